"""Joins."""

from pyspark.sql import functions as F

from ..operators import joins, retrieval
from ..operators.spread import top_per_group
from ..sources.bindings import corpus, met, qset, table, tel, vec
from . import query

CENTROIDS_SQL = """dims AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i
    FROM embeddings),
    cent AS (SELECT label AS query_id, list(m ORDER BY i) AS qv FROM
      (SELECT label, i, round(avg(x), 6) AS m FROM dims GROUP BY label, i) GROUP BY label)"""


def rankings(spark, d):
    """Two rankings of parts per brand, the ten best of each."""
    part = table(spark, d, "part")
    by_price = top_per_group(part.select("p_brand", "p_partkey", "p_retailprice"), ["p_brand"],
                             [F.desc("p_retailprice"), F.asc("p_partkey")], 10)
    by_size = top_per_group(part.select("p_brand", "p_partkey", "p_size"), ["p_brand"],
                            [F.desc("p_size"), F.asc("p_partkey")], 10)
    cols = ["p_brand AS query_id", "p_partkey AS doc_id", "rank"]
    return by_price.selectExpr(*cols), by_size.selectExpr(*cols)


RANKINGS_SQL = """a AS (SELECT p_brand AS query_id, p_partkey AS doc_id, row_number() OVER (PARTITION BY p_brand
    ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part QUALIFY rank <= 10),
    b AS (SELECT p_brand AS query_id, p_partkey AS doc_id, row_number() OVER (PARTITION BY p_brand
    ORDER BY p_size DESC, p_partkey) AS rank FROM part QUALIFY rank <= 10)"""

ASK_SQL = """asked AS (SELECT DISTINCT o_orderkey, upper(unnest(regexp_extract_all(t, '(?i)customer#\\d+'))) AS asked_id
    FROM (SELECT o_orderkey, 'Order ' || o_orderkey || ' for customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0')
    || ', copy to Customer#' || lpad(CAST(o_custkey + 1000 AS VARCHAR), 9, '0') AS t FROM orders))"""


def asked(spark, d):
    text = F.expr(
        "concat('Order ', o_orderkey, ' for customer#', lpad(o_custkey, 9, '0'), "
        "', copy to Customer#', lpad(o_custkey + 1000, 9, '0'))"
    )
    tickets = table(spark, d, "orders").select("o_orderkey", text.alias("t"))
    return joins.extract_ids(tickets, "o_orderkey", "t", r"(?i)customer#\d+")


@query(
    "j01_rank_list_merge",
    """SELECT query_id, doc_id, a.rank AS first_rank, b.rank AS second_rank FROM a FULL JOIN b
       USING (query_id, doc_id)""",
    ctes=RANKINGS_SQL,
)
def rank_list_merge(spark, d):
    a, b = rankings(spark, d)
    return retrieval.merge_lists({"first_rank": a, "second_rank": b})


@query(
    "j02_id_lookup",
    "SELECT o_orderkey, asked_id, c_custkey, c_mktsegment FROM asked JOIN customer ON asked_id = upper(c_name)",
    ctes=ASK_SQL,
)
def id_lookup(spark, d):
    customers = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return joins.lookup_ids(asked(spark, d), customers, "c_name").drop("c_name")


@query(
    "j03_missing_ids",
    "SELECT o_orderkey, asked_id FROM asked WHERE asked_id NOT IN (SELECT upper(c_name) FROM customer)",
    ctes=ASK_SQL,
)
def missing_ids(spark, d):
    return joins.missing_ids(asked(spark, d), table(spark, d, "customer"), "c_name").select("o_orderkey", "asked_id")


@query(
    "j04_terms_join_postings",
    """SELECT q.query_id, q.term, q.qtf, p.df, p.ctf FROM
       (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(regexp_extract_all(lower(text),
        '[A-Za-z0-9]+')) AS term FROM qset) GROUP BY ALL) q
       JOIN (SELECT term, count(DISTINCT doc_id) AS df, count(*) AS ctf FROM (SELECT doc_id,
        unnest(regexp_extract_all(lower(concat_ws(' ', text, region, equipment, severity)), '[A-Za-z0-9]+')) AS term
        FROM corpus) GROUP BY term) p USING (term)""",
    views="qset corpus",
)
def terms_join_postings(spark, d):
    index = retrieval.bm25_index(corpus(spark, d), "doc_id", ["text", "region", "equipment", "severity"])
    # Postings are combined per term first, so a frequent term joins as one row.
    return retrieval.query_terms(qset(spark, d), "query_id", "text").join(index.terms, "term")


@query(
    "j05_vectors_by_query",
    """SELECT query_id, doc_id, s AS score FROM (SELECT query_id, vec_id AS doc_id,
       round(list_cosine_similarity(embedding::DOUBLE[], qv), 6) AS s, row_number() OVER (PARTITION BY query_id
       ORDER BY round(list_cosine_similarity(embedding::DOUBLE[], qv), 6) DESC, vec_id) AS rank FROM embeddings, cent)
       WHERE rank <= 50""",
    ctes=CENTROIDS_SQL,
)
def vectors_by_query(spark, d):
    vectors = vec(spark, d)
    hits = retrieval.vector_search(vectors, "vec_id", "embedding", retrieval.centroids(vectors, "label", "embedding"),
                                   "query_id", "qv", k=50)
    return hits.select("query_id", "doc_id", "score")


@query(
    "j06_add_unseen",
    """SELECT query_id, doc_id, rank FROM a UNION ALL
       SELECT query_id, doc_id, rank FROM b ANTI JOIN a USING (query_id, doc_id)""",
    ctes=RANKINGS_SQL,
)
def add_unseen(spark, d):
    a, b = rankings(spark, d)
    return joins.add_unseen(a, b, ["query_id", "doc_id"])


@query("j07_subset_by_ids", "SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def subset_by_ids(spark, d):
    ids = table(spark, d, "lineitem").filter("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return joins.subset_by_ids(table(spark, d, "part").select("p_partkey", "p_name"), ids, "p_partkey")


@query(
    "j08_compare_expected",
    """SELECT doc_id, CASE WHEN quality IS NOT DISTINCT FROM CAST(n_chars >= 200 AS INT) THEN 1.0::DOUBLE
       ELSE 0.0::DOUBLE END AS score, quality IS NOT DISTINCT FROM CAST(n_chars >= 200 AS INT) AS passed
       FROM documents JOIN labels USING (doc_id)""",
)
def compare_expected(spark, d):
    got = (F.col("n_chars") >= 200).cast("int")
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    return joins.compare_expected(docs, table(spark, d, "labels"), "doc_id", F.col("quality"), got)


@query(
    "j09_side_by_side",
    """SELECT zone, readings, mean_freq, meter_rows, mean_power, incidents, critical FROM
       (SELECT zone, count(*) AS readings, round(avg(freq), 4) AS mean_freq FROM tel GROUP BY zone)
       FULL JOIN (SELECT concat('Zone_', chr(CAST(65 + meter_id % 4 AS INT))) AS zone, count(*) AS meter_rows,
         round(avg(power), 4) AS mean_power FROM met GROUP BY 1) USING (zone)
       FULL JOIN (SELECT CASE region WHEN 'en' THEN 'Zone_A' WHEN 'de' THEN 'Zone_B' WHEN 'fr' THEN 'Zone_C'
         ELSE 'Zone_E' END AS zone, count(*) AS incidents, count(*) FILTER (severity = 'critical') AS critical
         FROM corpus GROUP BY 1) USING (zone)""",
    views="tel met corpus",
)
def side_by_side(spark, d):
    zone = F.expr("CASE region WHEN 'en' THEN 'Zone_A' WHEN 'de' THEN 'Zone_B' WHEN 'fr' THEN 'Zone_C' ELSE 'Zone_E' END")
    grid = tel(spark, d).groupBy("zone").agg(F.count("*").alias("readings"), F.round(F.avg("freq"), 4).alias("mean_freq"))
    meters = met(spark, d).groupBy(F.expr("concat('Zone_', char(65 + meter_id % 4))").alias("zone")).agg(
        F.count("*").alias("meter_rows"), F.round(F.avg("power"), 4).alias("mean_power"))
    incidents = corpus(spark, d).groupBy(zone.alias("zone")).agg(
        F.count("*").alias("incidents"), F.count_if(F.col("severity") == "critical").alias("critical"))
    return joins.side_by_side([grid, meters, incidents], "zone")

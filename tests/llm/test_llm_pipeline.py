"""The pipeline, stage by stage and as a whole, against plain versions of its decisions."""

import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import plain
import pyarrow as pa
import tables
from busbar.llm import language_id, token_files
from pyspark.sql import functions as F


def _parquet(spark, rows, path):
    spark.createDataFrame(rows, tables.DOCS).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, tables.PASSAGE), (2, "never seen at all in here")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages_keep_the_columns_and_decide(spark, tmp_path):
    sf_dir = _parquet(spark, tables.documents(), tmp_path)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    told = corpus_pipeline.known_language(spark, docs, sf_dir).collect()
    assert all(any(c.isalpha() for c in r.text) for r in told)
    assert {5, 7, 11, 12, 300, 301} <= {r.doc_id for r in told}
    near = corpus_pipeline.no_near_duplicates(spark, docs, sf_dir)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    keep = Counter(rows[i] for i in plain.one_of_each(rows, 5, 80))
    assert Counter((r.doc_id, r.text) for r in near.collect()) == keep
    clean = corpus_pipeline.no_benchmark(spark, docs, sf_dir)
    items = [(1, tables.PASSAGE), (2, "never seen at all in here")]
    want = Counter(d for d, t in rows if not (lambda n, h, _: h > 0 and 20 * h >= n)(*plain.contamination(t, items)))
    assert Counter(r.doc_id for r in clean.collect()) == want
    for stage in (near, clean, corpus_pipeline.mixed(spark, docs, sf_dir)):
        assert stage.columns == docs.columns


def test_run_equals_its_plain_version(spark, tmp_path):
    sf_dir = _parquet(spark, tables.documents(), tmp_path)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [r.asDict() for r in language_id.identify(docs, language_id.public_vocabulary(), ~F.expr("crc32(cast(coalesce(cast(doc_id AS string), '') AS binary)) % 4 = 2")).collect()]
    rows = [r for r in rows if r["lang_pred"] != "und" and r["score"] >= 0.5]
    kept = [rows[i] for i in plain.one_of_each([(r["doc_id"], r["text"]) for r in rows], 5, 80)]
    kept = [r for r in kept if not (lambda n, h, _: h > 0 and 20 * h >= n)(*plain.contamination(r["text"], [(1, tables.PASSAGE)]))]
    sizes = Counter()
    for r in kept:
        sizes[r["source"]] += len(plain.words(r["text"]))
    targets = plain.targets(dict(sizes))
    got = corpus_pipeline.run(spark, sf_dir).collect()
    encoder = token_files.PieceEncoder(token_files.public_vocabulary())
    by_row = {}  # two texts may stand under one id
    for r in kept:
        ids = np.append(np.frombuffer(encoder.encode([r["text"]])[0], "<u4"), 0).astype("<u4")
        by_row[r["doc_id"], len(ids), zlib.crc32(ids.tobytes())] = r
    taken = Counter()
    for r in got:
        own = by_row[r.doc_id, r.n_tokens, r.ids_crc32]
        taken[own["source"]] += len(plain.words(own["text"]))
    longest = max(len(plain.words(r["text"])) for r in kept)
    assert all(abs(taken[s] - t) <= longest / 2 + 1 for s, t in targets.items())
    start = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens


def test_run_on_no_rows(spark, tmp_path):
    sf_dir = _parquet(spark, [], tmp_path)
    assert corpus_pipeline.run(spark, sf_dir).count() == 0


def test_texts_reach_python_a_few_megabytes_at_a_time(spark, tmp_path):
    sf_dir = _parquet(spark, tables.documents(), tmp_path)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    long = spark.range(0, 40, 1, 1).select(F.repeat(F.lit("0123456789abcdef"), 1 << 15).alias("text"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])

    for name, stage in corpus_pipeline.STAGES:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
        stage(spark, docs, sf_dir)
        got = long.mapInArrow(sizes, "n long, size long").collect()
        assert sum(r.n for r in got) == 40 and max(r.size for r in got) < 6 << 20, name

"""Mixing sources to target weights with a low-discrepancy schedule.

Every source is shuffled by a hash, laid out word after word and cut into blocks
of equally many words. The schedule's slots are golden-ratio points: slot k asks
the source in whose stretch of the cumulative weights the fraction of k times the
golden ratio falls, so each stretch of the schedule has the sources in their
shares up to a few slots. The slots of a source are ranked; rank r asks block r
of its layout, beginning anew after the last. Slots join blocks by source and
block, and a source's last slot takes only the words still missing. The slots
decide the order of the mix: a document stands where its first words are asked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import table

#: Production parameters: weights by rank of the source, words of the mix per word of input, passes at most.
WEIGHTS = (5.0, 2.0, 1.0)
SHARE, CAP = 1.5, 2
BLOCK_WORDS = 512
#: Rows of a source that are ordered in one task, on average; slots in one task.
BUCKET_ROWS, CHUNK_SLOTS = 2_000, 1 << 16

#: 2**64 divided by the golden ratio, odd: multiples of it, modulo 2**64, are the golden-ratio points exactly.
GOLDEN = 0x9E3779B97F4A7C15
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """Target of every source: its weighted part of the mix, at most `cap` times its size.

    What the capped sources leave is dealt to the others by weight until none is
    above its cap. With sources in the order of cap by weight this is one prefix
    sum: a source is capped if its part, of what the sources before it leave,
    reaches its cap. `sizes` has one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    numbered = sizes.withColumn("source_no", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("source_no") % len(weights) + 1).cast("int"))
    capped = numbered.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    every = Window.partitionBy()
    by_need = Window.orderBy(F.col("most") / F.col("weight"), "source_no")
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = capped.withColumn("level", left / open_weight)
    over = F.col("most") > F.col("weight") * F.col("level")  # right up to the first source for which it holds
    upto = by_need.rowsBetween(Window.unboundedPreceding, 0)
    opened = level.withColumn("full", F.count(F.when(over, 1)).over(upto) == 0).withColumn("own", F.when(over, F.col("level")))
    common = opened.withColumn("common", F.first("own", ignorenulls=True).over(by_need.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return common.select(
        "source", "source_no", "source_size",
        F.when(F.col("full"), F.col("most")).otherwise(F.col("weight") * F.col("common")).alias("target"),
    )


def _source_of(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return np.searchsorted(ends, points, side="right")


def slot_sources(first: int, n: int, slots: np.ndarray, step: int = GOLDEN) -> np.ndarray:
    """Sources asked by slots `first` to `first + n - 1`, given the slots each source needs; slot k has the point k + 1 times `step`."""
    with np.errstate(over="ignore"):
        points = (np.arange(first, first + n, dtype=np.uint64) + np.uint64(1)) * np.uint64(step)
    total, ends, upto = int(slots.sum()), [], 0
    for n_slots in slots.tolist():
        upto += n_slots
        ends.append(min((upto << 64) // total, (1 << 64) - 1))
    # A source without slots has an empty stretch; the last end takes the point that equals it.
    found = _source_of(points, np.array(ends, np.uint64))
    return np.minimum(found, np.flatnonzero(slots)[-1])


def _count_slots(slots: np.ndarray, step: int):
    total = int(slots.sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in batch.column(0).to_pylist():
                first = chunk * CHUNK_SLOTS
                n = np.bincount(slot_sources(first, min(CHUNK_SLOTS, total - first), slots, step))
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(some), pa.int64()), pa.array(some, pa.int64()), pa.array(n[some], pa.int64())], ["chunk", "source_no", "n"])

    return run


def _rank_slots(slots: np.ndarray, step: int):
    total = int(slots.sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                first = row["chunk"] * CHUNK_SLOTS
                source = slot_sources(first, min(CHUNK_SLOTS, total - first), slots, step)
                base = np.zeros(len(slots), np.int64)
                for b in row["bases"]:
                    base[b["source_no"]] = b["base"]
                order = np.argsort(source, kind="stable")
                by = source[order]
                begins = np.flatnonzero(np.r_[True, by[1:] != by[:-1]])
                rank = np.arange(len(by)) - np.repeat(begins, np.diff(np.r_[begins, len(by)])) + base[by]
                need = rank < slots[by]
                yield pa.RecordBatch.from_arrays([pa.array((first + order)[need], pa.int64()), pa.array(by[need], pa.int64()), pa.array(rank[need], pa.int64())], ["slot", "source_no", "rank"])

    return run


def schedule(spark: SparkSession, slots: np.ndarray, step: int = GOLDEN) -> DataFrame:
    """Slot, source and rank of the slot among its source's, as many per source as `slots` says.

    The slots asked too often of a source are passed over; the few that it lacks
    at the end of the schedule follow there.
    """
    shape = "slot long, source_no long, rank long"
    total = int(slots.sum())
    if not total:
        return spark.createDataFrame([], shape)
    chunks = spark.range(-(-total // CHUNK_SLOTS)).withColumnRenamed("id", "chunk")
    counts = chunks.mapInArrow(_count_slots(slots, step), "chunk long, source_no long, n long")
    upto = Window.partitionBy("source_no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("base", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    per_chunk = bases.groupBy("chunk").agg(F.collect_list(F.struct("source_no", "base")).alias("bases"))
    ranked = per_chunk.mapInArrow(_rank_slots(slots, step), shape)
    got = counts.groupBy("source_no").agg(F.sum("n").alias("n"))
    needs = spark.createDataFrame(pa.table({"source_no": np.arange(len(slots)), "slots": slots}))
    short = needs.join(got, "source_no", "left").fillna(0, ["n"]).filter("n < slots")
    late = short.select(F.explode(F.sequence("n", F.col("slots") - 1)).alias("rank"), "source_no")
    return ranked.unionByName(late.select((F.lit(total) + F.col("rank")).alias("slot"), "source_no", "rank"))


def mix(
    docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text",
    weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP, block_words: int = BLOCK_WORDS, step: int = GOLDEN,
) -> DataFrame:
    """Every row of `docs` with its words, its source's words and target, and the words that the mix takes of it.

    Null text has no words; an empty document is in no block and nothing is taken
    of it. A null source is a source, the last one. Rows are shuffled by a hash
    of their key, so a rerun gives the same mix; rows that share a key are
    ordered by their size. Each source gives its target to the word (rounded
    down), hence no row more than `cap` times its size. `first_slot` and
    `last_slot` are the slots of the schedule that take a row's first and last
    words; null if none does.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    rows = materialize(rows.withColumn("h", F.xxhash64("doc_id", F.lit("mix"))), "mix-sizes")
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    goals = targets(sums.drop("n"), weights, share, cap)
    quota = F.floor(F.col("target"))
    blocks = F.ceil(F.col("source_size") / block_words)
    passes = F.when(F.col("source_size") > 0, F.floor(quota / F.col("source_size"))).otherwise(0)
    goals = goals.withColumn("quota", quota).withColumn("blocks", blocks).withColumn("passes", passes)
    goals = goals.withColumn("rest", F.col("quota") - F.col("passes") * F.col("source_size"))
    goals = goals.withColumn("slots", (F.col("passes") * F.col("blocks") + F.ceil(F.col("rest") / block_words)).cast("long"))
    goals = materialize(goals, "mix-targets")
    slots = np.array([r.slots for r in goals.orderBy("source_no").select("slots").collect()], np.int64)  # one number per source

    # Places of the documents in their source's layout, by prefix sums over hash buckets.
    buckets = max(1, -(-rows.count() // BUCKET_ROWS))
    rows = rows.withColumn("bucket", F.pmod("h", F.lit(buckets)))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    bases = bases.select("source", "bucket", F.coalesce(F.sum("words").over(upto), F.lit(0)).alias("base"))
    goal = F.broadcast(goals) if len(slots) <= 100_000 else goals
    bases = bases.alias("b").join(goal.alias("g"), F.col("b.source").eqNullSafe(F.col("g.source"))).select("b.*", "g.source_no", "g.source_size", "g.target")
    inside = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size")
    rows = rows.select("*", F.row_number().over(inside).alias("nr"), (F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("inside"))
    same = (F.col("r.bucket") == F.col("b.bucket")) & F.col("r.source").eqNullSafe(F.col("b.source"))
    placed = rows.alias("r").join(bases.alias("b"), same).select(
        "r.doc_id", "r.source", "r.size", "r.bucket", "r.nr", "b.source_no", "b.source_size", "b.target", (F.col("b.base") + F.col("r.inside")).alias("lo")
    )
    # A document meets every block that holds words of it; an empty one has a block of its own that no slot asks.
    own = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("lo") / block_words), F.floor((F.col("lo") + F.col("size") - 1) / block_words)))
    pieces = placed.withColumn("block", F.explode(F.coalesce(own, F.array(-F.col("nr").cast("long")))))

    plan = schedule(spark, slots, step).join(goal.select("source_no", "blocks", "passes", "rest"), "source_no")
    plan = plan.select("slot", "source_no", (F.col("rank") % F.col("blocks")).alias("block"), F.floor(F.col("rank") / F.col("blocks")).alias("turn"), "passes", "rest")
    plan = plan.select("slot", "source_no", "block", F.when(F.col("turn") < F.col("passes"), (F.col("block") + 1) * block_words).otherwise(F.col("rest")).alias("upto"))
    start = F.greatest("lo", F.col("block") * block_words)
    end = F.least(F.col("lo") + F.col("size"), (F.col("block") + 1) * block_words, "upto")
    joined = pieces.join(plan, ["source_no", "block"], "left").withColumn("take", F.greatest(F.coalesce(end - start, F.lit(0)), F.lit(0)) * F.when(F.col("upto").isNull(), 0).otherwise(1))
    asked = F.when(F.col("take") > 0, F.col("slot"))
    out = joined.groupBy("source_no", "bucket", "nr", "doc_id", "source", "size", "source_size", "target").agg(
        F.sum("take").alias("taken"), F.min(asked).alias("first_slot"), F.max(asked).alias("last_slot"))
    return out.select("doc_id", "source", "size", "source_size", "target", "taken", "first_slot", "last_slot")


def mixed_documents(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", **how) -> DataFrame:
    """The mix as whole documents in the order of the schedule: each row of `docs` as often as the mix goes through it.

    The first copy stands at the slot that asks for the row's first words, the
    last one at the slot that takes its last, others evenly in between. A row
    of which the mix takes a part, at the end of its source's target, is in if
    that is at least half of it, so a source misses its target by at most half
    a document. Rows without words are in no block and go. Of rows that share
    key, source and size each comes as often as the one most taken. `docs` may
    have any other columns.
    """
    takes = mix(docs, key, source, text, **how).filter("size > 0")
    takes = takes.withColumn("copies", F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")).filter("copies > 0")
    takes = takes.groupBy("doc_id", "source", "size").agg(F.max("copies").alias("copies"), F.min("first_slot").alias("lo"), F.max("last_slot").alias("hi"))
    step = (F.col("hi") - F.col("lo")) / F.greatest(F.col("copies") - 1, F.lit(1))
    takes = takes.withColumn("slots", F.transform(F.sequence(F.lit(0), F.col("copies") - 1), lambda k: F.floor(F.col("lo") + k * step)))
    slot = "slot"
    while slot in docs.columns:
        slot += "_"
    size = F.coalesce(F.regexp_count(docs[text], F.lit(WORD)), F.lit(0))
    same = docs[key].eqNullSafe(takes["doc_id"]) & docs[source].eqNullSafe(takes["source"]) & (size == takes["size"])
    mixed = docs.join(takes, same).select(*[docs[c] for c in docs.columns], F.explode(takes["slots"]).alias(slot))
    return mixed.repartitionByRange(slot, F.xxhash64(key)).sortWithinPartitions(slot).drop(slot)


def op2_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op2_mixture": op2_mixture}
SQL: dict[str, str] = {}

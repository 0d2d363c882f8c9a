"""Connected components of a stored table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(links: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """`vid` and `comp`, the smallest vid that links lead to, of every vid in `links` (columns a and b).

    Each round a vertex takes the smallest label around it and then its label's
    label, so a label crosses a chain in about as many rounds as its length has
    digits in base two. All rounds are joins and grouped minima; each is written
    to the shared folder, which cuts the lineage.
    """
    spark, scratch = links.sparkSession, scratch or Scratch()
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = scratch.keep(both.filter("a <> b").distinct(), "edges")
    labels = scratch.keep(edges.groupBy(F.col("a").alias("vid")).agg(F.min(F.least("a", "b")).alias("comp")), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("vid", "b"), "b").groupBy(F.col("a").alias("vid")).agg(F.min("comp").alias("near"))
        lower = labels.join(near, "vid").select("vid", F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
        top = lower.select(F.col("vid").alias("comp"), F.col("comp").alias("next"))
        jumped = lower.join(top, "comp").select("vid", "was", F.least("comp", "next").alias("comp"))
        found = scratch.keep(jumped, "labels")
        labels = found.select("vid", "comp")
        if found.filter("comp <> was").isEmpty():
            scratch.drop(spark, "edges")
            return labels

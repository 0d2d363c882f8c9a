"""A stored table that takes in changes by key without being rewritten.

Rows lie in buckets by a hash of their key, one folder each. A batch of changes
is written beside them, under the batch's number and by bucket too; the same
batch written again replaces itself, so a repeated job does no harm. Reading
merges the two: buckets without changes are read as they are, in the others the
newest row of each key wins. Compaction writes those buckets anew, and no
others.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

#: What the library adds to a row: its bucket, the batch it came with, and whether it says that the key is gone.
BUCKET, BATCH, GONE = "_bucket", "_batch", "_gone"
_HELPERS = (BUCKET, BATCH, GONE)


@dataclass
class StoredTable:
    """`keys` name a row, the row with the largest `version` is the newest; of equal versions the later batch wins."""

    spark: SparkSession
    path: str
    keys: list[str]
    version: str
    buckets: int
    schema: T.StructType

    # --- files

    def _fs(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _folders(self, *parts: str) -> list[str]:
        """Names of the folders below a path; buckets and open batches are few."""
        place = self._at(*parts)
        if not self._fs().exists(place):
            return []
        return sorted(s.getPath().getName() for s in self._fs().listStatus(place) if s.isDirectory())

    def batches(self) -> list[int]:
        """Batches that are not compacted yet; one that broke off has no mark and does not count."""
        found = [f for f in self._folders("changes") if f.startswith("batch=")]
        return sorted(int(f[6:]) for f in found if self._fs().exists(self._at("changes", f, "_SUCCESS")))

    def touched(self) -> list[int]:
        """Buckets that have changes."""
        found = set()
        for b in self.batches():
            found |= {int(f.split("=")[1]) for f in self._folders("changes", f"batch={b}") if f.startswith(BUCKET)}
        return sorted(found)

    # --- rows

    def _bucketed(self, rows: DataFrame, batch: int) -> DataFrame:
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        return rows.withColumns({BATCH: F.lit(batch).cast("long"), BUCKET: bucket})

    def _write(self, rows: DataFrame, path: str, only: bool) -> None:
        """Replace what is at `path`, or `only` the buckets that have rows. Rows of a bucket may be more than one task's: they are dealt by key as well."""
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = rows.repartitionByRange(n, BUCKET, F.xxhash64(*self.keys)).sortWithinPartitions(BUCKET)
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if only else "static").partitionBy(BUCKET).parquet(path)

    def _stored(self, path: str) -> DataFrame:
        shape = T.StructType([*self.schema.fields, T.StructField(GONE, T.BooleanType()), T.StructField(BATCH, T.LongType()), T.StructField(BUCKET, T.IntegerType())])
        return self.spark.read.schema(shape).parquet(path)

    def _changes(self) -> DataFrame | None:
        out = None
        for b in self.batches():
            part = self._stored(f"{self.path}/changes/batch={b}")
            out = part if out is None else out.unionByName(part)
        return out

    def _merged(self, buckets: Sequence[int]) -> DataFrame:
        """The newest row of every key in some buckets; what is gone is still there, marked."""
        own = F.col(BUCKET).isin(list(buckets))
        both = self._stored(f"{self.path}/rows").filter(own).unionByName(self._changes().filter(own))
        rest = [c for c in both.columns if c not in self.keys]
        newest = F.max_by(F.struct(*rest), F.struct(self.version, BATCH)).alias("_r")
        return both.groupBy(*self.keys).agg(newest).select(*self.keys, "_r.*").select(*both.columns)

    def read(self) -> DataFrame:
        """The table as it is now."""
        stored, touched = self._stored(f"{self.path}/rows"), self.touched()
        if touched:
            stored = stored.filter(~F.col(BUCKET).isin(touched)).unionByName(self._merged(touched))
        return stored.filter(~F.col(GONE)).select(*self.schema.names)

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """The rows of some keys. The buckets of the keys are found first, and no other is read."""
        asked = self._bucketed(wanted.select(*self.keys).distinct(), 0).select(*self.keys, BUCKET)
        asked = materialize(asked, "asked-keys")
        buckets = [r[0] for r in asked.select(BUCKET).distinct().collect()]  # at most `buckets`
        touched = set(self.touched()) & set(buckets)
        stored = self._stored(f"{self.path}/rows").filter(F.col(BUCKET).isin([b for b in buckets if b not in touched]))
        if touched:
            stored = stored.unionByName(self._merged(sorted(touched)))
        return stored.filter(~F.col(GONE)).join(asked, [*self.keys, BUCKET], "left_semi").select(*self.schema.names)

    # --- changes

    def upsert(self, rows: DataFrame, batch: int) -> None:
        """Take in new and changed rows as batch number `batch`; a batch that is there already is replaced by this one.

        Of rows with one key in a batch the newest counts. A batch that has been
        compacted is known, and not taken in again.
        """
        self._take(rows.select(*self.schema.names).withColumn(GONE, F.lit(False)), batch)

    def delete(self, rows: DataFrame, batch: int) -> None:
        """Take out the keys of `rows`, which also have the version at which they go."""
        have = set(rows.columns)
        blank = [F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields]
        self._take(rows.select(*blank).withColumn(GONE, F.lit(True)), batch)

    def _take(self, rows: DataFrame, batch: int) -> None:
        if batch <= self._about()["compacted"]:
            return
        rows = materialize(self._bucketed(rows, batch), "changes")
        place = self._at("changes", f"batch={batch}")
        self._fs().delete(place, True)
        if rows.isEmpty():
            self.spark.createDataFrame([], rows.schema).write.mode("overwrite").parquet(f"{self.path}/changes/batch={batch}")
        else:
            self._write(rows, f"{self.path}/changes/batch={batch}", only=False)

    def compact(self) -> list[int]:
        """Write the buckets that have changes anew, and give up the changes. Broken off, it can be run again."""
        touched, batches = self.touched(), self.batches()
        if touched:
            merged = materialize(self._merged(touched).filter(~F.col(GONE)), "compacted")
            self._write(merged, f"{self.path}/rows", only=True)
            left = {r[0] for r in merged.select(BUCKET).distinct().collect()}
            for b in set(touched) - left:  # a dynamic overwrite leaves a bucket that lost all rows as it is
                self._fs().delete(self._at("rows", f"{BUCKET}={b}"), True)
        if batches:
            self._remember(batches[-1])
            for b in batches:
                self._fs().delete(self._at("changes", f"batch={b}"), True)
        return touched

    # --- what is known of the table itself

    def _remember(self, compacted: int) -> None:
        about = {"keys": self.keys, "version": self.version, "buckets": self.buckets, "schema": self.schema.jsonValue(), "compacted": compacted}
        self.spark.createDataFrame([(json.dumps(about),)], "about string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/about")

    def _about(self) -> dict:
        return json.loads(self.spark.read.parquet(f"{self.path}/about").first()["about"])


def create_table(rows: DataFrame, path: str, keys: Sequence[str], version: str, buckets: int = 64) -> StoredTable:
    """Store `rows` as a new table; of rows with one key the newest stays. Null keys are keys."""
    if clash := set(_HELPERS) & set(rows.columns):
        raise ValueError(f"columns {sorted(clash)} are used by the table itself")
    out = StoredTable(rows.sparkSession, path, list(keys), version, buckets, rows.schema)
    first = out._bucketed(rows.withColumn(GONE, F.lit(False)), -1)
    rest = [c for c in first.columns if c not in out.keys]
    newest = F.max_by(F.struct(*rest), F.col(version)).alias("_r")
    first = materialize(first.groupBy(*out.keys).agg(newest).select(*out.keys, "_r.*").select(*first.columns), "first-rows")
    if first.isEmpty():
        first.write.mode("overwrite").parquet(f"{path}/rows")
    else:
        out._write(first, f"{path}/rows", only=False)
    out._remember(-1)
    return out


def open_table(spark: SparkSession, path: str) -> StoredTable:
    about = json.loads(spark.read.parquet(f"{path}/about").first()["about"])
    return StoredTable(spark, path, about["keys"], about["version"], about["buckets"], T.StructType.fromJson(about["schema"]))

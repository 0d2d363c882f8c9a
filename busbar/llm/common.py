"""Tables, shared files and skew-proof joins that the operators have in common."""

from __future__ import annotations

import contextlib
import os
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import prepare, work_path

#: Groups with more than 1/HOT_SHARE of all rows are joined by broadcast; there are fewer than HOT_SHARE of them.
HOT_SHARE = 1000

#: Bytes that end a word are ASCII space and the five controls from tab to carriage return.
SPACES = b" \t\n\x0b\x0c\r"

#: Lower-cases A-Z and nothing else; the bytes of longer UTF-8 sequences are never in that range.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

UPPER_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER_LETTERS, UPPER_LETTERS.lower())


def utf8(values: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """The strings of an Arrow column as bytes."""
    return values.cast(pa.binary()).to_pylist()


def held_out(ids: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls in `fold`; a null id counts as empty text."""
    return F.crc32(F.coalesce(ids.cast("string"), F.lit("")).cast("binary")) % folds == fold


def crc_of(doc_id: int | None) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode())


def annotate(docs: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]], added: str) -> DataFrame:
    """`docs` with more columns, computed batch by batch without a shuffle.

    `make` sets up once per task and returns a function from a batch to the
    arrays of the columns `added` names as DDL. A column of `docs` that has one
    of those names is replaced.
    """
    more = StructType.fromDDL(added)
    kept = [f for f in docs.schema.fields if f.name not in more.names]
    names = [f.name for f in kept] + more.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows:
                arrays = [batch.column(f.name) for f in kept] + step(batch)
                yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.mapInArrow(run, StructType([*kept, *more.fields]))


def per_batch(make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]]):
    """For `mapInArrow`: `make` sets up once per task, what it returns turns one batch into one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows:
                yield step(batch)

    return run


_HELD: list = []


def take_over(name: str, clear: Callable[[], None]) -> None:
    """Tell that a task of operator `name` keeps something in its worker, and how that is given up.

    Workers serve one operator after another; what the one before has kept is
    given up as soon as another begins.
    """
    if _HELD and _HELD[0] != name:
        _HELD[1]()
    _HELD[:] = [name, clear]


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Left join of many rows with one row per group, in one pass, whatever the largest group is.

    Groups that hold more than 1/HOT_SHARE of all `total` rows are fewer than
    HOT_SHARE, so they are broadcast; rows of those groups, and rows without a
    key, go on under keys of their own and spread evenly. No other key has more
    than that share.
    """
    floor = max(total // HOT_SHARE, 1)
    values = [c for c in groups.columns if c != key]
    hot = groups.filter(F.col(size) > floor).select(key, F.struct(*values).alias("_hot"))
    cold = groups.filter(F.col(size) <= floor).select(F.col(key).alias("_key"), F.struct(*values).alias("_cold"))
    out = rows.join(F.broadcast(hot), key, "left")
    own = F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string"))
    out = out.withColumn("_key", F.coalesce(F.when(F.col("_hot").isNull(), F.col(key).cast("string")), own))
    out = out.join(cold.withColumn("_key", F.col("_key").cast("string")), "_key", "left")
    group = F.coalesce("_hot", "_cold")
    return out.select(*rows.columns, *(group[v].alias(v) for v in values))


class Scratch:
    """Tables that an operator writes to the shared folder and deletes when it is done with them."""

    def __init__(self) -> None:
        self.paths: dict[str, str] = {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write `df` and read it back; a table of that name that is there already is deleted."""
        path = work_path(df.sparkSession, name)
        df.write.parquet(path)
        self.drop(df.sparkSession, name)
        self.paths[name] = path
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def drop(self, spark: SparkSession, *names: str) -> None:
        """Delete these tables, or all."""
        for name in names or list(self.paths):
            if path := self.paths.pop(name, None):
                old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)


class SharedFolder:
    """Files below one URI of the shared folder, from the driver or from a task.

    A file appears under its name only when it is whole, so a task that runs
    twice or dies half-way leaves one valid file or none.
    """

    def __init__(self, uri: str):
        self.uri = uri
        self.files, self.root = fs.FileSystem.from_uri(uri)

    def __reduce__(self):
        return SharedFolder, (self.uri,)

    @contextlib.contextmanager
    def create(self, name: str):
        self.files.create_dir(self.root, recursive=True)
        draft = f"{self.root}/.{name}.{uuid.uuid4().hex}"
        with self.files.open_output_stream(draft) as out:
            yield out
        self.files.move(draft, f"{self.root}/{name}")

    def open(self, name: str):
        return self.files.open_input_file(f"{self.root}/{name}")

    def local(self, name: str) -> str | None:
        """The file's place if it can be opened as it is, for memory maps."""
        path = f"{self.root}/{name}"
        return path if isinstance(self.files, fs.LocalFileSystem) and os.path.exists(path) else None


def spread_files(manifest: DataFrame) -> DataFrame:
    """A stored list of files, a few per task."""
    spark = manifest.sparkSession
    return manifest.repartition(max(1, min(manifest.count(), 8 * spark.sparkContext.defaultParallelism)))


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit values (the splitmix finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x

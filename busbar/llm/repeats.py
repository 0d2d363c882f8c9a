"""Removal of long repeated byte strings, found with suffix arrays.

A byte goes if a string of `length` bytes that covers it also starts anywhere
else, in the same document or another. Strings never cross documents.

No suffix array of the whole corpus is built. Of the core-sized strings inside
every window of `length` bytes, the one with the least hash is the window's
core, so equal windows have equal cores at equal places, and one occurrence of
a core serves a whole run of windows. Cores that occur once are dropped. What
is left of an occurrence is its context: the bytes before and behind the core
that its windows reach. Contexts of one core that are equal cover each other;
those that differ are written behind one another, the core as one symbol, and
the suffix array of that text (see `suffix_groups`) tells which windows repeat.
A core with very many different contexts is cut into shorter runs of windows,
which have longer cores, and in the end into single windows, which are counted.

Documents are stored once, in files of a bounded size. Tasks read one file or
the contexts of some cores; only hashes, contexts and spans are shuffled.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import work_path
from .common import HOT_SHARE, Scratch, SharedFolder, join_groups, mix64, table
from .suffix_groups import repeated_starts

LENGTH = 400
#: Bytes of text in a stored file, and windows looked at together.
FILE_BYTES = 8 << 20
BLOCK = 1 << 18
#: Symbols in one suffix array, and contexts of one core above which its runs are cut.
ARRAY_SYMBOLS = 200_000
GROUP_CONTEXTS = 1_000
#: Windows in a run at each cut.
CUTS = (8, 1)

_FACTOR = 0x9E3779B97F4A7C15
_PLACE_BITS = 24
_CONTEXT = "core long, kind long, head binary, tail binary, file long, cid int, shift int, times int"
_SPANS = "file long, cid int, lo int, hi int"


def core_bytes(length: int) -> int:
    return max(length * 3 // 4, 1)


class Hasher:
    """Cores of all windows in a buffer of documents."""

    def __init__(self, length: int):
        self.length, self.core = length, core_bytes(length)
        self.reach = length - self.core  # a core starts at most so far behind its window
        size = BLOCK + length + 1
        self.up = np.full(size, _FACTOR, np.uint64)
        self.down = np.full(size, pow(_FACTOR, -1, 1 << 64), np.uint64)
        self.up[0] = self.down[0] = 1
        self.up, self.down = np.multiply.accumulate(self.up), np.multiply.accumulate(self.down)

    def cores(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """Hash and place of each core, first and last window that it serves, and the document; all places are in `data`."""
        parts = [self._block(data[lo : lo + BLOCK + self.length - 1], lo, ends) for lo in range(0, max(len(data) - self.length + 1, 0), BLOCK)]
        if not parts:
            return tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64, np.int64))
        return tuple(np.concatenate(x) for x in zip(*parts))

    def _block(self, data: np.ndarray, at: int, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        n, core, wide = len(data), self.core, self.reach + 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.down[:n], out=sums[1:])
        hashes = mix64((sums[core:] - sums[:-core]) * self.up[: n - core + 1])
        low = np.uint64(_PLACE_BITS)
        keys = (hashes >> low << low) | np.arange(len(hashes), dtype=np.uint64)
        m = len(keys) - wide + 1
        tiles = np.append(keys, np.full(-len(keys) % wide, ~np.uint64(0))).reshape(-1, wide)
        ahead = np.minimum.accumulate(tiles, axis=1).ravel()
        behind = np.minimum.accumulate(tiles[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(behind[:m], ahead[wide - 1 : wide - 1 + m])
        place = (least & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
        windows = np.arange(m)
        doc = np.searchsorted(ends, windows + at, "right")
        inside = windows + at + self.length <= ends[np.minimum(doc, len(ends) - 1)]
        windows, place, doc = windows[inside], place[inside], doc[inside]
        if not len(windows):
            return hashes[:0], place, place, place, doc
        new = np.append(True, (np.diff(place) != 0) | (np.diff(windows) != 1) | (np.diff(doc) != 0))
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(windows)) - 1
        return hashes[place[first]], place[first] + at, windows[first] + at, windows[last] + at, doc[first]


def _read_docs(folder: SharedFolder, file: int) -> tuple[list, np.ndarray, np.ndarray]:
    """Keys of a stored file's documents, all their bytes, and where each ends."""
    with folder.open(f"docs-{file:016x}") as f:
        got = pq.read_table(f)
    data = got.column("text").combine_chunks()
    data = data.chunk(0) if isinstance(data, pa.ChunkedArray) else data
    bounds = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1] if len(data) else np.zeros(1, np.int64)
    raw = np.frombuffer(data.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    return got.column("key").to_pylist(), raw, bounds[1:] - bounds[0]


def _store_task(folder: SharedFolder, key_type: pa.DataType, length: int):
    """Writes files of documents; a row for each core hash of a file, and one without a hash for the file."""

    def flush(file: int, keys: list, texts: list[bytes], hasher: Hasher) -> pa.RecordBatch:
        sink = io.BytesIO()
        stored = pa.table({"key": pa.array(keys, key_type), "text": pa.array(texts, pa.large_binary())})
        pq.write_table(stored, sink, compression="zstd", use_dictionary=False, row_group_size=max(len(keys), 1))
        with folder.create(f"docs-{file:016x}") as out:
            out.write(sink.getbuffer())
        ends = np.cumsum([len(t) for t in texts])
        cores, n = np.unique(hasher.cores(np.frombuffer(b"".join(texts), np.uint8), ends)[0], return_counts=True)
        hashes = pa.array([None], pa.int64()), pa.array(cores.view(np.int64))
        times = np.append(0, np.minimum(n, 2)).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.concat_arrays(hashes), pa.array(np.full(len(times), file)), pa.array(times)], ["core", "file", "times"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, numbers = Hasher(length), count(TaskContext.get().taskAttemptId() << 24)
        keys, texts, held = [], [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                own = part.column(1).cast(pa.large_binary()).to_pylist()
                for key, text in zip(part.column(0).to_pylist(), own):
                    keys.append(key)
                    texts.append(text or b"")
                    held += len(texts[-1])
                    if held >= FILE_BYTES:
                        yield flush(next(numbers), keys, texts, hasher)
                        keys, texts, held = [], [], 0
        if keys:
            yield flush(next(numbers), keys, texts, hasher)

    return run


def _contexts_task(folder: SharedFolder, length: int):
    """For a file and its repeated cores: every different context, and a side file that says where each occurs."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        file = key[0].as_py()
        _, data, ends = _read_docs(folder, file)
        hasher = Hasher(length)
        wanted = np.sort(rows.column("core").to_numpy().view(np.uint64))
        cores, place, first, last, doc = hasher.cores(data, ends)
        at = np.searchsorted(wanted, cores)
        keep = wanted[np.minimum(at, len(wanted) - 1)] == cores
        cores, place, first, last, doc = (x[keep] for x in (cores, place, first, last, doc))
        raw, size = data.tobytes(), hasher.core
        known: dict[tuple, int] = {}
        times: list[int] = []
        cids = np.empty(len(cores), np.int32)
        signed = cores.view(np.int64).tolist()
        for k, (c, p, lo, hi) in enumerate(zip(signed, place.tolist(), first.tolist(), last.tolist())):
            kind = xxhash.xxh3_64_intdigest(raw[p : p + size]) - (1 << 63)
            context = c, kind, raw[lo:p], raw[p + size : hi + length]
            cid = cids[k] = known.setdefault(context, len(known))
            if cid == len(times):
                times.append(1)
            else:
                times[cid] = 2
        sink = io.BytesIO()
        np.savez(sink, doc=doc, place=place, cid=cids)
        with folder.create(f"places-{file:016x}") as out:
            out.write(sink.getbuffer())
        cols = list(zip(*known)) if known else [[], [], [], []]
        arrays = [pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))]
        n = len(known)
        arrays += [pa.array(np.full(n, file)), pa.array(np.arange(n, dtype=np.int32)), pa.array(np.zeros(n, np.int32)), pa.array(times, pa.int32())]
        return pa.Table.from_arrays(arrays, names=["core", "kind", "head", "tail", "file", "cid", "shift", "times"])

    return run


def cut_runs(row: dict, run: int, width: int, size: int) -> Iterator[dict]:
    """A context whose run has at most `run` windows as contexts of runs of `width` windows.

    `size` is the length of its core. Windows are counted back from the core's
    place, so equal windows fall into equal pieces. What all windows of a piece
    have in common is added to the core.
    """
    head, tail = row["head"], row["tail"]
    length = size + run - 1
    most = len(head)  # the first window starts so far before the core, the last one ends with the tail
    least = most - (len(head) + size + len(tail) - length)
    for piece in range(least // width, most // width + 1):
        near, far = max(piece * width, least), min(piece * width + width - 1, most)  # distances of the piece's windows
        inner = min(piece * width, run - width)  # the new core begins so far before the old one ...
        after = length - size - inner - width + 1  # ... and ends so far behind it
        fixed_head, fixed_tail = head[len(head) - inner :] if inner else b"", tail[:after]
        mark = xxhash.xxh3_128_digest(b"%d,%d,%d,%d;" % (row["core"], row["kind"], piece, inner) + fixed_head + fixed_tail)
        core, kind = np.frombuffer(mark, np.int64).tolist()
        yield row | {
            "core": core, "kind": kind, "shift": row["shift"] - inner,
            "head": head[len(head) - far : len(head) - inner], "tail": tail[after : length - size - near],
        }


def _cut_task(run: int, width: int, size: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                rows = [piece for row in batch.slice(lo, 500).to_pylist() for piece in cut_runs(row, run, width, size)]
                yield pa.RecordBatch.from_pylist(rows, batch.schema)

    return task


class _Groups:
    """Reads contexts in the order of their cores; gives the spans that repeat, and hands on too large groups."""

    def __init__(self, run: int, size: int):
        self.run, self.size = run, size
        self.texts: list[tuple[bytes, bytes, list[tuple[int, int, int]], bool]] = []  # of one group: contexts with their places
        self.pending: list[list] = []  # groups for the next suffix array
        self.symbols = 0
        self.spans: list[tuple[int, int, int, int]] = []

    def end_group(self) -> None:
        texts, self.texts = self.texts, []
        for head, tail, places, twice in texts:
            if twice:  # equal contexts cover each other
                self.spans += [(f, c, s - len(head), s + self.size + len(tail)) for f, c, s in places]
        if len(texts) > 1 and not all(x[3] for x in texts):
            self.pending.append(texts)
            self.symbols += sum(len(x[0]) + len(x[1]) + 2 for x in texts)
            if self.symbols >= ARRAY_SYMBOLS:
                self.sort()

    def sort(self) -> None:
        groups, self.pending, self.symbols = self.pending, [], 0
        if not groups:
            return
        parts, starts, owners, at = [], [], [], 0
        for g, texts in enumerate(groups):
            for head, tail, places, twice in texts:
                part = np.empty(len(head) + len(tail) + 2, np.int64)
                part[: len(head)] = np.frombuffer(head, np.uint8)
                part[len(head)] = 257 + g  # the core
                part[len(head) + 1 : -1] = np.frombuffer(tail, np.uint8)
                part[-1] = 256
                parts.append(part)
                own = np.arange(len(part) - self.run)
                starts.append(own + at)
                owners.append((head, places, twice, len(own)))
                at += len(part)
        found = repeated_starts(np.concatenate(parts), np.concatenate(starts), self.run)
        at = 0
        for head, places, twice, n in owners:
            own = np.flatnonzero(found[at : at + n])
            at += n
            if twice or not len(own):
                continue
            # the windows reach over the core, so all that repeat cover one stretch
            lo, hi = int(own[0]) - len(head), int(own[-1]) - len(head) + self.run - 1 + self.size
            self.spans += [(f, c, s + lo, s + hi) for f, c, s in places]

    def take(self) -> list[tuple[int, int, int, int]]:
        spans, self.spans = self.spans, []
        return spans


def _groups_task(run: int, size: int):
    """Sorted contexts to spans (kind 0) and to rows of groups that are too large (kind 1)."""
    names = ["core", "kind", "head", "tail", "file", "cid", "shift", "times"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, group, large = _Groups(run, size), None, False

        def out(spans, rest):
            cols = list(zip(*spans)) if spans else [[], [], [], []]
            span_array = pa.StructArray.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int32()))], ["file", "cid", "lo", "hi"])
            span_part = pa.concat_arrays([span_array, pa.nulls(len(rest), span_array.type)])
            types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
            cols = list(zip(*rest)) if rest else [[] for _ in names]
            rest_array = pa.StructArray.from_arrays([pa.array(x, t) for x, t in zip(cols, types)], names)
            rest_part = pa.concat_arrays([pa.nulls(len(spans), rest_array.type), rest_array])
            return pa.RecordBatch.from_arrays([span_part, rest_part], ["span", "rest"])

        for batch in batches:
            rest = []
            for row in zip(*(batch.column(n).to_pylist() for n in names)):
                core, kind, head, tail, file, cid, shift, times = row
                if (core, kind) != group:
                    groups.end_group()
                    group, large = (core, kind), False
                if large:
                    rest.append(row)
                    continue
                texts = groups.texts
                if texts and texts[-1][0] == head and texts[-1][1] == tail:
                    texts[-1][2].append((file, cid, shift))
                    texts[-1] = (head, tail, texts[-1][2], True)
                else:
                    texts.append((head, tail, [(file, cid, shift)], times > 1))
                    if len(texts) > GROUP_CONTEXTS:
                        rest += [(core, kind, h, t, f, c, s, 2 if twice else 1) for h, t, places, twice in texts for f, c, s in places]
                        groups.texts, large = [], True
            yield out(groups.take(), rest)
        groups.end_group()
        groups.sort()
        yield out(groups.take(), [])

    return task


def _removal_task(folder: SharedFolder, key_type: pa.DataType, names: list[str], with_kept: bool):
    """For a file and the spans of its contexts: what each document keeps."""

    def run(key: tuple, files: pa.Table, spans: pa.Table) -> pa.Table:
        file = (files if files.num_rows else spans).column("file")[0].as_py()
        keys, data, ends = _read_docs(folder, file)
        change = np.zeros(len(data) + 1, np.int32)
        if spans.num_rows:
            with folder.open(f"places-{file:016x}") as f:
                at = np.load(io.BytesIO(f.read()))
            cid, lo, hi = (spans.column(c).to_numpy() for c in ("cid", "lo", "hi"))
            order = np.argsort(at["cid"], kind="stable")
            sorted_cid = at["cid"][order]
            a, b = np.searchsorted(sorted_cid, cid, "left"), np.searchsorted(sorted_cid, cid, "right")
            n = b - a
            own = order[np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            place = at["place"][own]
            np.add.at(change, place + np.repeat(lo, n), 1)
            np.add.at(change, place + np.repeat(hi, n), -1)
        gone = np.cumsum(change[:-1]) > 0
        rows = []
        for k, (name, hi) in enumerate(zip(keys, ends.tolist())):
            lo = int(ends[k - 1]) if k else 0
            mask = gone[lo:hi]
            kept = data[lo:hi][~mask].tobytes()
            edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
            pairs = [{"start": s, "end": e} for s, e in edges.reshape(-1, 2).tolist()]
            rows.append((name, hi - lo, int(mask.sum()), len(pairs), hashlib.sha256(kept).hexdigest(), pairs, kept if with_kept else None))
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        types = [key_type, pa.int64(), pa.int64(), pa.int64(), pa.string(), span, pa.binary()]
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=names)

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text", with_kept: bool = True) -> DataFrame:
    """Per row of `docs`: its key, n_bytes, n_removed, n_spans, kept_sha256, spans (start and end of every maximal
    removed run, in bytes of the UTF-8 text) and kept (the remaining bytes, which may cut a
    character in two; null unless `with_kept`).

    A null text is an empty one; a text of fewer than `length` bytes loses
    nothing. Repeated rows and rows without a key are documents like others, so
    copies of `length` bytes or more lose all their bytes. Texts of any length
    are read whole. Other columns of `docs`, whatever their names, are not
    looked at and not returned. No rows give no rows.
    """
    spark = docs.sparkSession
    folder, scratch = SharedFolder(work_path(spark, "repeat-files")), Scratch()
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    key_field = rows.schema["key"]
    key_type = pa.schema([("key", pa.int64())]).field(0).type if key_field.dataType.simpleString() == "bigint" else pa.string()
    if key_type == pa.string():
        rows = rows.withColumn("key", F.col("key").cast("string"))
    found = scratch.keep(rows.mapInArrow(_store_task(folder, key_type, length), "core long, file long, times int"), "cores")
    files = found.filter("core IS NULL").select("file")
    tasks = max(files.count(), 1)  # a task for a file: its shuffled rows are few, its text is not
    cores = found.filter("core IS NOT NULL")
    twice = cores.groupBy("core").agg(F.sum("times").alias("n")).filter("n > 1").select("core")
    repeated = cores.select("core", "file").join(twice, "core", "left_semi")
    contexts = scratch.keep(repeated.repartition(tasks, "file").groupBy("file").applyInArrow(_contexts_task(folder, length), _CONTEXT), "contexts")

    run, size, spans = length - core_bytes(length) + 1, core_bytes(length), []
    for width in (*(c for c in CUTS if c < run), None):
        if run == 1:
            spans.append(_single_windows(contexts, size))
            break
        total = contexts.count()
        hot = contexts.groupBy("core").count().filter(F.col("count") > max(GROUP_CONTEXTS, total // HOT_SHARE)).select("core")
        hot = F.broadcast(hot)  # fewer than HOT_SHARE
        even = contexts.join(hot, "core", "left_anti").repartition("core").sortWithinPartitions("core", "kind", "head", "tail")
        sorted_out = scratch.keep(even.mapInArrow(_groups_task(run, size), f"span struct<{_as_struct(_SPANS)}>, rest struct<{_as_struct(_CONTEXT)}>"), f"groups-{run}")
        spans.append(sorted_out.filter("span IS NOT NULL").select("span.*"))
        large = contexts.join(hot, "core", "left_semi").unionByName(sorted_out.filter("rest IS NOT NULL").select("rest.*"))
        if width is None:
            break
        contexts = scratch.keep(large.mapInArrow(_cut_task(run, width, size), _CONTEXT), f"cut-{width}")
        size, run = size + run - width, width
    all_spans = spans[0]
    for more in spans[1:]:
        all_spans = all_spans.unionByName(more)
    names = [key, "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"]
    kind = "long" if key_type == pa.int64() else "string"
    schema = f"`{key}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>, kept binary"
    files, all_spans = files.repartition(tasks, "file"), all_spans.repartition(tasks, "file")
    out = files.groupBy("file").cogroup(all_spans.groupBy("file")).applyInArrow(_removal_task(folder, key_type, names, with_kept), schema)
    return out.withColumn(key, F.col(key).cast(key_field.dataType))


def _as_struct(ddl: str) -> str:
    return ", ".join(":".join(c.split()) for c in ddl.split(", "))


def _single_windows(windows: DataFrame, size: int) -> DataFrame:
    """Runs of one window are equal if their cores are; they are counted."""
    windows = windows.withColumn("window", F.concat_ws(":", "core", "kind"))
    counts = windows.groupBy("window").agg(F.sum("times").alias("n"), F.count("*").alias("rows"))
    found = join_groups(windows, counts, "window", "rows", windows.count())
    return found.filter("n > 1").select("file", "cid", F.col("shift").alias("lo"), (F.col("shift") + size).alias("hi"))


def op12_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs, with_kept=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


_HEX = "hex(encode(coalesce(text, '')))"
QUERIES = {"op12_repeats": op12_repeats}
SQL = {
    "op12_repeats": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_HEX} AS h, length({_HEX}) // 2 AS n FROM documents),
w AS (SELECT r, h, unnest(range(0, n - {LENGTH} + 1)) AS s FROM d WHERE n >= {LENGTH}),
m AS (SELECT r, s, md5(substr(h, 2 * s + 1, {2 * LENGTH})) AS m FROM w),
rep AS (SELECT r, s FROM (SELECT r, s, count(*) OVER (PARTITION BY m) AS c FROM m) WHERE c > 1),
cuts AS (SELECT r, s, CASE WHEN s <= lag(s) OVER (PARTITION BY r ORDER BY s) + {LENGTH} THEN 0 ELSE 1 END AS new FROM rep),
runs AS (SELECT r, s, sum(new) OVER (PARTITION BY r ORDER BY s) AS g FROM cuts),
spans AS (SELECT r, g, min(s) AS a, max(s) + {LENGTH} AS b FROM runs GROUP BY r, g),
gaps AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS z FROM spans),
kept AS (SELECT r, sum(b - a) AS removed, count(*) AS n_spans, max(b) AS last,
    string_agg(substr(d.h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) AS k FROM gaps JOIN d USING (r) GROUP BY r)
SELECT doc_id, n AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
    sha256(unhex(coalesce(k, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN kept USING (r)"""
}

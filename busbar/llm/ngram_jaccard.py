"""Jaccard join of word-shingle sets by filtering under several global orders.

If two sets have a Jaccard similarity of at least t, then under any global order
of the shingles they share one among the first (1 - t) n + 1 of each. Order one
puts rare shingles first, so its prefixes meet in few pairs; the orders two and
three are independent random ones. A candidate must share prefix shingles under
all three, have a possible length, share under the first order as many prefix
shingles as the rest of the sets leaves to share, and one of them at a place from
which enough can still follow. Bitmaps of 64 bytes bound how far two sets must
differ at least. What remains is verified on the whole sets.

Equal sets are one class from the start. Then the links are found in two steps:

1. Classes with the same first shingle under a random order are a group. Every
   class meets one other of its groups; the links found join most of each group
   of near copies. Then, as long as that finds links, those that are not yet in
   a group's largest component meet some members of it. The cost is linear in
   the groups' sizes.
2. All prefixes of order one are joined, but only pairs of classes that are not
   yet connected are candidates. A link inside a component would change nothing,
   every other link is found.

Candidates of either step are joined with the prefixes of orders two and three,
and only those that also meet there are verified. Only ids, prefixes and links
are shuffled; whole sets are made again from the texts of those documents that
are in such a pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from .common import LOWER, Scratch, annotate, join_groups, mix64, table, take_over, utf8
from .components import components

#: Random orders whose first shingles bring classes together in step one.
FIRST_ORDERS = 8
#: The order by rarity knows at most so many frequent shingles; all others are rare. Any such list gives a valid order.
FREQUENT = 1 << 18
#: Shingles counted at a time, and how often one must occur there to be reported.
COUNTED, REPORTED = 1_000_000, 3
#: Texts that a task works on at a time.
SLICE = 200
#: Members of a group's largest component that the others meet in each further round of step one; it ends when fewer of the pairs than this are links.
PARTNERS, WORTHWHILE = 16, 0.02
#: Rows of one shingle that are compared in one piece.
LIST_ROWS = 2000
#: Lists of up to so many rows are compared all together.
SHORT_LIST = 64
#: A list of ids with at most so many rows is broadcast, a longer one is shuffled.
BROADCAST_IDS = 2_000_000
CACHE_WORDS = 150_000
#: Bits of a set's bitmap.
BITS = 512

_MULTIPLIERS = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _WordHashes()


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    """Sorted hashes of the distinct runs of `k` words; of all words, if they are fewer."""
    words = (text or b"").translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    size = min(k, len(words))
    n = len(words) - size + 1
    out = np.full(n, size, np.uint64)
    for j in range(size):
        out = mix64((out ^ h[j : j + n]) * _MULTIPLIERS[j % 4], j)
    return np.unique(out)


def parity_bits(shingles: np.ndarray) -> np.ndarray:
    """For each bit, whether an odd number of shingles falls on it.

    Every bit in which two bitmaps differ has a shingle that only one of the sets has.
    """
    odd = np.bincount((mix64(shingles, 20) % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def prefix_length(n: int, percent: int) -> int:
    """Shingles of a set of `n` of which a similar set must share one, under any order."""
    return n - -(-percent * n // 100) + 1


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """Arrays of numbers as one Arrow column, without Python numbers in between."""
    bounds = np.cumsum([0, *(len(x) for x in arrays)]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat.astype(kind.to_pandas_dtype(), copy=False), kind))


def _report_task(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("ngram_jaccard", _HASHES.clear)
        held, n = [], 0

        def drain():
            found, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts >= REPORTED
            return pa.RecordBatch.from_arrays([pa.array(found[often].view(np.int64)), pa.array(counts[often].astype(np.int64))], ["shingle", "n"])

        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                for text in utf8(batch.column(0).slice(lo, SLICE)):
                    s = shingle_set(text, k)
                    held.append(s)
                    n += len(s)
                    if n > COUNTED:
                        yield drain()
                        held, n = [], 0
        if held:
            yield drain()

    return run


def frequent_shingles(docs: DataFrame, text: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that many documents have, sorted, and their counts."""
    counts = docs.select(text).mapInArrow(_report_task(k), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "shingle").limit(FREQUENT).toPandas()
    shingles = top["shingle"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(shingles)
    return shingles[order], top["n"].to_numpy(np.int64)[order]


def _rarity(shingles: np.ndarray, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    if not len(frequent):
        return np.zeros(len(shingles), np.int64)
    at = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
    return np.where(frequent[at] == shingles, counts[at], 0)


def _low_bits(shingles: np.ndarray, order: int, size: int) -> np.ndarray:
    """The first `size` shingles under a random order, as 32-bit numbers: equal shingles have equal ones."""
    if not size:
        return np.zeros(0, np.int32)
    places = mix64(shingles, order)
    return (np.partition(places, size - 1)[:size] & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)


def _prefix_task(k: int, percent: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("ngram_jaccard", _HASHES.clear)
        frequent, counts = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                part = batch.slice(lo, SLICE)
                sets = [shingle_set(t, k) for t in utf8(part.column(1))]
                digests, prefixes, seconds, thirds, firsts, bits, common = [], [], [], [], [], [], []
                for s in sets:
                    size = prefix_length(len(s), percent) if len(s) else 0
                    digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() if len(s) else None)
                    rarity = _rarity(s, frequent, counts)
                    order = np.lexsort((mix64(s, 1), rarity))[:size]
                    prefixes.append(s[order].view(np.int64))
                    seconds.append(_low_bits(s, 2, size))
                    thirds.append(_low_bits(s, 3, size))
                    bits.append(parity_bits(s))
                    firsts.append(np.array([mix64(s, 10 + j).min() for j in range(FIRST_ORDERS if len(s) else 0)], np.uint64).view(np.int64))
                    common.append(int(rarity[order].sum()) // max(size, 1))
                long, whole = pa.int64(), pa.int32()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], whole), pa.array(digests, pa.string()), _lists(prefixes, long), _lists(seconds, whole), _lists(thirds, whole), _lists(firsts, long), _lists(bits, long), pa.array(common, long)],
                    ["doc_id", "n", "set_digest", "prefix", "second", "third", "firsts", "bits", "common"],
                )

    return run


_PREFIXES = "doc_id long, n int, set_digest string, prefix array<long>, second array<int>, third array<int>, firsts array<long>, bits array<long>, common long"


def _set_task(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("ngram_jaccard", _HASHES.clear)
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                sets = [shingle_set(t, k).tobytes() for t in utf8(batch.column(0).slice(lo, SLICE))]
                digests = [hashlib.blake2b(s, digest_size=16).hexdigest() for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(sets, pa.binary())], ["set_digest", "shingles"])

    return run


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def _verify_task(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                a, b, sa, sb = (batch.column(c).slice(lo, SLICE) for c in range(4))
                keep = [_similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in zip(sa, sb)]
                mask = pa.array(keep, pa.bool_())
                yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], ["a", "b"])

    return run


def meeting_in_all_orders(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Those pairs of classes that also share prefix shingles under orders two and three."""
    one = classes.select(F.col("vid").alias("a"), F.col("second").alias("a2"), F.col("third").alias("a3"))
    two = classes.select(F.col("vid").alias("b"), F.col("second").alias("b2"), F.col("third").alias("b3"))
    both = pairs.join(two, "b").join(one, "a")
    return both.filter(F.arrays_overlap("a2", "b2") & F.arrays_overlap("a3", "b3")).select("a", "b")


def verify(pairs: DataFrame, classes: DataFrame, docs: DataFrame, key: str, text: str, k: int, percent: int, scratch: Scratch, name: str) -> DataFrame:
    """The links among stored candidate pairs of classes, on their whole sets."""
    spark = docs.sparkSession
    asked = pairs.select(F.explode(F.array("a", "b")).alias("vid")).distinct()
    asked = scratch.keep(classes.select("vid", "doc_id", "set_digest").join(asked, "vid", "left_semi"), "asked")
    ids = asked.select(F.col("doc_id").alias("asked_id")).distinct()
    if asked.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    texts = docs.join(ids, docs[key].cast("long").eqNullSafe(F.col("asked_id")), "left_semi").select(text)
    sets = texts.mapInArrow(_set_task(k), "set_digest string, shingles binary")
    # Rows that share an id, and equal sets, give a digest more than once.
    sets = sets.join(asked.select("vid", "set_digest"), "set_digest").groupBy("vid").agg(F.first("shingles").alias("shingles"))
    sets = scratch.keep(sets, "sets")
    one = sets.select(F.col("vid").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("vid").alias("b"), F.col("shingles").alias("sb"))
    full = pairs.join(two, "b").join(one, "a").select("a", "b", "sa", "sb")
    links = scratch.keep(full.mapInArrow(_verify_task(percent), "a long, b long"), name)
    scratch.drop(spark, "asked", "sets")
    return links


def _pairs_task(percent: int):
    """A row for each prefix shingle that a pair shares, from sorted rows of (shingle, parts, n, place, vid, comp, bits).

    With it come the shingles that the two prefixes must share at least, and
    whether enough shingles can follow if this one is the first that they share.
    """
    numbers = ["shingle", "lo", "hi", "n", "place", "vid", "comp", "part"]

    def emit(rows: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
        n, vid, place, bits = (rows[c] for c in ("n", "vid", "place", "bits"))
        # Rows of one part meet in that part's own list, those of two parts in the list of both.
        keep = (rows["comp"][i] != rows["comp"][j]) & ((rows["lo"][i] == rows["hi"][i]) | (rows["part"][i] != rows["part"][j]))
        i, j = i[keep], j[keep]
        need = -(-percent * (n[i] + n[j]) // (100 + percent))
        differ = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64)
        near = differ <= n[i] + n[j] - 2 * need
        i, j, need = i[near], j[near], need[near]
        fits = np.minimum(n[i] - place[i], n[j] - place[j]) >= need
        # What is shared beyond the prefix that ends first lies in the rest of that set.
        rest = -(-percent * np.maximum(n[i], n[j]) // 100) - 1
        arrays = [np.minimum(vid[i], vid[j]), np.maximum(vid[i], vid[j]), need - rest, fits]
        return pa.RecordBatch.from_arrays([pa.array(v) for v in arrays], ["a", "b", "least", "fits"])

    def short_lists(rows: dict[str, np.ndarray], i: np.ndarray, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Pairs of all short lists together: each row with the next of its list, then with the one after it, and on."""
        n, step = rows["n"], 0
        while len(i):
            step += 1
            on = i + step < ends
            i, ends = i[on], ends[on]
            on = n[i + step] * percent <= n[i] * 100  # a list is sorted by size
            i, ends = i[on], ends[on]
            for lo in range(0, len(i), 200_000):
                yield emit(rows, i[lo : lo + 200_000], i[lo : lo + 200_000] + step)

    def long_list(rows: dict[str, np.ndarray], lo: int, hi: int) -> Iterator[pa.RecordBatch]:
        n = rows["n"][lo:hi]
        width = np.searchsorted(n, n * 100 // percent, side="right") - np.arange(len(n)) - 1
        begin = 0
        while begin < len(n):
            end = min(int(np.searchsorted(np.cumsum(width[begin:]), 200_000, side="left")) + begin + 1, len(n))
            own = width[begin:end]
            i = np.repeat(np.arange(begin, end), own)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(own) - own, own)
            yield emit(rows, lo + i, lo + j)
            begin = end

    def lists(rows: dict[str, np.ndarray], begins: np.ndarray, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
        short = ends - begins <= SHORT_LIST
        sizes = (ends - begins)[short]
        i = np.repeat(begins[short], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        yield from short_lists(rows, i, np.repeat(ends[short], sizes))
        for lo, hi in zip(begins[~short].tolist(), ends[~short].tolist()):
            yield from long_list(rows, lo, hi)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*numbers, "bits"]
        held = {c: np.zeros(0, np.int64) for c in numbers} | {"bits": np.zeros((0, BITS // 64), np.uint64)}
        for batch in batches:
            new = {c: batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in numbers}
            new["bits"] = batch.column("bits").flatten().to_numpy().view(np.uint64).reshape(-1, BITS // 64)
            rows = {c: np.concatenate([held[c], new[c]]) for c in names}
            if not len(rows["n"]):
                continue
            edge = np.flatnonzero((np.diff(rows["shingle"]) != 0) | (np.diff(rows["lo"]) != 0) | (np.diff(rows["hi"]) != 0)) + 1
            begins = np.r_[0, edge]
            yield from lists(rows, begins[:-1], begins[1:])
            held = {c: rows[c][begins[-1] :] for c in names}  # the last list may go on in the next batch
        if len(held["n"]) > 1:
            yield from lists(held, np.array([0]), np.array([len(held["n"])]))

    return run


def _possible(n: str, other_n: str, bits: str, other_bits: str, percent: int):
    """Whether lengths and bitmaps allow two sets to be similar."""
    differ = F.lit(0)
    for k in range(BITS // 64):
        differ = differ + F.bit_count(F.col(bits)[k].bitwiseXOR(F.col(other_bits)[k]))
    both = F.col(n) + F.col(other_n)
    fits = F.least(n, other_n) * 100 >= F.greatest(n, other_n) * percent
    return fits & (differ <= both - 2 * F.ceil(both * percent / (100 + percent)))


def _members(classes: DataFrame) -> DataFrame:
    """A row for each class and group, the classes with the same first shingle under one of the random orders."""
    rows = classes.select("vid", "n", "bits", "copies", "common", F.posexplode("firsts").alias("nr", "first"))
    return rows.withColumn("key", F.concat_ws(" ", "nr", "first")).withColumn("turn", F.xxhash64("vid", "nr"))


def _pairs_with(rows: DataFrame, groups: DataFrame, total: int, percent: int) -> DataFrame:
    """Members of groups with the class `a` of their group, if the two can be similar."""
    joined = join_groups(rows, groups, "key", "members", total)
    fits = _possible("n", "an", "bits", "ab", percent) & (F.col("a") != F.col("vid"))
    return joined.filter(fits).select(F.least("a", "vid").alias("a"), F.greatest("a", "vid").alias("b")).distinct()


def _first_pairs(classes: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Step one: each class with one class of each of its groups.

    In every second group that is the one with most copies and commonest
    shingles, which tends to be what the others were copied from; in the others
    it is any.
    """
    rows = _members(classes)
    best = F.when(F.col("nr") % 2 == 0, F.struct((-F.col("copies")).alias("x"), (-F.col("common")).alias("y"))).otherwise(F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y")))
    pivot = F.min(F.struct(best.alias("best"), "turn", "vid", "n", "bits")).alias("pivot")
    groups = rows.groupBy("key").agg(pivot, F.count("*").alias("members")).filter("members > 1")
    groups = groups.select("key", F.col("pivot.vid").alias("a"), F.col("pivot.n").alias("an"), F.col("pivot.bits").alias("ab"), "members")
    groups = scratch.keep(groups, "pivots")
    return _pairs_with(rows.select("key", "vid", "n", "bits"), groups, FIRST_ORDERS * classes.count(), percent)


def _round_pairs(classes: DataFrame, comps: DataFrame, percent: int, number: int, scratch: Scratch) -> DataFrame:
    """A further round: in each group, classes outside its largest component with some members of that component."""
    rows = _members(classes).join(comps, "vid", "left").withColumn("comp", F.coalesce("comp", "vid"))
    rows = scratch.keep(rows.select("key", "nr", "vid", "n", "bits", "comp"), "members")
    # one order in turn, so that a class meets PARTNERS others in each round
    own = rows.filter(F.col("nr") == number % FIRST_ORDERS)
    sizes = own.groupBy("key", "comp").agg(F.count("*").alias("size"))
    largest = sizes.groupBy("key").agg(F.max(F.struct("size", "comp")).alias("top"), F.sum("size").alias("members"), F.count("*").alias("parts"))
    largest = scratch.keep(largest.filter("parts > 1").select("key", F.col("top.comp").alias("top"), "members"), "largest")
    # every member of the largest component draws a place, and the first to draw a place holds it
    total = classes.count()
    placed = join_groups(own, largest, "key", "members", total).filter("top IS NOT NULL")
    inside = placed.filter("comp = top").withColumn("place", F.pmod(F.xxhash64("vid", F.lit(number)), F.lit(PARTNERS)))
    partner = F.min(F.struct(F.xxhash64("vid", F.lit(-number)).alias("turn"), "vid", "n", "bits")).alias("p")
    chosen = inside.groupBy("key").pivot("place", list(range(PARTNERS))).agg(partner)
    partners = F.filter(F.array(*[F.col(str(k)) for k in range(PARTNERS)]), lambda x: x.isNotNull())
    chosen = chosen.select("key", partners.alias("partners")).join(largest.select("key", "members"), "key")
    outside = placed.filter("comp <> top").select("key", "vid", "n", "bits")
    met = join_groups(outside, chosen, "key", "members", total)
    met = met.select("vid", "n", "bits", F.explode("partners").alias("p")).select("vid", "n", "bits", F.col("p.vid").alias("a"), F.col("p.n").alias("an"), F.col("p.bits").alias("ab"))
    return met.filter(_possible("n", "an", "bits", "ab", percent)).select(F.least("a", "vid").alias("a"), F.greatest("a", "vid").alias("b")).distinct()


def _other_pairs(classes: DataFrame, comps: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Step two: pairs of classes of different components that share a prefix shingle of order one."""
    labelled = classes.join(comps, "vid", "left").withColumn("comp", F.coalesce("comp", "vid"))
    rows = labelled.select("vid", "comp", "n", "bits", F.posexplode("prefix").alias("place", "shingle"))
    lists = rows.groupBy("shingle").agg(F.count("*").alias("members"), F.min("comp").alias("least"), F.max("comp").alias("most"))
    lists = scratch.keep(lists.filter("members > 1 AND least <> most").select("shingle", "members"), "lists")
    few = lists.count() <= BROADCAST_IDS
    rows = rows.join(F.broadcast(lists) if few else lists, "shingle")
    # A long list is cut into parts by a hash of the class, and every two parts meet.
    parts = F.ceil(F.col("members") / LIST_ROWS).cast("long")
    rows = rows.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("vid"), F.col("parts")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    rows = rows.select("shingle", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "n", "place", "vid", "comp", "part", "bits")
    dealt = rows.repartition("shingle", "lo", "hi").sortWithinPartitions("shingle", "lo", "hi", "n", "vid")
    shared = dealt.mapInArrow(_pairs_task(percent), "a long, b long, least long, fits boolean")
    counted = shared.groupBy("a", "b").agg(F.count("*").alias("n"), F.first("least").alias("least"), F.bool_or("fits").alias("fits"))
    return counted.filter("n >= least AND fits").select("a", "b")


def near_duplicates(docs: DataFrame, shingle_words: int, percent: int, key: str = "doc_id", text: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """Per row: doc_id, n_shingles, set_digest, component_id and component (a number of its own, also where ids are missing or repeated).

    Two rows link when 100 * intersection >= percent * union of their sets of
    lower-cased (A-Z) shingles; component_id is the smallest id reachable by
    links. Null and wordless texts have no shingles, no digest and link with
    nothing. Repeated rows have equal sets, hence one component; a null id is
    no candidate for the smallest. No rows give no rows; other columns are not
    read. The result reads tables of `scratch`, so drop them after it is stored.
    """
    spark, scratch = docs.sparkSession, scratch or Scratch()
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    shared = spark.sparkContext.broadcast(frequent_shingles(rows, "text", shingle_words))  # at most FREQUENT numbers
    found = scratch.keep(rows.mapInArrow(_prefix_task(shingle_words, percent, shared), _PREFIXES), "prefixes")
    shared.unpersist()
    firsts = [F.first(c).alias(c) for c in ("n", "prefix", "second", "third", "firsts", "bits", "common")]
    classes = found.filter("n > 0").groupBy("set_digest").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), *firsts)
    classes = scratch.keep(classes.withColumn("vid", F.monotonically_increasing_id()), "classes")
    found = scratch.keep(found.select("doc_id", "n", "set_digest"), "digests")
    scratch.drop(spark, "prefixes")

    def links_of(pairs: DataFrame, name: str) -> tuple[DataFrame, int]:
        met = scratch.keep(meeting_in_all_orders(pairs, classes), f"{name}-pairs")
        return verify(met, classes, rows, "doc_id", "text", shingle_words, percent, scratch, f"{name}-links"), met.count()

    links, _ = links_of(_first_pairs(classes, percent, scratch), "first")
    comps = components(links, scratch)
    for number in range(FIRST_ORDERS):
        more, tried = links_of(_round_pairs(classes, comps, percent, number, scratch), f"round-{number}")
        if not tried:
            continue
        n = more.count()
        if n:
            links = links.unionByName(more)
            comps = components(links, scratch)
        if n < WORTHWHILE * tried:
            break
    more, _ = links_of(_other_pairs(classes, comps, percent, scratch), "other")
    if not more.isEmpty():
        comps = components(links.unionByName(more), scratch)

    labelled = classes.select("vid", "doc_id", "set_digest", "copies").join(comps, "vid", "left").withColumn("comp", F.coalesce("comp", "vid"))
    least = labelled.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    groups = scratch.keep(labelled.join(least, "comp").select("set_digest", "comp", "component_id", "copies"), "groups")
    scratch.drop(spark, *(name for name in scratch.paths if name not in ("digests", "groups")))
    out = join_groups(found, groups, "set_digest", "copies", found.count())
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "set_digest", F.coalesce("component_id", "doc_id").alias("component_id"), F.col("comp").alias("component"))


def _digest_task(k: int, text: str):
    def make():
        def step(batch: pa.RecordBatch) -> list[pa.Array]:
            digests = []
            for lo in range(0, batch.num_rows, SLICE):
                sets = [shingle_set(t, k) for t in utf8(batch.column(text).slice(lo, SLICE))]
                digests += [hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() if len(s) else None for s in sets]
            return [pa.array(digests, pa.string())]

        return step

    return make


def one_of_each_group(docs: DataFrame, shingle_words: int, percent: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with one row of each component: of those with the smallest id (a null id comes last) one, the others go.

    Rows are judged by their own text: another text under the same id belongs
    to its own component. Rows without shingles are in no component and stay.
    Any columns may be there besides `key` and `text`.
    """
    scratch = Scratch()
    found = near_duplicates(docs, shingle_words, percent, key, text, scratch)
    found = materialize(found.select("doc_id", "set_digest", "component"), "near-duplicates")
    scratch.drop(docs.sparkSession)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "set_digest")).alias("first")
    kept = found.filter("component IS NOT NULL").groupBy("component").agg(first)
    kept = materialize(kept.select(F.col("first.doc_id").alias("kept_id"), F.col("first.set_digest").alias("kept_digest")), "kept")
    repeated = found.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("repeated_id"))
    repeated = materialize(repeated, "repeated-ids")
    # ids that stand for one row: the id decides
    single = found.filter("component IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").alias("gone_id"))
    gone = single.join(kept.select("kept_id"), F.col("gone_id") == F.col("kept_id"), "left_anti").join(repeated, F.col("gone_id") == F.col("repeated_id"), "left_anti")
    gone, own = materialize(gone, "gone"), docs[key].cast("long")
    few = gone.count() <= BROADCAST_IDS
    plain = docs.filter(docs[key].isNotNull())
    plain = plain.join(repeated, own == repeated["repeated_id"], "left_anti").join(F.broadcast(gone) if few else gone, own == gone["gone_id"], "left_anti")
    # the others: the row's own text decides
    rest = docs.join(repeated, own == repeated["repeated_id"], "left_semi").unionByName(docs.filter(docs[key].isNull()))
    helper = "digest"
    while helper in docs.columns:
        helper += "_"
    rest = materialize(annotate(rest, _digest_task(shingle_words, text), f"`{helper}` string"), "rows-without-own-id")
    wordless = rest.filter(rest[helper].isNull())
    chosen = rest.filter(rest[helper].isNotNull()).dropDuplicates([key, helper])
    chosen = chosen.join(kept, chosen[key].cast("long").eqNullSafe(kept["kept_id"]) & (chosen[helper] == kept["kept_digest"]), "left_semi")
    return plain.unionByName(wordless.drop(helper)).unionByName(chosen.drop(helper))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), 4, 85).select("doc_id", "n_shingles", "component_id")


OP5_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
     s AS (SELECT DISTINCT r, array_to_string(w[k:k + 3], ' ') AS x
           FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS k FROM d WHERE len(w) > 0)),
     n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
     met AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.r <> b.r GROUP BY ALL),
     link AS (SELECT a, b FROM met JOIN n p ON p.r = a JOIN n q ON q.r = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
     reach AS (SELECT r AS a, r AS b FROM d UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(e.doc_id) AS component_id
FROM d LEFT JOIN n USING (r) JOIN reach ON reach.a = d.r JOIN d e ON e.r = reach.b GROUP BY d.r, d.doc_id
"""

QUERIES = {"op5_ngram_jaccard": op5_ngram_jaccard}
SQL = {"op5_ngram_jaccard": OP5_SQL}

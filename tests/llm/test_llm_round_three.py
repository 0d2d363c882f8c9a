"""Lexical search, repeat removal and hard negatives: awkward rows, no rows, and against plain versions."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import plain
import pyarrow as pa
import pytest
import tables
from busbar.llm import decontaminate, hard_negatives, kneser_ney, repeats, signature_search, suffix_groups


@pytest.fixture(scope="module")
def docs(spark):
    return tables.frame(spark).cache()


def pairs():
    return [(r[0], r[1]) for r in tables.documents()]


# --- 11 lexical search --------------------------------------------------------------------------


def plain_search(docs, items, k):
    """Every document scored for every item."""
    counts = [(d, Counter(signature_search.terms_of((t or "").encode()))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n, length = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        rows = []
        for d, c in counts:
            m = 100 - 90 + (90 * c.total() * n) // length
            score = 0
            for t in set(signature_search.terms_of((text or "").encode())):
                if tf := c[t]:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                    score += w * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
            if score > 0:
                rows.append((-score, d is None, d or 0))
        for rank, (s, none, d) in enumerate(sorted(rows)[:k], 1):
            out.append((item, rank, None if none else d, -s))
    return out


ITEMS = [("a", "quick brown FOX"), ("b", None), ("b", ""), (None, "copy of COPIES"), ("c", tables.PASSAGE), ("d", "w1 w2 w3 t5 t9"), ("e", "nowhere"), ("a", "ÀÉ über 456")]


@pytest.mark.parametrize(("k", "asked", "block"), [(3, 500, 1024), (10, 2, 8), (1, 1, 16)])
def test_search_is_exact(spark, docs, monkeypatch, k, asked, block):
    monkeypatch.setattr(signature_search, "QUERY_BLOCK", asked)
    monkeypatch.setattr(signature_search, "BLOCK_DOCS", block)
    items = spark.createDataFrame([(*x, 1, "z") for x in ITEMS], "item_id string, text string, query int, score string")
    got = signature_search.search(signature_search.build_index(docs), items, k=k).collect()
    assert Counter(tuple(r) for r in got) == Counter(plain_search(pairs(), ITEMS, k))


def test_bounds_leave_documents_out(spark, tmp_path):
    rng = random.Random(5)
    texts = [" ".join(f"v{int(rng.paretovariate(0.8))}" for _ in range(rng.randint(5, 300))) for _ in range(600)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    index = signature_search.build_index(rows)
    asked = signature_search.Queries([{b"v3", b"v50", b"v7"}, {b"v900"}])
    counts = [Counter(signature_search.terms_of(t.encode())) for t in texts]
    asked.weigh({n: sum(t in c for c in counts) for t, n in asked.number.items()}, index.documents, index.words)
    seen = 0
    for row in index.manifest.collect():
        block = signature_search._Block(index.folder, row.asDict())
        bounds, length = asked.bounds(block), asked.long_parts(block.n)
        for d, terms in block.terms():
            exact = asked.scores(terms, int(length[d]))
            assert (bounds[:, d] >= exact).all()
            seen += 1
        holders = np.array([b"v900" in terms for _, terms in block.terms()])
        assert (bounds[1] > 0).sum() <= holders.sum() + 0.05 * len(holders) + 1  # nearly all without the term are excluded
    assert seen == 600


def test_search_of_nothing(spark, docs):
    none = spark.createDataFrame([], "item_id string, text string")
    assert signature_search.search(signature_search.build_index(docs), none).count() == 0
    some = spark.createDataFrame([("a", "fox")], "item_id string, text string")
    assert signature_search.search(signature_search.build_index(tables.empty(spark)), some).count() == 0


# --- 12 repeats ---------------------------------------------------------------------------------


def test_suffix_array_by_sorting():
    rng = np.random.default_rng(0)
    for _ in range(1500):
        x = rng.integers(0, rng.integers(1, 5), rng.integers(0, 40))
        rows = x.tolist()
        assert suffix_groups.suffix_array(x).tolist() == sorted(range(len(rows)), key=lambda i: rows[i:])
    for x in (np.zeros(5000, int), np.arange(5000), np.arange(5000)[::-1], np.tile([1, 0, 2], 2000)):
        rows = x.astype(np.uint16).byteswap().tobytes()
        assert suffix_groups.suffix_array(x).tolist() == sorted(range(len(x)), key=lambda i: rows[2 * i :])


def plain_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("length", "contexts", "file_bytes"), [(8, 1000, 2000), (8, 2, 2000), (40, 2, 5000), (40, 1000, 10**6), (1, 3, 4000)])
def test_repeats_against_all_windows(spark, monkeypatch, length, contexts, file_bytes):
    monkeypatch.setattr(repeats, "GROUP_CONTEXTS", contexts)
    monkeypatch.setattr(repeats, "FILE_BYTES", file_bytes)
    rng = random.Random(length)
    noise = lambda n: "".join(rng.choice("abé") for _ in range(rng.randint(0, n)))
    base = "".join(rng.choice("abcdé") for _ in range(400))
    texts = [None, "", "a" * 100, "x", "ab" * 60]
    for _ in range(120):
        at = rng.randint(0, 300)
        texts.append(noise(20) + base[at : at + rng.randint(1, 120)] + noise(20))
    rows = spark.createDataFrame([(k, t, "x", 7) for k, t in enumerate(texts)], "doc_id long, text string, file string, core int").repartition(3)
    got = {r.doc_id: r for r in repeats.remove_repeats(rows, length).collect()}
    want = plain_repeats(texts, length)
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for _, r in sorted(got.items())] == want
    for k, t in enumerate(texts):
        raw, cut = (t or "").encode(), 0
        for s in got[k].spans:
            assert cut <= s.start < s.end <= len(raw)
            cut = s.end
        outside = [raw[a:b] for a, b in zip([0, *(s.end for s in got[k].spans)], [*(s.start for s in got[k].spans), len(raw)])]
        assert b"".join(outside) == bytes(got[k].kept)


def test_repeats_of_awkward_rows(spark, docs):
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(docs, with_kept=False).collect())
    assert got == Counter((d, *w) for (d, _), w in zip(pairs(), plain_repeats([t for _, t in pairs()], 400)))
    assert repeats.remove_repeats(tables.empty(spark)).count() == 0


def test_long_documents_cross_blocks(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK", 700)
    rng = random.Random(1)
    passage = "".join(rng.choice("abcdefgh") for _ in range(450))
    texts = ["".join(rng.choice("abcdefgh") for _ in range(n)) + passage + "tail" for n in (10, 690, 2000)] + [passage[30:]]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = sorted(tuple(r)[1:] for r in repeats.remove_repeats(rows, with_kept=False).drop("spans", "kept").collect())
    assert got == sorted(plain_repeats(texts, 400))


# --- 13 hard negatives --------------------------------------------------------------------------


def plain_negatives(rows, every=50, positives=5, negatives=3):
    used = []
    for i, label, v in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        used.append((i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, [math.floor(256 * x) for x in v]))
    out, last = [], float("inf")
    score = lambda a, b: max(min(sum(x * y for x, y in zip(a, b)), 2**63 - 1), -(2**63))
    for i, label, v in used:
        if i is None or i % every:
            continue
        ranked = sorted((-score(v, w), last if j is None else j, m) for j, m, w in used)
        same = [(-s, j) for s, j, m in ranked if m == label and j != i][:positives]
        for ps, p in same:
            fits = [(-s, j) for s, j, m in ranked if m != label and 50 * ps <= 100 * -s <= 95 * ps][:negatives]
            out += [(i, None if p == last else p, k, None if j == last else j, ps, s) for k, (s, j) in enumerate(fits, 1)]
    return Counter(out)


VECTORS = "vec_id long, label int, embedding array<float>, anchor string, id int"


def vectors(n, dim, seed, clusters):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim))
    out = []
    for k in range(n):
        c = int(rng.integers(clusters))
        out.append((k, c % 10, [float(np.float32(x)) for x in centres[c] * rng.choice([0.5, 0.8, 1.0]) + rng.normal(size=dim) * 0.05]))
    return out


@pytest.mark.parametrize("block", [2, 1024])
def test_hard_negatives_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(hard_negatives, "BLOCK_ANCHORS", block)
    rows = vectors(400, 6, 3, 12)
    rows += [(None, 1, rows[0][2]), (1000, None, [1.0] * 6), (1001, 2, None), (1050, 3, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (1100, 3, [float("nan")] * 6)]
    rows += [(1150, 3, [float("inf")] * 6), (1200, 4, []), (1250, 4, [2.0]), (1300, 4, [0.0] * 6), rows[7], rows[50]]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS).repartition(3)
    got = Counter(tuple(r) for r in hard_negatives.hard_negatives(frame).collect())
    assert got == plain_negatives(rows)
    assert sum(got.values()) > 20


def test_huge_components_saturate(spark):
    rows = [(k, k % 3, [1e30 * (k + 1), -3.0, 0.5 * k]) for k in range(0, 60, 5)] + [(3, 0, [1.0, 2.0, 3.0])]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS)
    rows = [(i, m, [float(np.float32(x)) for x in v]) for i, m, v in rows]
    assert Counter(tuple(r) for r in hard_negatives.hard_negatives(frame).collect()) == plain_negatives(rows)


def test_bounds_spare_scores():
    rows = vectors(3000, 8, 1, 40)
    ids, labels = np.arange(3000), np.array([r[1] for r in rows])
    x = np.floor(256 * np.array([r[2] for r in rows]))
    block = hard_negatives.build_block(ids[:200], labels[:200], x[:200], 5)
    usable = lambda nodes: labels[:, None] == block.labels[nodes]
    most = np.full(200, np.iinfo(np.int64).max)
    scores, inside, computed = hard_negatives.bounded_scores(x, block, block.floors, most, usable)
    every = hard_negatives.products(x, block.vectors)
    want = usable(np.arange(200)) & (every >= block.floors)
    assert (inside == want).all() and (scores[inside] == every[inside]).all()
    assert computed < 0.7 * every.size


def test_tree_reaches_every_anchor():
    rng = np.random.default_rng(2)
    order, parent, edge = hard_negatives.spanning_tree(rng.normal(size=(50, 3)))
    assert sorted(order.tolist()) == list(range(50)) and (parent >= 0).sum() == 49
    seen = set()
    for k in order.tolist():
        assert parent[k] < 0 or parent[k] in seen
        seen.add(k)


def test_hard_negatives_of_no_rows(spark):
    none = spark.createDataFrame([], VECTORS)
    assert hard_negatives.hard_negatives(none).count() == 0
    alone = spark.createDataFrame([(50, 1, [1.0], "x", 1)], VECTORS)
    assert hard_negatives.hard_negatives(alone).count() == 0


def test_few_texts_are_taken_apart_at_a_time(monkeypatch):
    """A batch's words are never held together; sums over the slices are those of the whole batch."""
    texts = pa.array(["alpha beta gamma delta", None, "", "x " * 40, "alpha beta gamma delta eps"] * 5)
    parts = list(decontaminate._slices(texts, 60))
    assert [t for p in parts for t in p] == [None if t is None else t.encode() for t in texts.to_pylist()] and len(parts) > 9
    assert max(sum(len(t or b"") for t in p) for p in parts if len(p) > 1) <= 60
    assert list(decontaminate._slices(texts.slice(0, 0), 60)) == []
    shingles = ["alpha beta gamma delta", "beta gamma delta eps"]
    block = decontaminate.Block(["alpha beta gamma delta eps"], [(0, 0, 4), (0, 1, 4)])
    monkeypatch.setattr(decontaminate, "_all_shingles", lambda uri, k: (block, shingles))
    monkeypatch.setattr(decontaminate, "COUNTED_BYTES", 60)
    held = []
    numbers = block.numbers
    block.numbers = lambda docs: held.append(sum(map(len, docs))) or numbers(docs)
    out = list(decontaminate._count_task(decontaminate.WindowFiles("none", 1))(iter([pa.RecordBatch.from_arrays([texts], ["text"])])))
    assert out[0].to_pydict() == {"shingle": shingles, "n": [10, 5]} and max(held) <= 40


def test_statistics_of_a_token_are_looked_up_once(monkeypatch):
    """Tokens behind one another share a look-up, and the scores are those of separate ones."""
    asked, rng = [], np.random.default_rng(1)
    stats = np.zeros(8, kneser_ney._STATS)
    for c in kneser_ney._STATS.names:
        stats[c] = rng.integers(1, 9, 8)

    class Fake(kneser_ney.Model):
        def _stats(self, numbers):
            asked.append(len(numbers))
            return np.where(numbers >= 0, stats[numbers], np.zeros(1, kneser_ney._STATS))

        def _bigram_counts(self, one, two):
            return (one + two) % 3

    words = kneser_ney.Words("none", 1, np.array([5, 2]), 40, 18)
    model = Fake(words, set(), 1, np.array([7]), set(), np.array([0, 0.5, 1, 1.5]), np.array([0, 0.5, 1, 1.5]), 30, 4.0)
    two = np.array([3, -1, 3, 0, 6, 6, 2, -1])
    one = np.array([7, 3, -1, 7, 0, 6, 6, 7])
    got = model.log10(one, two)
    assert sum(asked) <= len(two) + 4
    assert got.tolist() == [model.log10(one[k : k + 1], two[k : k + 1])[0] for k in range(len(two))]


def test_numbers_of_words(monkeypatch):
    words = kneser_ney.Words("none", 1, np.array([2, 2]), 9, 18)
    known, seen = {b"a": 0, b"b": 3}, []
    by_hash = {kneser_ney.xxhash.xxh3_64_intdigest(w): n for w, n in known.items()}

    def of(hashes):
        seen.extend(hashes.tolist())
        return np.array([by_hash.get(h, -1) for h in hashes.tolist()])

    monkeypatch.setattr(words, "_of", of)
    assert words.numbers([b"a", b"x", b"b", b"a", b"x"]).tolist() == [0, -1, 3, 0, -1]
    assert words.numbers([b"x", b"b"]).tolist() == [-1, 3] and words.numbers([]).tolist() == []
    assert len(seen) == 3 and seen == sorted(seen)  # each word once, in the order of the stored ones


# --- 8 what a slice of texts costs ----------------------------------------------------------------


def test_words_are_hashed_together_as_the_library_does():
    rng = np.random.default_rng(3)
    texts = [None, b"", b" \n", b"a", b"A b\tc\x0b\x0cd\r\n", *(b"Q" * n for n in range(1, 40)), b"  " + b"w" * 300 + b" "]
    texts += [bytes(rng.choice(list(b"abcXYZ \n\xc3\xa9\x00\x1f\xff0"), rng.integers(0, 200)).tolist()) for _ in range(100)]
    want, first = [], []
    for text in texts:
        first.append(len(want))
        want += [kneser_ney.xxhash.xxh3_64_intdigest(w) for w in [*(text or b"").lower().split(), b""]]
    hashes, starts = kneser_ney.token_hashes(texts)
    assert hashes.tolist() == want and starts.tolist() == first


def test_counts_leave_a_task_packed(monkeypatch):
    texts = [" ".join(f"w{k * j % 211}" for k in range(300)) for j in range(1, 20)] + [None, ""]
    names = sorted({h for t in texts for h in kneser_ney.token_hashes([(t or "").encode()])[0].tolist()})
    words = kneser_ney.Words("none", 1, np.array([len(names), 0]), 5000, 18)
    monkeypatch.setattr(words, "_of", lambda hashes: np.searchsorted(np.array(names, np.uint64), hashes))
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    out = list(kneser_ney._bigram_task(words, np.array([3, words.size]), 2)(iter([batch])))
    assert sum(b.num_rows for b in out) <= 4  # a row for each shard, not for each bigram
    got = Counter()
    for row in (r for b in out for r in b.to_pylist()):
        keys = np.cumsum(kneser_ney._unpacked(row["bigrams"], row["size"]))
        assert set(kneser_ney._shard(words, np.array([3, words.size]), 2, keys >> 32, keys & 0xFFFFFFFF).tolist()) == {row["shard"]}
        got.update(dict(zip(keys.tolist(), kneser_ney._unpacked(row["n"], row["size"]).tolist())))
    want = Counter()
    for t in texts:
        numbers = [names.index(h) for h in kneser_ney.token_hashes([(t or "").encode()])[0].tolist()]
        want.update(a << 32 | b for a, b in zip([words.size, *numbers], numbers))
    assert got == want


def test_each_pair_of_words_is_looked_up_once():
    asked = []

    class Fake(kneser_ney.Model):
        def _stats(self, numbers):
            return np.ones(len(numbers), kneser_ney._STATS)

        def _bigram_counts(self, one, two):
            asked.extend(zip(one.tolist(), two.tolist()))
            return (one + two) % 3

    words = kneser_ney.Words("none", 1, np.array([5, 2]), 40, 18)
    model = Fake(words, set(), 1, np.array([7]), set(), np.array([0, 0.5, 1, 1.5]), np.array([0, 0.5, 1, 1.5]), 30, 4.0)
    one, two = np.array([7, 1, 2, 1, 2, 7]), np.array([1, 2, 1, 2, 1, 1])
    got = model.log10(one, two)
    assert sorted(asked) == [(1, 2), (2, 1), (7, 1)] and got[0] == got[5] and got[1] == got[3] and got[2] == got[4]

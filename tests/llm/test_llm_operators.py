"""Each operator on awkward rows, on no rows, and against a plain version of itself."""

import hashlib
import io
import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import plain
import pytest
import tables
import zstandard
from busbar.llm import (
    components,
    decontaminate,
    exact_dedup,
    kneser_ney,
    language_id,
    licenses,
    mixture,
    ngram_jaccard,
    quality,
    token_files,
    warc,
)
from busbar.llm.common import held_out, join_groups
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def docs(spark):
    return tables.frame(spark).cache()


@pytest.fixture(scope="module")
def pairs():
    return [(r[0], r[1]) for r in tables.documents()]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- joins of groups ---------------------------------------------------------------------------


def test_join_groups_keeps_every_row(spark):
    rows = spark.createDataFrame([(k, "hot" if k % 2 else None if k % 5 == 0 else f"k{k % 7}") for k in range(4000)], "id int, key string")
    groups = rows.filter("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    got = {r.id: (r.n, r.top) for r in join_groups(rows, groups, "key", "n", 4000).collect()}
    want = {r.key: (r.n, r.top) for r in groups.collect()}
    assert len(got) == 4000
    assert all(got[r.id] == want.get(r.key, (None, None)) for r in rows.collect())


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 140)] + [(200, 200)]
    got = dict(components.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert all(got[k] == 0 for k in range(61)) and all(got[k] == 100 for k in range(100, 140))
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 1 token files ------------------------------------------------------------------------------


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 31, 32])
def test_packing_round_trip(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 7, 4096, 9999):
        ids = rng.integers(0, 1 << bits, n, dtype=np.uint64).astype(np.uint32)
        data = token_files.pack(ids, bits)
        assert len(data) == -(-n * bits // 8)
        assert (token_files.unpack(data, n, bits) == ids).all()


@pytest.mark.parametrize("bits", [13, 16])
def test_random_access(bits):
    rng = np.random.default_rng(0)
    sizes = [3, 0, 9000, 1, 5000]
    ids = rng.integers(0, 1 << bits, sum(sizes)).astype(np.uint32)
    data = b"".join(token_files.file_parts([5, None, 6, 7, 8], sizes, ids, bits))
    f = token_files.TokenFile(io.BytesIO(data))
    assert f.doc_ids == [5, None, 6, 7, 8]
    ends = np.cumsum(sizes)
    for k, (hi, n) in enumerate(zip(ends, sizes)):
        assert (f.document(k) == ids[hi - n : hi]).all()
    for lo, hi in ((0, 1), (4090, 4100), (4096, 8192), (8191, 14004), (7, 7)):
        assert (f.ids(lo, hi) == ids[lo:hi]).all()
    with pytest.raises(ValueError):
        token_files.TokenFile(io.BytesIO(b"x" * 100))


def test_id_bits():
    assert [token_files.id_bits(v) for v in (1, 2, 3, 256, 257, 50257, 65536, 65537)] == [1, 1, 2, 8, 9, 16, 16, 17]


def _library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_files.public_vocabulary())
    t.encode_special_tokens = True
    return t


def test_pieces_give_the_ids_of_whole_texts():
    library, encoder = _library(), token_files.PieceEncoder(token_files.public_vocabulary())
    rng = np.random.default_rng(1)
    parts = ["a", "Word", " ", "  ", "\n", "\t", "'s", "'", "don't", "über", "日本", "ª", "²", "12", "...", ",", "<|endoftext|>", " ", "　", "é!", "x'y", "_", "\r\n"]
    texts = ["", *("".join(rng.choice(parts, rng.integers(1, 12))) for _ in range(3000))]
    got = encoder.encode(texts)
    want = [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
    assert got == want


@pytest.mark.parametrize("limit", [token_files.FILE_IDS, 300])
def test_token_files_of_awkward_rows(spark, docs, pairs, monkeypatch, limit):
    monkeypatch.setattr(token_files, "FILE_IDS", limit)
    out = token_files.read_token_files(token_files.write_token_files(docs, token_files.public_vocabulary()))
    library, start = _library(), 0
    got = out.orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((d for d, _ in pairs), key=lambda d: (d is not None, d or 0))
    for r in got:
        assert r.start == start
        start += r.n_tokens
    want = Counter()
    for d, t in pairs:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want[d, len(ids), zlib.crc32(ids.tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want


def test_token_files_of_no_rows(spark):
    files = token_files.write_token_files(tables.empty(spark), token_files.public_vocabulary())
    assert token_files.read_token_files(files).count() == 0


# --- 2 mixture ----------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [1, 7, 512])
def test_mixture_meets_its_targets(spark, docs, pairs, block):
    got = mixture.mix(docs, block_words=block).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((d, len(plain.WORD.findall(t or ""))) for d, t in pairs)
    sizes, taken = Counter(), Counter()
    for r in got:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r["size"]
    want = plain.targets({s: sizes[s] for s in {r[3] for r in tables.documents()}})
    for r in got:
        assert r.source_size == sizes[r.source]
        assert math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-9)
    assert all(taken[s] == int(want[s] + plain.Fraction(1, 10**6)) for s in want)
    again = mixture.mix(docs.repartition(7), block_words=block)
    assert rows_of(again) == sorted((tuple(r) for r in got), key=repr)


def test_schedule_has_low_discrepancy(spark):
    slots = np.array([5000, 0, 2500, 40, 1, 12345])
    got = mixture.schedule(spark, slots).toPandas().sort_values("slot")
    assert (np.bincount(got.source_no, minlength=6) == slots).all()
    for s, g in got.groupby("source_no"):
        assert (np.sort(g["rank"]) == np.arange(slots[s])).all()
    # Every stretch from the start has each source within a few slots of its share.
    main = got[got.slot < slots.sum()]
    for n in (100, 1000, 10_000):
        part = np.bincount(main.source_no[main.slot < n], minlength=6)
        assert (abs(part - n * slots / slots.sum()) < 8).all()


def test_targets_against_resharing(spark):
    rng = np.random.default_rng(2)
    for case in range(4):
        sizes = {f"s{k}": int(10 ** rng.uniform(0, 5)) * int(rng.random() > 0.2) for k in range(9)} | {None: 17}
        frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        want = plain.targets(sizes)
        for r in mixture.targets(frame).collect():
            assert math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-9), (case, r)


def test_mixture_of_no_words(spark):
    assert mixture.mix(tables.empty(spark)).count() == 0
    silent = spark.createDataFrame([(1, None, "a"), (2, " ", "b")], "doc_id long, text string, source string")
    assert [r.taken for r in mixture.mix(silent).collect()] == [0, 0]
    assert mixture.mixed_documents(silent).count() == 0


def test_mixed_documents_keep_their_columns(spark, docs):
    got = mixture.mixed_documents(docs)
    assert got.columns == docs.columns
    words = Counter()
    for r in got.collect():
        words[r.source] += len(plain.words(r.text))
    longest = {s: max(len(plain.words(r[1])) for r in tables.documents() if r[3] == s) for s in words}
    for s, target in {r.source: r.target for r in mixture.mix(docs).collect()}.items():
        assert abs(words[s] - target) <= longest.get(s, 0) + 1


def test_the_schedule_decides_the_order(spark):
    """Documents stand where the schedule asks for them: every stretch has the sources in their shares, and another schedule gives another order."""
    rows = [(k, " ".join(["w"] * 60), "abc"[k % 3], k, k) for k in range(900)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, slot long, _copies long").repartition(3)
    how = {"block_words": 64}
    goals = {r.source: r.target for r in mixture.mix(frame, **how).select("source", "target").distinct().collect()}
    order = mixture.mixed_documents(frame, **how)
    assert order.columns == frame.columns
    got = [(r.doc_id, r.source) for r in order.collect()]
    total = sum(goals.values())
    for n in (100, 300, 700, len(got)):
        seen = Counter(s for _, s in got[:n])
        assert all(abs(seen[s] - n * g / total) <= 8 for s, g in goals.items())
    again = [(r.doc_id, r.source) for r in mixture.mixed_documents(frame.repartition(5), **how).collect()]
    assert again == got
    # points that hardly move: source after source
    other = [(r.doc_id, r.source) for r in mixture.mixed_documents(frame, **how, step=1).collect()]
    assert Counter(other) == Counter(got) and other != got
    worst = Counter(s for _, s in other[:300])
    assert any(abs(worst[s] - 300 * g / total) > 50 for s, g in goals.items())
    slots = mixture.mix(frame, **how).filter("taken > 0")
    assert slots.filter("first_slot IS NULL OR last_slot < first_slot").count() == 0


@pytest.mark.parametrize("helper", ["_id", "_share", "_size", "_copies", "_source", "lo", "hi", "slots", "share", "part"])
def test_helper_columns_do_not_clash(spark, helper):
    rows = [(k, tables.PROSE["en" if k % 2 else "de"], "en" if k % 2 else "de", "ab"[k % 2], 7) for k in range(12)]
    frame = spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, `{helper}` long")
    assert mixture.mixed_documents(frame).columns == frame.columns
    told = language_id.identify(frame, language_id.public_vocabulary(), F.lit(True))
    assert {r.lang_pred for r in told.collect()} == {"en", "de"}


# --- 3 licences ---------------------------------------------------------------------------------


def test_licences(spark):
    mit = licenses.TEXTS["MIT"]
    texts = [
        mit,
        "MIT License\n\nCopyright (c) 2020 Someone\n\n" + mit.replace("sublicense", "sub-license").lower(),
        "© 1999 X\n" + mit.replace("\n", "  \r\n"),
        mit + " extra",
        "prose\nReleased under the MIT licence.\nmore\nLicensed under the APACHE LICENSE, version 2.0!\nReleased under the MIT License.",
        "SPDX-License-Identifier: GPL-3.0",
        "This work is licensed under the GNU General Public License, v3.",
        "licensed under the moon",
        None,
        "",
        tables.LONG,
    ]
    frame = spark.createDataFrame([(k, t, "x") for k, t in enumerate([*texts, mit])], "doc_id long, text string, digest string")
    got = {r.doc_id: (r.license, r.line_licenses, r.n_license_lines) for r in licenses.scan_licenses(frame).collect()}
    assert got == {
        0: ("MIT", "", 0), 1: ("MIT", "", 0), 2: ("MIT", "", 0), 3: (None, "", 0), 4: (None, "Apache-2.0,MIT", 3),
        5: ("GPL-3.0", "GPL-3.0", 1), 6: ("GPL-3.0", "GPL-3.0", 1), 7: (None, "", 0), 8: (None, "", 0), 9: (None, "", 0),
        10: (None, "", 0), 11: ("MIT", "", 0),
    }
    assert licenses.scan_licenses(tables.empty(spark)).count() == 0


def test_whole_and_inner_licence_texts(spark):
    import textwrap
    from importlib import resources

    file = lambda spdx: (resources.files("busbar.llm") / f"license_texts/{spdx}.txt").read_text()
    wrap = lambda t, w: "\n\n".join(textwrap.fill(" ".join(x.split()), w) for x in t.split("\n\n"))
    header, mit = licenses.TEXTS["Apache-2.0"], licenses.TEXTS["MIT"]
    bsd = wrap(licenses.TEXTS["BSD-3-Clause"], 72)
    texts = {
        **{s: (licenses.TEXTS[s], s, "", 0) for s in ("0BSD", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0")},
        **{s: (file(s), s, "", 0) for s in licenses.FILES if s != "Unlicense"},
        "cut": (file("Apache-2.0").split("END OF TERMS")[0], "Apache-2.0", "", 0),
        "mit 80": (wrap(mit, 80), "MIT", "", 0),
        "mit 60": ("Copyright 2020 X\n\n" + wrap(mit, 60), "MIT", "", 0),
        "code": ("#!/bin/sh\n#\n" + "".join(f"# {x}\n" for x in header.split("\n")) + "\nrm x\n", None, "Apache-2.0", 1),
        "two": (f"prose\n\n{wrap(mit, 79)}\n\nother prose\n\n{bsd}\n\nend", None, "BSD-3-Clause,MIT", 2),
        "nested": ("begin\n" + file("Apache-2.0") + "\nend", None, "Apache-2.0", 1),
        "long": ("begin\n" + file("GPL-3.0") + "\nend", None, "GPL-3.0", 1),
        "wrapped": ("prose\n * This software is released\n * under the MIT License.\nmore", None, "MIT", 1),
        "after": ("Copyright 2020 X\nReleased under\nthe Apache License,\nVersion 2.0.\n\nmore", None, "Apache-2.0", 1),
        "line": ("This work is\nlicensed under the MIT License.\n\nCopyright 2020 X\n", "MIT", "MIT", 1),
        "changed": ("x\n" + mit.replace("free of charge", "for a charge"), None, "", 0),
    }
    frame = spark.createDataFrame([(k, t[0]) for k, t in enumerate(texts.values())], "doc_id long, text string")
    got = {r.doc_id: (r.license, r.line_licenses, r.n_license_lines) for r in licenses.scan_licenses(frame).collect()}
    for k, (name, want) in enumerate(texts.items()):
        assert got[k][0] == want[1] and (want[1] in licenses.FILES or got[k][1:] == want[2:]), (name, got[k])
    assert len({spdx for spdx in licenses.NAMES} - set(licenses.TEXTS) - set(licenses.FILES)) == 4  # named in the README


def test_licence_digests_equal_the_plain_form(spark, docs, pairs):
    got = Counter((r.doc_id, r.text_sha256) for r in licenses.scan_licenses(docs).collect())
    assert got == Counter((d, licenses.digest(licenses.canonical(t or ""))) for d, t in pairs)


def test_notices_have_an_anchor():
    import re

    known = [t for t in licenses.known_texts() if len(t) < 150]
    assert known and all(re.search(licenses.ANCHOR, t) for t in known)


# --- 4 exact dedup ------------------------------------------------------------------------------


def _dedup(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault((t or "").translate(plain.LOWER), []).append(d)
    out = []
    for d, t in rows:
        key = (t or "").translate(plain.LOWER)
        top = max((x for x in groups[key] if x is not None), default=None)
        out.append((d, top, len(groups[key]), d == top, hashlib.sha256(key.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("budget", [exact_dedup.TABLE_BYTES, 300])
def test_exact_dedup(docs, pairs, budget):
    assert rows_of(exact_dedup.exact_dedup(docs, budget=budget)) == _dedup(pairs)


def test_exact_dedup_of_no_rows(spark):
    assert exact_dedup.exact_dedup(tables.empty(spark)).count() == 0


def test_grace_spills_and_compares_content(tmp_path):
    rng = np.random.default_rng(3)
    texts = [b"t%d" % k + b"x" * 50 for k in rng.integers(0, 300, 4000)]
    records = [(hash(t) % 5 << 60 | 7, t, k, 1) for k, t in enumerate(texts)]  # many texts under few hashes
    want = {t: (max(k for k, x in enumerate(texts) if x == t), texts.count(t)) for t in set(texts)}
    got, held = {}, 0
    for table in exact_dedup.grace(iter(records), 2000, str(tmp_path)):
        held += 1
        for _, t, k, n in table.records():
            assert t not in got
            got[t] = (k, n)
    assert got == want and held > 1
    assert not list(tmp_path.iterdir())


# --- 5 near duplicates --------------------------------------------------------------------------


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80), (1, 60)])
def test_near_duplicates(docs, pairs, k, percent):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_jaccard.near_duplicates(docs, k, percent).collect()]
    assert Counter(got) == Counter(plain.components(pairs, k, percent))


def test_near_duplicates_beyond_all_bounds(spark, monkeypatch):
    """Long lists in parts, ids shuffled instead of broadcast, no common pivot: the same links."""
    rng = np.random.default_rng(4)
    base = [f"v{k}" for k in range(60)]
    rows = []
    for k in range(120):
        words = list(base)
        for at in rng.integers(0, 60, rng.integers(0, 4)):
            words[at] = f"n{rng.integers(0, 30)}"
        rows.append((k, " ".join(words[: rng.integers(48, 61)])))
    monkeypatch.setattr(ngram_jaccard, "LIST_ROWS", 10)
    monkeypatch.setattr(ngram_jaccard, "BROADCAST_IDS", 0)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_jaccard.near_duplicates(frame, 2, 85).collect()]
    want = plain.components(rows, 2, 85)
    assert Counter(got) == Counter(want) and 1 < len({c for _, _, c in want}) < 120


def test_one_of_each_group(spark, docs, pairs):
    got = ngram_jaccard.one_of_each_group(docs, 5, 80)
    assert got.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter(pairs[i] for i in plain.one_of_each(pairs, 5, 80))
    assert ngram_jaccard.one_of_each_group(tables.empty(spark), 5, 80).count() == 0


def test_one_of_each_group_under_clashing_ids(spark):
    """A unique text stays although its id also stands on a copy; helper columns may have any name."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(1, a), (2, a), (2, b), (3, c), (3, c), (None, c), (None, f"{b} more"), (None, "alone " * 9), (4, ""), (4, None), (1, "quite another text of some words")]
    names = "doc_id long, text string, _id long, digest string, kept_id long, gone_id long, component string"
    frame = spark.createDataFrame([(*r, 1, "x", 2, 3, "y") for r in rows], names).repartition(3)
    got = ngram_jaccard.one_of_each_group(frame, 5, 80)
    assert got.columns == frame.columns
    want = [(1, a), (2, b), (3, c), (None, "alone " * 9), (4, ""), (4, None), (1, "quite another text of some words")]
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter(want)


def test_large_group_around_the_threshold(spark, monkeypatch):
    """One group of many near copies, of which any two are links or just not: few pairs are left for the lists."""
    rng = np.random.default_rng(9)
    base, rows = [f"v{k}" for k in range(100)], []
    for k in range(300):
        words = list(base)
        for at in rng.integers(0, 100, rng.integers(0, 6)):
            words[at] = f"n{rng.integers(0, 1000)}"
        rows.append((k, " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    left, other = [], ngram_jaccard._other_pairs
    monkeypatch.setattr(ngram_jaccard, "_other_pairs", lambda *x: left.append(other(*x)) or left[0])
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_jaccard.near_duplicates(frame, 2, 85).collect())
    assert got == Counter(plain.components(rows, 2, 85))


# --- 6 decontamination --------------------------------------------------------------------------

ITEMS = [
    (1, tables.PASSAGE), (2, "the lazy dog"), (3, None), (4, ""), (5, "!!! ---"), (6, tables.PROSE["en"]), (6, tables.PROSE["en"]),
    (7, "Word"), (10, "gold3 gold4 gold5 gold6"), (None, "copy of copies copy"), (11, "never seen words here"),
]


@pytest.mark.parametrize("windows", [decontaminate.BLOCK_WINDOWS, 5])
def test_decontamination(spark, docs, monkeypatch, windows):
    monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", windows)
    items = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, n_hit string")
    clash = docs.withColumn("n_words", F.lit("clash"))
    out = decontaminate.decontaminate(clash, items)
    got = Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in out.collect())
    want = Counter()
    for d, t, *_ in tables.documents():
        n, hit, found = plain.contamination(t, ITEMS)
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        want[d, n, hit, len(found), digest, hit > 0 and 20 * hit >= n] += 1
    assert got == want
    assert set(out.columns) == {*docs.columns, "n_words", "n_hit", "n_items", "items_sha256", "contaminated"}


def test_decontamination_of_nothing(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(docs, none).filter("n_hit > 0 OR contaminated").count() == 0
    assert decontaminate.decontaminate(tables.empty(spark), none).count() == 0


# --- 7 quality ----------------------------------------------------------------------------------


def test_quality_on_held_out_labels(spark, sf):
    got = quality.op7_quality(spark, sf).toPandas()
    labels = duckdb.sql(f"SELECT doc_id, quality FROM '{sf}/labels.parquet'").df()
    held = got[got.held_out].merge(labels, on="doc_id")
    assert (held.predicted == held.quality).mean() >= 0.9
    assert got.score.between(0, 1).all() and ((got.score >= 0.3) == (got.predicted == 1)).all()


def test_quality_of_awkward_rows(spark, docs):
    labels = spark.createDataFrame([(5, 1), (6, 0), (11, 1), (12, 0), (None, 1), (7, None), (5, 1), (999, 0)], "doc_id long, quality int")
    model = quality.fit(docs, labels, F.lit(True))
    out = quality.classify(docs, model)
    assert out.count() == len(tables.documents()) and out.filter("score IS NULL OR score < 0 OR score > 1").isEmpty()
    assert set(out.columns) == {*docs.columns, "predicted"}
    blank = quality.fit(docs, labels.limit(0), F.lit(True))
    assert {r.score for r in quality.classify(docs, blank).collect()} == {0.5}
    assert quality.classify(tables.empty(spark), model).count() == 0


def test_uniqueness_takes_in_the_last_stretch():
    unique = lambda *ids: quality.Features._unique(np.array(ids))
    assert unique(*range(64), *[7] * 36) == 65 / 100
    assert unique(*range(64), *range(64), 1, 1) == 129 / 130
    assert (unique(1, 1, 2), unique(*range(64)), unique(*[3] * 128)) == (2 / 3, 1, 2 / 128)


# --- 8 language model ---------------------------------------------------------------------------


def test_kneser_ney_against_plain_counts(spark, docs, monkeypatch):
    monkeypatch.setattr(kneser_ney, "HOT_SHARE", 20)
    monkeypatch.setattr(kneser_ney, "SHARD_TOKENS", 2000)
    monkeypatch.setattr(kneser_ney, "WORD_BITS", 6)
    train = F.col("doc_id").isNull() | (F.col("doc_id") % 3 != 0)
    out = kneser_ney.score(docs, kneser_ney.fit(docs, train)).collect()
    rows = [(r[0], r[1]) for r in tables.documents()]
    learnt = [t for d, t in rows if d is None or d % 3]
    scores, _, chance = plain.kneser_ney(learnt, [t for _, t in rows], kneser_ney.discounts)
    counts = Counter(w for t in learnt for w in [*plain.words(t), None])
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for (d, t), s in zip(rows, scores):
        tokens = [*plain.words(t), None]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens)
        want[d, len(tokens), sum(counts[w] > 0 for w in tokens), n, round(base, 4), round(s, 4)] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4), round(r.score, 4)) for r in out) == want
    for h in ("<s>", "the", "w1", "never"):
        assert math.isclose(sum(chance(h, w) for w in [*counts, "unknown"]), 1, abs_tol=1e-9)


def test_kneser_ney_without_training_or_rows(spark, docs):
    model = kneser_ney.fit(docs, F.lit(False))
    assert all(r.score == 0 and r.base_score == 0 and r.n_known == 0 for r in kneser_ney.score(docs, model).collect())
    assert kneser_ney.score(tables.empty(spark), model).count() == 0


# --- 9 language ---------------------------------------------------------------------------------


def _segmentations(word, pieces):
    if not word:
        yield []
    for k in range(1, min(len(word), pieces.longest) + 1):
        n = pieces.number.get(word[:k], pieces.unknown if k == 1 else None)
        if n is not None:
            yield from ([n, *rest] for rest in _segmentations(word[k:], pieces))


def test_forward_sums_all_segmentations():
    pieces = language_id.pieces(language_id.public_vocabulary())
    words = ["▁hello", "▁a", "▁日本", "▁straße", "▁xxx", "▁été12"]
    chances = np.random.default_rng(5).random((pieces.size, 3))
    chances = np.vstack([chances / chances.sum(axis=0), np.zeros(3)])
    lattice, lengths = pieces.lattice(words), np.array([len(w) for w in words])
    row, piece, uses = language_id.expected(lattice, lengths, 1 / pieces.size)
    for k, (word, got) in enumerate(zip(words, language_id.forward(lattice, chances, lengths))):
        found = list(_segmentations(word, pieces))
        assert np.allclose(got, np.log(sum(np.prod(chances[s], axis=0) for s in found)))
        weights = np.array([float(pieces.size) ** -len(s) for s in found])
        want = Counter()
        for s, w in zip(found, weights / weights.sum()):
            for p in s:
                want[p] += w
        mine = Counter()
        for p, u in zip(piece[row == k], uses[row == k]):
            mine[int(p)] += u
        assert all(math.isclose(mine[p], want[p], abs_tol=1e-12) for p in set(want) | set(mine))


def test_forward_of_a_very_long_word():
    pieces = language_id.pieces(language_id.public_vocabulary())
    chances = np.vstack([np.full((pieces.size, 2), 1 / pieces.size), np.zeros(2)])
    word = "▁" + "qz" * 5000
    assert np.isfinite(language_id.forward(pieces.lattice([word]), chances, np.array([len(word)]))).all()


def test_language_on_held_out_rows(spark, sf):
    got = language_id.op9_language_id(spark, sf).toPandas()
    langs = duckdb.sql(f"SELECT doc_id, lang FROM '{sf}/documents.parquet'").df()
    held = got[got.held_out].merge(langs, on="doc_id")
    assert (held.lang_pred == held.lang).mean() >= 0.97


def test_language_of_awkward_rows(spark, docs):
    out = language_id.identify(docs, language_id.public_vocabulary(), F.lit(True))
    assert set(out.columns) == {*docs.columns, "lang_pred"}
    for r in out.collect():
        letters = r.text is not None and any(c.isalpha() for c in r.text)
        assert (r.lang_pred == "und", r.score == 0) == (not letters, not letters)
        assert 0 <= r.score <= 1
    told = {r.doc_id: r.lang_pred for r in out.collect()}
    assert told[12] == "de" and told[300] == "de" and told[301] == "en"
    none = language_id.identify(docs, language_id.public_vocabulary(), F.lit(False))
    assert {(r.lang_pred, r.score) for r in none.collect()} == {("und", 0.0)}
    assert language_id.identify(tables.empty(spark), language_id.public_vocabulary(), F.lit(True)).count() == 0


# --- 10 archives --------------------------------------------------------------------------------

BIG = "<html>" + "payload ä " * 200


def _pages():
    return [
        (1, "http://a", BIG), (2, "http://b", BIG), (3, None, BIG), (3, None, BIG), (4, "u r\nl", "small"), (5, "x", "small"),
        (6, "x", None), (7, "x", ""), (None, "x", BIG), (8, "x", BIG + "other"), (None, "x", "y" * 2000), (None, "x", "y" * 2000), (9, "x", tables.LONG),
    ]


def test_archives_round_trip(spark, monkeypatch):
    frame = spark.createDataFrame([(*r, "z") for r in _pages()], "page_id long, url string, html string, payload string").repartition(3)
    for limit in (warc.FILE_BYTES, 500):
        monkeypatch.setattr(warc, "FILE_BYTES", limit)
        got = warc.read_archives(warc.write_archives(frame)).collect()
        want = Counter()
        for p, _, html in _pages():
            data = (html or "").encode()
            top = max((q for q, _, h in _pages() if h == html and q is not None), default=None) if len(data) >= 1000 else None
            revisit = top is not None and p != top
            want[p, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", top if revisit else None] += 1
        assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
        assert all(hashlib.sha1(r.payload).hexdigest() == r.payload_digest for r in got if r.record_type == "response")
    assert warc.read_archives(warc.write_archives(frame.limit(0))).count() == 0


def _archive(records, dictionary=b"payload of pages " * 50):
    encoder = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    return warc.dictionary_frame(dictionary) + b"".join(encoder.compress(r) for r in records)


def test_reader_validates_headers_and_lengths():
    good = warc.build_record(1, "http://a", b"payload of pages", None, False)
    data = _archive([good, warc.build_record(2, None, b"x" * 2000, 1, True)])
    found = [warc.parse_record(r) for r in warc.read_frames(io.BytesIO(data))]
    assert [(r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in found] == [(1, 16, "response", None), (2, 2000, "revisit", 1)]
    assert list(warc.read_frames(io.BytesIO(b""))) == []
    plain_frames = zstandard.ZstdCompressor().compress(good) * 2
    assert list(warc.read_frames(io.BytesIO(plain_frames))) == [good, good]
    for bad in (
        good.replace(b"WARC/1.1", b"WARC/9.9"), good.replace(b"WARC-Type", b"WARC-Typo"), good[:-1], good + b"x",
        good.replace(b"payload of pages", b"payload of pagez"), good.replace(b"\r\n\r\nHTTP", b"\r\nHTTP"), b"", b"junk",
        good.replace(b"Content-Length: 16", b"Content-Length: 17"), good.replace(b"response\r\n", b"revisit\r\n", 1),
    ):
        with pytest.raises(warc.BadRecord):
            warc.parse_record(bad)
    for cut in (3, 7, 40, len(data) - 3):
        with pytest.raises(warc.BadRecord):
            list(warc.read_frames(io.BytesIO(data[:cut])))


def test_held_out_is_crc32_of_the_id(spark):
    ids = spark.range(50).select("id", held_out(F.col("id"), 7, 2).alias("h"))
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 7 == 2) for r in ids.collect())

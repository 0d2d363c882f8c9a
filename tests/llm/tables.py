"""Small tables with every awkward case, for all operators of the subpackage."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, taken string, score string"

LONG = " ".join(f"w{k % 977}" for k in range(60_000))
PASSAGE = " ".join(f"gold{k}" for k in range(30))
PROSE = {
    "en": "the quick brown fox jumps over the lazy dog and then the dog sleeps while the fox runs away from the house",
    "de": "der schnelle braune fuchs springt über den faulen hund und dann schläft der hund während der fuchs wegläuft",
}


def _row(doc_id, text, lang="en", source="a"):
    return doc_id, text, lang, source, None if text is None else len(text), "x", "y"


def documents():
    """Nulls in every column, empty and long texts, copies, near copies, ties, repeated rows and ids."""
    rows = [
        _row(None, None, None, None),
        _row(1, None),
        _row(2, ""),
        _row(3, "", None, None),
        _row(4, " \n\t "),
        _row(5, "word"),
        _row(6, "WORD"),
        _row(7, LONG),
        _row(8, LONG.upper(), "de", "b"),
        _row(9, f"before {PASSAGE} after"),
        _row(10, f"{PROSE['en']} {PASSAGE[:80]}"),
        _row(11, PROSE["en"]),
        _row(11, PROSE["en"]),
        _row(11, "another text under the same id"),
        _row(12, PROSE["de"], "de", None),
        _row(13, "123 456 --- !!!", None, "c"),
        _row(14, "Ünïcödé ÀÉ é  ſ x　y z\r\nline\vtab\fend"),
        _row(None, "no id but text", "en", "d"),
        _row(15, "a b c"),
        _row(16, "A b C"),
    ]
    base = [f"t{k}" for k in range(200)]
    for k in range(8):  # near copies that differ by a word each
        words = list(base)
        words[20 * k + 3] = f"edit{k}"
        rows.append(_row(100 + k, " ".join(words), "en", "b"))
    for k in range(6):  # exact copies
        rows.append(_row(200 + k, "copy of copies " * 20, "en", "a"))
    for k in range(12):
        lang = "en" if k % 2 else "de"
        rows.append(_row(300 + k, " ".join(PROSE[lang].split()[k % 5 :]), lang, "abc"[k % 3]))
    return rows


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, DOCS).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOCS)

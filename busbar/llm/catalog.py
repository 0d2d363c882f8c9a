"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontaminate, exact_dedup, hard_negatives, kneser_ney, language_id, licenses, mixture, ngram_jaccard, quality, repeats, signature_search, token_files, warc

_MODULES = [token_files, mixture, licenses, exact_dedup, ngram_jaccard, decontaminate, quality, kneser_ney, language_id, warc, signature_search, repeats, hard_negatives]

QUERIES = {name: fn for m in _MODULES for name, fn in m.QUERIES.items()}
SQL = {name: sql for m in _MODULES for name, sql in m.SQL.items()}

"""The queries of this subpackage by name, and their SQL."""

from __future__ import annotations

from marlstone.llm import alignment, collocations, exact_dedup, language, lm, media, packing, pii, piece_codec, simhash, toxicity, url_filter, warc

MODULES = (simhash, packing, exact_dedup, media, lm, warc, url_filter, language, piece_codec, toxicity, collocations, alignment, pii)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in m.SQL.items()}

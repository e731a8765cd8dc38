"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from millrace.llm import divergence, jaccard, language, line_dedup, lm, mixing, neardup, pieces, spelling, topk, toxicity, url_filter, warc

MODULES = (jaccard, line_dedup, mixing, topk, lm, url_filter, language, pieces, neardup, warc, toxicity, divergence, spelling)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in m.SQL.items()}

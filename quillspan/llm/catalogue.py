"""The published queries of the training-data operators and their SQL."""

from __future__ import annotations

from quillspan.llm import (
    decontaminate, divergence, hard_negatives, licences, line_dedup, line_quality, mixing, paragraph_dedup, phrases,
    simhash_dedup, suffix_dedup, toxicity, warc,
)
from quillspan.plans.registry import Builder

MODULES = (
    paragraph_dedup, toxicity, suffix_dedup, decontaminate, line_dedup, mixing, warc, simhash_dedup, divergence, licences,
    line_quality, phrases, hard_negatives,
)


def queries() -> dict[str, Builder]:
    return {name: builder for module in MODULES for name, builder in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}

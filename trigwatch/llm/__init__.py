"""Operators for training-corpus tables: filters, scans, deduplication, mixing and output."""

from __future__ import annotations

import importlib

MODULES = ("quality", "warc", "secrets", "jaccard", "pii", "exact", "mixing", "toxicity", "tokens", "decontaminate", "negatives", "search", "bpe")


def load_llm() -> tuple[dict, dict]:
    """Queries and oracle SQL of every operator, and of the corpus pipeline."""
    from trigwatch.llm.registry import ORACLES, QUERIES

    for name in MODULES:
        importlib.import_module(f"trigwatch.llm.{name}")
    pipeline = importlib.import_module("corpus_pipeline")
    QUERIES["pipeline"] = pipeline.run
    if pipeline.ORACLE_SQL is not None:
        ORACLES["pipeline"] = pipeline.ORACLE_SQL
    return QUERIES, ORACLES

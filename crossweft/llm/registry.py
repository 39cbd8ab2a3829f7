"""Queries of the training-data operators; each module files its own beside its SQL, if any."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = (
    "simhash",
    "exact_dedup",
    "substring_dedup",
    "chat_format",
    "divergence_rules",
    "toxicity",
    "source_mixing",
    "personal_data",
    "trie_bpe",
    "suffix_dedup",
    "chosen_path",
    "hard_negatives",
    "spelling_variants",
)

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = (run, sql)
        return run

    return add


def all_queries() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    for module in MODULES:
        import_module(f"crossweft.llm.{module}")
    return QUERIES

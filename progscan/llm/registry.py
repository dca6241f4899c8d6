"""Registry of the training-data jobs."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: One module per operator, in the order of the operator list.
MODULES = ["suffix_dedup", "licenses", "lsh_forest", "quality_rules", "surrogates", "line_dedup", "mixing", "fingerprints", "pieces",
           "sharding", "decontaminate", "periodic_runs", "whitening"]


def job(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise KeyError(f"duplicate job {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn

    return deco


def load() -> None:
    for m in MODULES:
        importlib.import_module(f"progscan.llm.{m}")

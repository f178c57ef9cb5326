"""Registry of runnable cases: operator name -> Spark job and, where possible, equal SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

Job = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Job] = {}
ORACLES: dict[str, str] = {}

MODULES = tuple(sorted(p.stem for p in Path(__file__).parent.glob("*_cases.py")))


def case(name: str, oracle: str | None = None) -> Callable[[Job], Job]:
    def register(job: Job) -> Job:
        if name in QUERIES:
            raise ValueError(f"case registered twice: {name}")
        QUERIES[name] = job
        if oracle is not None:
            ORACLES[name] = oracle
        return job

    return register


def load() -> tuple[dict[str, Job], dict[str, str]]:
    for module in MODULES:
        importlib.import_module(f"marginalia.plans.{module}")
    return QUERIES, ORACLES


def typed(df: DataFrame) -> DataFrame:
    """Widen integers to BIGINT and floats to DOUBLE so both engines report the same types."""
    wide = {"int": "bigint", "smallint": "bigint", "tinyint": "bigint", "float": "double"}
    return df.select(*[df[c].cast(wide[t]).alias(c) if t in wide else df[c] for c, t in df.dtypes])

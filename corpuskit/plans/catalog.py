"""Query catalog: every registered operator query, as a Spark builder plus the
DuckDB oracle SQL of the same result (None where only a rows check applies).

Queries read the full driver tables through the fixture views; nothing is capped
or sampled unless the limit is the operator itself (first-n, caps).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskit.plans import fixtures as fx

Builder = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Builder, str | None]] = {}


def register(name: str, sql: str | None):
    def deco(fn: Builder) -> Builder:
        if name in REGISTRY:
            raise KeyError(f"query {name!r} registered twice")
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def _shipped(fn: Builder) -> Builder:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from corpuskit.session import ship_package
        ship_package(spark)
        return fn(spark, sf_dir)
    run.__name__ = getattr(fn, "__name__", "query")
    run.__doc__ = fn.__doc__
    return run


def queries() -> dict[str, Builder]:
    _load_all()
    return {k: _shipped(v[0]) for k, v in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load_all()
    return {k: v[1] for k, v in REGISTRY.items() if v[1] is not None}


def _load_all():
    # Importing the query modules fills REGISTRY.
    from corpuskit.plans import (q_labels, q_splits, q_text, q_scoring, q_metrics,  # noqa: F401
                                 q_textrank, q_misc, q_io, q_learned, q_simplification)


# Declared class counts per task (the label-count file).
TASK_NUM_LABELS = {"scotus": 2, "ledgar": 2, "unfair_tos": 8, "casehold": 5}


def task_counts_df(spark, counts: dict | None = None) -> DataFrame:
    c = counts or TASK_NUM_LABELS
    return spark.createDataFrame([(k, v) for k, v in c.items()], "task string, num_labels bigint")


def duck_values(rows: list[tuple], cols: list[str]) -> str:
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return str(v)
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({', '.join(cols)})"


def duck_task_counts(counts: dict | None = None) -> str:
    c = counts or TASK_NUM_LABELS
    return duck_values(list(c.items()), ["task", "num_labels"])


__all__ = ["register", "queries", "oracle_sql", "fx", "F", "task_counts_df", "duck_task_counts",
           "duck_values", "TASK_NUM_LABELS"]

"""queries(): one callable (spark, sf_dir) -> DataFrame per operator key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import evaluate

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return deco


@register("baseline_metrics")
def q_baseline_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.baseline_metrics(spark, sf)


def _load_all() -> None:
    from . import q_eval, q_prep, q_sft, q_sim, q_stream, q_text  # noqa: F401


_load_all()

"""Flagship evaluation: recency baseline on next-item targets, per split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..operators import expand, metrics as M, scoring
from .prepare import merged_orders


def baseline_metrics(spark: SparkSession, sf_dir: str, ks: Sequence[int] = C.DEFAULT_KS) -> DataFrame:
    """Cleaning -> J1 -> W1 -> next-item 'last' -> recency ranking -> metrics.

    The ranking is row-local (array of products by last position), so after
    the join the only shuffle is the final per-split average."""
    nxt = expand.next_item_last(merged_orders(spark, sf_dir))
    ranked = nxt.select("split", scoring.recency_ranking("prefix").alias("ranked"), F.array("target").alias("truth"))
    per = M.per_row_metrics_list(ranked, "ranked", "truth", ks)
    return M.summarise(per, ks, ["split"])

"""Data-quality checks as one-pass reports (optionally raising)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C


class QualityError(AssertionError):
    pass


def constant_columns_report(df: DataFrame, expected: dict[str, str]) -> DataFrame:
    """Rows, and rows whose column differs from the expected constant."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(~F.coalesce(F.col(c) == F.lit(v), F.lit(False))).alias(f"n_bad_{c}") for c, v in expected.items()],
    )


def item_pages_report(loads: DataFrame) -> DataFrame:
    """Surviving paths that are not item pages."""
    return loads.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(~F.col("url_path").rlike("^" + C.ITEM_PATH)).alias("n_not_item"),
    )


def missing_from(required: DataFrame, present: DataFrame, key: str = "pid") -> DataFrame:
    """Keys of ``required`` that ``present`` lacks (must be empty)."""
    return required.select(key).distinct().join(present.select(key), key, "left_anti")


def require_empty(df: DataFrame, what: str) -> None:
    """Raise when ``df`` has any row (reads at most one row)."""
    if df.limit(1).count() > 0:
        raise QualityError(what)

"""Registered queries: streaming cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..streaming import clean_stream
from .registry import register


@register("stream_clean_loads")
def q_stream_clean_loads(spark: SparkSession, sf: str) -> DataFrame:
    return clean_stream.run_clean_loads(spark, sf).select("seq", "uuid_ind", "session_id", "url_path", "item_id", "item_type")


@register("stream_session_counts")
def q_stream_session_counts(spark: SparkSession, sf: str) -> DataFrame:
    return clean_stream.run_session_counts(spark, sf)

"""Exploratory statistics over sessions, orders and users."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clean import SESSION_KEYS


def session_length(loads: DataFrame) -> DataFrame:
    """A1: loads per (user, session)."""
    return loads.groupBy(*SESSION_KEYS).agg(F.count(F.lit(1)).alias("n_loads"))


def session_unique_items(loads: DataFrame, approx: bool = False) -> DataFrame:
    """A2: distinct items per session (``approx`` uses HyperLogLog++)."""
    agg = F.approx_count_distinct("item_id") if approx else F.count_distinct("item_id")
    return loads.groupBy(*SESSION_KEYS).agg(agg.alias("n_unique_items"))


def histogram(df: DataFrame, value_col: str, count_name: str = "n") -> DataFrame:
    """A3: value -> number of rows (value_counts), plus the mean value as a
    column (a one-row aggregate joined by broadcast)."""
    hist = df.groupBy(value_col).agg(F.count(F.lit(1)).alias(count_name))
    mean = df.agg(F.round(F.avg(value_col), 6).alias("mean"))
    return hist.crossJoin(F.broadcast(mean))


def products_per_order(orders: DataFrame) -> DataFrame:
    """A4: histogram of order sizes."""
    return histogram(orders.select(F.size("products").alias("n_products")), "n_products", "n_orders")


def purchased_not_viewed(merged: DataFrame) -> DataFrame:
    """A5 / U4: purchased products that were not browsed before the order."""
    return merged.select(
        "order_id",
        F.size(F.array_except("products", F.array_distinct("loaded_pids"))).alias("n_not_viewed"),
    ).withColumn("all_viewed", F.col("n_not_viewed") == 0)


def orders_per_user(orders: DataFrame) -> DataFrame:
    """Orders per user."""
    return orders.groupBy("uuid_ind").agg(F.count(F.lit(1)).alias("n_orders"))


def order_id_uniqueness(orders: DataFrame) -> DataFrame:
    """Distinct order ids vs rows."""
    return orders.agg(F.count_distinct("order_id").alias("n_distinct"), F.count(F.lit(1)).alias("n_rows"))


def unique_products(loads: DataFrame, orders: DataFrame) -> DataFrame:
    """Distinct item ids over both logs (loads' items and ordered products)."""
    a = loads.select(F.col("item_id").alias("pid"))
    b = orders.select(F.explode("products").alias("pid"))
    return a.unionByName(b).where(F.col("pid").isNotNull()).distinct()

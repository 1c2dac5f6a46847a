"""Sequence expansion (array -> rows) for next-item and purchase targets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def next_item_last(orders: DataFrame, seq_col: str = "loaded_pids") -> DataFrame:
    """Sequences of length >= 2 -> prefix (all but last) and target (last).
    Keeps order_id / uuid_ind / split (the reference keeps the user column)."""
    keep = [c for c in ("order_id", "uuid_ind", "split") if c in orders.columns]
    s = F.col(seq_col)
    return orders.where(F.size(s) >= 2).select(
        *keep,
        F.slice(s, 1, F.size(s) - 1).alias("prefix"),
        F.element_at(s, -1).alias("target"),
    )


def next_item_iterative(orders: DataFrame, seq_col: str = "loaded_pids") -> DataFrame:
    """One row per prefix length i = 1..n-1: prefix = first i, target = item i+1.
    Order id and user are kept (the reference drops the user here)."""
    keep = [c for c in ("order_id", "uuid_ind", "split") if c in orders.columns]
    s = F.col(seq_col)
    ex = orders.where(F.size(s) >= 2).select(*keep, s.alias("_s"), F.explode(F.sequence(F.lit(1), F.size(s) - 1)).alias("prefix_len"))
    return ex.select(
        *keep, "prefix_len", F.slice("_s", 1, F.col("prefix_len")).alias("prefix"),
        F.element_at("_s", F.col("prefix_len") + 1).alias("target"),
    )


def expand_purchases(orders: DataFrame) -> DataFrame:
    """One row per (order, purchased product): seq = loaded_pids + [product]."""
    ex = orders.select("order_id", "uuid_ind", "loaded_pids", F.explode("products").alias("product"))
    return ex.select("order_id", "uuid_ind", "product", F.concat("loaded_pids", F.array("product")).alias("seq"))


def shuffled_products(seed: int = 0) -> F.Column:
    """T5: the order's products in a seeded pseudo-random order."""
    keyed = F.transform(
        "products",
        lambda p: F.struct(F.md5(F.concat_ws(":", F.col("order_id").cast("string"), p.cast("string"), F.lit(str(seed)))).alias("h"), p.alias("p")),
    )
    return F.transform(F.array_sort(keyed), lambda x: x["p"])


def concat_purchases(orders: DataFrame, seed: int = 0) -> DataFrame:
    """seq = loaded_pids + products in a seeded random order."""
    return orders.select("order_id", "uuid_ind", F.concat("loaded_pids", shuffled_products(seed)).alias("seq"))


def loaded_only_sequences(orders: DataFrame) -> DataFrame:
    """E5: the browse sequence alone, when it has at least two loads."""
    return orders.where(F.size("loaded_pids") >= 2).select("order_id", "uuid_ind", F.col("loaded_pids").alias("seq"))

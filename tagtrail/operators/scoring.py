"""Non-text scorers: recency baseline, random fill, hybrid score."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .indexing import dense_index


def recency_ranking(seq_col: str = "prefix") -> F.Column:
    """Products ranked by their last position in the sequence, latest first
    (the ranking the recency baseline's scores induce) as one array."""
    return F.array_distinct(F.reverse(F.col(seq_col)))


def baseline_score(df: DataFrame, seq_col: str = "loaded_pids", key: str = "order_id", zero_based: bool = False) -> DataFrame:
    """Score of a product = its LAST 1-based position in the
    sequence (R8: 0-based). Long output (key, pid, score)."""
    ex = df.select(key, F.posexplode(seq_col).alias("_p", "pid"))
    off = 0 if zero_based else 1
    return ex.groupBy(key, "pid").agg((F.max("_p") + off).cast("double").alias("score"))


def _draw(text: F.Column) -> F.Column:
    """A number from 0 to 2^32 - 1 from the first 8 hex digits of the md5."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def hash_fill(scores: DataFrame, orders: DataFrame, catalogue: DataFrame, k_max: int, seed: int = 0, key: str = "order_id") -> DataFrame:
    """R9 (fill='hash'): unscored catalogue products are ranked after every
    scored one, in a pseudo-random order of each order's own.

    The catalogue is dealt positions by ``md5(pid:seed)``. An order with ``n <
    k_max`` scored products draws ``2 * k_max`` positions from
    ``md5(key:seed:i)``; behind them come as many positions in a row from the
    first draw, which alone hold ``k_max`` unscored products (or the whole
    catalogue). Repeats and scored products drop out and the first ``k_max -
    n`` stay, so no order is paired with the whole catalogue. Fill scores lie
    in [-11, -10), below any real score."""
    hashed = catalogue.select("pid").where(F.col("pid").isNotNull()).distinct().withColumn(
        "_h", F.md5(F.concat(F.col("pid").cast("string"), F.lit(f":{seed}"))))
    places = dense_index(hashed, ["_h", "pid"], "_at").select("pid", "_at")
    size = places.agg(F.count(F.lit(1)).alias("_n")).where("_n > 0")  # one row
    n_scored = scores.groupBy(key).agg(F.count_distinct("pid").alias("_scored"))
    short = orders.select(key).distinct().join(n_scored, key, "left").na.fill(0, ["_scored"]).where(F.col("_scored") < k_max).crossJoin(F.broadcast(size))
    drawn = F.transform(F.sequence(F.lit(0), F.lit(2 * k_max - 1)), lambda i: _draw(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)), i.cast("string"))) % F.col("_n"))
    in_a_row = F.transform(F.sequence(F.lit(0), F.least(F.lit(2 * k_max), F.col("_n")) - 1), lambda i: (F.col("_d")[0] + i) % F.col("_n"))
    at = short.withColumn("_d", drawn).select(key, "_scored", F.posexplode(F.array_distinct(F.concat("_d", in_a_row))).alias("_i", "_at"))
    open_ = at.join(places, "_at").join(scores.select(key, "pid"), [key, "pid"], "left_anti")
    rank = F.row_number().over(Window.partitionBy(key).orderBy("_i"))
    filled = open_.withColumn("_r", rank).where(F.col("_r") <= k_max - F.col("_scored"))
    fill = filled.select(key, "pid", (F.lit(-10.0) - F.col("_r") / F.lit(float(2 * k_max + 1))).alias("score"))
    return scores.select(key, "pid", "score").unionByName(fill)


def hybrid_score(scores: DataFrame, baseline: DataFrame, key: str = "order_id") -> DataFrame:
    """Keep a score when the product is in the baseline (was browsed),
    else divide it by 1000."""
    b = baseline.select(key, "pid", F.lit(True).alias("_in_b"))
    j = scores.join(b, [key, "pid"], "left")
    return j.select(key, "pid", F.when(F.col("_in_b").isNull(), F.col("score") / 1000.0).otherwise(F.col("score")).alias("score"))

"""Orders and their browsing: catalogue restriction, the order <- preceding
loads join (J1), the time split (W1) and label encodings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from .clean import SESSION_KEYS, earlier_slices, slice_window, with_carry, with_slice
from .indexing import dense_index

LOAD_FIELDS = ["pos", "timestamp", "seq", "item_id", "item_type", "url_path", "main_cat", "sub_cat"]


def restrict_loads_to_catalogue(loads: DataFrame, catalogue: DataFrame) -> DataFrame:
    """keep loads whose item is in the catalogue (semi join; the
    catalogue is broadcast only when its size is checked to be small)."""
    cat = catalogue.select(F.col("pid").alias("item_id")).distinct()
    return loads.join(cat, "item_id", "left_semi")


def position_loads(loads: DataFrame) -> DataFrame:
    """1-based position of every load inside its session, by (timestamp, seq).

    Counted inside time slices; the loads of the earlier slices come as a
    carry row, so no task orders a whole hot session."""
    sliced = with_slice(loads)
    counts = sliced.groupBy(*SESSION_KEYS, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    upto = earlier_slices().rowsBetween(Window.unboundedPreceding, -1)
    carry = counts.select(*SESSION_KEYS, "_slice", F.sum("_n").over(upto).alias("_before")).where("_before IS NOT NULL")
    rows = with_carry(sliced, carry)
    # without a carry row the count starts at 0; with one, the carry row itself is counted too
    before = F.first("_before").over(slice_window())
    pos = F.row_number().over(slice_window()) + F.coalesce(before - 1, F.lit(0).cast("bigint"))
    return rows.withColumn("pos", pos.cast("int")).where("_own = 1").select(*loads.columns, "pos")


def asof_loads(orders: DataFrame, loads: DataFrame) -> DataFrame:
    """Orders plus ``n_loads``: how many loads of the order's session were logged at or before it.

    One as-of pass over the union of loads and orders: a running count inside
    time slices, the slices before coming as a carry row, so neither a join nor
    a task over a whole hot session is needed. Rows without a session or a
    timestamp precede nothing and follow nothing; orders without a preceding
    load are dropped."""
    timed = F.col("timestamp").isNotNull()
    for key in SESSION_KEYS:
        timed = timed & F.col(key).isNotNull()
    at = [*SESSION_KEYS, "timestamp"]
    seen = loads.where(timed).select(*at, F.lit(0).alias("_kind"), F.lit(1).cast("bigint").alias("_seen"))
    asks = orders.where(timed).select(*at, F.lit(1).alias("_kind"), F.lit(0).cast("bigint").alias("_seen"), F.struct(*orders.columns).alias("_order"))
    rows = with_slice(seen.unionByName(asks, allowMissingColumns=True))
    counts = rows.groupBy(*SESSION_KEYS, "_slice").agg(F.sum("_seen").alias("_n"))
    upto = earlier_slices().rowsBetween(Window.unboundedPreceding, -1)
    carry = counts.select(*SESSION_KEYS, "_slice", F.lit(0).alias("_kind"), F.sum("_n").over(upto).alias("_seen")).where("_seen > 0")
    inside = Window.partitionBy(*SESSION_KEYS, "_slice").orderBy("_own", "timestamp", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    counted = with_carry(rows, carry).withColumn("n_loads", F.sum("_seen").over(inside)).where("_kind = 1 AND n_loads > 0")
    return counted.select("_order.*", F.col("n_loads").cast("int").alias("n_loads"))


def session_loads(loads: DataFrame, orders: DataFrame) -> DataFrame:
    """(session, session_loads): the timed loads, in order, of every session that has an order, stored once."""
    wanted = orders.select(*SESSION_KEYS).distinct()
    timed = loads.where("timestamp IS NOT NULL").join(wanted, SESSION_KEYS, "left_semi")
    return timed.groupBy(*SESSION_KEYS).agg(F.array_sort(F.collect_list(F.struct(*LOAD_FIELDS))).alias("session_loads"))


def cut_prefixes(orders: DataFrame, sessions: DataFrame) -> DataFrame:
    """Orders with ``n_loads`` plus the first ``n_loads`` loads of their session and ``loaded_pids``."""
    out = orders.join(sessions, SESSION_KEYS).withColumn("loads", F.slice("session_loads", 1, F.col("n_loads")))
    return out.select(*[c for c in orders.columns if c != "n_loads"], "loads", F.col("loads.item_id").alias("loaded_pids"))


def attach_preceding_loads(orders: DataFrame, positioned_loads: DataFrame) -> DataFrame:
    """J1 (array form): orders plus ``loads`` ARRAY<STRUCT> ordered by
    position and ``loaded_pids``; orders with no preceding load are dropped.

    An order carries the length of its prefix; the loads of a session are
    collected once and cut, not paired with every order."""
    return cut_prefixes(asof_loads(orders, positioned_loads), session_loads(positioned_loads, orders))


def preceding_loads_long(orders: DataFrame, positioned_loads: DataFrame) -> DataFrame:
    """J1 (long form): one row per (order, load of the same session logged at or before the order)."""
    rows = attach_preceding_loads(orders.select("order_id", *SESSION_KEYS, "timestamp"), positioned_loads)
    return rows.select("order_id", *SESSION_KEYS, F.explode("loads").alias("load")).select("order_id", *SESSION_KEYS, "load.*")


def restrict_products(orders: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Products of each order intersected with the catalogue; orders
    left empty are dropped. Products are exploded, semi joined and regrouped on
    the order, whatever the catalogue's size; the planner picks the join."""
    ids = catalogue.select("pid").distinct()
    ex = orders.select("order_id", F.explode("products").alias("pid"))
    kept = ex.join(ids, "pid", "left_semi").groupBy("order_id").agg(F.array_sort(F.collect_set("pid")).alias("_p"))
    return orders.join(kept, "order_id").withColumn("products", F.col("_p")).select(*orders.columns)


def restrict_loads_array(orders: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Keep only catalogue items inside the ``loads`` array (order kept),
    re-derive ``loaded_pids`` and drop orders left without loads (F6). One plan
    for every catalogue size, as U2."""
    ids = catalogue.select(F.col("pid").alias("_pid")).distinct()
    ex = orders.select("order_id", F.posexplode("loads").alias("_i", "_l"))
    kept = ex.join(ids, F.col("_l.item_id") == F.col("_pid"), "left_semi")
    regrouped = kept.groupBy("order_id").agg(F.array_sort(F.collect_list(F.struct("_i", "_l"))).alias("_ls"))
    out = orders.join(regrouped, "order_id").withColumn("loads", F.col("_ls._l")).select(*orders.columns)
    return out.withColumn("loaded_pids", F.col("loads.item_id"))


def time_split(df: DataFrame, ts_col: str = "timestamp", train_ratio: float = C.TRAIN_RATIO, val_ratio: float = C.VAL_RATIO) -> DataFrame:
    """Train if ts <= min + int(span*train), val if <= min + int(span*(train+val)),
    else test. The bounds are a one-row aggregate broadcast to all rows; the
    ratio sum is done in double arithmetic like the reference (0.7 + 0.2 is
    0.8999999999999999)."""
    second = train_ratio + val_ratio
    b = df.agg(F.min(ts_col).alias("_mn"), F.max(ts_col).alias("_mx")).select(
        (F.col("_mn") + ((F.col("_mx") - F.col("_mn")).cast("double") * F.lit(train_ratio)).cast("bigint")).alias("_train_end"),
        (F.col("_mn") + ((F.col("_mx") - F.col("_mn")).cast("double") * F.lit(second)).cast("bigint")).alias("_val_end"),
    )
    out = df.crossJoin(F.broadcast(b))  # exactly one row
    split = (
        F.when(F.col(ts_col) <= F.col("_train_end"), "train")
        .when(F.col(ts_col) <= F.col("_val_end"), "val")
        .otherwise("test")
    )
    return out.withColumn("split", split).drop("_train_end", "_val_end")


def split_bounds(df: DataFrame, ts_col: str = "timestamp", train_ratio: float = C.TRAIN_RATIO, val_ratio: float = C.VAL_RATIO) -> DataFrame:
    """The min / max and the two split bounds as a one-row table."""
    second = train_ratio + val_ratio
    return df.agg(F.min(ts_col).alias("ts_min"), F.max(ts_col).alias("ts_max")).select(
        "ts_min",
        "ts_max",
        (F.col("ts_min") + ((F.col("ts_max") - F.col("ts_min")).cast("double") * F.lit(train_ratio)).cast("bigint")).alias("train_end"),
        (F.col("ts_min") + ((F.col("ts_max") - F.col("ts_min")).cast("double") * F.lit(second)).cast("bigint")).alias("val_end"),
    )


def product_index(catalogue: DataFrame) -> DataFrame:
    """Dense index 0..N-1 (bigint) of the catalogue by pid."""
    return dense_index(catalogue.select("pid").distinct(), ["pid"])


def multi_hot_labels(orders: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Multi-hot label vector over the catalogue (ordered by pid). Only
    for small catalogues -- the metrics use the long truth form instead."""
    cat = catalogue.select("pid").distinct().agg(F.array_sort(F.collect_list("pid")).alias("_ids"))
    out = orders.crossJoin(F.broadcast(cat))  # one row; the vector form is for small catalogues only
    return out.withColumn(
        "y_true", F.transform("_ids", lambda i: F.array_contains(F.col("products"), i).cast("int"))
    ).drop("_ids")


def sparse_labels(orders: DataFrame, catalogue: DataFrame, key: str = "order_id", col: str = "products") -> DataFrame:
    """X1 in sparse form: (key, size, indices, values) - the catalogue's size and the ascending dense indexes
    (``product_index``) of the order's products, each with value 1. The catalogue is joined, never held by a row or a
    task, so its size does not matter. Products outside the catalogue have no index; an order without any, with an
    empty or a null list has empty arrays; repeated products count once."""
    index = product_index(catalogue)
    size = index.agg(F.count(F.lit(1)).alias("size"))  # one row
    at = orders.select(key, F.explode(col).alias("pid")).distinct().join(index, "pid")
    rows = at.groupBy(key).agg(F.array_sort(F.collect_list("idx")).alias("indices"))
    out = orders.select(key).join(rows, key, "left").crossJoin(F.broadcast(size))
    indices = F.coalesce("indices", F.array().cast("array<bigint>"))
    return out.select(key, "size", indices.alias("indices"), F.transform(indices, lambda _: F.lit(1.0)).alias("values"))


def loads_in_order_sessions(loads: DataFrame, orders: DataFrame) -> DataFrame:
    """Loads of sessions in which an order was placed."""
    return loads.join(orders.select(*SESSION_KEYS).distinct(), SESSION_KEYS, "left_semi")


def loads_of_buyers(loads: DataFrame, purchases: DataFrame) -> DataFrame:
    """Loads of users that appear in both logs."""
    buyers = loads.select("uuid_ind").distinct().intersect(purchases.select("uuid_ind").distinct())
    return loads.join(buyers, "uuid_ind", "left_semi")

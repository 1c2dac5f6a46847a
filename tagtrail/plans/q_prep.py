"""Registered queries: sources, cleaning, orders, EDA."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import clean, eda, expand, orders as O, quality
from ..session import scratch_path
from ..sources import fixtures as fx
from .prepare import clean_loads, clean_purchases, prepare
from .registry import register


def _ids(c: str) -> F.Column:
    return F.array_join(F.col(c), ",")


@register("src_table")
def q_src_table(spark: SparkSession, sf: str) -> DataFrame:
    return fx.loads_raw(spark, sf)


@register("sink_table_roundtrip")
def q_sink_table_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "clean_loads")
    clean_loads(spark, sf).write.mode("overwrite").partitionBy("item_type").parquet(path)
    back = spark.read.parquet(path)
    return back.select("seq", "uuid_ind", "session_id", "url_path", "item_id", "item_type", "main_cat", "sub_cat")


@register("clean_self_referral")
def q_clean_self_referral(spark: SparkSession, sf: str) -> DataFrame:
    return clean.drop_self_referrals(fx.loads_raw(spark, sf)).select("seq", "url_now", "url_referrer")


@register("clean_domain")
def q_clean_domain(spark: SparkSession, sf: str) -> DataFrame:
    return clean.keep_domain(fx.loads_raw(spark, sf)).select("seq", U.netloc("url_now").alias("netloc"))


@register("clean_page_families")
def q_clean_page_families(spark: SparkSession, sf: str) -> DataFrame:
    loads = clean.with_url_path(clean.normalise_loads(fx.loads_raw(spark, sf)))
    return clean.drop_page_families(loads).select("seq", "url_path")


@register("page_family_counts")
def q_page_family_counts(spark: SparkSession, sf: str) -> DataFrame:
    return clean.page_family_counts(fx.loads_raw(spark, sf))


@register("url_netloc")
def q_url_netloc(spark: SparkSession, sf: str) -> DataFrame:
    return fx.loads_raw(spark, sf).select(
        "seq", U.netloc("url_now").alias("netloc_now"), U.netloc("url_referrer").alias("netloc_referrer")
    )


@register("url_path")
def q_url_path(spark: SparkSession, sf: str) -> DataFrame:
    return fx.loads_raw(spark, sf).select(
        "seq", U.path("url_now").alias("path_now"), U.path("url_referrer").alias("path_referrer")
    )


@register("url_item_id")
def q_url_item_id(spark: SparkSession, sf: str) -> DataFrame:
    return fx.loads_raw(spark, sf).select("seq", U.item_id(U.path("url_now")).alias("item_id"))


@register("url_to_pid")
def q_url_to_pid(spark: SparkSession, sf: str) -> DataFrame:
    return fx.loads_raw(spark, sf).select(
        "seq", U.url_pid("url_now").alias("pid_now"), U.url_pid("url_referrer").alias("pid_referrer")
    )


@register("url_item_type")
def q_url_item_type(spark: SparkSession, sf: str) -> DataFrame:
    return fx.loads_raw(spark, sf).select("seq", U.item_type(U.path("url_now")).alias("item_type"))


@register("referrer_category")
def q_referrer_category(spark: SparkSession, sf: str) -> DataFrame:
    return fx.loads_raw(spark, sf).select(
        "seq", U.referrer_main_cat("url_referrer").alias("main_cat"), U.referrer_sub_cat("url_referrer").alias("sub_cat")
    )


@register("normalise_schema")
def q_normalise_schema(spark: SparkSession, sf: str) -> DataFrame:
    return clean.normalise_loads(fx.loads_raw(spark, sf))


@register("order_id_extract")
def q_order_id_extract(spark: SparkSession, sf: str) -> DataFrame:
    return clean.normalise_purchases(fx.purchases_raw(spark, sf)).select("seq", "timestamp", "order_id")


@register("order_products")
def q_order_products(spark: SparkSession, sf: str) -> DataFrame:
    p = clean.normalise_purchases(fx.purchases_raw(spark, sf))
    return p.select("seq", "timestamp", "order_id", F.array_join(clean.order_products_column(), ",").alias("products"))


@register("dedup_orders")
def q_dedup_orders(spark: SparkSession, sf: str) -> DataFrame:
    return clean.dedup_orders(clean.normalise_purchases(fx.purchases_raw(spark, sf))).select("order_id", "seq", "timestamp")


@register("filter_min_len")
def q_filter_min_len(spark: SparkSession, sf: str) -> DataFrame:
    m = prepare(spark, sf).merged
    return m.where(F.size("loaded_pids") >= 2).select("order_id", F.size("loaded_pids").alias("n_loads"))


@register("empty_orders_sample")
def q_empty_orders_sample(spark: SparkSession, sf: str) -> DataFrame:
    return clean.empty_orders_sample(fx.purchases_raw(spark, sf)).select("order_id", "seq", "timestamp")


@register("clean_stage_report")
def q_clean_stage_report(spark: SparkSession, sf: str) -> DataFrame:
    return clean.clean_stage_report(fx.loads_raw(spark, sf))


@register("purchase_stage_report")
def q_purchase_stage_report(spark: SparkSession, sf: str) -> DataFrame:
    return clean.purchase_stage_report(fx.purchases_raw(spark, sf))


@register("dq_constant_columns")
def q_dq_constant_columns(spark: SparkSession, sf: str) -> DataFrame:
    a = quality.constant_columns_report(fx.loads_raw(spark, sf), {"web_id": "shop", "event_type": "load"})
    b = quality.constant_columns_report(fx.purchases_raw(spark, sf), {"web_id": "shop", "event_type": "purchase"})
    return a.withColumn("log", F.lit("loads")).unionByName(b.withColumn("log", F.lit("purchases")))


@register("dq_item_pages")
def q_dq_item_pages(spark: SparkSession, sf: str) -> DataFrame:
    return quality.item_pages_report(clean_loads(spark, sf))


@register("clean_consecutive_dups")
def q_clean_consecutive_dups(spark: SparkSession, sf: str) -> DataFrame:
    return clean_loads(spark, sf).select("seq", "uuid_ind", "session_id", "url_path", "item_id")


@register("filter_available_items")
def q_filter_available_items(spark: SparkSession, sf: str) -> DataFrame:
    loads = O.restrict_loads_to_catalogue(clean_loads(spark, sf), fx.products(spark, sf))
    return loads.select("seq", "item_id")


@register("sort_loads")
def q_sort_loads(spark: SparkSession, sf: str) -> DataFrame:
    return prepare(spark, sf).loads.select("uuid_ind", "session_id", "seq", "pos")


@register("order_preceding_loads")
def q_order_preceding_loads(spark: SparkSession, sf: str) -> DataFrame:
    m = prepare(spark, sf, split=False).merged
    return m.select(
        "order_id", "uuid_ind", "session_id", _ids("loaded_pids").alias("loaded_pids"),
        F.size("loads").alias("n_loads"), F.array_join(F.col("loads.seq"), ",").alias("load_seqs"),
    )


@register("loads_in_order_sessions")
def q_loads_in_order_sessions(spark: SparkSession, sf: str) -> DataFrame:
    loads = clean_loads(spark, sf)
    return O.loads_in_order_sessions(loads, clean_purchases(spark, sf)).select("seq", "uuid_ind", "session_id")


@register("loads_of_buyers")
def q_loads_of_buyers(spark: SparkSession, sf: str) -> DataFrame:
    loads = clean_loads(spark, sf)
    return O.loads_of_buyers(loads, clean_purchases(spark, sf)).select("seq", "uuid_ind")


@register("restrict_products")
def q_restrict_products(spark: SparkSession, sf: str) -> DataFrame:
    p = O.restrict_products(clean_purchases(spark, sf), fx.products(spark, sf))
    return p.select("order_id", _ids("products").alias("products"))


@register("restrict_loads")
def q_restrict_loads(spark: SparkSession, sf: str) -> DataFrame:
    """U3 on the array form: orders joined to unrestricted cleaned loads, then
    the loads array filtered to the catalogue (the reference's order of steps)."""
    cat = fx.products(spark, sf)
    loads = O.position_loads(clean_loads(spark, sf))
    p = clean_purchases(spark, sf).select("order_id", "uuid_ind", "session_id", "timestamp", "seq", "products")
    m = O.restrict_loads_array(O.attach_preceding_loads(p, loads), cat)
    return m.select("order_id", _ids("loaded_pids").alias("loaded_pids"))


@register("products_subset_of_loads")
def q_products_subset_of_loads(spark: SparkSession, sf: str) -> DataFrame:
    return eda.purchased_not_viewed(prepare(spark, sf).merged)


@register("time_split")
def q_time_split(spark: SparkSession, sf: str) -> DataFrame:
    return prepare(spark, sf).merged.select("order_id", "timestamp", "split")


@register("split_bounds")
def q_split_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return O.split_bounds(prepare(spark, sf, split=False).merged)


@register("loaded_pids")
def q_loaded_pids(spark: SparkSession, sf: str) -> DataFrame:
    m = prepare(spark, sf).merged
    return m.select("order_id", F.array_join(F.transform("loads", lambda l: l["item_id"]), ",").alias("loaded_pids"))


@register("product_index")
def q_product_index(spark: SparkSession, sf: str) -> DataFrame:
    return O.product_index(fx.products(spark, sf))


@register("multi_hot_labels")
def q_multi_hot_labels(spark: SparkSession, sf: str) -> DataFrame:
    m = O.multi_hot_labels(prepare(spark, sf).merged, fx.products(spark, sf))
    return m.select("order_id", _ids("y_true").alias("y_true"), F.aggregate("y_true", F.lit(0), lambda a, x: a + x).alias("n_true"))


@register("sparse_labels")
def q_sparse_labels(spark: SparkSession, sf: str) -> DataFrame:
    m = O.sparse_labels(prepare(spark, sf).merged, fx.products(spark, sf))
    return m.select("order_id", "size", F.array_join("indices", ",").alias("indices"), F.size("values").alias("n_true"))


@register("session_length")
def q_session_length(spark: SparkSession, sf: str) -> DataFrame:
    return eda.session_length(prepare(spark, sf).loads)


@register("session_unique_items")
def q_session_unique_items(spark: SparkSession, sf: str) -> DataFrame:
    return eda.session_unique_items(prepare(spark, sf).loads)


@register("session_length_hist")
def q_session_length_hist(spark: SparkSession, sf: str) -> DataFrame:
    return eda.histogram(eda.session_length(prepare(spark, sf).loads), "n_loads", "n_sessions")


@register("products_per_order_hist")
def q_products_per_order_hist(spark: SparkSession, sf: str) -> DataFrame:
    return eda.products_per_order(fx.orders_wide(spark, sf))


@register("purchased_not_viewed")
def q_purchased_not_viewed(spark: SparkSession, sf: str) -> DataFrame:
    return eda.histogram(eda.purchased_not_viewed(prepare(spark, sf).merged), "n_not_viewed", "n_orders")


@register("orders_per_user")
def q_orders_per_user(spark: SparkSession, sf: str) -> DataFrame:
    return eda.orders_per_user(prepare(spark, sf).orders)


@register("order_id_uniqueness")
def q_order_id_uniqueness(spark: SparkSession, sf: str) -> DataFrame:
    return eda.order_id_uniqueness(prepare(spark, sf).merged)


@register("unique_products")
def q_unique_products(spark: SparkSession, sf: str) -> DataFrame:
    p = prepare(spark, sf)
    return eda.unique_products(p.cleaned, p.orders)


@register("unmatched_paths")
def q_unmatched_paths(spark: SparkSession, sf: str) -> DataFrame:
    return clean.unmatched_paths(fx.loads_raw(spark, sf))


@register("next_item_last")
def q_next_item_last(spark: SparkSession, sf: str) -> DataFrame:
    n = expand.next_item_last(prepare(spark, sf).merged)
    return n.select("order_id", "uuid_ind", "split", _ids("prefix").alias("prefix"), "target")


@register("next_item_iterative")
def q_next_item_iterative(spark: SparkSession, sf: str) -> DataFrame:
    n = expand.next_item_iterative(prepare(spark, sf).merged)
    return n.select("order_id", "uuid_ind", "prefix_len", _ids("prefix").alias("prefix"), "target")


@register("expand_purchases")
def q_expand_purchases(spark: SparkSession, sf: str) -> DataFrame:
    e = expand.expand_purchases(prepare(spark, sf).merged)
    return e.select("order_id", "uuid_ind", "product", _ids("seq").alias("seq"))


@register("concat_purchases")
def q_concat_purchases(spark: SparkSession, sf: str) -> DataFrame:
    return expand.concat_purchases(prepare(spark, sf).merged, seed=7).withColumn("seq", F.array_join("seq", ","))


@register("loaded_only_sequences")
def q_loaded_only_sequences(spark: SparkSession, sf: str) -> DataFrame:
    e = expand.loaded_only_sequences(prepare(spark, sf).merged)
    return e.select("order_id", "uuid_ind", _ids("seq").alias("seq"))


@register("order_preceding_loads_long")
def q_order_preceding_loads_long(spark: SparkSession, sf: str) -> DataFrame:
    """J1 long form: one row per (order, preceding load) -- no per-order arrays."""
    p = prepare(spark, sf)
    return O.preceding_loads_long(p.purchases, p.loads).select("order_id", "pos", "seq", "item_id")

"""Fixture views derived from the driver tables (definitions in FIXTURES.md).

Each view is a deterministic function of ``event_id`` / keys of the driver
tables, so the same definition exists once here as DataFrame code and once as
SQL for the DuckDB oracle (``sqlcheck/fixtures_sql.py``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table, spread  # noqa: F401  (re-exported)

EPOCH_2024_US = 1704067200000000
WEEK_US = 7 * 86400 * 1000000
DAY_US = 86400 * 1000000


def epoch_us(ts: str | Column) -> Column:
    """Epoch microseconds of a wall-clock timestamp, independent of the
    session time zone (the driver tables hold TIMESTAMP_NTZ)."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff(
        "MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c.cast("timestamp_ntz")
    )


def _events(spark: SparkSession, sf_dir: str, types: list[str]) -> DataFrame:
    return _event_rows(read_table(spark, sf_dir, "events"), types)


def _event_rows(events: DataFrame, types: list[str]) -> DataFrame:
    ev = events.where(F.col("event_type").isin(types))
    return ev.select(
        F.col("event_id"),
        F.col("event_type").alias("_etype"),
        F.col("user_id").alias("uuid_ind"),
        F.col("value"),
        epoch_us("ts").alias("timestamp"),
        F.get_json_object("props", "$.k").cast("bigint").alias("_k"),
    ).withColumn(
        "session_id", F.expr(f"cast((timestamp - {EPOCH_2024_US}) div {WEEK_US} as string)")
    )


def loads_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_loads_raw: page loads (view / click events) with shop URLs."""
    return loads_raw_from(read_table(spark, sf_dir, "events"))


# one page of each family and two unknown pages
OTHER_PAGES = (
    "member.php newslist.php specialty.html authenticate.php contact_proposal.html forget.php inquiry.html sentok.php brand.html precursor.php new_ecpay_payment_3d.php shoppingcart.html index.html insearch.html "
    "modify.html new_order_12.html orderview_ab1.html login_3.php registered.php setbonus_x.html getgift_a.html faq_2.html bulletin_4.html cheapview_5.php bastchoice.php inpage_1_2.html about.html sitemap.xml"
)


def loads_raw_from(events: DataFrame) -> DataFrame:
    """fx_loads_raw over any events DataFrame (batch or streaming)."""
    ev = _event_rows(events, ["view", "click"])
    url_now = F.expr(
        f"""case when event_id % 11 = 0 then concat('https://mob.shop.example/', element_at(split('{OTHER_PAGES}', ' '), cast((event_id div 11) % 28 as int) + 1), '?x=1')
                when event_id % 13 = 0 then concat('https://other.example/cheap_', cast(_k as string), '.html')
                else concat('https://mob.shop.example/',
                            case when _etype = 'click' then 'cheap' else 'favorable' end,
                            '_', cast(_k as string), '.html?ref=', cast(event_id as string)) end"""
    )
    referrer = F.expr(
        """case when event_id % 17 = 0 then url_now
                when event_id % 3 = 0 then concat('https://shop.example/inpage_', cast(_k % 5 as string),
                                                  '_', cast(_k % 7 as string), '.html')
                when event_id % 3 = 1 then concat('https://shop.example/index_', cast(_k % 5 as string), '.html')
                else null end"""
    )
    return (
        ev.withColumn("url_now", url_now)
        .withColumn("url_referrer", referrer)
        .select(
            F.lit("shop").alias("web_id"),
            F.lit("load").alias("event_type"),
            F.col("event_id").alias("seq"),
            "timestamp",
            "session_id",
            "url_referrer",
            "url_now",
            F.expr("case event_id % 3 when 0 then 'desktop' when 1 then 'mobile' else 'tablet' end").alias(
                "device_type"
            ),
            F.expr("cast(event_id % 5 as int)").alias("landing_count"),
            "uuid_ind",
        )
    )


def purchases_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_purchases_raw: purchase events with a nested purchasing_detail;
    every 23rd order is logged twice, one second apart."""
    ev = _events(spark, sf_dir, ["purchase"])
    details = F.expr(
        """case when event_id % 19 = 0 then cast(array() as array<struct<product_id:string>>)
                when event_id % 2 = 0 then array(named_struct('product_id', cast(_k as string)),
                                                 named_struct('product_id', cast((_k + 7) % 100 as string)))
                else array(named_struct('product_id', cast(_k as string))) end"""
    )
    copies = F.explode(F.expr("case when event_id % 23 = 0 then array(0, 1) else array(0) end"))
    return ev.select("*", copies.alias("_copy")).select(
        F.lit("shop").alias("web_id"),
        F.lit("purchase").alias("event_type"),
        F.col("event_id").alias("seq"),
        (F.col("timestamp") + F.col("_copy") * 1000000).alias("timestamp"),
        "session_id",
        "uuid_ind",
        F.struct(
            F.col("event_id").cast("string").alias("order_id"),
            F.col("value").alias("total_price"),
            details.alias("details"),
        ).alias("purchasing_detail"),
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_products: the available catalogue -- parts the click log refers to
    (the ``k`` of an event) that are in stock (p_size <= 45)."""
    seen = read_table(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").cast("bigint").alias("p_partkey"))
    part = read_table(spark, sf_dir, "part").where(F.col("p_size") <= 45).select("p_partkey")
    return part.join(seen, "p_partkey", "left_semi").select(F.col("p_partkey").alias("pid"))


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_tags: pid -> words of p_name, then p_brand, then p_type (every part)."""
    return (
        read_table(spark, sf_dir, "part")
        .select(
            F.col("p_partkey").alias("pid"),
            F.concat(F.split("p_name", " "), F.array("p_brand", "p_type")).alias("tags"),
        )
    )


def tag_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_tag_docs: documents as lower-cased whitespace tokens (a larger corpus)."""
    return tag_docs_from(read_table(spark, sf_dir, "documents"))


def tag_docs_from(documents: DataFrame) -> DataFrame:
    """fx_tag_docs over any documents DataFrame."""
    return documents.select(
        F.col("doc_id"),
        F.col("lang"),
        F.expr(r"array_remove(split(lower(text), '\\s+'), '')").alias("tokens"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_predictions: pid -> generated-looking text (numbered tag line, then
    the whole document whose id equals the product id)."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return docs.join(tags(spark, sf_dir), docs.doc_id == F.col("pid")).select(
        "pid",
        "lang",
        F.concat(F.lit("1. "), F.array_join("tags", ", "), F.lit("\n2. "), F.col("text")).alias("raw_predict"),
    )


def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_generations: a chat-formatted generation around each prediction."""
    return predictions(spark, sf_dir).select(
        "pid",
        "lang",
        F.concat(
            F.lit("<s>[INST] tags of product "), F.col("pid").cast("string"), F.lit(" [/INST]"),
            F.col("raw_predict"), F.lit("</s>"),
        ).alias("generation"),
    )


def orders_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_orders_wide: orders with the distinct parts bought (no browsing)."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    per_order = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("products"))
    return o.join(per_order, o.o_orderkey == per_order.l_orderkey).select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("uuid_ind"), "products"
    )


def training_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_training_log: an epoch x split metric log derived from events
    (epoch = day index, split by user, metrics = bounded ratios)."""
    ev = read_table(spark, sf_dir, "events").select(
        (epoch_us("ts") - F.lit(EPOCH_2024_US)).alias("_us"), "user_id", "value"
    )
    return (
        ev.groupBy(
            F.expr(f"cast(_us div {DAY_US} as int)").alias("epoch"),
            F.expr("case user_id % 3 when 0 then 'train' when 1 then 'val' else 'test' end").alias("split"),
        )
        .agg(
            F.round(F.count(F.lit(1)) / (F.count(F.lit(1)) + 100.0), 6).alias("hr@20"),
            F.round(F.avg("value") / (F.avg("value") + 100.0), 6).alias("ndcg@20"),
        )
    )

"""Cleaning of the click log (loads) and the purchase log.

Row filters and projections are plain Column expressions that Catalyst fuses
into one whole-stage-codegen span; only consecutive-duplicate removal (W2)
and order de-duplication (W3) need data movement.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import urls as U
from ..session import cut_lineage

SESSION_KEYS = ["uuid_ind", "session_id"]
LOAD_ORDER = ["timestamp", "seq"]
SLICE = 3_600_000_000  # one hour in microseconds: sessions are ordered slice by slice


# ------------------------------------------------------------------ loads ---
def normalise_loads(raw: DataFrame) -> DataFrame:
    """Drop the constant columns, session id as BIGINT."""
    return raw.drop("web_id", "event_type").withColumn("session_id", F.col("session_id").cast("bigint"))


def not_self_referred() -> F.Column:
    """F1 predicate: the load was not referred by the same URL (NULL referrer kept)."""
    return F.coalesce(F.col("url_now") != F.col("url_referrer"), F.lit(True))


def in_domain(pattern: str = C.FIXTURE_DOMAIN) -> F.Column:
    """F2 predicate: netloc matches the (start-anchored) domain pattern."""
    return U.netloc("url_now").rlike(U.anchored(pattern))


def not_page_family(families: dict[str, str] | None = None) -> F.Column:
    """F3 predicate: the path matches none of the non-item page families."""
    return ~F.col("url_path").rlike(U.page_family_pattern(families))


def drop_self_referrals(loads: DataFrame) -> DataFrame:
    return loads.where(not_self_referred())


def keep_domain(loads: DataFrame, pattern: str = C.FIXTURE_DOMAIN) -> DataFrame:
    return loads.where(in_domain(pattern))


def with_url_path(loads: DataFrame) -> DataFrame:
    return loads.withColumn("url_path", U.path("url_now"))


def drop_page_families(loads: DataFrame, families: dict[str, str] | None = None) -> DataFrame:
    return loads.where(not_page_family(families))


def with_item_columns(loads: DataFrame) -> DataFrame:
    """Item id and type from the path, category from the referrer."""
    return loads.select(
        "*",
        U.item_id("url_path").alias("item_id"),
        U.item_type("url_path").alias("item_type"),
        U.referrer_main_cat("url_referrer").alias("main_cat"),
        U.referrer_sub_cat("url_referrer").alias("sub_cat"),
    )


def with_slice(loads: DataFrame) -> DataFrame:
    """``_slice``: start of the time slice of a load (a null timestamp sorts first)."""
    ts = F.col("timestamp")
    return loads.withColumn("_slice", F.coalesce(ts - F.pmod(ts, F.lit(SLICE)), F.lit(-(1 << 62))))


def with_carry(sliced: DataFrame, carry: DataFrame) -> DataFrame:
    """Rows plus at most one carry row per slice of a session (``_own`` 0), which sorts before them."""
    return sliced.withColumn("_own", F.lit(1)).unionByName(carry.withColumn("_own", F.lit(0)), allowMissingColumns=True)


def slice_window() -> Window:
    return Window.partitionBy(*SESSION_KEYS, "_slice").orderBy("_own", *LOAD_ORDER)


def earlier_slices() -> Window:
    """Slices of a session, one row each."""
    return Window.partitionBy(*SESSION_KEYS).orderBy("_slice")


def drop_consecutive_duplicates(loads: DataFrame) -> DataFrame:
    """Inside a session ordered by (timestamp, seq), drop a load whose
    path equals the previous load's path (``lag``; a NULL lag keeps the row).

    A session is compared slice by slice, so a hot session spreads over its
    slices; the last path of the slice before comes as a carry row, from an
    aggregate that is combined map-side."""
    sliced = with_slice(loads)
    last = sliced.groupBy(*SESSION_KEYS, "_slice").agg(F.max_by("url_path", F.struct(*LOAD_ORDER)).alias("_last"))
    carry = last.select(*SESSION_KEYS, "_slice", F.lag("_last").over(earlier_slices()).alias("url_path")).where("url_path IS NOT NULL")
    prev = F.lag("url_path").over(slice_window())
    kept = with_carry(sliced, carry).withColumn("_prev", prev)
    kept = kept.where((F.col("_own") == 1) & (F.col("_prev").isNull() | (F.col("_prev") != F.col("url_path"))))
    return kept.select(*loads.columns)


def pre_dedup_loads(raw: DataFrame, domain: str = C.FIXTURE_DOMAIN, families: dict[str, str] | None = None) -> DataFrame:
    """Stages F1, F2, P2, F3, P3/P5/P6 -- all row-local."""
    loads = normalise_loads(raw).where(not_self_referred() & in_domain(domain))
    loads = with_url_path(loads).where(not_page_family(families))
    return with_item_columns(loads)


def clean_loads(raw: DataFrame, domain: str = C.FIXTURE_DOMAIN, families: dict[str, str] | None = None) -> DataFrame:
    """The load cleaning stage end to end."""
    return drop_consecutive_duplicates(pre_dedup_loads(raw, domain, families))


def _stage(no: int, name: str, kept: str, prev: str) -> F.Column:
    return F.struct(
        F.lit(no).alias("stage_no"), F.lit(name).alias("stage"), F.col(kept).alias("n_kept"), F.col(prev).alias("n_prev")
    )


def clean_stage_report(raw: DataFrame, domain: str = C.FIXTURE_DOMAIN, families: dict[str, str] | None = None) -> DataFrame:
    """F8: rows kept / dropped per cleaning stage, percent of the ORIGINAL
    count (null without rows). The log is read once: the job that writes what
    W2 needs of the rows kept so far counts the row-local stages on the way
    (it has no shuffle, so a task that runs again is not counted twice)."""
    flagged = with_url_path(normalise_loads(raw)).select(
        *SESSION_KEYS, *LOAD_ORDER, "url_path",
        not_self_referred().alias("f1"), in_domain(domain).alias("f2"), not_page_family(families).alias("f3"),
    )
    f1, f2, f3 = F.col("f1"), F.col("f2"), F.col("f3")
    seen = Observation("clean_stages")
    flagged = flagged.observe(
        seen, F.count(F.lit(1)).alias("n0"), F.count_if(f1).alias("n1"), F.count_if(f1 & f2).alias("n2"), F.count_if(f1 & f2 & f3).alias("n3"))
    kept = cut_lineage(flagged.where(f1 & f2 & f3).drop("f1", "f2", "f3"), "clean_stages")
    n = {k: seen.get.get(k) or 0 for k in ("n0", "n1", "n2", "n3")}
    n4 = drop_consecutive_duplicates(kept).agg(F.count(F.lit(1)).alias("n4"))
    both = n4.select("*", *(F.lit(v).cast("bigint").alias(k) for k, v in n.items()))
    stages = F.array(
        _stage(0, "raw", "n0", "n0"),
        _stage(1, "self_referral", "n1", "n0"),
        _stage(2, "domain", "n2", "n1"),
        _stage(3, "page_family", "n3", "n2"),
        _stage(4, "consecutive_duplicates", "n4", "n3"),
    )
    out = both.select(F.col("n0"), F.inline(stages))
    return out.select(
        "stage_no",
        "stage",
        F.col("n_kept").cast("bigint").alias("n_kept"),
        (F.col("n_prev") - F.col("n_kept")).cast("bigint").alias("n_dropped"),
        F.round(F.try_divide((F.col("n_prev") - F.col("n_kept")) * 100.0, F.col("n0")), 6).alias("pct_dropped"),
    )


def page_family_counts(raw: DataFrame, domain: str = C.FIXTURE_DOMAIN, families: dict[str, str] | None = None) -> DataFrame:
    """number of loads (after F1, F2) per matched page family; NULL = item or unknown page."""
    loads = with_url_path(normalise_loads(raw).where(not_self_referred() & in_domain(domain)))
    return loads.groupBy(U.page_family("url_path", families).alias("family")).agg(F.count(F.lit(1)).alias("n"))


def unmatched_paths(raw: DataFrame, domain: str = C.FIXTURE_DOMAIN, families: dict[str, str] | None = None) -> DataFrame:
    """A10: paths that are neither a dropped page family nor an item page."""
    loads = with_url_path(normalise_loads(raw).where(not_self_referred() & in_domain(domain)))
    loads = loads.where(not_page_family(families) & ~F.col("url_path").rlike("^" + C.ITEM_PATH))
    return loads.groupBy("url_path").agg(F.count(F.lit(1)).alias("n"))


# -------------------------------------------------------------- purchases ---
def normalise_purchases(raw: DataFrame) -> DataFrame:
    """P7 + P8: drop the constant columns, session as BIGINT, order id out of
    the nested detail."""
    return (
        raw.drop("web_id", "event_type")
        .withColumn("session_id", F.col("session_id").cast("bigint"))
        .withColumn("order_id", F.col("purchasing_detail.order_id").cast("bigint"))
    )


def order_products_column(detail_col: str = "purchasing_detail") -> F.Column:
    """Distinct, sorted product ids of an order."""
    return F.array_sort(
        F.array_distinct(F.transform(F.col(detail_col + ".details"), lambda d: d["product_id"].cast("bigint")))
    )


def dedup_orders(purchases: DataFrame) -> DataFrame:
    """One row per order id, the first logged (by timestamp, seq).

    ``min_by`` is a partial aggregate: copies are reduced on the map side, so
    an order id with a huge number of copies never lands whole in one task."""
    cols = [c for c in purchases.columns if c != "order_id"]
    first = F.min_by(F.struct(*cols), F.struct("timestamp", "seq"))
    return purchases.groupBy("order_id").agg(first.alias("_r")).select("order_id", "_r.*")


def clean_purchases(raw: DataFrame) -> DataFrame:
    """Purchase cleaning end to end: P7, P8, W3, P9, F6 (non-empty orders)."""
    p = dedup_orders(normalise_purchases(raw))
    p = p.withColumn("products", order_products_column())
    return p.where(F.size("products") > 0)


def empty_orders_sample(raw: DataFrame, n: int = 5) -> DataFrame:
    """the first ``n`` de-duplicated orders that hold no product."""
    p = dedup_orders(normalise_purchases(raw)).withColumn("products", order_products_column())
    return p.where(F.size("products") == 0).orderBy("order_id").limit(n)


def purchase_stage_report(raw: DataFrame) -> DataFrame:
    """F8 for purchases: raw rows, after de-duplication, after empty-order removal."""
    norm = normalise_purchases(raw)
    n0 = norm.agg(F.count(F.lit(1)).alias("n0"))
    dedup = dedup_orders(norm).withColumn("products", order_products_column())
    n12 = dedup.agg(F.count(F.lit(1)).alias("n1"), F.count_if(F.size("products") > 0).alias("n2"))
    both = n0.crossJoin(n12)
    stages = F.array(
        _stage(0, "raw", "n0", "n0"),
        _stage(1, "duplicate_orders", "n1", "n0"),
        _stage(2, "empty_orders", "n2", "n1"),
    )
    return both.select("n0", F.inline(stages)).select(
        "stage_no",
        "stage",
        F.col("n_kept").cast("bigint").alias("n_kept"),
        (F.col("n_prev") - F.col("n_kept")).cast("bigint").alias("n_dropped"),
        F.round(F.try_divide((F.col("n_prev") - F.col("n_kept")) * 100.0, F.col("n0")), 6).alias("pct_dropped"),
    )

"""The data preparation chain: raw logs -> cleaned loads / purchases ->
orders with their preceding loads, restricted to the catalogue, split by time."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..operators import clean, orders as O
from ..session import cut_lineage, table_path
from ..sources import fixtures as fx

ORDER_COLS = ["order_id", "uuid_ind", "session_id", "timestamp", "seq", "products"]


@dataclass
class Prepared:
    loads: DataFrame          # cleaned, catalogue-restricted loads with session positions
    purchases: DataFrame      # cleaned, de-duplicated, catalogue-restricted orders
    merged: DataFrame         # orders + loads array + loaded_pids + split
    catalogue: DataFrame      # (pid)
    cleaned: DataFrame        # cleaned loads of every item
    orders: DataFrame         # the orders of ``merged`` without their loads: n_loads and split only


def clean_loads(spark: SparkSession, sf_dir: str, domain: str = C.FIXTURE_DOMAIN) -> DataFrame:
    # W2 reads its input twice: the row-local stages are written once
    return clean.drop_consecutive_duplicates(cut_lineage(clean.pre_dedup_loads(fx.loads_raw(spark, sf_dir), domain), "item_loads"))


def clean_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.clean_purchases(fx.purchases_raw(spark, sf_dir))


_PREPARED: dict[tuple, Prepared] = {}


def input_version(spark: SparkSession, sf_dir: str) -> tuple:
    """Number, bytes and a digest of the names and times of the files that the preparation reads."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load([table_path(sf_dir, t) for t in ("events", "part")])
    digest = F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)"))
    return tuple(files.agg(F.count(F.lit(1)), F.sum("length"), digest).first())


def build(spark: SparkSession, sf_dir: str, domain: str = C.FIXTURE_DOMAIN, cat: DataFrame | None = None,
          split: bool = True) -> Prepared:
    """The preparation plan, not materialised."""
    cat = fx.products(spark, sf_dir) if cat is None else cat
    cleaned = clean.clean_loads(fx.loads_raw(spark, sf_dir), domain)
    loads = O.position_loads(O.restrict_loads_to_catalogue(cleaned, cat))
    purchases = O.restrict_products(clean_purchases(spark, sf_dir).select(*ORDER_COLS), cat)
    orders, merged = O.asof_loads(purchases, loads), O.attach_preceding_loads(purchases, loads)
    if split:
        orders, merged = O.time_split(orders), O.time_split(merged)
    return Prepared(loads, purchases, merged, cat, cleaned, orders)


def prepare(spark: SparkSession, sf_dir: str, domain: str = C.FIXTURE_DOMAIN, split: bool = True,
            materialize: bool = True) -> Prepared:
    """Prepared tables. With ``materialize`` the cleaned loads and the
    merged orders are written once as Parquet tables in the shared
    checkpoint folder (as the reference persists its cleaned tables) and every
    later job of this application reads them instead of re-running the
    cleaning and the windows, as long as the input files stay the same."""
    if not materialize:
        p = build(spark, sf_dir, domain)
    else:
        key = (spark.sparkContext.applicationId, sf_dir, domain, input_version(spark, sf_dir))
        if key not in _PREPARED:
            cat = cut_lineage(fx.products(spark, sf_dir), "catalogue")
            # whatever a later step reads twice is written before it
            cleaned = cut_lineage(clean_loads(spark, sf_dir, domain), "cleaned_loads")
            kept = cut_lineage(O.restrict_loads_to_catalogue(cleaned, cat), "catalogue_loads")
            loads = cut_lineage(O.position_loads(kept), "prepared_loads")
            bought = cut_lineage(clean_purchases(spark, sf_dir).select(*ORDER_COLS), "cleaned_purchases")
            purchases = cut_lineage(O.restrict_products(bought, cat), "prepared_purchases")
            # orders are written with the length of their prefix, sessions with
            # their loads; the prefixes are cut where they are read. The split
            # bounds are a one-row aggregate over the written orders
            asked = cut_lineage(O.asof_loads(purchases, loads), "prepared_orders")
            sessions = cut_lineage(O.session_loads(loads, asked), "prepared_sessions")
            orders = O.time_split(asked)
            merged = O.cut_prefixes(orders, sessions).select(*ORDER_COLS, "loads", "loaded_pids", "split")
            _PREPARED[key] = Prepared(loads, purchases, merged, cat, cleaned, orders)
        p = _PREPARED[key]
    if split:
        return p
    return Prepared(p.loads, p.purchases, p.merged.drop("split"), p.catalogue, p.cleaned, p.orders.drop("split"))


def merged_orders(spark: SparkSession, sf_dir: str, split: bool = True) -> DataFrame:
    return prepare(spark, sf_dir, split=split).merged

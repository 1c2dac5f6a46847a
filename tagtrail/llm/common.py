"""Shared pieces of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage

# Lookup sides are broadcast only when this many rows of at most a few dozen
# bytes were counted; beyond it the join is an ordinary shuffle join.
BROADCAST_IDS = 1_000_000
BATCH_BYTES = 8 << 20
TEXT_BATCH_BYTES = 2 << 20  # where a task makes several arrays as long as its batch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, limit: int = BATCH_BYTES) -> None:
    """Arrow batches of at most ``limit`` bytes in this session from here on (unless it sets less): rows that hold whole
    texts would fill a batch of Spark's default size, once in the executor and once in its Python worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("b")) > limit:
        spark.conf.set(key, f"{limit}b")


def no_clash(df: DataFrame, into: str) -> None:
    """Raise where the result column would replace one of ``df``."""
    if into.lower() in (c.lower() for c in df.columns):
        raise ValueError(f"there is a column {into!r} already: name another with into=")


def held_out(doc_id: str, modulus: int, remainder: int):
    """True where crc32 of the id as text leaves ``remainder``; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % modulus == remainder, F.lit(False))


def learnable(doc_id: str, modulus: int, remainder: int):
    """Rows a model may learn from: a non-null id that is not held out."""
    return F.col(doc_id).isNotNull() & (F.crc32(F.col(doc_id).cast("string")) % modulus != remainder)


def small_side(df: DataFrame, rows: int = BROADCAST_IDS) -> DataFrame:
    """``df`` (a written table of narrow rows) with a broadcast hint when its counted rows are within the bound."""
    return F.broadcast(df) if df.count() <= rows else df


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (u long, v long; self
    loops allowed). The component is the smallest node reachable.

    Large-star / small-star rounds: every round hangs all larger neighbours
    of a node on its smallest neighbour, then all nodes of a star on its
    smallest member. A hub only ever appears as the pre-aggregated minimum of
    its neighbours, and skewed joins on it are split by the planner. Each
    round is written to the shared checkpoint folder, so a lost executor
    costs one round at most. Null ends are ignored. Raises when
    ``max_rounds`` do not suffice, instead of returning a partial answer.
    """
    pairs = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    nodes = cut_lineage(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "cc-nodes")
    stars = cut_lineage(pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc-edges")
    last = None
    for _ in range(max_rounds):
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select("u", "v", "m")
        nxt = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        stars = cut_lineage(nxt, "cc-edges")
        r = stars.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"), F.countDistinct("u").alias("k")).first()
        if (r.n, r.h) == last or r.n == 0:
            break
        last = (r.n, r.h)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return nodes.join(stars.withColumnRenamed("u", "node"), "node", "left").select("node", F.coalesce("v", "node").alias("component"))

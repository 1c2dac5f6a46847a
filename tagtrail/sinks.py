"""Sinks (K1-K5). Every writer takes a path under shared storage."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Entries per written JSON object: a map is split into objects of bounded
# size (one per line), so no single task ever builds the whole map.
JSON_OBJECT_ENTRIES = 10_000


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """K1: Parquet, optionally partitioned (e.g. by split)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_json_map(df: DataFrame, key: str, value: str, path: str, entries_per_object: int = JSON_OBJECT_ENTRIES) -> None:
    """K2: {key: value} JSON objects, one per line, of about ``entries_per_object`` entries each (0: one object), in
    the order of the keys inside an object. Keys of any type are written as their text and dealt by its hash; rows
    without a key are left out, of several values of a key the smallest is written."""
    rows = df.select(F.col(key).cast("string").alias("_k"), F.col(value).alias("_v")).where("_k IS NOT NULL")
    once = rows.groupBy("_k").agg(F.min("_v").alias("_v"))
    objects = -(-once.count() // entries_per_object) if entries_per_object else 1
    bucket = F.pmod(F.xxhash64("_k"), F.lit(max(1, objects)))
    entries = F.array_sort(F.collect_list(F.struct("_k", "_v")))
    objs = once.groupBy(bucket.alias("_b")).agg(F.to_json(F.map_from_entries(entries)).alias("value"))
    objs.select("value").write.mode("overwrite").text(path)


def write_json_ids(df: DataFrame, key: str, path: str, entries_per_array: int = JSON_OBJECT_ENTRIES) -> None:
    """K3: sorted JSON id arrays (one bounded, sorted array per line)."""
    bucket = F.floor(F.col(key).cast("double") / entries_per_array)
    arrs = df.groupBy(bucket.alias("_b")).agg(F.to_json(F.array_sort(F.collect_set(key))).alias("value"))
    arrs.orderBy("_b").select("value").write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    """K4: CSV with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def run_id(config_json: Column) -> Column:
    """K5: run directory key = first 8 hex digits of sha256 of the config text."""
    return F.substring(F.sha2(config_json, 256), 1, 8)


def write_run(df: DataFrame, config: dict, path: str) -> str:
    """K5: the rows of one run under ``path/rows/run_id=...`` and its configuration under ``path/configs/run_id=...``;
    returns the run id. Only the run's own folders are written over, whatever else lies at ``path``."""
    if "run_id" in (c.lower() for c in df.columns):
        raise ValueError("the rows have a column run_id already")
    spark = df.sparkSession
    text = json.dumps(config, sort_keys=True)
    conf = spark.createDataFrame([(text,)], "config string").withColumn("run_id", run_id(F.col("config")))
    this = conf.first()["run_id"]
    for name, rows in (("rows", df.withColumn("run_id", F.lit(this))), ("configs", conf)):
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(f"{path}/{name}")
    return this


def read_run(spark: SparkSession, path: str, this: str) -> tuple[DataFrame, dict]:
    """Rows and configuration of a run; an unknown run is an error."""
    read = lambda name: spark.read.option("basePath", f"{path}/{name}").parquet(f"{path}/{name}/run_id={this}").drop("run_id")
    return read("rows"), json.loads(read("configs").first()["config"])


def write_names(df: DataFrame, name_col: str, path: str, per_line: int = 1000) -> None:
    """Comma-joined names, at most ``per_line`` names per line (ids are
    consecutive inside a partition, so id div per_line bounds each group)."""
    g = F.monotonically_increasing_id().alias("_id")
    lines = df.select(name_col, g).groupBy(F.floor(F.col("_id") / per_line).alias("_b")).agg(
        F.array_join(F.collect_list(name_col), ", ").alias("value")
    )
    lines.select("value").write.mode("overwrite").text(path)

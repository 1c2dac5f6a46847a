"""Read a persisted table. Parquet replaces the reference's pickles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import table_path


def read_table(spark: SparkSession, sf_dir: str, name: str, schema: StructType | None = None) -> DataFrame:
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(table_path(sf_dir, name))


def read_path(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(path)


def spread(df: DataFrame, *key: str) -> DataFrame:
    """``df``, read from files: where one split of these holds more than twice the share of a core (a file of one row
    group is one split's, however large), its rows are dealt by a hash of ``key`` before a step of much work."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    rows = df.groupBy("_metadata.file_path", "_metadata.file_block_start").agg(F.count(F.lit(1)).alias("n"))
    sizes = rows.agg(F.max("n").alias("most"), F.sum("n").alias("every")).first()
    if not sizes.every or sizes.most * cores <= 2 * sizes.every:
        return df
    return df.repartition(max(cores, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), F.xxhash64(*key))

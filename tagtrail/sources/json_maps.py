"""JSON / CSV / text sources.

JSON maps are read as text and parsed with ``from_json`` (JVM side). Line
mode accepts one JSON object per line, so a large map split over many lines
or files is read in parallel; ``multiline=True`` reads each file as one
document (a pretty-printed object, as the reference writes)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _text(spark: SparkSession, path: str, multiline: bool) -> DataFrame:
    return spark.read.text(path, wholetext=multiline)


def read_tag_map(spark: SparkSession, path: str, multiline: bool = False, lower: bool = False) -> DataFrame:
    """S2 (+ S7 with ``lower``): {"pid": [tags]} -> (pid BIGINT, tags ARRAY<STRING>)."""
    m = _text(spark, path, multiline).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    out = m.select(F.explode("m").alias("k", "tags")).select(F.col("k").cast("bigint").alias("pid"), "tags")
    return out.withColumn("tags", lower_tags("tags")) if lower else out


def lower_tags(tags: str | F.Column) -> F.Column:
    """Lower-case every tag."""
    c = F.col(tags) if isinstance(tags, str) else tags
    return F.transform(c, lambda t: F.lower(t))


def read_text_map(spark: SparkSession, path: str, multiline: bool = False, value_name: str = "value") -> DataFrame:
    """S3: {"id": "text"} -> (id BIGINT, value STRING)."""
    m = _text(spark, path, multiline).select(F.from_json("value", "map<string,string>").alias("m"))
    return m.select(F.explode("m").alias("k", value_name)).select(F.col("k").cast("bigint").alias("id"), value_name)


def read_id_list(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """A JSON array of ids per line/file -> (pid BIGINT)."""
    a = _text(spark, path, multiline).select(F.from_json("value", "array<bigint>").alias("a"))
    return a.select(F.explode("a").alias("pid"))


def read_metrics_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A CSV metrics log with a header and an explicit schema (no inference)."""
    return spark.read.csv(path, header=True, schema=schema)


def read_name_list(spark: SparkSession, path: str) -> DataFrame:
    """Comma-separated names -> distinct trimmed names."""
    t = spark.read.text(path)
    names = t.select(F.explode(F.split("value", ",")).alias("name")).select(F.trim("name").alias("name"))
    return names.where(F.col("name") != "").distinct()

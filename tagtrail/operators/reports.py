"""Training-log reports (F9-F11, J6) and enhanced tag corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import cut_lineage
from .fuzzy import canonical_tags, canonicalise


def log_head(log: DataFrame, n: int, split_col: str = "split", order_col: str = "epoch") -> DataFrame:
    """the first ``n`` rows of every split (by epoch)."""
    w = Window.partitionBy(split_col).orderBy(order_col)
    return log.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def log_best(log: DataFrame, metric: str, split_col: str = "split") -> DataFrame:
    """rows attaining the maximum of ``metric`` per split (ties kept)."""
    w = Window.partitionBy(split_col).orderBy(F.col(f"`{metric}`").desc())
    return log.withColumn("_r", F.rank().over(w)).where(F.col("_r") == 1).drop("_r")


def log_last(log: DataFrame, split_col: str = "split", order_col: str = "epoch") -> DataFrame:
    """the last row of every split (``max_by``, a partial aggregate)."""
    cols = [c for c in log.columns if c != split_col]
    last = F.max_by(F.struct(*[F.col(f"`{c}`") for c in cols]), F.col(order_col))
    return log.groupBy(split_col).agg(last.alias("_l")).select(split_col, "_l.*")


def vs_reference(log: DataFrame, reference: DataFrame, metric: str, split_col: str = "split") -> DataFrame:
    """Each log row next to one reference value per split, with the delta
    (the reference table has one row per split: a broadcast join)."""
    ref = reference.select(split_col, F.col(f"`{metric}`").alias("reference"))
    j = log.join(F.broadcast(ref), split_col)
    return j.withColumn("delta", F.round(F.col(f"`{metric}`") - F.col("reference"), 6))


def enhanced_tags(preds: DataFrame, max_len: int | None = 10, add_pid_tag: int = 0, exclude_inputs: bool = False,
                  key: str = "pid", text_col: str = "raw_predict", fuzzy: int | None = None, mode: str = "sort", seed: int = 0) -> DataFrame:
    """Tags parsed from generated text, first ``max_len`` kept, the pid
    appended ``add_pid_tag`` times. With a threshold ``fuzzy`` every tag is
    first replaced by its leader among all parsed tags (G16, ``mode``)."""
    tags = T.parse_tags(text_col, exclude_inputs)
    if fuzzy is not None:
        parsed = cut_lineage(preds.select(key, tags.alias("tags")), "parsed_tags")
        preds = canonicalise(parsed, canonical_tags(parsed.select(F.explode("tags").alias("tag")), fuzzy, mode, seed), key)
        tags = F.col("tags")
    if max_len is not None:
        tags = F.slice(tags, 1, max_len)
    if add_pid_tag > 0:
        tags = F.concat(tags, F.array_repeat(F.col(key).cast("string"), add_pid_tag))
    return preds.select(key, tags.alias("tags"))


def enhanced_words(preds: DataFrame, max_len: int | None = None, add_pid_word: bool = True,
                   key: str = "pid", text_col: str = "raw_predict") -> DataFrame:
    """Words of the generated text after its first line, first
    ``max_len`` (None = all), plus the pid as a word."""
    words = T.parse_words(text_col, exclude_inputs=True)
    if max_len is not None:
        words = F.slice(words, 1, max_len)
    if add_pid_word:
        words = F.concat(words, F.array(F.col(key).cast("string")))
    return preds.select(key, words.alias("tags"))


def pid_only_tags(catalogue: DataFrame) -> DataFrame:
    """Each product's only tag is its id."""
    return catalogue.select("pid", F.array(F.col("pid").cast("string")).alias("tags"))

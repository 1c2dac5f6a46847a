"""The corpus pipeline: five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and reread as the next stage's docs; all but the last keep the
columns of ``documents``.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagtrail.llm import decontaminate, jaccard_join, language_id, mixing, training_shards
from tagtrail.llm.common import table
from tagtrail.llm.queries import MIX_WEIGHTS
from tagtrail.session import cut_lineage

MIN_LANGUAGE_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose best language is no likelier than the others together, go;
    where no row has both a lang and a text there is no model, and every document with a letter stays."""
    model = language_id.fit(docs)
    if not model[0]:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    scored = language_id.identify(docs, model, into="__language")
    return scored.where((F.col("__language.lang_pred") != "und") & (F.col("__language.score") >= MIN_LANGUAGE_SCORE)).drop("__language")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component (five words, similarity 0.8) one document stays, the one with the smallest id."""
    return jaccard_join.keep_one(docs, k=5, share=Fraction(4, 5))


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its leaf's budget takes it."""
    return mixing.mix(docs, weights=MIX_WEIGHTS)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fixed-stride shards of token ids in training order."""
    return training_shards.materialise(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("benchmark_free", benchmark_free), ("source_mix", source_mix), ("shards", shards)]

# a language model, hashed candidate search and token ids are beyond SQL; tests compare the second and third stage with plain Python
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

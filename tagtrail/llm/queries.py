"""One query opN_<name> per operator, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontaminate, embedding_graph, jaccard_join, language_id, mixing, quality_rank, quote_threads, suffix_dedup, token_counts, training_shards, url_filter, whitening
from .common import held_out, learnable, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", "tokens.n_words", "tokens.n_tokens")


def op2_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = language_id.fit(docs.where(learnable("doc_id", 4, 2)))
    return language_id.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "language.lang_pred", "language.score")


def op3_quality_rank(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = quality_rank.fit(docs, table(spark, sf, "labels").where(learnable("doc_id", 5, 0)))
    out = quality_rank.rate(docs.select("doc_id", "text"), model).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score")
    return out.withColumn("predicted", (F.col("score") >= quality_rank.THRESHOLD).cast("int"))


def op4_quote_threads(spark: SparkSession, sf: str) -> DataFrame:
    return quote_threads.reply_ordered(table(spark, sf, "conversations"))


def op5_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return suffix_dedup.duplicate_spans(table(spark, sf, "documents")).drop("starts", "ends")


def op6_source_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.plan(table(spark, sf, "documents"), weights=MIX_WEIGHTS).drop("row_key")


def op7_embedding_graph(spark: SparkSession, sf: str) -> DataFrame:
    return embedding_graph.near_duplicates(table(spark, sf, "embeddings"))


def op8_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf, "documents"), k=4, share=Fraction(85, 100)).drop("component", "row_key")


def op9_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.report(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op10_training_shards(spark: SparkSession, sf: str) -> DataFrame:
    return training_shards.materialise(table(spark, sf, "documents"))


def op11_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf, "pages"), url_filter.rule_table(spark, URL_RULES))


def op12_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whiten(table(spark, sf, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


def op13_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return collocations.collocations(table(spark, sf, "documents"))


# verdict, host, path
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

# weights of the tree's children; names that are missing weigh 1
MIX_WEIGHTS = {"domain": {"domain0": 4, "domain1": 3, "domain2": 2}, "lang": {"en": 5, "de": 3, "fr": 2}}

QUERIES: dict[str, Query] = {
    f.__name__: f for f in (op1_token_counts, op2_language_id, op3_quality_rank, op4_quote_threads, op5_suffix_dedup, op6_source_mix, op7_embedding_graph, op8_jaccard_join, op9_decontaminate, op10_training_shards, op11_url_filter, op12_whitening, op13_collocations)
}

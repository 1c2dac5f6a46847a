"""Registered queries: fuzzy tags, vectors / similarity, batch prediction
(SURVEY 2.11 G16-G18, 2.15, 2.16)."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import expand, fuzzy, predict, sft, vectors
from ..session import cut_lineage
from ..sources import fixtures as fx
from . import tag_eval as TE
from .prepare import prepare
from .registry import register

FUZZY_T = 90
SAMPLE_N = 50
CONFIGS = [{"temperature": 2.0, "top_p": 0.3}, {"temperature": 1.0, "top_p": 0.9}]


def _doc_tokens(spark, sf):
    docs = fx.spread(fx.read_table(spark, sf, "documents"), "doc_id", "text")
    return fx.tag_docs_from(docs).select(F.explode("tokens").alias("tag"))


def _mapping(spark, sf):
    return fuzzy.canonical_tags(_doc_tokens(spark, sf), FUZZY_T, "simple", seed=13)


@register("fuzzy_canonical_tags")
def q_fuzzy_canonical_tags(spark: SparkSession, sf: str) -> DataFrame:
    return _mapping(spark, sf)


@register("fuzzy_lookup")
def q_fuzzy_lookup(spark: SparkSession, sf: str) -> DataFrame:
    bench = fx.read_table(spark, sf, "benchmark").select(
        F.explode(F.expr(r"filter(split(lower(text), '\\s+'), t -> t <> '')")).alias("query"))
    return fuzzy.lookup(bench, _mapping(spark, sf), FUZZY_T, "simple", seed=13, default="<unknown>")


@register("fuzzy_merge_report")
def q_fuzzy_merge_report(spark: SparkSession, sf: str) -> DataFrame:
    return fuzzy.merge_report(_mapping(spark, sf))


def _product_tags(spark, sf):
    """(tags, mapping) of the product tags in mode ``sort``: words in any order and case are one tag."""
    tags = fx.tags(spark, sf)
    return tags, fuzzy.canonical_tags(tags.select(F.explode("tags").alias("tag")), FUZZY_T, "sort", seed=13)


@register("fuzzy_canonical_sort")
def q_fuzzy_canonical_sort(spark: SparkSession, sf: str) -> DataFrame:
    return _product_tags(spark, sf)[1]


@register("fuzzy_canonical_set")
def q_fuzzy_canonical_set(spark: SparkSession, sf: str) -> DataFrame:
    """Product names as sets of words: a name inside another, or nearly so, shares its leader."""
    names = fx.read_table(spark, sf, "part").select(F.col("p_name").alias("tag"))
    return fuzzy.canonical_tags(names, FUZZY_T, "set", seed=13)


@register("tag_metrics_fuzzy")
def q_tag_metrics_fuzzy(spark: SparkSession, sf: str) -> DataFrame:
    """Tag lists with every tag replaced by its leader, then evaluated."""
    n = expand.next_item_last(prepare(spark, sf).merged)
    led = cut_lineage(fuzzy.canonicalise(*_product_tags(spark, sf)), "fuzzy_led")
    return TE.tag_metrics(n, TE.next_item_truth(n), led, fx.products(spark, sf), "union", alpha=1.0)


def _sample_tags(spark, sf):
    sample = sft.sample_rows(fx.products(spark, sf), "pid", SAMPLE_N, seed=21)
    return fx.tags(spark, sf).join(sample, "pid", "left_semi")


@register("tag_count_vectors")
def q_tag_count_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.tag_counts(fx.tags(spark, sf))


@register("tag_cosine")
def q_tag_cosine(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.cosine(vectors.tag_counts(_sample_tags(spark, sf)))


@register("tag_cosine_catalogue")
def q_tag_cosine_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    """V2 over the whole catalogue."""
    catalogue = fx.tags(spark, sf).join(fx.products(spark, sf), "pid", "left_semi")
    return vectors.cosine(vectors.tag_counts(catalogue))


@register("tag_cosine_above")
def q_tag_cosine_above(spark: SparkSession, sf: str) -> DataFrame:
    """V2 over every part: pairs of different tag vectors of cosine 0.75 or more."""
    return vectors.cosine_above(vectors.tag_counts(fx.tags(spark, sf)), Fraction(3, 4))


@register("tag_fuzzy_matrix")
def q_tag_fuzzy_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.fuzzy_matrix(_sample_tags(spark, sf))


@register("tag_projection_2d")
def q_tag_projection_2d(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.projection_2d(fx.tags(spark, sf).join(fx.products(spark, sf), "pid", "left_semi"))


def _prompts(spark, sf):
    return sft.product_prompts(fx.products(spark, sf), fx.tags(spark, sf), 3)


@register("batch_predict")
def q_batch_predict(spark: SparkSession, sf: str) -> DataFrame:
    return predict.batch_predict(_prompts(spark, sf), predict.EchoTagPredictor)


@register("batch_predict_multi")
def q_batch_predict_multi(spark: SparkSession, sf: str) -> DataFrame:
    out = predict.batch_predict_multi(_prompts(spark, sf), CONFIGS, predict.EchoTagPredictor)
    return out.select("pid", F.array_join("predicts", " || ").alias("predicts"))


@register("batch_predict_iterative")
def q_batch_predict_iterative(spark: SparkSession, sf: str) -> DataFrame:
    return predict.batch_predict_iterative(_prompts(spark, sf), predict.EchoTagPredictor, 3)

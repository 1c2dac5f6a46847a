"""Registered queries: instruction-tuning data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import expand, sft
from ..sources import fixtures as fx
from .prepare import prepare
from .registry import register

N_TAGS = 5
MAX_LEN = 20
SYSTEM = "Suggest three tags, best first and with commas between them, for the product that the shopper opens next. "
CONFIGS = [
    {"temperature": 2.0, "top_p": 0.3},
    {"temperature": 1.0, "top_p": 0.9},
    {"temperature": 0.7, "top_p": 1.0},
]


def _merged(spark, sf):
    return prepare(spark, sf).merged


def _loaded_lines(spark, sf):
    seqs = expand.loaded_only_sequences(_merged(spark, sf))
    return sft.render_lines(seqs, fx.tags(spark, sf), "seq", ["order_id"], N_TAGS, MAX_LEN)


def _continuations(spark, sf):
    r = _loaded_lines(spark, sf)
    return r.select("order_id", "uuid_ind", F.lit("").alias("instruction"), *sft.continuation_record("lines"))


def _customer_names(spark, sf):
    return fx.read_table(spark, sf, "customer").select(F.col("c_custkey").alias("uuid_ind"), F.col("c_name").alias("user_name"))


@register("sft_render_sequence")
def q_sft_render_sequence(spark: SparkSession, sf: str) -> DataFrame:
    return _loaded_lines(spark, sf).select("order_id", F.array_join("lines", "\n").alias("text"))


@register("sft_denumber")
def q_sft_denumber(spark: SparkSession, sf: str) -> DataFrame:
    return _loaded_lines(spark, sf).select("order_id", T.denumber(F.array_join("lines", "\n")).alias("text"))


@register("sft_purchase_examples")
def q_sft_purchase_examples(spark: SparkSession, sf: str) -> DataFrame:
    seqs = expand.expand_purchases(_merged(spark, sf))
    r = sft.render_lines(seqs, fx.tags(spark, sf), "seq", ["order_id", "product"], N_TAGS, MAX_LEN)
    return r.select("order_id", "product", F.lit("").alias("instruction"), *sft.purchase_record("lines"))


@register("sft_continuation_examples")
def q_sft_continuation_examples(spark: SparkSession, sf: str) -> DataFrame:
    return _continuations(spark, sf).drop("uuid_ind")


@register("sft_product_prompts")
def q_sft_product_prompts(spark: SparkSession, sf: str) -> DataFrame:
    return sft.product_prompts(fx.products(spark, sf), fx.tags(spark, sf), N_TAGS)


@register("sft_test_prompts")
def q_sft_test_prompts(spark: SparkSession, sf: str) -> DataFrame:
    nxt = expand.next_item_last(_merged(spark, sf).where(F.col("split") == "test"))
    return sft.test_prompts(nxt, fx.tags(spark, sf), N_TAGS, MAX_LEN)


@register("sft_prompt_template")
def q_sft_prompt_template(spark: SparkSession, sf: str) -> DataFrame:
    c = _continuations(spark, sf)
    return c.select("order_id", sft.prompt_text(SYSTEM).alias("prompt"), sft.prompt_text(SYSTEM, legacy=True).alias("prompt_legacy"))


@register("sft_token_labels")
def q_sft_token_labels(spark: SparkSession, sf: str) -> DataFrame:
    t = sft.token_labels(_continuations(spark, sf), ["order_id"], SYSTEM)
    return t.select("order_id", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("input_ids", "labels", "attention_mask")])


@register("user_name_lookup")
def q_user_name_lookup(spark: SparkSession, sf: str) -> DataFrame:
    c = _continuations(spark, sf).drop("instruction")
    return sft.user_instruction(_customer_names(spark, sf), c).select("order_id", "instruction", "input", "output")


@register("union_splits")
def q_union_splits(spark: SparkSession, sf: str) -> DataFrame:
    m = _merged(spark, sf)
    return m.where(F.col("split") == "train").unionByName(m.where(F.col("split") == "val")).select("order_id", "split")


@register("sft_dataset")
def q_sft_dataset(spark: SparkSession, sf: str) -> DataFrame:
    """train+val, loaded-only sequences, seeded shuffle, continuation records."""
    m = _merged(spark, sf)
    tv = m.where(F.col("split") == "train").unionByName(m.where(F.col("split") == "val"))
    return sft.dataset(tv, fx.tags(spark, sf), "loaded", None, N_TAGS, MAX_LEN, seed=11)


def _dataset(mode: str, seed: int):
    def q(spark: SparkSession, sf: str) -> DataFrame:
        """I9 with user names and the default lengths."""
        m = _merged(spark, sf).where(F.col("split").isin("train", "val"))
        names = m.select("uuid_ind").distinct().select("uuid_ind", F.concat(F.lit("customer "), F.col("uuid_ind").cast("string")).alias("user_name"))
        return sft.dataset(m, fx.tags(spark, sf), mode, names, seed=seed)

    return q


for _mode, _seed in (("loaded", 12), ("expanded", 13), ("concatenated", 17)):
    register(f"sft_dataset_{_mode}")(_dataset(_mode, _seed))


@register("prompt_config_grid")
def q_prompt_config_grid(spark: SparkSession, sf: str) -> DataFrame:
    p = sft.product_prompts(fx.products(spark, sf), fx.tags(spark, sf), N_TAGS)
    return sft.with_configs(p, CONFIGS).select("pid", "config_id", "temperature", "top_p", "input")


@register("seq_truncate")
def q_seq_truncate(spark: SparkSession, sf: str) -> DataFrame:
    m = _merged(spark, sf)
    return m.select("order_id", F.array_join(T.first_n("loaded_pids", 3), ",").alias("first3"),
                    F.array_join(T.last_n("loaded_pids", 3), ",").alias("last3"))


@register("shuffle_rows")
def q_shuffle_rows(spark: SparkSession, sf: str) -> DataFrame:
    return sft.shuffle_rank(_merged(spark, sf).select("order_id"), ["order_id"], seed=1)


@register("shuffle_products")
def q_shuffle_products(spark: SparkSession, sf: str) -> DataFrame:
    return _merged(spark, sf).select("order_id", F.array_join(expand.shuffled_products(seed=2), ",").alias("products"))


@register("sample_products")
def q_sample_products(spark: SparkSession, sf: str) -> DataFrame:
    return sft.sample_rows(fx.products(spark, sf), "pid", 50, seed=3)


def _names(spark, sf):
    return fx.read_table(spark, sf, "customer").select(F.trim("c_name").alias("name"))


@register("assign_user_names")
def q_assign_user_names(spark: SparkSession, sf: str) -> DataFrame:
    return sft.assign_user_names(_merged(spark, sf), _names(spark, sf), seed=4)


@register("user_name_classes")
def q_user_name_classes(spark: SparkSession, sf: str) -> DataFrame:
    a = sft.assign_user_names(_merged(spark, sf), _names(spark, sf), seed=4)
    cls = F.when(F.col("n_orders") > 2, "frequent").when(F.col("n_orders") == 2, "repeat").otherwise("first_time")
    return a.groupBy(cls.alias("class")).agg(F.count(F.lit(1)).alias("n_users"))

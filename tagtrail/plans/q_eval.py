"""Registered queries: scoring, ranking metrics, tags, BM25 / IoU."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import bm25, expand, metrics as M, quality, scoring, tagquery
from ..session import cut_lineage, scratch_path
from ..sources import fixtures as fx
from . import tag_eval as TE
from .prepare import prepare
from .registry import register

TAG_ALPHA = 1.0  # fx_tags terms are frequent; alpha 4 would keep 0-4 of ~47 terms (FIXTURES.md)
DOC_ALPHA = 4.0


def _merged(spark, sf):
    return prepare(spark, sf).merged


def _next(spark, sf):
    return expand.next_item_last(_merged(spark, sf))


def _round(df: DataFrame, cols: list[str], d: int = 6) -> DataFrame:
    return df.select(*[F.round(c, d).alias(c) if c in cols else F.col(c) for c in df.columns])


# ------------------------------------------------------------- baseline ----
@register("baseline_score")
def q_baseline_score(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.baseline_score(_merged(spark, sf), "loaded_pids")


@register("rank_products")
def q_rank_products(spark: SparkSession, sf: str) -> DataFrame:
    return M.rank_scores(scoring.baseline_score(_merged(spark, sf), "loaded_pids"), 20)


def _baseline_order_metrics(spark, sf, ks=(5, 10, 20), zero_based=False):
    m = _merged(spark, sf)
    scores = scoring.baseline_score(m, "loaded_pids", zero_based=zero_based)
    return M.ranking_metrics(scores, M.truth_from_products(m), ks)


@register("ranking_metrics")
def q_ranking_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _baseline_order_metrics(spark, sf)


@register("metric_hr")
def q_metric_hr(spark: SparkSession, sf: str) -> DataFrame:
    return _baseline_order_metrics(spark, sf).select("split", "hr@5", "hr@10", "hr@20")


@register("metric_mrr")
def q_metric_mrr(spark: SparkSession, sf: str) -> DataFrame:
    return _baseline_order_metrics(spark, sf).select("split", "mrr@5", "mrr@10", "mrr@20")


@register("metric_ndcg")
def q_metric_ndcg(spark: SparkSession, sf: str) -> DataFrame:
    return _baseline_order_metrics(spark, sf).select("split", "ndcg@5", "ndcg@10", "ndcg@20")


@register("latest_first_metrics")
def q_latest_first_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _baseline_order_metrics(spark, sf, ks=(1, 5, 10, 20), zero_based=True)


@register("score_fill")
def q_score_fill(spark: SparkSession, sf: str) -> DataFrame:
    n = _next(spark, sf)
    scores = scoring.baseline_score(n, "prefix")
    return scoring.hash_fill(scores, n, fx.products(spark, sf), 20, seed=3)


@register("random_metrics")
def q_random_metrics(spark: SparkSession, sf: str) -> DataFrame:
    n = _next(spark, sf)
    empty = scoring.baseline_score(n, "prefix").where(F.lit(False))
    filled = scoring.hash_fill(empty, n, fx.products(spark, sf), 20, seed=5)
    return M.ranking_metrics(filled, TE.next_item_truth(n))


@register("hybrid_score")
def q_hybrid_score(spark: SparkSession, sf: str) -> DataFrame:
    n = _next(spark, sf)
    s = TE.tag_scores(n, fx.tags(spark, sf), fx.products(spark, sf), "union", alpha=TAG_ALPHA)
    h = scoring.hybrid_score(s, scoring.baseline_score(n, "prefix"))
    return _round(h, ["score"])


# ----------------------------------------------------------------- tags ----
@register("bow_english")
def q_bow_english(spark: SparkSession, sf: str) -> DataFrame:
    return fx.tags(spark, sf).select("pid", F.array_join(T.english_bow("tags"), "|").alias("bow"))


@register("bow_chars")
def q_bow_chars(spark: SparkSession, sf: str) -> DataFrame:
    return fx.tags(spark, sf).select("pid", F.array_join(T.chinese_bow("tags"), "|").alias("bow"))


@register("bow_nested")
def q_bow_nested(spark: SparkSession, sf: str) -> DataFrame:
    lists = tagquery.seq_tag_lookup(_next(spark, sf), fx.tags(spark, sf))
    nested = T.nested_bow("seq_tags")
    return lists.select("order_id", F.array_join(F.transform(nested, lambda x: F.array_join(x, " ")), "|").alias("bow"))


@register("seq_tag_lookup")
def q_seq_tag_lookup(spark: SparkSession, sf: str) -> DataFrame:
    lists = tagquery.seq_tag_lookup(_next(spark, sf), fx.tags(spark, sf))
    return lists.select("order_id", F.array_join(F.transform("seq_tags", lambda x: F.array_join(x, ",")), "|").alias("seq_tags"))


def _query(name):
    def q(spark: SparkSession, sf: str) -> DataFrame:
        return tagquery.build_query(_next(spark, sf), fx.tags(spark, sf), name)

    return q


for _name, _fn in [("union", "union"), ("intersection", "intersection"), ("sum", "sum"), ("last", "last"), ("recency", "recency")]:
    register(f"query_{_name}")(_query(_fn))


@register("query_custom_fn")
def q_query_custom_fn(spark: SparkSession, sf: str) -> DataFrame:
    """H1: a caller-supplied Column builder: words of the last two tag lists."""
    fn = lambda lists: T.english_bow(F.flatten(T.last_n(lists, 2)))
    return tagquery.custom_query(_next(spark, sf), fx.tags(spark, sf), fn)


# ----------------------------------------------------------------- BM25 ----
def _doc_index(spark, sf, buckets=None):
    return bm25.build_index(fx.tag_docs(spark, sf), "doc_id", "tokens", alpha=DOC_ALPHA, buckets=buckets)


def _save_doc_index(spark, sf, path):
    bm25.save_index(_doc_index(spark, sf, int(spark.conf.get("spark.sql.shuffle.partitions"))), path)


@register("bm25_postings")
def q_bm25_postings(spark: SparkSession, sf: str) -> DataFrame:
    return _round(_doc_index(spark, sf).postings, ["w"])


@register("bm25_idf")
def q_bm25_idf(spark: SparkSession, sf: str) -> DataFrame:
    return _round(_doc_index(spark, sf).terms, ["idf"])


@register("bm25_index_stats")
def q_bm25_index_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _round(_doc_index(spark, sf).stats, ["avgdl", "avg_idf"])


@register("bm25_score")
def q_bm25_score(spark: SparkSession, sf: str) -> DataFrame:
    n = _next(spark, sf)
    return _round(TE.tag_scores(n, fx.tags(spark, sf), fx.products(spark, sf), "union", alpha=TAG_ALPHA), ["score"])


@register("bm25_index_roundtrip")
def q_bm25_index_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "bm25")
    _save_doc_index(spark, sf, path)
    back = bm25.load_index(spark, path)
    return _round(back.terms, ["idf"])


@register("bm25_index_reload")
def q_bm25_index_reload(spark: SparkSession, sf: str) -> DataFrame:
    """All four tables and the parameters read back, summed up in one row."""
    path = scratch_path(spark, "bm25")
    _save_doc_index(spark, sf, path)
    i = bm25.load_index(spark, path)
    p = i.postings.agg(F.count(F.lit(1)).alias("n_postings"), F.round(F.sum("w"), 3).alias("sum_w"))
    t = i.terms.agg(F.sum("df").alias("sum_df"))
    d = i.docs.agg(F.sum("dl").alias("sum_dl"))
    s = i.stats.select("n_docs", F.round("avgdl", 6).alias("avgdl"), "n_terms")
    return p.crossJoin(t).crossJoin(d).crossJoin(s).select("*", F.lit(i.k1).alias("k1"), F.lit(i.b).alias("b"), F.lit(i.alpha).alias("alpha"))


@register("bm25_reloaded_top_n")
def q_bm25_reloaded_top_n(spark: SparkSession, sf: str) -> DataFrame:
    """R5 + T2: the search of ``bm25_top_n`` on an index that was saved and read back."""
    path = scratch_path(spark, "bm25")
    _save_doc_index(spark, sf, path)
    return _passage_top_n(spark, sf, bm25.load_index(spark, path))


@register("bm25_top_n")
def q_bm25_top_n(spark: SparkSession, sf: str) -> DataFrame:
    """The 5 best documents for every benchmark passage (lower-cased
    whitespace tokens as the query)."""
    q = _passage_terms(spark, sf)
    idx = bm25.build_index(fx.tag_docs(spark, sf), "doc_id", "tokens", alpha=DOC_ALPHA, only=q)
    return _round(bm25.search(idx, q), ["score"])


def _passage_terms(spark: SparkSession, sf: str) -> DataFrame:
    bench = fx.read_table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), F.explode(F.expr(r"filter(split(lower(text), '\\s+'), t -> t <> '')")).alias("term")
    )
    return bench.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qty"))


def _passage_top_n(spark: SparkSession, sf: str, idx: bm25.BM25Index) -> DataFrame:
    return _round(bm25.top_n(bm25.score(idx, _passage_terms(spark, sf), "query_id"), 5, "query_id"), ["score"])


@register("iou_score")
def q_iou_score(spark: SparkSession, sf: str) -> DataFrame:
    n = _next(spark, sf)
    return _round(TE.tag_scores(n, fx.tags(spark, sf), fx.products(spark, sf), "union", "iou"), ["score"])


@register("restrict_tag_corpus")
def q_restrict_tag_corpus(spark: SparkSession, sf: str) -> DataFrame:
    c = TE.restrict_tag_corpus(fx.tags(spark, sf), fx.products(spark, sf))
    return c.select("pid", F.array_join("tags", "|").alias("tags"))


@register("tag_scores")
def q_tag_scores(spark: SparkSession, sf: str) -> DataFrame:
    n = _next(spark, sf)
    return _round(TE.tag_scores(n, fx.tags(spark, sf), fx.products(spark, sf), "sum", alpha=TAG_ALPHA), ["score"])


@register("tag_metrics")
def q_tag_metrics(spark: SparkSession, sf: str) -> DataFrame:
    n = _next(spark, sf)
    return TE.tag_metrics(n, TE.next_item_truth(n), fx.tags(spark, sf), fx.products(spark, sf), "union", alpha=TAG_ALPHA)


@register("ranking_metrics_filled")
def q_ranking_metrics_filled(spark: SparkSession, sf: str) -> DataFrame:
    n = _next(spark, sf)
    return M.ranking_metrics(scoring.baseline_score(n, "prefix"), TE.next_item_truth(n), fill=fx.products(spark, sf), seed=3)


@register("tag_metrics_filled")
def q_tag_metrics_filled(spark: SparkSession, sf: str) -> DataFrame:
    n = _next(spark, sf)
    return TE.tag_metrics(n, TE.next_item_truth(n), fx.tags(spark, sf), fx.products(spark, sf), "last", alpha=TAG_ALPHA, fill=True, seed=3)


@register("metrics_report")
def q_metrics_report(spark: SparkSession, sf: str) -> DataFrame:
    """One wide table, one row per model/split."""
    n = cut_lineage(_next(spark, sf), "next-items")
    truth = TE.next_item_truth(n)
    tags, cat = fx.tags(spark, sf), cut_lineage(fx.products(spark, sf), "catalogue")
    tags = cut_lineage(TE.restrict_tag_corpus(tags, cat), "catalogue-tags")
    index = TE.tag_index(tags, cat, alpha=TAG_ALPHA)
    parts = [
        ("baseline", M.ranking_metrics(scoring.baseline_score(n, "prefix"), truth)),
        ("bm25_union", TE.tag_metrics(n, truth, tags, cat, "union", alpha=TAG_ALPHA, index=index)),
        ("bm25_sum", TE.tag_metrics(n, truth, tags, cat, "sum", alpha=TAG_ALPHA, index=index)),
        ("iou_union", TE.tag_metrics(n, truth, tags, cat, "union", "iou")),
    ]
    out = None
    for name, df in parts:
        df = df.select(F.concat(F.lit(name + "/"), F.col("split")).alias("name"), *[c for c in df.columns if c != "split"])
        out = df if out is None else out.unionByName(df)
    return out


# ------------------------------------------------------------- quality -----
@register("dq_tag_coverage")
def q_dq_tag_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return quality.missing_from(fx.products(spark, sf), fx.tags(spark, sf))


@register("dq_generation_coverage")
def q_dq_generation_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """D3 over every part: those without a generated text."""
    parts = fx.read_table(spark, sf, "part").select(F.col("p_partkey").alias("pid"))
    return quality.missing_from(parts, fx.predictions(spark, sf))


@register("dq_score_truth")
def q_dq_score_truth(spark: SparkSession, sf: str) -> DataFrame:
    """Scored orders missing from the truth, and scored ids outside the catalogue."""
    n = _next(spark, sf)
    s = TE.tag_scores(n, fx.tags(spark, sf), fx.products(spark, sf), "union", alpha=TAG_ALPHA)
    a = s.select("order_id").distinct().join(n.select("order_id"), "order_id", "left_anti").agg(F.count(F.lit(1)).alias("n_orders_not_in_truth"))
    b = s.join(fx.products(spark, sf), "pid", "left_anti").agg(F.count(F.lit(1)).alias("n_scores_outside_catalogue"))
    return a.crossJoin(b)


@register("dq_index_corpus")
def q_dq_index_corpus(spark: SparkSession, sf: str) -> DataFrame:
    idx = _doc_index(spark, sf)
    n = fx.tag_docs(spark, sf).agg(F.count(F.lit(1)).alias("n_corpus"))
    return idx.stats.select("n_docs").crossJoin(n).select("n_docs", "n_corpus", (F.col("n_docs") == F.col("n_corpus")).alias("ok"))

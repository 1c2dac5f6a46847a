"""Tag-based recommendation: tags of browsed products -> query -> BM25 / IoU
scores over the catalogue's tag documents -> ranking metrics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..operators import bm25, metrics as M, quality, tagquery
from ..session import cut_lineage


def restrict_tag_corpus(tags: DataFrame, catalogue: DataFrame, check: bool = True) -> DataFrame:
    """The tag corpus limited to the catalogue (keyed by pid, not by
    position). A catalogue product without tags is an error (D3); ``check=False``
    lets it pass, and no tag query ever finds it."""
    if check:
        quality.require_empty(quality.missing_from(catalogue, tags), "catalogue products without tags")
    return tags.join(catalogue.select("pid").distinct(), "pid", "left_semi")


def tag_scores(
    seqs: DataFrame, tags: DataFrame, catalogue: DataFrame, query_fn: str = "union", algorithm: str = "bm25",
    key: str = "order_id", seq_col: str = "prefix", k1: float = C.EVALUATOR_BM25_K1, b: float = C.BM25_B,
    alpha: float = C.BM25_ALPHA, group: list[str] | None = None, index: bm25.BM25Index | None = None,
) -> DataFrame:
    """(key, pid, score). BM25 uses k1 = 0.75 as the evaluator does; IoU
    only with the 'union' query (as the reference asserts). ``index`` is the
    catalogue's, where several models share one."""
    corpus = restrict_tag_corpus(tags, catalogue)
    q = tagquery.build_query(seqs, corpus, query_fn, key, seq_col, group=group)
    if algorithm == "bm25":
        idx = index or bm25.build_index(corpus, "pid", "tags", k1=k1, b=b, alpha=alpha, group=group)
        return bm25.score(idx, q, key, doc_alias="pid")
    if algorithm == "iou":
        if query_fn != "union":
            raise ValueError("IoU scoring accepts only the 'union' query")
        if group:
            raise ValueError("IoU scoring has no group support")
        return bm25.iou_score(q, corpus, key, "pid", "tags")
    raise ValueError(f"unknown algorithm {algorithm!r}")


def tag_metrics(
    seqs: DataFrame, truth: DataFrame, tags: DataFrame, catalogue: DataFrame, query_fn: str = "union",
    algorithm: str = "bm25", ks: Sequence[int] = C.DEFAULT_KS, key: str = "order_id", seq_col: str = "prefix",
    group_cols: Sequence[str] = ("split",), alpha: float = C.BM25_ALPHA, fill: bool = False, seed: int = 0,
    index: bm25.BM25Index | None = None,
) -> DataFrame:
    """Metrics for every split (``split`` stays a group key -- one job).
    ``fill`` ranks the catalogue's unscored products behind the scored ones (R9)."""
    scores = tag_scores(seqs, tags, catalogue, query_fn, algorithm, key, seq_col, alpha=alpha, index=index)
    return M.ranking_metrics(scores, truth, ks, key, group_cols, fill=catalogue if fill else None, seed=seed)


def tag_index(tags: DataFrame, catalogue: DataFrame, k1: float = C.EVALUATOR_BM25_K1, b: float = C.BM25_B, alpha: float = C.BM25_ALPHA) -> bm25.BM25Index:
    """The catalogue's BM25 index with its postings written once, for several models."""
    idx = bm25.build_index(restrict_tag_corpus(tags, catalogue), "pid", "tags", k1=k1, b=b, alpha=alpha)
    return replace(idx, postings=cut_lineage(idx.postings, "tag-postings"))


def next_item_truth(nxt: DataFrame, key: str = "order_id") -> DataFrame:
    return nxt.select(key, "split", F.col("target").alias("pid"))

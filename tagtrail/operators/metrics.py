"""Ranking and metrics: HR@k, MRR@k, NDCG@k.

Definitions (per evaluated order, then averaged over all orders of a group):
  hr@k   = hits in top k / min(n_true, k)
  mrr@k  = sum over EVERY hit in top k of 1 / rank (may exceed 1)
  ndcg@k = sum over hits of 1/log2(1 + rank) / sum_{i<=min(n_true,k)} 1/log2(1 + i)

Two physical forms compute the same numbers:
  * long form: scores (order, pid, score) -> per-order top-k window (Spark
    inserts a partial WindowGroupLimit before the shuffle, so a hot order is
    trimmed map-side) -> join to truth -> aggregate;
  * list form: a ranked ARRAY per row (e.g. the recency baseline) -> row-local
    higher-order functions, no shuffle until the final per-group average.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..session import cut_lineage
from .bm25 import SCORE_DIGITS
from .scoring import hash_fill


def _ks(ks: int | Sequence[int] | None) -> list[int]:
    if ks is None:
        return list(C.DEFAULT_KS)
    if isinstance(ks, int):
        return [ks]
    return list(ks)


def metric_names(ks: Sequence[int]) -> list[str]:
    return [f"{m}@{k}" for m in ("hr", "mrr", "ndcg") for k in ks]


def _idcg(m: Column) -> Column:
    return F.aggregate(
        F.sequence(F.lit(1), F.greatest(m, F.lit(1))),
        F.lit(0.0),
        lambda acc, i: acc + F.lit(1.0) / F.log2(i + F.lit(1)),
    )


def rank_scores(scores: DataFrame, k_max: int, key: str = "order_id", tie: Sequence[str] = ("pid",), configs: Sequence[str] = ()) -> DataFrame:
    """Rank of each scored product inside its order (score desc, then
    tie-break columns), keeping rank <= k_max (planned as WindowGroupLimit).
    An order is ranked once for each value of the columns ``configs``."""
    w = Window.partitionBy(*configs, key).orderBy(F.col("score").desc(), *[F.col(t) for t in tie])
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k_max)


def per_order_metrics_long(
    ranked: DataFrame, truth: DataFrame, ks: int | Sequence[int] | None = None,
    key: str = "order_id", group_cols: Sequence[str] = ("split",),
) -> DataFrame:
    """Per-order hr/mrr/ndcg from ranked rows (key, pid, rank) and truth rows
    (key, pid, *group_cols). Orders without any ranked row count as misses."""
    ks = _ks(ks)
    group_cols = list(group_cols)
    t = _truth_sets(truth, key, group_cols)
    j = t.join(ranked.select(key, "pid", "rank"), key, "left")
    per = j.groupBy(key).agg(*[F.any_value(g).alias(g) for g in group_cols], *_hit_sums(ks))
    return per.select(key, *group_cols, "n_true", *_metric_columns(ks))


def _truth_sets(truth: DataFrame, key: str, group_cols: Sequence[str]) -> DataFrame:
    return truth.groupBy(key).agg(
        *[F.any_value(g).alias(g) for g in group_cols],
        F.collect_set("pid").alias("_truth"),
    )


def _hit_sums(ks: Sequence[int]) -> list[Column]:
    hit = F.col("pid").isNotNull() & F.array_contains(F.col("_truth"), F.col("pid"))
    aggs = [F.any_value(F.size("_truth")).alias("n_true")]
    for k in ks:
        in_k = hit & (F.col("rank") <= k)
        aggs += [
            F.sum(F.when(in_k, 1).otherwise(0)).alias(f"_hits{k}"),
            F.sum(F.when(in_k, 1.0 / F.col("rank")).otherwise(0.0)).alias(f"_rr{k}"),
            F.sum(F.when(in_k, 1.0 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias(f"_dcg{k}"),
        ]
    return aggs


def _metric_columns(ks: Sequence[int]) -> list[Column]:
    cols = []
    for k in ks:
        m = F.least(F.col("n_true"), F.lit(k))
        cols += [
            (F.col(f"_hits{k}") / m).alias(f"hr@{k}"),
            F.col(f"_rr{k}").alias(f"mrr@{k}"),
            (F.col(f"_dcg{k}") / _idcg(m)).alias(f"ndcg@{k}"),
        ]
    return cols


def config_metrics(
    scores: DataFrame, truth: DataFrame, configs: DataFrame, ks: int | Sequence[int] | None = None,
    key: str = "order_id", group_cols: Sequence[str] = ("split",), digits: int = 6,
) -> DataFrame:
    """M4 for a grid: one row per configuration and group. ``scores`` has the
    columns of ``configs`` (a small table) besides (key, pid, score); ``truth``
    knows nothing of them, every order counts in every configuration.

    Orders meet their truth by ``key`` alone and only hits go on, so where both
    sides come partitioned by ``key`` no ranked row is shuffled. An order
    without a hit adds zeros: it is in the group's count alone.

    If ``configs`` has a column ``at``, ``scores`` are (key, pid, scores): arrays
    in which a configuration's score is at that place (see ``hits_in_cells``)."""
    ks = _ks(ks)
    names, given, groups = metric_names(ks), [c for c in configs.columns if c != "at"], list(group_cols)
    t = _truth_sets(truth, key, groups)
    if "at" in configs.columns:
        hits = hits_in_cells(scores, t, configs.count(), max(ks), key).join(F.broadcast(configs), "at")
        configs = configs.drop("at")
    else:
        ranked = rank_scores(scores, max(ks), key, configs=given)
        hits = ranked.select(*given, key, "pid", "rank").join(t, key).where(F.array_contains("_truth", F.col("pid")))
    per = hits.groupBy(*given, key).agg(*[F.any_value(g).alias(g) for g in groups], *_hit_sums(ks))
    per = per.select(*given, *groups, F.lit(0).cast("bigint").alias("n_orders"), *_metric_columns(ks))
    orders = t.groupBy(*groups).agg(F.count(F.lit(1)).alias("n_orders")).crossJoin(F.broadcast(configs))
    rows = per.unionByName(orders.select(*given, *groups, "n_orders", *[F.lit(0.0).alias(n) for n in names]))
    sums = rows.groupBy(*given, *groups).agg(F.sum("n_orders").alias("n_orders"), *[F.sum(F.col(f"`{n}`")).alias(n) for n in names])
    return sums.select(*given, *groups, "n_orders", *[F.round(F.col(f"`{n}`") / F.col("n_orders"), digits).alias(n) for n in names])


def hits_in_cells(scores: DataFrame, truth: DataFrame, cells: int, k_max: int, key: str) -> DataFrame:
    """(key, pid, at, rank) and the columns of ``truth`` (key, ..., _truth) of the true products among the best
    ``k_max`` by the ``at``-th of the ``cells`` scores of an order: ranked as ``rank_scores`` does, but counted. A true
    product's rank is one more than the number of products before it, so no order is sorted once for each cell.
    Scores are compared as rounded to SCORE_DIGITS, and rounded only where that may decide."""
    own = F.struct("pid", "scores")
    true = F.collect_list(F.when(F.array_contains("_truth", F.col("pid")), own)).over(Window.partitionBy(key))
    rows = scores.select(key, "pid", "scores").join(truth.select(key, "_truth"), key).withColumn("_t", true)
    rows = rows.select(key, "pid", "scores", F.explode("_t").alias("_t"))
    close = 2 * 10.0**-SCORE_DIGITS

    def before(i: int) -> Column:
        mine, its = F.get("scores", F.lit(i)), F.get("_t.scores", F.lit(i))
        near = F.round(mine, SCORE_DIGITS), F.round(its, SCORE_DIGITS)
        tied = (near[0] == near[1]) & (F.col("pid") < F.col("_t.pid"))
        first = F.when(its.isNull(), None).when(mine - its > close, 1).when(its - mine > close, 0).when(near[0] > near[1], 1).when(tied, 1).otherwise(0)
        return F.sum(first)

    ranks = rows.groupBy(key, F.col("_t.pid").alias("pid")).agg(F.array(*[before(i) + 1 for i in range(cells)]).alias("_r"))
    ranks = ranks.select(key, "pid", F.posexplode("_r").alias("at", "rank")).where(F.col("rank") <= k_max)
    return ranks.join(truth, key)


def per_row_metrics_list(df: DataFrame, ranked_col: str, truth_col: str, ks: int | Sequence[int] | None = None) -> DataFrame:
    """List form: per-row metrics from a ranked ARRAY and a truth ARRAY."""
    ks = _ks(ks)
    r, t = F.col(ranked_col), F.col(truth_col)
    n_true = F.size(F.array_distinct(t))
    cols = []
    for k in ks:
        top = F.slice(r, 1, k)
        idx = F.sequence(F.lit(1), F.greatest(F.size(top), F.lit(1)))
        hit_at = lambda i: (F.size(top) >= i) & F.array_contains(t, F.element_at(top, i))
        hits = F.size(F.filter(top, lambda x: F.array_contains(t, x)))
        rr = F.aggregate(idx, F.lit(0.0), lambda acc, i: acc + F.when(hit_at(i), 1.0 / i).otherwise(0.0))
        dcg = F.aggregate(idx, F.lit(0.0), lambda acc, i: acc + F.when(hit_at(i), 1.0 / F.log2(i + 1)).otherwise(0.0))
        m = F.least(n_true, F.lit(k))
        cols += [(hits / m).alias(f"hr@{k}"), rr.alias(f"mrr@{k}"), (dcg / _idcg(m)).alias(f"ndcg@{k}")]
    return df.select("*", *cols)


def summarise(per_order: DataFrame, ks: int | Sequence[int] | None = None, group_cols: Sequence[str] = ("split",), digits: int = 6) -> DataFrame:
    """M4: mean of every metric per group, columns in hr, mrr, ndcg order."""
    ks = _ks(ks)
    names = metric_names(ks)
    return per_order.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n_orders"), *[F.round(F.avg(F.col(f"`{n}`")), digits).alias(n) for n in names]
    )


def truth_from_products(orders: DataFrame, group_cols: Sequence[str] = ("split",), key: str = "order_id") -> DataFrame:
    """Long truth table (key, pid, *group_cols) from the ``products`` array."""
    return orders.select(key, *group_cols, F.explode("products").alias("pid"))


def ranking_metrics(
    scores: DataFrame, truth: DataFrame, ks: int | Sequence[int] | None = None,
    key: str = "order_id", group_cols: Sequence[str] = ("split",), digits: int = 6,
    fill: DataFrame | None = None, seed: int = 0, configs: DataFrame | None = None,
) -> DataFrame:
    """M4 end to end for the long form: rank, join truth, average per group.

    With a catalogue (pid) as ``fill``, products without a score rank behind
    the scored ones in a random order of each evaluated order (R9). With ``configs`` the
    scores are those of a grid (see ``config_metrics``)."""
    ks = _ks(ks)
    if configs is not None:
        if fill is not None:
            raise ValueError("a grid has no fill")
        return config_metrics(scores, truth, configs, ks, key, group_cols, digits)
    if fill is not None:
        # read three times by the fill
        scores = hash_fill(cut_lineage(scores.select(key, "pid", "score"), "scores"), truth, fill, max(ks), seed, key)
    ranked = rank_scores(scores, max(ks), key)
    per = per_order_metrics_long(ranked, truth, ks, key, group_cols)
    return summarise(per, ks, group_cols, digits)

"""Mixing sources to target weights by hierarchical budgeting (DataFrame functions only).

The tree is domain / language / source. A token budget flows down it in
proportion to the weights of each node's children; a child that cannot use its
share (its documents, repeated ``max_epochs`` times, hold fewer tokens) is
filled and its shortage goes to its siblings first, and only what a whole
family cannot use goes to the siblings of its parent. Each leaf then takes
whole epochs plus a prefix, in tokens, of one more epoch in a seeded order.

Prefix sums over a hot leaf are two-level: documents fall into hash slots of
about ``SLOT_DOCS`` documents, sums over the slots find the slot where the
prefix ends, and only that slot is ordered document by document.

All arithmetic is exact (decimal(38, 0)). Edge cases: null and wordless texts
hold no tokens and are taken 0 times; null languages and sources are leaves of their
own; a missing weight counts as the default weight; weights of 0 and below get
nothing; repeated rows (same id and text) are interchangeable and ordered as
equals, so either all of them or none lie before the cut; other columns pass
through; an empty table or a budget of 0 selects nothing.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import small_side

SLOT_DOCS = 512
BIG = "decimal(38,0)"
LEVELS = ("domain", "lang", "source")


def n_tokens(text: Column) -> Column:
    """White-space separated words."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def domain_of(source: Column, domains: int) -> Column:
    """Sources are dealt to ``domains`` domains by the number in their name (0 without one)."""
    return F.concat(F.lit("domain"), F.coalesce(F.regexp_extract(source, r"(\d+)$", 1).try_cast("long") % domains, F.lit(0)).cast("string"))


def weight_of(name: Column, weights: Mapping[str, int], default: int) -> Column:
    out = F.lit(default)
    for key, w in weights.items():
        out = F.when(name == key, F.lit(int(w))).otherwise(out)
    return out.cast(BIG)


def water_fill(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """Split ``budget`` among the rows of each parent by ``weight``, none above ``capacity``.

    Children are ordered by capacity / weight; a child is full when the
    budget left to it and those after it covers more than its capacity at
    equal shares. The others split what is left, rounded down.
    """
    nodes = nodes.where("weight > 0")
    # a ratio of two longs decides the order; exact products decide who is full
    order = [F.col("capacity") / F.col("weight"), *(F.col(c) for c in LEVELS if c in nodes.columns)]
    before = Window.partitionBy(*parent).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.partitionBy(*parent).orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    w = nodes.withColumn("left", F.col("budget") - F.coalesce(F.sum("capacity").over(before).cast(BIG), F.lit(0).cast(BIG))).withColumn("w_rest", F.sum("weight").over(rest).cast(BIG))
    w = w.withColumn("full", F.col("capacity") * F.col("w_rest") <= F.col("weight") * F.col("left"))
    first = Window.partitionBy(*parent)
    open_left = F.min(F.when(~F.col("full"), F.struct(F.col("capacity") / F.col("weight"), F.col("w_rest") * -1, "left", "w_rest"))).over(first)
    w = w.withColumn("o", open_left)
    share = F.expr("CAST((weight * o.left) div o.w_rest AS decimal(38,0))")
    return w.withColumn("quota", F.when(F.col("full"), F.col("capacity")).otherwise(F.least(F.col("capacity"), share))).drop("left", "w_rest", "full", "o", "budget")


def leaf_quotas(leaves: DataFrame, budget: int, weights: Mapping[str, Mapping[str, int]], max_epochs: int, default: int = 1) -> DataFrame:
    """(domain, lang, source, tokens, quota) from (domain, lang, source, tokens)."""
    null = {c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null")) for c in LEVELS}  # windows and joins on plain keys
    base = leaves.select(*(null[c].alias(c) for c in LEVELS), F.col("tokens"), (F.col("tokens") * max_epochs).cast(BIG).alias("capacity"))
    level: DataFrame | None = None
    for depth in range(1, len(LEVELS) + 1):
        keys, parent = list(LEVELS[:depth]), list(LEVELS[: depth - 1])
        name = F.expr(f"substr({LEVELS[depth - 1]}, 2)")
        nodes = base.groupBy(*keys).agg(F.sum("capacity").cast(BIG).alias("capacity"), F.sum("tokens").alias("tokens"))
        nodes = nodes.withColumn("weight", weight_of(name, weights.get(LEVELS[depth - 1], {}), default))
        if level is None:
            nodes = nodes.withColumn("budget", F.lit(int(budget)).cast(BIG))
        else:
            nodes = nodes.join(level.select(*parent, F.col("quota").alias("budget")), parent)
        level = water_fill(nodes, parent)
    back = {c: F.when(F.col(c) != "null", F.expr(f"substr({c}, 2)")) for c in LEVELS}
    return level.select(*(back[c].alias(c) for c in LEVELS), "tokens", F.col("quota").cast("long").alias("quota"))


def plan(docs: DataFrame, budget_share: float = 0.6, weights: Mapping[str, Mapping[str, int]] | None = None, max_epochs: int = 2, domains: int = 4, seed: str = "mix") -> DataFrame:
    """Per row of ``docs``: doc_id, row_key, domain, lang, source, n_tokens, epochs.

    ``epochs`` counts how often the document is taken (0: not at all). The
    budget is ``budget_share`` of all tokens, in thousandths.
    """
    rows = docs.select("doc_id", F.xxhash64("text", "lang", "source").alias("row_key"), domain_of(F.col("source"), domains).alias("domain"), "lang", "source", n_tokens(F.col("text")).alias("n_tokens"))
    order = lambda epoch: F.md5(F.concat_ws(":", F.lit(seed), epoch, F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    rows = cut_lineage(rows, "mix-rows")
    leaves = rows.where("n_tokens > 0").groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_docs"))
    leaves = cut_lineage(leaves, "mix-leaves")
    total = int(leaves.agg(F.sum("tokens")).first()[0] or 0)
    quotas = leaf_quotas(leaves, total * round(budget_share * 1000) // 1000, weights or {}, max_epochs).withColumnsRenamed({c: f"q_{c}" for c in LEVELS})
    leaf = lambda p: F.col("domain").eqNullSafe(F.col(f"{p}_domain")) & F.col("lang").eqNullSafe(F.col(f"{p}_lang")) & F.col("source").eqNullSafe(F.col(f"{p}_source"))
    known = leaves.join(quotas.drop("tokens"), leaf("q")).select(
        *(F.col(f"q_{c}") for c in LEVELS), F.expr("quota div tokens").alias("whole"), F.expr("quota % tokens").alias("part"),
        F.greatest(F.lit(1), F.ceil(F.col("n_docs") / SLOT_DOCS)).cast("long").alias("slots"),
    )
    known = F.broadcast(cut_lineage(known, "mix-quotas")) if leaves.count() <= 100_000 else cut_lineage(known, "mix-quotas")
    placed = rows.where("n_tokens > 0").join(known, leaf("q")).withColumn("mark", order(F.col("whole").cast("string")))
    # slots cut the md5 order into equal ranges of its first 32 bits
    slot = F.expr("CAST((CAST(conv(substr(mark, 1, 8), 16, 10) AS bigint) * slots) div 4294967296 AS bigint)")
    placed = placed.withColumn("slot", slot)
    keys = [*LEVELS, "slot"]
    sums = placed.groupBy(*keys).agg(F.sum("n_tokens").alias("slot_tokens"))
    run = Window.partitionBy(*LEVELS).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("start", F.coalesce(F.sum("slot_tokens").over(run), F.lit(0)))
    sums = sums.select(*(F.col(c).alias(f"s_{c}") for c in keys), "start", "slot_tokens")
    spread = placed.join(sums, leaf("s") & (F.col("slot") == F.col("s_slot")))
    inside = (F.col("start") < F.col("part")) & (F.col("start") + F.col("slot_tokens") > F.col("part"))
    out = ["doc_id", "row_key", *LEVELS, "n_tokens"]
    plain = spread.where(~inside).select(*out, (F.col("whole") + F.when(F.col("start") + F.col("slot_tokens") <= F.col("part"), 1).otherwise(0)).alias("epochs"))
    upto = Window.partitionBy(*keys).orderBy("mark", "row_key").rangeBetween(Window.unboundedPreceding, 0)
    cut = spread.where(inside).withColumn("end", F.col("start") + F.sum("n_tokens").over(upto))
    cut = cut.select(*out, (F.col("whole") + F.when(F.col("end") <= F.col("part"), 1).otherwise(0)).alias("epochs"))
    return plain.union(cut).union(rows.where("n_tokens = 0").select(*out, F.lit(0).cast("long").alias("epochs")))


def mix(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with every row repeated as often as it is taken; all columns stay."""
    taken = plan(docs, **options).where("epochs > 0").select(F.col("doc_id").alias("__mix_doc"), F.col("row_key").alias("__mix_row"), F.col("epochs").cast("int").alias("__mix_epochs")).distinct()
    taken = small_side(cut_lineage(taken, "mix-taken"))
    kept = docs.join(taken, docs["doc_id"].eqNullSafe(taken["__mix_doc"]) & (F.xxhash64(docs["text"], docs["lang"], docs["source"]) == taken["__mix_row"]))
    return kept.withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), F.col("__mix_epochs")))).select(*(docs[c] for c in docs.columns))

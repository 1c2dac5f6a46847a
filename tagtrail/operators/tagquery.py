"""Sequence -> tags lookup (J4) and multiset query builders.

Queries are long tables (key, term, qty): the multiset of query terms of
each evaluated sequence. Building them is explode + aggregate, so a long
sequence is split across tasks by the partial aggregation."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def seq_tags_long(seqs: DataFrame, tags: DataFrame, key: str = "order_id", seq_col: str = "prefix",
                  group: list[str] | None = None) -> DataFrame:
    """J4 (long form): (key, pos, n_pos, tags) for every position of the
    sequence, looking the item's tags up by a (size-checked) broadcast join.
    ``pos`` is 0-based. ``group`` columns (e.g. a config id) are part of both
    the sequence key and the tag lookup. An item without tags keeps its position
    with an empty list; of several tag lists of a product the smallest counts."""
    g = list(group or [])
    tags = tags.groupBy(*g, "pid").agg(F.min("tags").alias("tags"))
    ex = seqs.select(*g, key, F.size(seq_col).alias("n_pos"), F.posexplode(seq_col).alias("pos", "pid"))
    found = F.coalesce("tags", F.array().cast("array<string>")).alias("tags")
    return ex.join(tags.select(*g, "pid", "tags"), g + ["pid"], "left").select(*g, key, "pos", "n_pos", "pid", found)


def seq_tag_lookup(seqs: DataFrame, tags: DataFrame, key: str = "order_id", seq_col: str = "prefix") -> DataFrame:
    """J4 (array form): the list of tag lists, in sequence order."""
    long = seq_tags_long(seqs, tags, key, seq_col)
    agg = long.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "tags"))).alias("_t"))
    return agg.select(key, F.col("_t.tags").alias("seq_tags"))


def _term_counts(long: DataFrame, key: list[str], bow: Callable[[Column], Column] | None) -> DataFrame:
    terms = bow(F.col("tags")) if bow is not None else F.col("tags")
    ex = long.select(*key, "pos", "n_pos", F.explode(terms).alias("term"))
    return ex.groupBy(*key, "pos", "term").agg(F.any_value("n_pos").alias("n_pos"), F.count(F.lit(1)).alias("cnt"))


def build_query(
    seqs: DataFrame, tags: DataFrame, query_fn: str = "union", key: str = "order_id", seq_col: str = "prefix",
    bow: Callable[[Column], Column] | None = None, group: list[str] | None = None,
) -> DataFrame:
    """Multiset query (key, term, qty) from the tags of a sequence.

    union        max count of the term over positions
    intersection min count over ALL positions (absent counts 0)
    sum, concat  total count
    last         the tags of the last position, raw multiplicity
    recency      count weighted by 1-based position (later loads weigh more)
    """
    ks = list(group or []) + [key]
    long = seq_tags_long(seqs, tags, key, seq_col, group)
    cnt = _term_counts(long, ks, bow)
    g = cnt.groupBy(*ks, "term")
    if query_fn == "union":
        q = g.agg(F.max("cnt").alias("qty"))
    elif query_fn in ("sum", "concat"):
        q = g.agg(F.sum("cnt").alias("qty"))
    elif query_fn == "intersection":
        q = g.agg(F.min("cnt").alias("qty"), F.count(F.lit(1)).alias("_seen"), F.any_value("n_pos").alias("_n"))
        q = q.where(F.col("_seen") == F.col("_n")).drop("_seen", "_n")
    elif query_fn == "recency":
        q = g.agg(F.sum(F.col("cnt") * (F.col("pos") + 1)).alias("qty"))
    elif query_fn == "last":
        q = cnt.where(F.col("pos") == F.col("n_pos") - 1).select(*ks, "term", F.col("cnt").alias("qty"))
    else:
        raise ValueError(f"unknown query_fn {query_fn!r}")
    return q.select(*ks, "term", F.col("qty").cast("bigint").alias("qty"))


def _quantities(cnt: Column, query_fns: Sequence[str]) -> list[Column]:
    """Per query function the quantity of a term from its counts ``cnt`` at the positions of a sequence (null: not there)."""
    qty = {
        "union": F.max(cnt),
        "sum": F.sum(cnt),
        "concat": F.sum(cnt),
        "intersection": F.when(F.count(cnt) == F.any_value("n_pos"), F.min(cnt)),
        "recency": F.sum(cnt * (F.col("pos") + 1)),
        "last": F.sum(F.when(F.col("pos") == F.col("n_pos") - 1, cnt)),
    }
    unknown = [f for f in query_fns if f not in qty]
    if unknown:
        raise ValueError(f"unknown query_fn {unknown[0]!r}")
    return [qty[f].cast("bigint") for f in query_fns]


def build_queries(
    seqs: DataFrame, tags: DataFrame, query_fns: Sequence[str], key: str = "order_id", seq_col: str = "prefix",
    bow: Callable[[Column], Column] | None = None, group: list[str] | None = None, cells: Sequence[str] | None = None,
) -> DataFrame:
    """``build_query`` for several query functions on one pass over the sequences: one row (key, term) with a column
    of quantities by the name of each function, null where its query lacks the term.

    With ``cells`` (the values of a column ``cell`` of ``tags``) the sequences are not copied to the cells: a column
    holds an array, whose i-th quantity is that of the i-th cell."""
    if cells is not None:
        return _cell_queries(seqs, tags, query_fns, key, seq_col, bow, cells)
    ks = list(group or []) + [key]
    qty = _quantities(F.col("cnt"), query_fns)
    counts = _term_counts(seq_tags_long(seqs, tags, key, seq_col, group), ks, bow)
    return counts.groupBy(*ks, "term").agg(*[q.alias(f) for q, f in zip(qty, query_fns)])


def _cell_queries(seqs: DataFrame, tags: DataFrame, query_fns: Sequence[str], key: str, seq_col: str, bow: Callable[[Column], Column] | None, cells: Sequence[str]) -> DataFrame:
    at = range(len(cells))
    lists = tags.groupBy("cell", "pid").agg(F.min("tags").alias("tags"))
    terms = lists.select("cell", "pid", F.explode(bow(F.col("tags")) if bow is not None else "tags").alias("term")).where("pid IS NOT NULL AND term IS NOT NULL")
    counted = terms.groupBy("cell", "pid", "term").agg(F.count(F.lit(1)).alias("n"))
    counted = cell_arrays(counted, ["pid", "term"], "n", cells)
    places = seqs.select(key, F.size(seq_col).alias("n_pos"), F.posexplode(seq_col).alias("pos", "pid"))
    ex = join_lists(places, counted, ["pid"], ["term", "n"])
    per = ex.groupBy(key, "pos", "term").agg(F.any_value("n_pos").alias("n_pos"), *[F.sum(F.get("n", F.lit(i))).alias(f"_c{i}") for i in at])
    qty = [_quantities(F.col(f"_c{i}"), query_fns) for i in at]
    return per.groupBy(key, "term").agg(*[F.array(*[qty[i][j] for i in at]).alias(f) for j, f in enumerate(query_fns)])


def cell_arrays(rows: DataFrame, by: Sequence[str], value: str, cells: Sequence[str]) -> DataFrame:
    """One row for each value of ``by``, with an array of ``value``: its i-th entry is that of the i-th cell, or null."""
    return rows.groupBy(*by).agg(F.array(*[F.max(F.when(F.col("cell") == c, F.col(value))) for c in cells]).alias(value))


def join_lists(rows: DataFrame, found: DataFrame, on: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``rows`` with ``columns`` of the rows of ``found`` that are equal in ``on``, an inner join through one list for each
    key. Whatever the planner takes ``rows`` for, it never broadcasts them, which would lose how they are partitioned."""
    lists = found.groupBy(*on).agg(F.collect_list(F.struct(*columns)).alias("_found"))
    none = F.array().cast(lists.schema["_found"].dataType)
    j = rows.join(lists, list(on), "left").select(*rows.columns, F.explode(F.coalesce("_found", none)).alias("_f"))
    return j.select(*rows.columns, *[F.col(f"_f.{c}") for c in columns])


def custom_query(seqs: DataFrame, tags: DataFrame, fn: Callable[[Column], Column], key: str = "order_id", seq_col: str = "prefix") -> DataFrame:
    """H1: caller-supplied query builder ``ARRAY<ARRAY<STRING>> -> ARRAY<STRING>``
    as a Column function over the ordered list of tag lists."""
    lists = seq_tag_lookup(seqs, tags, key, seq_col)
    ex = lists.select(key, F.explode(fn(F.col("seq_tags"))).alias("term"))
    return ex.groupBy(key, "term").agg(F.count(F.lit(1)).cast("bigint").alias("qty"))

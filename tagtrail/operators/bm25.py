"""BM25 as four relational tables (an inverted index) and a join.

postings(term, doc_id, tf, w)  -- w = idf * tf*(k1+1) / (tf + k1*(1-b+b*dl/avgdl))
terms(term, df, idf)           -- only terms with idf > alpha (strict)
docs(doc_id, dl)
stats(n_docs, avgdl, n_terms, avg_idf, idf_warning)

Scoring a query multiset (key, term, qty) is an equi-join on term and a sum
per (key, doc): sum(qty * w). The IDF cutoff drops frequent terms before the
join, which also bounds the size of the hottest posting lists.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..session import cut_lineage
from .tagquery import cell_arrays, join_lists

BLOCKS = 16  # blocks of a long posting list
BLOCK_POSTINGS = 256  # a list up to this length is one block
HOT_POSTINGS = 1 << 16  # postings of a term that one join key may hold
HOT_TERMS = 4096  # at most so many terms are salted: each has more than 1 / HOT_TERMS of all postings
SLACK = 1e-6  # thresholds are lowered by it: sums in another order must not lose a tie
SCORE_DIGITS = 9  # scores are rounded so float summation order cannot reorder ties


@dataclass
class BM25Index:
    postings: DataFrame
    terms: DataFrame
    docs: DataFrame
    stats: DataFrame
    k1: float
    b: float
    alpha: float
    group: list[str]
    buckets: int | None = None  # the postings come hash partitioned by term into so many


def _stats_join(df: DataFrame, stats: DataFrame, g: list[str]) -> DataFrame:
    # without groups the stats are one row: broadcast; with groups (a config
    # grid) one row per group, joined on the group key
    return df.crossJoin(F.broadcast(stats)) if not g else df.join(F.broadcast(stats), g)


def _term_runs(corpus: DataFrame, g: list[str], doc_col: str, tokens_col: str) -> DataFrame:
    """(*g, doc_id, dl, term, tf): the distinct terms of every row of ``corpus`` with their counts, and one row without
    a term. Counted inside the row, as runs of its sorted tokens, so no token is shuffled."""
    rows = corpus.select(*g, F.col(doc_col).alias("doc_id"), F.size(tokens_col).alias("dl"), F.coalesce(F.array_sort(F.filter(tokens_col, lambda t: t.isNotNull())), F.array()).alias("_s"))
    rows = rows.select("*", F.expr("filter(sequence(1, size(_s) + 1), i -> i <= size(_s) AND (i = 1 OR get(_s, i - 1) <> get(_s, i - 2)))").alias("_at"))
    runs = F.expr("transform(_at, (p, j) -> named_struct('term', get(_s, p - 1), 'tf', cast(coalesce(get(_at, j + 1), size(_s) + 1) - p as bigint)))")
    length = F.expr("array(named_struct('term', cast(null as string), 'tf', cast(null as bigint)))")
    return rows.select(*g, "doc_id", "dl", F.explode(F.concat(runs, length)).alias("_t")).select(*g, "doc_id", "dl", "_t.term", "_t.tf")


def build_index(corpus: DataFrame, doc_col: str = "doc_id", tokens_col: str = "tokens",
                k1: float = C.BM25_K1, b: float = C.BM25_B, alpha: float = C.BM25_ALPHA,
                group: list[str] | None = None, only: DataFrame | None = None, buckets: int | None = None) -> BM25Index:
    """R1 + R2 + R3. ``group`` builds one independent index per group value
    (e.g. per configuration of an evaluation grid) in the same job. ``only``
    (term) keeps the postings of a query's terms: weights are those of the whole
    index, the other terms are dropped before anything is counted or shuffled
    (``n_terms`` and ``avg_idf`` then speak of these terms alone).

    Terms are counted inside each row of the corpus; rows that share a doc_id
    (and only they) are added up by a shuffle. The postings are shuffled once,
    by term, after the few terms below the cutoff are dropped; with ``buckets``
    into so many partitions, which ``save_index`` writes as they are."""
    g = list(group or [])
    spread = _term_runs(corpus, g, doc_col, tokens_col)
    if only is not None:
        spread = spread.join(only.select("term", F.lit(True).alias("_in")).distinct(), "term", "left").where("_in OR term IS NULL").select(*g, "doc_id", "dl", "term", "tf")
    counts = cut_lineage(spread, "bm25-counts")
    lengths = counts.where("term IS NULL").groupBy(*g, "doc_id").agg(F.max("dl").alias("dl"), F.count(F.lit(1)).alias("_rows"))
    lengths = cut_lineage(lengths, "bm25-docs")
    tf, docs = counts.where("term IS NOT NULL"), lengths.drop("_rows")
    repeated = lengths.where("_rows > 1")
    if not repeated.isEmpty():
        # a struct is equal to itself with a null in it, too
        ids = cut_lineage(repeated.select(F.struct(*g, "doc_id").alias("_id"), "dl"), "bm25-repeated")
        tf = tf.withColumn("_id", F.struct(*g, "doc_id"))
        added = tf.drop("dl").join(ids, "_id").groupBy(*g, "term", "doc_id").agg(F.sum("tf").alias("tf"), F.max("dl").alias("dl"))
        tf = tf.join(ids, "_id", "left_anti").drop("_id").unionByName(added)
    corpus_stats = docs.groupBy(*g).agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))
    df = tf.groupBy(*g, "term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    vocabulary = cut_lineage(_stats_join(df, corpus_stats, g).select(*g, "term", "df", idf.alias("idf")), "bm25-vocabulary")
    kept = F.col("idf") > F.lit(alpha)
    terms = vocabulary.where(kept)
    # each is in a fixed share of the documents, so they are few: written, the planner sees how few
    frequent = cut_lineage(vocabulary.where(~F.coalesce(kept, F.lit(False))).select(*g, "term"), "bm25-frequent")
    rows = tf.where("doc_id IS NOT NULL").join(frequent, g + ["term"], "left_anti")
    if buckets:
        rows = rows.repartition(buckets, "term")
    rows = _stats_join(rows.join(terms, g + ["term"]), corpus_stats.select(*g, "avgdl"), g)
    w = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    postings = rows.select(*g, "term", "doc_id", "tf", w.alias("w"))
    term_stats = terms.groupBy(*g).agg(F.count(F.lit(1)).alias("n_terms"), F.avg("idf").alias("avg_idf"))
    stats = (corpus_stats.crossJoin(term_stats) if not g else corpus_stats.join(term_stats, g, "left")).select(
        *g, "n_docs", "avgdl", F.coalesce("n_terms", F.lit(0)).alias("n_terms"), "avg_idf",
        # the reference warns when the average idf is negative (and divides
        # by zero when no term survives); here: NULL-safe flag
        F.coalesce(F.col("avg_idf") < 0, F.lit(False)).alias("idf_warning"),
    )
    return BM25Index(postings, terms, docs, stats, k1, b, alpha, g, buckets)


def salted_terms(index: BM25Index, hot: int = HOT_POSTINGS) -> DataFrame:
    """Terms of more than ``hot`` postings and more than 1 / HOT_TERMS of all, so
    at most HOT_TERMS rows, with the number of salts ``_n`` that brings each salt
    down to the larger of the two."""
    terms = index.terms
    if terms is None:  # postings alone
        terms = index.postings.groupBy(*index.group, "term").agg(F.count(F.lit(1)).alias("df"))
    total = terms.agg(F.sum("df").alias("_all"))
    d = terms.crossJoin(F.broadcast(total)).withColumn("_most", F.greatest(F.lit(hot), F.col("_all") / HOT_TERMS))
    return d.where(F.col("df") > F.col("_most")).select(*index.group, "term", F.ceil(F.col("df") / F.col("_most")).cast("int").alias("_n"))


def salted_postings(index: BM25Index, terms: DataFrame) -> DataFrame:
    """Postings with the salt ``_salt`` of their document, 0 for a term that is not hot."""
    d = index.postings.select(*index.group, "term", "doc_id", "w").join(F.broadcast(terms), index.group + ["term"], "left")
    return d.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.coalesce("_n", F.lit(1))).cast("int")).drop("_n")


def score(index: BM25Index, query: DataFrame, key: str = "order_id", doc_alias: str = "doc_id", hot: int = HOT_POSTINGS,
          qty: Sequence[str] = ("qty",), into: Sequence[str] = ("score",), cells: int | None = None) -> DataFrame:
    """(key, doc, score) for every document sharing a term with the query;
    query terms count with multiplicity. Postings of a hot term are spread over
    salts and its query rows copied to each, whatever the planner's skew settings.
    Several columns ``qty`` of quantities are scored in one join, each ``into``
    its column, null where that query shares no term with the document. With
    ``cells`` quantities, weights (see ``in_cells``) and scores are arrays of so
    many, an entry for each index of a grid; these scores are not rounded yet."""
    g = index.group
    terms = cut_lineage(salted_terms(index, hot), "bm25-hot")
    asked, postings, on = query.select(*g, key, "term", *qty), index.postings.select(*g, "term", "doc_id", "w"), [*g, "term"]
    if not terms.isEmpty():
        asked = asked.join(F.broadcast(terms), on, "left")
        asked = asked.select(*g, key, "term", *qty, F.explode(F.sequence(F.lit(0), F.coalesce("_n", F.lit(1)) - 1)).alias("_salt"))
        postings, on = salted_postings(index, terms), [*on, "_salt"]
    j = asked.join(postings, on) if cells is None else join_lists(asked, postings, on, ["doc_id", "w"])

    def scores(q: str) -> Column:
        if cells is None:
            return F.round(F.sum(F.col(q) * F.col("w")), SCORE_DIGITS)
        return F.array(*[F.sum(F.get(q, F.lit(i)) * F.get("w", F.lit(i))) for i in range(cells)])

    s = j.groupBy(*g, key, "doc_id").agg(*[scores(q).alias(i) for q, i in zip(qty, into, strict=True)])
    return s.withColumnRenamed("doc_id", doc_alias)


def in_cells(index: BM25Index, cells: Sequence[str]) -> BM25Index:
    """The postings of an index with ``cell`` as its group as one index whose weights are arrays, an entry for each cell
    (null where a cell's index lacks the posting). It scores alone: it has no terms, documents or stats."""
    return BM25Index(cell_arrays(index.postings, ["term", "doc_id"], "w", cells), *(None,) * 3, index.k1, index.b, index.alpha, [])


def top_n(scores: DataFrame, n: int = 5, key: str = "query_id", doc_col: str = "doc_id") -> DataFrame:
    """Best n documents per query (score desc, then doc id)."""
    w = Window.partitionBy(key).orderBy(F.col("score").desc(), F.col(doc_col))
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def posting_blocks(index: BM25Index, block: int = BLOCK_POSTINGS) -> DataFrame:
    """Postings in blocks of falling weight: term, doc_id, w, block (0 holds the heaviest), bound (largest weight of the
    block), top (of the term). A term's blocks are cut by ranges of weight that hold about ``block`` postings each,
    taken from its exact percentiles' histogram, so no task orders a whole posting list."""
    cuts = index.postings.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.max("w").alias("top"), F.percentile_approx("w", F.array(*[F.lit(p / BLOCKS) for p in range(1, BLOCKS)]), F.lit(1000)).alias("cuts"))
    cuts = cuts.withColumn("cuts", F.when(F.col("n") > block, F.col("cuts")).otherwise(F.array().cast("array<double>")))
    rows = index.postings.select("term", "doc_id", "w").join(cuts.drop("n"), "term")
    above = F.size(F.filter("cuts", lambda c: c > F.col("w")))  # cuts heavier than the posting: its block
    rows = rows.withColumn("block", above)
    bounds = rows.groupBy("term", "block").agg(F.max("w").alias("bound"))
    return rows.join(bounds, ["term", "block"]).select("term", "doc_id", "w", "block", "bound", "top")


def search(index: BM25Index, query: DataFrame, n: int = 5, key: str = "query_id", block: int = BLOCK_POSTINGS) -> DataFrame:
    """T2 without scoring every match: the best ``n`` documents per query, equal to ``top_n(score(...))``.

    1. The heaviest block of every query term gives partial scores; the n-th of
       a query is a threshold that its n-th document reaches.
    2. A block is skipped where its bound and the tops of all other terms stay
       below the threshold; terms whose tops together stay below it are skipped
       whole. A document in skipped blocks only cannot be among the best.
    3. The documents that are left are looked up by (term, document) and scored.

    Weights are not negative (alpha >= 0); otherwise everything is scored."""
    if index.alpha < 0 or index.group:
        return top_n(score(index, query, key), n, key)
    small = cut_lineage(query.select(key, "term", "qty"), "bm25-query")
    wanted = cut_lineage(index.postings.join(small.select("term").distinct(), "term", "left_semi").select("term", "doc_id", "w"), "bm25-wanted")
    blocks = cut_lineage(posting_blocks(BM25Index(wanted, *(None,) * 3, index.k1, index.b, index.alpha, []), block), "bm25-blocks")
    tops = blocks.groupBy("term").agg(F.max("top").alias("top"))
    terms = small.join(tops, "term").withColumn("most", F.col("qty") * F.col("top"))
    seeds = small.join(blocks.where("block = 0"), "term").groupBy(key, "doc_id").agg(F.sum(F.col("qty") * F.col("w")).alias("part"))
    floor = top_n(seeds.withColumnRenamed("part", "score"), n, key).where(F.col("rank") == n).select(key, (F.col("score") - SLACK).alias("floor"))
    by_top = Window.partitionBy(key).orderBy("most", "term")
    sized = terms.join(floor, key, "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)))
    sized = sized.withColumn("upto", F.sum("most").over(by_top)).withColumn("rest", F.sum("most").over(Window.partitionBy(key)) - F.col("most"))
    sized = cut_lineage(sized, "bm25-terms")
    reach = sized.where("upto >= floor").join(blocks, "term").where("qty * bound + rest >= floor")
    docs = cut_lineage(reach.select(key, "doc_id").distinct(), "bm25-candidates")
    asked = docs.join(small, key)
    scored = asked.join(blocks.select("term", "doc_id", "w"), ["term", "doc_id"])
    scores = scored.groupBy(key, "doc_id").agg(F.round(F.sum(F.col("qty") * F.col("w")), SCORE_DIGITS).alias("score"))
    return top_n(scores, n, key)


def save_index(index: BM25Index, path: str, buckets: int | None = None) -> None:
    """Persist the four tables and the parameters as Parquet; the postings in buckets by term, sorted, so that
    reading them back by term needs no shuffle."""
    spark = index.postings.sparkSession
    buckets = buckets or index.buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    _forget(spark, path)
    dealt = index.postings if buckets == index.buckets else index.postings.repartition(buckets, "term")
    dealt.write.mode("overwrite").bucketBy(buckets, "term").sortBy("term").option("path", path + "/postings").saveAsTable(_bucket_name(path))
    index.terms.write.mode("overwrite").parquet(path + "/terms")
    index.docs.write.mode("overwrite").parquet(path + "/docs")
    index.stats.write.mode("overwrite").parquet(path + "/stats")
    params = [(float(index.k1), float(index.b), float(index.alpha), index.group, buckets)]
    spark.createDataFrame(params, "k1 double, b double, alpha double, group array<string>, buckets int").write.mode("overwrite").parquet(path + "/params")


def _bucket_name(path: str) -> str:
    return "bm25_postings_" + hashlib.md5(path.encode()).hexdigest()


def _forget(spark, path: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {_bucket_name(path)}")  # an external table: its files stay


def load_index(spark, path: str) -> BM25Index:
    """The index saved at ``path``, with the parameters its weights were made with."""
    r = spark.read
    p = r.parquet(path + "/params").first()  # one row
    _forget(spark, path)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in r.parquet(path + "/postings").schema)
    where = f"USING parquet CLUSTERED BY (term) SORTED BY (term) INTO {p.buckets} BUCKETS LOCATION '{path}/postings'"
    spark.sql(f"CREATE TABLE {_bucket_name(path)} ({columns}) {where}")  # the session's catalogue learns the buckets
    return BM25Index(spark.table(_bucket_name(path)), r.parquet(path + "/terms"), r.parquet(path + "/docs"),
                     r.parquet(path + "/stats"), p.k1, p.b, p.alpha, list(p.group))


def iou_score(query: DataFrame, corpus: DataFrame, key: str = "order_id", doc_col: str = "pid", tokens_col: str = "tags") -> DataFrame:
    """Jaccard of the query's term SET and each document's term set,
    through an inverted index: only pairs sharing a term are generated;
    |Q u D| = |Q| + |D| - |Q n D|."""
    d = corpus.select(F.col(doc_col).alias("_doc"), F.explode(F.array_distinct(tokens_col)).alias("term"))
    dsize = d.groupBy("_doc").agg(F.count(F.lit(1)).alias("_nd"))
    q = query.select(key, "term").distinct()
    qsize = q.groupBy(key).agg(F.count(F.lit(1)).alias("_nq"))
    inter = q.join(d, "term").groupBy(key, "_doc").agg(F.count(F.lit(1)).alias("_ni"))
    s = inter.join(qsize, key).join(dsize, "_doc")
    return s.select(
        key, F.col("_doc").alias(doc_col),
        F.round(F.col("_ni") / (F.col("_nq") + F.col("_nd") - F.col("_ni")), SCORE_DIGITS).alias("score"),
    )

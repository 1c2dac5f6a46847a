"""T2 by pruned search, R5 as buckets, against scoring everything."""

import random

import pytest
from pyspark.sql import functions as F

from tagtrail.operators import bm25


def _corpus(spark, seed, docs=600):
    """Zipf words; every query's words stand together in some documents."""
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.6)) % 3000}" for _ in range(40_000)]
    rows = [(i, [rng.choice(words) for _ in range(rng.randint(1, 60))]) for i in range(docs)]
    queries = {}
    for q in range(12):
        queries[q] = [rng.choice(words) for _ in range(rng.randint(1, 15))]
        for i in rng.sample(range(docs), 7):
            rows[i] = (i, rows[i][1] + queries[q][: rng.randint(1, 15)])
    queries[12] = ["nowhere"]
    terms = spark.createDataFrame([(q, t) for q, ts in queries.items() for t in ts], "query_id long, term string").groupBy("query_id", "term").agg(F.count("*").alias("qty"))
    return spark.createDataFrame(rows, "doc_id long, tokens array<string>").repartition(3), terms


def _rows(df):
    return sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 6)) for r in df.collect())


@pytest.mark.parametrize("n, block, alpha", [(5, 8, 0.0), (1, 4, 1.0), (3, 10_000, 0.0), (50, 16, 0.0), (5, 8, -20.0)])
def test_search_equals_scoring_everything(spark, n, block, alpha):
    corpus, terms = _corpus(spark, n)
    idx = bm25.build_index(corpus, alpha=alpha)
    want = _rows(bm25.top_n(bm25.score(idx, terms, "query_id"), n))
    assert want and _rows(bm25.search(idx, terms, n, block=block)) == want
    assert _rows(bm25.search(bm25.build_index(corpus, alpha=alpha, only=terms), terms, n, block=block)) == want


def test_search_reads_a_small_part_of_the_postings(spark, monkeypatch):
    rows = [(i, ["common"] * (1 + i % 3) + [f"w{i % 700}"] + (["rare", "pair"] if i % 400 == 0 else [])) for i in range(4000)] + [(9000 + i, [f"x{i}"]) for i in range(9000)]
    idx = bm25.build_index(spark.createDataFrame(rows, "doc_id long, tokens array<string>"), alpha=0.0)
    terms = spark.createDataFrame([(1, "common", 1), (1, "rare", 1), (1, "pair", 1)], "query_id long, term string, qty long")
    made, real = {}, bm25.cut_lineage

    def kept(df, name):
        made[name] = real(df, name)
        return made[name]

    monkeypatch.setattr(bm25, "cut_lineage", kept)
    assert _rows(bm25.search(idx, terms, 5, block=64)) == _rows(bm25.top_n(bm25.score(idx, terms, "query_id"), 5))
    everything = made["bm25-blocks"].count()
    assert everything > 4000 and made["bm25-candidates"].count() < everything / 50


def test_search_of_nothing(spark):
    corpus, terms = _corpus(spark, 3, 20)
    idx = bm25.build_index(corpus, alpha=0.0)
    assert bm25.search(idx, terms.limit(0)).count() == 0
    assert bm25.search(bm25.build_index(corpus.limit(0), alpha=0.0), terms).count() == 0


def test_saved_postings_are_read_by_term_without_a_shuffle(spark, tmp_path):
    corpus, terms = _corpus(spark, 4)
    idx = bm25.build_index(corpus, alpha=0.5)
    path = str(tmp_path / "index")
    bm25.save_index(idx, path, buckets=5)
    back = bm25.load_index(spark, path)
    assert (back.k1, back.b, back.alpha, back.group) == (idx.k1, idx.b, idx.alpha, [])
    assert back.postings.exceptAll(idx.postings).count() == 0 and back.postings.count() == idx.postings.count()
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        plan = terms.join(back.postings, "term")._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    lines = plan.splitlines()
    at = next(i for i, x in enumerate(lines) if "FileScan" in x and "bm25_postings" in x)
    assert "Bucketed: true" in lines[at]
    depth = lambda x: len(x) - len(x.lstrip(" :+-*|"))
    above, level = [], depth(lines[at])
    for x in reversed(lines[:at]):  # the operators over the scan, up to the join
        if depth(x) < level:
            level = depth(x)
            above.append(x)
        if "Join" in x:
            break
    assert not any("Exchange" in x for x in above), above
    want = _rows(bm25.top_n(bm25.score(idx, terms, "query_id"), 5))
    assert _rows(bm25.top_n(bm25.score(back, terms, "query_id"), 5)) == want == _rows(bm25.search(back, terms, 5, block=8))
    bm25.save_index(bm25.build_index(corpus.limit(10), alpha=0.5), path)  # written over
    assert bm25.load_index(spark, path).docs.count() == 10


def test_hot_term_is_spread_over_salts(spark):
    """One term in 80 % of the documents: no join key holds more than ``hot`` postings by much, and scores stay equal."""
    corpus = spark.range(5000).select(F.col("id").alias("doc_id"), F.expr(
        "array(if(id % 5 < 4, 'hot', 'cold'), concat('t', id % 50), 'x')").alias("tokens"))
    index = bm25.build_index(corpus, alpha=-100.0)
    query = spark.createDataFrame([(1, "hot", 2), (1, "t7", 1), (2, "hot", 1), (3, "cold", 1), (3, "none", 1)], "order_id long, term string, qty long")
    plain = index.postings.join(query, "term").groupBy("order_id", "doc_id").agg(F.round(F.sum(F.col("qty") * F.col("w")), 9).alias("score"))
    got = bm25.score(index, query, hot=500)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))
    terms = bm25.salted_terms(index, 500)
    assert {r.term: r._n for r in terms.collect()} == {"hot": 8, "cold": 2, "x": 10}
    sizes = bm25.salted_postings(index, terms).groupBy("term", "_salt").count()
    assert sizes.agg(F.max("count")).first()[0] < 1.25 * 500
    assert bm25.salted_terms(index).count() == 0  # nothing is hot at the default


def test_index_of_repeated_and_null_documents(spark):
    """Rows of one doc_id are one document, of null doc_ids one that is counted and has no postings."""
    rows = [(1, ["a", "b", "a", None]), (1, ["a", "b", "a", None]), (2, ["b"]), (3, []), (4, None), (None, ["a"]), (None, ["a"])] + [(i, [f"w{i}", "b"]) for i in range(10, 30)]
    idx = bm25.build_index(spark.createDataFrame(rows, "doc_id long, tokens array<string>"), alpha=-100.0)
    assert {(r.term, r.doc_id): r.tf for r in idx.postings.collect()} == {("a", 1): 4, ("b", 1): 2, ("b", 2): 1} | {(t, i): 1 for i in range(10, 30) for t in (f"w{i}", "b")}
    assert {r.term: r.df for r in idx.terms.collect() if r.term in "ab"} == {"a": 2, "b": 22}
    assert idx.docs.count() == 25 and idx.stats.first().n_docs == 25


def test_postings_are_shuffled_once(spark, tmp_path):
    """Counting shuffles nothing of a posting; saving writes the partitions that the join left."""
    corpus, _ = _corpus(spark, 5)
    idx = bm25.build_index(corpus, alpha=0.5, buckets=6)
    plan = idx.postings._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 1 and "HashAggregate(keys=[term" not in plan
    bm25.save_index(idx, str(tmp_path / "index"))
    back = bm25.load_index(spark, str(tmp_path / "index"))
    files = back.postings.select(F.input_file_name().alias("f"), F.expr("pmod(hash(term), 6)").alias("b")).distinct().collect()
    assert len(files) == len({r.f for r in files}) == len({r.b for r in files}) == 6
    assert back.postings.exceptAll(bm25.build_index(corpus, alpha=0.5).postings).count() == 0

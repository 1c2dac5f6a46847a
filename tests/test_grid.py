"""The evaluation grid: one pass for all query functions, no copy of a sequence or score shuffled."""

import re

import pytest

from tagtrail.operators import bm25, metrics as M, tagquery
from tagtrail.plans import q_text

FNS = ("sum", "union", "last", "intersection", "recency")


def test_queries_of_one_pass_equal_single_queries(spark):
    tags = spark.createDataFrame([("a", 1, ["x", "x", "y"]), ("a", 2, ["y", "z"]), ("a", 3, []), ("b", 1, ["1", None, "x"]), ("b", 2, ["1"])], "cell string, pid long, tags array<string>")
    seqs = spark.createDataFrame([(c, o, p) for c in "ab" for o, p in [("1", [1, 2, 1]), ("2", [2]), ("3", [3, 9]), (None, [1, 1]), ("4", [])]], "cell string, order_id string, prefix array<long>")
    rows = tagquery.build_queries(seqs, tags, FNS, group=["cell"]).collect()
    for fn in FNS:
        want = {tuple(r) for r in tagquery.build_query(seqs, tags, fn, group=["cell"]).collect()}
        assert {(r.cell, r.order_id, r.term, r[fn]) for r in rows if r[fn] is not None} == want and want
    with pytest.raises(ValueError, match="nonsense"):
        tagquery.build_queries(seqs, tags, ["sum", "nonsense"])


def test_quantities_scored_together_equal_single_scores(spark):
    corpus = spark.createDataFrame([(i, [f"t{i % 7}", f"u{i % 5}", "v"]) for i in range(40)], "pid long, tags array<string>")
    index = bm25.build_index(corpus, "pid", "tags", alpha=-9.0)
    query = spark.createDataFrame([("1", "t1", 2, None), ("1", "u1", None, 1), ("2", "v", 1, 3), ("3", "none", 1, 1)], "order_id string, term string, a long, b long")
    for hot in (bm25.HOT_POSTINGS, 5):
        both = bm25.score(index, query, doc_alias="pid", hot=hot, qty=["a", "b"], into=["a", "b"]).collect()
        for q in "ab":
            one = bm25.score(index, query.where(f"{q} IS NOT NULL").withColumnRenamed(q, "qty"), doc_alias="pid", hot=hot).collect()
            assert {(r.order_id, r.pid, r[q]) for r in both if r[q] is not None} == {(r.order_id, r.pid, r.score) for r in one} and one


def test_configs_equal_single_metrics(spark):
    configs = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "cell string, n int")  # b has no score at all
    scores = [("a", n, f"{o}", p, float((o * 7 + p * 5 * n) % 11)) for n in (1, 2) for o in range(9) for p in range(30) if (o + p) % 4]
    frame = spark.createDataFrame(scores, "cell string, n int, order_id string, pid long, score double")
    truth = spark.createDataFrame([(f"{o}", None if o == 5 and d else o * 3 + d, None if o == 7 else "xy"[o % 2]) for o in range(12) for d in range(1 + o % 2)], "order_id string, pid long, split string")
    got = {(r.cell, r.n, r.split): tuple(r)[2:] for r in M.ranking_metrics(frame, truth, (1, 5), configs=configs).collect()}
    want = {}
    for cell, n in [("a", 1), ("a", 2), ("b", 1)]:
        for r in M.ranking_metrics(frame.where(f"cell = '{cell}' AND n = {n}").drop("cell", "n"), truth, (1, 5)).collect():
            want[(cell, n, r.split)] = tuple(r)
    assert got.keys() == want.keys() and len(got) == 9
    for k, row in want.items():
        assert got[k][:2] == row[:2] and got[k][2:] == pytest.approx(row[2:], abs=2e-6), k


def test_grid_shuffles_orders_before_their_copies(spark):
    out = q_text.q_eval_grid(spark, "/root/testdata/sf0.001")
    keys = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", out._jdf.queryExecution().executedPlan().toString())
    by_order = [k for k in keys if re.search(r"\border(_id)?#", k)]
    assert by_order and all(re.fullmatch(r"order#\d+, \d+", k) for k in by_order), keys
    assert out.count() == 3 * 21 * out.select("split").distinct().count()


def test_grid_partitions_grow_with_orders_and_documents(spark):
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert q_text.grid_partitions(spark, 0, 0) == least
    assert q_text.grid_partitions(spark, 100_000, 2000) == 400
    assert q_text.grid_partitions(spark, 10**9, 10**6) == q_text.GRID_PARTITIONS


def test_cells_in_arrays_equal_copies(spark):
    """Queries, scores and metrics with an array entry for each cell equal those of sequences copied to the cells."""
    cells = ["a", "b", "c"]
    tags = [(c, p, [f"t{(p * k + j) % 9}" for j in range(3 + (c == "b"))] + [str(p)] * n + ([None] if p == 3 else [])) for n, c in enumerate(cells) for k in (n + 1,) for p in range(12) if (p, c) != (5, "c")]
    tags = spark.createDataFrame(tags + [("a", 7, ["t1", "t1"]), ("c", 11, [])], "cell string, pid long, tags array<string>")
    seqs = [(str(i), [(i * 5 + j * 3) % 13 for j in range(1 + i % 4)]) for i in range(20)] + [("20", []), ("21", [2, None, 2]), ("1", [4, 4])]
    seqs = spark.createDataFrame(seqs, "order_id string, prefix array<long>")
    long = tagquery.build_queries(seqs.crossJoin(tags.select("cell").distinct()), tags, FNS, group=["cell"])
    wide = tagquery.build_queries(seqs, tags, FNS, cells=cells)
    once = "order_id <> '1'"  # two sequences of one order: any of their lengths counts
    want = {(r.cell, r.order_id, r.term, f): r[f] for r in long.where(once).collect() for f in FNS if r[f] is not None and r.term is not None}
    got = {(c, r.order_id, r.term, f): r[f][i] for r in wide.where(once).collect() for i, c in enumerate(cells) for f in FNS if r[f][i] is not None}
    assert got == want and len(want) > 500

    index = bm25.build_index(tags, "pid", "tags", alpha=-9.0, group=["cell"])
    for hot in (bm25.HOT_POSTINGS, 2):
        scored = bm25.score(index, long, doc_alias="pid", hot=hot, qty=FNS, into=FNS)
        arrays = bm25.score(bm25.in_cells(index, cells), wide, doc_alias="pid", hot=hot, qty=FNS, into=FNS, cells=3)
        want = {(r.cell, r.order_id, r.pid, f): r[f] for r in scored.where(once).collect() for f in FNS if r[f] is not None}
        got = {(c, r.order_id, r.pid, f): r[f][i] for r in arrays.where(once).collect() for i, c in enumerate(cells) for f in FNS if r[f][i] is not None}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in want) and want


def test_ranks_counted_in_cells_equal_sorted_ranks(spark):
    """Ties, scores that differ behind the rounded digits, several true products, missing scores."""
    score = lambda c, o, p: None if (o + p + c) % 5 == 0 else float((o * 7 + p * 5) % (3 + c)) + p * 1e-12
    rows = [(f"{o}", p, [score(c, o, p) for c in range(4)]) for o in range(9) for p in range(30)]
    wide = spark.createDataFrame(rows, "order_id string, pid long, scores array<double>")
    long = spark.createDataFrame([(c, o, p, round(s[c], 9)) for o, p, s in rows for c in range(4) if s[c] is not None], "n int, order_id string, pid long, score double")
    truth = spark.createDataFrame([(f"{o}", None if o == 5 and d else o * 3 + d, None if o == 7 else "xy"[o % 2]) for o in range(12) for d in range(1 + o % 3)], "order_id string, pid long, split string")
    configs = spark.createDataFrame([(c,) for c in range(4)], "n int")
    at = spark.createDataFrame([(c, c) for c in range(4)], "n int, at int")
    want = sorted(map(str, M.ranking_metrics(long, truth, (1, 5, 10), configs=configs).collect()))
    assert sorted(map(str, M.ranking_metrics(wide, truth, (1, 5, 10), configs=at).collect())) == want and len(want) == 12


def test_grid_copies_no_sequence_to_its_cells(spark):
    """Rows of orders are not multiplied by the 21 cells and sorted for each: no limited window over the scores."""
    plan = q_text.q_eval_grid(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" not in plan and not re.search(r"HashAggregate\(keys=\[cell#\d+, order#", plan)

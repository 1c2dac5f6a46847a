"""R9 hash fill: unscored products rank below every scored one, no
duplicates, exactly k - n_scored fill rows per short order."""

from tagtrail.operators import scoring


def test_hash_fill_invariants(spark):
    scores = spark.createDataFrame([(1, 10, 2.0), (1, 11, 1.0), (2, 12, 5.0)], "order_id long, pid long, score double")
    orders = spark.createDataFrame([(1,), (2,), (3,)], "order_id long")
    cat = spark.createDataFrame([(p,) for p in range(10, 30)], "pid long")
    k = 5
    out = scoring.hash_fill(scores, orders, cat, k, seed=1).collect()
    by = {}
    for r in out:
        by.setdefault(r.order_id, []).append((r.pid, r.score))
    for o, n_scored in ((1, 2), (2, 1), (3, 0)):
        rows = by.get(o, [])
        pids = [p for p, _ in rows]
        assert len(pids) == len(set(pids))
        assert len(rows) == max(k, n_scored)
        fills = [s for _, s in rows if s < 0]
        real = [s for _, s in rows if s >= 0]
        assert len(fills) == k - n_scored and all(f < min(real, default=0) for f in fills)


def test_fill_differs_by_order_and_ends_with_the_catalogue(spark):
    orders = spark.createDataFrame([(o,) for o in range(50)], "order_id long")
    none = spark.createDataFrame([], "order_id long, pid long, score double")
    rows = scoring.hash_fill(none, orders, spark.range(1000).withColumnRenamed("id", "pid"), 20, seed=5).collect()
    lists = {}
    for r in sorted(rows, key=lambda r: -r.score):
        lists.setdefault(r.order_id, []).append(r.pid)
    assert len({tuple(v) for v in lists.values()}) == 50 and all(len(set(v)) == 20 for v in lists.values())
    assert len({p for v in lists.values() for p in v}) > 500
    few = scoring.hash_fill(none, orders, spark.range(3).withColumnRenamed("id", "pid"), 20).collect()
    assert len(few) == 150 and len({(r.order_id, r.pid) for r in few}) == 150
    assert scoring.hash_fill(none, orders, spark.range(0).withColumnRenamed("id", "pid"), 20).count() == 0

"""Driver contract: entry runs, every oracle key is a registered query."""

import __spark_entry__ as E


def test_entry_smoke(spark):
    rows = E.entry(spark).collect()
    assert rows and {r.split for r in rows} <= {"train", "val", "test"}
    for r in rows:
        assert 0.0 <= r["hr@20"] <= 1.0 and 0.0 <= r["ndcg@20"] <= 1.0


def test_oracle_keys_are_queries():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 120


def test_splits_partition_orders(spark):
    from tagtrail.plans.prepare import prepare

    m = prepare(spark, E.SMOKE_DIR).merged
    assert m.count() == m.select("order_id").distinct().count()
    assert {r.split for r in m.select("split").distinct().collect()} <= {"train", "val", "test"}

"""Preparation: written steps, orders without their loads."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tagtrail.operators import clean, eda
from tagtrail.plans import prepare as P
from tagtrail.sources import fixtures as fx


def _tables(spark, path):
    kinds = ["view", "click", "purchase", "view", "error"]
    rows = [(i, datetime(2024, 1, 1) + timedelta(minutes=37 * (i % 700)), i % 9, kinds[i % 5], float(i), '{"k": %d}' % (i * 7 % 30)) for i in range(1, 2000)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{path}/events.parquet")
    parts = [(i, "red ring", "Brand#1", "LARGE", 40 + i % 8) for i in range(30)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{path}/part.parquet")


def test_prepared_tables_equal_the_plain_plan(spark, tmp_path, monkeypatch):
    sf = str(tmp_path)
    _tables(spark, sf)
    reads, real = [], fx.read_table
    monkeypatch.setattr(fx, "read_table", lambda s, d, name, *a: reads.append(name) or real(s, d, name, *a))
    made, cut = {}, P.cut_lineage
    monkeypatch.setattr(P, "cut_lineage", lambda df, name: made.setdefault(name, (df._jdf.queryExecution().optimizedPlan().toString(), cut(df, name)))[1])
    p = P.prepare(spark, sf)
    # each log is scanned by one job, once: everything later reads written tables
    scans = {name: plan.count("event_type") and sum("Relation" in x and "props" in x for x in plan.splitlines()) for name, (plan, _) in made.items() if name != "catalogue"}
    assert {n: k for n, k in scans.items() if k} == {"item_loads": 1, "cleaned_purchases": 1}
    plain = P.build(spark, sf)
    for got, want in ((p.merged, plain.merged), (p.orders, plain.orders), (p.cleaned, plain.cleaned), (p.purchases, plain.purchases), (p.loads, plain.loads)):
        want = want.select(*got.columns)
        assert got.count() == want.count() > 0 and got.exceptAll(want).count() == 0
    assert p.orders.drop("n_loads").exceptAll(p.merged.drop("loads", "loaded_pids")).count() == 0 and p.orders.count() == p.merged.count()
    assert sorted(map(tuple, eda.orders_per_user(p.orders).collect())) == sorted(map(tuple, eda.orders_per_user(p.merged).collect()))
    assert p.cleaned.exceptAll(clean.clean_loads(fx.loads_raw(spark, sf), P.C.FIXTURE_DOMAIN)).count() == 0

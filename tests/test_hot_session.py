"""W2, T1 and J1 with 80% of the loads in one session, against a plain loop."""

from pyspark.sql import functions as F

from tagtrail.operators import clean, orders as O

HOUR = 3_600_000_000


def _loads(spark):
    rows = []
    for i in range(1000):
        hot = i % 5 != 0
        user = 1 if hot else (None if i % 35 == 0 else i)
        ts = None if i % 97 == 0 else (i * 7919 % 40) * HOUR // 4 - 3 * HOUR
        path = None if i % 41 == 0 else f"/cheap_{i * 31 % 3}.html"
        rows.append((user, 7, ts, i, path, i * 31 % 3, "cheap", None, None))
    return spark.createDataFrame(rows, "uuid_ind long, session_id long, timestamp long, seq long, url_path string, item_id long, item_type string, main_cat long, sub_cat long").repartition(6)


def _in_order(rows):
    sessions = {}
    for r in sorted(rows, key=lambda r: (r.timestamp is not None, r.timestamp or 0, r.seq)):
        sessions.setdefault((r.uuid_ind, r.session_id), []).append(r)
    return sessions


def test_consecutive_duplicates_across_slices(spark):
    loads = _loads(spark)
    want = set()
    for rows in _in_order(loads.collect()).values():
        last = None
        for r in rows:
            if last is None or r.url_path is not None and r.url_path != last:
                want.add(r.seq)
            last = r.url_path
    got = clean.drop_consecutive_duplicates(loads)
    assert got.columns == loads.columns and sorted(r.seq for r in got.collect()) == sorted(want)


def test_positions_across_slices(spark):
    loads = _loads(spark)
    want = {r.seq: i for rows in _in_order(loads.collect()).values() for i, r in enumerate(rows, 1)}
    out = O.position_loads(loads)
    assert dict(out.dtypes)["pos"] == "int" and {r.seq: r.pos for r in out.collect()} == want
    # no window over rows of a whole session: the hot one lies in several slices
    assert clean.with_slice(loads).where("uuid_ind = 1").select("_slice").distinct().count() > 5
    assert O.position_loads(loads.limit(0)).count() == 0


def test_array_form_equals_long_form(spark):
    loads = O.position_loads(_loads(spark))
    orders = spark.createDataFrame([(o, 1, 7, (o % 9 - 2) * HOUR, o, [o % 3]) for o in range(30)] + [(99, 5, 8, HOUR, 99, [1])], "order_id long, uuid_ind long, session_id long, timestamp long, seq long, products array<long>")
    arrays = {r.order_id: [x.seq for x in r.loads] for r in O.attach_preceding_loads(orders, loads).collect()}
    long = {}
    for r in O.preceding_loads_long(orders, loads).orderBy("pos").collect():
        long.setdefault(r.order_id, []).append(r.seq)
    assert arrays == long and len(arrays) > 20 and 99 not in arrays


def test_hot_session_without_a_pair_of_order_and_load(spark):
    """100,000 loads and 10,000 orders of one session: no join between them, no task with more than a few slices."""
    loads = spark.range(0, 100_000, 1, 8).select(
        (F.col("id") % 1 + 1).alias("uuid_ind"), (F.col("id") % 1 + 7).alias("session_id"), (F.col("id") * HOUR / 50).cast("long").alias("timestamp"), F.col("id").alias("seq"),
        F.concat(F.lit("/cheap_"), F.col("id").cast("string")).alias("url_path"), F.col("id").alias("item_id"), F.lit("cheap").alias("item_type"), F.lit(1).alias("main_cat"), F.lit(2).alias("sub_cat"), (F.col("id") + 1).cast("int").alias("pos"))
    orders = spark.range(0, 10_000, 1, 4).select("id", (F.col("id") % 1 + 1).alias("uuid_ind"), (F.col("id") % 1 + 7).alias("session_id"), ((F.col("id") * 10 - 5) * HOUR / 50).cast("long").alias("timestamp")).withColumnRenamed("id", "order_id")
    out = O.asof_loads(orders, loads)
    assert {r.order_id: r.n_loads for r in out.collect()} == {o: 10 * o - 5 + 1 for o in range(1, 10_000)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "_slice" in plan
    assert out.limit(5).count() == 5 and O.asof_loads(orders.limit(0), loads).count() == 0 and O.asof_loads(orders, loads.limit(0)).count() == 0
    some = O.attach_preceding_loads(orders.where("order_id % 2500 = 1"), loads)
    assert {r.order_id: [x.seq for x in r.loads] for r in some.collect()} == {o: list(range(10 * o - 4)) for o in range(1, 10_000, 2500)}
    text = some._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text and "timestamp <=" not in text


def test_asof_ties_nulls_and_clashing_columns(spark):
    loads = _loads(spark)
    orders = spark.createDataFrame([(o, None if o == 4 else 1, 7, None if o == 3 else (o % 9 - 2) * HOUR, "x", 9) for o in range(30)], "order_id long, uuid_ind long, session_id long, timestamp long, n string, _n long")
    want = {}
    rows = loads.where("uuid_ind = 1 AND timestamp IS NOT NULL").collect()
    for o in orders.collect():
        k = sum(r.timestamp <= o.timestamp for r in rows) if o.timestamp is not None and o.uuid_ind else 0
        if k:
            want[o.order_id] = k
    got = O.asof_loads(orders, loads)
    assert got.columns == [*orders.columns, "n_loads"] and {r.order_id: r.n_loads for r in got.collect()} == want


def test_hot_term_is_split(spark):
    from tagtrail.operators import bm25

    conf = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        term = F.when(F.col("id") % 5 > 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("term")
        postings = spark.range(0, 20000, 1, 8).select(term, F.col("id").alias("doc_id"), F.lit(1.0).alias("w"))
        query = spark.createDataFrame([(o, "hot", 1) for o in range(3)] + [(9, "t5", 2)], "order_id long, term string, qty long")
        out = bm25.score(bm25.BM25Index(postings, None, None, None, 1.5, 0.75, 4.0, []), query)
        assert len(out.collect()) == 3 * 16000 + 1
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)

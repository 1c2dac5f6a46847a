"""Operators that once switched plans by size: one plan, one result."""

import pytest
from pyspark.sql import functions as F

from tagtrail.operators import orders as O
from tagtrail.operators import sft
from tagtrail.operators.indexing import dense_index


def test_dense_index_is_distributed_and_bigint(spark):
    df = spark.range(1000).select(F.col("id").alias("x"), (F.lit(999) - F.col("id")).alias("y")).repartition(7)
    out = dense_index(df, ["y"], "i")
    assert dict(out.dtypes)["i"] == "bigint" and out.columns == ["x", "y", "i"]
    assert all(r.i == r.y for r in out.collect())
    assert dense_index(df.limit(0), ["y"]).count() == 0


def test_catalogue_restrictions(spark):
    cat = spark.createDataFrame([("a",), ("b",), ("b",)], "pid string")
    df = spark.createDataFrame([(1, ["b", "c", "a"]), (2, ["c"]), (3, [])], "order_id long, products array<string>")
    assert [(r.order_id, r.products) for r in O.restrict_products(df, cat).collect()] == [(1, ["a", "b"])]
    loads = spark.createDataFrame([(1, [("b", 1), ("z", 2), ("a", 3), ("b", 4)]), (2, [("z", 1)])], "order_id long, loads array<struct<item_id:string,pos:int>>")
    got = O.restrict_loads_array(loads, cat).collect()
    assert [(r.order_id, r.loaded_pids, [x.pos for x in r.loads]) for r in got] == [(1, ["b", "a", "b"], [1, 3, 4])]


def test_too_few_names_raise(spark):
    orders = spark.createDataFrame([(u,) for u in range(8) for _ in range(3)], "uuid_ind long")
    names = spark.createDataFrame([(f"n{i}",) for i in range(6)], "name string")
    with pytest.raises(Exception, match="fewer names"):
        sft.assign_user_names(orders, names).collect()
    enough = spark.createDataFrame([(f"n{i}",) for i in range(8)], "name string")
    got = sft.assign_user_names(orders, enough).collect()
    assert len(got) == 8 and len({r.user_name for r in got}) == 8


def test_undecided_leaders_raise(spark):
    from tagtrail.operators import fuzzy

    tags = spark.createDataFrame([("canvas shoes",), ("canvas shoe",), ("canvas shoess",)], "tag string")
    with pytest.raises(RuntimeError, match="rounds"):
        fuzzy.canonical_tags(tags, max_rounds=0)


def test_rendering_keeps_every_row(spark):
    df = spark.createDataFrame([(1, [7, 8, 9]), (2, []), (3, None)], "order_id long, seq array<long>")
    tags = spark.createDataFrame([(7, ["a", "b"]), (8, ["c"]), (8, ["d"])], "pid long, tags array<string>")
    got = {r.order_id: r.lines for r in sft.render_lines(df, tags, "seq", ["order_id"]).collect()}
    assert got == {1: ["1. a, b", "2. c", None], 2: [], 3: None}


def test_unknown_tokens_raise_or_take_the_id(spark):
    rec = spark.createDataFrame([(1, "", "one", "two three")], "order_id long, instruction string, input string, output string")
    vocab = spark.createDataFrame([("two", 5)], "token string, id long")
    row = sft.token_labels(rec, ["order_id"], "system", vocab, unknown_id=9).first()
    end = row.input_ids.index(sft.EOS)
    assert row.input_ids[end - 2:end] == [5, 9] and row.labels[end - 2:end] == [5, 9] and row.labels[end - 3] == -100
    with pytest.raises(Exception, match="not in the vocabulary"):
        sft.token_labels(rec, ["order_id"], "system", vocab).collect()

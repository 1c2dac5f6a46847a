"""Dataset modes, the saved index's parameters and the fill of the evaluator."""

import pytest
from pyspark.sql import functions as F

from tagtrail.operators import bm25, metrics as M, sft
from tagtrail.plans import tag_eval as TE

ORDERS = [(1, 7, [1, 2], [3, 4]), (2, 8, [2], [1])]


def _orders(spark):
    return spark.createDataFrame(ORDERS, "order_id long, uuid_ind long, loaded_pids array<long>, products array<long>")


def _tags(spark):
    return spark.createDataFrame([(i, [f"t{i}", f"u{i}"]) for i in range(1, 5)], "pid long, tags array<string>")


def test_dataset_modes(spark):
    names = spark.createDataFrame([(7, "Ann"), (8, "Bo")], "uuid_ind long, user_name string")
    loaded = sft.dataset(_orders(spark), _tags(spark), "loaded").collect()
    assert [(r.order_id, r.instruction, r.input, r.output, r.shuffle_rank) for r in loaded] == [(1, "", "1. t1, u1\n2.", "t2, u2", 0)]
    expanded = {(r.order_id, r.product): r for r in sft.dataset(_orders(spark), _tags(spark), "expanded", names).collect()}
    assert set(expanded) == {(1, 3), (1, 4), (2, 1)} and expanded[(2, 1)].input == "1. t2, u2\n2." and expanded[(2, 1)].output == "t1, u1"
    assert expanded[(1, 3)].instruction == "User: Ann" and sorted(r.shuffle_rank for r in expanded.values()) == [0, 1, 2]
    both = {r.order_id: r for r in sft.dataset(_orders(spark), _tags(spark), "concatenated", names, n_tags=1).collect()}
    assert both[1].input == "1. t1\n2." and both[1].output in ("t2\n3. t3\n4. t4", "t2\n3. t4\n4. t3") and both[2].output == "t1"
    with pytest.raises(ValueError, match="unknown mode"):
        sft.dataset(_orders(spark), _tags(spark), "other")
    assert sft.dataset(_orders(spark).limit(0), _tags(spark), "expanded").count() == 0


def test_missing_user_name_is_an_error(spark):
    names = spark.createDataFrame([(7, "Ann")], "uuid_ind long, user_name string")
    with pytest.raises(Exception, match="no name for user 8"):
        sft.dataset(_orders(spark), _tags(spark), "expanded", names).collect()


def test_saved_index_keeps_its_parameters(spark, tmp_path):
    docs = spark.createDataFrame([(i, g, ["a", f"w{i}"]) for g in ("x", "y") for i in range(6)], "doc_id long, g string, tokens array<string>")
    index = bm25.build_index(docs, k1=0.5, b=0.25, alpha=-9.0, group=["g"])
    bm25.save_index(index, str(tmp_path / "i"))
    back = bm25.load_index(spark, str(tmp_path / "i"))
    assert (back.k1, back.b, back.alpha, back.group) == (0.5, 0.25, -9.0, ["g"])
    query = spark.createDataFrame([("x", 1, "w3", 2)], "g string, order_id long, term string, qty long")
    assert bm25.score(back, query).collect() == bm25.score(index, query).collect()
    assert back.docs.count() == 12 and back.stats.count() == 2 and back.terms.count() == index.terms.count()


def test_fill_of_the_evaluator(spark):
    scores = spark.createDataFrame([(1, 10, 1.0)], "order_id long, pid long, score double")
    truth = spark.createDataFrame([(1, "test", 11), (2, "test", 12)], "order_id long, split string, pid long")
    catalogue = spark.range(10, 15).select(F.col("id").alias("pid"))
    plain = M.ranking_metrics(scores, truth, [5]).first()
    filled = M.ranking_metrics(scores, truth, [5], fill=catalogue).first()
    assert plain["hr@5"] == 0.0 and filled["hr@5"] == 1.0 and filled.n_orders == 2
    seqs = spark.createDataFrame([(1, [1])], "order_id long, prefix array<long>")
    tags, target = _tags(spark), spark.createDataFrame([(1, "test", 3)], "order_id long, split string, pid long")
    cat = tags.select("pid")
    hr = lambda **o: TE.tag_metrics(seqs, target, tags, cat, "union", ks=[5], alpha=0.0, **o).first()["hr@5"]
    assert hr() == 0.0 and hr(fill=True) == 1.0

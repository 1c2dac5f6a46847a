"""Fuzzy pairs at size: deletion variants are filtered where they are made, a lookup compares queries alone, rounds
read the pairs that are left, one row group is read by all cores."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tagtrail.functions.similarity import indel_ratio, indel_ratios
from tagtrail.operators import fuzzy, variants
from tagtrail.sources.tables import spread


def _edited(rnd, s, n, letters="abcd"):
    x = list(s)
    for _ in range(n):
        i = rnd.randrange(len(x) + 1)
        x[i : i + rnd.randint(0, 1)] = rnd.choice(["", rnd.choice(letters)])
    return "".join(x)


def _strings(spark, strings):
    return spark.createDataFrame([(s, s) for s in strings], "id string, s string")


@pytest.mark.parametrize("threshold", [78, 90])
def test_pairs_of_long_strings_lose_none(spark, threshold):
    rnd = random.Random(8)
    tags = {"".join(rnd.choice("abcdé😀") for _ in range(n)) for n in (1, 2, 5, 9, 14, 17, 20, 23, 24, 25, 31, 33, 40, 63, 66) for _ in range(2)}
    tags = sorted(tags | {_edited(rnd, t, k) for t in sorted(tags) for k in (1, 2, 3, 4, 6)} - {""})
    got = {(r.a, r.b): r.score for r in fuzzy.similar_pairs(_strings(spark, tags), threshold).collect()}
    want = {(a, b): indel_ratio(a, b) for i, a in enumerate(tags) for b in tags[i + 1 :]}
    assert got == {p: s for p, s in want.items() if s >= threshold} and len(got) > 50


def test_variants_that_meet_no_string_are_dropped_where_they_are_made(spark):
    """Thousands of variants a string before; next to none of them is shuffled."""
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20)) for _ in range(300)]
    batch = pa.record_batch({"id": pa.array(range(300)), "g": [""] * 300, "e": [0] * 300, "s": words, "own": [False] * 300})
    f, every = 0.105, lambda own: (variants.INDEX, variants.PROBE, variants.BOTH)
    made = sum(len(k) for k, _ in variants.variant_keys(batch, f, every))

    class Words:
        value = np.zeros(1 << 14, np.uint64)

    for keys, _ in variants.variant_keys(batch, f, lambda own: (variants.INDEX,)):
        np.bitwise_or.at(Words.value, variants.word_of(keys, len(Words.value)), variants.word_bits(keys))
    free = {(False, variants.INDEX), (False, variants.BOTH)}
    kept = sum(len(k) for k, _ in variants.variant_keys(batch, f, every, variants.Filter(Words, free)))
    assert made > 300 * 1000 and kept < made / 5
    assert sum(variants.n_rows(20, 0, f, (s,)) for s in every(False)) * 300 >= made


def test_pairs_with_an_own_row_alone(spark):
    rnd = random.Random(5)
    words = sorted({"candlestick" + "".join(rnd.choice("ab") for _ in range(6)) for _ in range(60)})
    words += sorted({_edited(rnd, "".join(rnd.choice("abcdefgh") for _ in range(40)) + "xyz", 0) for _ in range(3)})
    words += [words[-1] + "abc", words[-1] + "abcde"]
    own = {words[0], words[-1]}
    df = spark.createDataFrame([(w, w, w in own) for w in words], "id string, s string, own boolean")
    got = {(r.a, r.b) for r in fuzzy.similar_pairs(df, 88).collect()}
    want = {(min(a, b), max(a, b)) for a in own for b in words if a != b and indel_ratio(a, b) >= 88}
    assert want <= got and len(want) > 5
    cand = fuzzy.candidate_pairs(df, 88).collect()
    assert all(r.a in own or r.b in own for r in cand) and len(cand) < 2 * len(words)


def test_leaders_of_a_chain_take_many_rounds(spark):
    """Each tag is similar to the next ones alone, so a tag waits for all tags of higher priority before it."""
    tags = ["abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"[i : i + 21] for i in range(30)]
    df = spark.createDataFrame([(t,) for t in tags], "tag string")
    got = {r.tag: (r.leader, r.is_leader) for r in fuzzy.canonical_tags(df, 90, "simple", 1).collect()}
    order = [r.tag for r in df.orderBy(F.xxhash64("tag", F.lit(1)), "tag").collect()]
    leaders, want = [], {}
    for t in order:
        near = [x for x in leaders if indel_ratio(t, x) >= 90]
        leaders += [] if near else [t]
        want[t] = (near[0], False) if near else (t, True)
    assert got == want and 1 < len(leaders) < 30
    with pytest.raises(RuntimeError, match="1 rounds"):
        fuzzy.canonical_tags(df, 90, "simple", 1, max_rounds=1)


def test_ratios_of_many_pairs_equal_single_ones():
    rnd = random.Random(2)
    a = ["".join(rnd.choice("abé😀") for _ in range(rnd.randint(0, 70))) for _ in range(400)] + ["", "x" * 64, "abc"]
    b = [_edited(rnd, s, rnd.randint(0, 9), "ab") for s in a[:-3]] + ["", "x" * 64, ""]
    assert indel_ratios(a, b).tolist() == [indel_ratio(x, y) for x, y in zip(a, b)]
    assert indel_ratios([], []).tolist() == [] and indel_ratios(["abc"], ["abd"]).tolist() == [67]


def test_rows_of_one_row_group_are_dealt(spark, tmp_path):
    rows = pa.table({"doc_id": pa.array([None, *range(999)]), "text": [f"text {i % 7}" for i in range(1000)]})
    pq.write_table(rows, tmp_path / "one.parquet")
    read = spark.read.parquet(str(tmp_path / "one.parquet"))
    dealt = spread(read, "doc_id", "text")
    if spark.sparkContext.defaultParallelism > 2:
        assert dealt.select(F.spark_partition_id()).distinct().count() > 1
    assert sorted(map(str, dealt.collect())) == sorted(map(str, read.collect()))
    spread(dealt, "doc_id").write.parquet(str(tmp_path / "many"))
    many = spark.read.parquet(str(tmp_path / "many"))
    assert spread(many.where("doc_id < 0"), "doc_id").count() == 0

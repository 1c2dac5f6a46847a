"""Sparse labels, cosine join, JSON maps of any key, run folders, tokenizers and coverage."""

import json
import random
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tagtrail import sinks
from tagtrail.operators import clean, orders as O, reports, sft, tagquery, vectors
from tagtrail.operators.quality import QualityError
from tagtrail.plans import tag_eval


def test_sparse_labels(spark):
    catalogue = spark.range(0, 1_000_000, 1, 4).select((F.col("id") * 3).alias("pid"))
    rows = [(1, [9, 0, 9, 5]), (2, []), (3, None), (4, [2_999_997, 4])]
    out = {r.order_id: r for r in O.sparse_labels(spark.createDataFrame(rows, "order_id long, products array<long>"), catalogue).collect()}
    assert {i: (r["size"], r["indices"], r["values"]) for i, r in out.items()} == {
        1: (1_000_000, [0, 3], [1.0, 1.0]), 2: (1_000_000, [], []), 3: (1_000_000, [], []), 4: (1_000_000, [999_999], [1.0])}
    plan = O.sparse_labels(spark.createDataFrame(rows, "order_id long, products array<long>"), catalogue)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list(pid" not in plan


@pytest.mark.parametrize("share", [Fraction(9, 10), Fraction(1, 2), Fraction(1)])
def test_cosine_join_equals_brute_force(spark, share):
    rng = random.Random(2)
    tags = [f"t{i}" for i in range(12)]
    rows = [(i, ["hot"] * rng.randint(0, 3) + [rng.choice(tags) for _ in range(rng.randint(0, 5))]) for i in range(150)] + [(500 + i, ["hot", "t1"]) for i in range(40)] + [(900, []), (901, None)]
    got = vectors.cosine_above(vectors.tag_counts(spark.createDataFrame(rows, "pid long, tags array<string>")), share).collect()
    reps = {}
    for pid, ts in rows:
        if ts:
            reps.setdefault(frozenset(Counter(ts).items()), pid)
    want = {}
    for x, a in reps.items():
        for y, b in reps.items():
            dot = sum(n * dict(y).get(t, 0) for t, n in x)
            nx, ny = (sum(n * n for _, n in v) for v in (x, y))
            if a < b and share.denominator**2 * dot * dot >= share.numerator**2 * nx * ny:
                want[a, b] = round(dot / (nx * ny) ** 0.5, 6)
    assert {(r.pid_a, r.pid_b): r.cosine for r in got} == pytest.approx(want) and len(got) == len(want)
    assert share == 1 or want


def test_json_map_of_any_key(spark, tmp_path):
    rows = [(f"k{i}", i) for i in range(95)] + [("k7", 3), ("12", 1), ("é\"", 2), (None, 9)]
    sinks.write_json_map(spark.createDataFrame(rows, "k string, v long"), "k", "v", str(tmp_path / "m"), entries_per_object=20)
    objects = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "m")).collect()]
    assert len(objects) > 3 and all(list(o) == sorted(o, key=str.encode) for o in objects)
    whole = {k: v for o in objects for k, v in o.items()}
    assert whole == {**{f"k{i}": i for i in range(95)}, "k7": 3, "12": 1, 'é"': 2} and sum(map(len, objects)) == len(whole)
    sinks.write_json_map(spark.createDataFrame([], "k string, v long"), "k", "v", str(tmp_path / "none"))
    assert spark.read.text(str(tmp_path / "none")).count() == 0


def test_a_run_is_rewritten_without_touching_another(spark, tmp_path):
    path = str(tmp_path / "runs")
    a, b = {"k1": 1.5, "name": "a"}, {"k1": 0.75, "name": "b"}
    one = sinks.write_run(spark.range(5).toDF("x"), a, path)
    two = sinks.write_run(spark.range(7).toDF("x"), b, path)
    assert one != two and sinks.write_run(spark.range(2).toDF("x"), dict(reversed(a.items())), path) == one
    rows, config = sinks.read_run(spark, path, one)
    assert config == a and rows.columns == ["x"] and rows.count() == 2
    rows, config = sinks.read_run(spark, path, two)
    assert config == b and rows.count() == 7
    with pytest.raises(ValueError):
        sinks.write_run(spark.range(1).toDF("run_id"), a, path)


RECORDS = [(1, "", "1. red, shirt\n2.", "blue shirt"), (2, "User: Zoë", "1. a\n2.", ""), (3, "", "x", None)]


def _labels(rows):
    return {r.order_id: (r.input_ids, r.labels, r.attention_mask) for r in rows.collect()}


def test_vocabulary_and_whitespace_tokenizer_agree(spark):
    df = spark.createDataFrame(RECORDS, "order_id long, instruction string, input string, output string")
    texts = df.select(F.concat_ws(" ", sft.prompt_text("Say."), "output").alias("text"))
    vocab = {r.token: int(r.id) for r in sft.build_vocab(texts).collect()}
    made = sft.token_labels(df, ["order_id"], "Say.", cutoff=64)
    own = sft.token_labels(df, ["order_id"], "Say.", cutoff=64, tokenizer=sft.whitespace_tokenizer(vocab))
    assert _labels(made) == _labels(own)
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Exchange" not in plan
    with pytest.raises(Exception, match="not in the vocabulary"):
        sft.token_labels(df, ["order_id"], "Say.", cutoff=64, tokenizer=sft.whitespace_tokenizer({})).collect()


def test_subword_tokenizer(spark):
    path = "/opt/tokenizers/byte_bpe_50k.tiktoken"

    def make():
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(t): int(i) for t, i in (line.split() for line in f.read().splitlines())}
        return tiktoken.Encoding("t", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    df = spark.createDataFrame(RECORDS, "order_id long, instruction string, input string, output string")
    got = _labels(sft.token_labels(df, ["order_id"], "Say.", cutoff=40, tokenizer=make, special=(50_256, 50_257, 50_258), true_mask=True))
    encode = make()
    for r in df.withColumn("prompt", sft.prompt_text("Say.")).collect():
        p, o = encode(r.prompt), encode(r.output or "")
        whole = ([50_257] + p + o + [50_258])[:40]
        ids = whole + [50_256] * (40 - len(whole))
        n = min(len(p) + 1, 40)
        assert got[r.order_id] == (ids, [-100] * n + ids[n:], [1] * len(whole) + [0] * (40 - len(whole)))


def test_untagged_items_keep_their_place_and_an_untagged_catalogue_is_an_error(spark):
    tags = spark.createDataFrame([(1, ["a", "b"]), (3, ["c"])], "pid long, tags array<string>")
    seqs = spark.createDataFrame([(7, [1, 2, 3])], "order_id long, prefix array<long>")
    assert tagquery.seq_tag_lookup(seqs, tags).first().seq_tags == [["a", "b"], [], ["c"]]
    assert {(r.term, r.qty) for r in tagquery.build_query(seqs, tags, "sum").collect()} == {("a", 1), ("b", 1), ("c", 1)}
    catalogue = spark.createDataFrame([(1,), (2,)], "pid long")
    with pytest.raises(QualityError):
        tag_eval.restrict_tag_corpus(tags, catalogue)
    assert tag_eval.restrict_tag_corpus(tags, catalogue, check=False).count() == 1


def test_stage_report_reads_the_log_once(spark, tmp_path):
    """Counts come from the writing job; the report's plan does not read the log."""
    site = "https://shop.example"
    rows = [(i, 1, 1, i, f"{site}/{p}", r) for i, (p, r) in enumerate(
        [("a-1.html", None), ("a-1.html", None), ("b-2.html", f"{site}/b-2.html"), ("a-1.html", "x"), ("c-3.html", "x")])]
    raw = spark.createDataFrame(rows, "seq long, uuid_ind long, session_id long, timestamp long, url_now string, url_referrer string")
    raw.selectExpr("*", "'shop' web_id", "'load' event_type").write.parquet(str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    report = clean.clean_stage_report(log, r"shop\.example", {"cart": "/cart"})
    assert [(r.n_kept, r.n_dropped) for r in report.orderBy("stage_no").collect()] == [(5, 0), (4, 1), (4, 0), (4, 0), (2, 2)]
    assert not any(str(tmp_path) in f for f in report.inputFiles())
    none = clean.clean_stage_report(log.where("seq < 0"), r"shop\.example", {"cart": "/cart"}).collect()
    assert [(r.n_kept, r.n_dropped, r.pct_dropped) for r in none] == [(0, 0, None)] * 5


def test_enhanced_tags_by_their_leaders(spark):
    preds = spark.createDataFrame([(1, "1. wool hat, tea"), (2, "1. Hat wool"), (3, "nothing")], "pid long, raw_predict string")
    plain = {r.pid: r.tags for r in reports.enhanced_tags(preds).collect()}
    got = {r.pid: r.tags for r in reports.enhanced_tags(preds, add_pid_tag=1, fuzzy=90).collect()}
    assert {k: len(v) + 1 for k, v in plain.items()} == {k: len(v) for k, v in got.items()}
    assert got[1][0] == got[2][0] and got[3][-1] == "3"

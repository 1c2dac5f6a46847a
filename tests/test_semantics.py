"""Hand-computed cases of the semantics register."""

import math

from pyspark.sql import functions as F

from tagtrail.functions import text as T
from tagtrail.operators import clean, expand, metrics as M, orders as O, scoring, tagquery


def test_baseline_last_occurrence_wins(spark):
    df = spark.createDataFrame([(1, [3, 10, 5, 3])], "order_id long, loaded_pids array<long>")
    got = {r.pid: r.score for r in scoring.baseline_score(df).collect()}
    assert got == {3: 4.0, 10: 2.0, 5: 3.0}
    ranked = df.select(scoring.recency_ranking("loaded_pids").alias("r")).first().r
    assert ranked == [3, 5, 10]


def test_english_bow_docstring(spark):
    df = spark.createDataFrame([(["hello world", "I am a tag"],)], "tags array<string>")
    assert df.select(T.english_bow("tags").alias("b")).first().b == ["hello", "world", "I", "am", "a", "tag"]


def test_padded_tag_gives_empty_words(spark):
    df = spark.createDataFrame([([" a "],)], "tags array<string>")
    assert df.select(T.english_bow("tags").alias("b")).first().b == ["", "a", ""]


def test_multiset_queries(spark):
    seqs = spark.createDataFrame([(1, [1, 2])], "order_id long, prefix array<long>")
    tags = spark.createDataFrame([(1, ["a", "a", "b"]), (2, ["a", "c"])], "pid long, tags array<string>")

    def q(fn):
        return {r.term: r.qty for r in tagquery.build_query(seqs, tags, fn).collect()}

    assert q("union") == {"a": 2, "b": 1, "c": 1}
    assert q("intersection") == {"a": 1}
    assert q("sum") == {"a": 3, "b": 1, "c": 1}
    assert q("concat") == q("sum")
    assert q("last") == {"a": 1, "c": 1}
    assert q("recency") == {"a": 4, "b": 1, "c": 2}


def test_next_item_expansions(spark):
    df = spark.createDataFrame([(1, 9, [1, 2, 3])], "order_id long, uuid_ind long, loaded_pids array<long>")
    last = expand.next_item_last(df).first()
    assert (last.prefix, last.target, last.uuid_ind) == ([1, 2], 3, 9)
    it = sorted((r.prefix, r.target) for r in expand.next_item_iterative(df).collect())
    assert it == [([1], 2), ([1, 2], 3)]


def test_multi_hit_metrics(spark):
    ranked = spark.createDataFrame([("o", "p", 1), ("o", "x", 2), ("o", "q", 3)], "order_id string, pid string, rank int")
    truth = spark.createDataFrame([("o", "s", "p"), ("o", "s", "q")], "order_id string, split string, pid string")
    r = M.per_order_metrics_long(ranked, truth, [5]).first()
    assert r["hr@5"] == 1.0
    assert math.isclose(r["mrr@5"], 1 + 1 / 3)
    assert math.isclose(r["ndcg@5"], (1 + 1 / 2) / (1 + 1 / math.log2(3)))


def test_list_metrics_match_long_form(spark):
    df = spark.createDataFrame([(["p", "x", "q"], ["p", "q"])], "ranked array<string>, truth array<string>")
    r = M.per_row_metrics_list(df, "ranked", "truth", [5]).first()
    assert math.isclose(r["mrr@5"], 1 + 1 / 3) and r["hr@5"] == 1.0


def test_denumber_everywhere(spark):
    df = spark.createDataFrame([("1. vitamin 12. x",)], "s string")
    assert df.select(T.denumber("s").alias("o")).first().o == "vitamin x"


def test_self_referral_keeps_null_referrer(spark):
    df = spark.createDataFrame([("u", None), ("v", "v"), ("w", "z")], "url_now string, url_referrer string")
    assert sorted(r.url_now for r in clean.drop_self_referrals(df).collect()) == ["u", "w"]


def test_time_split_double_ratio(spark):
    df = spark.createDataFrame([(t,) for t in range(11)], "timestamp long")
    got = {r.timestamp: r.split for r in O.time_split(df).collect()}
    # the reference's bounds, in Python float arithmetic: 0 + int(10 * 0.7) and
    # 0 + int(10 * (0.7 + 0.2)); the second product rounds to 9.0 in IEEE doubles
    train_end, val_end = int(10 * 0.7), int(10 * (0.7 + 0.2))
    for t, s in got.items():
        assert s == ("train" if t <= train_end else "val" if t <= val_end else "test")


def test_idf_cutoff(spark):
    from tagtrail.operators import bm25

    # N = 357 documents; term "five" in 5 docs (idf 4.160 kept), "six" in 6 (3.990 dropped)
    rows = [(i, (["five"] if i < 5 else []) + (["six"] if i < 6 else []) + ["pad"]) for i in range(357)]
    corpus = spark.createDataFrame(rows, "doc_id long, tokens array<string>")
    terms = {r.term: r.idf for r in bm25.build_index(corpus, alpha=4.0).terms.collect()}
    assert "five" in terms and "six" not in terms and round(terms["five"], 3) == 4.160


def test_truncate_last_shorter(spark):
    df = spark.createDataFrame([([1, 2],)], "a array<long>")
    assert df.select(T.last_n("a", 3).alias("x")).first().x == [1, 2]


def test_url_parsing_like_urlparse(spark):
    from tagtrail.functions import urls as U

    df = spark.createDataFrame([("https://user@mob.shop.example:8080/a/cheap_12.html;p=1?x=2#f",)], "u string")
    r = df.select(U.netloc("u").alias("n"), U.path("u").alias("p")).first()
    assert r.n == "user@mob.shop.example:8080" and r.p == "/a/cheap_12.html"


def test_parse_tags_keeps_empty(spark):
    df = spark.createDataFrame([("1 2",), ("Red Apple, fresh-fruit\\nnext",)], "s string")
    got = [r.t for r in df.select(T.parse_tags("s").alias("t")).collect()]
    assert got[0] == [""]


def test_clean_generation(spark):
    df = spark.createDataFrame([("<s>[INST] q [/INST] Assistant: red, <b>blue</b></s>",), ("no marker",)], "s string")
    got = [r.c for r in df.select(T.clean_generation("s").alias("c")).collect()]
    assert got == ["  red, blue", ""]


def test_token_labels_prompt_masking(spark):
    from tagtrail.operators import sft

    rec = spark.createDataFrame([(1, "", "1. a, b\n2.", "c d")], "order_id long, instruction string, input string, output string")
    r = sft.token_labels(rec, ["order_id"], "sys", cutoff=32).first()
    n_prompt = 1 + len("[INST] <<SYS>> sys <</SYS>> [/INST] 1. a, b 2.".split())
    assert len(r.input_ids) == len(r.labels) == len(r.attention_mask) == 32
    assert r.labels[:n_prompt] == [-100] * n_prompt and r.labels[n_prompt:n_prompt + 3] == r.input_ids[n_prompt:n_prompt + 3]
    assert r.input_ids[n_prompt + 2] == 2 and set(r.attention_mask) == {1}
    ref = sft.token_labels(rec, ["order_id"], "sys", cutoff=32, reference_prompt_padding=True).first()
    assert set(ref.labels) == {-100}

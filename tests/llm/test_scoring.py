"""Token counts, language ID and quality ranking."""

import random

import pytest
from pyspark.sql import functions as F

from tagtrail.llm import language_id, quality_rank, queries, token_counts
from tagtrail.llm.common import table

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, tokens string, language string, score string"
ODD = [(1, None, "en", "a", "x", "y", "z"), (2, "", None, None, None, None, None), (2, "", None, None, None, None, None), (None, "12 !? 7", "fr", "b", "", "", ""), (3, "Ünïcödé wörds " * 9000, "de", "c", "t", "l", "s"), (4, "a" * 5000, "de", "c", "t", "l", "s")]


def greedy(word, starts, continues):
    b, n, at = word.encode(), 0, 0
    while at < len(b):
        vocab = starts if at == 0 else continues
        size = next(k for k in range(len(b) - at, 0, -1) if b[at : at + k] in vocab)
        at += size
        n += 1
    return n


def test_automaton_counts_greedy_pieces():
    starts, continues = token_counts.word_pieces()
    of = token_counts.Counter(token_counts.automaton(starts, continues))
    rng = random.Random(5)
    words = ["", "a", "the", "unbelievable", "élan", "naïveté", "x" * 300, "日本語", "thethethe"] + ["".join(rng.choice("thesionaéx19_") for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    assert [of[w] for w in words] == [greedy(w, starts, continues) for w in words]
    # a small vocabulary in which failure links are followed over several pieces
    small = {b"a", b"b", b"c", b"d", b"abcd", b"ab"}
    more = {b"a", b"b", b"c", b"d", b"cda", b"bc", b"dab"}
    tiny = token_counts.Counter(token_counts.automaton(small | {bytes([i]) for i in range(256)}, more | {bytes([i]) for i in range(256)}))
    for _ in range(3000):
        w = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 12)))
        assert tiny[w] == greedy(w, small, more), w


def test_token_counts_odd_rows(spark):
    df = spark.createDataFrame(ODD, SCHEMA)
    rows = token_counts.count_tokens(df, into="counts").select("doc_id", "text", "counts.*").collect()
    assert len(rows) == len(ODD)
    starts, continues = token_counts.word_pieces()
    for r in rows:
        words = token_counts.WORD.findall(r.text or "")
        assert r.n_words == len(words) and r.n_tokens == sum(greedy(w, starts, continues) for w in set(words) for _ in range(words.count(w)))
    assert token_counts.count_tokens(df.limit(0), into="counts").count() == 0


def test_language_held_out_accuracy(spark):
    out = queries.QUERIES["op2_language_id"](spark, SF).join(table(spark, SF, "documents").select("doc_id", "lang"), "doc_id")
    hits = out.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert hits > 0.98 and out.where("score < 0 OR score > 1").count() == 0


def test_language_odd_rows(spark):
    df = spark.createDataFrame(ODD, SCHEMA)
    model = language_id.fit(df)
    rows = {(r.doc_id, r.text): (r.p.lang_pred, r.p.score) for r in language_id.identify(df, model, into="p").collect()}
    assert rows[(1, None)] == ("und", 0.0) and rows[(2, "")] == ("und", 0.0) and rows[(None, "12 !? 7")] == ("und", 0.0)
    assert rows[(4, "a" * 5000)][0] in model[0]
    empty = language_id.fit(df.limit(0))
    assert {r.p.lang_pred for r in language_id.identify(df, empty, into="p").collect()} == {"und"}


def test_long_texts_score_as_the_sum_of_their_pieces(monkeypatch):
    import numpy as np

    matrix = np.random.default_rng(1).normal(size=(language_id.BUCKETS + 1, 3)).astype("f4")
    texts = ["ab " * 500, "x", None, "", "zażółć gęślą jaźń " * 40]
    whole = language_id.log_likelihoods(texts, matrix)
    monkeypatch.setattr(language_id, "PIECE", 37)
    assert np.allclose(whole, language_id.log_likelihoods(texts, matrix), rtol=1e-4, atol=1e-2)


def test_counting_grams_of_many_texts_takes_bounded_memory():
    import tracemalloc

    import numpy as np

    matrix = np.zeros((language_id.BUCKETS + 1, 4), np.float32)
    texts = ["".join(chr(97 + (i * j * j + j) % 26) for j in range(1000)) for i in range(512)]
    tracemalloc.start()
    try:
        assert language_id.log_likelihoods(texts, matrix).shape == (512, 4)
        assert tracemalloc.get_traced_memory()[1] < 16 << 20
    finally:
        tracemalloc.stop()


def test_quality_held_out(spark):
    out = queries.QUERIES["op3_quality_rank"](spark, SF).join(table(spark, SF, "labels"), "doc_id").where("held_out").toPandas()
    assert ((out.predicted == 1) == (out.quality == 1)).mean() > 0.95
    assert (out.score.between(0, 1)).all() and ((out.score >= 0.3) == (out.predicted == 1)).all()


def test_quality_odd_rows(spark):
    df = spark.createDataFrame(ODD, SCHEMA)
    labels = spark.createDataFrame([(1, None, 0), (None, 1, 0), (3, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality_rank.fit(df, labels)
    rows = quality_rank.rate(df, model, into="s").collect()
    assert len(rows) == len(ODD) and all(r.s == pytest.approx(0.3) for r in rows)


def test_more_languages_than_a_model_holds_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MAX_MODEL_CELLS", 2 * language_id.BUCKETS)
    two = spark.createDataFrame([(i, "text of a", f"l{i % 2}") for i in range(8)], "doc_id long, text string, lang string")
    assert language_id.fit(two)[0] == ["l0", "l1"]
    three = spark.createDataFrame([(i, "text of a", f"l{i % 3}") for i in range(9)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="too many"):
        language_id.fit(three)


def plain_bayes(train, texts):
    """Dictionary version of the classifier: counts of hashed n-grams per language, smoothed, and the whole text scored."""
    import math
    from collections import Counter

    import numpy as np

    def grams(text):
        cp = language_id.code_points(f" {text} ") if text else np.empty(0, np.uint32)
        out = Counter()
        for n in language_id.ORDERS:
            for at in range(len(cp) - n + 1):
                out[int(language_id.gram_buckets(cp[at : at + n], n, language_id.BUCKETS)[0])] += 1
        return out

    counts, docs = {}, Counter()
    for text, lang in train:
        counts.setdefault(lang, Counter()).update(grams(text))
        docs[lang] += 1
    langs = sorted(counts)
    total = {x: sum(counts[x].values()) + language_id.SMOOTHING * language_id.BUCKETS for x in langs}
    out = []
    for text in texts:
        if not text or not any(map(str.isalpha, text)):
            out.append(("und", 0.0))
            continue
        g = grams(text)
        ll = {x: math.log(docs[x] / sum(docs.values())) + sum(k * math.log((counts[x][b] + language_id.SMOOTHING) / total[x]) for b, k in g.items()) for x in langs}
        best = max(langs, key=ll.get)
        out.append((best, 1 / sum(math.exp(v - ll[best]) for v in ll.values())))
    return out


def test_language_query_equals_plain_bayes(spark):
    from zlib import crc32

    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text", "lang").collect()
    held = {r.doc_id: crc32(str(r.doc_id).encode()) % 4 == 2 for r in docs}
    want = plain_bayes([(r.text, r.lang) for r in docs if not held[r.doc_id] and r.text is not None and r.lang is not None], [r.text for r in docs])
    got = {r.doc_id: r for r in queries.op2_language_id(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(docs)
    for r, (lang, score) in zip(docs, want):
        assert got[r.doc_id].held_out == held[r.doc_id]
        assert got[r.doc_id].lang_pred == lang and got[r.doc_id].score == pytest.approx(score, abs=2e-3), r.doc_id


def test_many_languages_are_scored_in_bounded_memory():
    import tracemalloc

    import numpy as np

    matrix = np.random.default_rng(2).normal(size=(language_id.BUCKETS + 1, 176)).astype("f4")
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdefghij klmnop") for _ in range(400_000)), "x", None]
    tracemalloc.start()
    out = language_id.log_likelihoods(texts, matrix)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120e6 and out.shape == (3, 176)
    cp = language_id.code_points(f" {texts[0]} ")
    plain = matrix[language_id.BUCKETS].astype("f8").copy()
    for n in language_id.ORDERS:
        b, k = np.unique(language_id.gram_buckets(cp, n, language_id.BUCKETS), return_counts=True)
        plain += (matrix[b].astype("f8") * k[:, None]).sum(axis=0)
    assert np.allclose(out[0], plain)


def test_quality_model_does_not_depend_on_partitioning_or_repeats(spark):
    import numpy as np

    rng = random.Random(8)
    good = [(i, " ".join(rng.choice(["the", "river", "runs", "slowly", "home"]) for _ in range(40)) + ".") for i in range(60)]
    bad = [(100 + i, "$$$ buy | now | " * rng.randint(1, 9)) for i in range(60)]
    rows = good + bad + [(i, "something else entirely, twice") for i in range(5)]
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in good + bad], "doc_id long, quality int")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    models = [quality_rank.fit(df.repartition(n), labels) for n in (1, 7)]
    assert np.array_equal(models[0]["w"], models[1]["w"]) and models[0]["cut"] == models[1]["cut"]
    # scores against a plain dot product
    shift = np.log(quality_rank.THRESHOLD / (1 - quality_rank.THRESHOLD))
    m = models[0]
    for r in quality_rank.rate(df, m).collect():
        s = float(quality_rank.features(r.text).astype(float) @ m["w"])
        p = 1 / (1 + np.exp(-(3 * (s - m["cut"]) / m["scale"] + shift)))
        assert r.score == pytest.approx(p, abs=1e-6) and (r.score >= 0.3) == (s >= m["cut"])
    none = table(spark, SF, "documents").limit(0)
    assert quality_rank.rate(none, quality_rank.fit(none, labels)).count() == 0


def test_a_result_column_that_exists_is_an_error(spark):
    df = spark.createDataFrame(ODD, SCHEMA)
    model = language_id.fit(df.limit(0))
    for call in (lambda: language_id.identify(df, model), lambda: token_counts.count_tokens(df), lambda: quality_rank.rate(df, {"w": 0, "cut": 0, "scale": 1})):
        with pytest.raises(ValueError, match="into="):
            call()


def test_quality_model_learns_from_every_labelled_document(spark, monkeypatch):
    """Blocks hold every labelled document once, and each meets one of the other label; the weights are the optimum of the
    loss over all pairs and the cut is the quantile of all strengths."""
    import numpy as np

    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdeXY19.") for _ in range(rng.randint(1, 7)))
    rows = [(i, " ".join(word() for _ in range(rng.randint(3, 30))) + (" ok." if i % 9 else " $|"), int(i % 9 > 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    monkeypatch.setattr(quality_rank, "BLOCK", 40)
    monkeypatch.setattr(quality_rank, "LEAST", 8)  # 44 bad documents in ten blocks: copied to two
    known = quality_rank.known_labels(df, "quality")
    blocks = quality_rank.training_blocks(df.select("doc_id", "text"), known, {0: 45, 1: 355})
    held = [quality_rank.unpack(r) for r in blocks.collect()]
    assert len(held) == 10 and sum(int(f.sum()) for _, _, f in held) == 400 and sum(len(f) for _, _, f in held) == 355 + 2 * 45
    assert all(0 < y.sum() < len(y) for _, y, _ in held)
    own = np.vstack([x[f == 1] for x, _, f in held])
    every = np.vstack([quality_rank.features(t) for _, t, _ in rows]).astype(float)
    assert np.array_equal(own[np.lexsort(own.T)], every[np.lexsort(every.T)])
    m = quality_rank.fit(df.select("doc_id", "text"), df)
    spread = every.std(axis=0) + 1e-3
    w, pairs, gradient = m["w"] * spread, 0, 0
    for x, y, _ in held:
        d = (x[y == 1][:, None] - x[y == 0][None]) / spread
        pairs += d.shape[0] * d.shape[1]
        gradient = gradient - (d / (1 + np.exp(d @ w))[:, :, None]).sum(axis=(0, 1))
    assert np.abs(gradient / pairs + quality_rank.DECAY * w).max() < 1e-4
    s = every @ m["w"]
    assert (s >= m["cut"]).sum() == 355 and m["scale"] == pytest.approx(s.std(), rel=1e-6)


def test_quality_model_of_texts_with_one_id_and_one_rare_label(spark):
    rows = [(i, f"plain text number {i} of many.") for i in range(30)] + [(30, "$$ | $$")] * 3 + [(30, "another text"), (None, "x"), (31, None)]
    labels = [(i, 1) for i in range(30)] + [(30, 0), (31, 0), (77, 0), (77, 0), (None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    a, b = (quality_rank.fit(df.repartition(n), known) for n in (1, 5))
    assert (a["w"] == b["w"]).all() and a["cut"] == b["cut"] and a["scale"] == b["scale"] and a["w"].any()
    blank = quality_rank.fit(df.where("doc_id < 30"), known)  # labels of both kinds, documents of one
    assert not blank["w"].any()

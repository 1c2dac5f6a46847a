"""Quotation threads, decontamination, mixing, shards and the pipeline."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagtrail.llm import decontaminate, mixing, queries, quote_threads, training_shards
from tagtrail.llm.common import connected_components

SF = "/root/testdata/sf0.001"


def test_components_of_chains_and_hubs(spark):
    rows = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(300, 300), (None, 7)]
    got = dict(connected_components(spark.createDataFrame(rows, "u long, v long")).collect())
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(30)) and got[300] == 300


def test_quotes_link_and_order(spark):
    talk = [
        (1, 0, "user", "Where is the key to the garden?"),
        (1, 1, "assistant", "Under the blue stone.\nNext to the gate."),
        (1, 2, "user", "Thanks."),
        (1, 3, "user", "On Monday bob wrote:\n> under the BLUE stone.\n> next to the gate\nWhich gate?"),
        (1, 4, "assistant", ">> Under the blue stone. Next to the gate.\n> which gate\nThe north one."),
        (1, 4, "assistant", ">> Under the blue stone. Next to the gate.\n> which gate\nThe north one."),
        (1, 5, "user", "> never said\nok"),
        (2, 0, "user", "> Under the blue stone.\nother talk"),
        (None, None, None, None),
        (3, 7, "user", "> only a quote"),
    ]
    df = spark.createDataFrame([(*r, "c", 1) for r in talk], "conv_id long, turn long, role string, text string, conv string, t int")
    got = {(r.conv_id, r.turn): r for r in quote_threads.reply_ordered(df).collect()}
    assert len(got) == 9 and got[(1, 4)].copies == 2
    assert got[(1, 3)].reply_to == 1 and got[(1, 3)].quoted and got[(1, 3)].text == "Which gate?"
    assert got[(1, 4)].reply_to == 3 and got[(1, 4)].quoted_turns == [1, 3] and got[(1, 4)].text == "The north one."
    assert got[(1, 5)].reply_to == 4 and not got[(1, 5)].quoted and got[(2, 0)].reply_to is None and got[(2, 0)].text == "other talk"
    assert got[(3, 7)].text == "" and got[(None, None)].position == 1
    order = sorted((r.position, r.turn) for r in got.values() if r.conv_id == 1)
    assert order == [(1, 0), (2, 1), (3, 2), (4, 3), (5, 4), (6, 5)]
    assert quote_threads.reply_ordered(df.limit(0)).count() == 0


def test_quote_positions_over_slices(spark, monkeypatch):
    monkeypatch.setattr(quote_threads, "SLICE", 4)
    talk = [(1, i, "user", f"message number {i}" if i % 7 else f"> message number {i // 2 + 1}\nanswer {i}") for i in range(60)]
    got = quote_threads.reply_ordered(spark.createDataFrame(talk, "conv_id long, turn long, role string, text string")).collect()
    own = {i: (None if i % 7 == 0 else f"message number {i}") for i in range(60)}
    parent = {i: next((j for j in range(i - 1, -1, -1) if i % 7 == 0 and own[j] == f"message number {i // 2 + 1}"), i - 1) for i in range(60)}
    want = sorted(range(60), key=lambda i: (parent[i], i))
    assert [r.turn for r in sorted(got, key=lambda r: r.position)] == want
    assert [r.position for r in sorted(got, key=lambda r: r.position)] == list(range(1, 61))
    assert all((r.reply_to if r.reply_to is not None else -1) == parent[r.turn] for r in got)


def brute_hits(docs, items):
    rx = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cut = lambda t: rx.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    wins = {}
    for i, t in items:
        w = cut(t)
        n = min(13, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[s : s + n]), set()).add(i)
    out = []
    for d, t in docs:
        w = cut(t)
        hit, found = set(), set()
        for n in {len(x) for x in wins}:
            for s in range(len(w) - n + 1):
                if (x := tuple(w[s : s + n])) in wins:
                    hit |= set(range(s, s + n))
                    found |= wins[x]
        ids = sorted(str(x) for x in found if x is not None)
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_BYTES, 0])
def test_decontamination_equals_brute_force(spark, limit):
    item = " ".join(f"q{i}" for i in range(30))
    docs = [(1, item), (2, "pre " * 40 + item[: len(item) // 2] + " post"), (3, None), (4, "!!"), (5, "É short Item é"), (6, "short item"), (6, "short item"), (None, "x SHORT-item y"), (7, " ".join(f"z{i}" for i in range(900)) + " " + item), (8, "q1 q2 q3 " * 50), (9, "short " * 20)]
    items = [(10, item), (9, item + " more"), (11, "Short item"), (11, "Short item"), (12, None), (13, "é É"), (None, "q1 q2 q3 " * 6)]
    d = spark.createDataFrame([(*r, "w") for r in docs], "doc_id long, text string, window string")
    b = spark.createDataFrame([(*r, "w") for r in items], "item_id long, text string, w string")
    got = [tuple(r) for r in decontaminate.report(d, b, broadcast_bytes=limit).collect()]
    assert sorted(got, key=str) == brute_hits(docs, items)
    bad = {r[0] for r in got if r[5]}
    assert {r.doc_id for r in decontaminate.clean(d, b).collect()} == {r[0] for r in docs} - bad
    assert decontaminate.report(d, b.limit(0)).where("contaminated").count() == 0 and decontaminate.report(d.limit(0), b).count() == 0


def test_mix_fills_families_before_ancestors(spark):
    leaves = [("domain0", "en", "src0", 100), ("domain0", "en", "src4", 1000), ("domain0", "de", "src0", 50), ("domain1", "en", "src1", 5000)]
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long")
    got = {(r.domain, r.lang, r.source): r.quota for r in mixing.leaf_quotas(df, 2000, {"lang": {"de": 3}}, 1).collect()}
    # domain0 gets 1000: de could have 750 but holds 50, so en takes 950; src0 is full at 100
    assert got == {("domain0", "de", "src0"): 50, ("domain0", "en", "src0"): 100, ("domain0", "en", "src4"): 850, ("domain1", "en", "src1"): 1000}
    all_of_it = {r.source: r.quota for r in mixing.leaf_quotas(df, 10**9, {}, 2).collect()}
    assert all_of_it["src1"] == 10000
    gone = {r.domain: r.quota for r in mixing.leaf_quotas(df, 2000, {"domain": {"domain0": 0}}, 1).collect()}
    assert gone == {"domain1": 2000}


def test_mix_odd_rows(spark):
    rows = [(i, f"w{i} " * (i % 9 + 1), ["en", None, "de"][i % 3], ["src0", None, "nix"][i % 2]) for i in range(200)] + [(None, "a b c", "en", "src0"), (7, None, "en", "src0"), (8, "", "en", "src0")] + [(500, "same text", "en", "src0")] * 3
    df = spark.createDataFrame([(*r, "m") for r in rows], "doc_id long, text string, lang string, source string, slot string")
    plan = mixing.plan(df, budget_share=0.5).collect()
    assert len(plan) == len(rows)
    total = sum(r.n_tokens for r in plan)
    used = sum(r.n_tokens * r.epochs for r in plan)
    assert 0.4 * total <= used <= 0.5 * total
    assert len({r.epochs for r in plan if r.doc_id == 500}) == 1
    out = mixing.mix(df, budget_share=0.5)
    assert out.columns == df.columns and out.count() == sum(r.epochs for r in plan)
    assert mixing.plan(df.limit(0)).count() == 0 and mixing.mix(df, budget_share=0.0).count() == 0
    assert mixing.mix(df, budget_share=9.0).count() == 2 * sum(r.n_tokens > 0 for r in plan)


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4097])
def test_feistel_is_a_permutation(n):
    a = training_shards.feistel_slots(np.arange(n), n, "k")
    assert sorted(a) == list(range(n))
    assert n < 100 or (a != training_shards.feistel_slots(np.arange(n), n, "other")).any()


def test_shards_round_trip(spark, tmp_path):
    rows = [(i, "Some words, très bien, 123 " * (i % 7 * 5)) for i in range(60)] + [(None, "no id"), (61, None), (62, ""), (63, "twice"), (63, "twice"), (64, "long words " * 20000)]
    df = spark.createDataFrame([(*r, "d") for r in rows], "doc_id long, text string, data string").repartition(3)
    path = str(tmp_path / "shards")
    out = training_shards.write_shards(df, path, stride=64, shard_slots=50).orderBy("shard").collect()
    enc = training_shards.encoder(training_shards.read_vocabulary(training_shards.VOCABULARY))
    docs, slots = {}, []
    for r in out:
        assert len(r.data) == r.n_slots * r.stride and r.first_slot == r.shard * 50
        for k in range(r.n_slots):
            ids = np.frombuffer(r.data[k * 128 : (k + 1) * 128], "<u2")
            assert (ids[r.n_ids[k] :] == training_shards.PAD).all()
            docs.setdefault(r.doc_ids[k], []).append((r.seqs[k], ids[: r.n_ids[k]].tolist()))
            slots.append(r.first_slot + k)
    assert slots == list(range(len(slots)))
    for i, t in rows:
        if t:
            whole = enc.encode_ordinary(t) * sum(r == (i, t) for r in rows)
            assert sorted(x for _, s in docs[i] for x in s) == sorted(whole)
            if i != 63:
                assert [x for _, s in sorted(docs[i]) for x in s] == whole
    some = training_shards.read_slots(spark, path, 45, 120, shard_slots=50).orderBy("slot").collect()
    assert [r.slot for r in some] == list(range(45, 120))
    assert bytes(some[0].ids) == out[0].data[45 * 128 : 46 * 128]
    assert training_shards.materialise(df.limit(0)).count() == 0


def test_places_of_shards_take_no_workers_of_their_own(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text number {i} " * (i % 40)) for i in range(60)], "doc_id long, text string")

    def refused(*args, **more):
        raise AssertionError("rows of a list go through Python workers of another kind")

    monkeypatch.setattr(spark.sparkContext, "parallelize", refused)
    placed, n = training_shards.ordered(docs.repartition(3), stride=16)
    assert sorted(r.slot for r in placed.select("slot").collect()) == list(range(n)) and n > 60
    assert training_shards.ordered(docs.limit(0))[0].collect() == []


def test_stages_on_texts_ask_for_small_batches(spark):
    from tagtrail.llm import common, jaccard_join, language_id

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.createDataFrame([(1, "one text and another", "en")], "doc_id long, text string, lang string")
    old = spark.conf.get(key)
    try:
        for stage in (language_id.fit, lambda d: language_id.predictor(spark, ([], None)), lambda d: jaccard_join.shingle_counts(d, 2), lambda d: training_shards.sequences(d, 8, training_shards.VOCABULARY)):
            spark.conf.set(key, f"{common.BATCH_BYTES}b")
            stage(docs)
            assert int(spark.conf.get(key).rstrip("b")) <= 2 << 20
    finally:
        spark.conf.set(key, old)


def test_pipeline_stages_keep_columns_and_clean_documents(spark):
    import corpus_pipeline

    docs = queries.table(spark, SF, "documents")
    marked = docs.withColumn("node", F.lit("x"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, marked, SF)
        assert out.columns == marked.columns, name
        assert out.select("doc_id").distinct().join(docs.select("doc_id"), "doc_id", "left_anti").count() == 0
    hits = {r.doc_id for r in queries.QUERIES["op9_decontaminate"](spark, SF).where("contaminated").collect()}
    free = {r.doc_id for r in corpus_pipeline.STAGES[2][1](spark, docs, SF).collect()}
    assert free == {r.doc_id for r in docs.select("doc_id").collect()} - hits
    assert corpus_pipeline.run(spark, SF).count() >= 1


def test_language_stage_without_labels_keeps_documents_with_a_letter(spark):
    import corpus_pipeline

    rows = [(1, "Some words", None), (2, "É", None), (3, "12 !!", None), (4, "", None), (5, None, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = corpus_pipeline.language(spark, df, SF)
    assert out.columns == df.columns and {r.doc_id for r in out.collect()} == {1, 2}


def test_pipeline_drops_near_copies_and_benchmark_passages_only(spark):
    """The second and third stage against plain Python over all of sf0.001."""
    import re

    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = queries.table(spark, sf, "documents")
    rows = {r.doc_id: (r.text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for r in docs.collect()}
    sets = {}
    for i, t in rows.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        n = min(5, len(w))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
    root = {i: i for i in rows}

    def find(i):
        return i if root[i] == i else find(root[i])

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    want = {i for i in rows if find(i) == i}
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, sf).collect()} == want and len(want) < len(rows)

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    wins = set()
    for r in queries.table(spark, sf, "benchmark").collect():
        w = words((r.text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        n = min(13, len(w))
        wins |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
    dirty = set()
    for i, t in rows.items():
        w, hit = words(t), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in wins:
                    hit.update(range(k, k + n))
        if hit and 20 * len(hit) >= len(w):
            dirty.add(i)
    assert {r.doc_id for r in corpus_pipeline.benchmark_free(spark, docs, sf).collect()} == set(rows) - dirty and dirty

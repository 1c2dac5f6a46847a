"""Suffix dedup, Jaccard join and the embedding graph against brute force."""

import hashlib
import random
import re
from fractions import Fraction

import numpy as np
import pytest

from tagtrail.llm import embedding_graph, jaccard_join, suffix_dedup


def closure(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        root[find(a)] = find(b)
    return [find(i) for i in range(n)]


def words(rng, n, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    shared = " ".join(words(rng, 70))
    out = [None, "", "   \n", "one", "One", "one two three", "One  two\tthree", "é è ü", "é è Ü"]
    for _ in range(12):
        base = words(rng, rng.choice([5, 30, 120, 400]))
        for _ in range(rng.randint(1, 6)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 40))):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            out.append(" ".join(w))
    out += [" ".join(words(rng, 40)) + " " + shared + " " + " ".join(words(rng, 40)) for _ in range(5)]
    out += ["a" * 300, "a" * 260, "ab" * 200, out[20], out[20]]
    return out


def brute_jaccard(rows, k, share):
    sets = []
    for _, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        n = min(k, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and len(sets[i] & sets[j]) * share.denominator >= share.numerator * len(sets[i] | sets[j])]
    comp = closure(len(rows), pairs)
    ids = [r[0] for r in rows]
    low = {}
    for i, c in enumerate(comp):
        if ids[i] is not None:
            low[c] = min(low.get(c, ids[i]), ids[i])
    links = [sum(i in p for p in pairs) for i in range(len(rows))]
    return sorted(((ids[i], len(sets[i]), low.get(comp[i]), links[i]) for i in range(len(rows))), key=str)


@pytest.mark.parametrize("block", [200_000, 300])
def test_jaccard_equals_brute_force(spark, texts, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", block)
    monkeypatch.setattr(jaccard_join, "LEAF", 2 if block == 300 else 32)
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[-1]), (None, texts[12]), (None, None)]
    df = spark.createDataFrame([(*r, "n", 1) for r in rows], "doc_id long, text string, node string, copies int")
    got = jaccard_join.jaccard_components(df, 4, Fraction(85, 100)).select("doc_id", "n_shingles", "component_id", "n_links").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_jaccard(rows, 4, Fraction(85, 100))


def test_jaccard_hot_shingle_is_not_lost(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "GROUP_MAX", 3)
    rng = random.Random(2)
    base = words(rng, 200)
    rows = []
    for i in range(30):
        w = list(base)
        w[i * 5] = f"x{i}"
        rows.append((i, " ".join(w)))
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, Fraction(85, 100)).collect()
    assert {r.component_id for r in got} == {0} and {r.n_links for r in got} == {29}


@pytest.mark.parametrize("share", [Fraction(1, 5), Fraction(2, 5), Fraction(1, 2), Fraction(85, 100)])
def test_bitmaps_keep_every_pair_of_the_share(share):
    rng = np.random.default_rng(5)
    pool = rng.integers(1, 1 << 63, 700, dtype=np.uint64)
    sets = [np.sort(pool[:n]) for n in (1, 20, 60, 65, 120, 128, 129, 300, 512, 513, 700)] + [np.sort(pool[100:350])]
    got = set()
    for i, j in jaccard_join.bounded_pairs(np.array([len(s) for s in sets]), [jaccard_join.bitmap(s) for s in sets], share):
        got |= {frozenset(x) for x in zip(i.tolist(), j.tolist())}
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if both >= share * (len(sets[i]) + len(sets[j]) - both):
                assert frozenset((i, j)) in got


def test_keep_one(spark, texts):
    rows = [(i, t) for i, t in enumerate(texts)] + [(40, texts[40]), (40, texts[40]), (None, texts[40])]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, component string")
    kept = [tuple(r)[:2] for r in jaccard_join.keep_one(df, 4, Fraction(85, 100)).collect()]
    comps = {r[2] for r in brute_jaccard(rows, 4, Fraction(85, 100)) if r[1]}
    assert sorted(i for i, t in kept if t and t.strip()) == sorted(comps)
    assert sum(not (t and t.strip()) for _, t in kept) == 3
    assert jaccard_join.keep_one(df.limit(0)).count() == 0


def brute_spans(rows, span=50):
    low = {}
    data = [(LAST if i is None else i, (t or "").encode()) for i, t in rows]
    for rank, b in data:
        for s in range(len(b) - span + 1):
            w = b[s : s + span]
            low[w] = min(rank, low.get(w, rank))
    out = []
    for (i, _), (rank, b) in zip(rows, data):
        gone = [False] * len(b)
        for s in range(len(b) - span + 1):
            if low[b[s : s + span]] < rank:
                gone[s : s + span] = [True] * span
        spans = sum(g and not p for g, p in zip(gone, [False, *gone]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


LAST = 1 << 62


@pytest.mark.parametrize("block", [1 << 22, 3000])
def test_suffix_dedup_equals_brute_force(spark, texts, monkeypatch, block):
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    monkeypatch.setattr(suffix_dedup, "PIECE", 1 << 20 if block > 3000 else 1000)
    monkeypatch.setattr(suffix_dedup, "PART", 1 << 14)
    rng = random.Random(3)
    rows = [(rng.randrange(1000), t) for t in texts] + [(5, texts[30]), (5, texts[30]), (None, texts[30]), (None, texts[15])]
    df = spark.createDataFrame([(*r, b"x") for r in rows], "doc_id long, text string, data binary").repartition(3)
    got = suffix_dedup.duplicate_spans(df).drop("starts", "ends").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_spans(rows)
    assert suffix_dedup.duplicate_spans(df.limit(0)).count() == 0


def test_suffix_dedup_bounds_the_surroundings_of_a_hot_anchor(spark, monkeypatch):
    hot = 12
    monkeypatch.setattr(suffix_dedup, "HOT", hot, raising=False)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 2000)
    monkeypatch.setattr(suffix_dedup, "PART", 1 << 13)
    whole, key, decode, unzip = suffix_dedup.smallest_ids, suffix_dedup.KEY, suffix_dedup.split_texts, suffix_dedup.zstandard.decompress

    def bounded(span):
        answer = whole(span)

        def checked(pdf):
            seen = {}
            for data, n in zip(pdf["data"], pdf["n"]):
                raw = unzip(data)
                for t, r in zip(decode(raw[9 * n :], n), raw[8 * n : 9 * n]):
                    seen.setdefault(t[r : r + key], set()).add(t)
            assert max(map(len, seen.values()), default=0) <= hot, "too many surroundings of one anchor string in a task"
            return answer(pdf)

        return checked

    monkeypatch.setattr(suffix_dedup, "smallest_ids", bounded)
    rng = random.Random(6)
    passage = " ".join(words(rng, 30))
    rows = [(i % 90, " ".join(words(rng, 20)) + " " + passage + " " + " ".join(words(rng, 20))) for i in range(100)]
    rows += [(200 + i, rows[i % 5][1]) for i in range(20)] + [(None, rows[7][1]), (400, None), (3, passage), (401, passage * 3)]
    got = suffix_dedup.duplicate_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).drop("starts", "ends").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_spans(rows)


def test_loser_tree_marks_strings_of_two_runs():
    rng = random.Random(9)
    runs = [sorted({bytes(rng.choice(b"ab\0") for _ in range(16)) if rng.random() < 0.5 else bytes(rng.choice(b"ab") for _ in range(4)) + b"c" * 12 for _ in range(60)}) for _ in range(7)] + [[]]
    coded = []
    for r in runs:
        lcp = [0] + [next((k for k in range(16) if a[k] != b[k]), 16) for a, b in zip(r, r[1:])]
        raw = bytes(lcp[: len(r)]) + b"".join(t[c:] for t, c in zip(r, lcp))
        coded.append(suffix_dedup.unpack_run(suffix_dedup.zstandard.compress(raw), len(r)))
        assert [k.to_bytes(16, "big") for k in coded[-1][1]] == r
    marks = suffix_dedup.repeated(coded)
    for r, m in zip(runs, marks):
        assert [bool(x) for x in m] == [sum(t in other for other in runs) > 1 for t in r]


@pytest.mark.parametrize("shard_max", [1500, 20])
def test_embedding_graph_equals_brute_force(spark, monkeypatch, shard_max):
    monkeypatch.setattr(embedding_graph, "SHARD_MAX", shard_max)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(120, 16))
    vecs = [base[i % 30] + rng.normal(size=16) * 0.05 * (i % 5) if i < 90 else base[i] for i in range(120)]
    rows = [(i, [float(x) for x in v], i % 3) for i, v in enumerate(vecs)] + [(500, None, 1), (501, [], 1), (502, [0.0] * 16, 1), (503, [float("nan")] + [1.0] * 15, 1), (504, [None] + [1.0] * 15, 1), (505, rows_of(vecs[0]), None), (506, [1e-30 * x for x in rows_of(vecs[0])], 0), (7, rows_of(vecs[7]), 1), (507, [1.0, 2.0], 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, node string")
    got = embedding_graph.near_duplicates(df).collect()
    a = [None if r[2] is None or not r[1] or any(x is None or not np.isfinite(x) for x in r[1]) or not any(r[1]) else np.array(r[1], dtype="f4").astype("f8") for r in rows]
    unit = [None if x is None else x / np.abs(x).max() / np.linalg.norm(x / np.abs(x).max()) for x in a]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.93]
    comp = closure(len(rows), pairs)
    low = {}
    for i, c in enumerate(comp):
        low[c] = min(low.get(c, rows[i][0]), rows[i][0])
    want = sorted((rows[i][0], sum(i in p for p in pairs), low[comp[i]], rows[i][0] == low[comp[i]]) for i in range(len(rows)))
    assert len(pairs) > 50
    assert sorted(tuple(r)[:4] for r in got) == want
    assert {r.audited_recall for r in got} == {1.0}


def hot_and_pairs():
    """(vec_id, embedding, label) rows: a third is one group of near copies, the rest are pairs; and the true links."""
    rng = np.random.default_rng(8)
    hot = rng.normal(size=16)
    vecs = [hot + rng.normal(size=16) * 0.02 for _ in range(100)]
    for _ in range(100):
        v = rng.normal(size=16)
        vecs += [v, v + rng.normal(size=16) * 0.02]
    rows = [(i, rows_of(v), 1) for i, v in enumerate(vecs)]
    x = embedding_graph.unit([np.array(r[1], dtype="f4") for r in rows])
    return rows, (x @ x.T >= 0.93).sum(axis=1) - 1


def test_embedding_audit_sees_links_lost_outside_a_hot_group(spark, monkeypatch):
    rows, want = hot_and_pairs()
    assert want.max() >= 99 and (want < 20).sum() >= 200
    whole = embedding_graph.link_rows
    monkeypatch.setattr(embedding_graph, "link_rows", lambda *a: whole(*a).where("links > 20"))
    got = embedding_graph.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert {r.vec_id: r.n_links for r in got} == dict(enumerate(want))
    assert {r.audited_recall for r in got} == {1.0}


def test_embedding_pairs_of_all_blocks(spark, monkeypatch):
    rows, want = hot_and_pairs()
    monkeypatch.setattr(embedding_graph, "ROUNDS", 0)
    monkeypatch.setattr(embedding_graph, "SHARD_MAX", 60)
    monkeypatch.setattr(embedding_graph, "BUCKET", 70)
    monkeypatch.setattr(embedding_graph, "ASKED", 10)
    got = embedding_graph.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert {r.vec_id: r.n_links for r in got} == dict(enumerate(want))


def two_shards(spark, monkeypatch):
    """Nodes of two shards that both hold every node, in two blocks each; their blocks' sizes; true links."""
    monkeypatch.setattr(embedding_graph, "SHARD", 150)
    monkeypatch.setattr(embedding_graph, "SHARD_MAX", 200)
    rows, want = hot_and_pairs()
    nodes = spark.createDataFrame([(i, v, 1, 5) for i, v, _ in rows], "node long, vec array<float>, copies long, family long")
    sizes = nodes.selectExpr("explode(array(0, 1)) AS shard", "pmod(xxhash64(node, shard), 2L) AS block").groupBy("shard", "block").count().collect()
    assert embedding_graph.assign(nodes, 2).groupBy("shard").count().collect() == [(0, 300), (1, 300)]
    return nodes, {k: {r["count"] for r in sizes if r.shard == k} for k in (0, 1)}, {i: int(n) for i, n in enumerate(want) if n}


def linked(nodes):
    rows = embedding_graph.link_rows(nodes, 0.93, 2).groupBy("u").sum("links", "near").collect()
    assert all(r[1] == r[2] for r in rows)
    return {r.u: r[1] for r in rows}


def test_embedding_links_come_from_the_search_alone(spark, monkeypatch):
    nodes, _, _ = two_shards(spark, monkeypatch)
    monkeypatch.setattr(embedding_graph, "in_range", lambda q, x, lists, start, threshold: np.empty(0, np.int64))
    assert linked(nodes) == {}


@pytest.mark.parametrize("blind", [0, 1])
def test_embedding_links_that_one_shard_misses_still_count(spark, monkeypatch, blind):
    nodes, sizes, want = two_shards(spark, monkeypatch)
    assert not sizes[0] & sizes[1]
    whole, lost = embedding_graph.in_range, sizes[blind]
    monkeypatch.setattr(embedding_graph, "in_range", lambda q, x, *rest: np.empty(0, np.int64) if len(x) in lost else whole(q, x, *rest))
    assert linked(nodes) == want


def test_embedding_doubles_keep_their_range(spark):
    rows = [(1, [1e200, 2e200], 1), (2, [1e-200, 2e-200], 1), (3, [2e200, 1e200], 1), (4, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_graph.near_duplicates(df).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (0, 3), 4: (2, 1)}


def rows_of(v):
    return [float(x) for x in v]


def test_bitmaps_of_a_large_group_take_bounded_memory(monkeypatch):
    import tracemalloc

    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, 40 + i % 9).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for i in range(1000)]
    sizes, bits = np.array([len(s) for s in sets]), [jaccard_join.bitmap(s) for s in sets]

    def pairs():
        return {(min(x), max(x)) for i, j in jaccard_join.bounded_pairs(sizes, bits, Fraction(3, 5)) for x in zip(i.tolist(), j.tolist())}

    tracemalloc.start()
    try:
        n = sum(len(i) for i, _ in jaccard_join.bounded_pairs(sizes, bits, Fraction(9, 10)))
        assert tracemalloc.get_traced_memory()[1] < 16 << 20
    finally:
        tracemalloc.stop()
    found = pairs()
    assert len(found) > n
    monkeypatch.setattr(jaccard_join, "PAIR_ROWS", 300)
    assert pairs() == found

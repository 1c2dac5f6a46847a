"""Fuzzy leaders equal the sequential greedy pass; LCS equals a DP."""

import random

import pytest
from pyspark.sql import functions as F

from tagtrail.functions.similarity import indel_ratio, lcs_length, token_set_ratio
from tagtrail.operators import fuzzy


def _dp(a, b):
    m = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            m[i + 1][j + 1] = m[i][j] + 1 if a[i] == b[j] else max(m[i][j + 1], m[i + 1][j])
    return m[-1][-1]


def test_lcs_bit_parallel():
    rnd = random.Random(3)
    for _ in range(2000):
        a = "".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 10)))
        b = "".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 10)))
        assert lcs_length(a, b) == _dp(a, b)
    assert indel_ratio("", "") == 100 and indel_ratio("abc", "abc") == 100


def test_leaders_equal_sequential_greedy(spark):
    rnd = random.Random(5)
    words = []
    for w in ["retitioning", "eauenaux", "interesting", "widgetry", "gizmos"]:
        words.append(w)
        for _ in range(5):
            x = list(w)
            i = rnd.randrange(len(x))
            if rnd.random() < 0.5:
                x.insert(i, rnd.choice("aeiou"))
            else:
                del x[i]
            words.append("".join(x))
    words = list(dict.fromkeys(words))
    df = spark.createDataFrame([(w,) for w in words], "tag string")
    threshold, seed = 85, 7
    got = {r.tag: (r.leader, r.is_leader) for r in fuzzy.canonical_tags(df, threshold, "simple", seed).collect()}
    pr = sorted(df.select("tag", F.xxhash64("tag", F.lit(seed)).alias("h")).collect(), key=lambda r: (r.h, r.tag))
    rank = {r.tag: i for i, r in enumerate(pr)}
    leaders = []
    for r in pr:
        if not any(indel_ratio(r.tag, l) >= threshold for l in leaders):
            leaders.append(r.tag)
    for w in words:
        if w in leaders:
            assert got[w] == (w, True)
        else:
            best = min((l for l in leaders if indel_ratio(w, l) >= threshold), key=rank.get)
            assert got[w] == (best, False)


def _greedy(df, threshold, seed, prep):
    pr = sorted(df.select("tag", F.xxhash64("tag", F.lit(seed)).alias("h")).where("tag is not null").distinct().collect(), key=lambda r: (r.h, r.tag))
    leaders, out = [], {}
    for r in pr:
        near = [x for x in leaders if indel_ratio(prep(r.tag), prep(x)) >= threshold]
        if not near:
            leaders.append(r.tag)
        out[r.tag] = (near[0], False) if near else (r.tag, True)
    return out


def _sorted_words(t):
    return " ".join(sorted("".join(c if c.isalnum() else " " for c in t.lower()).split()))


def test_sort_mode_joins_tags_of_one_prepared_string(spark):
    rnd = random.Random(11)
    tags = ["Red", "red", "RED!", "", "!", "wool hat", "Hat, wool", "hat wools", "ab", "ba"]
    for w in ["red woollen hats", "green tea", "silver candlestick"]:
        for _ in range(12):
            x = list(w)
            i = rnd.randrange(len(x))
            x[i] = rnd.choice("abcR !") if rnd.random() < 0.5 else ""
            tags.append("".join(x))
    df = spark.createDataFrame([(t,) for t in tags] + [("Red",), (None,)], "tag string")
    for threshold in (80, 90):
        got = {r.tag: (r.leader, r.is_leader) for r in fuzzy.canonical_tags(df, threshold, "sort", 7).collect()}
        assert got == _greedy(df, threshold, 7, _sorted_words)


def test_short_words_by_deletion_variants(spark):
    rnd = random.Random(2)
    tags = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randint(1, 16))) for _ in range(250)})
    tags = sorted(set(tags) | {t[:i] + rnd.choice("abc") + t[i + 1:] for t in tags for i in (0, len(t) // 2)})
    df = spark.createDataFrame([(t,) for t in tags], "tag string")
    for threshold in (75, 90):
        pairs = fuzzy.similar_pairs(df.select(F.col("tag").alias("id"), F.col("tag").alias("s")), threshold)
        got = {(r.a, r.b) for r in pairs.collect()}
        assert got == {(a, b) for i, a in enumerate(tags) for b in tags[i + 1:] if indel_ratio(a, b) >= threshold}


def test_common_segments_make_no_candidates(spark):
    """Strings that share a segment, two (or one or three) characters apart in length: only those that leave one string are compared."""
    rnd = random.Random(6)
    words = {"ation" + "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)) for n in (4, 6) for _ in range(400)}
    words |= {"ationsth" + "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)) for n in (6, 7, 9) for _ in range(300)}
    words |= {"ationxyzab", "ationxyzabcd", "tionxyzab", "ationsthabcdef", "ationsthabcdefghi", "ationsthabcdegh"}
    strings = spark.createDataFrame([(w, w) for w in sorted(words)], "id string, s string")
    assert fuzzy.candidate_pairs(strings, 90).count() < len(words)
    got = {(r.a, r.b) for r in fuzzy.similar_pairs(strings, 90).collect()}
    tags = sorted(words)
    assert got == {(a, b) for i, a in enumerate(tags) for b in tags[i + 1:] if abs(len(a) - len(b)) < 5 and indel_ratio(a, b) >= 90}


def test_lookup_takes_the_first_similar_leader(spark):
    mapping = fuzzy.canonical_tags(spark.createDataFrame([(t,) for t in ["candlestick", "hat wool", "green tea"]], "tag string"), 90, "sort", 3)
    queries = spark.createDataFrame([(t,) for t in ["Wool hat", "candlesticks", "green tea", "nothing"]] + [(None,)], "query string")
    got = {r["query"]: r.leader for r in fuzzy.lookup(queries, mapping, 90, "sort", 3, "?").collect()}
    assert got == {"Wool hat": "hat wool", "candlesticks": "candlestick", "green tea": "green tea", "nothing": "?"}


def test_canonicalise_replaces_tags_by_leaders(spark):
    mapping = fuzzy.canonical_tags(spark.createDataFrame([("Red Shoe",), ("shoe red",), ("blue hat",)], "tag string"), 90, "sort")
    leader = {r.tag: r.leader for r in mapping.collect()}
    assert leader["Red Shoe"] == leader["shoe red"] and leader["blue hat"] == "blue hat"
    lists = spark.createDataFrame([(1, ["shoe red", "blue hat", "unseen", "Red Shoe"]), (2, ["blue hat"])], "pid long, tags array<string>")
    got = {r.pid: r.tags for r in fuzzy.canonicalise(lists, mapping).collect()}
    assert got == {1: [leader["shoe red"], "blue hat", "unseen", leader["Red Shoe"]], 2: ["blue hat"]}


def _set_words(t):
    return " ".join(sorted(set("".join(c if c.isalnum() else " " for c in t.lower()).split())))


def test_token_set_ratio_by_hand():
    assert token_set_ratio("hat red", "hat red wool") == 100  # one inside the other
    assert token_set_ratio("red woolen", "red woollen") == 95  # 1 edit of 21 characters
    assert token_set_ratio("abcdefghij x", "abcdefghij yyyyyyyy") == 91  # common words against the first: 2 of 22
    assert token_set_ratio("ab", "cd") == 0 and token_set_ratio("", "") == 0 and token_set_ratio("a", "") == 0


def _set_tags():
    rnd = random.Random(17)
    words = ["red", "wool", "woollen", "hat", "a", "b", "of", "candlestick", "extraordinary", "tea", "green"]
    tags = {"Red!", "red", "", "!!", "red red hat", "hat, Red", "extraordinary abc", "extraordinary xyz", "extraordinary abcd"}
    for _ in range(100):
        k = rnd.choice([1, 2, 2, 3, 3, 4, 5, 6, 7, 9])
        t = [rnd.choice(words) for _ in range(k)]
        if rnd.random() < 0.6:
            i = rnd.randrange(k)
            at = rnd.randrange(len(t[i]) + 1)
            t[i] = t[i][:at] + rnd.choice(["", "x", "s"]) + t[i][at + rnd.randint(0, 1):]
        tags.add(" ".join(w for w in t if w))
    return sorted(tags)


@pytest.mark.parametrize("threshold", [75, 90])
def test_set_mode_candidates_lose_no_pair(spark, threshold):
    strings = sorted({_set_words(t) for t in _set_tags()} - {""})
    pairs = fuzzy.similar_pairs(spark.createDataFrame([(s, s) for s in strings], "id string, s string"), threshold, "set")
    got = {(r.a, r.b): r.score for r in pairs.collect()}
    scores = {(a, b): token_set_ratio(a, b) for i, a in enumerate(strings) for b in strings[i + 1:]}
    assert got == {p: s for p, s in scores.items() if s >= threshold}


def test_set_mode_equals_sequential_greedy(spark):
    tags = _set_tags()
    df = spark.createDataFrame([(t,) for t in tags] + [("red",), (None,)], "tag string")
    got = {r.tag: (r.leader, r.is_leader) for r in fuzzy.canonical_tags(df, 90, "set", 7).collect()}
    order = [r.tag for r in df.where("tag is not null").distinct().orderBy(F.xxhash64("tag", F.lit(7)), "tag").collect()]
    leaders, want = [], {}
    for t in order:
        near = [x for x in leaders if token_set_ratio(_set_words(t), _set_words(x)) >= 90]
        leaders += [] if near else [t]
        want[t] = (near[0], False) if near else (t, True)
    assert got == want
    assert got[""] == ("", True) and got["!!"] == ("!!", True)


def test_set_mode_pairs_no_tags_by_a_hot_word_alone(spark):
    """One word in every tag: candidates stay far below all pairs."""
    rnd = random.Random(4)
    tags = ["red " + "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(1500)]
    cand = fuzzy.candidate_pairs(spark.createDataFrame([(t, _set_words(t)) for t in tags], "id string, s string"), 90, "set")
    assert cand.count() < 0.02 * len(tags) ** 2 / 2


def test_set_mode_lookup(spark):
    mapping = fuzzy.canonical_tags(spark.createDataFrame([("wool hat",), ("green tea",), ("",)], "tag string"), 90, "set", 3)
    queries = spark.createDataFrame([(q,) for q in ["hat", "Tea; green and hot", "", "wool hat", "nothing"]], "query string")
    got = {r["query"]: r.leader for r in fuzzy.lookup(queries, mapping, 90, "set", 3, "?").collect()}
    assert got == {"hat": "wool hat", "Tea; green and hot": "green tea", "": "?", "wool hat": "wool hat", "nothing": "?"}


def test_set_mode_without_tags(spark):
    assert fuzzy.canonical_tags(spark.createDataFrame([], "tag string"), 90, "set").count() == 0

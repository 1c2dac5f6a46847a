"""URL filter, whitening and phrase mining against plain Python versions."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tagtrail.llm import collocations, queries, url_filter, whitening
from tagtrail.llm.common import table

SF = "/root/testdata/sf0.001"
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(AZ), re.match(r"[^?#]*", rest[len(host) :])[0]


def url_verdict(url, rules):
    host, path = url_parts(url)
    fits = [(len(h) + len(p), len(h), h + p, v) for v, h, p in rules if h and v and (host == h or host.endswith("." + h)) and path.startswith(p or "")]
    fits = [f for f in fits if f[0] == max(x[0] for x in fits)]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


URLS = [None, "", "no scheme", "http://", "http://net", "http://net/", "HTTP://A.B.NET/x", "http://Ünet.net/é", "http://a.net?x=/en/", "http://a.net#/", "x://example.net/en/1#t", "x://example.net/en", "x://y://example.net/en/", "http://badexample.net/en/", "http://example.com/de/5?a", "http://m.example.com/de", "https://w.example.org/fr/", "a\n://example.org/fr/x", "http://" + "a." * 3000 + "net/" + "p/" * 5000, "http://.net/", "http://net./", "http://a..net/"]
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"), ("allow", "a.net", None), ("block", None, "/"), (None, "org", "/"), ("block", "", "/")]


def judged(df):
    return sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1:3]))


@pytest.mark.parametrize("bound", [url_filter.MAX_INDEX_BYTES, 0])
def test_url_filter_equals_a_plain_loop(spark, monkeypatch, bound):
    monkeypatch.setattr(url_filter, "MAX_INDEX_BYTES", bound)
    rng = random.Random(1)
    hosts = ["net", "a.net", "b.a.net", "com", "x.com", "y.x.com", "io"]
    paths = ["", "/", "/a", "/a/", "/ab", "/b/c", "/é/"]
    rules = RULES + [(rng.choice(["allow", "block"]), h, p) for h in hosts for p in paths if rng.random() < 0.4]
    once = {}
    for v, h, p in rules:
        if h and v:
            once[h, p or ""] = max(v, once.get((h, p or ""), ""))
    plain = [(v, h, p) for (h, p), v in once.items()]
    urls = URLS + [f"http://{rng.choice(['', 'm.', 'www.'])}{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?q', 'x', '#f'])}" for _ in range(400)]
    pages = spark.createDataFrame([(i if i else None, u, "h", "p", "r", "v") for i, u in enumerate(urls)], "page_id long, url string, host string, path string, rule string, verdict string")
    pages = pages.union(pages.limit(3))
    got = judged(url_filter.filter_urls(pages, url_filter.rule_table(spark, rules)))
    rows = [(r.page_id, *url_verdict(r.url, plain)) for r in pages.collect()]
    assert got == sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1:3]))
    assert url_filter.filter_urls(pages.where("false"), url_filter.rule_table(spark, rules)).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(pages, url_filter.rule_table(spark, [])).collect()} == {"allow"}


def test_url_digest_collisions_never_decide(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter, "digests", lambda strings: np.full(len(strings), 7, np.uint64))
    (tmp_path / "rules").write_bytes(url_filter.layout(["net", "a.net", "org"], ["/", "/x", "/x/"], ["block", "allow", "block"]))
    index = url_filter.Index(str(tmp_path / "rules"))
    found = index.best(["a.net", "b.net", "org", "com"], ["/xy", "/xy", "/x", "/x/"])
    assert [None if f is None else index.full(f[0]) for f in found] == [b"a.net/x", b"net/", None, None]


def test_url_query_equals_a_plain_loop(spark):
    got = judged(queries.op11_url_filter(spark, SF))
    want = [(r.page_id, *url_verdict(r.url, queries.URL_RULES)) for r in table(spark, SF, "pages").collect()]
    assert got == sorted(want, key=lambda r: (r[0] is None, r[0] or 0, r[1:3]))


def check_whitening(rows, vectors, k):
    """``rows`` of one fit against an eigendecomposition of the plain covariance."""
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for v in vectors], dtype=object)
    n, total = len(x), x.sum(axis=0)
    a = (n * x - total).astype(float) / n
    e, axes = np.linalg.eigh(a.T @ a / n)
    e, axes = e[::-1], axes[:, ::-1]
    live = int((e[:k] > 1e-13 * e[0]).sum())
    of = {}
    for r in rows:
        of.setdefault(r.vec_id, {})[r.component] = r
        assert r.n == n and r.deviation == int(((n * x[r.vec_id] - total) ** 2).sum())
        assert r.explained == pytest.approx(e[r.component - 1] / e.sum(), rel=1e-9, abs=1e-12)
        assert r.identity_error <= 1e-9
        assert (r.whitened is None) == (r.component > live)
    for j in range(live):
        white = np.array([of[i][j + 1].whitened for i in range(n)])
        want = a @ axes[:, j] / np.sqrt(e[j])
        assert min(np.abs(white - want).max(), np.abs(white + want).max()) < 1e-6


@pytest.mark.parametrize("shape", ["plain", "dependent", "few", "scales"])
def test_whitening_equals_eigenvectors(spark, shape):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(300, 12)) * np.arange(1, 13) * 5
    if shape == "dependent":
        v[:, 3], v[:, 5], v[:, 11] = v[:, 2], 7.0, np.floor(v[:, 11])
        v[:, 6] = v[:, 11] * 2
    if shape == "few":
        v = v[:5]
    if shape == "scales":
        v[:, 0] *= 1e6
        v[:, 1] *= 1e-2
    df = spark.createDataFrame([(i, row.tolist(), 0, "x") for i, row in enumerate(v)], "vec_id long, embedding array<double>, n long, whitened string").repartition(5)
    out = whitening.whiten(df).collect()
    assert len(out) == len(v) * 8
    check_whitening(out, v.tolist(), 8)


def test_whitening_odd_rows(spark, monkeypatch):
    odd = [(0, [1.0, 2.0, 4.0]), (1, [0.5, -2.0, 1.0]), (2, [3.0, 3.0, 3.0]), (3, [1.0, 2.0, 4.0]), (None, None), (9, []), (9, [1.0, None, 2.0]), (9, [1.0, float("nan"), 2.0]), (9, [float("inf"), 1.0, 2.0])]
    df = spark.createDataFrame(odd, "vec_id long, embedding array<double>")
    out = whitening.whiten(df).collect()
    assert sorted((r.vec_id, r.component) for r in out) == [(i, c) for i in range(4) for c in (1, 2, 3)]
    check_whitening(out, [v for _, v in odd[:4]], 3)
    monkeypatch.setattr(whitening, "FAN", 2)  # matrices are summed in several rounds
    check_whitening(whitening.whiten(df.repartition(9)).collect(), [v for _, v in odd[:4]], 3)
    assert whitening.whiten(df.where("vec_id = 9")).collect() == []
    one = whitening.whiten(df.where("vec_id = 2")).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(c, 1, 0, None, None, None) for c in (1, 2, 3)]
    with pytest.raises(ValueError):
        whitening.whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>"))


def test_whitening_exact_beyond_64_bits(spark):
    rows = [(0, [2.0**45, 0.0]), (1, [-(2.0**45), 1.0]), (2, [1.0, 5.0])]
    out = {r.vec_id: r.deviation for r in whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    x = [[int(c) * 1024 + 100_000 for c in v] for _, v in rows]
    total = [sum(c) for c in zip(*x)]
    assert out == {i: sum((3 * c - s) ** 2 for c, s in zip(v, total)) for i, v in enumerate(x)}


def test_whitening_query(spark):
    rows = table(spark, SF, "embeddings").collect()
    out = queries.op12_whitening(spark, SF).collect()
    assert dict(queries.op12_whitening(spark, SF).dtypes)["deviation"] == "bigint" and len(out) == 8 * len(rows)
    at = {r.vec_id: i for i, r in enumerate(rows)}
    check_whitening([r for r in out if r.vec_id in at], [list(map(float, r.embedding)) for r in sorted(rows, key=lambda r: r.vec_id)], 8)


def mined(rows, max_words=4, min_count=30, top=2000):
    """Plain version of the contract over (text, lang) rows."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(AZ)):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, max_words + 1) for i in range(len(w) - k + 1))
    cand = {p: a for p, a in f.items() if a >= min_count and len(p[1]) > 1}
    longest = Counter()
    for (lang, w), a in cand.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                longest[lang, w[i : i + k]] = max(longest[lang, w[i : i + k]], a)
    out = {}
    for (lang, w), a in cand.items():
        if 100 * longest[lang, w] >= 80 * a:
            continue
        score, _, l, r = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), l, r))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, rows in out.items() for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top]))


def phrase_rows(df):
    return sorted((r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def corpus(seed, docs):
    rng = random.Random(seed)
    words = ["a", "B", "é", "ö", "日本", "x1", "it's", "\u00a0", "-", "zz"]
    passage = "a B é ö zz"
    text = lambda: "".join(rng.choice([rng.choice(words) + " ", passage + rng.choice([" ", ", "]), "\t", ". ", "\n", rng.choice(words) + "! "]) for _ in range(rng.randint(0, 60)))
    return [(rng.choice([i, i, None]), text(), rng.choice(["en", "EN", None, "und"])) for i in range(docs)]


ODD = [(1, None, "en"), (2, "", None), (2, "", None), (None, " \t\n.", "en"), (5, "One. two three " * 40, None)]


@pytest.mark.parametrize("sample", [collocations.SAMPLE, 1, 1 << 40])
def test_phrases_equal_a_plain_count(spark, monkeypatch, sample):
    """Whatever the sample proposes (with 2**40, nothing) the passes close."""
    monkeypatch.setattr(collocations, "SAMPLE", sample)
    rows = corpus(4, 250) + ODD
    df = spark.createDataFrame([(*r, 1, "n") for r in rows], "doc_id long, text string, lang string, n long, phrase string").repartition(3)
    got = phrase_rows(collocations.collocations(df, min_count=4, top=40))
    want = mined([r[1:] for r in rows], min_count=4, top=40)
    assert len(want) > 90 and got == want


def test_phrases_of_long_texts_in_runs(spark, monkeypatch):
    for name, value in (("RUN_BYTES", 64), ("CHUNK_WORDS", 50), ("HOT", 2), ("HELD", 3), ("MARK_BITS", 1 << 12)):
        monkeypatch.setattr(collocations, name, value)
    rows = corpus(9, 30) + [(99, "one two three four five. " * 300 + "x" * 500, "en"), *ODD]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert phrase_rows(collocations.collocations(df, min_count=3)) == mined([r[1:] for r in rows], min_count=3)
    assert phrase_rows(collocations.collocations(df.where("doc_id < 0"), min_count=3)) == []


def test_phrase_scores_beyond_64_bits(spark, monkeypatch):
    huge = spark.createDataFrame([("en", "", 4 * 10**18), ("en", "a", 3 * 10**18), ("en", "b", 3 * 10**18 + 1), ("en", "a b", 2 * 10**18 + 7)], "lang string, phrase string, n long")
    monkeypatch.setattr(collocations, "frequent_phrases", lambda *a: huge)
    row = collocations.collocations(huge).first()
    assert (row.score, row.a, row.l, row.r, row.n) == (2_000_000 * (2 * 10**18 + 7) // (6 * 10**18 + 1), 2 * 10**18 + 7, 3 * 10**18, 3 * 10**18 + 1, 4 * 10**18)


def test_phrase_query_equals_a_plain_count(spark):
    docs = table(spark, SF, "documents").select("text", "lang").collect()
    assert phrase_rows(queries.op13_collocations(spark, SF)) == mined(docs)

"""Oracle SQL for scoring, metrics, tags, BM25 / IoU."""

from __future__ import annotations

from .fixtures_sql import with_ctes

O: dict[str, str] = {}
W = with_ctes


def metrics_ctes(p: str, scores: str, truth: str, ks=(5, 10, 20)) -> str:
    """CTEs computing per-split metrics into ``{p}out`` from scores
    (order_id, pid, score) and truth (order_id, split, pid)."""
    K = max(ks)
    sums, avgs = [], []
    for k in ks:
        sums += [
            f"coalesce(sum(CASE WHEN h.rank <= {k} THEN 1 END), 0) AS h{k}",
            f"coalesce(sum(CASE WHEN h.rank <= {k} THEN 1.0 / h.rank END), 0.0) AS rr{k}",
            f"coalesce(sum(CASE WHEN h.rank <= {k} THEN 1.0 / log2(h.rank + 1) END), 0.0) AS dcg{k}",
        ]
    for k in ks:
        avgs.append(f'round(avg(h{k} / least(n_true, {k})), 6) AS "hr@{k}"')
    for k in ks:
        avgs.append(f'round(avg(rr{k}), 6) AS "mrr@{k}"')
    for k in ks:
        idcg = f"list_sum(list_transform(range(1, least(n_true, {k}) + 1), lambda i: 1.0 / log2(i + 1)))"
        avgs.append(f'round(avg(dcg{k} / {idcg}), 6) AS "ndcg@{k}"')
    return f"""
, {p}rk AS (SELECT order_id, pid, row_number() OVER (PARTITION BY order_id ORDER BY score DESC, pid) AS rank FROM {scores})
, {p}tr AS (SELECT order_id, any_value(split) AS split, count(DISTINCT pid) AS n_true FROM {truth} GROUP BY order_id)
, {p}hits AS (SELECT r.order_id, r.rank FROM {p}rk r JOIN (SELECT DISTINCT order_id, pid FROM {truth}) t
              ON r.order_id = t.order_id AND r.pid = t.pid WHERE r.rank <= {K})
, {p}po AS (SELECT t.order_id, t.split, t.n_true, {", ".join(sums)}
            FROM {p}tr t LEFT JOIN {p}hits h ON t.order_id = h.order_id GROUP BY t.order_id, t.split, t.n_true)
, {p}out AS (SELECT split, count(*) AS n_orders, {", ".join(avgs)} FROM {p}po GROUP BY split)
"""


def bm25_ctes(p: str, corpus_sql: str, k1: float, b: float, alpha: float) -> str:
    """CTEs ``{p}docs {p}cs {p}tf {p}terms {p}post`` for a corpus (doc_id, tokens)."""
    k1, b, alpha = (f"CAST({x} AS DOUBLE)" for x in (k1, b, alpha))
    idf = "ln(n_docs - df + 0.5) - ln(df + 0.5)"
    return f"""
, {p}corpus AS ({corpus_sql})
, {p}docs AS (SELECT doc_id, len(tokens) AS dl FROM {p}corpus)
, {p}cs AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM {p}docs)
, {p}tf AS (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(tokens) AS term FROM {p}corpus) x GROUP BY 1, 2)
, {p}df AS (SELECT term, count(*) AS df FROM {p}tf GROUP BY 1)
, {p}terms AS (SELECT term, df, {idf} AS idf FROM {p}df, {p}cs WHERE {idf} > {alpha})
, {p}post AS (SELECT f.term, f.doc_id, f.tf, t.idf * f.tf * ({k1} + 1) / (f.tf + {k1} * (1 - {b} + {b} * d.dl / c.avgdl)) AS w
             FROM {p}tf f JOIN {p}terms t ON f.term = t.term JOIN {p}docs d ON f.doc_id = d.doc_id, {p}cs c)
"""


TAG_CORPUS = "SELECT pid AS doc_id, tags AS tokens FROM fx_tags WHERE pid IN (SELECT pid FROM fx_products)"
DOC_CORPUS = "SELECT doc_id, tokens FROM fx_tag_docs"

# per-position term counts of the next-item prefixes
CNT = """
, _lt AS (SELECT x.order_id, x.pos, x.n_pos, t.tags FROM (
    SELECT order_id, len(prefix) AS n_pos, unnest(prefix) AS pid, generate_subscripts(prefix, 1) - 1 AS pos FROM fx_next_last) x
    JOIN fx_tags t ON t.pid = x.pid)
, _cnt AS (SELECT order_id, pos, any_value(n_pos) AS n_pos, term, count(*) AS cnt
           FROM (SELECT order_id, pos, n_pos, unnest(tags) AS term FROM _lt) y GROUP BY order_id, pos, term)
"""

QUERIES = {
    "union": "SELECT order_id, term, CAST(max(cnt) AS BIGINT) AS qty FROM _cnt GROUP BY 1, 2",
    "intersection": "SELECT order_id, term, CAST(min(cnt) AS BIGINT) AS qty FROM _cnt GROUP BY 1, 2 HAVING count(*) = any_value(n_pos)",
    "sum": "SELECT order_id, term, CAST(sum(cnt) AS BIGINT) AS qty FROM _cnt GROUP BY 1, 2",
    "last": "SELECT order_id, term, CAST(cnt AS BIGINT) AS qty FROM _cnt WHERE pos = n_pos - 1",
    "recency": "SELECT order_id, term, CAST(sum(cnt * (pos + 1)) AS BIGINT) AS qty FROM _cnt GROUP BY 1, 2",
}


def q_cte(fn: str, name: str = "_q") -> str:
    return CNT + f", {name} AS ({QUERIES[fn]})\n"


def tag_bm25_scores(p: str, fn: str) -> str:
    """CTEs ending in ``{p}sc(order_id, pid, score)``: BM25 (k1 .75, alpha 1) over fx_tags."""
    return (q_cte(fn, f"{p}q") + bm25_ctes(p, TAG_CORPUS, 0.75, 0.75, 1.0) +
            f", {p}sc AS (SELECT q.order_id, p.doc_id AS pid, round(sum(q.qty * p.w), 9) AS score "
            f"FROM {p}q q JOIN {p}post p ON q.term = p.term GROUP BY 1, 2)\n").replace(", _lt AS", f", {p}lt AS").replace(
        "FROM _lt", f"FROM {p}lt").replace(", _cnt AS", f", {p}cnt AS").replace("FROM _cnt", f"FROM {p}cnt")


def tag_iou_scores(p: str) -> str:
    return (q_cte("union", f"{p}q") + f"""
, {p}qs AS (SELECT DISTINCT order_id, term FROM {p}q)
, {p}ds AS (SELECT DISTINCT pid, term FROM (SELECT pid, unnest(tags) AS term FROM fx_tags WHERE pid IN (SELECT pid FROM fx_products)) x)
, {p}nq AS (SELECT order_id, count(*) AS nq FROM {p}qs GROUP BY 1)
, {p}nd AS (SELECT pid, count(*) AS nd FROM {p}ds GROUP BY 1)
, {p}ni AS (SELECT q.order_id, d.pid, count(*) AS ni FROM {p}qs q JOIN {p}ds d ON q.term = d.term GROUP BY 1, 2)
, {p}sc AS (SELECT i.order_id, i.pid, round(ni / (nq + nd - ni), 9) AS score FROM {p}ni i JOIN {p}nq USING (order_id) JOIN {p}nd USING (pid))
""").replace(", _lt AS", f", {p}lt AS").replace("FROM _lt", f"FROM {p}lt").replace(", _cnt AS", f", {p}cnt AS").replace("FROM _cnt", f"FROM {p}cnt")


BASE_MERGED = """
, _sc AS (SELECT order_id, pid, CAST(max(i) AS DOUBLE) AS score FROM (
    SELECT order_id, unnest(loaded_pids) AS pid, generate_subscripts(loaded_pids, 1) AS i FROM fx_merged) x GROUP BY 1, 2)
, _truth AS (SELECT order_id, split, unnest(products) AS pid FROM fx_merged)
"""
BASE_NEXT = """
, _bsc AS (SELECT order_id, pid, CAST(max(i) AS DOUBLE) AS score FROM (
    SELECT order_id, unnest(prefix) AS pid, generate_subscripts(prefix, 1) AS i FROM fx_next_last) x GROUP BY 1, 2)
, _ntruth AS (SELECT order_id, split, target AS pid FROM fx_next_last)
"""

O["baseline_score"] = W(BASE_MERGED + "SELECT * FROM _sc", "fx_merged")
O["rank_products"] = W(BASE_MERGED + """SELECT * FROM (SELECT order_id, pid, score,
    row_number() OVER (PARTITION BY order_id ORDER BY score DESC, pid) AS rank FROM _sc) x WHERE rank <= 20""", "fx_merged")
O["ranking_metrics"] = W(BASE_MERGED + metrics_ctes("m_", "_sc", "_truth") + "SELECT * FROM m_out", "fx_merged")
O["metric_hr"] = W(BASE_MERGED + metrics_ctes("m_", "_sc", "_truth") + 'SELECT split, "hr@5", "hr@10", "hr@20" FROM m_out', "fx_merged")
O["metric_mrr"] = W(BASE_MERGED + metrics_ctes("m_", "_sc", "_truth") + 'SELECT split, "mrr@5", "mrr@10", "mrr@20" FROM m_out', "fx_merged")
O["metric_ndcg"] = W(BASE_MERGED + metrics_ctes("m_", "_sc", "_truth") + 'SELECT split, "ndcg@5", "ndcg@10", "ndcg@20" FROM m_out', "fx_merged")
O["latest_first_metrics"] = W(
    BASE_MERGED.replace("CAST(max(i) AS DOUBLE)", "CAST(max(i) - 1 AS DOUBLE)") + metrics_ctes("m_", "_sc", "_truth", (1, 5, 10, 20))
    + "SELECT * FROM m_out", "fx_merged")
O["hybrid_score"] = W(BASE_NEXT + tag_bm25_scores("b_", "union") + """
SELECT s.order_id, s.pid, round(CASE WHEN t.pid IS NULL THEN s.score / 1000.0 ELSE s.score END, 6) AS score
FROM b_sc s LEFT JOIN _bsc t ON s.order_id = t.order_id AND s.pid = t.pid""", "fx_next_last", "fx_tags", "fx_products")

O["bow_english"] = W(r"""SELECT pid, array_to_string(flatten(list_transform(tags, lambda t: regexp_split_to_array(t, '\s+'))), '|') AS bow
FROM fx_tags""", "fx_tags")
O["bow_chars"] = W("""SELECT pid, array_to_string(flatten(list_transform(tags, lambda t: CASE WHEN t = '' THEN [] ELSE string_split(t, '') END)), '|') AS bow
FROM fx_tags""", "fx_tags")
O["bow_nested"] = W(CNT + r"""SELECT order_id, array_to_string(list(array_to_string(flatten(list_transform(tags,
    lambda t: regexp_split_to_array(t, '\s+'))), ' ') ORDER BY pos), '|') AS bow FROM _lt GROUP BY order_id""", "fx_next_last", "fx_tags")
O["seq_tag_lookup"] = W(CNT + """SELECT order_id, array_to_string(list(array_to_string(tags, ',') ORDER BY pos), '|') AS seq_tags
FROM _lt GROUP BY order_id""", "fx_next_last", "fx_tags")
for _fn in QUERIES:
    O[f"query_{_fn}"] = W(q_cte(_fn) + "SELECT * FROM _q", "fx_next_last", "fx_tags")
O["query_custom_fn"] = W(CNT + r"""SELECT order_id, term, count(*) AS qty FROM (
    SELECT order_id, unnest(regexp_split_to_array(tag, '\s+')) AS term FROM (
      SELECT order_id, unnest(tags) AS tag FROM _lt WHERE pos >= n_pos - 2) y) x GROUP BY 1, 2""",
    "fx_next_last", "fx_tags")

DOC_BM25 = bm25_ctes("d_", DOC_CORPUS, 1.5, 0.75, 4.0)
O["bm25_postings"] = W(DOC_BM25 + "SELECT term, doc_id, tf, round(w, 6) AS w FROM d_post", "fx_tag_docs")
O["bm25_idf"] = W(DOC_BM25 + "SELECT term, df, round(idf, 6) AS idf FROM d_terms", "fx_tag_docs")
O["bm25_index_roundtrip"] = O["bm25_idf"]
O["bm25_index_stats"] = W(DOC_BM25 + """SELECT c.n_docs, round(c.avgdl, 6) AS avgdl, t.n_terms, round(t.avg_idf, 6) AS avg_idf,
    coalesce(t.avg_idf < 0, false) AS idf_warning FROM d_cs c, (SELECT count(*) AS n_terms, avg(idf) AS avg_idf FROM d_terms) t""",
    "fx_tag_docs")
O["bm25_top_n"] = W(DOC_BM25 + r"""
, bq AS (SELECT query_id, term, count(*) AS qty FROM (SELECT item_id AS query_id,
         unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda t: t <> '')) AS term FROM benchmark) x GROUP BY 1, 2)
, bs AS (SELECT q.query_id, p.doc_id, round(sum(q.qty * p.w), 9) AS score FROM bq q JOIN d_post p ON q.term = p.term GROUP BY 1, 2)
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bs) x WHERE rank <= 5""",
    "fx_tag_docs")
O["bm25_score"] = W(tag_bm25_scores("b_", "union") + "SELECT order_id, pid, round(score, 6) AS score FROM b_sc",
                    "fx_next_last", "fx_tags", "fx_products")
O["tag_scores"] = W(tag_bm25_scores("b_", "sum") + "SELECT order_id, pid, round(score, 6) AS score FROM b_sc",
                    "fx_next_last", "fx_tags", "fx_products")
O["iou_score"] = W(tag_iou_scores("i_") + "SELECT order_id, pid, round(score, 6) AS score FROM i_sc",
                   "fx_next_last", "fx_tags", "fx_products")
O["restrict_tag_corpus"] = W("SELECT pid, array_to_string(tags, '|') AS tags FROM fx_tags WHERE pid IN (SELECT pid FROM fx_products)",
                             "fx_tags", "fx_products")
O["tag_metrics"] = W(BASE_NEXT + tag_bm25_scores("b_", "union") + metrics_ctes("m_", "b_sc", "_ntruth") + "SELECT * FROM m_out",
                     "fx_next_last", "fx_tags", "fx_products")
O["metrics_report"] = W(
    BASE_NEXT + tag_bm25_scores("bu_", "union") + tag_bm25_scores("bs_", "sum") + tag_iou_scores("iu_")
    + metrics_ctes("m1_", "_bsc", "_ntruth") + metrics_ctes("m2_", "bu_sc", "_ntruth")
    + metrics_ctes("m3_", "bs_sc", "_ntruth") + metrics_ctes("m4_", "iu_sc", "_ntruth")
    + """SELECT 'baseline/' || split AS name, * EXCLUDE (split) FROM m1_out UNION ALL
SELECT 'bm25_union/' || split, * EXCLUDE (split) FROM m2_out UNION ALL
SELECT 'bm25_sum/' || split, * EXCLUDE (split) FROM m3_out UNION ALL
SELECT 'iou_union/' || split, * EXCLUDE (split) FROM m4_out""", "fx_next_last", "fx_tags", "fx_products")
O["dq_tag_coverage"] = W("SELECT pid FROM fx_products WHERE pid NOT IN (SELECT pid FROM fx_tags)", "fx_products", "fx_tags")
O["dq_score_truth"] = W(tag_bm25_scores("b_", "union") + """SELECT
  (SELECT count(*) FROM (SELECT DISTINCT order_id FROM b_sc) s WHERE order_id NOT IN (SELECT order_id FROM fx_next_last)) AS n_orders_not_in_truth,
  (SELECT count(*) FROM b_sc WHERE pid NOT IN (SELECT pid FROM fx_products)) AS n_scores_outside_catalogue""",
    "fx_next_last", "fx_tags", "fx_products")
O["dq_index_corpus"] = W(DOC_BM25 + """SELECT c.n_docs, (SELECT count(*) FROM fx_tag_docs) AS n_corpus,
  c.n_docs = (SELECT count(*) FROM fx_tag_docs) AS ok FROM d_cs c""", "fx_tag_docs")


def fill_ctes(scores: str, k: int, seed: int) -> str:
    """CTE ``_filled`` (order_id, pid, score): scores and each short order's own pseudo-random products behind them."""
    return f"""
, _places AS (SELECT pid, row_number() OVER (ORDER BY md5(pid || ':{seed}'), pid) - 1 AS place FROM (SELECT DISTINCT pid FROM fx_products) x)
, _size AS (SELECT count(*) AS n FROM _places)
, _short AS (SELECT o.order_id, (SELECT count(DISTINCT s.pid) FROM {scores} s WHERE s.order_id = o.order_id) AS n_scored
             FROM (SELECT DISTINCT order_id FROM fx_next_last) o)
, _drawn AS (SELECT order_id, n_scored, i, CAST('0x' || md5(order_id || ':{seed}:' || i)[1:8] AS BIGINT) % n AS place
             FROM _short, _size, range(0, {2 * k}) r(i) WHERE n_scored < {k}
             UNION ALL
             SELECT order_id, n_scored, {2 * k} + i, (CAST('0x' || md5(order_id || ':{seed}:0')[1:8] AS BIGINT) + i) % n
             FROM _short, _size, range(0, {2 * k}) r(i) WHERE n_scored < {k} AND i < n)
, _first AS (SELECT order_id, n_scored, place, min(i) AS i FROM _drawn GROUP BY ALL)
, _open AS (SELECT f.order_id, f.n_scored, p.pid, row_number() OVER (PARTITION BY f.order_id ORDER BY f.i) AS r
            FROM _first f JOIN _places p ON f.place = p.place
            WHERE NOT EXISTS (SELECT 1 FROM {scores} s WHERE s.order_id = f.order_id AND s.pid = p.pid))
, _filled AS (SELECT order_id, pid, CAST(score AS DOUBLE) AS score FROM {scores}
              UNION ALL SELECT order_id, pid, -10.0::DOUBLE - r / {float(2 * k + 1)}::DOUBLE FROM _open WHERE r <= {k} - n_scored)
"""


O["score_fill"] = W("""
, _bs AS (SELECT order_id, pid, max(i) AS score FROM (
    SELECT order_id, unnest(prefix) AS pid, generate_subscripts(prefix, 1) AS i FROM fx_next_last) x GROUP BY 1, 2)"""
    + fill_ctes("_bs", 20, 3) + "SELECT order_id, pid, score FROM _filled", "fx_next_last", "fx_products")
O["random_metrics"] = W("""
, _no AS (SELECT order_id, target AS pid, 0.0 AS score FROM fx_next_last WHERE false)
, _truth AS (SELECT order_id, split, target AS pid FROM fx_next_last)"""
    + fill_ctes("_no", 20, 5) + metrics_ctes("m", "_filled", "_truth") + "SELECT * FROM mout", "fx_next_last", "fx_products")
O["ranking_metrics_filled"] = W(BASE_NEXT + fill_ctes("_bsc", 20, 3) + metrics_ctes("m_", "_filled", "_ntruth") + "SELECT * FROM m_out",
                                "fx_next_last", "fx_products")
O["tag_metrics_filled"] = W(BASE_NEXT + tag_bm25_scores("b_", "last") + fill_ctes("b_sc", 20, 3) + metrics_ctes("m_", "_filled", "_ntruth")
                            + "SELECT * FROM m_out", "fx_next_last", "fx_tags", "fx_products")
O["bm25_reloaded_top_n"] = O["bm25_top_n"]
O["bm25_index_reload"] = W(DOC_BM25 + """SELECT (SELECT count(*) FROM d_post) AS n_postings, (SELECT round(sum(w), 3) FROM d_post) AS sum_w,
    (SELECT CAST(sum(df) AS BIGINT) FROM d_terms) AS sum_df, (SELECT CAST(sum(dl) AS BIGINT) FROM d_docs) AS sum_dl,
    c.n_docs, round(c.avgdl, 6) AS avgdl, (SELECT count(*) FROM d_terms) AS n_terms,
    CAST(1.5 AS DOUBLE) AS k1, CAST(0.75 AS DOUBLE) AS b, CAST(4.0 AS DOUBLE) AS alpha FROM d_cs c""", "fx_tag_docs")
O["dq_generation_coverage"] = W("SELECT p_partkey AS pid FROM part WHERE p_partkey NOT IN (SELECT pid FROM fx_predictions)", "fx_predictions")

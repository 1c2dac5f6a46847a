"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from .queries import MIX_WEIGHTS

WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE: dict[str, str] = {}

ORACLE["op9_decontaminate"] = rf"""
WITH it AS (SELECT item_id, {WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, n, list_slice(w, s, s + n - 1) AS v FROM (
  SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS s FROM it WHERE len(w) > 0) x),
d AS (SELECT doc_id, {WORDS} AS w FROM documents),
sz AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, n, s, list_slice(w, s, s + n - 1) AS v FROM (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sz WHERE len(w) >= n) x),
hit AS (SELECT DISTINCT doc_id, s, n, item_id FROM dw JOIN win USING (n, v)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) y GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hit) z GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN items USING (doc_id)"""


def _weight(level: str) -> str:
    names = MIX_WEIGHTS.get(level, {})
    return "CASE " + " ".join(f"WHEN {level} = '{k}' THEN {v}" for k, v in names.items()) + " ELSE 1 END" if names else "1"


def _fill(name: str, level: str, keys: list[str], parents: str, budget: str) -> str:
    """CTEs that split each parent's budget among the nodes of one level."""
    k, up = ", ".join(keys), ", ".join(keys[:-1])
    part = f"PARTITION BY {up} " if up else ""
    source = f"JOIN {parents} USING ({up})" if up else ""
    return f"""
{name}_n AS (SELECT {k}, sum(tokens) AS tokens, sum(tokens) * 2 AS cap, {_weight(level)} AS wt FROM leaves GROUP BY {k}),
{name}_b AS (SELECT {name}_n.*, {budget} AS budget FROM {name}_n {source}),
{name}_o AS (SELECT *, budget - coalesce(sum(cap) OVER ({part}ORDER BY cap * 1.0 / wt, {k} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
  sum(wt) OVER ({part}ORDER BY cap * 1.0 / wt, {k} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wrest FROM {name}_b),
{name}_f AS (SELECT *, cap * wrest <= wt * lft AS fl FROM {name}_o),
{name}_x AS (SELECT *, first_value(lft) OVER ({part}ORDER BY fl, cap * 1.0 / wt, {k} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS ol,
  first_value(wrest) OVER ({part}ORDER BY fl, cap * 1.0 / wt, {k} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS ow FROM {name}_f),
{name} AS (SELECT {k}, tokens, CASE WHEN fl THEN cap ELSE least(cap, (wt * ol) // ow) END AS quota FROM {name}_x),"""


ORACLE["op6_source_mix"] = rf"""
WITH d AS (SELECT doc_id, 'domain' || coalesce(TRY_CAST(regexp_extract(source, '(\d+)$', 1) AS BIGINT) % 4, 0) AS domain, lang, source,
  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens) AS tokens FROM d WHERE n_tokens > 0 GROUP BY ALL),
{_fill("l1", "domain", ["domain"], "", "(SELECT sum(tokens) FROM leaves) * 600 // 1000")}
{_fill("l2", "lang", ["domain", "lang"], "(SELECT domain, quota FROM l1) p", "quota")}
{_fill("l3", "source", ["domain", "lang", "source"], "(SELECT domain, lang, quota FROM l2) p", "quota")}
t AS (SELECT d.*, CAST(quota // tokens AS BIGINT) AS whole, CAST(quota % tokens AS BIGINT) AS part FROM d JOIN l3 USING (domain, lang, source) WHERE n_tokens > 0),
c AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('mix:' || whole || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null')) RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM t)
SELECT doc_id, domain, lang, source, n_tokens, CAST(whole + CASE WHEN upto <= part THEN 1 ELSE 0 END AS BIGINT) AS epochs FROM c
UNION ALL SELECT doc_id, domain, lang, source, n_tokens, 0 FROM d WHERE n_tokens = 0"""


ORACLE["op11_url_filter"] = r"""
WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '^[\s\S]*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '^[\s\S]*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
r(verdict, host, path) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
f AS (SELECT DISTINCT p.host, p.path, r.host || r.path AS rule, r.verdict FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)),
b AS (SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM f GROUP BY host, path)
SELECT page_id, p.host, p.path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN b USING (host, path)"""

ORACLE["op13_collocations"] = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
g AS (SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase FROM (
  SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) x(k) WHERE len(w) >= k) y),
t AS (SELECT lang, count(*) AS n FROM g WHERE k = 1 GROUP BY lang),
f AS (SELECT lang, k, phrase, count(*) AS f, string_split(phrase, ' ') AS w FROM g GROUP BY lang, k, phrase HAVING count(*) >= 30),
c AS (SELECT lang, k, phrase, f AS a, w, unnest(range(1, k)) AS cut_at FROM f WHERE k > 1),
s AS (SELECT c.lang, c.phrase, c.k, a, cut_at, x.f AS l, y.f AS r, CAST((CAST(2000000 AS HUGEINT) * a) // (x.f + y.f) AS BIGINT) AS score FROM c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(list_slice(c.w, 1, cut_at), ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(list_slice(c.w, cut_at + 1, c.k), ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut_at) = 1),
o AS (SELECT lang, f AS f2, unnest(list_concat(
  [array_to_string(list_slice(w, i, i + 1), ' ') for i in range(1, k)], CASE WHEN k = 4 THEN [array_to_string(list_slice(w, i, i + 2), ' ') for i in range(1, 3)] ELSE [] END)) AS phrase FROM f WHERE k > 2),
m AS (SELECT lang, phrase, max(f2) AS f2 FROM o GROUP BY lang, phrase),
z AS (SELECT b.* FROM b LEFT JOIN m USING (lang, phrase) WHERE f2 IS NULL OR 100 * f2 < 80 * a),
q AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM z QUALIFY rank <= 2000)
SELECT lang, rank, phrase, a, l, r, n, score FROM q JOIN t USING (lang)"""


def _components(pairs: str, nodes: str) -> str:
    """CTE comp(id, component_id): smallest id reachable over pairs (a, b)."""
    return f"""both_ways AS (SELECT a, b FROM {pairs} UNION SELECT b, a FROM {pairs}),
reach(id, r) AS (SELECT id, id FROM {nodes} UNION SELECT reach.id, b FROM reach JOIN both_ways ON r = a),
comp AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id)"""


ORACLE["op7_embedding_graph"] = f"""
WITH RECURSIVE v AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND list_count(e) = len(e) AND len(list_filter(e, lambda x: isfinite(x))) = len(e) AND len(list_filter(e, lambda x: x <> 0)) > 0),
p AS (SELECT x.id AS a, y.id AS b FROM ok x JOIN ok y ON x.label = y.label AND len(x.e) = len(y.e) AND x.id <> y.id WHERE list_cosine_similarity(x.e, y.e) >= 0.93),
{_components("p", "v")}
SELECT v.id AS vec_id, coalesce(n, 0) AS n_links, component_id, v.id = component_id AS kept, CAST(1.0 AS DOUBLE) AS audited_recall
FROM v JOIN comp USING (id) LEFT JOIN (SELECT a AS id, count(*) AS n FROM p GROUP BY a) USING (id)"""

ORACLE["op8_jaccard_join"] = rf"""
WITH RECURSIVE w AS (SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w FROM documents),
s AS (SELECT DISTINCT id, list_slice(w, i, i + least(len(w), 4) - 1) AS g FROM (SELECT id, w, unnest(range(1, len(w) - least(len(w), 4) + 2)) AS i FROM w WHERE len(w) > 0) x),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
o AS (SELECT x.id AS a, y.id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.id <> y.id GROUP BY x.id, y.id),
p AS (SELECT a, b FROM o JOIN n na ON na.id = a JOIN n nb ON nb.id = b WHERE 100 * k >= 85 * (na.n + nb.n - k)),
{_components("p", "w")}
SELECT w.id AS doc_id, coalesce(n.n, 0) AS n_shingles, component_id, coalesce(l.n, 0) AS n_links
FROM w JOIN comp USING (id) LEFT JOIN n USING (id) LEFT JOIN (SELECT a AS id, count(*) AS n FROM p GROUP BY a) l USING (id)"""

ORACLE["op5_suffix_dedup"] = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, i, substr(h, 2 * i + 1, 2) AS x, CASE WHEN 2 * i + 100 <= len(h) THEN substr(h, 2 * i + 1, 100) END AS w
  FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2)) AS i FROM t) u),
m AS (SELECT w, min(doc_id) AS low FROM b WHERE w IS NOT NULL GROUP BY w HAVING min(doc_id) < max(doc_id)),
f AS (SELECT doc_id, i, x, CASE WHEN low < doc_id THEN 1 ELSE 0 END AS gone FROM b LEFT JOIN m USING (w)),
c AS (SELECT doc_id, i, x, max(gone) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS r FROM f),
e AS (SELECT *, r - coalesce(lag(r) OVER (PARTITION BY doc_id ORDER BY i), 0) AS rise FROM c),
g AS (SELECT doc_id, count(*) AS n_bytes, sum(r) AS n_removed, count(*) FILTER (rise = 1) AS n_spans, string_agg(x, '' ORDER BY i) FILTER (r = 0) AS kept FROM e GROUP BY doc_id)
SELECT doc_id, coalesce(n_bytes, 0) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM t LEFT JOIN g USING (doc_id)"""

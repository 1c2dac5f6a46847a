"""Oracle SQL for sampling, tag vectors and cosine similarity."""

from __future__ import annotations

from .fixtures_sql import with_ctes

O: dict[str, str] = {}
W = with_ctes

SAMPLE = "(SELECT pid FROM fx_products ORDER BY md5(CAST(pid AS VARCHAR) || ':{seed}'), pid LIMIT {n})"

O["sample_products"] = W("SELECT pid FROM " + SAMPLE.format(seed=3, n=50), "fx_products")
O["tag_count_vectors"] = W("SELECT pid, tag, count(*) AS n FROM (SELECT pid, unnest(tags) AS tag FROM fx_tags) x GROUP BY 1, 2", "fx_tags")


def cosine_sql(chosen: str) -> str:
    return W(f"""
, c AS (SELECT pid, tag, count(*) AS n FROM (SELECT pid, unnest(tags) AS tag FROM fx_tags
        WHERE pid IN {chosen}) x GROUP BY 1, 2)
, nr AS (SELECT pid, sqrt(sum(n * n)) AS norm FROM c GROUP BY 1)
, d AS (SELECT a.pid AS pa, b.pid AS pb, sum(a.n * b.n) AS dot FROM c a JOIN c b ON a.tag = b.tag GROUP BY 1, 2)
SELECT pa AS pid_a, pb AS pid_b, round(CASE WHEN pa = pb THEN 1.0 ELSE dot / (x.norm * y.norm) END, 6) AS cosine
FROM d JOIN nr x ON x.pid = d.pa JOIN nr y ON y.pid = d.pb""", "fx_products", "fx_tags")


O["tag_cosine"] = cosine_sql(SAMPLE.format(seed=21, n=50))
O["tag_cosine_catalogue"] = cosine_sql("(SELECT pid FROM fx_products)")

O["tag_cosine_above"] = W("""
, c AS (SELECT pid, tag, count(*) AS n FROM (SELECT pid, unnest(tags) AS tag FROM fx_tags) x GROUP BY 1, 2)
, v AS (SELECT pid, string_agg(tag || chr(1) || n, chr(2) ORDER BY tag) AS v FROM c GROUP BY 1)
, r AS (SELECT min(pid) AS pid FROM v GROUP BY v)
, k AS (SELECT c.* FROM c JOIN r USING (pid))
, nr AS (SELECT pid, sum(n * n) AS n2 FROM k GROUP BY 1)
, d AS (SELECT a.pid AS pa, b.pid AS pb, sum(a.n * b.n) AS dot FROM k a JOIN k b ON a.tag = b.tag AND a.pid < b.pid GROUP BY 1, 2)
SELECT pa AS pid_a, pb AS pid_b, round(dot / sqrt(CAST(x.n2 AS DOUBLE) * CAST(y.n2 AS DOUBLE)), 6) AS cosine
FROM d JOIN nr x ON x.pid = d.pa JOIN nr y ON y.pid = d.pb WHERE 16 * dot * dot >= 9 * x.n2 * y.n2""", "fx_tags")

# the echo predictor gives the tags of a prompt's first line in reverse order, two of them below top_p 0.5;
# what follows the marker is kept as it is, with its leading blank
PROMPTS = """
, _pr AS (SELECT c.pid, list_slice(t.tags, 1, 3) AS tg FROM fx_products c JOIN fx_tags t ON t.pid = c.pid)
, _ec AS (SELECT pid, '1. ' || array_to_string(tg, ', ') || chr(10) || '2.' AS input,
          ' ' || array_to_string(list_reverse(tg), ', ') AS echo, ' ' || array_to_string(list_reverse(list_slice(tg, 1, 2)), ', ') AS echo2 FROM _pr)
"""
O["batch_predict"] = W(PROMPTS + "SELECT pid, '' AS instruction, input, echo AS predict FROM _ec", "fx_products", "fx_tags")
O["batch_predict_multi"] = W(PROMPTS + "SELECT pid, echo2 || ' || ' || echo AS predicts FROM _ec", "fx_products", "fx_tags")
O["batch_predict_iterative"] = W(PROMPTS + """SELECT pid, '' AS instruction,
  input || ' ' || echo || chr(10) || '3. ' || echo || chr(10) || '4. ' || echo AS input FROM _ec""", "fx_products", "fx_tags")

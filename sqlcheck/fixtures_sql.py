"""Fixture views of FIXTURES.md as DuckDB CTEs, plus a tiny helper that
prepends the CTEs a query needs (in dependency order)."""

from __future__ import annotations

import re

# name -> (sql, deps)
CTES: dict[str, tuple[str, list[str]]] = {}


def cte(name: str, sql: str, deps: list[str] | None = None) -> None:
    CTES[name] = (sql, deps or [])


def with_ctes(body: str, *names: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in CTES[n][1]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return body
    parts = [f"{n} AS (\n{CTES[n][0]}\n)" for n in order]
    body = body.lstrip()
    if body.startswith(","):
        return "WITH " + ",\n".join(parts) + "\n" + body
    return "WITH " + ",\n".join(parts) + "\n" + body


FAMILIES_RE = None  # filled below from the engine's fixed values


def _families_alternation() -> str:
    from tagtrail.constants import PAGE_FAMILIES

    return "^(?:" + "|".join(PAGE_FAMILIES.values()) + ")"


def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


FAM = sql_str(_families_alternation())
NETLOC = sql_str(r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)")
PATH_RAW = sql_str(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)")
HAS_SCHEME = sql_str(r"^[A-Za-z][A-Za-z0-9+.-]*://")
DOMAIN = sql_str(r"^(?:(mob\.)?shop.example)")
ITEM = sql_str(r"^/+(?:cheap|favorable)_(\d+)\.html")
CHEAP = sql_str(r"^/+cheap_(\d+)\.html")
REFCAT = sql_str(r"/+(?:inpage|index)_(\d+)(_(\d+))?\.html")


def url_path_sql(u: str) -> str:
    raw = f"CASE WHEN regexp_matches({u}, {HAS_SCHEME}) THEN regexp_extract({u}, {PATH_RAW}, 1) ELSE regexp_extract({u}, '^([^?#]*)', 1) END"
    return f"regexp_replace({raw}, ';[^/]*$', '')"


cte("fx_ev", """SELECT event_id, event_type AS _etype, user_id AS uuid_ind, value, epoch_us(ts) AS "timestamp",
       CAST(json_extract_string(props, '$.k') AS BIGINT) AS _k,
       CAST((epoch_us(ts) - 1704067200000000) // 604800000000 AS VARCHAR) AS session_id
FROM events""")

OTHER_PAGES = (
    "member.php newslist.php specialty.html authenticate.php contact_proposal.html forget.php inquiry.html sentok.php brand.html precursor.php new_ecpay_payment_3d.php shoppingcart.html index.html insearch.html "
    "modify.html new_order_12.html orderview_ab1.html login_3.php registered.php setbonus_x.html getgift_a.html faq_2.html bulletin_4.html cheapview_5.php bastchoice.php inpage_1_2.html about.html sitemap.xml"
)

cte("fx_loads_raw", f"""SELECT 'shop' AS web_id, 'load' AS event_type, event_id AS seq, "timestamp", session_id,
  CASE WHEN event_id % 17 = 0 THEN url_now
       WHEN event_id % 3 = 0 THEN 'https://shop.example/inpage_' || CAST(_k % 5 AS VARCHAR) || '_' || CAST(_k % 7 AS VARCHAR) || '.html'
       WHEN event_id % 3 = 1 THEN 'https://shop.example/index_' || CAST(_k % 5 AS VARCHAR) || '.html'
       ELSE NULL END AS url_referrer,
  url_now,
  CASE event_id % 3 WHEN 0 THEN 'desktop' WHEN 1 THEN 'mobile' ELSE 'tablet' END AS device_type,
  CAST(event_id % 5 AS INTEGER) AS landing_count, uuid_ind
FROM (SELECT *, CASE WHEN event_id % 11 = 0 THEN 'https://mob.shop.example/' || string_split('{OTHER_PAGES}', ' ')[(event_id // 11) % 28 + 1] || '?x=1'
                     WHEN event_id % 13 = 0 THEN 'https://other.example/cheap_' || CAST(_k AS VARCHAR) || '.html'
                     ELSE 'https://mob.shop.example/' || CASE WHEN _etype = 'click' THEN 'cheap' ELSE 'favorable' END
                          || '_' || CAST(_k AS VARCHAR) || '.html?ref=' || CAST(event_id AS VARCHAR) END AS url_now
      FROM fx_ev WHERE _etype IN ('view', 'click')) e""", ["fx_ev"])

cte("fx_purchases_raw", """SELECT 'shop' AS web_id, 'purchase' AS event_type, event_id AS seq,
  "timestamp" + c.copy * 1000000 AS "timestamp", session_id, uuid_ind,
  {'order_id': CAST(event_id AS VARCHAR), 'total_price': value,
   'details': CASE WHEN event_id % 19 = 0 THEN CAST([] AS STRUCT(product_id VARCHAR)[])
                   WHEN event_id % 2 = 0 THEN [{'product_id': CAST(_k AS VARCHAR)}, {'product_id': CAST((_k + 7) % 100 AS VARCHAR)}]
                   ELSE [{'product_id': CAST(_k AS VARCHAR)}] END} AS purchasing_detail
FROM fx_ev e JOIN (SELECT 0 AS copy UNION ALL SELECT 1) c ON c.copy = 0 OR e.event_id % 23 = 0
WHERE _etype = 'purchase'""", ["fx_ev"])

cte("fx_products", """SELECT p_partkey AS pid FROM part WHERE p_size <= 45
  AND p_partkey IN (SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) FROM events)""")

cte("fx_tags", """SELECT p_partkey AS pid, list_concat(string_split(p_name, ' '), [p_brand, p_type]) AS tags
FROM part""")

cte("fx_tag_docs", r"""SELECT doc_id, lang, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda t: t <> '') AS tokens
FROM documents""")

cte("fx_predictions", """SELECT t.pid, d.lang,
  '1. ' || array_to_string(t.tags, ', ') || chr(10) || '2. ' || d.text AS raw_predict
FROM documents d JOIN fx_tags t ON d.doc_id = t.pid""", ["fx_tags"])

cte("fx_generations", """SELECT pid, lang, '<s>[INST] tags of product ' || CAST(pid AS VARCHAR) || ' [/INST]' || raw_predict || '</s>' AS generation
FROM fx_predictions""", ["fx_predictions"])

cte("fx_orders_wide", """SELECT o.o_orderkey AS order_id, o.o_custkey AS uuid_ind, li.products
FROM orders o JOIN (SELECT l_orderkey, list_sort(list_distinct(list(l_partkey))) AS products FROM lineitem GROUP BY l_orderkey) li
ON o.o_orderkey = li.l_orderkey""")

cte("fx_training_log", """SELECT CAST((epoch_us(ts) - 1704067200000000) // 86400000000 AS INTEGER) AS epoch,
  CASE user_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split,
  round(count(*) / (count(*) + 100.0), 6) AS "hr@20", round(avg(value) / (avg(value) + 100.0), 6) AS "ndcg@20"
FROM events GROUP BY 1, 2""")

# ---- cleaning chain --------------------------------------------------------
cte("fx_loads_norm", """SELECT seq, "timestamp", CAST(session_id AS BIGINT) AS session_id, url_referrer, url_now,
  device_type, landing_count, uuid_ind FROM fx_loads_raw""", ["fx_loads_raw"])

cte("fx_loads_stage", f"""SELECT *, {url_path_sql('url_now')} AS url_path,
  coalesce(url_now <> url_referrer, true) AS f1,
  regexp_matches(regexp_extract(url_now, {NETLOC}, 1), {DOMAIN}) AS f2
FROM fx_loads_norm""", ["fx_loads_norm"])

cte("fx_loads_pre", f"""SELECT seq, "timestamp", session_id, url_referrer, url_now, device_type, landing_count, uuid_ind, url_path,
  TRY_CAST(nullif(regexp_extract(url_path, {ITEM}, 1), '') AS BIGINT) AS item_id,
  CASE WHEN regexp_matches(url_path, {CHEAP}) THEN 'cheap' ELSE 'favorable' END AS item_type,
  CAST(nullif(regexp_extract(url_referrer, {REFCAT}, 1), '') AS BIGINT) AS main_cat,
  CAST(nullif(regexp_extract(url_referrer, {REFCAT}, 3), '') AS BIGINT) AS sub_cat
FROM fx_loads_stage WHERE f1 AND f2 AND NOT regexp_matches(url_path, {FAM})""", ["fx_loads_stage"])

cte("fx_loads_clean", """SELECT * EXCLUDE (_prev) FROM (
  SELECT *, lag(url_path) OVER (PARTITION BY uuid_ind, session_id ORDER BY "timestamp", seq) AS _prev FROM fx_loads_pre) x
WHERE _prev IS NULL OR _prev <> url_path""", ["fx_loads_pre"])

cte("fx_loads_final", """SELECT *, row_number() OVER (PARTITION BY uuid_ind, session_id ORDER BY "timestamp", seq) AS pos
FROM fx_loads_clean WHERE item_id IN (SELECT pid FROM fx_products)""", ["fx_loads_clean", "fx_products"])

cte("fx_purchases_norm", """SELECT seq, "timestamp", CAST(session_id AS BIGINT) AS session_id, uuid_ind, purchasing_detail,
  CAST(purchasing_detail.order_id AS BIGINT) AS order_id FROM fx_purchases_raw""", ["fx_purchases_raw"])

cte("fx_purchases_dedup", """SELECT * EXCLUDE (_rn),
  list_sort(list_distinct(list_transform(purchasing_detail.details, lambda d: CAST(d.product_id AS BIGINT)))) AS products
FROM (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY "timestamp", seq) AS _rn FROM fx_purchases_norm) x
WHERE _rn = 1""", ["fx_purchases_norm"])

cte("fx_purchases_clean", "SELECT * FROM fx_purchases_dedup WHERE len(products) > 0", ["fx_purchases_dedup"])

cte("fx_purchases_cat", """SELECT p.order_id, any_value(p.uuid_ind) AS uuid_ind, any_value(p.session_id) AS session_id,
  any_value(p."timestamp") AS "timestamp", any_value(p.seq) AS seq, list_sort(list(u.pid)) AS products
FROM fx_purchases_clean p, unnest(p.products) AS u(pid)
WHERE u.pid IN (SELECT pid FROM fx_products)
GROUP BY p.order_id""", ["fx_purchases_clean", "fx_products"])

cte("fx_merged_nosplit", """SELECT o.order_id, o.uuid_ind, o.session_id, o."timestamp", o.seq, o.products,
  list(l.item_id ORDER BY l.pos) AS loaded_pids, count(*) AS n_loads
FROM fx_purchases_cat o JOIN fx_loads_final l
  ON o.uuid_ind = l.uuid_ind AND o.session_id = l.session_id AND l."timestamp" <= o."timestamp"
GROUP BY o.order_id, o.uuid_ind, o.session_id, o."timestamp", o.seq, o.products""", ["fx_purchases_cat", "fx_loads_final"])

cte("fx_bounds", """SELECT min("timestamp") AS ts_min, max("timestamp") AS ts_max,
  min("timestamp") + CAST(trunc(CAST(max("timestamp") - min("timestamp") AS DOUBLE) * CAST(0.7 AS DOUBLE)) AS BIGINT) AS train_end,
  min("timestamp") + CAST(trunc(CAST(max("timestamp") - min("timestamp") AS DOUBLE) * (CAST(0.7 AS DOUBLE) + CAST(0.2 AS DOUBLE))) AS BIGINT) AS val_end
FROM fx_merged_nosplit""", ["fx_merged_nosplit"])

cte("fx_merged", """SELECT m.*, CASE WHEN m."timestamp" <= b.train_end THEN 'train' WHEN m."timestamp" <= b.val_end THEN 'val' ELSE 'test' END AS split
FROM fx_merged_nosplit m CROSS JOIN fx_bounds b""", ["fx_merged_nosplit", "fx_bounds"])

cte("fx_next_last", """SELECT order_id, uuid_ind, split, loaded_pids[1:len(loaded_pids) - 1] AS prefix, loaded_pids[len(loaded_pids)] AS target
FROM fx_merged WHERE len(loaded_pids) >= 2""", ["fx_merged"])

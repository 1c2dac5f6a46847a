"""Oracle SQL for sources, cleaning, orders, EDA."""

from __future__ import annotations

from .fixtures_sql import CHEAP, FAM, ITEM, NETLOC, REFCAT, sql_str, url_path_sql, with_ctes

O: dict[str, str] = {}
W = with_ctes
PID = sql_str(r"(?:favorable|cheap)_(\d+)")


def _family_case(col: str) -> str:
    from tagtrail.constants import PAGE_FAMILIES

    whens = " ".join(f"WHEN regexp_matches({col}, {sql_str('^(?:' + p + ')')}) THEN {sql_str(n)}" for n, p in PAGE_FAMILIES.items())
    return f"CASE {whens} ELSE NULL END"


O["src_table"] = W("SELECT * FROM fx_loads_raw", "fx_loads_raw")
O["sink_table_roundtrip"] = W(
    "SELECT seq, uuid_ind, session_id, url_path, item_id, item_type, main_cat, sub_cat FROM fx_loads_clean", "fx_loads_clean")
O["clean_self_referral"] = W(
    "SELECT seq, url_now, url_referrer FROM fx_loads_raw WHERE coalesce(url_now <> url_referrer, true)", "fx_loads_raw")
O["clean_domain"] = W(
    f"SELECT seq, regexp_extract(url_now, {NETLOC}, 1) AS netloc FROM fx_loads_stage WHERE f2", "fx_loads_stage")
O["clean_page_families"] = W(
    f"SELECT seq, url_path FROM fx_loads_stage WHERE NOT regexp_matches(url_path, {FAM})", "fx_loads_stage")
O["page_family_counts"] = W(
    f"SELECT {_family_case('url_path')} AS family, count(*) AS n FROM fx_loads_stage WHERE f1 AND f2 GROUP BY 1", "fx_loads_stage")
O["url_netloc"] = W(
    f"SELECT seq, regexp_extract(url_now, {NETLOC}, 1) AS netloc_now, regexp_extract(url_referrer, {NETLOC}, 1) AS netloc_referrer FROM fx_loads_raw",
    "fx_loads_raw")
O["url_path"] = W(
    f"SELECT seq, {url_path_sql('url_now')} AS path_now, {url_path_sql('url_referrer')} AS path_referrer FROM fx_loads_raw", "fx_loads_raw")
O["url_item_id"] = W(
    f"SELECT seq, TRY_CAST(nullif(regexp_extract({url_path_sql('url_now')}, {ITEM}, 1), '') AS BIGINT) AS item_id FROM fx_loads_raw",
    "fx_loads_raw")
O["url_to_pid"] = W(
    f"""SELECT seq, TRY_CAST(nullif(regexp_extract(url_now, {PID}, 1), '') AS BIGINT) AS pid_now,
       TRY_CAST(nullif(regexp_extract(url_referrer, {PID}, 1), '') AS BIGINT) AS pid_referrer FROM fx_loads_raw""", "fx_loads_raw")
O["url_item_type"] = W(
    f"SELECT seq, CASE WHEN regexp_matches({url_path_sql('url_now')}, {CHEAP}) THEN 'cheap' ELSE 'favorable' END AS item_type FROM fx_loads_raw",
    "fx_loads_raw")
O["referrer_category"] = W(
    f"""SELECT seq, CAST(nullif(regexp_extract(url_referrer, {REFCAT}, 1), '') AS BIGINT) AS main_cat,
       CAST(nullif(regexp_extract(url_referrer, {REFCAT}, 3), '') AS BIGINT) AS sub_cat FROM fx_loads_raw""", "fx_loads_raw")
O["normalise_schema"] = W("SELECT * FROM fx_loads_norm", "fx_loads_norm")
O["order_id_extract"] = W('SELECT seq, "timestamp", order_id FROM fx_purchases_norm', "fx_purchases_norm")
O["order_products"] = W(
    """SELECT seq, "timestamp", order_id,
       array_to_string(list_sort(list_distinct(list_transform(purchasing_detail.details, lambda d: CAST(d.product_id AS BIGINT)))), ',') AS products
       FROM fx_purchases_norm""", "fx_purchases_norm")
O["dedup_orders"] = W('SELECT order_id, seq, "timestamp" FROM fx_purchases_dedup', "fx_purchases_dedup")
O["filter_min_len"] = W("SELECT order_id, len(loaded_pids) AS n_loads FROM fx_merged WHERE len(loaded_pids) >= 2", "fx_merged")
O["empty_orders_sample"] = W(
    'SELECT order_id, seq, "timestamp" FROM fx_purchases_dedup WHERE len(products) = 0 ORDER BY order_id LIMIT 5', "fx_purchases_dedup")
O["clean_stage_report"] = W(
    """, c AS (SELECT count(*) AS n0, count_if(f1) AS n1, count_if(f1 AND f2) AS n2,
              count_if(f1 AND f2 AND NOT regexp_matches(url_path, """ + FAM + """)) AS n3,
              (SELECT count(*) FROM fx_loads_clean) AS n4 FROM fx_loads_stage)
SELECT s.stage_no, s.stage, CAST(s.n_kept AS BIGINT) AS n_kept, CAST(s.n_prev - s.n_kept AS BIGINT) AS n_dropped,
       round((s.n_prev - s.n_kept) * 100.0 / c.n0, 6) AS pct_dropped
FROM c, (SELECT 0 AS stage_no, 'raw' AS stage, n0 AS n_kept, n0 AS n_prev FROM c UNION ALL
         SELECT 1, 'self_referral', n1, n0 FROM c UNION ALL SELECT 2, 'domain', n2, n1 FROM c UNION ALL
         SELECT 3, 'page_family', n3, n2 FROM c UNION ALL SELECT 4, 'consecutive_duplicates', n4, n3 FROM c) s""",
    "fx_loads_stage", "fx_loads_clean")
O["purchase_stage_report"] = W(
    """, c AS (SELECT (SELECT count(*) FROM fx_purchases_norm) AS n0, count(*) AS n1, count_if(len(products) > 0) AS n2 FROM fx_purchases_dedup)
SELECT s.stage_no, s.stage, CAST(s.n_kept AS BIGINT) AS n_kept, CAST(s.n_prev - s.n_kept AS BIGINT) AS n_dropped,
       round((s.n_prev - s.n_kept) * 100.0 / c.n0, 6) AS pct_dropped
FROM c, (SELECT 0 AS stage_no, 'raw' AS stage, n0 AS n_kept, n0 AS n_prev FROM c UNION ALL
         SELECT 1, 'duplicate_orders', n1, n0 FROM c UNION ALL SELECT 2, 'empty_orders', n2, n1 FROM c) s""",
    "fx_purchases_norm", "fx_purchases_dedup")
O["dq_constant_columns"] = W(
    """SELECT count(*) AS n_rows, count_if(NOT coalesce(web_id = 'shop', false)) AS n_bad_web_id,
         count_if(NOT coalesce(event_type = 'load', false)) AS n_bad_event_type, 'loads' AS log FROM fx_loads_raw
       UNION ALL
       SELECT count(*), count_if(NOT coalesce(web_id = 'shop', false)), count_if(NOT coalesce(event_type = 'purchase', false)), 'purchases'
       FROM fx_purchases_raw""", "fx_loads_raw", "fx_purchases_raw")
O["dq_item_pages"] = W(
    f"SELECT count(*) AS n_rows, count_if(NOT regexp_matches(url_path, {ITEM})) AS n_not_item FROM fx_loads_clean", "fx_loads_clean")
O["clean_consecutive_dups"] = W("SELECT seq, uuid_ind, session_id, url_path, item_id FROM fx_loads_clean", "fx_loads_clean")
O["filter_available_items"] = W("SELECT seq, item_id FROM fx_loads_clean WHERE item_id IN (SELECT pid FROM fx_products)",
                                "fx_loads_clean", "fx_products")
O["sort_loads"] = W("SELECT uuid_ind, session_id, seq, pos FROM fx_loads_final", "fx_loads_final")
O["order_preceding_loads"] = W(
    """SELECT o.order_id, o.uuid_ind, o.session_id, array_to_string(list(l.item_id ORDER BY l.pos), ',') AS loaded_pids,
       count(*) AS n_loads, array_to_string(list(l.seq ORDER BY l.pos), ',') AS load_seqs
FROM fx_purchases_cat o JOIN fx_loads_final l
  ON o.uuid_ind = l.uuid_ind AND o.session_id = l.session_id AND l."timestamp" <= o."timestamp"
GROUP BY o.order_id, o.uuid_ind, o.session_id""", "fx_purchases_cat", "fx_loads_final")
O["loads_in_order_sessions"] = W(
    """SELECT seq, uuid_ind, session_id FROM fx_loads_clean l
       WHERE EXISTS (SELECT 1 FROM fx_purchases_clean p WHERE p.uuid_ind = l.uuid_ind AND p.session_id = l.session_id)""",
    "fx_loads_clean", "fx_purchases_clean")
O["loads_of_buyers"] = W(
    "SELECT seq, uuid_ind FROM fx_loads_clean WHERE uuid_ind IN (SELECT uuid_ind FROM fx_purchases_clean)",
    "fx_loads_clean", "fx_purchases_clean")
O["restrict_products"] = W("SELECT order_id, array_to_string(products, ',') AS products FROM fx_purchases_cat", "fx_purchases_cat")
O["restrict_loads"] = W(
    """, lp AS (SELECT *, row_number() OVER (PARTITION BY uuid_ind, session_id ORDER BY "timestamp", seq) AS pos FROM fx_loads_clean)
, j AS (SELECT o.order_id, l.item_id, l.pos FROM fx_purchases_clean o JOIN lp l
        ON o.uuid_ind = l.uuid_ind AND o.session_id = l.session_id AND l."timestamp" <= o."timestamp")
SELECT order_id, array_to_string(list(item_id ORDER BY pos), ',') AS loaded_pids FROM j
WHERE item_id IN (SELECT pid FROM fx_products) GROUP BY order_id""", "fx_loads_clean", "fx_purchases_clean", "fx_products")
O["products_subset_of_loads"] = W(
    """SELECT order_id, len(list_filter(products, lambda p: NOT list_contains(loaded_pids, p))) AS n_not_viewed,
       len(list_filter(products, lambda p: NOT list_contains(loaded_pids, p))) = 0 AS all_viewed FROM fx_merged""", "fx_merged")
O["time_split"] = W('SELECT order_id, "timestamp", split FROM fx_merged', "fx_merged")
O["split_bounds"] = W("SELECT * FROM fx_bounds", "fx_bounds")
O["loaded_pids"] = W("SELECT order_id, array_to_string(loaded_pids, ',') AS loaded_pids FROM fx_merged", "fx_merged")
O["product_index"] = W("SELECT pid, row_number() OVER (ORDER BY pid) - 1 AS idx FROM fx_products", "fx_products")
O["multi_hot_labels"] = W(
    """, c AS (SELECT list(pid ORDER BY pid) AS ids FROM fx_products)
SELECT order_id, array_to_string(list_transform(c.ids, lambda i: CASE WHEN list_contains(products, i) THEN 1 ELSE 0 END), ',') AS y_true,
       CAST(len(products) AS INTEGER) AS n_true FROM fx_merged, c""", "fx_merged", "fx_products")
O["sparse_labels"] = W(
    """, c AS (SELECT pid, row_number() OVER (ORDER BY pid) - 1 AS idx FROM fx_products)
, x AS (SELECT DISTINCT order_id, unnest(products) AS pid FROM fx_merged)
, y AS (SELECT order_id, string_agg(CAST(idx AS VARCHAR), ',' ORDER BY idx) AS indices, count(*) AS n FROM x JOIN c USING (pid) GROUP BY 1)
SELECT order_id, (SELECT count(*) FROM c) AS size, coalesce(indices, '') AS indices, CAST(coalesce(n, 0) AS INTEGER) AS n_true
FROM fx_merged LEFT JOIN y USING (order_id)""", "fx_merged", "fx_products")
O["session_length"] = W("SELECT uuid_ind, session_id, count(*) AS n_loads FROM fx_loads_final GROUP BY 1, 2", "fx_loads_final")
O["session_unique_items"] = W(
    "SELECT uuid_ind, session_id, count(DISTINCT item_id) AS n_unique_items FROM fx_loads_final GROUP BY 1, 2", "fx_loads_final")
O["session_length_hist"] = W(
    """, s AS (SELECT uuid_ind, session_id, count(*) AS n_loads FROM fx_loads_final GROUP BY 1, 2)
SELECT n_loads, count(*) AS n_sessions, (SELECT round(avg(n_loads), 6) FROM s) AS mean FROM s GROUP BY n_loads""", "fx_loads_final")
O["products_per_order_hist"] = W(
    """, s AS (SELECT CAST(len(products) AS INTEGER) AS n_products FROM fx_orders_wide)
SELECT n_products, count(*) AS n_orders, (SELECT round(avg(n_products), 6) FROM s) AS mean FROM s GROUP BY n_products""",
    "fx_orders_wide")
O["purchased_not_viewed"] = W(
    """, s AS (SELECT order_id, CAST(len(list_filter(products, lambda p: NOT list_contains(loaded_pids, p))) AS INTEGER) AS n_not_viewed,
                  len(list_filter(products, lambda p: NOT list_contains(loaded_pids, p))) = 0 AS all_viewed FROM fx_merged)
SELECT n_not_viewed, count(*) AS n_orders, (SELECT round(avg(n_not_viewed), 6) FROM s) AS mean FROM s GROUP BY n_not_viewed""",
    "fx_merged")
O["orders_per_user"] = W("SELECT uuid_ind, count(*) AS n_orders FROM fx_merged GROUP BY 1", "fx_merged")
O["order_id_uniqueness"] = W("SELECT count(DISTINCT order_id) AS n_distinct, count(*) AS n_rows FROM fx_merged", "fx_merged")
O["unique_products"] = W(
    """SELECT DISTINCT pid FROM (SELECT item_id AS pid FROM fx_loads_clean UNION ALL
       SELECT unnest(products) AS pid FROM fx_merged) x WHERE pid IS NOT NULL""", "fx_loads_clean", "fx_merged")
O["unmatched_paths"] = W(
    f"""SELECT url_path, count(*) AS n FROM fx_loads_stage WHERE f1 AND f2 AND NOT regexp_matches(url_path, {FAM})
        AND NOT regexp_matches(url_path, {ITEM}) GROUP BY 1""", "fx_loads_stage")
O["next_item_last"] = W(
    "SELECT order_id, uuid_ind, split, array_to_string(prefix, ',') AS prefix, target FROM fx_next_last", "fx_next_last")
O["next_item_iterative"] = W(
    """SELECT order_id, uuid_ind, i AS prefix_len, array_to_string(loaded_pids[1:i], ',') AS prefix, loaded_pids[i + 1] AS target
       FROM fx_merged, range(1, len(loaded_pids)) r(i) WHERE len(loaded_pids) >= 2""", "fx_merged")
O["expand_purchases"] = W(
    """SELECT order_id, uuid_ind, p AS product, array_to_string(list_append(loaded_pids, p), ',') AS seq
       FROM fx_merged, unnest(products) u(p)""", "fx_merged")
O["loaded_only_sequences"] = W(
    "SELECT order_id, uuid_ind, array_to_string(loaded_pids, ',') AS seq FROM fx_merged WHERE len(loaded_pids) >= 2", "fx_merged")
O["stream_clean_loads"] = W("SELECT seq, uuid_ind, session_id, url_path, item_id, item_type FROM fx_loads_pre", "fx_loads_pre")
O["stream_session_counts"] = W("SELECT uuid_ind, session_id, count(*) AS n_loads FROM fx_loads_pre GROUP BY 1, 2", "fx_loads_pre")
O["order_preceding_loads_long"] = W(
    """SELECT o.order_id, l.pos, l.seq, l.item_id FROM fx_purchases_cat o JOIN fx_loads_final l
  ON o.uuid_ind = l.uuid_ind AND o.session_id = l.session_id AND l."timestamp" <= o."timestamp\"""", "fx_purchases_cat", "fx_loads_final")

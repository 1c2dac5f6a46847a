"""Oracle SQL for instruction-tuning data."""

from __future__ import annotations

import string

from .fixtures_sql import sql_str, with_ctes

O: dict[str, str] = {}
W = with_ctes
N_TAGS, MAX_LEN = 5, 20
SYSTEM = "Suggest three tags, best first and with commas between them, for the product that the shopper opens next. "


def lines_ctes(p: str, src: str, keys: list[str], seq: str, n_tags: int = N_TAGS, max_len: int = MAX_LEN) -> str:
    """``{p}lines(keys..., lines)``: last ``max_len`` items as numbered tag lines."""
    k = ", ".join(keys)
    kx = ", ".join(f"x.{c}" for c in keys)
    return f"""
, {p}tr AS (SELECT {k}, list_slice({seq}, greatest(len({seq}) - {max_len} + 1, 1), len({seq})) AS s FROM {src})
, {p}ex AS (SELECT {k}, unnest(s) AS pid, generate_subscripts(s, 1) AS i FROM {p}tr)
, {p}lines AS (SELECT {kx}, list(CAST(x.i AS VARCHAR) || '. ' || array_to_string(list_slice(t.tags, 1, {n_tags}), ', ') ORDER BY x.i) AS lines
               FROM {p}ex x JOIN fx_tags t ON t.pid = x.pid GROUP BY {kx})
"""


LOADED = "(SELECT order_id, uuid_ind, loaded_pids AS seq FROM fx_merged WHERE len(loaded_pids) >= 2)"
DENUM = "regexp_replace({}, '\\d+\\. ', '', 'g')"


def denum(s: str) -> str:
    return DENUM.format(s)


CONT = f"""
, cont AS (SELECT l.order_id, m.uuid_ind, '' AS instruction, lines[1] || chr(10) || '2.' AS input,
    CASE WHEN len(lines) = 2 THEN {denum('lines[2]')}
         ELSE {denum('lines[2]')} || chr(10) || array_to_string(list_slice(lines, 3, len(lines)), chr(10)) END AS output
  FROM lo_lines l JOIN fx_merged m ON m.order_id = l.order_id)
"""


def template_sql(tpl: str) -> str:
    parts = []
    fields = {"instruction": sql_str(SYSTEM), "user_instruction": "instruction", "input": "input"}
    for lit, field, _s, _c in string.Formatter().parse(tpl):
        if lit:
            parts.append(" || chr(10) || ".join(sql_str(x) for x in lit.split("\n")) if "\n" in lit else sql_str(lit))
        if field is not None:
            parts.append(fields[field])
    return " || ".join(parts)


O["sft_render_sequence"] = W(lines_ctes("lo_", LOADED, ["order_id"], "seq")
                             + "SELECT order_id, array_to_string(lines, chr(10)) AS text FROM lo_lines", "fx_merged", "fx_tags")
O["sft_denumber"] = W(lines_ctes("lo_", LOADED, ["order_id"], "seq")
                      + f"SELECT order_id, {denum('array_to_string(lines, chr(10))')} AS text FROM lo_lines", "fx_merged", "fx_tags")
O["sft_purchase_examples"] = W(
    lines_ctes("pe_", "(SELECT order_id, p AS product, list_append(loaded_pids, p) AS seq FROM fx_merged, unnest(products) u(p))",
               ["order_id", "product"], "seq")
    + f"""SELECT order_id, product, '' AS instruction,
  array_to_string(list_slice(lines, 1, len(lines) - 1), chr(10)) || chr(10) || CAST(len(lines) AS VARCHAR) || '.' AS input,
  {denum('lines[len(lines)]')} AS output FROM pe_lines""", "fx_merged", "fx_tags")
O["sft_continuation_examples"] = W(lines_ctes("lo_", LOADED, ["order_id"], "seq") + CONT
                                   + "SELECT order_id, instruction, input, output FROM cont", "fx_merged", "fx_tags")
O["sft_product_prompts"] = W("""SELECT c.pid, '' AS instruction, '1. ' || array_to_string(list_slice(t.tags, 1, 5), ', ') || chr(10) || '2.' AS input
FROM fx_products c JOIN fx_tags t ON t.pid = c.pid""", "fx_products", "fx_tags")
O["sft_test_prompts"] = W(
    lines_ctes("tp_", "(SELECT order_id, prefix FROM fx_next_last WHERE split = 'test')", ["order_id"], "prefix")
    + """SELECT order_id, '' AS instruction, array_to_string(lines, chr(10)) || chr(10) || CAST(len(lines) + 1 AS VARCHAR) || '.' AS input
FROM tp_lines""", "fx_next_last", "fx_tags")


def _prompts():
    from tagtrail.constants import PROMPT, PROMPT_LEGACY

    return template_sql(PROMPT), template_sql(PROMPT_LEGACY)


_P, _PL = _prompts()
O["sft_prompt_template"] = W(lines_ctes("lo_", LOADED, ["order_id"], "seq") + CONT
                             + f"SELECT order_id, {_P} AS prompt, {_PL} AS prompt_legacy FROM cont", "fx_merged", "fx_tags")

TOK = "list_filter(regexp_split_to_array({}, '\\s+'), lambda t: t <> '')"
O["sft_token_labels"] = W(lines_ctes("lo_", LOADED, ["order_id"], "seq") + CONT + f"""
, rec AS (SELECT order_id, {_P} AS prompt, output FROM cont)
, vocab AS (SELECT token, row_number() OVER (ORDER BY token) - 1 + 3 AS id FROM (
    SELECT DISTINCT unnest({TOK.format("concat_ws(' ', prompt, output)")}) AS token FROM rec) v)
, pt AS (SELECT order_id, unnest({TOK.format('prompt')}) AS token, generate_subscripts({TOK.format('prompt')}, 1) AS i FROM rec)
, ot AS (SELECT order_id, unnest({TOK.format('output')}) AS token, generate_subscripts({TOK.format('output')}, 1) AS i FROM rec)
, pids AS (SELECT order_id, list(CAST(v.id AS INTEGER) ORDER BY i) AS ids FROM pt JOIN vocab v USING (token) GROUP BY order_id)
, oids AS (SELECT order_id, list(CAST(v.id AS INTEGER) ORDER BY i) AS ids FROM ot JOIN vocab v USING (token) GROUP BY order_id)
, fu AS (SELECT r.order_id, list_slice(list_concat([1], coalesce(pids.ids, []), coalesce(oids.ids, []), [2]), 1, 512) AS fl,
                least(len(coalesce(pids.ids, [])) + 1, 512) AS np
         FROM rec r LEFT JOIN pids USING (order_id) LEFT JOIN oids USING (order_id))
, pd AS (SELECT order_id, np, list_concat(fl, list_transform(range(512 - len(fl)), lambda x: 0)) AS ids FROM fu)
SELECT order_id, array_to_string(ids, ',') AS input_ids,
  array_to_string(list_concat(list_transform(range(np), lambda x: -100), list_slice(ids, np + 1, 512)), ',') AS labels,
  array_to_string(list_transform(range(512), lambda x: 1), ',') AS attention_mask FROM pd""", "fx_merged", "fx_tags")
O["user_name_lookup"] = W(lines_ctes("lo_", LOADED, ["order_id"], "seq") + CONT + """SELECT c.order_id, 'User: ' || cu.c_name AS instruction, c.input, c.output
FROM cont c LEFT JOIN customer cu ON cu.c_custkey = c.uuid_ind""", "fx_merged", "fx_tags")
O["union_splits"] = W("SELECT order_id, split FROM fx_merged WHERE split = 'train' UNION ALL SELECT order_id, split FROM fx_merged WHERE split = 'val'",
                      "fx_merged")
O["prompt_config_grid"] = W("""SELECT c.pid, g.config_id, g.temperature, g.top_p,
  '1. ' || array_to_string(list_slice(t.tags, 1, 5), ', ') || chr(10) || '2.' AS input
FROM fx_products c JOIN fx_tags t ON t.pid = c.pid,
  (SELECT 0 AS config_id, CAST(2.0 AS DOUBLE) AS temperature, CAST(0.3 AS DOUBLE) AS top_p UNION ALL
   SELECT 1, CAST(1.0 AS DOUBLE), CAST(0.9 AS DOUBLE) UNION ALL SELECT 2, CAST(0.7 AS DOUBLE), CAST(1.0 AS DOUBLE)) g""",
    "fx_products", "fx_tags")
O["seq_truncate"] = W("""SELECT order_id, array_to_string(list_slice(loaded_pids, 1, 3), ',') AS first3,
  array_to_string(list_slice(loaded_pids, greatest(len(loaded_pids) - 2, 1), len(loaded_pids)), ',') AS last3 FROM fx_merged""", "fx_merged")
O["user_name_classes"] = W("""SELECT CASE WHEN n > 2 THEN 'frequent' WHEN n = 2 THEN 'repeat' ELSE 'first_time' END AS class, count(*) AS n_users
FROM (SELECT uuid_ind, count(*) AS n FROM fx_merged GROUP BY 1) x GROUP BY 1""", "fx_merged")


def shuffled(seed: int) -> str:
    return f"list_transform(list_sort(list_transform(products, lambda p: [md5(order_id || ':' || p || ':{seed}'), CAST(p AS VARCHAR)])), lambda x: x[2])"


O["shuffle_rows"] = W("SELECT order_id, row_number() OVER (ORDER BY md5(order_id || ':1'), order_id) - 1 AS shuffle_rank FROM fx_merged", "fx_merged")
O["shuffle_products"] = W(f"SELECT order_id, array_to_string({shuffled(2)}, ',') AS products FROM fx_merged", "fx_merged")
O["concat_purchases"] = W(f"""SELECT order_id, uuid_ind, array_to_string(list_concat(list_transform(loaded_pids, lambda p: CAST(p AS VARCHAR)), {shuffled(7)}), ',') AS seq
FROM fx_merged""", "fx_merged")
O["sft_dataset"] = W(lines_ctes("lo_", LOADED, ["order_id"], "seq") + CONT + """SELECT c.order_id, c.instruction, c.input, c.output,
  row_number() OVER (ORDER BY md5(c.order_id || ':11'), c.order_id) - 1 AS shuffle_rank
FROM cont c JOIN fx_merged m ON m.order_id = c.order_id WHERE m.split IN ('train', 'val')""", "fx_merged", "fx_tags")


def dataset_sql(src: str, keys: list[str], seed: int, purchase: bool) -> str:
    """Records of sequences ``src`` (keys, uuid_ind, seq) with names, the default lengths and a seeded order."""
    text = " || ':' || ".join(keys)
    if purchase:
        record = f"""array_to_string(list_slice(lines, 1, len(lines) - 1), chr(10)) || chr(10) || CAST(len(lines) AS VARCHAR) || '.' AS input,
  {denum('lines[len(lines)]')} AS output"""
    else:
        record = f"""lines[1] || chr(10) || '2.' AS input, CASE WHEN len(lines) = 2 THEN {denum('lines[2]')}
  ELSE {denum('lines[2]')} || chr(10) || array_to_string(list_slice(lines, 3, len(lines)), chr(10)) END AS output"""
    return W(lines_ctes("ds_", src, [*keys, "uuid_ind"], "seq", 5, 20) + f"""SELECT {", ".join(keys)}, 'User: customer ' || uuid_ind AS instruction, {record},
  row_number() OVER (ORDER BY md5({text} || ':{seed}'), {", ".join(keys)}) - 1 AS shuffle_rank FROM ds_lines""", "fx_merged", "fx_tags")


TV = "split IN ('train', 'val')"
O["sft_dataset_loaded"] = dataset_sql(f"(SELECT order_id, uuid_ind, loaded_pids AS seq FROM fx_merged WHERE len(loaded_pids) >= 2 AND {TV})", ["order_id"], 12, False)
O["sft_dataset_expanded"] = dataset_sql(
    f"(SELECT order_id, uuid_ind, p AS product, list_append(loaded_pids, p) AS seq FROM fx_merged, unnest(products) u(p) WHERE {TV})", ["order_id", "product"], 13, True)
O["sft_dataset_concatenated"] = dataset_sql(
    f"(SELECT order_id, uuid_ind, list_concat(loaded_pids, CAST({shuffled(17)} AS BIGINT[])) AS seq FROM fx_merged WHERE {TV})", ["order_id"], 17, False)
O["assign_user_names"] = W("""
, _n AS (SELECT uuid_ind, count(*) AS n_orders FROM fx_merged GROUP BY 1)
, _frequent AS (SELECT uuid_ind, n_orders, row_number() OVER (ORDER BY md5(uuid_ind || ':4'), uuid_ind) - 1 AS r FROM _n WHERE n_orders > 2)
, _names AS (SELECT name, row_number() OVER (ORDER BY md5(name || ':4'), name) - 1 AS r FROM (SELECT DISTINCT trim(c_name) AS name FROM customer) x)
, _sizes AS (SELECT (SELECT count(*) FROM _frequent) AS nf, (SELECT count(*) FROM _names) AS nn)
, _twice AS (SELECT uuid_ind, n_orders, nf + CAST('0x' || md5(uuid_ind || ':5')[1:8] AS BIGINT) % greatest(nn - nf, 1) AS r FROM _n, _sizes WHERE n_orders = 2)
SELECT u.uuid_ind, u.n_orders, m.name AS user_name FROM (SELECT * FROM _frequent UNION ALL SELECT * FROM _twice) u JOIN _names m ON m.r = u.r
UNION ALL SELECT uuid_ind, n_orders, 'First time buyer' FROM _n WHERE n_orders = 1""", "fx_merged")

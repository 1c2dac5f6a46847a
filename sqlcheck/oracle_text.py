"""Oracle SQL for text parsing, I/O round trips, reports and the grid."""

from __future__ import annotations

from .fixtures_sql import sql_str, with_ctes
from .oracle_eval import BASE_NEXT, O as EVAL, metrics_ctes, tag_bm25_scores

O: dict[str, str] = {}
W = with_ctes


def uni_word(s: str) -> str:
    """Make RE2's ASCII word boundaries behave like Unicode ones: every
    non-ASCII letter / digit becomes '_' (a word character outside every
    tag class), so boundaries fall where Python's would."""
    return (f"regexp_replace(regexp_replace({s}, '[^\\P{{L}}\\x00-\\x7F]', '_', 'g'), "
            f"'[^\\P{{N}}\\x00-\\x7F]', '_', 'g')")


def strip(s: str) -> str:
    return f"regexp_replace({s}, '^\\s+|\\s+$', '', 'g')"


def drop_first(s: str) -> str:
    return f"regexp_replace({s}, '^[^\\n]*\\n', '')"


def parse_tags(s: str, exclude: bool = False) -> str:
    t = drop_first(strip(s)) if exclude else s
    return f"list_transform(regexp_extract_all({uni_word(f'lower({t})')}, '\\b[a-zA-Z- ]+\\b', 0), lambda x: trim(x))"


def parse_words(s: str, exclude: bool = False) -> str:
    t = drop_first(s) if exclude else s
    return f"regexp_extract_all(lower({t}), '[a-zA-Z-]{{2,}}', 0)"


def clean_gen(s: str) -> str:
    out = f"split_part({s}, '[/INST]', 2)"
    from tagtrail.constants import GENERATION_MARKERS

    for p in GENERATION_MARKERS:
        out = f"regexp_replace({out}, {sql_str(p)}, '', 'gi')"
    return out


O["parse_tags"] = W(f"""SELECT pid, array_to_string({parse_tags('raw_predict')}, '|') AS tags,
  array_to_string({parse_tags('raw_predict', True)}, '|') AS tags_no_input FROM fx_predictions""", "fx_predictions")
O["parse_words"] = W(f"""SELECT pid, array_to_string({parse_words('raw_predict')}, '|') AS words,
  array_to_string({parse_words('raw_predict', True)}, '|') AS words_no_input FROM fx_predictions""", "fx_predictions")
O["drop_first_line"] = W(f"SELECT pid, {drop_first('raw_predict')} AS text FROM fx_predictions", "fx_predictions")
O["enhanced_tags"] = W(f"""SELECT pid, array_to_string(list_concat(list_slice({parse_tags('raw_predict')}, 1, 9),
  [CAST(pid AS VARCHAR), CAST(pid AS VARCHAR), CAST(pid AS VARCHAR)]), '|') AS tags FROM fx_predictions""", "fx_predictions")
O["enhanced_words"] = W(f"""SELECT pid, array_to_string(list_concat({parse_words('raw_predict', True)}, [CAST(pid AS VARCHAR)]), '|') AS tags
FROM fx_predictions""", "fx_predictions")
O["pid_only_tags"] = W("SELECT pid, CAST(pid AS VARCHAR) AS tags FROM fx_products", "fx_products")
O["clean_generation"] = W(f"SELECT pid, {clean_gen('generation')} AS text FROM fx_generations", "fx_generations")
O["tags_lower"] = W("SELECT pid, array_to_string(list_transform(tags, lambda t: lower(t)), '|') AS tags FROM fx_tags", "fx_tags")
O["src_json_tag_map"] = O["tags_lower"]
O["sink_json_map"] = W("SELECT pid, raw_predict FROM fx_predictions", "fx_predictions")
O["src_json_text_map"] = W(f"SELECT pid, {clean_gen('generation')} AS text FROM fx_generations", "fx_generations")
O["sink_json_ids"] = W("""SELECT '[' || array_to_string(list(pid ORDER BY pid), ',') || ']' AS json FROM fx_products GROUP BY pid // 25""",
                       "fx_products")
O["src_json_id_list"] = W("SELECT pid FROM fx_products", "fx_products")
O["src_csv_metrics"] = W("""SELECT epoch, split, CAST("hr@20" AS DOUBLE) AS "hr@20", CAST("ndcg@20" AS DOUBLE) AS "ndcg@20"
FROM fx_training_log""", "fx_training_log")
O["sink_csv_report"] = EVAL["metrics_report"]
O["src_name_list"] = "SELECT DISTINCT trim(c_name) AS name FROM customer WHERE trim(c_name) <> ''"
O["run_id_hash"] = """SELECT p_partkey AS pid,
  substring(sha256('{"do_sample":true,"temperature":' || CAST(p_size AS VARCHAR) || ',"top_p":0.3}'), 1, 8) AS run_id FROM part"""
O["metrics_log_head"] = W("""SELECT epoch, split, "hr@20", "ndcg@20" FROM (
  SELECT *, row_number() OVER (PARTITION BY split ORDER BY epoch) AS rn FROM fx_training_log) x WHERE rn <= 10""", "fx_training_log")
O["metrics_log_best"] = W("""SELECT epoch, split, "hr@20", "ndcg@20" FROM (
  SELECT *, rank() OVER (PARTITION BY split ORDER BY "ndcg@20" DESC) AS r FROM fx_training_log) x WHERE r = 1""", "fx_training_log")
O["metrics_log_last"] = W("""SELECT split, epoch, "hr@20", "ndcg@20" FROM (
  SELECT *, row_number() OVER (PARTITION BY split ORDER BY epoch DESC) AS rn FROM fx_training_log) x WHERE rn = 1""", "fx_training_log")

_tm = W(BASE_NEXT + tag_bm25_scores("b_", "union") + metrics_ctes("m_", "b_sc", "_ntruth")
       + """SELECT l.split, l.epoch, l."hr@20", l."ndcg@20", r."ndcg@20" AS reference,
  round(l."ndcg@20" - r."ndcg@20", 6) AS delta FROM fx_training_log l JOIN m_out r ON l.split = r.split""",
       "fx_next_last", "fx_tags", "fx_products", "fx_training_log")


def _grid() -> str:
    """All cells of the grid as rows: the cell is a key of every step."""
    k, b, one = "CAST(0.75 AS DOUBLE)", "CAST(0.75 AS DOUBLE)", "CAST(1 AS DOUBLE)"
    return f"""
, cells AS (SELECT 'l' || m || '_p' || p AS cell, m, p FROM range(8, 11) a(m), range(0, 7) c(p))
, gp AS (SELECT pid, {parse_tags('raw_predict')} AS t FROM fx_predictions WHERE pid IN (SELECT pid FROM fx_products))
, gt AS (SELECT cell, pid, list_concat(list_slice(t, 1, m), list_transform(range(p), lambda x: CAST(pid AS VARCHAR))) AS tags FROM gp, cells)
, glt AS (SELECT t.cell, x.order_id, x.pos, x.n_pos, t.tags FROM (
    SELECT order_id, len(prefix) AS n_pos, unnest(prefix) AS pid, generate_subscripts(prefix, 1) - 1 AS pos FROM fx_next_last) x
    JOIN gt t ON t.pid = x.pid)
, gcnt AS (SELECT cell, order_id, pos, n_pos, term, count(*) AS cnt
           FROM (SELECT cell, order_id, pos, n_pos, unnest(tags) AS term FROM glt) y GROUP BY ALL)
, gq AS (SELECT 'sum' AS qf, cell, order_id, term, CAST(sum(cnt) AS BIGINT) AS qty FROM gcnt GROUP BY ALL
   UNION ALL SELECT 'union', cell, order_id, term, max(cnt) FROM gcnt GROUP BY ALL
   UNION ALL SELECT 'last', cell, order_id, term, cnt FROM gcnt WHERE pos = n_pos - 1)
, gdl AS (SELECT cell, pid, len(tags) AS dl FROM gt)
, gcs AS (SELECT cell, count(*) AS n_docs, avg(dl) AS avgdl FROM gdl GROUP BY cell)
, gtf AS (SELECT cell, term, pid, count(*) AS tf FROM (SELECT cell, pid, unnest(tags) AS term FROM gt) x GROUP BY ALL)
, gidf AS (SELECT f.cell, f.term, ln(n_docs - df + 0.5) - ln(df + 0.5) AS idf
           FROM (SELECT cell, term, count(*) AS df FROM gtf GROUP BY ALL) f JOIN gcs c ON c.cell = f.cell)
, gpost AS (SELECT f.cell, f.term, f.pid, i.idf * f.tf * ({k} + 1) / (f.tf + {k} * ({one} - {b} + {b} * d.dl / c.avgdl)) AS w
            FROM gtf f JOIN gidf i ON i.cell = f.cell AND i.term = f.term JOIN gdl d ON d.cell = f.cell AND d.pid = f.pid
            JOIN gcs c ON c.cell = f.cell WHERE i.idf > 1)
, gsc AS (SELECT q.qf || '_' || q.cell || '#' || q.order_id AS order_id, p.pid, round(sum(q.qty * p.w), 9) AS score
          FROM gq q JOIN gpost p ON p.cell = q.cell AND p.term = q.term GROUP BY ALL)
, gtruth AS (SELECT f.qf || '_' || cell || '#' || order_id AS order_id, f.qf || '_' || cell || '#' || split AS split, target AS pid
             FROM fx_next_last, cells, (VALUES ('sum'), ('union'), ('last')) f(qf))
""" + metrics_ctes("g_", "gsc", "gtruth") + """SELECT split_part(split, '#', 1) AS config_id, split_part(split, '#', 2) AS split, * EXCLUDE (split) FROM g_out"""


O["eval_grid"] = W(_grid(), "fx_predictions", "fx_products", "fx_next_last")
O["epoch_vs_reference_metric"] = _tm

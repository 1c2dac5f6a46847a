"""oracle_sql(): DuckDB SQL per registered query key."""

from __future__ import annotations

from .fixtures_sql import with_ctes

KS = (5, 10, 20)


def _rank_metrics_sql(rank_col: str = "rnk") -> str:
    cols = []
    for k in KS:
        cols.append(f'round(avg(CASE WHEN {rank_col} BETWEEN 1 AND {k} THEN 1.0 ELSE 0.0 END), 6) AS "hr@{k}"')
    for k in KS:
        cols.append(f'round(avg(CASE WHEN {rank_col} BETWEEN 1 AND {k} THEN 1.0 / {rank_col} ELSE 0.0 END), 6) AS "mrr@{k}"')
    for k in KS:
        cols.append(f'round(avg(CASE WHEN {rank_col} BETWEEN 1 AND {k} THEN 1.0 / log2(1 + {rank_col}) ELSE 0.0 END), 6) AS "ndcg@{k}"')
    return ",\n  ".join(cols)


ORACLE: dict[str, str] = {}

ORACLE["baseline_metrics"] = with_ctes(
    f"""
, pp AS (SELECT order_id, pid, max(i) AS lp FROM (
    SELECT order_id, unnest(prefix) AS pid, generate_subscripts(prefix, 1) AS i FROM fx_next_last) x GROUP BY 1, 2)
, rk AS (SELECT n.order_id, n.split, (SELECT count(*) FROM pp q WHERE q.order_id = n.order_id AND q.lp >= t.lp) AS rnk
         FROM fx_next_last n LEFT JOIN pp t ON t.order_id = n.order_id AND t.pid = n.target)
SELECT split, count(*) AS n_orders,
  {_rank_metrics_sql()}
FROM rk GROUP BY split""",
    "fx_next_last",
)

from .oracle_prep import O as _prep  # noqa: E402

ORACLE.update(_prep)

from .oracle_eval import O as _eval  # noqa: E402

ORACLE.update(_eval)

from .oracle_text import O as _text  # noqa: E402

ORACLE.update(_text)

from .oracle_sft import O as _sft  # noqa: E402

ORACLE.update(_sft)

from .oracle_sim import O as _sim  # noqa: E402

ORACLE.update(_sim)

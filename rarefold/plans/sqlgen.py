"""Small SQL text builders shared by the oracle statements (DuckDB dialect).

They restate our definitions over the raw tables; no value computed by Spark
is ever read back by an oracle.
"""

from __future__ import annotations

from ..operators.scoring import SCORE_METRICS


def scorecard_ctes(src: str, key, prefix: str = "sc") -> str:
    """CTE ``{prefix}_card`` (keys, metrics…, auc) over ``src(keys, label, pred, proba)``."""
    p = prefix
    key = ", ".join(key) if isinstance(key, (list, tuple)) else key
    return f"""{p}_cf AS (
  SELECT {key}, count_if(label = 0 AND pred = 0)::BIGINT AS tn, count_if(label = 0 AND pred = 1)::BIGINT AS fp,
         count_if(label = 1 AND pred = 0)::BIGINT AS fn, count_if(label = 1 AND pred = 1)::BIGINT AS tp
  FROM {src} GROUP BY {key}),
{p}_rt AS (
  SELECT *, CASE WHEN fn + tp <> 0 THEN tp::DOUBLE / (fn + tp) END AS rp,
            CASE WHEN tn + fp <> 0 THEN tn::DOUBLE / (tn + fp) END AS rn,
            CASE WHEN tp + fp <> 0 THEN tp::DOUBLE / (tp + fp) END AS precision
  FROM {p}_cf),
{p}_r2 AS (
  SELECT {key}, tn, fp, fn, tp, precision,
         CASE WHEN tn + fp > fn + tp THEN rp ELSE rn END AS tpr,
         CASE WHEN tn + fp > fn + tp THEN rn ELSE rp END AS tnr
  FROM {p}_rt),
{p}_ps AS (
  SELECT {key}, proba, sum(label) AS pos, sum(1 - label) AS neg FROM {src} GROUP BY {key}, proba),
{p}_pc AS (
  SELECT *, coalesce(sum(neg) OVER (PARTITION BY {key} ORDER BY proba
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM {p}_ps),
{p}_auc AS (
  SELECT {key}, CASE WHEN sum(pos) * sum(neg) <> 0
         THEN sum(pos * (below + neg / 2.0))::DOUBLE / (sum(pos) * sum(neg))::DOUBLE END AS auc
  FROM {p}_pc GROUP BY {key}),
{p}_card AS (
  SELECT *, tpr AS recall, sqrt(tpr * tnr) AS gmean,
         CASE WHEN precision + tpr <> 0 THEN 2 * precision * tpr / (precision + tpr) END AS f1,
         CASE WHEN 4 * precision + tpr <> 0 THEN 5 * precision * tpr / (4 * precision + tpr) END AS f2
  FROM {p}_r2 LEFT JOIN {p}_auc USING ({key}))"""


def unpivot(src: str, key_select: str, metrics=None, digits: int = 6) -> str:
    """UNION ALL unpivot that keeps NULL values (as Spark's ``unpivot`` does)."""
    metrics = metrics or (SCORE_METRICS + ["auc"])
    parts = [f"SELECT {key_select}, '{m}' AS metric, round(CAST({m} AS DOUBLE), {digits}) AS value FROM {src}"
             for m in metrics]
    return "\nUNION ALL\n".join(parts)


def sround(expr: str, digits: int = 6) -> str:
    """Round the way Spark rounds a double (its shortest decimal form, half up).

    DuckDB's ``round(DOUBLE)`` works on the binary value, so an average of
    already-rounded numbers such as 0.5208335 (binary 0.52083349999...) would
    round down; going through a wide DECIMAL first restates Spark's rule."""
    return f"CAST(round(CAST({expr} AS DECIMAL(38, 12)), {digits}) AS DOUBLE)"

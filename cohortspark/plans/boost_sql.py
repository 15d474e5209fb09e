"""SQL restatement of boosted symmetric trees: every question is tried by a join, level by level."""

from __future__ import annotations

from collections.abc import Sequence

from cohortspark.schema import NUMERIC_COLS, TARGET_COLS


def boost_ctes(*, rounds: int, depth: int, rate: float, l2: float, features: Sequence[str] = NUMERIC_COLS, targets: Sequence[str] = TARGET_COLS) -> str:
    """CTEs ``e0 … e<rounds>`` with the raw predictions ``p_<i>`` of every row after each tree.

    Needs ``splitted`` (features, split) and ``tg`` (targets ``y_<name>``). Learns from the train rows.
    """
    k = range(len(targets))
    wide = ", ".join(f"CAST(s.{f} AS DOUBLE) AS x{j}" for j, f in enumerate(features))
    long = " UNION ALL ".join(f"SELECT row_id, copy_no, {j} AS f, x{j} AS v FROM bx" for j in range(len(features)))
    start = ", ".join(f"(SELECT avg(y{i}) FROM bx WHERE split = 'train') AS p_{i}" for i in k)
    sql = f""", bx AS MATERIALIZED (SELECT s.row_id, s.copy_no, s.split, {wide}, {", ".join(f"tg.y_{t} AS y{i}" for i, t in enumerate(targets))}
  FROM splitted s JOIN tg USING (row_id, copy_no)),
fx AS MATERIALIZED ({long}),
cut AS MATERIALIZED (SELECT f, c FROM (SELECT f, v AS c, max(v) OVER (PARTITION BY f) AS top
  FROM (SELECT DISTINCT f, v FROM fx JOIN bx USING (row_id, copy_no) WHERE split = 'train')) WHERE c < top),
e0 AS MATERIALIZED (SELECT row_id, copy_no, split, {", ".join(f"y{i}" for i in k)}, {start} FROM bx)"""
    for r in range(rounds):
        left = ", ".join(f"y{i} - p_{i} AS r{i}" for i in k)
        sql += f",\nn{r}_0 AS MATERIALIZED (SELECT row_id, copy_no, split, 0 AS node, {left} FROM e{r})"
        for d in range(depth):
            sums = ", ".join(f"sum(r{i}) AS s{i}, coalesce(sum(r{i}) FILTER (WHERE v > c), 0e0) AS t{i}" for i in k)
            gain = " + ".join(f"t{i} * t{i} / (wr + {l2}) + (s{i} - t{i}) * (s{i} - t{i}) / (w - wr + {l2}) - s{i} * s{i} / (w + {l2})" for i in k)
            sql += f""",
g{r}_{d} AS MATERIALIZED (SELECT f, c, sum({gain}) AS gain FROM (
  SELECT f, c, node, CAST(count(*) AS DOUBLE) AS w, CAST(count(*) FILTER (WHERE v > c) AS DOUBLE) AS wr, {sums}
  FROM n{r}_{d} JOIN fx USING (row_id, copy_no) JOIN cut USING (f) WHERE split = 'train' GROUP BY f, c, node) GROUP BY f, c),
b{r}_{d} AS MATERIALIZED (SELECT f, c FROM g{r}_{d} ORDER BY CAST(printf('%.9e', gain) AS DOUBLE) DESC, f, c LIMIT 1),
n{r}_{d + 1} AS MATERIALIZED (SELECT n.* REPLACE (n.node + CASE WHEN v > c THEN {1 << d} ELSE 0 END AS node)
  FROM n{r}_{d} n JOIN (SELECT row_id, copy_no, v, c FROM fx JOIN b{r}_{d} USING (f)) USING (row_id, copy_no))"""
        leaves = ", ".join(f"{rate} * sum(r{i}) / (count(*) + {l2}) AS l{i}" for i in k)
        sql += f""",
l{r} AS (SELECT node, {leaves} FROM n{r}_{depth} WHERE split = 'train' GROUP BY node),
e{r + 1} AS MATERIALIZED (SELECT e.row_id, e.copy_no, e.split, {", ".join(f"y{i}" for i in k)}, {", ".join(f"p_{i} + coalesce(l{i}, 0e0) AS p_{i}" for i in k)}
  FROM e{r} e JOIN n{r}_{depth} n USING (row_id, copy_no) LEFT JOIN l{r} USING (node))"""
    return sql + "\n"


def staged_sql(rounds: int, targets: Sequence[str] = TARGET_COLS) -> str:
    """``(split, round, rmse, is_best)``: errors of every prefix; the best prefix has the least test error."""
    sq = " + ".join(f"(y{i} - p_{i}) * (y{i} - p_{i})" for i in range(len(targets)))
    parts = " UNION ALL ".join(f"SELECT split, {r} AS round, sqrt(avg({sq})) AS rmse FROM e{r} GROUP BY split" for r in range(rounds + 1))
    return f""", st AS ({parts})
SELECT split, CAST(round AS INTEGER) AS round, round(rmse, 6) AS rmse, round = (SELECT arg_min(round, rmse) FROM st WHERE split = 'test') AS is_best FROM st"""

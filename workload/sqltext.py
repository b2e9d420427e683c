"""Building blocks of the check SQL (DuckDB dialect), written apart from the Spark expressions."""

from __future__ import annotations

import math


def d(x: float) -> str:
    """A DOUBLE literal."""
    text = repr(float(x))
    return text if "e" in text else text + "e0"


def h(seed, stream: str, key: str, col: str = "") -> str:
    return f"md5(concat_ws('|', '', '{seed}', '{stream}', {key}, '{col}'))"


def u(hash_sql: str, n: int = 0) -> str:
    return f"(CAST(('0x' || substr({hash_sql}, {1 + 13 * n}, 13)) AS BIGINT) / 4503599627370496.0e0)"


def text(column: str) -> str:
    return f"CAST({column} AS VARCHAR)"


def split(key: str) -> str:
    return f"CASE WHEN {u(h(42, 'split', key))} < 0.2e0 THEN 'test' ELSE 'train' END"


# unique row identity of lineitem
LINE_KEY = (
    "concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR),"
    " CAST(l_suppkey AS VARCHAR), CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR),"
    " CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS VARCHAR))"
)
LINE_IDS = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


def minmax(x: str, lo: str, hi: str, to_lo: float = -1.0, to_hi: float = 1.0) -> str:
    """Train range (columns lo, hi) to [to_lo, to_hi]."""
    return f"({d(to_lo)} + ({x} - {lo}) / (CASE WHEN {hi} = {lo} THEN 1.0e0 ELSE {hi} - {lo} END) * {d(to_hi - to_lo)})"


def pm_constants(eps: float, t: float) -> dict[str, float]:
    e, tt = math.exp(eps), math.exp(eps / t)
    k = (e + tt) / (tt * (e - 1.0))
    return {"t": tt, "k": k, "a": (e + tt) * (tt + 1.0) / (tt * (e - 1.0)), "p": e / (e + tt)}


def pm_core(v: str, eps: float, t: float) -> tuple[str, str]:
    c = pm_constants(eps, t)
    return (
        f"({d(c['k'])} * ({v} * {d(c['t'])} - 1.0e0))",
        f"({d(c['k'])} * ({v} * {d(c['t'])} + 1.0e0))",
    )


def pm(v: str, u0: str, u1: str, eps: float, t: float) -> str:
    """Noisy value; arguments should be plain columns."""
    c = pm_constants(eps, t)
    l, r = pm_core(v, eps, t)
    a = d(c["a"])
    left, right = f"({l} + {a})", f"({a} - {r})"
    w = f"({u1} * ({left} + {right}))"
    tail = f"CASE WHEN {w} < {left} THEN {w} - {a} ELSE {r} + ({w} - {left}) END"
    return f"CASE WHEN {u0} < {d(c['p'])} THEN {l} + ({r} - {l}) * {u1} ELSE {tail} END"


def window_matrix(eps: float, n: int, c: int):
    """Sliding-window mechanism in closed form: (signed outputs, a1, knots, p[position][knot])."""
    e = math.exp(eps)
    q = 1.0 / (c * e + n - c)
    free = n - c
    starts = [(free // 2 + j, free // 2 + j) for j in range(free - free // 2 + (0 if free % 2 else 1))]
    if free % 2:
        starts = [(free // 2, free // 2 + 1)] + [(s, s) for s in range(free // 2 + 1, free + 1)]
    p = [
        [q * sum((e if s <= pos < s + c else 1.0) for s in pair) / 2.0 for pair in starts]
        for pos in range(n)
    ]
    half = n // 2
    index = [i for i in range(-half, half + 1) if i or n % 2]
    a1 = 1.0 / sum(i * p[pos][-1] for pos, i in enumerate(index))
    x = [sum(i * a1 * p[pos][j] for pos, i in enumerate(index)) for j in range(len(starts))]
    x[0], x[-1] = 0.0, 1.0
    return index, a1, x, p


def qm_tables(eps: float, n: int, c: int, name: str = "q") -> str:
    """CTEs ``<name>_cell(pos, i, j, p_left, p_right, x_left, x_right)``: one row per output and segment."""
    index, _, x, p = window_matrix(eps, n, c)
    rows = ", ".join(
        f"({pos}, {i}, {j}, {d(p[pos][j - 1])}, {d(p[pos][j])}, {d(x[j - 1])}, {d(x[j])})"
        for pos, i in enumerate(index)
        for j in range(1, len(x))
    )
    return f"{name}_cell(pos, i, j, p_left, p_right, x_left, x_right) AS (VALUES {rows})"


def qm_probability(rows: str, keys: str, n: int, name: str = "q") -> str:
    """SELECT of (keys, v, u, pos, i, p) for rows (keys, v, u): interpolate, reverse for negative input."""
    return f"""SELECT {keys}, v, u, CASE WHEN v < 0 THEN {n - 1} - pos ELSE pos END AS pos,
      (p_right - p_left) / (x_right - x_left) * (least(abs(v), 1.0e0) - x_right) + p_right AS p
    FROM {rows} JOIN {name}_cell
      ON (least(abs(v), 1.0e0) > x_left OR j = 1) AND least(abs(v), 1.0e0) <= x_right"""


def qm_sample(rows: str, keys: str, n: int, name: str = "q") -> str:
    """SELECT of (keys, idx): cumulate and compare with u."""
    half = n // 2
    shift = f"pos_n - {half}" if n % 2 else f"CASE WHEN pos_n < {half} THEN pos_n - {half} ELSE pos_n - {half} + 1 END"
    return f"""SELECT {keys}, CAST({shift} AS INTEGER) AS idx FROM (
      SELECT {keys}, sum(CASE WHEN pos < {n - 1} AND u >= cum THEN 1 ELSE 0 END) AS pos_n FROM (
        SELECT {keys}, pos, u, sum(p) OVER (PARTITION BY {keys} ORDER BY pos ROWS UNBOUNDED PRECEDING) AS cum
        FROM ({qm_probability(rows, keys, n, name)})
      ) GROUP BY {keys}
    )"""

"""Gradient descent as a chain of CTEs in long form, for all three models and many experiments at once.

Inputs are two relations: ``x(exp, id, f, x)`` with f = 0 for the bias (x = 1) and ``y(exp, id, c, y)`` with
one row per class (a single class 0 for linear and logistic models).
"""

from __future__ import annotations


def predictions(model: str, beta: str, x: str) -> str:
    """(exp, id, c, z, p) of rows under coefficients."""
    z = f"SELECT x.exp, x.id, b.c, sum(x.x * b.b) AS z FROM {x} x JOIN {beta} b ON b.exp = x.exp AND b.f = x.f GROUP BY x.exp, x.id, b.c"
    if model == "linear":
        return f"SELECT exp, id, c, z, z AS p FROM ({z})"
    if model == "logistic":
        return f"SELECT exp, id, c, z, 1.0e0 / (1.0e0 + exp(-greatest(least(z, 500), -500))) AS p FROM ({z})"
    return f"""SELECT exp, id, c, z, ez / sum(ez) OVER (PARTITION BY exp, id) AS p FROM (
      SELECT exp, id, c, z, exp(greatest(least(z, 500), -500) - max(greatest(least(z, 500), -500)) OVER (PARTITION BY exp, id)) AS ez FROM ({z}))"""


def train_ctes(model: str, steps: int, x: str = "x", y: str = "y", lr: float = 0.05, reg: float = 0.1, batch=None) -> str:
    """CTEs ``beta_0(exp, c, f, b)`` to ``beta_<steps>``. ``batch(k)`` names the rows of step k: (exp, id) relation."""
    start = {
        "linear": "avg(y)",
        "logistic": "ln(least(greatest(avg(y), 1e-9), 1 - 1e-9) / (1 - least(greatest(avg(y), 1e-9), 1 - 1e-9)))",
        "softmax": "ln(least(greatest(avg(y), 1e-9), 1 - 1e-9))",
    }[model]
    factor, weight = ("2.0e0", 2 * reg) if model == "linear" else ("1.0e0", reg)
    parts = [
        f"bias AS (SELECT exp, c, {start} AS b FROM {y} GROUP BY exp, c)",
        f"feats AS (SELECT DISTINCT exp, f FROM {x})",
        "beta_0 AS (SELECT s.exp, s.c, t.f, CASE WHEN t.f = 0 THEN s.b ELSE 0.0e0 END AS b FROM bias s JOIN feats t ON t.exp = s.exp)",
    ]
    for k in range(steps):
        rows_x, rows_y = x, y
        if batch is not None:
            parts.append(f"bx_{k} AS MATERIALIZED (SELECT x.* FROM {x} x JOIN {batch(k)} b ON b.exp = x.exp AND b.id = x.id)")
            parts.append(f"by_{k} AS MATERIALIZED (SELECT y.* FROM {y} y JOIN {batch(k)} b ON b.exp = y.exp AND b.id = y.id)")
            rows_x, rows_y = f"bx_{k}", f"by_{k}"
        parts += [
            f"m_{k} AS (SELECT exp, count(DISTINCT id) AS m FROM {rows_y} GROUP BY exp)",
            f"p_{k} AS MATERIALIZED ({predictions(model, f'beta_{k}', rows_x)})",
            f"e_{k} AS MATERIALIZED (SELECT p.exp, p.id, p.c, p.p - y.y AS e FROM p_{k} p JOIN {rows_y} y ON y.exp = p.exp AND y.id = p.id AND y.c = p.c)",
            f"s_{k} AS (SELECT e.exp, e.c, x.f, sum(x.x * e.e) AS s FROM e_{k} e JOIN {rows_x} x ON x.exp = e.exp AND x.id = e.id GROUP BY e.exp, e.c, x.f)",
            f"""g_{k} AS (SELECT b.exp, b.c, b.f, b.b, {factor} * s.s / m.m + CASE WHEN b.f = 0 THEN 0.0e0 ELSE {weight!r}e0 * b.b END AS g
              FROM beta_{k} b JOIN s_{k} s ON s.exp = b.exp AND s.c = b.c AND s.f = b.f JOIN m_{k} m ON m.exp = b.exp)""",
            f"n_{k} AS (SELECT exp, sqrt(sum(g * g)) AS n FROM g_{k} GROUP BY exp)",
            f"""beta_{k + 1} AS MATERIALIZED (SELECT g.exp, g.c, g.f, greatest(least(g.b - {lr!r}e0 * (CASE WHEN n.n > 1 THEN g.g * 1.0e0 / n.n ELSE g.g END), 1.0e0), -1.0e0) AS b
              FROM g_{k} g JOIN n_{k} n ON n.exp = g.exp)""",
        ]
    return ",\n      ".join(parts)


def long_x(source: str, key: str, features, where: str = "TRUE") -> str:
    """x relation from a wide relation with columns exp, key and features."""
    parts = [f"SELECT exp, {key} AS id, 0 AS f, 1.0e0 AS x FROM {source} WHERE {where}"]
    parts += [f"SELECT exp, {key}, {n}, {c} FROM {source} WHERE {where}" for n, c in enumerate(features, start=1)]
    return " UNION ALL ".join(parts)


def auc_sql(source: str, keys: str = "") -> str:
    """AUC per key of a relation (keys, y, score): pairs below plus half the ties."""
    group, over = (f"GROUP BY {keys}, score", f"PARTITION BY {keys} ORDER BY score") if keys else ("GROUP BY score", "ORDER BY score")
    head = f"{keys}, " if keys else ""
    tail = f"GROUP BY {keys}" if keys else ""
    return f"""SELECT {head}sum(pos * (below + 0.5e0 * neg)) / nullif(CAST(sum(pos) AS DOUBLE) * sum(neg), 0) AS auc FROM (
      SELECT {head}pos, neg, sum(neg) OVER ({over}) - neg AS below FROM (
        SELECT {head}score, CAST(sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS pos, CAST(sum(CASE WHEN y = 1 THEN 0 ELSE 1 END) AS DOUBLE) AS neg
        FROM {source} {group})) {tail}"""


def roc_sql(source: str, keys: str = "") -> str:
    """(keys, threshold, fpr, tpr), with the infinite start point."""
    head = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys} " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return f"""SELECT {head}score AS threshold, sum(neg) OVER ({part}ORDER BY score DESC) / nullif(sum(neg) OVER ({part.strip()}), 0) AS fpr,
        sum(pos) OVER ({part}ORDER BY score DESC) / nullif(sum(pos) OVER ({part.strip()}), 0) AS tpr FROM (
        SELECT {head}score, CAST(sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS pos, CAST(sum(CASE WHEN y = 1 THEN 0 ELSE 1 END) AS DOUBLE) AS neg
        FROM {source} GROUP BY {head}score)
      UNION ALL SELECT {head}CAST('inf' AS DOUBLE), 0.0e0, 0.0e0 FROM {source} {group}"""


def youden_sql(source: str, keys: str) -> str:
    return f"""SELECT {keys}, threshold, youden_j FROM (SELECT {keys}, threshold, tpr - fpr AS youden_j,
      row_number() OVER (PARTITION BY {keys} ORDER BY tpr - fpr DESC, threshold DESC) AS rn FROM ({roc_sql(source, keys)})) WHERE rn = 1"""

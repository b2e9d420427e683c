"""Mechanism tables as queries: design, moments, variances, audits, for many budgets at once.

A mechanism is a set of cells ``(eps, n_outputs, [more keys], i, a, j, p)``: probability p of output i (value a)
at knot j. Budgets come in as a table of (eps, n_outputs). Fan-out is by ``explode`` on small ranges; all
aggregates group by the mechanism key first, so one shuffle of the keys places the whole design. The number of tasks
is given: adaptive execution would go by the bytes of the keys, of which a few are many cells.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("eps", "n_outputs")
EPS_STEPS = 10_000
SUM_TOLERANCE = 1e-6
CELL_TOLERANCE = 1e-9
KNOT_GAP = 1e-7
SMOOTHING = 0.1
OBJECTIVES = ("avg", "worst")
# budgets are dealt to tasks of about so many candidate cells
TASK_CELLS = 1_000_000
# cells are dealt to so many tasks a core
TASKS_PER_CORE = 16
# and, where their number is known, to tasks of about so many cells at most
PLACED_CELLS = 500_000


def keyed(df: DataFrame) -> DataFrame:
    """Replace eps by the integer ``eps_e4``.

    Grouping by a floating point column goes through a normalisation that hides an existing partitioning, so
    every aggregate and window would shuffle again. Epsilons have 4 decimals, so the integer is exact.
    """
    return df.withColumn("eps_e4", F.round(F.col("eps") * EPS_STEPS).cast("bigint")).drop("eps")


def unkeyed(df: DataFrame) -> DataFrame:
    """Inverse of ``keyed``; eps takes the place of ``eps_e4``."""
    return df.select(*[epsilon().alias("eps") if c == "eps_e4" else F.col(c) for c in df.columns])


def epsilon() -> Column:
    return F.col("eps_e4") / F.lit(float(EPS_STEPS))


def _inner(keys: Sequence[str]) -> list[str]:
    return ["eps_e4" if k == "eps" else k for k in keys]


def _placed_budgets(budgets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One shuffle by the mechanism key, which serves all later aggregates and windows of a design.

    A job counts the cells that the budgets will have (N outputs have about N**3 / 4 in all their candidates), so that
    what a task holds does not grow with the number of budgets.
    """
    n = F.col("n_outputs").cast("double")
    cells = budgets.agg(F.sum(n * n * n / 4.0)).head()[0] or 0.0
    return keyed(budgets).repartition(1 + int(cells / TASK_CELLS), *_inner(keys))


def _placed(cells: DataFrame, keys: Sequence[str], n_cells: float | None = None) -> DataFrame:
    """The same for cells. Counting them would design them twice, so the number of tasks follows the cores.

    Who knows how many cells there are (``most_cells``, or a count of stored ones) says so, and the tasks follow that too.
    """
    spark = cells.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
    return keyed(cells).repartition(max(tasks, 1 + int((n_cells or 0) / PLACED_CELLS)), *_inner(keys))


def most_cells(budgets: DataFrame, mechanisms: int = 1) -> float:
    """Upper bound of the cells of so many designed mechanisms or start tables a budget; a job over the budgets."""
    n = F.col("n_outputs").cast("double")
    # N outputs have N // 2 + 1 knots at most
    return mechanisms * (budgets.agg(F.sum(n * (F.floor(n / 2) + 1))).head()[0] or 0.0)


def check_sizes(budgets: DataFrame) -> DataFrame:
    """Fail on N <= 1."""
    n = F.col("n_outputs")
    ok = F.when(n > 1, n).otherwise(F.raise_error(F.lit("n_outputs must be greater than 1")).cast("int"))
    return budgets.withColumn("n_outputs", ok)


def distinct_budgets(budgets: DataFrame) -> DataFrame:
    """Mechanism keys to design: epsilon to 4 decimals, as the catalog stores it."""
    return (
        unkeyed(
            keyed(budgets.where(F.col("eps").isNotNull() & F.col("n_outputs").isNotNull()))
            .select("eps_e4", F.col("n_outputs").cast("int").alias("n_outputs"))
            .distinct()
        )
    )


def half() -> Column:
    return F.floor(F.col("n_outputs") / 2).cast("int")


def signed(position: Column) -> Column:
    """Output position 0..N-1 to signed index."""
    n = half()
    odd = F.col("n_outputs") % 2 == 1
    return F.when(odd | (position < n), position - n).otherwise(position - n + 1)


def output_positions(df: DataFrame) -> DataFrame:
    """One row per output: position and signed index i."""
    wide = df.withColumn("pos", F.explode(F.sequence(F.lit(0), F.col("n_outputs") - 1)))
    return wide.withColumn("i", signed(F.col("pos")))


def output_grid(mechanisms: DataFrame, a1: str = "a1") -> DataFrame:
    """Output values a = i * a1."""
    return output_positions(mechanisms).withColumn("a", F.col("i") * F.col(a1)).drop("pos")


def start_table(budgets: DataFrame, smoothing: float = SMOOTHING) -> DataFrame:
    """Discretised piecewise mechanism: n + 1 knots at x = j / n, bins around the outputs.

    Each cell is the overlap of the output's bin with left tail, core and right tail, normalised per knot;
    a1 is rescaled so that the last knot's mean is 1, then a uniform share is mixed in.
    """
    e, a_max, n = F.col("e"), F.col("a_max"), F.col("n")
    base = (
        _placed_budgets(budgets, budgets.columns)
        .withColumn("n", half())
        .withColumn("e", F.exp(epsilon()))
        .withColumn("t", F.exp(epsilon() / 3.0))
        .withColumn("a1_start", (e + 1.0) / ((e - 1.0) * n))
        .withColumn("a_max", n * F.col("a1_start"))
        .withColumn("p_core", e / (e + F.col("t")))
        .withColumn("p_tail", F.col("t") / (e + F.col("t")))
        .withColumn("j", F.explode(F.sequence(F.lit(0), n)))
        .withColumn("x", F.col("j") / n)
        .withColumn("l", (a_max + 1.0) / 2.0 * F.col("x") - (a_max - 1.0) / 2.0)
        .withColumn("r", (a_max + 1.0) / 2.0 * F.col("x") + (a_max - 1.0) / 2.0)
    )
    core_width = F.col("r") - F.col("l")
    tail_width = F.lit(2.0) * a_max - core_width
    dens = base.withColumn(
        "d_core", F.when(core_width > 1e-9, F.col("p_core") / core_width).otherwise(F.lit(0.0))
    ).withColumn("d_tail", F.when(tail_width > 1e-9, F.col("p_tail") / tail_width).otherwise(F.lit(0.0)))
    i = F.col("i")
    cells = (
        output_positions(dens)
        .withColumn("lo", F.when(i == -n, -a_max).otherwise((i - 0.5) / n * a_max))
        .withColumn("hi", F.when(i == n, a_max).otherwise((i + 0.5) / n * a_max))
    )

    def overlap(lo: Column, hi: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.col("hi"), hi) - F.greatest(F.col("lo"), lo))

    raw = (
        overlap(-a_max, F.col("l")) * F.col("d_tail")
        + overlap(F.col("l"), F.col("r")) * F.col("d_core")
        + overlap(F.col("r"), a_max) * F.col("d_tail")
    )
    keys = _inner(budgets.columns)
    per_knot = Window.partitionBy(*keys, "j")
    per_mechanism = Window.partitionBy(*keys)
    weighed = cells.withColumn("raw", raw).withColumn("total", F.sum("raw").over(per_knot))
    plain = weighed.withColumn("p0", F.when(F.col("total") > 1e-9, F.col("raw") / F.col("total")).otherwise(F.col("raw")))
    last_mean = F.sum(F.when(F.col("j") == n, i * F.col("a1_start") * F.col("p0"))).over(per_mechanism)
    scaled = plain.withColumn("x_last", last_mean).withColumn(
        "a1",
        F.when(F.abs("x_last") > 1e-9, F.col("a1_start") / F.col("x_last")).otherwise(F.col("a1_start")),
    )
    mixed = scaled.withColumn("mix", F.lit(1.0 - smoothing) * F.col("p0") + F.lit(smoothing) / F.col("n_outputs"))
    total = F.sum("mix").over(per_knot)
    return unkeyed(
        mixed.select(
            *keys,
            "i",
            (i * F.col("a1")).alias("a"),
            "j",
            F.when(total > 1e-9, F.col("mix") / total).otherwise(F.col("mix")).alias("p"),
        )
    )


def _window_cells(candidates: DataFrame, width: str = "width") -> DataFrame:
    """Cells of sliding-window mechanisms, index form (without a), for keyed candidates.

    A knot is a run of ``width`` neighbouring outputs with probability E q, the others q. Knots slide the
    run from the centre to the right end; when it cannot be centred, the first knot averages the two
    nearly centred runs.
    """
    c, free = F.col(width), F.col("n_outputs") - F.col(width)
    knots = (
        candidates.withColumn("__e", F.exp(epsilon()))
        .withColumn("__q", F.lit(1.0) / (c * F.col("__e") + free))
        .withColumn("j", F.explode(F.sequence(F.lit(0), F.floor((free + 1) / 2).cast("int"))))
        .withColumn("__lo", F.floor(free / 2).cast("int") + F.col("j"))
        .withColumn("__hi", F.col("__lo") + F.when((free % 2 == 1) & (F.col("j") == 0), 1).otherwise(0))
    )

    def level(start: str) -> Column:
        inside = (F.col("pos") >= F.col(start)) & (F.col("pos") < F.col(start) + c)
        return F.when(inside, F.col("__e")).otherwise(F.lit(1.0))

    p = F.col("__q") * (level("__lo") + level("__hi")) / F.lit(2.0)
    return output_positions(knots).withColumn("p", p).select(*candidates.columns, "i", "j", "p")


def _knot_moments(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    return cells.groupBy(*keys, "j").agg(
        F.sum(F.col("a") * F.col("p")).alias("x"),
        F.sum(F.col("a") * F.col("a") * F.col("p")).alias("e2"),
    )


def knot_moments(cells: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean x and second moment e2 of the output at each knot."""
    return unkeyed(_knot_moments(keyed(cells), _inner(keys)))


def _steps(moments: DataFrame, keys: Sequence[str]) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("j")
    return moments.select(
        "*", F.lag("x").over(order).alias("x_prev"), F.lag("e2").over(order).alias("e2_prev")
    ).withColumn("dx", F.col("x") - F.col("x_prev"))


def _average_term() -> Column:
    area = (F.col("e2") + F.col("e2_prev")) / 2.0 * F.col("dx")
    x, y = F.col("x"), F.col("x_prev")
    cubes = (x * x * x - y * y * y) / 3.0
    return F.when(F.abs("dx") > 1e-20, area - cubes).otherwise(F.lit(0.0))


def _worst_term() -> Column:
    """Largest variance at the knot or at a stationary point of the segment that ends there."""
    rise = F.col("e2") - F.col("e2_prev")
    at_knot = F.col("e2") - F.col("x") * F.col("x")
    wide = F.when(F.abs("dx") >= 1e-12, F.col("dx"))
    star = rise / (wide * 2.0)
    inside = (star >= F.col("x_prev") - 1e-9) & (star <= F.col("x") + 1e-9)
    at_star = rise / wide * (star - F.col("x")) + F.col("e2") - star * star
    return F.greatest(at_knot, F.when(inside, at_star))


def variances(cells: DataFrame, keys: Sequence[str] = KEYS, n_cells: float | None = None) -> DataFrame:
    """Average-case and worst-case noise variance of each mechanism over |input| in [x_0, x_n]."""
    inner = _inner(keys)
    return unkeyed(
        _steps(_knot_moments(_placed(cells, keys, n_cells), inner), inner)
        .groupBy(*inner)
        .agg(F.sum(_average_term()).alias("avg_var"), F.max(_worst_term()).alias("worst_var"))
    )


def average_variance(cells: DataFrame, keys: Sequence[str] = KEYS, n_cells: float | None = None) -> DataFrame:
    return variances(cells, keys, n_cells).drop("worst_var")


def worst_variance(cells: DataFrame, keys: Sequence[str] = KEYS, n_cells: float | None = None) -> DataFrame:
    return variances(cells, keys, n_cells).drop("avg_var")


def _candidates(budgets: DataFrame) -> DataFrame:
    """Every window width per keyed budget, with a1 and both variances."""
    keys = [*_inner(KEYS), "width"]
    wide = budgets.withColumn("width", F.explode(F.sequence(F.lit(1), F.col("n_outputs") - 1)))
    by_index = (
        _window_cells(wide)
        .groupBy(*keys, "j")
        .agg(F.sum(F.col("i") * F.col("p")).alias("x"), F.sum(F.col("i") * F.col("i") * F.col("p")).alias("e2"))
    )
    a1 = F.lit(1.0) / F.max("x").over(Window.partitionBy(*keys))
    moments = by_index.withColumn("a1", a1).select(
        *keys, "j", "a1", (F.col("x") * F.col("a1")).alias("x"), (F.col("e2") * F.col("a1") * F.col("a1")).alias("e2")
    )
    return (
        _steps(moments, keys)
        .groupBy(*keys)
        .agg(
            F.first("a1").alias("a1"),
            F.sum(_average_term()).alias("avg_var"),
            F.max(_worst_term()).alias("worst_var"),
        )
    )


def candidates(budgets: DataFrame) -> DataFrame:
    """All candidate mechanisms: (eps, n_outputs, width, a1, avg_var, worst_var)."""
    return unkeyed(_candidates(_placed_budgets(check_sizes(budgets), KEYS)))


def _sweep(budgets: DataFrame, objectives: Sequence[str]) -> DataFrame:
    keys = _inner(KEYS)
    scored = _candidates(budgets)
    picks = [
        F.struct(
            F.lit(o).alias("obj"),
            F.min(F.struct(F.col(f"{o}_var").alias("v"), "width", "a1", "avg_var", "worst_var")).alias("b"),
        )
        for o in objectives
    ]
    best = scored.groupBy(*keys).agg(F.array(*picks).alias("picks")).select(*keys, F.explode("picks").alias("pick"))
    return best.select(
        F.col("pick.obj").alias("obj"),
        *keys,
        *[F.col(f"pick.b.{c}").alias(c) for c in ("width", "a1", "avg_var", "worst_var")],
    )


def sweep(budgets: DataFrame, objectives: Sequence[str] = OBJECTIVES) -> DataFrame:
    """Best width per budget and objective: (obj, eps, n_outputs, width, a1, avg_var, worst_var)."""
    return unkeyed(_sweep(_placed_budgets(check_sizes(budgets), KEYS), objectives))


def design(budgets: DataFrame, objectives: Sequence[str] = OBJECTIVES) -> DataFrame:
    """Catalog cells of the best mechanism per objective: (obj, eps, n_outputs, width, a1, i, a, j, p)."""
    return _chosen_cells(_sweep(_placed_budgets(check_sizes(budgets), KEYS), objectives))


def chosen_cells(chosen: DataFrame) -> DataFrame:
    """The cells of rows of ``sweep``, as ``design`` gives them. Rows are multiplied where they are, without a shuffle."""
    return _chosen_cells(keyed(chosen))


def _chosen_cells(chosen: DataFrame) -> DataFrame:
    chosen = chosen.select("obj", *_inner(KEYS), "width", "a1")
    return unkeyed(_window_cells(chosen)).withColumn("a", F.col("i") * F.col("a1"))


def sum_violations(cells: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Knots whose probabilities do not sum to 1."""
    sums = keyed(cells).groupBy(*_inner(keys), "j").agg(F.sum("p").alias("p_sum"))
    return unkeyed(sums.where(F.abs(F.col("p_sum") - 1.0) > SUM_TOLERANCE))


def ratio_violations(cells: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Cells above E times the smallest probability of their output."""
    inner = _inner(keys)
    lowest = F.min("p").over(Window.partitionBy(*inner, "i"))
    bound = F.exp(epsilon()) * F.col("p_star")
    listed = keyed(cells).withColumn("p_star", lowest).withColumn("upper_bound", bound)
    above = listed.where(F.col("p") > F.col("upper_bound") + CELL_TOLERANCE)
    return unkeyed(above.select(*inner, "i", "j", "p", "p_star", "upper_bound"))


def audit(cells: DataFrame, keys: Sequence[str] = KEYS, min_gap: float | None = None, n_cells: float | None = None) -> DataFrame:
    """Feasibility report, one row per mechanism.

    Counts: knots that do not sum to 1; cells above E times their output's minimum; cells outside
    [p(-i, n), E p(-i, n)] over all inputs, negative ones by reflection p(i, -j) = p(-i, j); outputs whose
    probability at knot 0 is not symmetric; knot gaps that are too small. Checks: last knot at 1, a1 > 0.
    """
    cells, keys = _placed(cells, keys, n_cells), _inner(keys)
    # output i at input j is output |i| at input sign(i) * j; the centre output is on both sides
    sides = F.when(F.col("i") == 0, F.array(F.lit(1), F.lit(-1))).otherwise(F.array(F.signum("i").cast("int")))
    both = cells.select(*keys, F.abs("i").alias("m"), "a", "j", "p", F.explode(sides).alias("side"))
    # one sort by mechanism and output serves both windows
    per_output = Window.partitionBy(*keys, "m")
    side, p = F.col("side"), F.col("p")

    def seen(pick, condition: Column) -> Column:
        return pick(F.when(condition, p)).over(per_output)

    at_zero = F.col("j") == 0
    seen_both = both.select(
        *keys,
        "a",
        "m",
        "j",
        "p",
        "side",
        F.when(side == 1, seen(F.min, side == 1)).otherwise(seen(F.min, side == -1)).alias("p_star"),
        F.max(F.when(side == -1, F.struct("j", "p"))).over(per_output).alias("end"),
        (F.abs(seen(F.max, at_zero & (side == 1)) - seen(F.max, at_zero & (side == -1))) > CELL_TOLERANCE).alias("uneven"),
        F.max("j").over(Window.partitionBy(*keys)).alias("n_knots"),
    )
    # an output without a cell at the last knot has no base
    base = F.when(F.col("end.j") == F.col("n_knots"), F.col("end.p"))
    e = F.exp(epsilon())
    once = (F.col("m") > 0) | (side == 1)
    # a0 leaves a gap of at least 0, no a0 a strictly positive one
    needed = F.when(F.col("n_outputs") % 2 == 1, F.lit(0.0)).otherwise(F.lit(KNOT_GAP)) if min_gap is None else F.lit(float(min_gap))
    knots = seen_both.groupBy(*keys, "j").agg(
        F.sum(F.when(once, F.col("a") * p)).alias("x"),
        F.max("n_knots").alias("n_knots"),
        (F.abs(F.sum(F.when(once, p)) - 1.0) > SUM_TOLERANCE).cast("int").alias("bad_sum"),
        F.sum(F.when(once & (p > e * F.col("p_star") + CELL_TOLERANCE), 1).otherwise(0)).alias("bad_ratio"),
        F.sum(F.when((p < base - CELL_TOLERANCE) | (p > e * base + CELL_TOLERANCE), 1).otherwise(0)).alias("bad_reflected"),
        F.sum(F.when(F.col("uneven") & at_zero & (side == 1), 1).otherwise(0)).alias("uneven"),
        F.min(F.when((F.col("m") == 1) & (side == 1), F.col("a"))).alias("a1"),
    )
    gap = F.col("x") - F.lag("x").over(Window.partitionBy(*keys).orderBy("j"))
    report = (
        knots.withColumn("gap_short", F.when(gap < needed - CELL_TOLERANCE, 1).otherwise(0))
        .groupBy(*keys)
        .agg(
            F.sum("bad_sum").cast("bigint").alias("sum_violations"),
            F.sum("bad_ratio").cast("bigint").alias("ratio_violations"),
            F.sum("bad_reflected").cast("bigint").alias("reflected_violations"),
            F.sum("uneven").cast("bigint").alias("symmetry_violations"),
            F.sum("gap_short").cast("bigint").alias("gap_violations"),
            F.max(F.when(F.col("j") == F.col("n_knots"), F.col("x"))).alias("x_last"),
            F.max("a1").alias("a1"),
        )
    )
    clean = (
        F.col("sum_violations")
        + F.col("ratio_violations")
        + F.col("reflected_violations")
        + F.col("symmetry_violations")
        + F.col("gap_violations")
    ) == 0
    ends = (F.abs(F.col("x_last") - 1.0) <= SUM_TOLERANCE) & (F.col("a1") > 0)
    return unkeyed(report.withColumn("feasible", clean & ends))


def clean_knots(cells: DataFrame, keys: Sequence[str] = KEYS, n_cells: float | None = None) -> DataFrame:
    """Renumber the knots of a mechanism by position when its positions are not increasing."""
    cells, keys = _placed(cells, keys, n_cells), _inner(keys)
    x = cells.groupBy(*keys, "j").agg(F.sum(F.col("a") * F.col("p")).alias("__x"))
    step = F.col("__x") - F.lag("__x").over(Window.partitionBy(*keys).orderBy("j"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("__x", "j")) - 1
    falls = F.coalesce(F.min("__step").over(Window.partitionBy(*keys)) < -1e-9, F.lit(False))
    renamed = x.withColumn("__step", step).select(
        *keys, "j", F.when(falls, rank).otherwise(F.col("j")).alias("__new")
    )
    joined = cells.join(renamed, [*keys, "j"])
    renumbered = joined.select(*[F.col("__new").cast("int").alias("j") if c == "j" else F.col(c) for c in cells.columns])
    return unkeyed(renumbered)


def report(cells: DataFrame, keys: Sequence[str] = KEYS, n_cells: float | None = None) -> DataFrame:
    """Outputs with p > 1e-4 at the first, middle and last knot, with the knot's mean."""
    cells, keys = _placed(cells, keys, n_cells), _inner(keys)
    shown = cells.select(
        *keys,
        "i",
        "a",
        "j",
        "p",
        F.max("j").over(Window.partitionBy(*keys)).alias("__last"),
        F.sum(F.col("a") * F.col("p")).over(Window.partitionBy(*keys, "j")).alias("x"),
    )
    wanted = F.col("j").isin(0) | (F.col("j") == F.col("__last")) | (F.col("j") == F.floor(F.col("__last") / 2))
    return unkeyed(shown.where(wanted & (F.col("p") > 1e-4)).drop("__last"))

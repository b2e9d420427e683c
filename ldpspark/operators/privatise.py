"""Privatisation of table columns: many columns, labels, join forms for per-row mechanisms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import piecewise, quantised, response
from ..functions.layers import Layered, project
from ..functions.rand import digest, draw
from .encode import Categories, decode, ordinal_encode
from .profile import quoted
from .scale import PRIVATE_RANGE, Stats, linear_map, min_max

# A mechanism table of at most this many outputs in all (three 8-byte values each, so 24 MB) is broadcast; a larger
# one is joined by shuffle (AQE splits the partitions of a budget that many rows share).
BROADCAST_OUTPUTS = 1_000_000


def scaled(column: str, s: Stats) -> Column:
    """Column on the mechanism's domain [-1, 1], by its train range."""
    return min_max(quoted(column).cast("double"), s, *PRIVATE_RANGE)


def perturb_pm(
    df: DataFrame,
    columns: Sequence[str],
    fitted: dict[str, Stats],
    mechanism: piecewise.Piecewise | dict[str, Column],
    key: Column,
    seed,
    **options,
) -> DataFrame:
    """Every column gets its own draw at the full budget; all of them in one pass over the rows."""
    params = mechanism.columns() if isinstance(mechanism, piecewise.Piecewise) else mechanism
    row = F.col("__key")
    stacks = [piecewise.perturb(c, scaled(c, fitted[c]), params, row, seed, c, **options) for c in columns]
    return project(df.withColumn("__key", key), stacks).drop("__key")


def perturb_qm(
    df: DataFrame,
    columns: Sequence[str],
    fitted: dict[str, Stats],
    lookup: quantised.Lookup,
    key: Column,
    seed,
    **options,
) -> DataFrame:
    """Signed output index per column."""
    row = F.col("__key")
    stacks = [quantised.sample(c, scaled(c, fitted[c]), lookup, row, seed, c, **options) for c in columns]
    return project(df.withColumn("__key", key), stacks).drop("__key")


def pm_label_to_range(label: Column, a, s: Stats) -> Column:
    """LDP output in [-A, A] back onto the train label range."""
    bound = a if isinstance(a, Column) else F.lit(float(a))
    return linear_map(label, -bound, bound, F.lit(s.min), F.lit(s.max))


def qm_label_to_range(index: Column, index_min: int, index_max: int, s: Stats) -> Column:
    return linear_map(index.cast("double"), index_min, index_max, s.min, s.max)


def respond(
    df: DataFrame,
    column: str,
    cats: Categories,
    eps: float,
    key: Column,
    seed,
    *,
    mode: str = "strict",
    salt: str = "",
    output: str | None = None,
) -> DataFrame:
    """Randomised response on a categorical column; a value outside ``cats`` fails the job."""
    out = output or column
    p = response.keep_probability(eps, max(cats.size, 1))
    coded = ordinal_encode(df, column, cats, "__code", unknown=None)
    unseen = quoted(column).isNotNull() & F.col("__code").isNull()
    message = F.concat(F.lit(f"unknown category in '{column}': "), quoted(column).cast("string"))
    checked = coded.withColumn("__code", F.when(unseen, F.raise_error(message)).otherwise(F.col("__code")))
    noisy = project(
        checked,
        [response.respond_index("__noisy", F.col("__code"), cats.size, p, key, seed, column, mode=mode, salt=salt)],
    )
    return decode(noisy, "__noisy", cats, out).drop("__code", "__noisy")


def segments(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mechanism cells (keys, i, a, j, p) as one row per segment between neighbouring knots.

    Columns: x_left, x_right (first and last segment are open-ended), x_min, x_max of the mechanism,
    and arrays of output indices, right-hand probabilities and slopes in output order.
    """
    from pyspark.sql import Window

    keys = list(keys)
    knots = cells.groupBy(*keys, "j").agg(
        F.sum(F.col("a") * F.col("p")).alias("x"),
        F.array_sort(F.collect_list(F.struct("i", "p"))).alias("cell"),
    )
    order = Window.partitionBy(*keys).orderBy("x", "j")
    whole = Window.partitionBy(*keys)
    paired = knots.select(
        *keys,
        "x",
        F.col("cell.i").alias("outputs"),
        F.col("cell.p").alias("p_right"),
        F.lag("x").over(order).alias("x_before"),
        F.lag(F.col("cell.p")).over(order).alias("p_left"),
        F.row_number().over(order).alias("__n"),
        F.max("x").over(whole).alias("x_max"),
        F.min("x").over(whole).alias("x_min"),
        F.count(F.lit(1)).over(whole).alias("__k"),
    ).where(F.col("__n") > 1)
    dx = F.col("x") - F.col("x_before")
    safe = F.when(F.abs(dx) < 1e-9, F.lit(1.0)).otherwise(dx)
    slopes = F.zip_with("p_right", "p_left", lambda r, l: (r - l) / F.col("__dx"))
    return (
        paired.withColumn("__dx", safe)
        .withColumn("slope", slopes)
        .select(
            *keys,
            F.when(F.col("__n") == 2, F.lit(float("-inf"))).otherwise(F.col("x_before")).alias("x_left"),
            F.when(F.col("__n") == F.col("__k"), F.lit(float("inf"))).otherwise(F.col("x")).alias("x_right"),
            F.col("x").alias("x_knot"),
            "x_min",
            "x_max",
            "outputs",
            "p_right",
            "slope",
        )
    )


def bounded_broadcast(mechanism_segments: DataFrame, most: int = BROADCAST_OUTPUTS) -> DataFrame:
    """Broadcast hint only after counting that all arrays of the table together are small."""
    held = mechanism_segments.agg(F.sum(F.size("outputs"))).first()[0] or 0
    return F.broadcast(mechanism_segments) if held <= most else mechanism_segments


def sample_by_budget(
    df: DataFrame,
    value: Column,
    mechanism_segments: DataFrame,
    keys: Sequence[str],
    key: Column,
    seed,
    col: str,
    output: str,
    *,
    stream: str = "qm",
    salt: str = "",
) -> DataFrame:
    """Quantised sample when every row names its own mechanism (columns ``keys``), any N.

    An equality join on the mechanism key with a range condition on the magnitude: exactly one segment per
    row. A NULL value keeps its row, with a NULL output.
    """
    keys = list(keys)
    side = bounded_broadcast(mechanism_segments)
    rows = df.withColumn("__v", value).withColumn("__h", digest(seed, stream, key, col, salt))
    lower = F.abs(F.col("__v"))
    same = [F.col(f"r.`{k}`") == F.col(f"s.`{k}`") for k in keys]
    inside = (lower > F.col("s.x_left")) & (lower <= F.col("s.x_right"))
    condition = same[0]
    for extra in [*same[1:], inside]:
        condition = condition & extra
    joined = rows.alias("r").join(side.alias("s"), condition, "left")
    magnitude = F.least(F.greatest(F.abs(F.col("__v")), F.col("x_min")), F.col("x_max"))
    probs = F.zip_with("p_right", "slope", lambda p, m: F.greatest(m * (F.col("__a") - F.col("x_knot")) + p, F.lit(0.0)))
    base = [F.col(f"r.`{c}`") for c in df.columns]
    staged = joined.select(
        *base,
        "__v",
        draw(F.col("__h"), 0).alias("__u"),
        F.when(F.col("__v").isNotNull(), magnitude).alias("__a"),
        "x_knot",
        "outputs",
        "p_right",
        "slope",
    ).withColumn("__p", probs)
    oriented = staged.withColumn("__q", F.when(F.col("__v") < 0, F.reverse("__p")).otherwise(F.col("__p")))
    total = F.aggregate("__q", F.lit(0.0), lambda s, p: s + p)
    # running sum walks the outputs; position = number of thresholds at or below the draw, of the first N-1
    walk = F.aggregate(
        F.slice("__q", 1, F.size("__q") - 1),
        F.struct(F.lit(0.0).alias("cum"), F.lit(0).alias("pos")),
        lambda s, p: F.struct(
            (s["cum"] + p / F.col("__total")).alias("cum"),
            (s["pos"] + F.when(F.col("__u") >= s["cum"] + p / F.col("__total"), 1).otherwise(0)).alias("pos"),
        ),
        lambda s: s["pos"],
    )
    positioned = oriented.withColumn("__total", F.when(total < 1e-9, F.lit(1.0)).otherwise(total)).withColumn("__pos", walk)
    return positioned.select(*[quoted(c) for c in df.columns], F.get("outputs", F.col("__pos")).cast("int").alias(output))



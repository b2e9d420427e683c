"""Mechanism catalog: designed mechanisms as a Parquet table of cells, keyed by (obj, eps, n_outputs)."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import ROUND_HALF_UP, Decimal

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.quantised import Quantised
from ..operators import mechanism as mech
from ..session import settle

KEY = ("obj", "eps", "n_outputs")
# how many infeasible mechanisms an error message names
MAX_LISTED = 5
CELL_SCHEMA = "obj string, eps double, n_outputs int, i int, a double, j int, p double"


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """The stored cells; an absent catalog is empty."""
    try:
        return spark.read.schema(CELL_SCHEMA).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], CELL_SCHEMA)


def store(cells: DataFrame, path: str) -> None:
    """Append mechanisms, for instance ones that were optimised elsewhere. Infeasible ones are refused."""
    broken = mech.audit(cells).where(~F.col("feasible")).head(MAX_LISTED)
    if broken:
        raise ValueError("infeasible mechanisms: " + "; ".join(str(r.asDict()) for r in broken))
    _append(cells, path)


def _append(cells: DataFrame, path: str) -> None:
    typed = cells.select(
        "obj",
        F.col("eps").cast("double"),
        F.col("n_outputs").cast("int"),
        F.col("i").cast("int"),
        F.col("a").cast("double"),
        F.col("j").cast("int"),
        F.col("p").cast("double"),
    )
    typed.write.mode("append").parquet(path)


def missing(wanted: DataFrame, catalog: DataFrame) -> DataFrame:
    """Wanted keys that the catalog lacks."""
    return wanted.join(catalog.select(*KEY).distinct(), list(KEY), "left_anti")


def get_or_create(wanted: DataFrame, path: str) -> DataFrame:
    """Cells of all wanted keys (obj, eps, n_outputs); designs and appends the missing ones first."""
    spark = wanted.sparkSession
    keys = wanted.select(
        "obj", F.round("eps", 4).alias("eps"), F.col("n_outputs").cast("int").alias("n_outputs")
    ).distinct()
    catalog = read_catalog(spark, path)
    # asked for several times; without this the catalog is read each time
    absent = settle(missing(keys, catalog))
    if not absent.isEmpty():
        # mechanisms are joined, not their cells
        chosen = mech.sweep(absent.select("eps", "n_outputs").distinct()).join(absent, list(KEY), "left_semi")
        # feasible by construction
        _append(mech.chosen_cells(chosen), path)
        catalog = read_catalog(spark, path)
    # a map of the keys: cells are not sorted
    return catalog.join(keys.hint("shuffle_hash"), list(KEY), "left_semi")


def lookup_key(obj: str, eps: float, n_outputs: int) -> tuple[str, float, int]:
    # half up on the decimal form, as Spark rounds
    return obj, float(Decimal(repr(float(eps))).quantize(Decimal("0.0001"), ROUND_HALF_UP)), int(n_outputs)


def collect_mechanisms(cells: DataFrame) -> dict[tuple[str, float, int], Quantised]:
    """Mechanisms as driver objects, for the few keys of one run grid."""
    grouped: dict[tuple, list] = {}
    for r in cells.select(*KEY, "i", "a", "j", "p").collect():
        grouped.setdefault((r["obj"], r["eps"], r["n_outputs"]), []).append(r)
    out = {}
    for key, rows in grouped.items():
        outputs = sorted({r["i"] for r in rows})
        knots = max(r["j"] for r in rows) + 1
        value = {r["i"]: r["a"] for r in rows}
        p = [[0.0] * knots for _ in outputs]
        position = {i: n for n, i in enumerate(outputs)}
        for r in rows:
            p[position[r["i"]]][r["j"]] = r["p"]
        out[key] = Quantised.from_arrays(key[1], [value[i] for i in outputs], p)
    return out


# A design is a pure function of its key, so a session needs it once. Few keys: one run grid names some dozens.
_DESIGNED: dict[tuple[str, float, int], Quantised] = {}


def design_mechanisms(spark: SparkSession, keys: Sequence[tuple[str, float, int]], path: str | None = None):
    """``{key: Quantised}`` for (obj, eps, n_outputs) keys, from the catalog at ``path`` if given."""
    wanted = [lookup_key(*k) for k in dict.fromkeys(keys)]
    schema = "obj string, eps double, n_outputs int"
    if path is not None:
        return collect_mechanisms(get_or_create(spark.createDataFrame(wanted, schema), path))
    absent = [k for k in wanted if k not in _DESIGNED]
    if absent:
        frame = spark.createDataFrame([k[1:] for k in absent], "eps double, n_outputs int").distinct()
        objectives = sorted({k[0] for k in absent})
        _DESIGNED.update(collect_mechanisms(mech.design(frame, objectives)))
    return {k: _DESIGNED[k] for k in wanted}

"""Approximate nearest neighbours with shifted space-filling curves.

Unit vectors are projected to a few dimensions, shifted, and ordered along a Hilbert curve; several curves use different
projections and shifts, so neighbours that one curve tears apart are close on another. Equal vectors collapse to one
point first. Each curve is range-partitioned and ranked in Spark and cut into blocks of a fixed number of points. A query
visits the blocks in a window around its own rank on every curve: queries of neighbouring blocks share a task, and the
blocks of their windows stream past them in order. The candidates found are merged and ranked by the exact measure on
the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ldpspark.operators.ordered import prefix_sums
from ldpspark.session import settle


# queries that are compared with a block at once
PART = 512


@dataclass(frozen=True)
class Curves:
    """``share`` is how much of the curve a query sees to each side of its block. Vectors without structure, as random
    ones in many dimensions, need the default; clustered ones do with far less."""

    curves: int = 14
    axes: int = 8
    # bits of an axis that cut the bulk of unstructured vectors, and further ones that tell apart what shares such a
    # cell, down to where the cosine in double precision sees no difference
    bits: int = 7
    fine: int = 25
    rows: int = 512
    share: float = 0.03
    seed: int = 0
    # queries that one task holds
    queries: int = 32_768


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of integer cells (rows x axes), by the transposed-axes method of J. Skilling, as
    big-endian bytes (rows x bytes)."""
    x = [c.copy() for c in cells.T.astype(np.int64)]
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for axis in range(len(x)):
            set_ = (x[axis] & q) != 0
            swap = np.where(set_, 0, (x[0] ^ x[axis]) & p)
            x[0] = np.where(set_, x[0] ^ p, x[0] ^ swap)
            x[axis] = x[axis] ^ swap
        q >>= 1
    for axis in range(1, len(x)):
        x[axis] ^= x[axis - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where((x[-1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    key = [((axis ^ flip) >> bit) & 1 for bit in range(bits - 1, -1, -1) for axis in x]
    return np.packbits(np.stack(key, axis=1).astype(np.uint8), axis=1)


def curve_keys(unit: np.ndarray, spec: Curves) -> list[np.ndarray]:
    """Keys (rows x bytes) of each curve. A coordinate of a random unit vector has deviation 1/sqrt(dim): three of them
    to each side fill the middle cell of the grid, and the shift moves the grid by up to half of that. The cells around
    it take coordinates up to 1, so none is clipped; finer bits follow the same curve inside a cell."""
    rng = np.random.default_rng(spec.seed)
    dim = unit.shape[1]
    reach = 3 / np.sqrt(dim)
    # middle-sized cells to each side, as a power of two
    outer = max(0, int(np.ceil(np.log2(1 + 1 / reach)))) + 1
    bits = outer + spec.bits + spec.fine
    out = []
    for _ in range(spec.curves):
        basis = np.linalg.qr(rng.normal(size=(dim, dim)))[0][:, : spec.axes]
        shift = rng.random(spec.axes)[: basis.shape[1]]
        place = ((unit @ basis) / reach + 1 + shift) / 3 + (1 << (outer - 1))
        out.append(hilbert((place * (1 << (spec.bits + spec.fine))).astype(np.int64), bits))
    return out


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, dim, embedding`` (array of double) of the vectors that take part."""
    whole = F.col("embedding").cast("array<double>")
    finite = F.forall(
        whole, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    ) & F.exists(whole, lambda x: x != 0)
    seen = vectors.select("vec_id", whole.alias("embedding")).where("vec_id is not null and embedding is not null")
    return seen.where(finite).select("vec_id", F.size("embedding").alias("dim"), "embedding")


def _matrix(column: pd.Series, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows over their length; scaled first, so that neither very small nor very large components are lost."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Best:
    """The ``k`` nearest ids of each query (unit rows), by exact score, then smaller id; blocks come one after the other."""

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k = queries, k
        self.found: list[dict[int, float]] = [{} for _ in queries]
        self.floor = np.full(len(queries), -np.inf)

    def meet(self, asking: np.ndarray, block: np.ndarray, ids: np.ndarray, point: np.ndarray) -> None:
        """Queries with the row numbers ``asking`` against a block, whose rows ``point`` carry the ``ids``. An id carried by
        several rows counts once, with its best score."""
        # the k-th best row bounds the k-th best id, unless rows share ids
        full = len(block) >= self.k and len(np.unique(ids)) == len(ids)
        for first in range(0, len(asking), PART):
            rows = asking[first : first + PART]
            rough = self.queries[rows] @ block.T
            floor = self.floor[rows]
            if full:
                floor = np.maximum(floor, np.partition(rough, rough.shape[1] - self.k, axis=1)[:, rough.shape[1] - self.k])
            # scores of a matrix product may differ in the last digits from those that count
            floor = floor - 1e-9
            for row in np.nonzero(rough.max(axis=1) >= floor)[0]:
                self._merge(rows[row], np.nonzero((rough[row] >= floor[row])[point])[0], block, ids, point)

    def _merge(self, query: int, at: np.ndarray, block: np.ndarray, ids: np.ndarray, point: np.ndarray) -> None:
        held = self.found[query]
        exact = (block[point[at]] * self.queries[query]).sum(axis=1)
        for i, score in zip(ids[at].tolist(), exact.tolist()):
            held[i] = max(held.get(i, -np.inf), score)
        if len(held) >= self.k:
            best = sorted(held.items(), key=lambda c: (-c[1], c[0]))[: self.k]
            self.found[query], self.floor[query] = dict(best), best[-1][1]


def search(vectors: DataFrame, is_query: Column, k: int = 5, spec: Curves = Curves()) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of each query, by cosine in double precision, ties to
    the smaller ``vec_id``.

    Vectors that are NULL, zero, or hold a NULL or non-finite component take no part, nor do rows without ``vec_id``. Vectors
    of different length never meet: each length is searched by itself. Rows with a query's ``vec_id`` are its own and no
    candidates; of several vectors with one ``vec_id`` and length the best score counts. Fewer candidates than ``k`` give fewer
    rows. Vectors of equal direction are one point, which carries its ``k + 1`` smallest ``vec_id``; no query can need more.
    Other columns are not read.
    """
    seen = usable(vectors.select("vec_id", "embedding"))
    # a row for each length of vectors in the table
    dims = sorted(r["dim"] for r in seen.select("dim").distinct().collect())
    found = [_search(seen.where(F.col("dim") == d), is_query, k, spec, d) for d in dims or [0]]
    best = reduce(DataFrame.unionByName, found)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )


def _search(seen: DataFrame, is_query: Column, k: int, spec: Curves, dim: int) -> DataFrame:
    kind = seen.schema["vec_id"].dataType.simpleString()

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            # + 0.0 makes one zero of both
            rows = [x.tobytes() for x in _unit(np.stack(pdf["embedding"].to_numpy())) + 0.0] if len(pdf) else []
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "unit": rows})

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = curve_keys(_matrix(pdf["unit"], dim), spec) if len(pdf) else []
            for curve, key in enumerate(found):
                yield pd.DataFrame({"curve": np.int32(curve), "key": [x.tobytes() for x in key], "point": pdf["point"]})

    # a point is known by the 128-bit digest of its vector
    units = seen.select("vec_id", "embedding").mapInPandas(pack, f"vec_id {kind}, unit binary")
    units = settle(units.withColumn("point", F.unhex(F.md5("unit"))).distinct())
    nth = F.row_number().over(Window.partitionBy("point").orderBy("vec_id"))
    points = units.withColumn("nth", nth).where(F.col("nth") <= k + 1).groupBy("point").agg(
        F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("unit").alias("unit")
    )
    points = settle(points)
    keyed = points.select("point", "unit").mapInPandas(keys, "curve int, key binary, point binary")
    keyed = keyed.withColumn("one", F.lit(1).cast("bigint"))
    ranked = settle(prefix_sums(keyed, ["curve"], [F.col("key"), F.col("point")], {"one": "n"}))
    asking = settle(units.select("vec_id", "point").where(is_query).select(F.col("vec_id").alias("query_id"), "point"))
    asked_points = settle(asking.select(F.col("point").alias("asks")).distinct())
    # the window in blocks, the same for all curves
    n = points.count()
    reach = int(np.ceil(spec.share * n / spec.rows))
    last = max(0, -(-n // spec.rows) - 1)
    # queries of as many neighbouring blocks as the window has to each side share a task, so a point is sent about three
    # times on a curve, however many rows there are
    wide = max(1, reach)
    groups = last // wide + 1
    salts = max(1, -(-asked_points.count() // (groups * spec.queries)))
    places = ranked.groupBy(F.col("point").alias("placed")).agg(
        F.collect_set(F.struct("curve", F.floor(F.col("n_before") / spec.rows).cast("int").alias("block"))).alias("places")
    )
    held = points.join(places, F.col("point") == F.col("placed")).drop("placed")
    held = held.join(asked_points, F.col("point") == F.col("asks"), "left").withColumn("asks", F.col("asks").isNotNull())
    held = settle(held)
    spots = held.select("point", "ids", "unit", "asks", F.explode("places").alias("p")).select("point", "ids", "unit", "asks", "p.*")
    columns = ["curve", "group", "salt", "side", "block", "point", "unit", "ids"]
    group = lambda block: F.floor(block / wide).cast("int")
    asked = spots.where("asks").withColumns(
        {"group": group(F.col("block")), "salt": F.pmod(F.xxhash64("point"), F.lit(salts)).cast("int"), "side": F.lit(0), "ids": F.array().cast(f"array<{kind}>")}
    )
    near = F.sequence(group(F.greatest(F.col("block") - reach, F.lit(0))), group(F.least(F.col("block") + reach, F.lit(last))))
    base = spots.withColumn("group", F.explode(near)).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    base = base.withColumns({"side": F.lit(1), "point": F.lit(None).cast("binary")})

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Queries of a group come first; its blocks then pass by."""
        place, asks, best, parts = None, [], None, []

        def close() -> None:
            if not parts:
                return
            block = pd.concat(parts)
            parts.clear()
            number, ids = int(block["block"].iloc[0]), block["ids"].to_numpy()
            owner = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
            rows = np.nonzero(np.abs(best[1] - number) <= reach)[0]
            if len(rows):
                best[0].meet(rows, _matrix(block["unit"], dim), np.concatenate(ids), owner)

        def answers() -> pd.DataFrame:
            close()
            rows = [(p, i, s) for p, found in zip(best[2], best[0].found) for i, s in found.items()] if best else []
            return pd.DataFrame(rows, columns=["point", "vec_id", "score"])

        for pdf in batches:
            for here, part in pdf.groupby(["curve", "group", "salt", "side", "block"], sort=False):
                if here[:3] != place:
                    yield answers()
                    place, asks, best = here[:3], [], None
                if here[3] == 0:
                    asks.append(part)
                    continue
                if best is None and asks:
                    whole = pd.concat(asks)
                    best = Best(_matrix(whole["unit"], dim), k + 1), whole["block"].to_numpy(), whole["point"].to_numpy()
                if best is not None:
                    if parts and parts[0]["block"].iloc[0] != here[4]:
                        close()
                    parts.append(part)
        yield answers()

    dealt = asked.select(*columns).unionByName(base.select(*columns)).repartition("curve", "group", "salt")
    pairs = dealt.sortWithinPartitions(*columns[:5]).mapInPandas(meet, f"point binary, vec_id {kind}, score double")
    nearest = [F.col("score").desc(), F.col("vec_id")]
    near = pairs.groupBy("point", "vec_id").agg(F.max("score").alias("score"))
    near = near.withColumn("nth", F.row_number().over(Window.partitionBy("point").orderBy(*nearest))).where(F.col("nth") <= k + 1)
    # the query's own id is among the first k + 1 of its point, or none of them is
    lists = near.groupBy(F.col("point").alias("of")).agg(F.collect_list(F.struct("vec_id", "score")).alias("near"))
    answers = asking.join(lists, F.col("point") == F.col("of")).select("query_id", F.explode("near").alias("c"))
    best = answers.select("query_id", "c.*").where(F.col("vec_id") != F.col("query_id"))
    return best.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))

"""Discrete quantised mechanism (QM).

A mechanism has N output values (integer multiples of a_1) and a column of output probabilities at each
knot x_0 < x_1 < ... A value is clipped to the knot range, its output distribution is the linear
interpolation of the two neighbouring knot columns, and a negative value uses the reversed vector.

Cumulative probabilities are piecewise linear too, so sampling compares one uniform with N - 1 thresholds.
Segment, threshold and most probable output are found by unrolled binary search in constant arrays: no join
and no higher-order function, hence whole-stage codegen, with code size logarithmic in N. Several mechanisms
with the same N share one constant block and are chosen by an integer column.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .layers import Layered
from .params import Table
from .rand import digest, draw

# Up to this many outputs a distribution is one compiled expression per output; beyond it is one array.
UNROLL_LIMIT = 32


def signed_indices(n_outputs: int) -> list[int]:
    """-n..n, without 0 when N is even."""
    if n_outputs <= 1:
        raise ValueError("a quantised mechanism needs at least two outputs")
    n = n_outputs // 2
    return [i for i in range(-n, n + 1) if i != 0 or n_outputs % 2 == 1]


def envelope_corners(slope: np.ndarray, right: np.ndarray, start: float, end: float) -> list[float]:
    """Where the highest of the lines ``right + slope * (a - end)`` changes inside the interval, from left to right.

    The lines are walked along: from the highest one, on to the steeper line that is met first.
    """
    value = right + slope * (start - end)
    top = np.flatnonzero(value >= value.max() - 1e-15)
    current, at, corners = int(top[np.argmax(slope[top])]), start, []
    while True:
        gap = slope - slope[current]
        steeper = np.flatnonzero(gap > 1e-15)
        meet = end + (right[current] - right[steeper]) / gap[steeper]
        ahead = (meet > at) & (meet < end)
        if not ahead.any():
            return corners
        steeper, meet = steeper[ahead], meet[ahead]
        first = steeper[meet == meet.min()]
        at = float(meet.min())
        corners.append(at)
        current = int(first[np.argmax(slope[first])])


@dataclass(frozen=True)
class Quantised:
    """One mechanism: output values and a probability column per knot, knots ascending."""

    eps: float
    a_values: tuple[float, ...]
    p_matrix: tuple[tuple[float, ...], ...]

    @staticmethod
    def from_arrays(eps: float, a_values: Sequence[float], p_matrix) -> "Quantised":
        """Order the knots, drop negative dust and renormalise the columns."""
        a = np.asarray(a_values, dtype=float)
        p = np.asarray(p_matrix, dtype=float)
        x = a @ p
        if np.any(np.diff(x) < -1e-9):
            p = p[:, np.argsort(x, kind="stable")]
        p = np.where(p < 0, 0.0, p)
        total = p.sum(axis=0)
        if np.any(np.abs(total - 1.0) > 1e-12):
            p = p / np.where(total < 1e-9, 1.0, total)
        return Quantised(float(eps), tuple(map(float, a)), tuple(tuple(map(float, r)) for r in p))

    @property
    def n_outputs(self) -> int:
        return len(self.a_values)

    @property
    def a1(self) -> float:
        """Step between output values: the smallest positive one."""
        return min(v for v in self.a_values if v > 0)

    @property
    def index_range(self) -> tuple[int, int]:
        idx = signed_indices(self.n_outputs)
        return idx[0], idx[-1]

    @cached_property
    def knots(self) -> np.ndarray:
        """Knot positions; ends that are 0 and 1 up to rounding are exactly 0 and 1."""
        x = np.asarray(self.a_values) @ np.asarray(self.p_matrix)
        for end, exact in ((0, 0.0), (-1, 1.0)):
            if abs(x[end] - exact) < 1e-12:
                x[end] = exact
        return x

    def segment_width(self) -> np.ndarray:
        dx = np.diff(self.knots)
        return np.where(np.abs(dx) < 1e-9, 1.0, dx)

    def distribution(self, magnitude: float) -> np.ndarray:
        """Output probabilities at one magnitude inside the knot range."""
        x, p = self.knots, np.asarray(self.p_matrix)
        j = min(max(int(np.searchsorted(x, magnitude, side="left")), 1), len(x) - 1)
        slope = (p[:, j] - p[:, j - 1]) / self.segment_width()[j - 1]
        return slope * (magnitude - x[j]) + p[:, j]

    def modes(self) -> tuple[list[float], list[tuple[int, int]], list[tuple[int, int]]]:
        """The most probable output as a step function of the magnitude.

        Break points, the (first, last) maximising position in each open interval between them, and the same
        at each break point. Break points are the knots and the corners of the upper envelope of the outputs' lines.
        """
        x, p = self.knots, np.asarray(self.p_matrix)
        slopes = (p[:, 1:] - p[:, :-1]) / self.segment_width()
        points = set(map(float, x))
        for j in range(1, len(x)):
            points.update(envelope_corners(slopes[:, j - 1], p[:, j], x[j - 1], x[j]))
        breaks = sorted(points)

        def ends(at: float) -> tuple[int, int]:
            d = self.distribution(at)
            best = np.flatnonzero(d == d.max())
            return int(best[0]), int(best[-1])

        at_points = [ends(b) for b in breaks]
        between = [ends((lo + hi) / 2) for lo, hi in zip(breaks[:-1], breaks[1:])]
        # values are clipped to the knots, so the outer intervals are never met
        return breaks, [at_points[0], *between, at_points[-1]], at_points


def _bits(slots: int) -> int:
    """Steps of a binary search that tells ``slots`` positions apart."""
    return max(slots - 1, 0).bit_length()


class Lookup:
    """Constant block of one or several mechanisms with the same N."""

    def __init__(self, mechanisms: Sequence[Quantised], which: Column | None = None):
        sizes = {m.n_outputs for m in mechanisms}
        if len(sizes) != 1:
            raise ValueError("mechanisms in one lookup must have the same number of outputs")
        self.n = sizes.pop()
        self.mechanisms = list(mechanisms)
        self.which = which
        self.segments = max(len(m.p_matrix[0]) for m in mechanisms) - 1
        self.segment_bits = _bits(self.segments)
        self.output_bits = _bits(self.n)

    # -- constant blocks: only those that a query uses are built

    @cached_property
    def _ends(self) -> Table:
        return Table([[m.knots[0], m.knots[-1]] for m in self.mechanisms], self.which)

    @cached_property
    def _inner_knots(self) -> Table:
        """Entry s is the knot that ends segment s - 1."""
        width = 2**self.segment_bits
        rows = []
        for m in self.mechanisms:
            inner = [-np.inf, *m.knots[1:-1]]
            rows.append(inner + [np.inf] * (width - len(inner)))
        return Table(rows, self.which)

    def _padded(self, values: np.ndarray) -> list:
        """Per-segment values, the last one repeated for mechanisms with fewer segments."""
        return [*values, *[values[-1]] * (self.segments - len(values))]

    @cached_property
    def _right(self) -> Table:
        return Table([self._padded(m.knots[1:]) for m in self.mechanisms], self.which)

    @cached_property
    def _thresholds(self) -> Table:
        """Value at the right knot and slope of each threshold, addressed by (sign, segment, slot).

        Slots 1 .. N - 1 hold the cumulative values. A negative value uses the reversed vector, whose
        threshold k is 1 - C(N - k). The remaining slots hold a bound that no draw reaches.
        """
        rows = []
        slots, segments = 2**self.output_bits, 2**self.segment_bits
        for m in self.mechanisms:
            p = np.asarray(m.p_matrix)
            cum = np.cumsum(p, axis=0)[:-1]
            slope = (cum[:, 1:] - cum[:, :-1]) / m.segment_width()
            cells = np.zeros((2, segments, slots, 2))
            cells[..., 0] = 2.0
            for j in range(slope.shape[1]):
                cells[0, j, 1 : self.n] = np.stack([cum[:, j + 1], slope[:, j]], axis=-1)
                cells[1, j, 1 : self.n] = np.stack([1.0 - cum[::-1, j + 1], -slope[::-1, j]], axis=-1)
            rows.append(cells.ravel())
        return Table(rows, self.which)

    @cached_property
    def _modes(self):
        """Search bits, break points, and the signed index addressed by (interval, on a point, sign)."""
        steps = [m.modes() for m in self.mechanisms]
        bits = _bits(max(len(b) for b, _, _ in steps) + 1)
        width = 2**bits
        index = signed_indices(self.n)
        breaks, picks = [], []
        for points, between, at in steps:
            # entry m + 1 is break point m
            breaks.append([-np.inf, *points] + [np.inf] * (width - len(points)))
            cells = np.zeros((width, 2, 2))
            for slot, ends in ((0, between), (1, at)):
                for m in range(width):
                    first, last = ends[min(m, len(ends) - 1)]
                    cells[m, slot] = index[first], index[self.n - 1 - last]
            picks.append(cells.ravel())
        return bits, Table(breaks, self.which), Table(picks, self.which)

    @cached_property
    def _probabilities(self) -> Table:
        """Value at the right knot and slope of each output's probability, addressed by (segment, position)."""
        rows = []
        for m in self.mechanisms:
            p = np.asarray(m.p_matrix)
            slope = (p[:, 1:] - p[:, :-1]) / m.segment_width()
            cells = np.zeros((2**self.segment_bits, 2**self.output_bits, 2))
            for j in range(slope.shape[1]):
                cells[j, : self.n] = np.stack([p[:, j + 1], slope[:, j]], axis=-1)
            rows.append(cells.ravel())
        return Table(rows, self.which)

    # -- expressions

    def start(self, v: Column) -> dict[str, Column]:
        """Clipped magnitude and sign. Neither is ever NULL: a missing value is restored at the end."""
        return {
            "a": F.least(F.greatest(F.abs(v), self._ends.at(0)), self._ends.at(1)),
            "neg": F.coalesce(F.when(v < 0, 1).otherwise(0), F.lit(0)),
        }

    @staticmethod
    def _search(letter: str, bits: int, reached) -> list:
        """Layers of an unrolled binary search; ``reached(c, slot)`` says whether a slot is passed."""
        names = [f"{letter}{b}" for b in range(bits - 1, -1, -1)]

        def step(n: int):
            def layer(c):
                jump = 2 ** (bits - 1 - n)
                if n == 0:
                    return {names[0]: F.when(reached(c, F.lit(jump)), jump).otherwise(0)}
                at = c(names[n - 1])
                return {names[n]: F.when(reached(c, at.bitwiseOR(jump)), at.bitwiseOR(jump)).otherwise(at)}

            return layer

        return [step(n) for n in range(bits)]

    def segment_layers(self):
        """0-based segment ``j`` with x_j < a <= x_j+1, then the distance ``d`` to its right knot."""
        layers = self._search(
            "j", self.segment_bits, lambda c, slot: c("a") > self._inner_knots.at(slot)
        )
        name = "j0" if self.segment_bits else None

        def place(c):
            j = c(name) if name else F.lit(0)
            return {"j": j, "d": c("a") - self._right.at(j)}

        return [*layers, place]

    def position_layers(self):
        """Number of thresholds at or below ``u``; the last layer's name is ``k0``."""

        def reached(c, slot):
            row = F.shiftleft(F.shiftleft(c("neg"), self.segment_bits).bitwiseOR(c("j")), self.output_bits + 1)
            cell = row.bitwiseOR(F.shiftleft(slot, 1))
            return c("u") >= self._thresholds.at(cell.bitwiseOR(1)) * c("d") + self._thresholds.at(cell)

        return self._search("k", self.output_bits, reached)

    def mode_layers(self):
        """Break points below ``a``; the last layer's name is ``m0``."""
        bits, breaks, _ = self._modes
        return self._search("m", bits, lambda c, slot: c("a") > breaks.at(slot))

    def mode_index(self, c) -> Column:
        """Signed index of the first most probable position; counted from the other end for a negative value."""
        _, breaks, picks = self._modes
        m = c("m0")
        on_point = F.when(breaks.at(m + 1) == c("a"), 2).otherwise(0)
        return picks.at(F.shiftleft(m, 2).bitwiseOR(on_point).bitwiseOR(c("neg"))).cast("int")

    def probability(self, k: int | Column, c) -> Column:
        cell = F.shiftleft(c("j"), self.output_bits + 1).bitwiseOR(F.shiftleft(k, 1) if isinstance(k, Column) else F.lit(2 * k))
        return self._probabilities.at(cell.bitwiseOR(1)) * c("d") + self._probabilities.at(cell)

    def distribution(self, c) -> Column:
        """All probabilities as one array."""
        return F.transform(F.sequence(F.lit(0), F.lit(self.n - 1)), lambda k: F.greatest(self.probability(k, c), F.lit(0.0)))

    def index(self, position: Column) -> Column:
        """Output position to signed index."""
        half = self.n // 2
        if self.n % 2 == 1:
            return (position - half).cast("int")
        return (position - half + F.when(position < half, 0).otherwise(1)).cast("int")


def _side_by_side(*paths):
    """Merge layer lists that do not depend on each other."""
    depth = max(len(p) for p in paths)

    def merged(level):
        active = [p[level] for p in paths if level < len(p)]
        return lambda c: {name: expr for layer in active for name, expr in layer(c).items()}

    return [merged(level) for level in range(depth)]


def probabilities(prefix: str, value: Column, lookup: Lookup) -> Layered:
    """A struct column ``prefix`` with one field per output: ``prefix0`` .. ``prefixN-1`` in output order.

    Interpolate, zero the negatives, renormalise, reverse for negative input.
    """
    n = lookup.n
    wide = n > UNROLL_LIMIT

    def raw(c):
        if wide:
            return {"p": lookup.distribution(c)}
        return {f"p{k}": F.greatest(lookup.probability(k, c), F.lit(0.0)) for k in range(n)}

    def each(c, k: int) -> Column:
        return c("p")[k] if wide else c(f"p{k}")

    def total(c):
        out = each(c, 0)
        for k in range(1, n):
            out = out + each(c, k)
        return {"s": F.when(out < 1e-9, F.lit(1.0)).otherwise(out)}

    def struct(c):
        picks = [
            (F.when(c("neg") == 1, each(c, n - 1 - k)).otherwise(each(c, k)) / c("s")).alias(f"{prefix}{k}")
            for k in range(n)
        ]
        return F.when(c("v").isNotNull(), F.struct(*picks))

    layers = [
        lambda c: {"v": value},
        lambda c: lookup.start(c("v")),
        *lookup.segment_layers(),
        raw,
        total,
    ]
    return Layered(prefix, layers, struct)


def sample(
    output: str,
    value: Column,
    lookup: Lookup,
    key: Column,
    seed,
    col: str,
    *,
    stream: str = "qm",
    null_policy: str = "null",
    test: Column | None = None,
    salt: str = "",
) -> Layered:
    """Signed output index by inverse CDF with one keyed uniform.

    Rows where ``test`` holds get the most probable output instead (see ``most_probable``).
    Only the first N - 1 cumulative values are compared, so rounding in the last one cannot matter.
    ``null_policy="lowest"`` sends NULL to the first output, as a comparison with NaN does.
    """
    if null_policy not in ("null", "lowest"):
        raise ValueError(f"unknown null_policy: {null_policy}")

    def hashed(c):
        h = digest(seed, stream, key, col, salt)
        return {"v": value, "h": h if test is None else F.when(~test, h)}

    def final(c):
        index = lookup.index(c("k0"))
        index = index if test is None else F.when(test, lookup.mode_index(c)).otherwise(index)
        index = F.when(c("v").isNotNull(), index)
        return F.coalesce(index, F.lit(-(lookup.n // 2))) if null_policy == "lowest" else index

    search = [*lookup.segment_layers(), *lookup.position_layers()]
    layers = [
        hashed,
        lambda c: {**lookup.start(c("v")), "u": draw(c("h"), 0)},
        *(search if test is None else _side_by_side(search, lookup.mode_layers())),
    ]
    return Layered(output, layers, final)


def most_probable(output: str, value: Column, lookup: Lookup) -> Layered:
    """Signed index of the most probable output; the first one on ties, after the reversal."""

    def final(c):
        return F.when(c("v").isNotNull(), lookup.mode_index(c))

    layers = [
        lambda c: {"v": value},
        lambda c: lookup.start(c("v")),
        *lookup.mode_layers(),
    ]
    return Layered(output, layers, final)


def index_value(index: Column, a1) -> Column:
    """Signed index to output value: outputs are integer multiples of a_1."""
    return index * (a1 if isinstance(a1, Column) else F.lit(float(a1)))

"""Layered projections.

A perturbation reads its hash several times. Written as one expression, the optimizer may evaluate the
hash once per reference; written as consecutive ``select`` calls, each layer is evaluated once per row and
all layers stay inside one whole-stage codegen span. ``Layered`` is such a stack for one output column and
``project`` runs the stacks of many columns side by side, so d columns still cost only a few projections.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Layered:
    """Temporary columns per layer, then the final expression.

    Each layer is a function of a ``name -> Column`` resolver and returns new temporaries.
    """

    output: str
    layers: list[Callable[[Callable[[str], Column]], dict[str, Column]]] = field(default_factory=list)
    final: Callable[[Callable[[str], Column]], Column] | None = None


def project(df: DataFrame, stacks: Sequence[Layered]) -> DataFrame:
    """Apply the stacks; an output that names an existing column replaces it in place."""
    base = df.columns
    depth = max((len(s.layers) for s in stacks), default=0)

    def resolver(prefix: str) -> Callable[[str], Column]:
        seen: dict[str, Column] = {}

        def resolve(name: str) -> Column:
            if name not in seen:
                seen[name] = F.col(f"`{prefix}{name}`")
            return seen[name]

        return resolve

    resolvers = [resolver(f"__{n}_") for n in range(len(stacks))]
    current = df
    for level in range(depth):
        added = [
            expr.alias(f"__{n}_{name}")
            for n, stack in enumerate(stacks)
            if level < len(stack.layers)
            for name, expr in stack.layers[level](resolvers[n]).items()
        ]
        current = current.select("*", *added)

    finals = {s.output: s.final(resolvers[n]).alias(s.output) for n, s in enumerate(stacks)}
    kept = [finals.get(c, f"`{c}`") for c in base]
    new = [expr for name, expr in finals.items() if name not in base]
    return current.select(*kept, *new)

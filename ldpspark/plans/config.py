"""Parameters of a job. Values here are the usual defaults of the experiments."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

# Fixed values of the usual experiment grids.
EPSILONS = (1.0, 2.0, 3.0, 4.0, 5.0)
SEEDS = tuple(range(10))
T_VALUES = (3.0,)
N_VALUES = (7,)
# Label resolution by dataset; other datasets use the feature resolution.
LABEL_N = {"wine": 7, "shuttle": 7, "gamma": 2, "credit": 2, "iris": 3}
# Datasets with a continuous label get both label modes.
REGRESSION_DATASETS = ("elevators", "CASP", "wine")
# Datasets whose label is log-transformed.
LOG_LABEL_DATASETS = ("OnlineNewsPopularity", "Beijing_housing", "cal_housing")

LABEL_MODES = ("none", "index", "linear", "categorical")


@dataclass(frozen=True)
class Dataset:
    """Which columns mean what."""

    name: str
    key: tuple[str, ...]
    label: str
    features: tuple[str, ...] | None = None
    log_label: bool = False
    with_categorical: bool = False
    test_size: float = 0.2
    random_state: int = 42
    salt: str = field(default="", repr=False)


@dataclass(frozen=True)
class Run:
    """One privatised copy of a dataset."""

    mechanism: str
    eps: float
    seed: int = 0
    mode: str = "linear"
    t: float | None = None
    n_outputs: int | None = None
    obj: str | None = None
    label_eps: float | None = None
    label_n: int | None = None

    def __post_init__(self):
        if self.mechanism not in ("pm", "qm"):
            raise ValueError(f"unknown mechanism: {self.mechanism}")
        if self.mode not in LABEL_MODES:
            raise ValueError(f"unknown label mode: {self.mode}")
        if self.mechanism == "pm" and self.t is None:
            object.__setattr__(self, "t", 3.0)
        if self.mechanism == "qm":
            if self.n_outputs is None:
                object.__setattr__(self, "n_outputs", 7)
            if self.obj is None:
                object.__setattr__(self, "obj", "avg")
            if self.label_n is None:
                object.__setattr__(self, "label_n", self.n_outputs)
        if self.label_eps is None:
            object.__setattr__(self, "label_eps", self.eps)

    @property
    def variant(self) -> str:
        return f"pm_t{self.t:g}" if self.mechanism == "pm" else "qm"


def pm_grid(
    eps: Sequence[float] = EPSILONS,
    t: Sequence[float] = T_VALUES,
    modes: Sequence[str] = ("categorical",),
    seeds: Sequence[int] = SEEDS,
) -> list[Run]:
    return [Run("pm", e, s, m, t=x) for m in modes for x in t for e in eps for s in seeds]


def qm_grid(
    dataset: str,
    eps: Sequence[float] = EPSILONS,
    n_values: Sequence[int] = N_VALUES,
    seeds: Sequence[int] = SEEDS,
    obj: str = "avg",
    label_eps: Sequence[float] | None = None,
) -> list[Run]:
    """Label resolution and label modes follow the dataset; ``label_eps`` adds the off-diagonal budgets."""
    modes = ("index", "linear") if dataset in REGRESSION_DATASETS else ("linear",)
    pairs = [(e, e) for e in eps]
    if label_eps is not None:
        pairs += [(e, le) for e in eps for le in label_eps if e != le]
    return [
        Run("qm", e, s, m, n_outputs=n, obj=obj, label_eps=le, label_n=LABEL_N.get(dataset, n))
        for n in n_values
        for e, le in pairs
        for m in modes
        for s in seeds
    ]

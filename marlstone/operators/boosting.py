"""Gradient boosting by histograms, for rows with missing values.

Features are cut into bins once; a missing value has a bin of its own. A tree grows level by level: one
pass over the rows adds up the residuals and rows of each (leaf, feature, bin), and the leaves whose
best split gains most are split first, up to a number of leaves. Each split learns to which side rows
without the value go. What meets on the driver is the sums of one level and the trees, which do not
grow with the rows; rows are scored anew from the trees in each pass, so nothing has to be kept in step.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.session import cut

#: Relative accuracy of the quantiles that cut a feature into bins.
ACCURACY = 10_000


@dataclass
class Tree:
    """Nodes as lists; a leaf has feature -1. Rows with a bin of at most `cut` go left, those without a value where lost_left says."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    lost_left: list[bool] = field(default_factory=lambda: [True])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int, lost_left: bool, left: float, right: float) -> tuple[int, int]:
        at = len(self.feature)
        self.feature[node], self.cut[node], self.lost_left[node], self.left[node], self.right[node] = feature, cut, lost_left, at, at + 1
        for value in (left, right):
            for name, x in (("feature", -1), ("cut", 0), ("lost_left", True), ("left", 0), ("right", 0), ("value", value)):
                getattr(self, name).append(x)
        return at, at + 1

    def leaves_of(self, bins: np.ndarray, lost: int) -> np.ndarray:
        """Each row's leaf. bins: rows x features; lost: the bin of a missing value."""
        feature, cut, lost_left, left, right = (np.array(getattr(self, n)) for n in ("feature", "cut", "lost_left", "left", "right"))
        at = np.zeros(len(bins), int)
        while (inner := np.flatnonzero(feature[at] >= 0)).size:
            node = at[inner]
            own = bins[inner, feature[node]]
            at[inner] = np.where(np.where(own == lost, lost_left[node], own <= cut[node]), left[node], right[node])
        return at


@dataclass
class BoostedModel:
    names: list[str]
    edges: list[list[float]]
    base: float
    rate: float
    bins: int
    trees: list[Tree]

    def binned(self, x: np.ndarray) -> np.ndarray:
        """Values as bins: a bin ends with its edge; the last one is for missing values."""
        out = np.empty(x.shape, np.int16)
        for k, edges in enumerate(self.edges):
            out[:, k] = np.searchsorted(edges, x[:, k])
        out[np.isnan(x)] = self.bins
        return out

    def scores(self, bins: np.ndarray) -> np.ndarray:
        total = np.full(len(bins), self.base)
        for tree in self.trees:
            total += self.rate * np.array(tree.value)[tree.leaves_of(bins, self.bins)]
        return total

    def predict(self, df: DataFrame, name: str = "y_hat") -> DataFrame:
        @F.pandas_udf("double")
        def score(x: pd.Series) -> pd.Series:
            return pd.Series(self.scores(self.binned(values(x, len(self.names)))))

        return df.withColumn(name, score(F.array(*(F.col(n).cast("double") for n in self.names))))

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> BoostedModel:
        told = json.loads(text)
        return cls(**{**told, "trees": [Tree(**t) for t in told["trees"]]})


def values(x: pd.Series, width: int) -> np.ndarray:
    return np.array([np.full(width, np.nan) if r is None else [np.nan if v is None else v for v in r] for r in x], float).reshape(len(x), width)


@dataclass(frozen=True)
class HistogramBoosting:
    trees: int = 30
    leaves: int = 15
    levels: int = 4
    bins: int = 64
    rate: float = 0.2
    least: int = 20
    ridge: float = 1.0

    def fit(self, df: DataFrame, names: Sequence[str], label: str = "y") -> BoostedModel:
        """From rows with a label; names: numeric features, nulls and NaN are missing."""
        names = list(names)
        number = lambda n: F.nanvl(F.col(n).cast("double"), F.lit(None).cast("double"))
        rows = df.where(F.col(label).isNotNull()).select(F.col(label).cast("double").alias("y"), *(number(n).alias(f"f{k}") for k, n in enumerate(names)))
        shares = [i / self.bins for i in range(1, self.bins)]
        told = rows.agg(F.avg("y").alias("y"), *(F.percentile_approx(f"f{k}", shares, ACCURACY).alias(f"f{k}") for k in range(len(names)))).first()
        edges = [sorted(set(told[f"f{k}"] or [])) for k in range(len(names))]
        model = BoostedModel(names, edges, told.y or 0.0, self.rate, self.bins, [])
        if told.y is None:
            return model

        @F.pandas_udf("array<int>")
        def to_bins(x: pd.Series) -> pd.Series:
            return pd.Series(list(model.binned(values(x, len(names))).astype(int)))

        rows = cut(rows.select("y", to_bins(F.array(*(f"f{k}" for k in range(len(names))))).alias("bins")))
        for _ in range(self.trees):
            tree = self.grow(rows, model)
            if len(tree.feature) == 1:
                break
            model.trees.append(tree)
        return model

    def grow(self, rows: DataFrame, model: BoostedModel) -> Tree:
        tree, frontier, leaves = Tree(), [0], 1
        for _ in range(self.levels):
            found = [(s, node) for node, (g, n) in self.sums(rows, model, tree, frontier).items() if (s := self.best_split(g, n)) is not None]
            frontier = []
            for (_, feature, at, lost_left, left, right), node in sorted(found, key=lambda x: (-x[0][0], x[1])):
                if leaves < self.leaves:  # the largest gains come first
                    frontier += tree.split(node, feature, at, lost_left, left, right)
                    leaves += 1
            if not frontier or leaves >= self.leaves:
                break
        return tree

    def sums(self, rows: DataFrame, model: BoostedModel, tree: Tree, frontier: list[int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """For each leaf of the frontier: sums of residuals and numbers of rows, features x (bins and the missing one)."""
        width, many = model.bins + 1, len(model.names)
        size = many * width

        def add(batches):
            total = np.zeros((2, len(frontier) * size))
            for pdf in batches:
                bins = np.array(pdf["bins"].tolist(), np.int64).reshape(len(pdf), many)
                residual = pdf["y"].to_numpy() - model.scores(bins)
                node = tree.leaves_of(bins, model.bins)
                for k, leaf in enumerate(frontier):
                    own = np.flatnonzero(node == leaf)
                    cell = (k * size + np.arange(many) * width + bins[own]).ravel()
                    total[0] += np.bincount(cell, np.repeat(residual[own], many), len(total[0]))
                    total[1] += np.bincount(cell, minlength=len(total[1]))
            at = np.flatnonzero(total[1])
            yield pd.DataFrame({"cell": at, "g": total[0][at], "n": total[1][at].astype(np.int64)})

        cells = rows.mapInPandas(add, "cell long, g double, n long").groupBy("cell").agg(F.sum("g").alias("g"), F.sum("n").alias("n")).toPandas()
        g, n = np.zeros(len(frontier) * size), np.zeros(len(frontier) * size)
        g[cells["cell"]], n[cells["cell"]] = cells["g"], cells["n"]
        return {leaf: (g[k * size : (k + 1) * size].reshape(many, width), n[k * size : (k + 1) * size].reshape(many, width)) for k, leaf in enumerate(frontier)}

    def best_split(self, g: np.ndarray, n: np.ndarray) -> tuple[float, int, int, bool, float, float] | None:
        """gain, feature, bin, whether missing values go left, and both sides' values; None if nothing gains."""
        whole_g, whole_n = g[0].sum(), n[0].sum()
        worth = lambda a, b: a * a / (b + self.ridge)
        best = None
        for lost_left in (True, False):
            left_g, left_n = np.cumsum(g[:, :-1], axis=1), np.cumsum(n[:, :-1], axis=1)
            if lost_left:
                left_g, left_n = left_g + g[:, -1:], left_n + n[:, -1:]
            right_g, right_n = whole_g - left_g, whole_n - left_n
            gain = worth(left_g, left_n) + worth(right_g, right_n) - worth(whole_g, whole_n)
            gain[(left_n < self.least) | (right_n < self.least)] = -np.inf
            f, at = np.unravel_index(int(gain.argmax()), gain.shape)
            if gain[f, at] > 1e-12 and (best is None or gain[f, at] > best[0]):
                best = (float(gain[f, at]), int(f), int(at), lost_left, float(left_g[f, at] / (left_n[f, at] + self.ridge)), float(right_g[f, at] / (right_n[f, at] + self.ridge)))
        return best

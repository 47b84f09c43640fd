"""Poisson boosting on gradient histograms over the bounded labelled rows of one model.

A task fits one model: rows are binned once, and a tree grows by its best split until it has
enough leaves. Numbers split at a threshold, and missing ones go to the side that gains more;
categories split one against the rest, which is what a column per category would give.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd

MISSING_CATEGORY = "__missing__"


@dataclass(frozen=True)
class TreeSettings:
    """Boosting settings; the defaults are the published configuration (fixed values)."""

    iterations: int = 374
    depth: int = 7
    min_leaf: int = 22
    leaves: int = 31
    bins: int = 255
    learning_rate: float = 0.06973687
    l2: float = 0.0141275
    #: Rounds without a better validation loss after which boosting ends; 0 never ends early.
    patience: int = 10
    validation_share: float = 0.1
    seed: int = 42


def as_numbers(column: pd.Series) -> np.ndarray:
    return pd.to_numeric(column, errors="coerce").to_numpy(dtype=np.float64, na_value=np.nan)


def as_categories(column: pd.Series) -> np.ndarray:
    return column.astype(object).where(column.notna(), MISSING_CATEGORY).astype(str).to_numpy()


class Bins:
    """Bins of all features, one behind the other in a histogram.

    A number's bin is the count of cuts at or below it, and the last bin holds missing values;
    a category's bin is its place among the sorted categories that were met.
    """

    def __init__(self, rows: pd.DataFrame, numeric: list[str], categorical: list[str], most: int):
        self.names = [*numeric, *categorical]
        self.numeric = len(numeric)
        self.cuts: list[np.ndarray] = []
        columns, widths = [], []
        for name in numeric:
            values = as_numbers(rows[name])
            met = np.unique(values[~np.isnan(values)])
            if len(met) > most:
                met = np.unique(np.quantile(values[~np.isnan(values)], np.linspace(0, 1, most)))
            cuts = (met[1:] + met[:-1]) / 2
            found = np.searchsorted(cuts, values, side="left")
            found[np.isnan(values)] = len(cuts) + 1
            self.cuts.append(cuts)
            columns.append(found)
            widths.append(len(cuts) + 2)
        for name in categorical:
            met, found = np.unique(as_categories(rows[name]), return_inverse=True)
            self.cuts.append(met)
            columns.append(found)
            widths.append(len(met))
        self.start = np.concatenate([[0], np.cumsum(widths)]).astype(np.int64)
        self.places = (np.stack(columns, axis=1) + self.start[:-1]).astype(np.int32)
        self.width = np.array(widths)
        numbers = self.start[self.numeric]
        # Places where the running sums of numbers begin anew, and those of their missing values.
        self.owner = np.repeat(np.arange(len(widths)), self.width)
        self.last = self.start[1:] - 1
        self.is_category = np.arange(self.start[-1]) >= numbers

    def histogram(self, rows: np.ndarray, gradient: np.ndarray, hessian: np.ndarray) -> np.ndarray:
        """Sums of gradient, hessian and rows by bin."""
        at = self.places[rows].ravel()
        f, n = self.places.shape[1], int(self.start[-1])
        return np.stack(
            [
                np.bincount(at, np.repeat(gradient[rows], f), n),
                np.bincount(at, np.repeat(hessian[rows], f), n),
                np.bincount(at, minlength=n).astype(np.float64),
            ]
        )


@dataclass
class Split:
    gain: float
    feature: int
    bin: int
    missing_left: bool


def best_split(bins: Bins, sums: np.ndarray, settings: TreeSettings) -> Split | None:
    """The split that lowers the loss most; of equal ones, the first by feature and bin."""
    f0, f1 = int(bins.start[0]), int(bins.start[1])
    total = sums[:, f0:f1].sum(axis=1)
    running = np.cumsum(sums, axis=1)
    before = np.zeros((3, len(bins.width)))
    before[:, 1:] = running[:, bins.start[1:-1] - 1]
    left = running - before[:, bins.owner]
    missing = sums[:, bins.last][:, bins.owner]
    parent = total[0] ** 2 / (total[1] + settings.l2)

    def gains(side: np.ndarray) -> np.ndarray:
        rest = total[:, None] - side
        fine = (side[2] >= settings.min_leaf) & (rest[2] >= settings.min_leaf)
        with np.errstate(divide="ignore", invalid="ignore"):
            value = side[0] ** 2 / (side[1] + settings.l2) + rest[0] ** 2 / (rest[1] + settings.l2) - parent
        return np.where(fine, value, -np.inf)

    # A category goes left alone; a number's bin ends what goes left, but for its missing bin.
    without = gains(np.where(bins.is_category, sums, left))
    last = np.zeros(len(bins.owner), dtype=bool)
    last[bins.last] = True
    without[last & ~bins.is_category] = -np.inf
    with_missing = gains(left + missing)
    with_missing[bins.is_category | last | (missing[2] == 0)] = -np.inf
    options = np.maximum(without, with_missing)
    place = int(np.argmax(options))
    if not options[place] > 1e-12:
        return None
    to_left = bool(with_missing[place] > without[place])
    if missing[2, place] == 0 and not bins.is_category[place]:
        # No row shows where missing values belong: they follow the larger side.
        to_left = bool(2 * left[2, place] > total[2])
    return Split(float(options[place]), int(bins.owner[place]), int(place - bins.start[bins.owner[place]]), to_left)


def goes_left(bins: Bins, split: Split, rows: np.ndarray) -> np.ndarray:
    found = bins.places[rows, split.feature] - bins.start[split.feature]
    if split.feature >= bins.numeric:
        return found == split.bin
    missing = found == bins.width[split.feature] - 1
    return np.where(missing, split.missing_left, found <= split.bin)


def grow(bins: Bins, gradient: np.ndarray, hessian: np.ndarray, rows: np.ndarray, settings: TreeSettings) -> list[dict]:
    """Nodes of one tree, the root first; the split with the largest gain is made next."""

    def node(members: np.ndarray, sums: np.ndarray, depth: int) -> int:
        value = -settings.learning_rate * gradient[members].sum() / (hessian[members].sum() + settings.l2)
        nodes.append({"value": float(value), "n_rows": len(members), "split": None, "left": -1, "right": -1})
        number = len(nodes) - 1
        if depth < settings.depth and len(members) >= 2 * settings.min_leaf:
            found = best_split(bins, sums, settings)
            if found is not None:
                heapq.heappush(open_, (-found.gain, number, depth, found, members, sums))
        return number

    nodes: list[dict] = []
    open_: list = []
    node(rows, bins.histogram(rows, gradient, hessian), 0)
    made = 1
    while open_ and made < settings.leaves:
        _, number, depth, split, members, sums = heapq.heappop(open_)
        left = goes_left(bins, split, members)
        parts = members[left], members[~left]
        small = 0 if len(parts[0]) <= len(parts[1]) else 1
        own = bins.histogram(parts[small], gradient, hessian)
        # The larger side's histogram is what the smaller one leaves.
        both = (own, sums - own) if small == 0 else (sums - own, own)
        nodes[number]["split"] = split
        nodes[number]["left"] = node(parts[0], both[0], depth + 1)
        nodes[number]["right"] = node(parts[1], both[1], depth + 1)
        made += 1
    return nodes


def _walk(bins: Bins, nodes: list[dict], rows: np.ndarray) -> np.ndarray:
    out = np.zeros(len(rows))
    pending = [(0, np.arange(len(rows)))]
    while pending:
        number, members = pending.pop()
        split = nodes[number]["split"]
        if split is None:
            out[members] = nodes[number]["value"]
            continue
        left = goes_left(bins, split, rows[members])
        pending += [(nodes[number]["left"], members[left]), (nodes[number]["right"], members[~left])]
    return out


def poisson_loss(y: np.ndarray, raw: np.ndarray) -> float:
    return float(np.mean(np.exp(raw) - y * raw))


def fit(rows: pd.DataFrame, target: str, numeric: list[str], categorical: list[str], settings: TreeSettings) -> pd.DataFrame:
    """Nodes of all trees of one model; row (tree -1, node 0) holds the logarithm of the mean."""
    y = np.maximum(as_numbers(rows[target]), 0.0)
    bins = Bins(rows, numeric, categorical, settings.bins)
    order = np.random.default_rng(settings.seed).permutation(len(y))
    held = order[: int(len(y) * settings.validation_share)] if settings.patience else order[:0]
    used = np.sort(np.setdiff1d(order, held))
    base = float(np.log(max(y[used].mean(), 1e-10)))
    raw = np.full(len(y), base)
    everyone = np.arange(len(y))
    out = [{"tree": -1, "node": 0, "value": base, "n_rows": len(used)}]
    best, since = poisson_loss(y[held], raw[held]) if len(held) else np.inf, 0
    for tree in range(settings.iterations):
        mean = np.exp(raw)
        nodes = grow(bins, mean - y, mean, used, settings)
        if nodes[0]["split"] is None:
            break
        raw += _walk(bins, nodes, everyone)
        for number, one in enumerate(nodes):
            row = {"tree": tree, "node": number, "value": one["value"], "n_rows": one["n_rows"]}
            if (split := one["split"]) is not None:
                cut = bins.cuts[split.feature]
                row |= {"feature": bins.names[split.feature], "left": one["left"], "right": one["right"], "gain": split.gain}
                row["missing_left"] = split.missing_left
                if split.feature >= bins.numeric:
                    row["category"] = str(cut[split.bin])
                else:
                    # The last cut of a number parts all its values from the missing ones.
                    row["threshold"] = float(cut[split.bin]) if split.bin < len(cut) else np.inf
            out.append(row)
        if len(held):
            loss = poisson_loss(y[held], raw[held])
            best, since = (loss, 0) if loss < best - 1e-7 else (best, since + 1)
            if since >= settings.patience:
                break
    columns = ["tree", "node", "feature", "threshold", "category", "missing_left", "left", "right", "value", "gain", "n_rows"]
    found = pd.DataFrame(out, columns=columns)
    # Columns of texts may have no text at all.
    return found.astype({"feature": object, "category": object, "missing_left": object}).where(found.notna(), None)


class Forest:
    """Trees of one model as arrays, for scoring whole batches."""

    def __init__(self, nodes: pd.DataFrame):
        head = nodes[nodes["tree"] < 0]
        self.base = float(head["value"].iloc[0])
        body = nodes[nodes["tree"] >= 0].sort_values(["tree", "node"])
        self.names = sorted(body["feature"].dropna().unique())
        number = {name: i for i, name in enumerate(self.names)}
        starts = body.groupby("tree")["node"].size().cumsum().to_numpy()
        self.roots = np.concatenate([[0], starts[:-1]]).astype(np.int32) if len(starts) else np.zeros(0, np.int32)
        first = np.repeat(self.roots, np.diff(np.concatenate([[0], starts]))) if len(starts) else np.zeros(0, np.int32)
        inner = body["feature"].notna().to_numpy()
        here = np.arange(len(body))
        self.feature = np.array([number.get(f, 0) for f in body["feature"]], dtype=np.int16)
        self.left = np.where(inner, body["left"].fillna(0).to_numpy(int) + first, here)
        self.right = np.where(inner, body["right"].fillna(0).to_numpy(int) + first, here)
        self.value = body["value"].to_numpy(float)
        self.missing_left = np.array([v is True or v == 1 for v in body["missing_left"]], dtype=bool)
        # Categories are compared as their numbers among those that the model knows.
        self.known = {name: {} for name in body.loc[body["category"].notna(), "feature"].unique()}
        threshold = body["threshold"].to_numpy(float).copy()
        self.equal = body["category"].notna().to_numpy()
        for i in np.flatnonzero(self.equal):
            codes = self.known[body["feature"].iloc[i]]
            threshold[i] = codes.setdefault(body["category"].iloc[i], len(codes))
        self.threshold = threshold
        level, self.depth = self.roots[inner[self.roots]], 0
        while len(level):
            below = np.concatenate([self.left[level], self.right[level]])
            level, self.depth = below[inner[below]], self.depth + 1
        #: Trees that test a feature, by its number.
        tree = np.searchsorted(self.roots, here, side="right") - 1
        self.trees = [np.unique(tree[inner & (self.feature == f)]) for f in range(len(self.names))]

    def matrix(self, rows: pd.DataFrame) -> np.ndarray:
        """Values of the model's features; unknown categories are -1."""
        out = np.empty((len(rows), len(self.names)))
        for i, name in enumerate(self.names):
            if name in self.known:
                out[:, i] = pd.Series(as_categories(rows[name])).map(self.known[name]).fillna(-1).to_numpy(float)
            else:
                out[:, i] = as_numbers(rows[name])
        return out

    def sums(self, values: np.ndarray, trees: np.ndarray | None = None) -> np.ndarray:
        """Sum of the trees' values per row, of all trees or of some."""
        total = np.zeros(len(values))
        every = np.arange(len(values))
        for root in self.roots if trees is None else self.roots[trees]:
            at = np.full(len(values), root)
            for _ in range(self.depth):
                x = values[every, self.feature[at]]
                limit = self.threshold[at]
                left = np.where(self.equal[at], x == limit, np.where(np.isnan(x), self.missing_left[at], x <= limit))
                at = np.where(left, self.left[at], self.right[at])
            total += self.value[at]
        return total

    def predict(self, rows: pd.DataFrame) -> np.ndarray:
        return np.exp(self.base + self.sums(self.matrix(rows)))

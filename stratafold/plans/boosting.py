"""Boosted trees on the joint softmax loss, from histograms that Spark adds up.

Every column is cut into bins once, by a quantile sketch. A round grows one tree for each class on the gradients of the
joint loss. A pass over the rows makes histograms for all classes and all nodes that are open, one aggregation by (tree, node, column, bin); only the
smaller of two siblings is counted, the other is its parent's histogram less that. Trees grow by leaves: the leaf of the highest
gain is split first, until the number of leaves is reached. To spend one pass on many nodes, nodes that may be split are counted ahead of
their turn; which of them are split is decided in the exact order, so that the tree is the one of a node at a time.

Gradients are whole multiples of 2^-22, and their sums are exact. Splits depend neither on partitions nor on the order
of tasks, so that a task that runs again, or another cluster, gives the same trees.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.scalar import argmax, decode
from ..session import scratch_folder, stored
from .cells import quantiles
from .learners import Predictor, patient_rounds

UNIT = 1 << 22  # gradients, second derivatives and losses are counted in 1/UNIT
_SETTLE = 5  # rounds after which the rows' scores are written anew; until then the newest trees are applied in each pass
_DRAWS = 8  # rounds whose samples are counted in one pass over all rows
_HISTOGRAM = "tree int, node int, feature int, bin int, g long, h long, n long"


@dataclass
class Tree:
    """Node 0 is the root. ``left`` is the left child (the right one follows it) or 0 in a leaf; bins above ``cut`` go right."""

    feature: list[int] = field(default_factory=lambda: [0])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int) -> int:
        self.feature[node], self.cut[node], self.left[node] = feature, cut, len(self.left)
        for column, empty in ((self.feature, 0), (self.cut, 0), (self.left, 0), (self.value, 0.0)):
            column += [empty, empty]
        return self.left[node]

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        feature, cut, left = np.array(self.feature), np.array(self.cut), np.array(self.left)
        at = np.zeros(len(bins), dtype=np.int64)
        inner = np.flatnonzero(left[at])
        while len(inner):
            node = at[inner]
            at[inner] = left[node] + (bins[inner, feature[node]] > cut[node])
            inner = inner[left[at[inner]] > 0]
        return at


@dataclass
class SoftmaxModel:
    """Edges of the bins, and for each round one tree for each class."""

    cols: list[str]
    classes: list
    edges: list[list[float]]
    rounds: list[list[Tree]]

    def bins(self, values: np.ndarray) -> np.ndarray:
        """Bin 0 is for missing values; bin i holds values above edge i - 2 and up to edge i - 1."""
        out = np.zeros(values.shape, dtype=np.uint8)
        for j, edges in enumerate(self.edges):
            x = values[:, j]
            out[:, j] = np.where(np.isnan(x), 0, np.searchsorted(np.array(edges), x) + 1)
        return out

    def scores(self, bins: np.ndarray) -> np.ndarray:
        return added(np.zeros((len(bins), len(self.classes))), self.rounds, bins)


def added(scores: np.ndarray, rounds: list[list[Tree]], bins: np.ndarray) -> np.ndarray:
    """The scores after more rounds."""
    scores = scores.copy()
    for trees in rounds:
        for k, tree in enumerate(trees):
            scores[:, k] += np.array(tree.value)[tree.nodes(bins)]
    return scores


def softmax(scores: np.ndarray) -> np.ndarray:
    shifted = np.exp(scores - scores.max(axis=1, keepdims=True, initial=-np.inf))
    return shifted / shifted.sum(axis=1, keepdims=True)


def bin_edges(df: DataFrame, cols: list[str], bins: int) -> list[list[float]]:
    """Edges of at most ``bins`` bins a column, near its quantiles; one pass for all columns."""
    if not 2 <= bins <= 255:
        raise ValueError("bins is between 2 and 255")
    shares = [i / bins for i in range(1, bins)]
    return quantiles(df, cols, shares, 1 / (4 * bins))


class _Growing:
    """A tree and what is known of its nodes: sums of gradients, and the best split of those that were counted."""

    def __init__(self, leaves: int, depth: int | None, min_leaf: int) -> None:
        self.leaves, self.depth, self.min_leaf = leaves, depth, min_leaf
        self.ahead = Tree()  # all splits that were looked at
        self.level, self.rows = [0], [0]
        self.g, self.h = [0], [0]
        self.best: dict[int, dict | None] = {}  # by node; None: it cannot be split

    def learn(self, node: int, found: dict | None) -> None:
        self.best[node] = found if found is not None and found["gain"] > 0 else None

    def open_children(self, node: int) -> tuple[int, int]:
        """The children of a node's best split; those that are too deep or too small to be split need no histogram."""
        if self.ahead.left[node]:
            return self.ahead.left[node], self.ahead.left[node] + 1
        b = self.best[node]
        left = self.ahead.split(node, b["feature"], b["bin"])
        self.level += [self.level[node] + 1] * 2
        for mine, key in ((self.rows, "n"), (self.g, "g"), (self.h, "h")):
            mine += [b[key], mine[node] - b[key]]
        for child in (left, left + 1):
            if (self.depth is not None and self.level[child] >= self.depth) or self.rows[child] < 2 * self.min_leaf:
                self.best[child] = None
        return left, left + 1

    def order(self) -> tuple[list[int], list[int]]:
        """Nodes in the order they are split, highest gain first (ties: the older node), and the ones split whose children are not known yet."""
        split, unknown = [], []
        heap = [(-self.best[0]["gain"], 0)] if self.best.get(0) else []
        while heap and len(split) + 1 < self.leaves:
            _, node = heapq.heappop(heap)
            split.append(node)
            missing = False
            for child in self.open_children(node):
                if child not in self.best:
                    missing = True
                elif self.best[child]:
                    heapq.heappush(heap, (-self.best[child]["gain"], child))
            if missing and len(split) + 1 < self.leaves:
                unknown.append(node)
        return split, unknown

    def finished(self, rate: float, l2: float) -> Tree:
        split, _ = self.order()
        tree, place = Tree(), {0: 0}
        for node in split:
            left = tree.split(place[node], self.ahead.feature[node], self.ahead.cut[node])
            place[self.ahead.left[node]], place[self.ahead.left[node] + 1] = left, left + 1
        for node, at in place.items():
            if not tree.left[at]:
                tree.value[at] = -rate * self.g[node] / (self.h[node] + l2 * UNIT) if self.h[node] + l2 * UNIT > 0 else 0.0
        return tree


def best_splits(histograms: DataFrame, l2: float, min_leaf: int, min_gain: float) -> DataFrame:
    """(tree, node, feature, bin, gain, g, h, n): the split of the highest gain of each node, and the sums of its left side.

    Of equal gains the one of the first column and the lowest bin counts. A node without a split that leaves ``min_leaf`` rows on both sides has no row.
    """
    one = ["tree", "node", "feature"]
    upto = Window.partitionBy(*one).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*one)
    sums = histograms.select(*one, "bin", *[F.sum(c).over(w).alias(c + end) for c in "ghn" for w, end in ((upto, ""), (whole, "_all"))])

    def strength(g, h):
        g, h = g.cast("double") / UNIT, h.cast("double") / UNIT
        return F.when(h + l2 > 0, g * g / (h + F.lit(float(l2)))).otherwise(0.0)

    rest = {c: F.col(f"{c}_all") - F.col(c) for c in "ghn"}
    gain = 0.5 * (strength(F.col("g"), F.col("h")) + strength(rest["g"], rest["h"]) - strength(F.col("g_all"), F.col("h_all"))) - F.lit(float(min_gain))
    fits = sums.where((F.col("n") >= min_leaf) & (rest["n"] >= min_leaf)).withColumn("gain", gain)
    best = F.max_by(F.struct("feature", "bin", "gain", "g", "h", "n"), F.struct("gain", -F.col("feature"), -F.col("bin"))).alias("best")
    return fits.groupBy("tree", "node").agg(best).select("tree", "node", "best.*")


class SoftmaxBooster:
    """One fit: the binned rows in the shared folder, and the passes over them."""

    def __init__(self, model: SoftmaxModel, folder: str, rate: float, leaves: int, depth: int | None, features: float, subsample: float, min_leaf: int, min_gain: float, l2: float, seed: int) -> None:
        self.model, self.folder, self.rate, self.leaves, self.depth = model, folder, rate, leaves, depth
        self.features, self.subsample, self.min_leaf, self.min_gain, self.l2, self.seed = features, subsample, min_leaf, min_gain, l2, seed
        self.settled = 0
        self.binned: DataFrame | None = None
        self.rows: DataFrame | None = None
        self.passes = 0

    def bin_rows(self, labelled: DataFrame) -> None:
        """(bins, y, w, valid, n, draws, scores) of all rows; ``labelled`` has the columns c0.., y, w, valid and pick.

        What equal rows add is a whole multiple, and the same. Which rows a round draws depends on their own ``pick``: they are counted for ``_DRAWS`` rounds at a time.
        """
        model = self.model

        def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                values = np.column_stack([batch.column(f"c{i}").to_numpy(zero_copy_only=False) for i in range(len(model.cols))])
                yield pa.RecordBatch.from_arrays([_rows_as_binary(model.bins(values)), *(batch.column(c) for c in ("y", "w", "valid", "pick"))], names=["bins", "y", "w", "valid", "pick"])

        self.binned = labelled.mapInArrow(binned, _BINNED)
        if self.subsample < 1.0:
            self.binned = stored(self.binned, f"{self.folder}/binned")
        self._collapse()

    def _collapse(self) -> None:
        """Rows of the same bins, class and weight are one row that counts ``n`` times, and as often in each of the next rounds as its rows are drawn."""
        number, seed, subsample, none = len(self.model.rounds), self.seed, self.subsample, bytes(8 * len(self.model.classes))
        rows, names = self.binned, [f"d{i}" for i in range(_DRAWS)] if subsample < 1.0 else []

        def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                pick = batch.column("pick").to_numpy()
                taken = [pa.array((_drawn(pick, seed, number + i) < subsample).astype(np.int64)) for i in range(_DRAWS)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("bins", "y", "w", "valid")), *taken], names=["bins", "y", "w", "valid", *names])

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in filter(len, batches):
                draws = np.column_stack([batch.column(c).to_numpy() for c in names])
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _OWN[:-1]), _rows_as_binary(draws)], names=_OWN)

        if names:
            rows = rows.mapInArrow(drawn, "bins binary, y int, w double, valid boolean, " + ", ".join(f"{n} long" for n in names))
        counted = rows.groupBy("bins", "y", "w", "valid").agg(F.count("*").alias("n"), *[F.sum(n).alias(n) for n in names])
        if names:
            counted = counted.mapInArrow(packed, _STATE.removesuffix(", scores binary"))
        else:
            counted = counted.withColumn("draws", F.lit(b""))
        self.settled = 0
        self.rows = stored(counted.withColumn("scores", F.lit(none)), f"{self.folder}/rows-{number}-0")
        if number:
            self.settle()

    def settle(self) -> None:
        """Write the scores with all trees so far."""
        trees = self.model.rounds[self.settled :]

        def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in filter(len, batches):
                bins, scores = _unpacked(batch)
                yield _state(bins, batch, added(scores, trees, bins))

        self.settled = len(self.model.rounds)
        self.rows = stored(self.rows.mapInArrow(moved, _STATE), f"{self.folder}/rows-{self.settled}-1")

    def _chosen_columns(self, number: int) -> list[list[int]]:
        """Columns of each tree of a round."""
        every = len(self.model.cols)
        take = max(1, round(self.features * every))
        random = np.random.default_rng((self.seed, number))
        return [sorted(random.choice(every, take, replace=False).tolist()) if take < every else list(range(every)) for _ in self.model.classes]

    def count(self, growing: list[_Growing], wanted: list[tuple[int, int]], columns: list[list[int]], loss: bool) -> DataFrame:
        """Histograms of the wanted (tree, node), added up over all training rows; with ``loss`` that of the validation rows, as tree -1."""
        number, width = len(self.model.rounds), 256
        pending, trees = self.model.rounds[self.settled :], {k: growing[k].ahead for k, _ in wanted}
        slots = {k: np.full(len(trees[k].left), -1) for k in trees}
        for k, node in wanted:
            slots[k][node] = (slots[k] >= 0).sum()
        subsample = self.subsample
        self.passes += 1

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = {k: np.zeros((3, (slots[k] >= 0).sum(), len(columns[k]), width), dtype=np.int64) for k in trees}
            lost = judged = 0
            for batch in filter(len, batches):
                bins, scores = _unpacked(batch)
                chance = softmax(added(scores, pending, bins))
                y, w = batch.column("y").to_numpy(), batch.column("w").to_numpy()
                valid, times = batch.column("valid").to_numpy(zero_copy_only=False), batch.column("n").to_numpy()
                if loss and valid.any():
                    own = -np.log(np.maximum(chance[valid, y[valid]], 1e-300)) * w[valid]
                    lost, judged = lost + int((np.rint(own * UNIT).astype(np.int64) * times[valid]).sum()), judged + int(times[valid].sum())
                train = ~valid
                if subsample < 1.0:
                    times = _binary_as_rows(batch.column("draws"), np.int64)[:, number % _DRAWS]
                    train &= times > 0
                bins, chance, y, w, times = bins[train], chance[train], y[train], w[train], times[train]
                for k, tree in trees.items():
                    g = np.rint((chance[:, k] - (y == k)) * w * UNIT).astype(np.int64)
                    h = np.rint(chance[:, k] * (1 - chance[:, k]) * w * UNIT).astype(np.int64)
                    slot = slots[k][tree.nodes(bins)]
                    mine = np.flatnonzero(slot >= 0)
                    shape = sums[k].shape[1], width
                    for f, column in enumerate(columns[k]):
                        cell = slot[mine] * width + bins[mine, column]
                        for i, of in enumerate((g, h, 1)):
                            sums[k][i, :, f] += _whole_sums(cell, (of * times)[mine], shape[0] * width).reshape(shape)
            made: list[tuple] = []
            for k in trees:
                nodes = np.flatnonzero(slots[k] >= 0)[np.argsort(slots[k][slots[k] >= 0])]
                s, f, b = np.nonzero(sums[k][2])
                made.append((np.full(len(s), k), nodes[s], np.array(columns[k])[f], b, *(sums[k][i, s, f, b] for i in range(3))))
            if judged:
                made.append(tuple(np.array([v]) for v in (-1, 0, 0, 0, lost, 0, judged)))
            if made:
                whole = [np.concatenate(c) for c in zip(*made)]
                kinds = [pa.int32()] * 4 + [pa.int64()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)).cast(t) for c, t in zip(whole, kinds)], names=["tree", "node", "feature", "bin", "g", "h", "n"])

        return self.rows.mapInArrow(partial, _HISTOGRAM).groupBy("tree", "node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in "ghn"])

    def round(self) -> float | None:
        """Grow one tree for each class; the loss of the validation rows before it, if there are any."""
        number, spark = len(self.model.rounds), self.rows.sparkSession
        growing = [_Growing(self.leaves, self.depth, self.min_leaf) for _ in self.model.classes]
        columns = self._chosen_columns(number)
        histograms = stored(self.count(growing, [(k, 0) for k in range(len(growing))], columns, loss=True), f"{self.folder}/counts-{number}-0")
        totals = histograms.groupBy("tree", "feature").agg(*[F.sum(c).alias(c) for c in "ghn"]).groupBy("tree").agg(*[F.max(c).alias(c) for c in "ghn"])
        loss = None
        for t in totals.collect():  # a row for each class
            if t["tree"] < 0:
                loss = t["g"] / UNIT / t["n"]
            else:
                growing[t["tree"]].g, growing[t["tree"]].h, growing[t["tree"]].rows = [t["g"]], [t["h"]], [t["n"]]
        known = histograms.where("tree >= 0")
        self._learn(growing, known, [(k, 0) for k in range(len(growing))])
        step = 0
        while True:
            pairs = [(k, node, *sorted(growing[k].open_children(node), key=lambda c, k=k: (growing[k].rows[c], c))) for k in range(len(growing)) for node in growing[k].order()[1]]
            if not pairs:
                break
            step += 1
            small = self.count(growing, [(k, few) for k, _, few, _ in pairs], columns, loss=False)
            # the larger sibling's histogram is the parent's less the smaller one's
            siblings = spark.createDataFrame(pairs, "tree int, node int, few int, many int")
            of_parents = known.join(F.broadcast(siblings), ["tree", "node"])
            counted = small.select("tree", F.col("node").alias("few"), "feature", "bin", *[F.col(c).alias(f"{c}_few") for c in "ghn"])
            rest = of_parents.join(counted, ["tree", "few", "feature", "bin"], "left")
            less = [(F.col(c) - F.coalesce(f"{c}_few", F.lit(0))).alias(c) for c in "ghn"]
            many = rest.select("tree", F.col("many").alias("node"), "feature", "bin", *less).where("n > 0")
            both = stored(small.unionByName(many), f"{self.folder}/counts-{number}-{step}")
            known = known.unionByName(both)
            self._learn(growing, both, [(k, c) for k, _, few, many_ in pairs for c in (few, many_)])
        self.model.rounds.append([g.finished(self.rate, self.l2) for g in growing])
        if self.subsample < 1.0 and len(self.model.rounds) % _DRAWS == 0:
            self._collapse()
        elif len(self.model.rounds) - self.settled >= _SETTLE:
            self.settle()
        return loss

    def _learn(self, growing: list[_Growing], histograms: DataFrame, nodes: list[tuple[int, int]]) -> None:
        found = {(b["tree"], b["node"]): b.asDict() for b in best_splits(histograms, self.l2, self.min_leaf, self.min_gain).collect()}  # a row for each node
        for k, node in nodes:
            if node not in growing[k].best:
                growing[k].learn(node, found.get((k, node)))

    def loss(self) -> float | None:
        """Mean loss of the validation rows with all trees."""
        found = self.count([], [], [], loss=True).collect()
        return found[0]["g"] / UNIT / found[0]["n"] if found else None


_BINNED = "bins binary, y int, w double, valid boolean, pick long"
_STATE = "bins binary, y int, w double, valid boolean, n long, draws binary, scores binary"
_OWN = ["bins", "y", "w", "valid", "n", "draws"]


def _whole_sums(cell: np.ndarray, values: np.ndarray, cells: int) -> np.ndarray:
    """Sums of whole numbers by cell: in doubles while these hold them exactly, else one after the other."""
    if np.abs(values.astype(np.float64)).sum() < 1 << 53:
        return np.bincount(cell, values, cells).astype(np.int64)
    sums = np.zeros(cells, dtype=np.int64)
    np.add.at(sums, cell, values)
    return sums


def _rows_as_binary(rows: np.ndarray) -> pa.Array:
    """Each row's bytes as a binary value."""
    rows = np.ascontiguousarray(rows)
    ends = np.arange(len(rows) + 1, dtype=np.int32) * (rows.shape[1] * rows.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(rows)])


def _binary_as_rows(column: pa.Array, kind) -> np.ndarray:
    data = pa.compute.binary_join(pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column), b"")[0].as_py()
    return np.frombuffer(data, dtype=kind).reshape(len(column), -1)


def _state(bins: np.ndarray, batch: pa.RecordBatch, scores: np.ndarray) -> pa.RecordBatch:
    columns = [_rows_as_binary(bins), *(batch.column(c) for c in _OWN[1:]), _rows_as_binary(scores)]
    return pa.RecordBatch.from_arrays(columns, names=[*_OWN, "scores"])


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return _binary_as_rows(batch.column("bins"), np.uint8), _binary_as_rows(batch.column("scores"), np.float64)


def _drawn(pick: np.ndarray, seed: int, number: int) -> np.ndarray:
    """A number in [0, 1) of each row for a round, from the row's hash."""
    with np.errstate(over="ignore"):
        x = pick.astype(np.uint64) + np.uint64((seed * 1_000_003 + number + 1) & 0xFFFFFFFF) * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def softmax_boosted(
    cols: list[str],
    label: str,
    classes: list,
    rounds: int = 100,
    rate: float = 0.1,
    leaves: int = 31,
    depth: int | None = None,
    bins: int = 64,
    features: float = 1.0,
    subsample: float = 1.0,
    min_leaf: int = 20,
    min_gain: float = 0.0,
    l2: float = 1.0,
    weight: str | None = None,
    key: list[str] | None = None,
    patience: int | None = None,
    edges: list[list[float]] | None = None,
    seed: int = 42,
) -> Callable[..., Predictor]:
    """Boosted trees on the joint softmax loss: ``fit(train)``, or ``fit(train, valid)`` to stop on the validation rows.

    A round adds one tree for each class, grown best leaf first up to ``leaves`` (and ``depth``). ``features`` is the share of columns a tree
    may use, ``subsample`` the share of rows a round trains on (drawn by the hash of ``key``, or of all columns), ``weight`` names a column of
    row weights. With ``patience`` rounds stop once so many in a row have brought no lower joint log loss on ``valid``, and the trees up to the best round are
    kept; the rows' running scores make this one aggregate a round, and nothing is fitted twice. Missing values are the lowest. Rows of other
    classes, or without a label, neither train nor judge. ``edges`` gives the bins instead of the quantiles of the training rows.

    The predictor has ``model``, ``losses`` (before each round and after the last) and ``passes`` (over the rows). Trees come to the driver
    one row a node; rows and histograms stay in Spark. Values that are whole multiples of the unit of a gradient add up exactly, so reruns give the same trees.
    """

    def fit(train: DataFrame, valid: DataFrame | None = None) -> Predictor:
        spark = train.sparkSession
        index = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)).cast("int") - 1

        def numbered(df: DataFrame, judges: bool) -> DataFrame:
            own = [F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(f"c{i}") for i, c in enumerate(cols)]
            weighs = F.col(weight).cast("double") if weight and not judges else F.lit(1.0)
            chosen = df.where(F.col(label).isin(list(classes)))
            return chosen.select(*own, index.alias("y"), weighs.alias("w"), F.lit(judges).alias("valid"), F.xxhash64(*(key or df.columns)).alias("pick"))

        found = edges if edges is not None else bin_edges(train.where(F.col(label).isin(list(classes))), cols, bins)
        model = SoftmaxModel(list(cols), list(classes), found, [])
        losses: list[float] = []
        with scratch_folder(spark, "boosting") as folder:
            booster = SoftmaxBooster(model, folder, rate, leaves, depth, features, subsample, min_leaf, min_gain, l2, seed)
            halves = [numbered(train, False)] + ([numbered(valid, True)] if valid is not None else [])
            booster.bin_rows(halves[0] if valid is None else halves[0].unionByName(halves[1]))
            for _ in range(rounds):
                loss = booster.round()
                if loss is not None:
                    losses.append(loss)  # of the rounds before this one
                    if patience is not None and len(losses) > 1 and patient_rounds(losses[1:], patience) + patience <= len(losses) - 1:
                        break
            else:
                if valid is not None and (last := booster.loss()) is not None:
                    losses.append(last)
        if patience is not None and len(losses) > 1:
            del model.rounds[patient_rounds(losses[1:], patience) :]
        predict = _predictor(model)
        predict.model, predict.losses, predict.passes = model, losses, booster.passes
        return predict

    return fit


def _predictor(model: SoftmaxModel) -> Predictor:
    @F.arrow_udf("array<double>")
    def chances(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for rows in batches:
            values = np.column_stack([rows.field(i).to_numpy(zero_copy_only=False) for i in range(len(model.cols))])
            found = softmax(model.scores(model.bins(values)))
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * found.shape[1]), pa.array(found.ravel()))

    def predict(df: DataFrame) -> DataFrame:
        own = F.struct(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(f"c{i}") for i, c in enumerate(model.cols)])
        kept = [c for c in df.columns if c not in ("probability", "prediction")]
        return df.select(*kept, chances(own).alias("probability")).withColumn("prediction", decode(argmax("probability"), model.classes))

    return predict

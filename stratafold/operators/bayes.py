"""Gaussian naive Bayes as a grouped aggregate and a projection."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from ..functions.scalar import argmax, decode, num
from ..session import kept, removed, scratch_folder, short_shuffles, stored
from .aggregates import grouped_stats, held_out_parts, merge_stats

VARIANCE_FLOOR = 1e-9  # share of the largest feature variance added to every variance
BLOCK_CLASSES = 1024  # classes in a row of the model, at most about, when the caller lists none
SLICES, SLICE_CLASSES = 2048, 32  # cells of a fold at most, and classes of a cell at least
MODEL_BYTES = 64 * 1024 * 1024  # of a model in blocks that is broadcast at a time
_ROWS_OF_TASK = 131_072  # rows that are scored together
_ROWS_TOGETHER = 64  # neighbouring rows that are held against all bounds together
_ROWS_OF_BATCH = 20_000
_PAIRS_AT_A_TIME = 2_000_000  # of a row and a block
_SCORES_AT_A_TIME = 1 << 18


def fit_gaussian_nb(
    df: DataFrame, label: str, cols: list[str], classes: list | None = None, fold: str | None = None, folds: list[int] = ()
) -> DataFrame:
    """One row per held-out fold (or one row) with ``model``: an array of (class, const, mean[], scale[]) in class order.

    The table is aggregated once by (fold, label); what follows works on folds x classes x columns rows.
    Rows of other classes than ``classes`` (None: all of the table) do not train. The classes are picked by
    conditions inside the aggregates: a filter would reach the scan of this branch alone, which then could not
    share the fold shuffle with the scoring branch.
    """
    listed = F.col(label).isNotNull() if classes is None else F.col(label).isin(list(classes))
    models = _per_label(df, label, cols, listed, fold, folds).groupBy("_held").agg(_in_order(label, listed))
    return models.select(*([F.col("_held").alias(fold)] if fold else []), "model")


def fit_gaussian_nb_blocks(df: DataFrame, label: str, cols: list[str], fold: str, folds: list[int]) -> DataFrame:
    """The model of all classes of the table, as rows (fold, block, model, bounds) of similar classes.

    Classes are cut into slices by quantiles of their means in the first two columns, in cells of ``SLICE_CLASSES`` or more; of the two, the column whose
    means lie wider apart, in standard deviations of a class, is cut finer. Cells grow with the root of the number of classes. The classes of a cell of similar variances are a block; a
    block of more than ``BLOCK_CLASSES`` is dealt on by hash, so that no row or task holds all classes. ``bounds`` says what bounds a block's scores.
    """
    with scratch_folder(df.sparkSession, "classes") as folder, short_shuffles(df.sparkSession):
        return kept(_blocks(df, label, cols, fold, folds, folder), "model")


def _blocks(df: DataFrame, label: str, cols: list[str], fold: str, folds: list[int], folder: str) -> DataFrame:
    listed = F.col(label).isNotNull()
    numbers = stored(_numbers(df, label, cols, listed, fold, folds), f"{folder}/numbers")
    per_label = stored(_densities(_spread_by_joins(numbers), ["_held", label]), f"{folder}/densities")
    removed(df.sparkSession, f"{folder}/numbers")
    column = [F.col("_cols")[i] for i in range(len(cols))]
    sliced = column[:2]
    steps = F.lit(np.arange(1, SLICES) / SLICES)
    edges = [F.percentile_approx(c["mean"], steps).alias(f"edges{i}") for i, c in enumerate(sliced)]
    scales = [F.percentile_approx(c["scale"], 0.5).alias(f"scale{i}") for i, c in enumerate(sliced)]
    found = per_label.groupBy("_held").agg(F.count("*").alias("n"), *edges, *scales).collect()  # a row for each fold
    cuts = {r["_held"]: _cuts(r["n"], [(r[f"edges{i}"], r[f"scale{i}"]) for i in range(len(sliced))]) for r in found}

    def place(i: int):
        @F.arrow_udf("int")
        def slice_of(held: pa.Array, means: pa.Array) -> pa.Array:
            held, means = held.to_numpy(zero_copy_only=False), means.to_numpy(zero_copy_only=False)
            out = np.zeros(len(held), dtype=np.int32)
            for h in np.unique(held):
                mine = held == h
                out[mine] = np.searchsorted(cuts[h][i], means[mine], side="left")
            return pa.array(out)

        return slice_of("_held", sliced[i]["mean"])

    # classes of very different variances have bounds that tell little together: their scales agree within a factor of sixteen
    alike = [F.floor(F.log2(c["scale"]) / 4) for c in column[:2]]
    at = [f"_at{i}" for i in range(len(sliced))]
    placed = per_label.withColumns({name: place(i) for i, name in enumerate(at)})
    placed = placed.withColumn("_group", F.xxhash64("_held", *at, *alike))
    sizes = placed.groupBy("_group").agg(F.count("*").alias("_classes"))
    deal = F.pmod(F.xxhash64(label), F.ceil(F.col("_classes") / BLOCK_CLASSES).cast("long"))
    dealt = placed.join(sizes, "_group").withColumn("block", F.xxhash64("_group", deal))
    sound = listed & F.col("const").isNotNull()
    for c in column:
        sound = sound & c["mean"].isNotNull() & c["scale"].isNotNull()

    def of(value: Column, *how) -> list[Column]:
        return [f(F.when(sound, value)) for f in how]

    ranges = [F.struct(*[x.alias(n) for x, n in zip(of(c["mean"], F.min, F.max, F.avg) + of(c["scale"], F.min, F.avg), ("low", "high", "mean", "scale", "usual"))]) for c in column]
    first = [F.min(F.when(listed, F.col(label))).alias("first"), F.min(F.when(sound, F.col(label))).alias("first_sound")]
    const = [x.alias(n) for x, n in zip(of(F.col("const"), F.max, F.avg), ("const", "usual"))]
    bounds = F.struct(*const, *first, F.count(F.when(listed, 1)).alias("classes"), F.array(*[F.min(c) for c in at]).alias("at"), F.array(*ranges).alias("ranges"))
    return dealt.groupBy(F.col("_held").alias(fold), "block").agg(_in_order(label, listed), bounds.alias("bounds"))


def _cuts(n: int, sliced: list[tuple[list, float]]) -> list[np.ndarray]:
    """Where the means of ``n`` classes are cut in each column, from the quantiles of their means and the usual scale."""
    cells = min(float(SLICES), math.ceil(min(n / SLICE_CLASSES, 2 * math.sqrt(n))))  # as many cells as classes in one, about
    edges = [np.array([] if e is None else e, dtype=float) for e, _ in sliced]
    width = [max((e[-1] - e[0]) * math.sqrt(2 * s), 1e-9) if len(e) and s and math.isfinite(e[-1] - e[0]) and math.isfinite(s) else 1e-9 for e, (_, s) in zip(edges, sliced)]
    if len(width) == 1:
        wide = [cells]
    else:
        one = min(cells, max(1.0, round(math.sqrt(cells * width[0] / width[1]))))
        wide = [one, max(1.0, round(cells / one))]
    return [np.unique(e[(np.arange(1, int(w)) * SLICES / w).astype(int) - 1]) if len(e) else e for e, w in zip(edges, wide)]


def _in_order(label: str, listed: Column) -> Column:
    one = F.struct(F.col(label).alias("class"), "const", F.col("_cols.mean").alias("mean"), F.col("_cols.scale").alias("scale"))
    return F.sort_array(F.collect_list(F.when(listed, one))).alias("model")


def _spread_by_joins(numbers: DataFrame) -> DataFrame:
    """``_total`` and ``_floor`` on each row (class and column), from sums that combine before the shuffle; they are a row for each fold and column, and broadcast."""
    key, n = ["_held", "at"], F.col("n")
    means = numbers.groupBy(*key).agg((F.sum(n * F.col("mean")) / F.sum("n")).alias("_mean"), F.sum("n").alias("_n"), F.sum("rows").alias("_total"))
    off = F.col("mean") - F.col("_mean")
    spread = numbers.join(F.broadcast(means), key).groupBy(*key).agg((F.sum(F.col("m2") + n * off * off) / F.max("_n")).alias("_spread"))
    floors = spread.groupBy("_held").agg((F.lit(VARIANCE_FLOOR) * F.max("_spread")).alias("_floor"))
    return numbers.join(F.broadcast(means.select(*key, "_total")), key).join(F.broadcast(floors), "_held")


def _spread_by_windows(numbers: DataFrame, within: list[str]) -> DataFrame:
    """The same for few classes, in one shuffle; ``within`` are the columns that tell models apart."""
    column, whole = Window.partitionBy(*within, "at"), Window.partitionBy(*within)
    n_all = F.sum("n").over(column)
    off = F.col("mean") - F.col("_mean")
    return (
        numbers.withColumn("_mean", F.sum(F.col("n") * F.col("mean")).over(column) / n_all)
        .withColumn("_spread", F.sum(F.col("m2") + F.col("n") * off * off).over(column) / n_all)
        .withColumn("_total", F.sum("rows").over(column))
        .withColumn("_floor", F.lit(VARIANCE_FLOOR) * F.max("_spread").over(whole))
    )


def _numbers(df: DataFrame, label: str, cols: list[str], listed: Column, fold: str | None, folds: list[int]) -> DataFrame:
    """(_held, label, at, rows, n, mean, m2): one row for each class and column of each held-out fold."""
    if fold:
        parts = held_out_parts(grouped_stats(df, cols, [fold, label]), [label], folds, fold)
    else:
        whole = grouped_stats(df, cols, [label])
        parts = whole.select(label, "rows", F.inline("stats")).withColumn("_held", F.lit(0))
    per_class = merge_stats(parts, ["_held", label, "at"])
    numbers = [F.when(listed, F.col(c)).alias(c) for c in ("rows", "n", "mean", "m2")]
    return per_class.select("_held", label, "at", *numbers)


def _densities(spread: DataFrame, key: list[str]) -> DataFrame:
    """(key, const, _cols): what the log density of a class needs."""
    fitted = spread.withColumn("_var", F.col("m2") / F.col("n") + F.col("_floor"))
    entry = F.struct("at", "mean", (F.lit(0.5) / F.col("_var")).alias("scale"))
    prior = F.log(F.max("rows") / F.max("_total"))
    return fitted.groupBy(*key).agg(
        (prior - 0.5 * F.sum(F.log(F.lit(2 * math.pi) * F.col("_var")))).alias("const"),
        F.sort_array(F.collect_list(entry)).alias("_cols"),
    )


def _per_label(df: DataFrame, label: str, cols: list[str], listed: Column, fold: str | None, folds: list[int]) -> DataFrame:
    """(_held, label, const, _cols), one row for each class of each held-out fold."""
    return _densities(_spread_by_windows(_numbers(df, label, cols, listed, fold, folds), ["_held"]), ["_held", label])


def _score(m: Column, cols: list[str]) -> Column:
    terms = [(num(x) - m["mean"][j]) * (num(x) - m["mean"][j]) * m["scale"][j] for j, x in enumerate(cols)]
    return F.coalesce(m["const"] - sum(terms[1:], terms[0]), F.lit(float("-inf")))


def predict_gaussian_nb(
    df: DataFrame, model: DataFrame, cols: list[str], classes: list | None = None, fold: str | None = None, out: str = "prediction"
) -> DataFrame:
    """Add ``scores`` (log joint density per class) and the class of the largest, lowest on ties.

    Scores are in the order of ``classes``, -inf for one that was not seen in training; without them, in the order of
    the model's classes. A model is one row per fold, and a row is scored against its classes in place. Listed classes are put in
    their order once for a model, so that a row's scores are plain arithmetic, which Spark compiles.
    """
    if classes is not None:
        slots = F.array(*[F.get("model", F.array_position("model.class", F.lit(c)).cast("int") - 1) for c in classes])
        model = model.withColumn("model", slots)
    if fold:
        scored = df.join(F.broadcast(model.withColumnRenamed("model", "_model")), [fold], "left").select(*df.columns, "_model")
    else:
        scored = df.withColumn("_model", model.select("model").scalar())
    if classes is None:
        scored = scored.withColumn("scores", F.transform("_model", lambda m: _score(m, cols)))
        return scored.withColumn(out, F.get("_model", argmax("scores"))["class"]).drop("_model")
    scored = scored.withColumn("scores", F.array(*[_score(F.get("_model", F.lit(k)), cols) for k in range(len(classes))]))
    return scored.drop("_model").withColumn(out, decode(argmax("scores"), classes))


def nb_probabilities(scores: str = "scores", n: int | None = None) -> Column:
    """Class probabilities from log joint densities; with the number ``n`` of classes, if small, as plain arithmetic."""
    if n is not None and n <= 16:  # each class has its own expression
        own = [F.exp(F.get(scores, F.lit(k)) - F.array_max(scores)) for k in range(n)]
        return F.array(*[x / sum(own, F.lit(0.0)) for x in own])
    shifted = F.transform(scores, lambda s: F.exp(s - F.array_max(scores)))
    total = F.aggregate(shifted, F.lit(0.0), lambda a, x: a + x)
    return F.transform(shifted, lambda x: x / total)


class _Bounds:
    """What bounds the scores of a fold's blocks: the largest constant, and for each column the range of means and the least scale."""

    def __init__(self, blocks: list[dict]) -> None:
        bounds = [b["bounds"] for b in blocks]

        def numbers(values) -> np.ndarray:
            return np.array([np.nan if v is None else v for v in values], dtype=float)

        sound = np.array([b["first_sound"] is not None for b in bounds])
        self.block, self.classes = np.array([b["block"] for b in blocks]), np.array([b["classes"] for b in bounds])
        self.const, self.usual = (np.where(sound, numbers(b[k] for b in bounds), -np.inf) for k in ("const", "usual"))
        columns = range(len(bounds[0]["ranges"]))
        self.ranges = [{k: np.where(sound, numbers(b["ranges"][j][k] for b in bounds), 0.0) for k in ("low", "high", "mean", "scale", "usual")} for j in columns]
        listed = [i for i, b in enumerate(bounds) if b["first"] is not None]
        self.lowest = min(listed, key=lambda i: bounds[i]["first"], default=0)
        self.lowest_sound = min(np.flatnonzero(sound).tolist(), key=lambda i: bounds[i]["first_sound"], default=self.lowest)
        at = np.array([b["at"] for b in bounds])
        self.edges, self.cells = [], {}
        for j in range(at.shape[1]):  # the highest mean of each slice
            slices, own = np.unique(at[:, j], return_inverse=True)
            high = np.full(len(slices), -np.inf)
            np.maximum.at(high, own, np.where(sound, self.ranges[j]["high"], -np.inf))
            self.edges.append(np.maximum.accumulate(high)[:-1])
            at[:, j] = own
        for i, cell in enumerate(map(tuple, at.tolist())):
            if sound[i]:
                self.cells.setdefault(cell, []).append(i)
        self.everywhere = np.flatnonzero(sound) if sound.any() else np.arange(len(bounds))

    def upper(self, low: np.ndarray, high: np.ndarray, own: np.ndarray) -> np.ndarray:
        """No class of the blocks ``own`` scores more for a row between ``low`` and ``high`` (rows x columns): its distance to a mean is at least that to the range of means."""
        total = 0.0
        for j, r in enumerate(self.ranges):
            off = np.maximum(np.maximum(r["low"][own] - high[:, j, None], low[:, j, None] - r["high"][own]), 0.0)
            total = total + off * off * r["scale"][own]
        upper = self.const[own] - total
        upper = upper + 1e-9 * (1 + np.abs(np.where(np.isinf(upper), 0.0, upper)))
        return np.where(np.isnan(upper), np.inf, upper)

    def home(self, x: np.ndarray) -> np.ndarray:
        """For each row the place of the block whose usual class scores most, among those of its cell."""
        out = np.empty(len(x), dtype=np.int64)
        out[:] = np.where(np.isnan(x).any(axis=1), self.lowest_sound, self.lowest)
        finite = np.isfinite(x).all(axis=1).nonzero()[0]
        cell = np.stack([np.searchsorted(e, x[finite, j], side="left") for j, e in enumerate(self.edges)], axis=1)
        order = np.lexsort(cell.T)
        cell, finite = cell[order], finite[order]
        starts = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]).any(axis=1)])) if len(finite) else []
        for start, end in zip(starts, [*starts[1:], len(finite)]):
            own = np.array(self.cells.get(tuple(cell[start].tolist()), self.everywhere))
            for rows in np.array_split(finite[start:end], math.ceil((end - start) * len(own) / _SCORES_AT_A_TIME)):
                usual = self.usual[own] - sum((x[rows, j, None] - r["mean"][own]) ** 2 * r["usual"][own] for j, r in enumerate(self.ranges))
                out[rows] = own[np.argmax(np.where(np.isnan(usual), -np.inf, usual), axis=1)]
        return out

    def others(self, x: np.ndarray, score: np.ndarray, home: np.ndarray, among: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (row, place of a block): the blocks ``among`` beside its own whose bound is not below the score that a row has."""
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        finite = np.isfinite(x).all(axis=1).nonzero()[0]
        finite = finite[np.lexsort((*x[finite].T[::-1], home[finite]))]
        for start in range(0, len(finite), _ROWS_TOGETHER):
            rows = finite[start : start + _ROWS_TOGETHER]
            low, high = x[rows].min(axis=0, keepdims=True), x[rows].max(axis=0, keepdims=True)
            near = among[self.upper(low, high, among)[0] >= score[rows].min()]
            for part in np.array_split(near, math.ceil(len(near) * len(rows) / _SCORES_AT_A_TIME)) if len(near) else []:
                reach = self.upper(x[rows], x[rows], part) >= score[rows, None]
                row, place = np.nonzero(reach & (part != home[rows, None]))
                pairs.append((rows[row], part[place]))
            if sum(len(r) for r, _ in pairs[-1:]) and sum(len(r) for r, _ in pairs) >= _PAIRS_AT_A_TIME:
                yield np.concatenate([r for r, _ in pairs]), np.concatenate([b for _, b in pairs])
                pairs = []
        if pairs:
            yield np.concatenate([r for r, _ in pairs]), np.concatenate([b for _, b in pairs])


def _floats(column: pa.Array, missing: float) -> np.ndarray:
    return np.asarray(column.cast(pa.float64()).fill_null(missing).to_numpy(zero_copy_only=False))


def _matrix(values: dict[str, pa.Array], cols: list[str]) -> np.ndarray:
    """Rows x columns; a missing value, with which no class has a score, is an infinite one."""
    return np.stack([_floats(values[c], math.inf) for c in cols], axis=1)


def _scored(record: pa.StructScalar, width: int) -> tuple[pa.Array, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Classes, constants, means and scales of a block; a class without one of them has no score."""
    model = record.values
    const = _floats(model.field("const"), -math.inf)
    parts: dict[str, list[np.ndarray]] = {}
    for name in ("mean", "scale"):
        lists = model.field(name)
        flat = pa.compute.list_flatten(lists)
        table = flat.to_numpy(zero_copy_only=False).reshape(len(lists), width)
        gone = flat.is_null().to_numpy(zero_copy_only=False).reshape(len(lists), width).any(axis=1)
        const = np.where(gone, -math.inf, const)
        parts[name] = [np.where(gone, 0.0, table[:, j]) for j in range(width)]
    return model.field("class"), const, parts["mean"], parts["scale"]


def _best(x: np.ndarray, const: np.ndarray, means: list[np.ndarray], scales: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The largest score of each row and the first class that has it; a score that is not a number counts as the largest."""
    score, at = np.empty(len(x)), np.empty(len(x), dtype=np.int64)
    step = max(1, _SCORES_AT_A_TIME // len(const))
    with np.errstate(invalid="ignore", over="ignore"):
        for start in range(0, len(x), step):
            rows, total = x[start : start + step], None
            for j in range(x.shape[1]):
                off = rows[:, j, None] - means[j]
                term = off * off * scales[j]
                total = term if total is None else total + term
            found = const - total
            found[np.isnan(found)] = np.inf
            at[start : start + step] = np.argmax(found, axis=1)
            score[start : start + step] = np.take_along_axis(found, at[start : start + step, None], axis=1)[:, 0]
    return score, at


def _together(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of ``rows`` or more, as far as there are so many."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.concat_batches(held)
            held = []
    if sum(b.num_rows for b in held):
        yield pa.concat_batches(held)


def _dealt_blocks(blocks: DataFrame, fold: str, width: int, path: str) -> tuple[DataFrame, dict]:
    """The blocks with ``_chunk``, a folder for each chunk of at most ``MODEL_BYTES`` (one block at least), and what is known of the blocks, by fold.

    Blocks of a fold whose means lie together are dealt together, so that few rows need more than one chunk.
    """
    kind = blocks.schema["model"].dataType.elementType["class"].dataType
    long = F.expr("aggregate(model, 0L, (a, m) -> a + octet_length(cast(m.class as string)))") if isinstance(kind, StringType) else F.lit(0).cast("long")
    known = blocks.select(fold, "block", "bounds", long.alias("_long")).toArrow().to_pylist()  # one row for up to BLOCK_CLASSES classes
    places: dict = {}
    rows, chunk, filled = [], 0, 0
    for b in sorted(known, key=lambda b: (b[fold] is not None, b[fold], b["bounds"]["at"], b["block"])):
        size = b["_long"] + b["bounds"]["classes"] * 8 * (3 + 2 * width)
        if filled and filled + size > MODEL_BYTES:
            chunk, filled = chunk + 1, 0
        filled += size
        rows.append((b[fold], b["block"], chunk))
        places.setdefault(b[fold], []).append(b | {"_chunk": chunk})
    spark = blocks.sparkSession
    where = spark.createDataFrame(rows, StructType([blocks.schema[fold], blocks.schema["block"], StructField("_chunk", IntegerType())]))
    dealt = blocks.select(fold, "block", "model").join(F.broadcast(where), [fold, "block"])
    dealt.repartition("_chunk").write.partitionBy("_chunk").parquet(path)
    return spark.read.schema(dealt.schema).parquet(path), places


def predict_gaussian_nb_blocks(df: DataFrame, blocks: DataFrame, cols: list[str], fold: str, key: list[str], out: str = "prediction", visits: str | None = None) -> DataFrame:
    """Add the class of the largest score, lowest on ties, from a model in blocks, by branch and bound.

    Every row meets the block of its cell whose usual class scores most; then those whose bound is not below the score it has. Bounds, a row for each
    block, are sent to the tasks; blocks are broadcast in chunks of ``MODEL_BYTES``, and a row carries its best class from chunk to chunk, those alone that
    can still win. No row is written or shuffled once for each block it meets. Rows of one ``key`` share the best of their classes. ``visits`` names a column
    for the number of classes a row was scored against.
    """
    spark = df.sparkSession
    class_type = blocks.schema["model"].dataType.elementType["class"].dataType
    xs = [f"_x{j}" for j in range(len(cols))]
    with scratch_folder(spark, "bayes") as folder, short_shuffles(spark):
        dealt, places = _dealt_blocks(blocks, fold, len(cols), f"{folder}/model")
        # a training row without a label makes a block of no classes, and the rows of that fold get no prediction
        sound = {f: own for f, own in places.items() if f is not None and all(b["bounds"]["classes"] for b in own)}
        bounds = spark.sparkContext.broadcast({f: (_Bounds(own), np.array([b["_chunk"] for b in own])) for f, own in sound.items()})
        extra = [StructField("_home", IntegerType()), StructField("_first", IntegerType())]
        state = [StructField("_home", IntegerType()), StructField("_cost", DoubleType()), StructField("_class", class_type), StructField("_seen", LongType()), StructField("_left", ArrayType(IntegerType()))]
        asked_schema, state_schema = (StructType([*df.schema.fields, *own]) for own in (extra, state))
        asked_arrow, state_arrow = to_arrow_schema(asked_schema), to_arrow_schema(state_schema)

        def numbered(rows: DataFrame) -> DataFrame:
            return rows.select("*", *[num(c).alias(x) for c, x in zip(cols, xs)])

        def by_fold(batch: pa.RecordBatch):
            own = np.asarray(batch.column(fold).to_pylist(), dtype=object)
            for f in set(own.tolist()):
                yield f, np.flatnonzero(own == f) if f is not None else np.flatnonzero([v is None for v in own])

        def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                home, first = (np.full(batch.num_rows, -1, dtype=np.int32) for _ in range(2))
                x = _matrix({c: batch.column(c) for c in xs}, xs) if batch.num_rows else None
                for f, rows in by_fold(batch):
                    if f in bounds.value:
                        known, chunk = bounds.value[f]
                        home[rows] = known.home(x[rows])
                        first[rows] = chunk[home[rows]]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in df_columns], pa.array(home), pa.array(first)], schema=asked_arrow)

        def scored(chunk: int, shared, again: bool):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                at = {}
                for i, (f, block) in enumerate(zip(shared.value[fold].to_pylist(), shared.value["block"].to_pylist())):
                    at[f, block] = i
                model = shared.value["model"].combine_chunks()
                found: dict[int, tuple] = {}

                def block(i: int) -> tuple:
                    if i not in found:
                        classes, *own = _scored(model[i], len(xs))
                        found[i] = (classes.to_numpy(zero_copy_only=False), *own)
                    return found[i]

                for batch in _together(batches, _ROWS_OF_TASK):
                    n = batch.num_rows
                    x, home = _matrix({c: batch.column(c) for c in xs}, xs), batch.column("_home").to_numpy()
                    if again:
                        score, best, seen = -batch.column("_cost").to_numpy(), batch.column("_class").to_numpy(zero_copy_only=False).copy(), batch.column("_seen").to_numpy().copy()
                    else:
                        score, best, seen = np.full(n, -np.inf), None, np.zeros(n, dtype=np.int64)
                    more = np.zeros((n, 0), dtype=bool)
                    for f, rows in by_fold(batch):
                        known, chunks = bounds.value[f]
                        here = np.flatnonzero(chunks == chunk)
                        if not len(here):
                            continue
                        if not again:
                            best = _meet(x, score, best, seen, rows, home[rows], lambda p: block(at[f, known.block[p]]))
                        for own, places in known.others(x[rows], score[rows], home[rows], here):
                            best = _meet(x, score, best, seen, rows[own], places, lambda p: block(at[f, known.block[p]]))
                        there = np.flatnonzero(chunks != chunk)
                        if not again and len(there):
                            if not more.shape[1]:
                                more = np.zeros((n, 1 + max(int(c.max()) for _, c in bounds.value.values())), dtype=bool)
                            for own, places in known.others(x[rows], score[rows], home[rows], there):
                                more[rows[own], chunks[places]] = True
                    row, open_ = np.nonzero(more)
                    left = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int32)), pa.array(open_.astype(np.int32)))
                    kind = state_arrow.field("_class").type
                    own = [pa.array(-score), pa.array(best, from_pandas=False).cast(kind), pa.array(seen), left.cast(state_arrow.field("_left").type) if not again else batch.column("_left")]
                    made = pa.RecordBatch.from_arrays([*[batch.column(c) for c in df_columns], batch.column("_home"), *own], schema=state_arrow)
                    for i in range(0, n, _ROWS_OF_BATCH):
                        yield made.slice(i, _ROWS_OF_BATCH)

            return run

        def shared_chunk(chunk: int):
            return spark.sparkContext.broadcast(dealt.where(F.col("_chunk") == chunk).drop("_chunk").toArrow())

        df_columns = df.columns
        numbered(df).mapInArrow(homes, asked_schema).write.partitionBy("_first").parquet(f"{folder}/asked")
        asked = spark.read.schema(asked_schema).parquet(f"{folder}/asked")
        none = [F.lit(None).cast(x.dataType).alias(x.name) for x in state[1:]]
        asked.where(F.col("_first") < 0).select(*df_columns, "_home", *none).write.parquet(f"{folder}/first")
        for chunk in sorted({b["_chunk"] for own in sound.values() for b in own}):
            shared = shared_chunk(chunk)
            mine = numbered(asked.where(F.col("_first") == chunk).drop("_first"))
            mine.mapInArrow(scored(chunk, shared, False), state_schema).write.mode("append").parquet(f"{folder}/first")
            shared.destroy()
        removed(spark, f"{folder}/asked")
        first = spark.read.schema(state_schema).parquet(f"{folder}/first")
        is_open = F.coalesce(F.size("_left") > 0, F.lit(False))
        again = first.where(is_open)
        wanted = sorted(r[0] for r in again.select(F.explode("_left")).distinct().collect())  # a row for each chunk at most
        for i, chunk in enumerate(wanted):
            shared = shared_chunk(chunk)
            asks = F.array_contains("_left", F.lit(chunk))
            tried = numbered(again.where(asks)).mapInArrow(scored(chunk, shared, True), state_schema)
            again = stored(tried.union(again.where(~asks)), f"{folder}/again-{i}")
            shared.destroy()
            if i:
                removed(spark, f"{folder}/again-{i - 1}")
        ended = first.where(~is_open).union(again)
        # a key that comes twice has the best of its rows' classes
        id_, hashed = F.struct(fold, *key), F.xxhash64(fold, *key)
        twice = stored(ended.groupBy(hashed.alias("_h")).agg(F.count("*").alias("_n")).where("_n > 1").select("_h"), f"{folder}/twice")
        if not twice.isEmpty():
            some = ended.withColumns({"_h": hashed, "_id": id_}).join(twice, "_h", "left_semi")
            per = some.groupBy("_id").agg(F.min(F.struct("_cost", "_class")).alias("_best"), F.sum("_seen").alias("_sum"))
            shared_best = ended.withColumn("_id", id_).join(per, "_id", "left")
            ended = shared_best.withColumns({"_class": F.when(F.col("_best").isNull(), F.col("_class")).otherwise(F.col("_best._class")), "_seen": F.coalesce("_sum", "_seen")})
        made = kept(ended.select(*df_columns, F.col("_class").alias(out), *([F.coalesce("_seen", F.lit(0)).alias(visits)] if visits else [])), "predicted")
        bounds.destroy()
        return made


def _meet(x: np.ndarray, score: np.ndarray, best: np.ndarray | None, seen: np.ndarray, rows: np.ndarray, places: np.ndarray, block: Callable) -> np.ndarray:
    """Score ``rows`` against the classes of the block at their place; ``score``, ``best`` (made with the first classes) and ``seen`` are bettered."""
    order = np.argsort(places, kind="stable")
    rows, places = rows[order], places[order]
    starts = np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1]])) if len(rows) else []
    for start, end in zip(starts, [*starts[1:], len(rows)]):
        own = rows[start:end]
        classes, *model = block(int(places[start]))
        found, at = _best(x[own], *model)
        if best is None:
            best = np.empty(len(x), dtype=classes.dtype)
        better = (found > score[own]) | (seen[own] == 0)
        tie = np.flatnonzero((found == score[own]) & ~better)
        if len(tie):
            better[tie] = classes[at[tie]] < best[own[tie]]
        score[own[better]], best[own[better]] = found[better], classes[at[better]]
        seen[own] += len(classes)
    return best


def nb_out_of_fold(
    df: DataFrame, label: str, cols: list[str], folds: list[int], classes: list | None = None, fold: str = "fold", key: list[str] | None = None, visits: str | None = None
) -> DataFrame:
    """Out-of-fold predictions of every validation row, all folds in one plan.

    With ``classes`` there are ``scores`` too. Without, the classes may be any number: the model comes in blocks, only the
    best class of a row is kept, and ``key`` must name the columns that identify a row.
    """
    if classes is None:
        if not key:
            raise ValueError("key is needed where the classes are not listed")
        with short_shuffles(df.sparkSession):
            df = kept(df, "folded")  # read for the model and for its rows
        model = fit_gaussian_nb_blocks(df, label, cols, fold, folds)
        return predict_gaussian_nb_blocks(df.where(F.col(fold).isNotNull()), model, cols, fold, key, visits=visits)
    model = fit_gaussian_nb(df, label, cols, classes, fold, folds)
    return predict_gaussian_nb(df.where(F.col(fold).isNotNull()), model, cols, classes, fold)


def nb_variant_hits(df: DataFrame, label: str, variants: dict[str, list[str]], classes: list, folds: list[int], fold: str = "fold") -> DataFrame:
    """(variant, fold, accuracy) of naive Bayes on several choices of columns, from one fit and one scoring pass.

    Statistics of all columns are taken once, by fold and class. A variant picks its columns among them, and only its constants and
    the floor of its variances are its own. A row's squared distance to a class is taken once for each column; each variant weighs and adds
    those of its columns. Rows without a label are not right.
    """
    names = list(variants)
    cols = list(dict.fromkeys(c for own in variants.values() for c in own))
    if not all(variants.values()):
        raise ValueError("a variant has no columns")
    listed = F.col(label).isin(list(classes))
    numbers = _numbers(df, label, cols, listed, fold, folds).where(listed)
    uses = F.array(*[F.struct(F.lit(v).alias("variant"), F.array(*[F.lit(cols.index(c)) for c in variants[name]]).alias("own")) for v, name in enumerate(names)])
    chosen = numbers.select("*", F.inline(uses)).where(F.array_contains("own", F.col("at"))).drop("own")
    models = _densities(_spread_by_windows(chosen, ["_held", "variant"]), ["_held", "variant", label])
    scale = F.map_from_entries(F.transform("_cols", lambda c: F.struct(c["at"], c["scale"])))
    weights = F.transform(F.sequence(F.lit(0), F.lit(len(cols) - 1)), lambda j: F.coalesce(F.try_element_at(scale, j), F.lit(0.0)))
    per_class = models.groupBy("_held", label).agg(
        F.sort_array(F.collect_list(F.struct("variant", "const", weights.alias("weights")))).alias("variants"),
        F.map_from_entries(F.array_distinct(F.flatten(F.collect_list(F.transform("_cols", lambda c: F.struct(c["at"], c["mean"])))))).alias("_means"),
    )
    means = F.transform(F.sequence(F.lit(0), F.lit(len(cols) - 1)), lambda j: F.try_element_at("_means", j))
    one = F.struct(F.col(label).alias("class"), means.alias("mean"), "variants")
    model = per_class.groupBy(F.col("_held").alias(fold)).agg(F.sort_array(F.collect_list(one)).alias("_model"))
    scored = df.where(F.col(fold).isNotNull()).join(F.broadcast(model), [fold])

    def distances(m: Column) -> Column:
        return F.array(*[(num(x) - m["mean"][j]) * (num(x) - m["mean"][j]) for j, x in enumerate(cols)])

    far = scored.withColumn("_far", F.transform("_model", distances))

    def scores(v: int, places: list[int]) -> Column:
        def score(m: Column, k: Column) -> Column:
            terms = [F.get(F.col("_far"), k)[j] * m["variants"][v]["weights"][j] for j in places]
            return F.coalesce(m["variants"][v]["const"] - sum(terms[1:], terms[0]), F.lit(float("-inf")))

        return F.transform("_model", score)

    right = []
    for v, name in enumerate(names):
        best = F.get("_model", argmax(scores(v, [cols.index(c) for c in variants[name]])))["class"]
        right.append(F.avg(F.coalesce(best == F.col(label), F.lit(False)).cast("double")).alias(f"v{v}"))
    found = far.groupBy(fold).agg(*right)
    return found.select(fold, F.inline(F.array(*[F.struct(F.lit(n).alias("variant"), F.col(f"v{v}").alias("accuracy")) for v, n in enumerate(names)]))).select("variant", fold, "accuracy")

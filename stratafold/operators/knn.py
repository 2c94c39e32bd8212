"""Exact k-nearest-neighbour join and classifier.

Distances are computed by numpy on Arrow batches. Two ways, chosen by the measured size of the points:

* points within ``MAX_POINT_BYTES``: they are broadcast and the queries are not moved at all;
* more: points are split into cells around pivot vectors, and the cells dealt into chunks of ``CHUNK_BYTES``. One chunk
  after the other is broadcast; a query carries its k best so far from pass to pass, so that no pair of query and cell is ever
  written or shuffled. A first round searches the cell a query lies in, which gives an upper bound for its k-th distance; a
  second searches only the other cells whose lower bound (triangle inequality) is within it. A cell larger than a
  chunk is cut into parts.

Disk thereby holds the points and the queries with their k best, whatever the number of pairs; a task holds a chunk.
Of equal vectors only the k lowest keys can ever be neighbours (ties go to the lower key), so copies
beyond those are removed first; the limit applies before the shuffle as well as after it.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from ..session import checkpoint_dir, kept, removed, scratch_folder, short_shuffles, stored
from .folds import hash_order
from .voting import top_votes

MAX_POINT_BYTES = 64 * 1024 * 1024
CHUNK_BYTES = 64 * 1024 * 1024  # points that are broadcast at a time where there are more
BLOCK_ROWS = 4096
TILE_VALUES = 262_144  # distances that are looked at together, so that they stay in a core's cache
GAP_VALUES = 2_000_000  # numbers of a task's intermediate arrays: queries by pivots, or candidates by dimensions


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(array):
        return np.zeros((0, 0))
    return np.asarray(array.flatten(), dtype="float64").reshape(len(array), -1)


def nearest(queries: np.ndarray, points: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, point row, distance) of the k nearest points of each query; ties by point row.

    The expanded square picks candidates; those within its rounding error of the k-th are measured again.
    """
    k = min(k, len(points))
    if k == 0 or len(queries) == 0:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    norms = (points * points).sum(1)
    found = []
    step = max(1, 4_000_000 // len(points))
    for at in range(0, len(queries), step):
        q = queries[at : at + step]
        q_norms = (q * q).sum(1)
        rough = q_norms[:, None] + norms[None, :] - 2.0 * (q @ points.T)
        kth = np.partition(rough, k - 1, axis=1)[:, k - 1]
        slack = 1e-9 * (q_norms + norms.max() + 1.0)
        rows, cols = np.nonzero(rough <= (kth + slack)[:, None])
        exact = np.empty(len(rows))
        few = max(1, GAP_VALUES // max(1, points.shape[1]))
        for i in range(0, len(rows), few):
            part = slice(i, i + few)
            gap = q[rows[part]] - points[cols[part]]
            exact[part] = np.sqrt((gap * gap).sum(1))
        order = np.lexsort((cols, exact, rows))
        rows, cols, exact = rows[order], cols[order], exact[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        keep = place < k
        found.append((rows[keep] + at, cols[keep], exact[keep]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _neighbour_schema(queries: DataFrame, points: DataFrame, query_key: list[str], cols: list[str]) -> StructType:
    fields = [queries.schema[c] for c in query_key] + [points.schema[c] for c in cols]
    return StructType([StructField(f.name, f.dataType) for f in fields] + [StructField("distance", DoubleType())])


def _rows(q: pa.Table, p: pa.Table, vec: str, k: int, query_key: list[str], cols: list[str], schema: pa.Schema) -> pa.Table:
    qi, pi, dist = nearest(_matrix(q[vec]), _matrix(p[vec]), k)
    arrays = [q[c].take(pa.array(qi)) for c in query_key] + [p[c].take(pa.array(pi)) for c in cols]
    return pa.Table.from_arrays([*arrays, pa.array(dist)], names=schema.names).cast(schema)


def knn_join(
    queries: DataFrame,
    points: DataFrame,
    k: int,
    vec: str,
    query_key: list[str],
    point_key: str,
    carry: list[str] = (),
    max_point_bytes: int = MAX_POINT_BYTES,
    block_rows: int = BLOCK_ROWS,
    pivots: int | None = None,
) -> DataFrame:
    """(query key.., point key, carried point columns, distance, rank) of the k nearest points by Euclidean distance.

    Column names of the two sides must not clash, but for ``vec``. There are as many pivots as the square root of the
    number of points, unless ``pivots`` says otherwise. ``block_rows`` points of a cell are compared at a time.
    """
    cols = [point_key, *carry]
    queries = queries.select(*query_key, vec).where(F.col(vec).isNotNull())
    points = points.select(*cols, vec).where(F.col(vec).isNotNull())
    copies = Window.partitionBy(vec).orderBy(point_key)
    points = points.withColumn("_copy", F.row_number().over(copies)).where(F.col("_copy") <= k).drop("_copy")
    schema = _neighbour_schema(queries, points, query_key, cols)
    total = points.agg(F.sum(_width(vec, cols)).alias("bytes"), F.count("*").alias("rows")).first()
    if (total["bytes"] or 0) <= max_point_bytes:
        found = _broadcast_search(queries, points.toArrow().sort_by(point_key), k, vec, query_key, cols, schema)
    else:
        found = _cell_search(queries, points, k, vec, query_key, point_key, cols, schema, block_rows, pivots or math.isqrt(total["rows"]) + 1)
    best = Window.partitionBy(*query_key).orderBy("distance", point_key)
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _width(vec: str, cols: list[str]) -> Column:
    """Bytes of a point: all its columns are counted."""
    return F.size(vec) * 8 + sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + 16 for c in cols), F.lit(0))


def _broadcast_search(queries, points: pa.Table, k, vec, query_key, cols, schema: StructType) -> DataFrame:
    shared = queries.sparkSession.sparkContext.broadcast(points)
    arrow = to_arrow_schema(schema)

    def search(batches):
        for batch in batches:
            yield from _rows(pa.Table.from_batches([batch]), shared.value, vec, k, query_key, cols, arrow).to_batches()

    return queries.mapInArrow(search, schema)


# --- cells -----------------------------------------------------------------------------------


def _to_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances to every pivot, measured by differences: the bounds below must not round past zero."""
    out = np.empty((len(x), len(pivots)))
    for j, p in enumerate(pivots):
        gap = x - p
        out[:, j] = np.sqrt((gap * gap).sum(1))
    return out


def _slices(batches, pivots: int):
    """The batches in slices whose distances to all pivots are at most ``GAP_VALUES`` numbers: there are more pivots where there are more points."""
    step = max(1, GAP_VALUES // max(1, pivots))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def in_chunks(placed: DataFrame, cell: str, sizes: dict[int, int], cols: list[str], vec: str, path: str) -> tuple[DataFrame, list[tuple[int, int]]]:
    """The points with ``_part`` and ``_chunk``, a folder for each chunk, and the cell and chunk of every part.

    ``sizes`` are the bytes of each cell. A chunk holds whole cells up to ``CHUNK_BYTES``; larger cells are cut into parts by a hash of key and vector.
    """
    parts: list[tuple[int, int]] = []
    rows, chunk, filled = [], 0, 0
    for c, size in sorted(sizes.items()):
        own = max(1, -(-size // CHUNK_BYTES))
        first = len(parts)
        for _ in range(own):
            if filled and filled + size // own > CHUNK_BYTES:
                chunk, filled = chunk + 1, 0
            filled += size // own
            parts.append((c, chunk))
        rows.append((c, list(range(first, len(parts))), [k for _, k in parts[first:]]))
    spark = placed.sparkSession
    where = spark.createDataFrame(rows, f"{cell} int, _parts array<int>, _chunks array<int>")  # a row for each cell
    at = F.pmod(F.xxhash64(cols[0], vec), F.size("_parts")).cast("int")
    dealt = placed.join(F.broadcast(where), cell).withColumn("_at", at).select(*cols, vec, F.get("_parts", F.col("_at")).alias("_part"), F.get("_chunks", F.col("_at")).alias("_chunk"))
    dealt.repartition("_chunk").write.partitionBy("_chunk").parquet(path)
    return spark.read.schema(dealt.schema).parquet(path), parts


class _Best:
    """The k best points of each query of a batch by (distance, order of the key), and where a point is found: among the chunk's or, behind them, those a query had."""

    def __init__(self, k: int, lists: pa.ListArray, keys: pa.Array, key: str) -> None:
        n, had = len(lists), lists.flatten()
        # nulls come last, as they do where a table is sorted by its key
        self.code = np.asarray(pa.compute.rank(pa.concat_arrays([keys, had.field(key)]), "ascending", null_placement="at_end", tiebreaker="dense")).astype(np.int64)
        self.k, self.had, self.own = k, had, len(keys)
        self.far, self.order, self.at = np.full((n, k), np.inf), np.full((n, k), np.iinfo(np.int64).max), np.full((n, k), -1)
        size = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(n), size)
        place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        self.far[row, place] = had.field("distance").to_numpy(zero_copy_only=False)
        self.order[row, place] = self.code[self.own :]
        self.at[row, place] = self.own + np.arange(len(row))
        self.changed = False

    def add(self, rows: np.ndarray, at: np.ndarray, far: np.ndarray) -> None:
        order = self.code[at]
        last, last_order = self.far[rows, -1], self.order[rows, -1]
        better = (far < last) | ((far == last) & (order < last_order))
        if not better.any():
            return
        self.changed = True
        own, row = np.unique(rows[better], return_inverse=True)
        row = np.concatenate([np.repeat(np.arange(len(own)), self.k), row])
        columns = [np.concatenate([a[own].ravel(), b[better]]) for a, b in ((self.far, far), (self.order, order), (self.at, at))]
        sort = np.lexsort((columns[1], columns[0], row))
        row = row[sort]
        kept_ = sort[np.arange(len(row)) - np.searchsorted(row, row) < self.k]
        for table, column in zip((self.far, self.order, self.at), columns):
            table[own] = column[kept_].reshape(-1, self.k)

    def lists(self, chunk: pa.Table, cols: list[str], kind: pa.ListType) -> pa.Array:
        found = self.at >= 0
        at = self.at[found]
        new = at < self.own
        back = np.empty(len(at), dtype=np.int64)
        back[np.concatenate([np.flatnonzero(new), np.flatnonzero(~new)])] = np.arange(len(at))
        fields = {f.name: f.type for f in kind.value_type}

        def column(c: str) -> pa.Array:
            both = [chunk[c].combine_chunks().take(pa.array(at[new])), self.had.field(c).take(pa.array(at[~new] - self.own))]
            return pa.concat_arrays([x.cast(fields[c]) for x in both]).take(pa.array(back))

        values = pa.StructArray.from_arrays([*map(column, cols), pa.array(self.far[found])], fields=list(kind.value_type))
        offsets = np.concatenate([[0], np.cumsum(found.sum(1))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), values).cast(kind)


def _search_part(best: _Best, q: np.ndarray, norms: np.ndarray, rows: np.ndarray, points: np.ndarray, turned: np.ndarray, start: int, end: int, block_rows: int) -> None:
    """Hold the queries ``rows`` against the points from ``start`` to ``end``; ``turned`` are the points as columns, their squared norms below."""
    for a in range(start, end, block_rows):
        block = turned[:, a : min(end, a + block_rows)]
        n, most = block.shape[1], np.fmax.reduce(block[-1])
        step = max(1, TILE_VALUES // n)
        for i in range(0, len(rows), step):
            r = rows[i : i + step]
            x = q[r]
            rough = x[:, :-1] @ block[:-1] + block[-1]  # the squared distance less the query's square
            slack = 1e-9 * (norms[r] + most)
            limit = best.far[r, -1] ** 2 - norms[r] + slack
            near = rough <= limit[:, None]
            hits = np.count_nonzero(near)
            if hits > 4 * best.k * len(r) and n > best.k:
                near = rough <= np.minimum(limit, np.partition(rough, best.k - 1, axis=1)[:, best.k - 1] + slack)[:, None]
            elif not hits:
                continue
            row, at = np.nonzero(near)
            far = np.empty(len(row))
            few = max(1, GAP_VALUES // max(1, points.shape[1]))
            for j in range(0, len(row), few):
                part = slice(j, j + few)
                gap = x[row[part], :-1] / -2.0 - points[a + at[part]]
                far[part] = np.sqrt((gap * gap).sum(1))
            best.add(r[row], a + at, far)


def sweep(state: DataFrame, chunk: pa.Table, k: int, vec: str, cols: list[str], lower: Callable, block_rows: int) -> tuple[DataFrame, object]:
    """``state`` with ``_best`` bettered by the points of a chunk, and the broadcast to drop when it is written.

    ``lower(batch, q, parts)`` gives a lower bound of the distance for each query and part of the chunk, NaN for a part that is not to be searched.
    """
    key = cols[0]
    shared = state.sparkSession.sparkContext.broadcast(chunk.sort_by([("_part", "ascending"), (key, "ascending")]))
    arrow = to_arrow_schema(state.schema)
    place = state.columns.index("_best")

    def run(batches):
        held = shared.value
        points = _matrix(held[vec])
        turned = np.vstack([points.T, (points * points).sum(1)]) if len(points) else np.zeros((1, 0))
        keys = held[key].combine_chunks()
        parts, starts = np.unique(held["_part"].to_numpy(), return_index=True)
        ends = [*starts[1:], len(points)]
        for batch in _slices(batches, len(parts)):
            if not batch.num_rows or not len(points):
                yield batch
                continue
            q = _matrix(batch[vec])
            norms = (q * q).sum(1)
            low = lower(batch, q, parts)
            if np.isnan(low).all():
                yield batch
                continue
            q = np.hstack([-2.0 * q, np.ones((len(q), 1))])
            best = _Best(k, batch["_best"], keys.cast(batch["_best"].type.value_type.field(key).type), key)
            for j in range(len(parts)):
                rows = np.flatnonzero(low[:, j] <= best.far[:, -1] * (1 + 1e-9) + 1e-9)
                if len(rows):
                    _search_part(best, q, norms, rows, points, turned, starts[j], ends[j], block_rows)
            if best.changed:
                columns = list(batch.columns)
                columns[place] = best.lists(held, cols, arrow.field(place).type)
                batch = pa.RecordBatch.from_arrays(columns, schema=arrow)
            yield batch

    return state.mapInArrow(run, state.schema), shared


def no_best(points: DataFrame, cols: list[str]) -> Column:
    """The empty list a query begins with."""
    fields = [StructField(c, points.schema[c].dataType) for c in cols] + [StructField("distance", DoubleType())]
    return F.array().cast(ArrayType(StructType(fields)))


def passes(state: DataFrame, chunked: DataFrame, chunks: list[int], k: int, vec: str, query_key: list[str], cols: list[str], lower: Callable, block_rows: int, folder: str) -> DataFrame:
    """(query key.., point columns, distance) of the k best of each query, after all ``chunks``; the states between are removed."""
    spark = state.sparkSession
    files = max(1, math.ceil(state.count() / (4 * spark.sparkContext.defaultParallelism)))
    for i, c in enumerate(chunks):
        after, shared = sweep(state, chunk_of(chunked, c), k, vec, cols, lower, block_rows)
        if i == len(chunks) - 1:
            state = kept(after.select(*query_key, "_best"), "nearest")
        else:
            state = stored(after, f"{folder}/pass-{i}", files)
        shared.destroy()
        if i:
            removed(spark, f"{folder}/pass-{i - 1}")
    return state.select(*query_key, F.inline("_best"))


def chunk_of(chunked: DataFrame, chunk: int) -> pa.Table:
    return chunked.where(F.col("_chunk") == chunk).drop("_chunk").toArrow()


def _cell_search(queries, points, k, vec, query_key, point_key, cols, schema, block_rows, pivots) -> DataFrame:
    spark = queries.sparkSession
    with scratch_folder(spark, "cells") as folder, short_shuffles(spark):
        points = stored(points, f"{folder}/points")
        sound = ~F.exists(vec, lambda x: x.isNull() | F.isnan(x))
        top = points.where(sound).withColumn("_h", hash_order([point_key], 0)).orderBy("_h", point_key).limit(pivots).select(vec)
        pivot = _matrix(top.toArrow()[vec])
        if not len(pivot):  # no point has a distance to anything
            return spark.createDataFrame([], schema)
        centres = spark.sparkContext.broadcast(pivot)

        def placer(arrow: pa.Schema, extra: Callable):
            def place(batches):
                for batch in _slices(batches, len(centres.value)):
                    if batch.num_rows:
                        far = _to_pivots(_matrix(batch[vec]), centres.value)
                        yield pa.RecordBatch.from_arrays([*batch.columns, *extra(far, far.argmin(1))], schema=arrow)

            return place

        placed_schema = StructType(points.schema.fields + [StructField("_cell", IntegerType()), StructField("_far", DoubleType())])
        place = placer(to_arrow_schema(placed_schema), lambda far, cell: [pa.array(cell, pa.int32()), pa.array(far[np.arange(len(cell)), cell])])
        placed = stored(points.mapInArrow(place, placed_schema), f"{folder}/placed")
        removed(spark, f"{folder}/points")
        far = F.when(~F.isnan("_far"), F.col("_far"))
        stats = placed.groupBy("_cell").agg(F.sum(_width(vec, cols)).alias("bytes"), F.max(far).alias("radius"), F.min(far).alias("inner"))
        cells = {r["_cell"]: r for r in stats.collect()}  # at most one row per pivot
        chunked, parts = in_chunks(placed, "_cell", {c: r["bytes"] for c, r in cells.items()}, cols, vec, f"{folder}/chunks")
        removed(spark, f"{folder}/placed")
        known = np.array([c for c, _ in parts])
        radius, inner = (np.array([np.nan if cells[c][name] is None else cells[c][name] for c, _ in parts]) for name in ("radius", "inner"))
        part_chunk = np.array([c for _, c in parts], dtype=np.int32)

        # the first part of the cell a query lies in, or of the nearest one that has points
        filled, firsts = np.unique(known, return_index=True)

        def home(far, _):
            own = firsts[far[:, filled].argmin(1)]
            return [pa.array(own, pa.int32()), pa.array(part_chunk[own])]

        asked_schema = StructType(queries.schema.fields + [StructField("_home", IntegerType()), StructField("_first", IntegerType())])
        asked = queries.mapInArrow(placer(to_arrow_schema(asked_schema), home), asked_schema).withColumn("_best", no_best(points, cols))
        asked.repartition(4 * spark.sparkContext.defaultParallelism).write.partitionBy("_first").parquet(f"{folder}/asked")
        started = spark.read.schema(asked.schema).parquet(f"{folder}/asked")

        def only_home(batch, q, own):
            return np.where(np.asarray(batch["_home"])[:, None] == own, 0.0, np.nan)

        def others(batch, q, own):
            far = _to_pivots(q, centres.value[known[own]])
            low = np.maximum(far - radius[own], np.maximum(inner[own] - far, 0.0))
            low[np.asarray(batch["_home"])[:, None] == own] = np.nan
            return low

        chunks = sorted(set(part_chunk.tolist()))
        near = started.drop("_first")
        for c in chunks:
            first, shared = sweep(started.where(F.col("_first") == c).drop("_first"), chunk_of(chunked, c), k, vec, cols, only_home, block_rows)
            first.write.mode("append").parquet(f"{folder}/first")
            shared.destroy()
        removed(spark, f"{folder}/asked")
        near = spark.read.schema(near.schema).parquet(f"{folder}/first")
        found = passes(near, chunked, chunks, k, vec, query_key, cols, others, block_rows, folder)
        centres.destroy()
        return found


def knn_classify(
    queries: DataFrame,
    points: DataFrame,
    k: int,
    vec: str,
    query_key: list[str],
    point_key: str,
    label: str,
    out: str = "prediction",
    **options,
) -> DataFrame:
    """Majority label of the k nearest points, the lowest label on ties."""
    found = knn_join(queries, points, k, vec, query_key, point_key, [label], **options)
    return top_votes(found.select(*query_key, label), query_key, label).select(*query_key, F.col(label).alias(out))


def knn_out_of_fold(
    df: DataFrame, k: int, vec: str, key: str, label: str, folds: list[int], fold: str = "fold", **options
) -> DataFrame:
    """Each fold's rows classified by the rows of the other folds."""
    checkpoint_dir(df.sparkSession)
    df = df.select(key, label, vec, fold).checkpoint()  # read several times for every fold
    points = df.select(F.col(key).alias("_point"), F.col(label).alias("_label"), vec, fold)
    parts = []
    for f in folds:
        train = points.where(F.col(fold).isNull() | (F.col(fold) != f)).drop(fold)
        voted = knn_classify(df.where(F.col(fold) == f), train, k, vec, [key], "_point", "_label", **options)
        parts.append(voted.withColumn(fold, F.lit(f)))
    return reduce(DataFrame.unionByName, parts)

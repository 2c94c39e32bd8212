"""Embedding whitening: leading components of the covariance by FEAST contour integration.

Components are found by intervals of the spectrum. Inertia counts (signs of the pivots of a symmetric factorisation of the
shifted covariance) say how many eigenvalues lie below a shift, so bisection cuts the wanted part of the spectrum into intervals with
few eigenvalues each. For an interval, a contour around it is integrated by quadrature of complex shifted solves; that projects random
vectors onto the interval's eigenvectors. Rayleigh-Ritz extracts the components, and their number must equal the inertia count, so that none is missed.

The vectors stay in Spark: their sums, their covariance, the whitened rows and the check of these are passes over the table.
Only matrices of dimension x dimension leave it, and the intervals are solved by tasks of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from stratafold.llm.shared import staged

SCALE = 1024  # entries are whole numbers floor(SCALE * c), and 100,000 more where they are shown
MAX_DIMENSION = 4_096  # of a vector: bounds the matrices that leave Spark (128 MB)
_LARGEST = float(1 << 50)  # a scaled entry beyond this is not held exactly, and counts as not finite
_DECIMAL_END = 10**38
_NODES = 12  # quadrature nodes on the upper half of a contour
_PER_INTERVAL = 6  # eigenvalues in an interval, unless they cannot be told apart


def inertia(matrix: np.ndarray, shift: float) -> tuple[int, int]:
    """How many eigenvalues of a symmetric matrix lie below ``shift``, and how many at it.

    Pivots of 1 x 1 and 2 x 2 are chosen over the whole remaining matrix (Bunch and Parlett), which bounds the growth of
    its entries; by Sylvester's law the signs of the pivots are those of the shifted eigenvalues.
    """
    rest = np.array(matrix, dtype=np.float64) - shift * np.eye(len(matrix))
    below = 0
    while len(rest):
        size = np.abs(rest)
        diagonal = size.diagonal()
        r = int(diagonal.argmax())
        p, q = divmod(int(size.argmax()), len(rest))
        if size[p, q] == 0.0:
            return below, len(rest)
        if diagonal[r] >= 0.64 * size[p, q]:
            pivots = [r]
            below += bool(rest[r, r] < 0)
        else:
            pivots = [p, q]
            below += 1  # a 2 x 2 pivot has one eigenvalue of either sign
        others = np.setdiff1d(np.arange(len(rest)), pivots)
        side = rest[np.ix_(others, pivots)]
        rest = rest[np.ix_(others, others)] - side @ np.linalg.solve(rest[np.ix_(pivots, pivots)], side.T)
        rest = (rest + rest.T) / 2
    return below, 0


def spectrum_intervals(matrix: np.ndarray, components: int, most: int = _PER_INTERVAL) -> list[tuple[float, float, int]]:
    """Intervals (from, to, eigenvalues inside) that hold the ``components`` largest eigenvalues, highest first.

    Eigenvalues that are rounding beside the largest (those of directions without variance) are left out.
    """
    size = len(matrix)
    top = float(np.abs(matrix).sum(axis=1).max(initial=0.0))  # no eigenvalue is beyond it
    if top == 0.0:
        return []
    top *= 1 + 1e-9
    floor = top * size * 1e-13
    closest = top * 1e-12

    def below(shift: float) -> int:
        return sum(inertia(matrix, shift))

    found: list[tuple[float, float, int]] = []
    taken, waiting = 0, [(floor, top, below(floor), size)]
    while waiting and taken < components:
        low, high, under_low, under_high = waiting.pop()
        inside = under_high - under_low
        if inside == 0:
            continue
        if inside <= most or high - low <= closest:
            found.append((*_into_gaps(below, low, high), inside))
            taken += inside
            continue
        middle = (low + high) / 2 if low > high / 16 else (low * high) ** 0.5  # spectra fall fast
        under = below(middle)
        waiting += [(low, middle, under_low, under), (middle, high, under, under_high)]
    return found


def _into_gaps(below, low: float, high: float, steps: int = 12) -> tuple[float, float]:
    """The interval with its ends moved towards the eigenvalues inside, half of the gap, so that none lies close to the contour."""
    under_low, under_high = below(low), below(high)
    first, beyond = low, high
    for _ in range(steps):
        middle = (first + beyond) / 2
        first, beyond = (middle, beyond) if below(middle) == under_low else (first, middle)
    last, before = high, low
    for _ in range(steps):
        middle = (last + before) / 2
        last, before = (middle, before) if below(middle) == under_high else (last, middle)
    return (low + first) / 2, (high + last) / 2


def feast(matrix: np.ndarray, low: float, high: float, inside: int, nodes: int = _NODES, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """The ``inside`` eigenvalues in [low, high], falling, and their unit eigenvectors as rows."""
    size = len(matrix)
    wide = min(size, 2 * inside + 4)
    scale = float(np.abs(matrix).sum(axis=1).max())
    center, radius = (low + high) / 2, (high - low) / 2 + scale * 1e-15
    x, weights = np.polynomial.legendre.leggauss(nodes)
    turn = np.exp(1j * np.pi * (x + 1) / 2)  # the upper half; the lower half is its mirror image
    block = np.random.default_rng(size * 31 + inside).standard_normal((size, wide))
    eye = np.eye(size)
    values, vectors = np.zeros(0), np.zeros((0, size))
    for _ in range(rounds):
        projected = np.zeros_like(block)
        for t, w in zip(turn, weights):
            solved = np.linalg.solve((center + radius * t) * eye - matrix, block)
            projected += (w / 2) * (radius * t * solved).real
        basis, strength, _ = np.linalg.svd(projected, full_matrices=False)
        basis = basis[:, strength > strength[0] * 1e-14] if strength[0] > 0 else basis
        ritz, rotation = np.linalg.eigh(basis.T @ matrix @ basis)
        found = basis @ rotation
        near = np.abs(ritz - center) <= radius
        values, vectors = ritz[near][::-1], found[:, near].T[::-1]
        if len(values) == inside:
            rest = np.linalg.norm(vectors @ matrix - values[:, None] * vectors, axis=1).max()
            if rest <= scale * 2e-14 * size:
                return values, vectors
        block = found if found.shape[1] == wide else np.hstack([found, np.random.default_rng(1).standard_normal((size, wide - found.shape[1]))])
    if len(values) != inside:
        raise ArithmeticError(f"{inside} eigenvalues lie in [{low}, {high}], {len(values)} were found")
    return values, vectors


def whole_numbers(column: str) -> Column:
    """floor(SCALE * c) of each entry as long, or null for a vector that is null or holds an entry that is null, not finite or too large."""
    scaled = F.transform(F.col(column), lambda c: F.floor(c.cast("double") * SCALE))
    bad = F.exists(F.col(column), lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double") * SCALE) >= _LARGEST))
    # floor of a value that a long cannot hold would stop the query, so that the test comes first
    return F.when(F.col(column).isNotNull() & ~bad, scaled)


def _int_sums(rows: np.ndarray) -> np.ndarray:
    """The sum of each column of whole numbers, exact."""
    most = int(np.abs(rows).max(initial=0))
    return rows.sum(axis=0) if most * max(len(rows), 1) < 1 << 62 else rows.astype(object).sum(axis=0)


def _int_products(rows: np.ndarray) -> np.ndarray:
    """rows.T @ rows of whole numbers, exact: in doubles while no sum can pass 2^53, else in Python's."""
    most = int(np.abs(rows).max(initial=0))
    if most * most * max(len(rows), 1) < 1 << 53:
        floats = rows.astype(np.float64)
        return (floats.T @ floats).astype(np.int64)
    exact = rows.astype(object)
    return exact.T @ exact


def _matrix(batch: pa.RecordBatch, name: str, kind) -> np.ndarray:
    column = batch.column(name)
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(batch.num_rows, -1)


def _summed(vectors: DataFrame, name: str, of) -> dict[int, list[int]]:
    """Sums over all vectors of what ``of`` gives for a batch: rows (key, whole numbers), added exactly.

    A task adds up its batches and sends one row for each key. The sums of tasks meet by (key, position) in decimals.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                mine = of(_matrix(batch, name, np.int64)).astype(object)
                total = mine if total is None else total + mine
        if total is not None:
            texts = [[str(v) for v in row] for row in np.atleast_2d(total).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int32()), pa.array(texts, pa.list_(pa.string()))], names=["key", "sums"])

    partials = vectors.select(name).mapInArrow(partial, "key int, sums array<string>")
    parts = partials.select("key", F.posexplode("sums").alias("at", "part"))
    added = parts.groupBy("key", "at").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).toArrow()
    out: dict[int, list[int]] = {}
    for row in sorted(added.to_pylist(), key=lambda r: (r["key"], r["at"])):
        out.setdefault(row["key"], []).append(int(row["total"]))
    return out


def covariance(vectors: DataFrame, name: str, n: int, sums: list[int]) -> np.ndarray:
    """Covariance of whole-number vectors, divisor n, centred before multiplying.

    Each vector is centred on the mean rounded to whole numbers, so that products stay small and their sums exact; the rest of
    the mean, at most a half, is taken out of the exact sums. Every entry is rounded once.
    """
    middle = np.array([(2 * s + n) // (2 * n) for s in sums], dtype=np.int64)
    found = _summed(vectors, name, lambda rows: _int_products(rows - middle))
    rest = [s - n * int(m) for s, m in zip(sums, middle)]
    size = len(sums)
    return np.array([[(n * found[i][j] - rest[i] * rest[j]) / (n * n) for j in range(size)] for i in range(size)])


def leading_components(df: DataFrame, matrix: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit eigenvectors as rows. Each interval of the spectrum is a task."""
    intervals = spectrum_intervals(matrix, components)
    if not intervals:
        return np.zeros(0), np.zeros((0, len(matrix)))
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(matrix)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                values, vectors = feast(shared.value, row["low"], row["high"], row["inside"])
                yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(vectors.tolist(), pa.list_(pa.float64()))], names=["value", "vector"])

    tasks = spark.createDataFrame(intervals, "low double, high double, inside int").repartition(len(intervals))
    found = sorted(tasks.mapInArrow(solve, "value double, vector array<double>").toArrow().to_pylist(), key=lambda r: -r["value"])[:components]
    return np.array([r["value"] for r in found]), np.array([r["vector"] for r in found])


def whiten(embeddings: DataFrame, components: int = 8, vector: str = "embedding") -> DataFrame:
    """Whitened coordinates of every usable vector: its columns, then ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    Entries become whole numbers x = floor(1024 * c) + 100,000, c as double. A row goes whose vector is null, empty, or holds an
    entry that is null, not finite or at least 2^40 in size (which a long product of 1,024 no longer holds exactly beside
    others). All other rows are fitted and whitened, repeated ones as often as they stand there; if vectors differ in length,
    the most frequent length counts (of equally frequent ones the longest) and others go.

    One row for each vector and component, numbered from 1 by falling eigenvalue e of the covariance V (divisor n):
    ``whitened`` is (x - S/n) projected on the unit eigenvector, over sqrt(e), S the sums of all x; ``explained`` is e / trace(V);
    ``deviation`` is the exact sum of (n*x - S)^2 as decimal(38,0), null from 10^38 on; ``identity_error`` is the largest absolute entry of the covariance of
    ``whitened`` minus the identity, measured over all rows. Directions without variance are no components: equal vectors,
    a single one, or an empty table give no rows. Equal eigenvalues have some orthonormal basis of theirs. Columns of
    these names that the input has are replaced, others stay.
    """
    made = ["component", "n", "deviation", "whitened", "explained", "identity_error"]
    kept = [c for c in embeddings.columns if c not in made]
    usable = embeddings.select(F.struct(*kept).alias("row"), whole_numbers(vector).alias("x")).where(F.size("x") > 0)
    lengths = usable.groupBy(F.size("x").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    empty = embeddings.select(*kept).limit(0).withColumns(dict(zip(made, map(F.lit, (0, 0, Decimal(0), 0.0, 0.0, 0.0)))))
    empty = empty.withColumns({"component": F.col("component").cast("int"), "n": F.col("n").cast("long"), "deviation": F.col("deviation").cast("decimal(38,0)")})
    if lengths is None:
        return empty
    if lengths["length"] > MAX_DIMENSION:
        raise ValueError(f"vectors of {lengths['length']} entries; the covariance is bounded at {MAX_DIMENSION}")
    usable = usable.where(F.size("x") == lengths["length"])
    n = lengths["count"]
    # 100,000 more moves all x and their mean alike, so that everything below is taken without it
    sums = _summed(usable, "x", _int_sums)[0]
    matrix = covariance(usable, "x", n, sums)
    values, axes = leading_components(embeddings, matrix, components)
    if not len(values):
        return empty
    whitener = embeddings.sparkSession.sparkContext.broadcast((n, sums, axes / np.sqrt(values)[:, None]))

    @F.arrow_udf("struct<whitened:array<double>,deviation:decimal(38,0)>")
    def project(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        n, sums, axes = whitener.value
        middle = np.array([(2 * s + n) // (2 * n) for s in sums], dtype=np.int64)
        rest = [s - n * int(m) for s, m in zip(sums, middle)]
        offset = np.array([r / n for r in rest])
        rest_squared = sum(r * r for r in rest)
        for batch in batches:
            near = batch.flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1) - middle  # of the mean, exact
            coordinates = (near - offset) @ axes.T
            large = int(np.abs(near).max(initial=0))
            exact = near if large * large * len(sums) < 1 << 62 and large * max(map(abs, rest)) * len(sums) < 1 << 62 else near.astype(object)
            squares, cross = (exact * exact).sum(axis=1).tolist(), (exact * np.array(rest, dtype=exact.dtype)).sum(axis=1).tolist()
            deviation = [n * n * s - 2 * n * c + rest_squared for s, c in zip(squares, cross)]
            decimals = pa.array([Decimal(d) if d < _DECIMAL_END else None for d in deviation], pa.decimal128(38, 0))
            yield pa.StructArray.from_arrays([pa.array(coordinates.tolist(), pa.list_(pa.float64())), decimals], names=["whitened", "deviation"])

    projected = usable.select("row", project("x").alias("p"))
    table = staged(projected.select("row", F.col("p.whitened").alias("whitened"), F.col("p.deviation").alias("deviation")), "whitened")
    error = _identity_error(table, n, len(values))
    shares = values / np.trace(matrix)
    rows = table.select("row", "deviation", F.posexplode("whitened").alias("at", "coordinate"))
    share = F.element_at(F.array(*[F.lit(float(s)) for s in shares]), F.col("at") + 1)
    return rows.select(
        *[F.col("row").getField(c).alias(c) for c in kept],
        (F.col("at") + 1).alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        F.col("coordinate").alias("whitened"),
        share.alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def _identity_error(table: DataFrame, n: int, components: int) -> float:
    """Largest absolute entry of the measured covariance of the whitened rows minus the identity; two passes, so that rows are centred before multiplying."""
    means = table.agg(*[F.avg(F.col("whitened")[i]).alias(f"m{i}") for i in range(components)]).first()
    centred = table.select(*[(F.col("whitened")[i] - F.lit(means[i])).alias(f"c{i}") for i in range(components)])
    pairs = [(i, j) for i in range(components) for j in range(i, components)]
    found = centred.agg(*[F.sum(F.col(f"c{i}") * F.col(f"c{j}")).alias(f"p{i}_{j}") for i, j in pairs]).first()
    return max(abs(v / n - (i == j)) for (i, j), v in zip(pairs, found))

"""Ragged numpy arrays: many short runs of values in one flat array, and a memo of such runs by key."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterator, Sequence
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401


def runs(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The positions begin[0], begin[0] + 1, ... (count[0] of them), begin[1], ... of all runs, one after the other."""
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(begin - (ends - count), count) + np.arange(total)


def offsets(count: np.ndarray) -> np.ndarray:
    """Where each run begins in the flat array, and where the last one ends."""
    out = np.zeros(len(count) + 1, dtype=np.int64)
    np.cumsum(count, out=out[1:])
    return out


def groups_of(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Neighbouring items (from, to) whose sizes add up to ``most`` at most; a larger item stands alone."""
    start = 0
    while start < len(sizes):
        end, size = start, 0
        while end < len(sizes) and (end == start or size + sizes[end] <= most):
            size += sizes[end]
            end += 1
        yield start, end
        start = end


def text_slices(batches: Iterator[pa.Array], most: int = 1_000_000) -> Iterator[pa.Array]:
    """The batches of texts in parts of a bounded number of bytes, so that only one part's values are held as Python objects."""
    for batch in batches:
        for start, end in groups_of(pa.compute.binary_length(batch).fill_null(0).to_pylist(), most):
            yield batch.slice(start, end - start)


def flattened(found: list[Sequence[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The runs one after the other, and the length of each."""
    count = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    return np.fromiter(chain.from_iterable(found), dtype=np.int32, count=int(count.sum())), count


class RaggedMemo:
    """Runs of ids by key, learned once and gathered for a whole batch of keys at a time.

    ``learn`` gives the runs of a list of unseen keys, flat, and their lengths. Keys longer than ``longest`` are forgotten after the
    batch, and the memo starts again beyond ``most`` keys or eight times as many ids, which bounds a worker's memory.
    """

    def __init__(self, learn: Callable[[list], tuple[np.ndarray, np.ndarray]], longest: int = 64, most: int = 600_000) -> None:
        self.learn, self.longest, self.most = learn, longest, most
        self.fixed: dict[Hashable, Sequence[int]] = {}
        self._clear()

    def _clear(self) -> None:
        self.place: dict[Hashable, int] = {}
        self.flat, self.begin, self.count = (np.zeros(1 << 12, dtype=np.int32), np.zeros(1 << 10, dtype=np.int64), np.zeros(1 << 10, dtype=np.int64))
        self.used = 0
        self._add(list(self.fixed), *flattened(list(self.fixed.values())))

    def fix(self, key: Hashable, run: Sequence[int]) -> None:
        """A key whose run is given and never forgotten."""
        self.fixed[key] = run
        self._clear()

    def _add(self, keys: list, ids: np.ndarray, count: np.ndarray) -> None:
        n, k = len(self.place), len(keys)
        self.flat = _room(self.flat, self.used + len(ids))
        self.begin, self.count = _room(self.begin, n + k), _room(self.count, n + k)
        self.flat[self.used : self.used + len(ids)] = ids
        self.begin[n : n + k] = self.used + np.cumsum(count) - count
        self.count[n : n + k] = count
        self.used += len(ids)
        self.place.update(zip(keys, range(n, n + k), strict=True))

    def gather(self, keys: list) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all keys, one run after the other, and the length of each run."""
        if len(self.place) > self.most or self.used > 8 * self.most:
            self._clear()
        at = np.fromiter(map(self.place.get, keys, repeat(-1)), dtype=np.int64, count=len(keys))
        gaps = np.flatnonzero(at < 0)
        kept, long = self.used, []
        if len(gaps):
            missing = [keys[i] for i in gaps.tolist()]
            unseen = set(missing)
            long = [k for k in unseen if len(k) > self.longest]
            short = list(unseen.difference(long)) if long else list(unseen)
            if short:
                self._add(short, *self.learn(short))
            kept = self.used
            if long:
                self._add(long, *self.learn(long))
            at[gaps] = np.fromiter(map(self.place.__getitem__, missing), dtype=np.int64, count=len(missing))
        count = self.count[at]
        ids = self.flat[runs(self.begin[at], count)]
        for k in long:  # they were added last
            del self.place[k]
        self.used = kept
        if len(self.flat) > 16 * self.most + (1 << 21):  # room that long keys have taken
            self.flat = self.flat[: max(kept, 1 << 12)].copy()
        return ids, count


def _room(array: np.ndarray, n: int) -> np.ndarray:
    if n <= len(array):
        return array
    grown = np.zeros(max(n, 2 * len(array)), dtype=array.dtype)
    grown[: len(array)] = array
    return grown

"""Benchmark decontamination by pigeonhole edit matching.

A passage within e edits of a benchmark item contains at least one of any e + 1 pieces of the item unchanged. So
each item is split into one piece more than its error budget, an automaton finds all exact hits of all pieces
in the whole texts, and around the hits Myers' bit-parallel distance says whether the item is there.
"""

from __future__ import annotations

import functools
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from stratafold.llm.shared import staged, text_of, unused_names

ERROR_SHARE = 0.07  # edits for each character of an item
MIN_CHARS = 20  # of an item; shorter ones count only as they are, and as whole words
_BLOCK_CHARS = 16_000_000  # of the items that are searched, and broadcast, together


def normal(text: str) -> str:
    """Lower case, every run of white space one space."""
    return " ".join(text.lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """The item cut into ``budget + 1`` pieces of nearly equal length, with their offsets."""
    cuts = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def best_match(item: str, window: str, budget: int) -> tuple[int, int] | None:
    """Smallest edit distance of the item to any part of the window, and the end of the first such part.

    Bit i of the vectors stands for the item's first i + 1 characters: whether the distance grows (``up``) or
    falls (``down``) by one from one row of the alignment table to the next. None if it is above the budget.
    """
    exact = window.find(item)
    if exact >= 0:
        return 0, exact + len(item)
    at: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        at[c] |= 1 << i
    every, top = (1 << len(item)) - 1, 1 << (len(item) - 1)
    up, down, distance = every, 0, len(item)
    best = None
    for end, c in enumerate(window, 1):
        same = at.get(c, 0)
        diagonal = ((((same & up) + up) ^ up) | same | down) & every
        rise, fall = down | (every & ~(diagonal | up)), up & diagonal
        distance += 1 if rise & top else -1 if fall & top else 0
        rise, fall = (rise << 1) & every, (fall << 1) & every  # a match may begin anywhere: row 0 stays 0
        vertical = same | down
        up, down = fall | (every & ~(vertical | rise)), rise & vertical
        if distance <= budget and (best is None or distance < best[0]):
            best = distance, end
    return best


class PieceIndex:
    """Automaton over the pieces of a block of items; items under ``min_chars`` characters have no error budget, and must stand between word borders."""

    def __init__(self, items: list[str], error_share: float, min_chars: int = MIN_CHARS) -> None:
        self.items = items
        self.short = [len(i) < min_chars for i in items]
        self.budget = [0 if short else int(len(i) * error_share) for i, short in zip(items, self.short, strict=True)]
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for number, item in enumerate(items):
            for offset, piece in pieces(item, self.budget[number]):
                places[piece].append((number, offset + len(piece) - 1))
        self.automaton = ahocorasick.Automaton()
        for piece, own in places.items():
            self.automaton.add_word(piece, own)
        if places:
            self.automaton.make_automaton()

    def matches(self, text: str) -> list[tuple[int, int, int]]:
        """(item, distance, end in the normalised text) of each item that is in the text, its best place."""
        if not self.items:
            return []
        starts: dict[int, list[int]] = defaultdict(list)
        for end, own in self.automaton.iter(text):
            for number, offset in own:
                starts[number].append(end - offset)
        found = []
        for number, begins in starts.items():
            item, budget, best = self.items[number], self.budget[number], None
            begins.sort()
            if self.short[number]:
                ends = [b + len(item) for b in begins if not (text[b - 1 : b].isalnum() or text[b + len(item) : b + len(item) + 1].isalnum())]
                if ends:
                    found.append((number, 0, ends[0]))
                continue
            first = last = begins[0]
            for begin in [*begins[1:], None]:
                if begin is not None and begin - last <= 2 * budget:  # the windows overlap: one search for both
                    last = begin
                    continue
                low = max(0, first - budget)
                match = best_match(item, text[low : last + len(item) + budget], budget)
                if match and (best is None or match[0] < best[0]):
                    best = match[0], match[1] + low
                    if best[0] == 0:
                        break
                first = last = begin
            if best:
                found.append((number, *best))
        return sorted(found)


@functools.lru_cache(maxsize=1)
def _index(items: tuple[str, ...], error_share: float, min_chars: int) -> PieceIndex:
    """One automaton in a worker process at a time."""
    return PieceIndex(list(items), error_share, min_chars)


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, error_share: float = ERROR_SHARE, min_chars: int = MIN_CHARS, column: str = "matches") -> DataFrame:
    """Add to each document an array of (item_id, distance, end_char), one for each benchmark item its text contains.

    An item is contained if some part of the text is within ``error_share`` edits for each of its characters, after
    both are lower-cased and their white space is made single spaces; ``end_char`` counts in that form. Items under ``min_chars`` characters
    are contained where they stand exactly, with no letter or digit beside them. Whole texts and all items are searched; a null text is an
    empty one, and an item that is null, empty or blank is in no text. Items are searched in blocks of about 16 million characters; with more than one,
    each is a pass of its own over the texts, so that a task holds one automaton, whatever the number of items. Texts are
    not shuffled, so repeated and hot documents cost what any others do. A column of this name is replaced.
    """
    items = benchmark.select("item_id", text_of().alias("text"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // _BLOCK_CHARS))
    id_type = benchmark.schema["item_id"].dataType
    kind = pa.struct([("item_id", to_arrow_type(id_type)), ("distance", pa.int32()), ("end_char", pa.int64())])

    def search(block: int):
        own = [(r.item_id, normal(r.text)) for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()]
        own = sorted({(str(i), t): (i, t) for i, t in own if t}.values(), key=lambda x: (str(x[0]), x[1]))
        sent = docs.sparkSession.sparkContext.broadcast(own)

        @F.arrow_udf(f"array<struct<item_id:{id_type.simpleString()},distance:int,end_char:bigint>>")
        def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            ids, index = [i for i, _ in sent.value], _index(tuple(t for _, t in sent.value), error_share, min_chars)
            for texts in batches:
                rows = [[{"item_id": ids[n], "distance": d, "end_char": e} for n, d, e in index.matches(normal(t))] for t in texts.to_pylist()]
                yield pa.array(rows, pa.list_(kind))

        return found(text_of())

    if blocks == 1:
        return docs.withColumn(column, search(0))
    row, own, kept = *unused_names(docs, "row", "own"), [c for c in docs.columns if c != column]
    rows = staged(docs.withColumn(row, F.monotonically_increasing_id()), "numbered-texts")
    found = None
    for block in range(blocks):
        hits = staged(rows.select(row, search(block).alias(own)).where(F.size(own) > 0), "block-matches")
        found = hits if found is None else found.union(hits)
    matches = found.groupBy(row).agg(F.sort_array(F.flatten(F.collect_list(own))).alias(own))
    none = F.array().cast(matches.schema[own].dataType)
    return rows.join(matches, row, "left").select(*kept, F.coalesce(own, none).alias(column))


def decontaminate(docs: DataFrame, benchmark: DataFrame, error_share: float = ERROR_SHARE, min_chars: int = MIN_CHARS) -> DataFrame:
    """The documents that contain no benchmark item, with their own columns."""
    (column,) = unused_names(docs, "matches")
    return benchmark_matches(docs, benchmark, error_share, min_chars, column).where(F.size(column) == 0).select(*docs.columns)

"""Token counts of whole texts by rank-synchronous merging of pre-tokens.

The pre-tokens of a batch lie in one ragged numpy array. In every round each sequence applies its own
lowest-ranked pair, everywhere in the sequence at once, until no sequence has a known pair; what is left of a
sequence is its number of tokens. Applying all places of a pair at once equals applying them one by one,
because a pair that contains a merged symbol ranks after the merge that makes the symbol.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F

from stratafold.llm.shared import text_of

# Fixed value: how byte-level vocabularies split text before merging.
BYTE_LEVEL_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_NEVER = np.iinfo(np.int64).max
_CACHED_CHARS = 64  # longer pieces are counted anew each time
_CACHE_SIZE = 700_000  # entries of each cache, which then starts again: bounds a worker's memory
_GROUP_CHARS = 2_000_000  # texts looked up together


def byte_symbols() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones stand for themselves."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class RaggedMerger:
    """Counts the symbols left after all merges, for many byte sequences at a time."""

    def __init__(self, vocabulary: dict[str, int], merges: list) -> None:
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.size = max(vocabulary.values()) + 1
        keys = np.array([vocabulary[a] * self.size + vocabulary[b] for a, b in pairs], dtype=np.int64)
        made = np.array([vocabulary[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        # one entry more than any pair of ids, so that a search never leaves the arrays
        self.keys = np.append(keys[order], _NEVER)
        self.rank = np.append(order, _NEVER)
        self.made = np.append(made[order], 0)
        self.first = np.array([vocabulary[c] for c in byte_symbols()], dtype=np.int64)

    def counts(self, pieces: list[bytes]) -> np.ndarray:
        left = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        several = np.flatnonzero(left > 1)
        if len(several):
            ids = self.first[np.frombuffer(b"".join(p for p in pieces if len(p) > 1), dtype=np.uint8)]
            for done, lengths, _ in self.merged(ids, left[several]):
                left[several[done]] = lengths
        return left

    def merged(self, ids: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Sequences without a known pair left: which they are, their lengths, and their ids one after the other. No sequence is empty."""
        alive = np.arange(len(lengths))
        last = np.zeros(len(ids), dtype=bool)
        last[np.cumsum(lengths) - 1] = True
        at, rank = self._look_up(ids, last, np.arange(len(ids)))
        while len(alive):
            best = np.minimum.reduceat(rank, np.cumsum(lengths) - lengths)
            going = best < _NEVER
            if not going.all():
                inside = np.repeat(going, lengths)
                yield alive[~going], lengths[~going], ids[~inside]
                ids, last, at, rank = ids[inside], last[inside], at[inside], rank[inside]
                alive, lengths, best = alive[going], lengths[going], best[going]
                if not len(alive):
                    break
            chosen = rank == np.repeat(best, lengths)
            if (chosen[1:] & chosen[:-1]).any():  # a run of equal symbols: every other pair, from its left
                index = np.arange(len(chosen))
                last_other = np.maximum.accumulate(np.where(chosen, -1, index))
                chosen &= (index - last_other) % 2 == 1
            place = np.flatnonzero(chosen)
            ids[place] = self.made[at[place]]
            last[place] = last[place + 1]
            stays = np.ones(len(ids), dtype=bool)
            stays[place + 1] = False
            lengths = lengths - np.add.reduceat(chosen.astype(np.int64), np.cumsum(lengths) - lengths)
            ids, last, at, rank = ids[stays], last[stays], at[stays], rank[stays]
            place -= np.arange(len(place))  # where the merged symbols lie now; only their pairs have changed
            changed = np.concatenate([place, place[place > 0] - 1])
            at[changed], rank[changed] = self._look_up(ids, last, changed)

    def _look_up(self, ids: np.ndarray, last: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the pairs that begin at these places stand among the merges, and their ranks."""
        pair = ids[places] * self.size + ids[np.minimum(places + 1, len(ids) - 1)]
        pair[last[places]] = -1  # no pair reaches into the next sequence
        at = np.searchsorted(self.keys, pair)
        return at, np.where(self.keys[at] == pair, self.rank[at], _NEVER)


class TokenCounter:
    """Token counts of texts for one byte-level vocabulary file, as its own library gives them."""

    def __init__(self, spec: str) -> None:
        tokenizer = json.loads(spec)
        before = tokenizer.get("pre_tokenizer") or {}
        if tokenizer["model"]["type"] != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or tokenizer.get("normalizer"):
            raise ValueError("only byte-level vocabularies without normaliser and prefix space are supported")
        self.merger = RaggedMerger(tokenizer["model"]["vocab"], tokenizer["model"]["merges"])
        self.split = regex.compile(BYTE_LEVEL_SPLIT)
        special = sorted((t["content"] for t in tokenizer.get("added_tokens", [])), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.two_blanks = re.compile(r"\s\s")
        self.known: dict[str, int] = {}
        self.known_tokens: dict[str, int] = {}

    def _segments(self, text: str) -> tuple[list[str], int]:
        """The text between special tokens, and how many of these there are."""
        if self.special is None or not self.special.search(text):
            return [text], 0
        parts = self.special.split(text)
        return [p for p in parts if p], len(parts) - 1

    def _pieces(self, segment: str) -> list[str]:
        """Pieces that are tokenised independently of each other.

        No pre-token crosses a single blank between two other characters but to begin with it; where blanks
        stand together, the pre-tokens themselves are the pieces.
        """
        if self.two_blanks.search(segment):
            return self.split.findall(segment)
        first, *others = segment.split(" ")
        return [first, *[" " + o for o in others]] if first else [" " + o for o in others]

    def counts(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts), dtype=np.int64)
        start = 0
        while start < len(texts):
            end, chars = start, 0
            while end < len(texts) and (end == start or chars + len(texts[end]) <= _GROUP_CHARS):
                chars += len(texts[end])
                end += 1
            self._count_group(texts, start, end, out)
            start = end
        return out

    def _count_group(self, texts: list[str], start: int, end: int, out: np.ndarray) -> None:
        if len(self.known) > _CACHE_SIZE:
            self.known = {}
        if len(self.known_tokens) > _CACHE_SIZE:
            self.known_tokens = {}
        pieces = []
        for i in range(start, end):
            segments, out[i] = self._segments(texts[i])
            pieces.append([p for s in segments for p in self._pieces(s)] if len(segments) > 1 else self._pieces(segments[0]) if segments else [])
        unseen = list(set().union(*pieces) - self.known.keys())
        split = [[p] if p[1:].isalpha() and (p[0] == " " or p[0].isalpha()) else self.split.findall(p) for p in unseen]
        size = self.known_tokens
        tokens = list({t for own in split for t in own} - size.keys())
        size.update(zip(tokens, self.merger.counts([t.encode() for t in tokens]).tolist(), strict=True))
        fresh = {p: sum(map(size.__getitem__, own)) for p, own in zip(unseen, split, strict=True)}
        for t in tokens:
            if len(t) > _CACHED_CHARS:
                del size[t]
        known = self.known
        known.update(fresh)
        for i, own in enumerate(pieces, start):
            out[i] += sum(map(known.__getitem__, own))
        for p in fresh:
            if len(p) > _CACHED_CHARS:
                del known[p]


def count_tokens(docs: DataFrame, vocabulary_path: str, limit: int = 512) -> DataFrame:
    """Add n_bytes, n_tokens and over_limit (more than ``limit`` tokens) to each document.

    ``vocabulary_path`` names a byte-level vocabulary of the tokenizers library, read on the driver and sent to
    the workers (its size is that of the file). Nothing is truncated and no token is added; strings of special
    tokens inside a text count as these tokens, as the library does by default. A null text is an empty one:
    0 bytes, 0 tokens. Each row is counted by itself, so repeated rows repeat their result and nothing is
    shuffled. Columns of these names that the input has are replaced; others stay.
    """
    with open(vocabulary_path, encoding="utf-8") as file:
        spec = docs.sparkSession.sparkContext.broadcast(file.read())

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = _counter(spec.value)
        for texts in batches:
            yield pd.Series(counter.counts(texts.tolist()))

    counted = docs.withColumns({"n_bytes": F.octet_length(text_of()).cast("long"), "n_tokens": tokens(text_of())})
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


@functools.lru_cache(maxsize=1)
def _counter(spec: str) -> TokenCounter:
    """One counter in a worker process, with what it knows already, for all tasks that run there."""
    return TokenCounter(spec)

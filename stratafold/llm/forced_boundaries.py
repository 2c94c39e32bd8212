"""Byte-level BPE of whole texts, cut at forced boundaries, and back.

Two bytes that stand together inside no token of the vocabulary can never be joined: no merge makes a token that holds
them, so the text may be cut there, each fragment be encoded by itself, and the ids be put one after the other. The
vocabulary splits a text by a pattern before it merges, so a cut must also leave that split as it is:

* not behind white space, whose split depends on what follows;
* not before an apostrophe, but behind a letter or digit of ASCII: at the head of a fragment it could begin a contraction;
* not inside a contraction, and only between whole characters.

Elsewhere the pattern either ends a piece at the cut, or the cut divides a run of one kind in two runs of that kind.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from stratafold.llm.ragged import RaggedMemo, flattened, groups_of, offsets, runs, text_slices
from stratafold.llm.shared import text_of
from stratafold.llm.token_counts import byte_symbols

_GROUP_CHARS = 1_000_000  # texts encoded together
_WHITE = [*range(0x09, 0x0E), *range(0x1C, 0x21)]
_LETTERS_DIGITS = [b for b in range(128) if chr(b).isalnum()]
_CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")  # fixed value: those of the pattern
_OTHER_WHITE = re.compile(r"[^\S\x00-\x7f]")


def token_bytes(tokenizer: dict) -> list[bytes]:
    """The bytes of every id of a byte-level vocabulary; added tokens are their own text."""
    byte_of = {c: b for b, c in enumerate(byte_symbols())}
    added = {t["id"]: t["content"].encode() for t in tokenizer.get("added_tokens", [])}
    vocabulary = tokenizer["model"]["vocab"]
    out = [b""] * (max([*vocabulary.values(), *added]) + 1)
    for token, i in vocabulary.items():
        out[i] = bytes(map(byte_of.__getitem__, token)) if i not in added else added[i]
    for i, text in added.items():
        out[i] = text
    return out


def forced_boundaries(tokens: list[bytes]) -> np.ndarray:
    """forced[a, b]: bytes a and b stand together inside no token."""
    forced = np.ones((256, 256), dtype=bool)
    for token in tokens:
        if len(token) > 1:
            pair = np.frombuffer(token, dtype=np.uint8)
            forced[pair[:-1], pair[1:]] = False
    return forced


class BoundaryEncoder:
    """Ids of whole texts for one byte-level vocabulary file, as its library gives them.

    ``special_as_text`` treats the strings of special tokens like any other text.
    """

    def __init__(self, spec: str, special_as_text: bool = False) -> None:
        tokenizer = json.loads(spec)
        before = tokenizer.get("pre_tokenizer") or {}
        if tokenizer["model"]["type"] != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or tokenizer.get("normalizer"):
            raise ValueError("only byte-level vocabularies without normaliser and prefix space are supported")
        added = tokenizer.get("added_tokens", [])
        if any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens must match their own text alone")
        self.library = Tokenizer.from_str(spec)
        self.library.no_truncation()
        self.library.no_padding()
        self.library.encode_special_tokens = True  # fragments are plain text
        ids_of_added = {t["id"] for t in added}
        self.tokens = token_bytes(tokenizer)
        certain = forced_boundaries([t for i, t in enumerate(self.tokens) if i not in ids_of_added])
        certain[_WHITE, :] = False
        certain[:, ord("'")] &= np.isin(np.arange(256), _LETTERS_DIGITS)
        certain[:, 0x80:0xC0] = False
        for c in _CONTRACTIONS:
            for a, b in zip(c.encode(), c.encode()[1:]):
                certain[a, b] = False
        self.certain = certain.ravel()
        ascii_only = certain.copy()
        ascii_only[0x80:] = False  # a character beyond ASCII may be white space
        self.certain_behind_ascii = ascii_only.ravel()
        self.memo = RaggedMemo(self._encode_fragments)
        self.special = None
        if not special_as_text and added:
            texts = sorted((t["content"].encode() for t in added), key=len, reverse=True)
            self.special = re.compile(b"|".join(map(re.escape, texts)))
            for t in added:
                self.memo.fix(t["content"].encode(), [t["id"]])

    def _encode_fragments(self, fragments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return flattened([e.ids for e in self.library.encode_batch_fast([f.decode() for f in fragments], add_special_tokens=False)])

    def fragments(self, texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
        """The fragments of all texts, and how many each text has."""
        data = b"".join(texts)
        if not data:
            return [], np.zeros(len(texts), dtype=np.int64)
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        at = offsets(sizes)
        array = np.frombuffer(data, dtype=np.uint8)
        table = self.certain_behind_ascii if _OTHER_WHITE.search(data.decode()) else self.certain
        cut = np.zeros(len(data) + 1, dtype=bool)
        cut[1:-1] = table[(array[:-1].astype(np.uint16) << 8) | array[1:]]
        cut[at] = True
        if self.special is not None and self.special.search(data):
            for start, text in zip(at.tolist(), texts):
                for found in self.special.finditer(text):
                    cut[start + found.start() + 1 : start + found.end()] = False
                    cut[[start + found.start(), start + found.end()]] = True
        ends = np.flatnonzero(cut)
        places = ends.tolist()
        return [data[a:b] for a, b in zip(places, places[1:])], np.diff(np.searchsorted(ends, at))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (UTF-8), one after the other, and how many each text has."""
        ids, counts = [], []
        for start, end in groups_of(list(map(len, texts)), _GROUP_CHARS):
            fragments, per_text = self.fragments(texts[start:end])
            found, per_fragment = self.memo.gather(fragments)
            ids.append(found)
            counts.append(np.diff(offsets(per_fragment)[offsets(per_text)]))
        if not ids:
            return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)
        return np.concatenate(ids), np.concatenate(counts)


class TokenBytes:
    """The bytes of token ids, for many sequences at a time; ids that the vocabulary does not have stand for nothing."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.size = np.array([*map(len, tokens), 0], dtype=np.int64)  # the last one is for unknown ids
        self.begin = offsets(self.size)[:-1]
        self.data = np.frombuffer(b"".join(tokens) or b"\0", dtype=np.uint8)

    def sizes(self, ids: np.ndarray) -> np.ndarray:
        return self.size[self._known(ids)]

    def _known(self, ids: np.ndarray) -> np.ndarray:
        last = len(self.size) - 1
        return ids if not len(ids) or (ids.min() >= 0 and ids.max() < last) else np.where((ids < 0) | (ids >= last), last, ids)

    def join(self, ids: np.ndarray) -> bytes:
        ids = self._known(ids)
        return self.data[runs(self.begin[ids], self.size[ids])].tobytes()

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The text of each sequence; bytes that are no UTF-8 become the replacement character."""
        data = self.join(ids)
        at = offsets(self.sizes(ids))[offsets(counts)].tolist()
        return [data[a:b].decode(errors="replace") for a, b in zip(at, at[1:])]


def _vocabulary(df: DataFrame, path: str):
    """The vocabulary file, read on the driver and sent to the workers; its size is that of the file."""
    with open(path, encoding="utf-8") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


@functools.lru_cache(maxsize=2)
def boundary_encoder(spec: str, special_as_text: bool = False) -> BoundaryEncoder:
    """One encoder in a worker process, with the fragments it knows, for all tasks that run there."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    return BoundaryEncoder(spec, special_as_text)


def _id_lists(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets(counts).astype(np.int32)), pa.array(ids))


def encode_texts(docs: DataFrame, vocabulary_path: str, column: str = "text", into: str = "ids") -> DataFrame:
    """Add the token ids of each whole text as an array of int.

    Ids are those of the tokenizers library without added special tokens, truncation and padding; strings of special
    tokens inside a text are these tokens. A null text is an empty one and has an empty array. Each row is encoded by
    itself, so repeated rows repeat their ids and nothing is shuffled; a text of any length is one row. A column
    ``into`` that the input has is replaced; others stay.
    """
    spec = _vocabulary(docs, vocabulary_path)

    @F.arrow_udf("array<int>")
    def ids_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = boundary_encoder(spec.value)
        for texts in text_slices(batches, _GROUP_CHARS):
            yield _id_lists(*encoder.encode(texts.cast(pa.binary()).to_pylist()))

    return docs.withColumn(into, ids_of(text_of(column)))


def decode_ids(df: DataFrame, vocabulary_path: str, column: str = "ids", into: str = "decoded") -> DataFrame:
    """Add the text of each array of ids, special tokens included. A null array has a null text, null or unknown ids stand for nothing."""
    spec = _vocabulary(df, vocabulary_path)

    @F.arrow_udf("string")
    def text_of_ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens = _token_bytes(spec.value)
        for arrays in batches:
            counts = arrays.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            ids = arrays.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
            texts = tokens.decode(ids, counts)
            yield pa.array([t if there else None for t, there in zip(texts, arrays.is_valid().to_pylist())] if arrays.null_count else texts, pa.string())

    return df.withColumn(into, text_of_ids(F.col(column).cast("array<int>")))


def round_trip(docs: DataFrame, vocabulary_path: str, column: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add both the ids of each whole text and the text they decode to, as the two functions above do, in one pass through Python."""
    spec = _vocabulary(docs, vocabulary_path)

    @F.arrow_udf("struct<ids:array<int>,decoded:string>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = boundary_encoder(spec.value)
        tokens = TokenBytes(encoder.tokens)
        for texts in text_slices(batches, _GROUP_CHARS):
            found, counts = encoder.encode(texts.cast(pa.binary()).to_pylist())
            yield pa.StructArray.from_arrays([_id_lists(found, counts), pa.array(tokens.decode(found, counts), pa.string())], names=["ids", "decoded"])

    kept = [c for c in docs.columns if c not in (ids, decoded)]
    made = docs.select(F.struct(*kept).alias("row"), both(text_of(column)).alias("made"))
    return made.select(*[F.col("row").getField(c).alias(c) for c in kept], F.col("made.ids").alias(ids), F.col("made.decoded").alias(decoded))


@functools.lru_cache(maxsize=1)
def _token_bytes(spec: str) -> TokenBytes:
    return TokenBytes(token_bytes(json.loads(spec)))

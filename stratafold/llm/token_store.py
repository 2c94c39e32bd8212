"""Token ids in a binary format: blocks of ids, transposed into planes, each plane compressed.

A table of the format is a folder with two tables. ``blocks`` has fixed-size blocks of ids: the bits (or bytes)
of equal weight of all ids in a block stand together as a plane, and each plane is compressed with zstandard by
itself, so that the high planes, which hardly change, take hardly any room. ``index`` says for every document
where its ids begin and how many there are. Every task writes a shard: its documents' ids without gaps, in blocks
numbered from 0. Both kinds of rows carry the shard, and shards follow each other in ascending doc_id order.
"""

from __future__ import annotations

import functools
import json
import os
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from tokenizers import Tokenizer

from stratafold.llm.ragged import RaggedMemo, flattened, offsets, runs
from stratafold.llm.shared import scratch, text_of
from stratafold.llm.token_counts import RaggedMerger, byte_symbols

BLOCK_IDS = 1 << 16
_NO_BLANKS = "\x1c\x1d\x1e\x1f"  # the only ones that Python splits at and the library does not
_BLANKS = re.compile(r"[ \n\t\r\f\v]+")
_CLOSING = ".,;:!?"
_CACHED_CHARS = 64  # longer words are encoded anew each time
_PIECES, _WORDS = 1_000_000, 300_000  # pre-tokens and words that are kept: bounds a worker's memory
_GROUP_CHARS = 2_000_000  # texts encoded together


def to_planes(ids: np.ndarray, kind: str = "byte", level: int = 1) -> list[bytes]:
    """Compressed planes of a block of uint32 ids, from the lowest up to the highest that is not all zero."""
    compress = zstandard.ZstdCompressor(level=level).compress
    little = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        used = (int(ids.max(initial=0)).bit_length() + 7) // 8
        return [compress(np.ascontiguousarray(little[:, i]).tobytes()) for i in range(used)]
    if kind == "bit":
        used = int(ids.max(initial=0)).bit_length()
        bits = np.unpackbits(little, axis=1, bitorder="little")
        return [compress(np.packbits(bits[:, i]).tobytes()) for i in range(used)]
    raise ValueError(f"planes are of kind byte or bit, not {kind!r}")


def from_planes(planes: list[bytes], n: int, kind: str = "byte") -> np.ndarray:
    """The block's ids."""
    expand = zstandard.ZstdDecompressor().decompress
    if kind == "byte":
        little = np.zeros((n, 4), dtype=np.uint8)
        for i, plane in enumerate(planes):
            little[:, i] = np.frombuffer(expand(plane), dtype=np.uint8)
    elif kind == "bit":
        bits = np.zeros((n, 32), dtype=np.uint8)
        for i, plane in enumerate(planes):
            bits[:, i] = np.unpackbits(np.frombuffer(expand(plane), dtype=np.uint8), count=n)
        little = np.packbits(bits, axis=1, bitorder="little")
    else:
        raise ValueError(f"planes are of kind byte or bit, not {kind!r}")
    return np.ascontiguousarray(little).view("<u4").ravel()


def _splits_after(core: str) -> bool:
    """Whether the word ends in a letter or digit, also once the library has normalised it (NFC, lower case).

    Some letters become a letter and a combining mark, and that mark forms one piece with the marks behind it.
    """
    end = core[-1:]
    return end.isalnum() and (end.isascii() or unicodedata.normalize("NFC", end).lower()[-1].isalnum())


# Fixed value: how the vocabulary splits a text before merging, for lower-case ASCII and Latin letters up to U+017F.
PLAIN_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u017f]+|[0-9]|[^ \\t\\n\\r\\f\\va-z0-9\u00df-\u00f6\u00f8-\u017f]+"
# Characters that are their own normal form, and whose lower case does not depend on their neighbours.
_NOT_PLAIN = re.compile("[^\\x00-\\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]")
_SPLIT_OF_FILE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SUFFIX = "</w>"


class PieceMerger(RaggedMerger):
    """Ids of pre-tokens, for vocabularies whose last symbol of a pre-token has a suffix."""

    def __init__(self, vocabulary: dict[str, int], merges: list) -> None:
        super().__init__(vocabulary, merges)
        self.ending = np.array([vocabulary[c + _SUFFIX] for c in byte_symbols()], dtype=np.int64)

    def ids(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, one after the other, and how many each has; no piece is empty."""
        data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        first, ends = self.first[data], np.cumsum(lengths) - 1
        first[ends] = self.ending[data[ends]]
        done, sizes, ids = map(np.concatenate, zip(*self.merged(first, lengths)))
        count = np.zeros(len(pieces), dtype=np.int64)
        count[done] = sizes
        flat = np.zeros(len(ids), dtype=np.int64)
        flat[runs(offsets(count)[:-1][done], sizes)] = ids
        return flat, count


class WordEncoder:
    """Ids of whole texts as a tokenizers file gives them, for vocabularies that drop white space.

    A text of ASCII and Latin letters is lower-cased and split into pre-tokens; each is merged once, many at a time, and
    looked up after that. Of other texts the white-space separated words are encoded by the library once: there a text's
    ids are those of its words, one after the other.
    """

    def __init__(self, spec: str) -> None:
        self.library = Tokenizer.from_str(spec)
        self.library.no_truncation()
        self.library.no_padding()
        probe = "a \n\tb"
        whole, _ = self._ids([probe])
        self.by_word = whole.tolist() == self._ids(["a", "b"])[0].tolist()
        special = [t["content"] for t in json.loads(spec).get("added_tokens", [])]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.merger = self._merger(json.loads(spec))
        self.split = re.compile(PLAIN_SPLIT)
        self.pieces = RaggedMemo(self._merge, longest=_CACHED_CHARS, most=_PIECES)
        self.words = RaggedMemo(self._learn_words, longest=_CACHED_CHARS, most=_WORDS)

    def _merger(self, tokenizer: dict) -> PieceMerger | None:
        """None where the file does more than lower-case, split and merge; then the library encodes all words."""
        model, normal = tokenizer["model"], tokenizer.get("normalizer") or {}
        steps = [n.get("type") for n in normal.get("normalizers", [normal])]
        splits = [p.get("pattern", {}).get("Regex") for p in (tokenizer.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        plain = model["type"] == "BPE" and model.get("end_of_word_suffix") == _SUFFIX and not model.get("continuing_subword_prefix")
        if not (self.by_word and plain and steps == ["NFC", "Replace", "Lowercase"] and splits[:1] == [_SPLIT_OF_FILE]):
            return None
        return PieceMerger(model["vocab"], model["merges"])

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return flattened([e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)])

    def _is_plain(self, text: str) -> bool:
        return self.merger is not None and (text.isascii() or not _NOT_PLAIN.search(text)) and not (self.special and self.special.search(text))

    def _merge(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Long pieces are left to the library, whose time does not grow with the number of different merges."""
        if len(pieces[0]) > _CACHED_CHARS:
            return self._ids(pieces)
        return self.merger.ids([p.encode() for p in pieces])

    def _learn_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Between a letter or digit and a mark no id reaches over, so closing marks are encoded apart."""
        cores = [w.rstrip(_CLOSING) for w in words]
        cores = [c if _splits_after(c) else w for c, w in zip(cores, words, strict=True)]
        parts = [p for c, w in zip(cores, words, strict=True) for p in (c, w[len(c) :])]
        different = {p: i for i, p in enumerate(dict.fromkeys(parts))}
        ids, count = self._ids(list(different))
        at = np.fromiter(map(different.__getitem__, parts), dtype=np.int64, count=len(parts))
        return ids[runs(offsets(count)[:-1][at], count[at])], count[at].reshape(-1, 2).sum(axis=1)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if not self.by_word:
            return _packed(*self._ids(texts))
        plain = list(map(self._is_plain, texts))
        out = [b""] * len(texts)
        for memo, kind in ((self.pieces, True), (self.words, False)):
            mine = [i for i, p in enumerate(plain) if p == kind]
            units = [self._units(texts[i], kind) for i in mine]
            if units:
                ids, count = memo.gather(list(chain.from_iterable(units)))
                sizes = np.diff(offsets(count)[offsets(np.fromiter(map(len, units), dtype=np.int64, count=len(units)))])
                for i, packed in zip(mine, _packed(ids, sizes)):
                    out[i] = packed
        return out

    def _units(self, text: str, plain: bool) -> list[str]:
        if plain:
            return self.split.findall(text.lower())
        return [w for w in _BLANKS.split(text) if w] if any(c in text for c in _NO_BLANKS) else text.split()


def _packed(ids: np.ndarray, count: np.ndarray) -> list[bytes]:
    data, at = ids.astype("<u4").tobytes(), (4 * offsets(count)).tolist()
    return [data[a:b] for a, b in zip(at, at[1:])]


@functools.lru_cache(maxsize=1)
def _encoder(spec: str) -> WordEncoder:
    """One encoder in a worker process, with the words it knows, for all tasks that run there."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    return WordEncoder(spec)


def _doc_type(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def write_tokens(docs: DataFrame, vocabulary_path: str, path: str, end_id: int, kind: str = "byte", block_ids: int = BLOCK_IDS) -> None:
    """Encode every whole text, append ``end_id`` to each, and write the ids in ascending doc_id order to ``path``.

    A null text is an empty one: its only id is ``end_id``. Null ids come first; rows with the same doc_id are
    ordered by a hash of their text, so that reruns write the same ids. Texts are shuffled once, into ranges of doc_id (and
    text, so that one id with very many rows is split too). A task holds one block and a group of texts.
    """
    spark = docs.sparkSession
    with open(vocabulary_path, encoding="utf-8") as file:
        spec = spark.sparkContext.broadcast(file.read())
    end = np.array([end_id], dtype="<u4").tobytes()

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, encoder = TaskContext.get().partitionId(), _encoder(spec.value)
        start, block, waiting, waiting_bytes = 0, 0, [], 0
        for batch in batches:
            texts, at = batch.column("text").to_pylist(), 0
            while at < len(texts):
                to, chars = at, 0
                while to < len(texts) and (to == at or chars + len(texts[to]) <= _GROUP_CHARS):
                    chars += len(texts[to])
                    to += 1
                ids = [e + end for e in encoder.encode(texts[at:to])]
                sizes = np.array([len(i) // 4 for i in ids])
                starts = start + np.cumsum(sizes) - sizes
                start += int(sizes.sum())
                yield rows(to - at, shard=number, doc_id=batch.column("doc_id").slice(at, to - at), start=starts, n=sizes)
                waiting += ids
                waiting_bytes += sum(map(len, ids))
                if waiting_bytes >= 4 * block_ids:
                    joined = np.frombuffer(b"".join(waiting), dtype="<u4")
                    full = len(joined) // block_ids
                    for b in range(full):
                        yield packed(number, block, joined[b * block_ids : (b + 1) * block_ids])
                        block += 1
                    waiting, waiting_bytes = [joined[full * block_ids :].tobytes()], 4 * (len(joined) - full * block_ids)
                at = to
        if waiting_bytes:
            yield packed(number, block, np.frombuffer(b"".join(waiting), dtype="<u4"))

    def packed(number: int, block: int, ids: np.ndarray) -> pa.RecordBatch:
        return rows(1, shard=number, block=[block], n=[len(ids)], planes=[to_planes(ids, kind)])

    id_type = to_arrow_type(docs.schema["doc_id"].dataType)
    kinds = {"shard": pa.int32(), "doc_id": id_type, "start": pa.int64(), "block": pa.int64(), "n": pa.int64(), "planes": pa.list_(pa.binary())}

    def rows(count: int, shard: int, **columns) -> pa.RecordBatch:
        made = {"shard": [shard] * count, **columns}
        return pa.RecordBatch.from_arrays([made[c] if isinstance(made.get(c), pa.Array) else pa.array(made[c], k) if c in made else pa.nulls(count, k) for c, k in kinds.items()], names=list(kinds))

    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = docs.select("doc_id", text_of().alias("text")).withColumn("text_hash", F.xxhash64("text"))
    ordered = placed.repartitionByRange(ranges, "doc_id", "text_hash").sortWithinPartitions("doc_id", "text_hash").select("doc_id", "text")
    table = ordered.mapInArrow(shard, f"shard int, doc_id {_doc_type(docs)}, start long, block long, n long, planes array<binary>")
    # one pass writes both kinds of rows, each kind to its own folder
    table.withColumn("part", F.when(F.col("block").isNull(), "index").otherwise("blocks")).write.partitionBy("part").option("compression", "none").parquet(path)
    spark.createDataFrame([(kind, block_ids)], "kind string, block_ids long").coalesce(1).write.parquet(f"{path}/part=format")


def read_tokens(spark: SparkSession, path: str, doc_type: str = "bigint") -> DataFrame:
    """Read the format back: doc_id, start (ids of all documents before it), n_tokens and ids (little-endian uint32 bytes).

    A document's ids are cut from the blocks they lie in; a document longer than a block is put together from
    its blocks in order. Shards are put after each other by a running sum over one row for each shard.
    """
    schema = f"shard int, doc_id {doc_type}, start long, block long, n long, planes array<binary>, part string"
    table = spark.read.schema(schema).parquet(path)
    kind, block_ids = spark.read.parquet(f"{path}/part=format").select("kind", "block_ids").first()
    index, blocks = table.where("part = 'index'"), table.where("part = 'blocks'")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row for each shard
    shards = index.groupBy("shard").agg(F.sum("n").alias("ids")).withColumn("before", F.coalesce(F.sum("ids").over(before), F.lit(0)))
    docs = index.select("shard", "doc_id", "start", "n").join(shards.select("shard", "before"), "shard")
    first, last = F.floor(F.col("start") / block_ids), F.floor((F.col("start") + F.col("n") - 1) / block_ids)
    cuts = docs.withColumn("block", F.explode(F.sequence(first, last)))
    wanted = cuts.groupBy("shard", "block").agg(F.sort_array(F.collect_list(F.struct("start", "n", "doc_id", "before"))).alias("docs"))
    both = blocks.select("shard", "block", F.col("n").alias("block_n"), "planes").join(wanted, ["shard", "block"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1)
                number, n = row.column("block")[0].as_py(), row.column("block_n")[0].as_py()
                ids = from_planes(row.column("planes")[0].as_py(), n, kind)
                docs = row.column("docs").flatten()
                starts, sizes = (docs.field(f).to_numpy(zero_copy_only=False) for f in ("start", "n"))
                begin = number * block_ids
                pieces = [ids[max(s - begin, 0) : max(s + k - begin, 0)].tobytes() for s, k in zip(starts.tolist(), sizes.tolist(), strict=True)]
                whole = pa.RecordBatch.from_arrays(
                    [pa.array([row.column("shard")[0].as_py()] * len(docs), pa.int32()), *(docs.field(f) for f in ("doc_id", "start", "n", "before")), pa.array([number] * len(docs), pa.int64()), pa.array(pieces, pa.binary())],
                    names=["shard", "doc_id", "start", "n", "before", "block", "piece"],
                )
                yield whole

    pieces = both.select("shard", "block", "block_n", "planes", "docs").mapInArrow(cut, f"shard int, doc_id {doc_type}, start long, n long, before long, block long, piece binary")
    # most documents lie in one block; only those that reach over several are grouped
    inside = F.floor(F.col("start") / block_ids) == F.floor((F.col("start") + F.col("n") - 1) / block_ids)
    whole = pieces.where(inside).select("doc_id", F.col("start") + F.col("before"), "n", "piece")
    parts = F.sort_array(F.collect_list(F.struct("block", "piece")))
    join = F.aggregate(F.transform(F.col("parts"), lambda p: p.piece), F.lit(b""), lambda a, b: F.concat(a, b))
    split = pieces.where(~inside).groupBy("shard", "start", "doc_id", "n", "before").agg(parts.alias("parts"))
    split = split.select("doc_id", F.col("start") + F.col("before"), "n", join)
    return whole.union(split).toDF("doc_id", "start", "n_tokens", "ids")


def token_table(docs: DataFrame, vocabulary_path: str, end_id: int, kind: str = "byte") -> DataFrame:
    """Write the documents' ids in the format to the shared folder and read them back."""
    path = scratch(docs.sparkSession, "tokens")
    write_tokens(docs, vocabulary_path, path, end_id, kind)
    return read_tokens(docs.sparkSession, path, _doc_type(docs))


def ids_crc32(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of each document's ids as they stand in the table."""
    return tokens.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))

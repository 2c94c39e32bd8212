"""Alignment of two tokenizers on the same bytes, by merge-path partitioning.

The byte offsets at which the tokens of A and of B end are two sorted lists. Merging them walks over all places where a token
of either ends: between two neighbouring places exactly one A and one B token overlap, and where both lists have the same
place a group of tokens ends. The merge is cut by diagonals: a binary search on each finds how many ends of A and
of B come before it, so that pieces of equal work are merged independently of each other. A piece emits its overlaps and the
shared ends it has met; groups that reach over pieces are stitched from the shared ends of neighbours.

How often two ids are linked in the corpus is counted in Spark. Documents are worked on in blocks of a bounded size. A block counts
each id pair once, as the number of its documents that hold the pair; these rows are added up by pair, and come back to the
block, where documents refer to pairs by their number.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from stratafold.llm.forced_boundaries import BoundaryEncoder, TokenBytes, boundary_encoder
from stratafold.llm.ragged import RaggedMemo, flattened, groups_of, offsets
from stratafold.llm.shared import scratch, staged, text_of

PIECE_STEPS = 1 << 15  # merge steps of a piece
_GROUP_CHARS = 1_000_000  # texts aligned together
_BLOCK_CHARS = 8_000_000  # texts whose pairs are counted together; a longer text is a block of its own
_SPACE = "▁"
_WORDS = re.compile(r" *[^ ]+| +")


class PieceEncoder:
    """Ids of whole texts for a sentencepiece model that marks spaces and puts one before a text.

    No piece has a space mark behind another character, so that a text is cut before its spaces, and words are encoded once.
    """

    def __init__(self, model: bytes) -> None:
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.tokens = [bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)]
        probe = "  two words\nand  more "
        mark = self.library.piece_to_id(_SPACE)
        by_word = not any(_SPACE in p.lstrip(_SPACE) for p in pieces) and not self.library.is_unknown(mark)
        self.memo = RaggedMemo(self._encode, most=600_000)
        if by_word:
            self.memo.fix(" ", [mark])  # a last space alone; the library would take it for no text at all
        self.by_word = by_word and self.encode([" " + probe], True)[0].tolist() == self.library.encode(probe)

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return flattened(self.library.encode([w[1:] for w in words], num_threads=1) if words else [])

    def encode(self, texts: list[str], by_word: bool | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts that each begin with the space the model adds, one after the other, and how many each text has."""
        if not (self.by_word if by_word is None else by_word):
            return self._encode(texts)
        words = [[t] if _SPACE in t else _WORDS.findall(t) for t in texts]  # the mark itself counts as a space
        ids, count = self.memo.gather([w for own in words for w in own])
        return ids, np.diff(offsets(count)[offsets(np.array([len(own) for own in words], dtype=np.int64))])


def diagonal_cuts(a: np.ndarray, b: np.ndarray, steps: int = PIECE_STEPS) -> tuple[np.ndarray, np.ndarray]:
    """How many of a and of b come before every ``steps``-th step of their merge, and before its end; of equal values a's is first.

    All diagonals are searched at once: on diagonal d, the point (i, d - i) is on the path where a[i - 1] <= b[d - i] and b[d - i - 1] < a[i].
    """
    total = len(a) + len(b)
    diagonal = np.append(np.arange(0, total, steps), total)
    low, high = np.maximum(diagonal - len(b), 0), np.minimum(diagonal, len(a))
    while (open_ := low < high).any():
        middle = (low + high) // 2
        at = np.where(open_, middle, 0)
        other = np.where(open_, diagonal - 1 - middle, 0)
        first = np.zeros(len(diagonal), dtype=bool)
        first[open_] = a[at[open_]] <= b[other[open_]]
        low, high = np.where(open_ & first, middle + 1, low), np.where(open_ & ~first, middle, high)
    return low, diagonal - low


def merge_piece(a: np.ndarray, b: np.ndarray, i0: int, i1: int, j0: int, j1: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Overlaps (index in a, index in b) that end in this piece of the merge, and the shared ends (index in a, index in b) it meets."""
    mine_a, mine_b = a[i0:i1], b[j0:j1]
    b_of_a = j0 + np.searchsorted(mine_b, mine_a)  # the token of b that a's token ends in
    a_of_b = i0 + np.searchsorted(mine_a, mine_b)
    inner = np.minimum(a_of_b, len(a) - 1)
    shared = (a_of_b < i1) & (a[inner] == mine_b)
    if j1 > j0 and i0 > 0 and a[i0 - 1] == b[j0]:  # the piece before has the same end of a
        shared[0] = True
        a_of_b[0] = i0 - 1
    alone = ~shared
    of_b = np.arange(j0, j1)
    return np.concatenate([np.arange(i0, i1), a_of_b[alone]]), np.concatenate([b_of_a, of_b[alone]]), a_of_b[shared], of_b[shared]


@dataclass
class Aligned:
    """Tokens of a batch of texts and how they overlap; ``texts`` has each text's first A token, B token and group."""

    a: np.ndarray
    b: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    group_a: np.ndarray  # one past the last A token of each group
    group_b: np.ndarray
    text_a: np.ndarray
    text_b: np.ndarray
    text_group: np.ndarray


def align_ends(a_ids: np.ndarray, b_ids: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray, text_a: np.ndarray, text_b: np.ndarray, steps: int = PIECE_STEPS) -> Aligned:
    """Overlaps and groups of tokens whose ends lie on one line of bytes, text after text; every text's end is shared."""
    i, j = diagonal_cuts(a_ends, b_ends, steps)
    pieces = [merge_piece(a_ends, b_ends, *p) for p in zip(i[:-1].tolist(), i[1:].tolist(), j[:-1].tolist(), j[1:].tolist())]
    link_a, link_b, shared_a, shared_b = (np.concatenate(parts) if pieces else np.zeros(0, dtype=np.int64) for parts in (zip(*pieces) if pieces else ((),) * 4))
    # a group runs from one shared end to the next, in whichever pieces these were met
    return Aligned(a_ids, b_ids, link_a, link_b, shared_a + 1, shared_b + 1, text_a, text_b, np.searchsorted(shared_a, text_a))


class Aligner:
    """Both tokenizers in a worker process, and the alignment of batches of texts."""

    def __init__(self, spec: str, model: bytes) -> None:
        self.encode_a: BoundaryEncoder = boundary_encoder(spec, True)
        self.encode_b = PieceEncoder(model)
        self.bytes_a, self.bytes_b = TokenBytes(self.encode_a.tokens), TokenBytes(self.encode_b.tokens)
        self.size_a, self.size_b = len(self.encode_a.tokens), len(self.encode_b.tokens)
        # every id as text with what follows it: inside a group and at its end, for A and then for B
        self.words = [f"{i}{end}" for i in range(self.size_a) for end in (",", "|")] + [f"{i}{end}" for i in range(self.size_b) for end in (",", ";")]

    def align(self, texts: list[str]) -> Aligned:
        """Texts without characters, or whose tokens of A or B do not join to a space and the text, have no tokens."""
        lead = [" " + t if t else "" for t in texts]
        data = [t.encode() for t in lead]
        a, count_a = self.encode_a.encode(data)
        b, count_b = self.encode_b.encode(lead)
        ends_a, ends_b = np.cumsum(self.bytes_a.sizes(a)), np.cumsum(self.bytes_b.sizes(b))
        joined = b"".join(data)
        joined_a, joined_b = self.bytes_a.join(a), self.bytes_b.join(b)
        if joined_a != joined or joined_b != joined:
            at_a, at_b = np.append(0, ends_a)[offsets(count_a)].tolist(), np.append(0, ends_b)[offsets(count_b)].tolist()
            fits = np.array([joined_a[p:q] == t == joined_b[r:s] for t, p, q, r, s in zip(data, at_a, at_a[1:], at_b, at_b[1:])], dtype=bool)
            a, b = a[np.repeat(fits, count_a)], b[np.repeat(fits, count_b)]
            count_a, count_b = count_a * fits, count_b * fits
            ends_a, ends_b = np.cumsum(self.bytes_a.sizes(a)), np.cumsum(self.bytes_b.sizes(b))
        return align_ends(a, b, ends_a, ends_b, offsets(count_a), offsets(count_b))

    def group_texts(self, found: Aligned) -> list[str]:
        """Groups of each text as ``a1,a2|b1;a3|b2,b3``: A ids, B ids, next group."""
        before_a, before_b = np.append(0, found.group_a)[:-1], np.append(0, found.group_b)[:-1]
        size_a, size_b = found.group_a - before_a, found.group_b - before_b
        words = np.empty(len(found.a) + len(found.b), dtype=np.int64)
        own_a, own_b = 2 * found.a.astype(np.int64), 2 * (self.size_a + found.b.astype(np.int64))
        own_a[found.group_a - 1] += 1
        own_b[found.group_b - 1] += 1
        # a group's A tokens stand behind the B tokens of the groups before it, its B tokens behind its own A tokens
        words[np.arange(len(own_a)) + np.repeat(before_b, size_a)] = own_a
        words[np.arange(len(own_b)) + np.repeat(found.group_a, size_b)] = own_b
        texts = list(map(self.words.__getitem__, words.tolist()))
        at = (found.text_a + found.text_b).tolist()
        return ["".join(texts[s:e])[:-1] for s, e in zip(at, at[1:])]


@functools.lru_cache(maxsize=1)
def _aligner(spec: str, model: bytes) -> Aligner:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    return Aligner(spec, model)


ALIGNED = "block long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<int>, links array<int>"


def align_texts(docs: DataFrame, byte_level_path: str, pieces_path: str, carry: list[str], column: str = "text") -> DataFrame:
    """Rows of two kinds: aligned documents (``kind`` 0) and the id pairs of their blocks (``kind`` 1).

    A document has the columns ``carry`` in the struct ``row``, its counts of tokens, groups and links, its groups as text, and in
    ``pairs`` and ``links`` the numbers of its id pairs within the block and how often each is linked. A pair has its ``number``, ``pair``
    (A id times 2^32 plus B id) and ``documents``, the number of the block's documents that hold it.
    """
    sc = docs.sparkSession.sparkContext
    with open(byte_level_path, encoding="utf-8") as spec, open(pieces_path, "rb") as model:
        files = sc.broadcast((spec.read(), model.read()))  # their size is that of the files
    source = docs.select(F.struct(*carry).alias("row"), text_of(column).alias("text"))
    schema = StructType([StructField("row", source.schema["row"].dataType), *_parse(ALIGNED), *_parse("number int, pair long, documents long, kind int")])
    arrow = to_arrow_schema(schema)

    def rows(count: int, **columns) -> pa.RecordBatch:
        made = []
        for field in arrow:
            value = columns.get(field.name)
            made.append(pa.nulls(count, field.type) if value is None else value.cast(field.type) if isinstance(value, pa.Array) else pa.array(value, field.type))
        return pa.RecordBatch.from_arrays(made, schema=arrow)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(*files.value)
        block = _Block(TaskContext.get().partitionId() << 32, aligner.size_b)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            own = batch.column("row")
            for start, end in groups_of([len(t) for t in texts], _GROUP_CHARS):
                if block.size and block.size + sum(map(len, texts[start:end])) > _BLOCK_CHARS:
                    yield from block.close(rows)
                block.add(aligner, texts[start:end], own.slice(start, end - start))
        yield from block.close(rows)

    return source.mapInArrow(work, schema)


def _parse(ddl: str) -> list:
    return StructType.fromDDL(ddl).fields


class _Block:
    """Documents of one block until it is closed: then their pairs are numbered."""

    def __init__(self, first: int, size_b: int) -> None:
        self.number, self.size_b = first, size_b
        self._open()

    def _open(self) -> None:
        self.size, self.own, self.columns, self.keys, self.links, self.counts = 0, [], [], [], [], []

    def add(self, aligner: Aligner, texts: list[str], own: pa.Array) -> None:
        found = aligner.align(texts)
        text_of_link = np.searchsorted(found.text_a, found.link_a, side="right") - 1
        pair = found.a[found.link_a].astype(np.int64) * self.size_b + found.b[found.link_b]
        span = aligner.size_a * aligner.size_b  # below 2^42 for vocabularies of two million ids, so that 2^21 texts fit a long
        key, links = np.unique(text_of_link * span + pair, return_counts=True)
        text, key = np.divmod(key, span)
        n_groups, n_links = np.diff(found.text_group), np.bincount(text_of_link, minlength=len(texts))
        self.own.append(own)
        self.columns.append((np.diff(found.text_a), np.diff(found.text_b), n_groups, n_links, aligner.group_texts(found)))
        self.keys.append(key)
        self.links.append(links)
        self.counts.append(np.bincount(text, minlength=len(texts)))
        self.size += sum(map(len, texts))

    def close(self, rows) -> Iterator[pa.RecordBatch]:
        if not self.own:
            return
        known, number, documents = np.unique(np.concatenate(self.keys), return_inverse=True, return_counts=True)
        pair = (known // self.size_b << 32) + known % self.size_b
        yield rows(len(known), block=np.full(len(known), self.number), number=np.arange(len(known)), pair=pair, documents=documents, kind=np.ones(len(known)))
        at = 0
        for own, (n_a, n_b, n_groups, n_links, groups), links, counts in zip(self.own, self.columns, self.links, self.counts):
            place = pa.array(offsets(counts), pa.int32())
            pairs = pa.ListArray.from_arrays(place, pa.array(number[at : at + len(links)], pa.int32()))
            linked = pa.ListArray.from_arrays(place, pa.array(links, pa.int32()))
            at += len(links)
            n = len(own)
            yield rows(n, row=own, block=np.full(n, self.number), n_a=n_a, n_b=n_b, n_groups=n_groups, n_links=n_links, groups=groups, pairs=pairs, links=linked, kind=np.zeros(n))
        self.number += 1
        self._open()


def align_tokenizers(docs: DataFrame, byte_level_path: str, pieces_path: str, column: str = "text", keep: list[str] | None = None, groups=None) -> DataFrame:
    """Add ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum`` and ``groups`` to each document.

    A is a byte-level vocabulary of the tokenizers library and encodes a space and the text; B is a sentencepiece model, which adds the space
    itself; strings of special tokens are plain text. Groups are cut where tokens of both end, and stand as text, ``a1,a2|b1;a3|b2,b3``.
    A link is a pair of an A and a B token whose bytes overlap. The count of an id pair is the number of documents of ``docs`` that
    hold it linked; ``n_best`` counts links whose count is the highest of their A id (ties included), ``count_sum`` adds the counts of all links.
    ``groups`` (a function of that column) may put something smaller, such as a digest, in its place before it is stored.

    A text that is null, empty, or not given back by the tokens of A or B (as with U+2581) has no tokens: zeros and an empty ``groups``. Each
    row is a document of its own, so repeated rows count as often as they stand there. An empty table stays empty. Columns of
    these names that the input has are replaced; others stay, or only those named in ``keep``, which need not be stored then. Texts are not shuffled: only the pair numbers of a block meet its pair counts.
    """
    made = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    carry = [c for c in (docs.columns if keep is None else keep) if c not in made]
    spark = docs.sparkSession
    found = align_texts(docs, byte_level_path, pieces_path, carry, column)
    if groups is not None:
        found = found.withColumn("groups", groups(F.col("groups")))
    path = scratch(spark, "aligned")
    found.write.partitionBy("kind").option("compression", "zstd").parquet(path)
    read = spark.read.schema(found.schema)
    texts = read.parquet(path).where("kind = 0").select("row", "block", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "links")
    pairs = read.parquet(path).where("kind = 1").select("block", "number", "pair", "documents")
    counts = staged(pairs.groupBy("pair").agg(F.sum("documents").alias("count")), "pair-counts")
    best = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("count").alias("most"))
    scored = counts.withColumn("a", F.shiftright("pair", 32)).join(best, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    back = pairs.select(F.col("block").alias("of_block"), "number", "pair").join(scored, "pair").select("of_block", "number", "count", "best")
    out = StructType([*texts.schema.fields[:1], *_parse("n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string")])
    arrow = to_arrow_schema(out)

    def judge(documents: pa.Table, pairs: pa.Table) -> pa.Table:
        n = documents.num_rows
        where = np.empty(pairs.num_rows, dtype=np.int64)
        where[pairs.column("number").to_numpy()] = np.arange(pairs.num_rows)
        count, best = pairs.column("count").to_numpy()[where], pairs.column("best").to_numpy()[where]
        mine, links = documents.column("pairs").combine_chunks(), documents.column("links").combine_chunks()
        pair, linked = (x.flatten().to_numpy().astype(np.int64) for x in (mine, links))
        at = offsets(mine.value_lengths().to_numpy().astype(np.int64))
        total, good = (np.append(0, np.cumsum(v))[at] for v in (linked * count[pair], linked * best[pair]))
        columns = {**{c: documents.column(c) for c in documents.column_names}, "n_best": pa.array(np.diff(good)), "count_sum": pa.array(np.diff(total))}
        return pa.Table.from_arrays([columns[f.name].cast(f.type) if n else pa.array([], f.type) for f in arrow], schema=arrow)

    judged = texts.groupBy("block").cogroup(back.groupBy("of_block")).applyInArrow(judge, out)
    return judged.select(*[F.col("row").getField(c).alias(c) for c in carry], *made)

"""Near copies by wide SimHash fingerprints and pigeonhole blocks, verified by the shingles they share.

A fingerprint has 768 bits, each the majority of hashes of a text's different words: an edited word moves it little, where it
would move five shingles of five words. It is split into 32 blocks of 24 bits. Two fingerprints that differ in at most
31 bits share a block for certain, and with a tenth of all bits different nine in ten pairs still do. Fingerprints are filed under
their blocks, compared within a file by Hamming distance, and a link is kept if the two texts' sets of five-word shingles are alike. A
file emits the links that hold it together, not all pairs.

What the fingerprints miss is found by prefixes: two sets of a Jaccard similarity of at least s share a shingle among the first
n - ceil(s * n) + 1 of each in any order that all sets keep, here the seldom ones first. Texts of different groups that share one are compared as well,
unless bitmaps of their shingles differ in more bits than alike sets have shingles for themselves.
The groups are then those of all pairs that are alike; large groups of near copies are one group by then and are not paired again.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from stratafold.llm.components import connected_components
from stratafold.llm.ragged import text_slices
from stratafold.llm.shared import staged, text_of, unused_names

SEED = 42
BLOCKS, BLOCK_BITS = 32, 24
BITS = BLOCKS * BLOCK_BITS
_PART = 2_048  # fingerprints of a file that are compared with each other; a larger file is dealt to parts
_PIVOTS = 64  # fingerprints of a large file that stand in each of its parts
_WORDS_AT_A_TIME = 4_096
_KINDS = 1 << 22  # kinds of shingles, by their hash, that are counted to tell frequent ones
_FREQUENT = 1 << 18  # kinds that are told apart by their number at most; others count as seldom. The order changes the work, not the result
_PAIRS_AT_A_TIME = 1 << 16
_MAPS, _MAP_BITS = 256, 1 << 15  # bitmaps, a megabyte in all, that tell where a text is read whether it may be looked for


def words_of(text: str) -> list[bytes]:
    """What white space separates, A-Z in lower case."""
    return text.encode().lower().split()


def wide_fingerprint(words: list[bytes]) -> np.ndarray:
    """768 bits in bytes: those set in over half of the hashes of the different words; zeros without words."""
    different = list(dict.fromkeys(words))
    ones = np.zeros(BITS, dtype=np.int64)
    lanes = np.arange(1, BITS // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for start in range(0, len(different), _WORDS_AT_A_TIME):
        part = different[start : start + _WORDS_AT_A_TIME]
        x = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in part), dtype=np.uint64, count=len(part))[:, None] + lanes
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):  # independent bits for each lane
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
        ones += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(different), bitorder="little")


def shingle_hashes(words: list[bytes], shingle: int) -> np.ndarray:
    """Sorted 64-bit hashes of the different shingles; of fewer words the whole sequence is one."""
    n = max(1, len(words) - shingle + 1)
    made = np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle]), SEED) for i in range(n)), dtype=np.uint64, count=n)
    return np.unique(made)


def prefix_of(shingles: np.ndarray, similarity: float, frequent: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """The shingles one of which an alike set must share: the first n - ceil(similarity * n) + 1, seldom ones first.

    ``frequent`` are the sorted kinds of frequent shingles, ``numbers`` how many there are of each.
    """
    kinds = (shingles % np.uint64(_KINDS)).astype(np.int64)
    number = np.zeros(len(shingles), dtype=np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, kinds), len(frequent) - 1)
        number = np.where(frequent[at] == kinds, numbers[at], 0)
    take = len(shingles) - math.ceil(similarity * len(shingles) - 1e-9) + 1
    return shingles[np.argsort(number, kind="stable")[:take]]  # they are sorted already


def parity_of(shingles: np.ndarray) -> bytes:
    """Bitmap of 2^k bits, two for each shingle at least: a bit tells whether an odd number of shingles has its number as remainder."""
    bits = 1 << max(6, (2 * len(shingles) - 1).bit_length())
    times = np.bincount((shingles % np.uint64(bits)).astype(np.int64), minlength=bits)
    return np.packbits((times & 1).astype(np.uint8), bitorder="little").tobytes()


def may_be_alike(parities: tuple[bytes, bytes], sizes: tuple[int, int], similarity: float) -> bool:
    """False only for sets that are not alike: a bit that differs takes a shingle that one of them has for itself.

    Of n shingles in both sets together, alike ones have n * (1 - similarity) / (1 + similarity) that are in one set only, at most.
    """
    short, long = sorted((np.frombuffer(p, dtype=np.uint8) for p in parities), key=len)
    while len(long) > len(short):  # remainders by half as many bits
        half = len(long) // 2
        long = long[:half] ^ long[half:]
    return int(np.bitwise_count(short ^ long).sum()) <= sum(sizes) * (1 - similarity) / (1 + similarity) + 1e-6


def _file_links(limit: int):
    """Links that connect what is connected within each file, between fingerprints at most ``limit`` bits apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])
            for members in batch.column("members"):
                nodes = members.values.field("node").to_numpy(zero_copy_only=False)
                prints = np.frombuffer(b"".join(members.values.field("print").to_pylist()), dtype=np.uint64).reshape(len(nodes), -1)
                rest = np.arange(len(nodes))
                while len(rest) > 1:  # a search through the file; each fingerprint is reached once
                    front, rest = rest[:1], rest[1:]
                    while len(front) and len(rest):
                        at, front = front[0], front[1:]
                        near = np.bitwise_count(prints[rest] ^ prints[at]).sum(axis=1) <= limit
                        if near.any():
                            found = rest[near]
                            ends[0].append(np.full(len(found), nodes[at]))
                            ends[1].append(nodes[found])
                            front, rest = np.concatenate([front, found]), rest[~near]
            columns = [pa.array(np.concatenate(side)) if side else pa.array([], pa.int64()) for side in ends]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b"])

    return run


def candidate_links(nodes: DataFrame, bits: int) -> DataFrame:
    """(a, b) between nodes whose fingerprints share a block and differ in ``bits`` at most.

    A file of more than 2,048 fingerprints is dealt to parts by hash, each of which also holds about 64 of the file's fingerprints, the
    same in all its parts, so that groups stay connected; the work of a file grows with its size and not with its square.
    """
    blocks = F.transform(F.sequence(F.lit(0), F.lit(BLOCKS - 1)), lambda i: F.concat(F.lit("0"), F.hex(F.substring("print", i * 3 + 1, F.lit(3)))))
    keys = F.transform(blocks, lambda h, i: F.conv(h, 16, 10).cast("long") + i.cast("long") * (1 << BLOCK_BITS))
    filed = nodes.select("node", F.explode(keys).alias("file"))
    sizes = staged(filed.groupBy("file").count().where("count > 1"), "block-sizes")
    members = filed.join(sizes, "file")  # a fingerprint, twelve times as long as its node, follows only into files with others
    parts = F.ceil(F.col("count") / _PART)
    every_part = F.sequence(F.lit(0).cast("long"), parts - 1)
    own = F.array(F.pmod(F.xxhash64("node"), parts))
    pivot = F.pmod(F.xxhash64("node", F.lit("pivot")), F.lit(1 << 30)) * F.col("count") < _PIVOTS * (1 << 30)
    dealt = members.withColumn("part", F.explode(F.when((parts > 1) & pivot, every_part).otherwise(own)))
    dealt = dealt.select("file", "part", "node").join(nodes.select("node", "print"), "node")
    gathered = dealt.groupBy("file", "part").agg(F.collect_list(F.struct("node", "print")).alias("members")).where(F.size("members") > 1)
    return gathered.select("members").mapInArrow(_file_links(bits), "a long, b long").distinct()


_BATCH = 1_000  # rows of texts or shingles that go to Python together
_FILES = 64  # files that go to Python together: up to 2,048 fingerprints each
_TEXTS = 64  # pairs of texts that go to Python together


def _fingerprinted(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, node (a hash of the words in order) and print (of the different words) of each row."""

    @F.arrow_udf("struct<node:bigint,print:binary>")
    def fingerprints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in text_slices(batches):
            found = [(xxhash.xxh64_intdigest(b" ".join(w), SEED), wide_fingerprint(w).tobytes()) for w in map(words_of, texts.to_pylist())]
            hashes = np.array([h for h, _ in found], dtype=np.uint64).view(np.int64)
            yield pa.StructArray.from_arrays([pa.array(hashes), pa.array([p for _, p in found], pa.binary())], names=["node", "print"])

    made = docs.select("doc_id", F.xxhash64(text_of()).alias("text_hash"), fingerprints(text_of()).alias("f"))
    return staged(made.select("doc_id", "text_hash", "f.node", "f.print"), "wide-prints", _BATCH)


def _rows_of(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose ``key`` is among ``keys``, with the columns of both; most others are told by bitmaps of hashes before texts are shuffled."""

    def numbered(df: DataFrame) -> DataFrame:
        place = F.pmod(F.xxhash64("key"), F.lit(_MAPS * _MAP_BITS))
        return df.withColumns({"map": F.floor(place / _MAP_BITS), "bit": place % _MAP_BITS})

    maps = numbered(keys.select("key")).groupBy("map").agg(F.bitmap_construct_agg("bit").alias("bits"))
    byte = F.conv(F.hex(F.substring("bits", (F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    marked = numbered(rows).join(F.broadcast(maps), "map").where(F.getbit(byte, (F.col("bit") % 8).cast("int")) == 1)
    return marked.drop("map", "bit", "bits").join(keys, "key")


def _alike(links: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The links whose nodes' sets of shingles have at least this Jaccard similarity; ``texts`` has node and text of all of them."""

    @F.arrow_udf("double")
    def jaccard(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        own = functools.lru_cache(maxsize=64)(lambda text: shingle_hashes(words_of(text), shingle))
        for a, b in batches:
            out = []
            for x, y in zip(a, b):
                one, two = own(x.as_py()), own(y.as_py())
                both = len(np.intersect1d(one, two, assume_unique=True))
                out.append(both / (len(one) + len(two) - both))
            yield pa.array(out, pa.float64())

    texts = staged(texts.dropDuplicates(["node"]), "linked-texts")
    left = links.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    pairs = left.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    alike = pairs.select("a", "b", jaccard("text_a", "text_b").alias("similarity")).where(F.col("similarity") >= similarity)
    return staged(alike.select("a", "b"), "alike", _TEXTS)


def _frequent_kinds(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Kinds of shingles that stand often in some partition, sorted, and their numbers there: a bounded list."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.zeros(_KINDS, dtype=np.int64)
        for texts in text_slices(batch.column("text") for batch in batches):
            for text in texts.to_pylist():
                np.add.at(number, (shingle_hashes(words_of(text), shingle) % np.uint64(_KINDS)).astype(np.int64), 1)
        often = np.flatnonzero(number >= 8)
        often = often[np.argsort(-number[often], kind="stable")[:_FREQUENT]]
        yield pa.RecordBatch.from_arrays([pa.array(often), pa.array(number[often])], names=["kind", "n"])

    numbers = staged(docs.select(text_of().alias("text")).mapInArrow(counted, "kind long, n long"), "kinds", _BATCH)
    most = numbers.groupBy("kind").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "kind").limit(_FREQUENT)
    found = most.toArrow().sort_by("kind")  # _FREQUENT rows at most
    return found["kind"].to_numpy(), found["n"].to_numpy()


def _cross_pairs(similarity: float):
    """(a, b) of each file: members of different groups whose numbers of shingles let them be alike."""

    def made(ends: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        a, b = (np.concatenate(side) for side in zip(*ends))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, rows = [], 0
        for batch in batches:
            for members in batch.column("members"):
                node, group, size = (members.values.field(c).to_numpy(zero_copy_only=False) for c in ("node", "component", "size"))
                order = np.argsort(group, kind="stable")
                node, group, size = node[order], group[order], size[order]
                after = np.searchsorted(group, group, side="right")
                for i in range(int(np.searchsorted(group, group[-1]))):  # all but the last group
                    own, others = size[i], size[after[i] :]
                    fits = (np.minimum(own, others) >= similarity * np.maximum(own, others) - 1e-9).nonzero()[0]
                    if len(fits):
                        waiting.append((np.full(len(fits), node[i]), node[after[i] :][fits]))
                        rows += len(fits)
                    if rows >= _PAIRS_AT_A_TIME:
                        yield made(waiting)
                        waiting, rows = [], 0
        if waiting:
            yield made(waiting)

    return run


def missed_links(docs: DataFrame, component: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """(a, b) between nodes of different components whose prefixes share a shingle: every pair of alike texts that is not connected yet is among them.

    ``component`` has node and component of the nodes that are linked already. A shingle that one component has for itself, as those of a large group of
    near copies are, makes no pairs. Most shingles stand in one text only: they go before components are looked up.
    """
    frequent, numbers = _frequent_kinds(docs, shingle)

    @F.arrow_udf("struct<node:bigint,size:bigint,parity:binary,prefix:array<bigint>>")
    def prefixes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in text_slices(batches):
            nodes, sizes, parities, own = [], [], [], []
            for words in map(words_of, texts.to_pylist()):
                shingles = shingle_hashes(words, shingle)
                nodes.append(xxhash.xxh64_intdigest(b" ".join(words), SEED))
                sizes.append(len(shingles))
                parities.append(parity_of(shingles))
                own.append(prefix_of(shingles, similarity, frequent, numbers).view(np.int64))
            ends = np.concatenate([[0], np.cumsum([len(p) for p in own])]).astype(np.int32)
            flat = pa.array(np.concatenate([np.empty(0, dtype=np.int64), *own]))
            columns = [pa.array(np.array(nodes, dtype=np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(parities, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), flat)]
            yield pa.StructArray.from_arrays(columns, names=["node", "size", "parity", "prefix"])

    @F.arrow_udf("boolean")
    def near(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([may_be_alike((p, q), (m, n), similarity) for p, q, m, n in zip(*(c.to_pylist() for c in batch))], pa.bool_())

    made = staged(docs.select(prefixes(text_of()).alias("f")).select("f.*"), "prefixes", _BATCH)
    tokens = made.select("node", "size", F.explode("prefix").alias("token"))
    shared = staged(tokens.groupBy("token").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("token"), "shared-by-texts")
    named = tokens.join(shared, "token").distinct().join(component, "node", "left")
    named = staged(named.select("token", "node", "size", F.coalesce("component", "node").alias("component")), "shared-prefixes")
    shared = staged(named.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("token"), "shared")
    member = F.struct("node", "component", "size")
    files = named.join(shared, "token").groupBy("token").agg(F.collect_set(member).alias("members"))
    pairs = staged(files.select("members").mapInArrow(_cross_pairs(similarity), "a long, b long").distinct(), "missed", _FILES)
    sketches = made.select("node", "size", "parity").dropDuplicates(["node"])
    for end in "ab":
        pairs = pairs.join(sketches.toDF(end, f"size_{end}", f"parity_{end}"), end)
    return staged(pairs.where(near("parity_a", "parity_b", "size_a", "size_b")).select("a", "b"), "missed-near", _BATCH)


def near_copy_groups(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, bits: int = 92) -> DataFrame:
    """``doc_id``, ``text_hash``, ``node`` (a hash of the text's words in order) and ``group_id`` of each row.

    Texts are linked whose sets of ``shingle``-word shingles have a Jaccard similarity of at least ``similarity``, all pairs of them: first those whose
    fingerprints share a block and differ in at most ``bits`` of 768, then those of different groups that share a shingle of their prefixes.
    Texts with the same words in the same order are one node, hot groups of copies among them.
    ``group_id`` is the smallest doc_id that links reach (null if all are null). A null text is an empty one; texts without words are one
    group. Repeated rows repeat their result. An id of any type that can be ordered will do.
    """
    own = _fingerprinted(docs)
    stands = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("stands")
    nodes = staged(own.groupBy("node").agg(F.min("doc_id").alias("first_doc"), stands, F.first("print").alias("print")), "nodes")

    def alike(links: DataFrame) -> DataFrame:
        # the text of one row of each linked node, so that a hot group of copies is not gathered: all texts of a node have the same words
        linked = nodes.select("node", F.struct("stands.doc_id", "stands.text_hash").alias("key")).join(links.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi")
        there = _rows_of(docs.select(F.struct("doc_id", F.xxhash64(text_of()).alias("text_hash")).alias("key"), text_of().alias("text")), linked)
        return _alike(links, there.select("node", "text"), shingle, similarity)

    found = alike(staged(candidate_links(nodes.select("node", "print"), bits), "candidates", _FILES))
    component = connected_components(found, "a", "b")
    found = found.union(alike(missed_links(docs, component, similarity, shingle)))
    component = connected_components(found, "a", "b")
    named = nodes.select("node", "first_doc").join(component, "node", "left").select("node", "first_doc", F.coalesce("component", "node").alias("component"))
    group = named.groupBy("component").agg(F.min("first_doc").alias("group_id"))
    return own.select("doc_id", "text_hash", "node").join(named.join(group, "component").select("node", "group_id"), "node").select("doc_id", "text_hash", "node", "group_id")


def drop_near_copies(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, bits: int = 92) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies, with all its columns.

    Of rows that repeat doc_id and words one stays. Of a group with null ids only, each different text stays once; beside other ids, rows
    without an id go.
    """
    (key,) = unused_names(docs, "key")
    groups = near_copy_groups(docs, similarity, shingle, bits)
    first = groups.where(F.col("doc_id").eqNullSafe(F.col("group_id"))).groupBy("doc_id", "node").agg(F.min("text_hash").alias("text_hash"))
    first = first.withColumn("text_hash", F.coalesce("text_hash", F.lit(0).cast("long")))  # never null: keys of the same type, so that texts are shuffled once
    keyed = docs.withColumn(key, F.struct("doc_id", F.xxhash64(text_of()).alias("text_hash")))
    return keyed.join(first.select(F.struct("doc_id", "text_hash").alias(key)), key, "left_semi").dropDuplicates([key]).select(*docs.columns)

"""Near-duplicates by SimHash fingerprints, found through pigeonhole blocks.

Two fingerprints that differ in at most d bits agree in all but d of d + 2 blocks of bits. So each distinct
fingerprint is filed under the values of every choice of two blocks, only fingerprints filed together are
compared, and their Hamming distance is verified. A file that holds too many fingerprints is split again in the
same way on the bits that its key does not fix, until it is small: the work of a group of near copies does not
grow with its square, and no pair is lost. Only the links that hold a file together leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from stratafold.llm.components import connected_components
from stratafold.llm.shared import staged, text_of, unused_names

SEED = 42  # fixed value: the seed of the shingle hashes
_FILE_LIMIT = 1024  # fingerprints compared with each other in one task
_CHUNK = 1 << 16  # shingle hashes whose bits are counted together


def fingerprint(text: str, shingle: int = 3) -> int:
    """64 bits: those set in over half of the XXH64 values of the shingles; 0 without words.

    Words are what white space separates, A-Z in lower case; a text of fewer words than a shingle is one shingle.
    """
    words = text.encode().lower().split()  # of bytes: lowers A-Z only, splits at the six ASCII blanks
    if not words:
        return 0
    line = b" ".join(words)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    ends = np.cumsum(size) - 1
    begins = ends - size + 1
    n = max(1, len(words) - shingle + 1)
    hashed = xxhash.xxh64_intdigest
    hashes = np.fromiter((hashed(line[i:j], SEED) for i, j in zip(begins[:n].tolist(), ends[-n:].tolist(), strict=True)), dtype=np.uint64, count=n)
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, n, _CHUNK):
        bits = np.unpackbits(hashes[start : start + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, column: str = "fingerprint_bits") -> DataFrame:
    """Add each text's fingerprint as a signed 64-bit number; a null text is an empty one, whose fingerprint is 0."""

    @F.pandas_udf("long")
    def simhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64))

    return docs.withColumn(column, simhash(text_of()))


def _blocks(bits: list[int], n: int) -> list[list[int]]:
    return [list(map(int, part)) for part in np.array_split(bits, n)]


def _mask(bits: list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >= 1 << 63 else value


def block_masks(distance: int) -> list[list[tuple[int, int]]]:
    """For every level of splitting, the choices of fixed bits, as (number of the choice above, mask).

    Each level fixes two of ``distance + 2`` blocks of the bits that are still free, in all ways.
    """
    levels, above = [], [list(range(64))]
    while True:
        masks, free_bits = [], []
        for parent, free in enumerate(above):
            for kept in combinations(_blocks(free, distance + 2), 2):
                fixed = [b for block in kept for b in block]
                masks.append((parent, _mask(sorted(set(range(64)) - set(free)) + fixed)))
                free_bits.append([b for b in free if b not in fixed])
        levels.append(masks)
        if 1 << len(free_bits[0]) <= _FILE_LIMIT:
            return levels
        above = free_bits


def _links(distance: int):
    """For each file, links of at most ``distance`` bits that connect what is connected within the file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, high = [], []
            for prints in batch.column("prints"):
                values = np.unique(prints.values.to_numpy(zero_copy_only=False)).view(np.uint64)
                rest = np.arange(len(values))
                while len(rest) > 1:  # a search through the file; each fingerprint is reached once
                    front, rest = rest[:1], rest[1:]
                    while len(front) and len(rest):
                        at, front = values[front[0]], front[1:]
                        near = np.bitwise_count(values[rest] ^ at) <= distance
                        if near.any():
                            found = rest[near]
                            low.append(np.full(len(found), at))
                            high.append(values[found])
                            front, rest = np.concatenate([front, found]), rest[~near]
            ends = [pa.array(np.concatenate(side).view(np.int64)) if side else pa.array([], pa.int64()) for side in (low, high)]
            yield pa.RecordBatch.from_arrays(ends, names=["a", "b"])

    return run


def hamming_links(prints: DataFrame, column: str, distance: int = 2) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints, at most ``distance`` bits apart, with the same components as all such pairs.

    ``prints`` has one row per distinct fingerprint. Files of one are dropped before anything is gathered; files
    of more than 1,024 go on to the next level.
    """
    members = prints.select(F.col(column).alias("bits"), F.lit(0).alias("choice"))
    links = None
    for level, masks in enumerate(block_masks(distance)):
        last = level == len(block_masks(distance)) - 1
        choices = {}
        for number, (parent, mask) in enumerate(masks):
            choices.setdefault(parent, []).append(F.struct(F.lit(number).alias("choice"), F.col("bits").bitwiseAND(F.lit(mask).cast("long")).alias("key")))
        own = None
        for parent, structs in choices.items():
            own = F.when(F.col("choice") == parent, F.array(*structs)) if own is None else own.when(F.col("choice") == parent, F.array(*structs))
        filed = members.select("bits", F.explode(own).alias("f")).select("bits", "f.choice", "f.key")
        sizes = staged(filed.groupBy("choice", "key").count().where("count > 1"), "file-sizes")
        small = filed.join(sizes if last else sizes.where(F.col("count") <= _FILE_LIMIT), ["choice", "key"])
        gathered = small.groupBy("choice", "key").agg(F.collect_list("bits").alias("prints")).select("prints")
        found = gathered.mapInArrow(_links(distance), "a long, b long")
        links = found if links is None else links.union(found)
        if last or sizes.where(F.col("count") > _FILE_LIMIT).limit(1).count() == 0:
            return links
        members = staged(filed.join(sizes.where(F.col("count") > _FILE_LIMIT), ["choice", "key"]).select("bits", "choice"), "large-files")
    raise AssertionError("the last level returns")


def _components(docs: DataFrame, distance: int, shingle: int) -> DataFrame:
    """doc_id, a hash of the text, fingerprint_bits and component_id of each row."""
    own = docs.select("doc_id", "text", F.xxhash64(text_of()).alias("text_hash"))
    own = staged(fingerprints(own, shingle).select("doc_id", "text_hash", "fingerprint_bits"), "fingerprints")
    nodes = staged(own.groupBy("fingerprint_bits").agg(F.min("doc_id").alias("first_doc")), "distinct-fingerprints")
    component = connected_components(hamming_links(nodes, "fingerprint_bits", distance), "a", "b")
    named = nodes.join(component.withColumnRenamed("node", "fingerprint_bits"), "fingerprint_bits", "left")
    named = named.select("fingerprint_bits", "first_doc", F.coalesce("component", "fingerprint_bits").alias("component"))
    first = named.groupBy("component").agg(F.min("first_doc").alias("component_id"))
    named = named.join(first, "component").select("fingerprint_bits", "component_id")
    return own.join(named, "fingerprint_bits")


def simhash_components(docs: DataFrame, distance: int = 2, shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint_bits and component_id of each document, one row per row of the input.

    Documents whose fingerprints are at most ``distance`` bits apart are linked, and ``component_id`` is the
    smallest doc_id that can be reached by links, the document's own included (null if all are null). A null text
    is an empty one. Equal fingerprints, hot groups of copies among them, are one node of the graph, so their
    number costs nothing but a partial count; documents without words share fingerprint 0 and are linked like any
    others. Repeated rows repeat their result. Other columns are not read.
    """
    return _components(docs, distance, shingle).select("doc_id", "fingerprint_bits", "component_id")


def simhash_dedup(docs: DataFrame, distance: int = 2, shingle: int = 3) -> DataFrame:
    """The documents that are the smallest doc_id of their component, once each, with all their columns.

    Of repeated rows (doc_id and text) one stays. Of a component with null ids only, each different text stays
    once; beside other ids, rows without an id go.
    """
    (key,) = unused_names(docs, "key")
    kept = _components(docs, distance, shingle).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = kept.select(F.struct("doc_id", "text_hash").alias(key))
    keyed = docs.withColumn(key, F.struct("doc_id", F.xxhash64(text_of()).alias("text_hash")))
    return keyed.join(kept, key, "left_semi").dropDuplicates([key]).select(*docs.columns)

"""Exact duplicates by an exchange of Golomb-coded fingerprints.

Every input partition sorts the 64-bit fingerprints of its texts and sends each owner of a range of fingerprints
one message: the differences of the sorted values, Golomb-Rice coded. An owner merges the messages it gets and
answers each sender with a bitmap of the fingerprints that occur more than once. The fingerprints marked in the
bitmaps are the suspects; only they are verified by the bytes of their texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from stratafold.llm.shared import WHITE, staged, text_of

_SENDER_PRINTS, _OWNER_PRINTS = 8_000_000, 4_000_000  # fingerprints that one partition sends, and that one owner merges, on average
_LEAST = 16  # owners, and senders, of a small table


def golomb_encode(sorted_values: np.ndarray, span: int) -> tuple[int, bytes]:
    """Rice parameter and code of ascending uint64 values that lie in a range of ``span``, relative to its start.

    Of each difference the quotient by 2^parameter is written in unary, then the remainders in binary.
    """
    n = len(sorted_values)
    gaps = np.diff(sorted_values, prepend=np.uint64(0))
    low = max(0, (span // max(n, 1)).bit_length() - 1)
    quotient = (gaps >> np.uint64(low)).astype(np.int64)
    unary = np.zeros(int(quotient.sum()) + n, dtype=np.uint8)
    unary[np.cumsum(quotient + 1) - 1] = 1  # zeros as many as the quotient, then a one
    rest = (gaps & np.uint64((1 << low) - 1)).astype(">u8").view(np.uint8).reshape(n, 8)
    binary = np.unpackbits(rest, axis=1)[:, 64 - low :]
    return low, np.packbits(np.concatenate([unary, binary.ravel()])).tobytes()


def golomb_decode(n: int, low: int, code: bytes) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(code, dtype=np.uint8))
    ends = np.flatnonzero(bits)[:n]  # the first n ones end the unary part
    quotient = np.diff(ends, prepend=-1) - 1
    begin = int(ends[-1]) + 1 if n else 0
    wide = np.zeros((n, 64), dtype=np.uint8)
    wide[:, 64 - low :] = bits[begin : begin + n * low].reshape(n, low)
    rest = np.packbits(wide, axis=1).view(">u8").ravel().astype(np.uint64)
    return np.cumsum((quotient.astype(np.uint64) << np.uint64(low)) + rest, dtype=np.uint64)


MESSAGE = "sender int, owner int, n long, low int, code binary, repeated binary"


def _send(owners: int):
    """One message to each owner: the partition's different fingerprints, and which of them it has more than once."""
    span = -(-(1 << 64) // owners)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [b.column("print").to_numpy(zero_copy_only=False).view(np.uint64) for b in batches]
        if not own:
            return
        values, times = np.unique(np.concatenate(own), return_counts=True)
        cuts = np.searchsorted(values, np.array([i * span for i in range(1, owners)], dtype=np.uint64))
        sender, rows = TaskContext.get().partitionId(), []
        for owner, (mine, many) in enumerate(zip(np.split(values, cuts), np.split(times > 1, cuts), strict=True)):
            if len(mine):
                low, code = golomb_encode(mine - np.uint64(owner * span), span)
                rows.append((sender, owner, len(mine), low, code, np.packbits(many).tobytes()))
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds], names=["sender", "owner", "n", "low", "code", "repeated"])

    return run


def _answer(messages: pd.DataFrame) -> pd.DataFrame:
    """An owner's bitmap for each message: fingerprints that it, or it and another, has more than once."""
    decoded = [golomb_decode(m.n, m.low, m.code) for m in messages.itertuples()]
    values, times = np.unique(np.concatenate(decoded), return_counts=True)
    many = values[times > 1]
    maps = [np.packbits(np.unpackbits(np.frombuffer(m.repeated, np.uint8), count=m.n).astype(bool) | np.isin(d, many)).tobytes() for m, d in zip(messages.itertuples(), decoded, strict=True)]
    return pd.DataFrame({"sender": messages["sender"], "owner": messages["owner"], "duplicates": maps})


def _suspects(owners: int):
    span = -(-(1 << 64) // owners)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros(0, dtype=np.int64)]
            for m in batch.to_pylist():
                marked = np.unpackbits(np.frombuffer(m["duplicates"], np.uint8), count=m["n"]).astype(bool)
                found.append((golomb_decode(m["n"], m["low"], m["code"])[marked] + np.uint64(m["owner"] * span)).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found))], names=["print"])

    return run


def suspect_prints(prints: DataFrame) -> DataFrame:
    """The different values of the long column ``print`` that occur more than once, by the exchange.

    ``prints`` must be a table that can be read again. A fingerprint is eight bytes, so that few partitions hold millions of them: the
    numbers of senders and owners follow the table's size, and a message holds a thousand values or more up to some 10^10 rows.
    A value with very many copies reaches its owner once from each partition.
    """
    rows = prints.count()
    owners = max(_LEAST, -(-rows // _OWNER_PRINTS))
    senders = max(_LEAST, -(-rows // _SENDER_PRINTS))
    messages = staged(prints.select("print").coalesce(senders).mapInArrow(_send(owners), MESSAGE), "golomb-messages")
    bitmaps = messages.groupBy("owner").applyInPandas(_answer, "sender int, owner int, duplicates binary")
    marked = messages.join(bitmaps, ["sender", "owner"]).select("sender", "owner", "n", "low", "code", "duplicates")
    return marked.mapInArrow(_suspects(owners), "print long").distinct()


def normal_text() -> Column:
    """The text with every run of ASCII white space as one space; empty for null."""
    return F.regexp_replace(text_of(), WHITE, " ")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """Per row of the input: doc_id, keep_id, group_size, kept and text_sha256.

    Texts are equal when they are after every run of white space is made one space; a null text is an empty one.
    Of equal texts the row with the smallest doc_id stays (ids before null ids; of repeated rows with that id, one). The
    groups are those whose texts were compared byte by byte; a hot group combines before it is shuffled, to one
    row for each task. Should two different texts share a SHA-256, the job stops with an error instead of joining
    them. Other columns are not read.
    """
    digest = F.sha2("normal", 256)
    own = docs.select("doc_id", normal_text().alias("normal"))
    own = own.select("doc_id", digest.alias("text_sha256"), F.xxhash64("normal").alias("print"), F.monotonically_increasing_id().alias("row"))
    own = staged(own, "text-prints")
    suspects = staged(suspect_prints(own), "suspects")
    # byte verification: suspects' texts, grouped by all their bytes
    texts = docs.select(normal_text().alias("normal")).withColumn("print", F.xxhash64("normal")).join(suspects, "print", "left_semi")
    texts = texts.groupBy("print", "normal").agg(F.count("*").alias("copies")).select(digest.alias("text_sha256"), "copies")
    texts = texts.groupBy("text_sha256").agg(F.count("*").alias("texts"), F.sum("copies").alias("group_size"))
    sure = F.when(F.col("texts") == 1, F.col("group_size")).otherwise(F.raise_error(F.lit("different texts share a SHA-256")).cast("long"))
    stays = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    first = own.join(suspects, "print", "left_semi").groupBy("text_sha256").agg(stays.alias("stays"))
    groups = first.join(texts, "text_sha256").select("text_sha256", "stays", sure.alias("group_size"))
    # from a table, so that the groups bring no partitioning into the join and a hot group's rows can be split
    found = own.join(staged(groups, "duplicate-groups"), "text_sha256", "left")
    return found.select(
        "doc_id",
        F.when(F.col("stays").isNull(), F.col("doc_id")).otherwise(F.col("stays.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("row") == F.col("stays.row"), F.lit(True)).alias("kept"),
        "text_sha256",
    )

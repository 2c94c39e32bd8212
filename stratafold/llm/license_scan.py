"""License notices in whole texts by diagonal voting.

All rolling word k-gram hashes of the documents are joined with the positions of the same hashes in the
templates. A hit at word i of a document and word j of a template votes for the diagonal i - j: a notice that
stands in the text unchanged puts all its votes on one diagonal, an added or missing word moves the rest to a
neighbouring one. Neighbouring diagonals are merged, and a span is accepted when enough of the template's words
are covered by grams whose words are equal, not only their hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from stratafold.llm.shared import text_of

_KEY = ["doc_id", "text_hash"]
_GROUP_CHARS = 4_000_000  # texts handled together in a task
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93  # odd, so that they have inverses


@dataclass(frozen=True)
class Template:
    """A notice in lower-case words. An exact one must stand consecutively and whole; ``k`` words make a gram."""

    label: str
    words: str
    k: int
    exact: bool = False


# The phrases and labels that are always searched.
BASE = (
    Template("cc-by", "cc by", 2, exact=True),
    Template("gpl", "general public license", 2, exact=True),
    Template("reserved", "all rights reserved", 2, exact=True),
)

# Opening words of public license notices.
NOTICES = (
    Template("apache", "licensed under the apache license version 2 0", 3),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", 3),
    Template("cc-by-nc", "licensed under cc by nc 4 0", 3),
    Template("gpl", "this work is licensed under the gnu general public license version 3", 3),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", 3),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 3),
    Template("mit", "released under the mit license", 3),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", 3),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", 3),
)

_MAX_TEMPLATE_WORDS = 100_000  # in all templates together: bounds what is broadcast


def template_grams(spark: SparkSession, templates: tuple[Template, ...]) -> DataFrame:
    """One row for each gram of each template. Its size is checked, because it is broadcast."""
    rows = []
    for number, t in enumerate(templates):
        words = t.words.split()
        if len(words) < t.k:
            raise ValueError(f"template {t.words!r} has fewer than {t.k} words")

        rows += [(number, t.label, t.exact, len(words), t.k, j, words[j : j + t.k]) for j in range(len(words) - t.k + 1)]
    if len(rows) > _MAX_TEMPLATE_WORDS:
        raise ValueError(f"templates have {len(rows)} grams, more than {_MAX_TEMPLATE_WORDS}")
    hashes = [int(gram_hashes(" ".join(row[-1]).encode(), [row[4]])[2][0]) for row in rows]
    return spark.createDataFrame(
        [(*row, h) for row, h in zip(rows, hashes, strict=True)], "template int, label string, exact boolean, t_words int, k int, t_pos int, t_gram array<string>, hash long"
    )


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def gram_hashes(text: bytes, sizes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all words, where each word begins among them (and the end), and the rolling hashes by gram size.

    Words are runs of ASCII letters and digits and of anything beyond ASCII, after A-Z are lower-cased. A word's
    hash is a difference of running sums over its bytes; that of a gram, of one over its words. Hashes of grams
    that would reach beyond the last word are left out.
    """
    folded = np.frombuffer(text.translate(_FOLD), dtype=np.uint8)
    inside = folded != 32
    begins = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    own = folded[inside]
    offsets = np.append(np.cumsum(inside)[begins] - 1, len(own)) if len(begins) else np.zeros(1, dtype=np.int64)
    n = len(offsets) - 1
    with np.errstate(over="ignore"):
        total = np.concatenate([[np.uint64(0)], np.cumsum((own.astype(np.uint64) + np.uint64(1)) * _powers(_BYTE_BASE, len(own)), dtype=np.uint64)])
        back = _powers(pow(_BYTE_BASE, -1, 1 << 64), len(own) + 1)
        word = (total[offsets[1:]] - total[offsets[:-1]]) * back[offsets[:-1]]
        word ^= word >> np.uint64(29)
        word *= np.uint64(_WORD_BASE)
        word ^= word >> np.uint64(32)
        total = np.concatenate([[np.uint64(0)], np.cumsum(word * _powers(_WORD_BASE, n), dtype=np.uint64)])
        back = _powers(pow(_WORD_BASE, -1, 1 << 64), n + 1)
        grams = [(total[k:] - total[: n + 1 - k]) * back[: n + 1 - k] if k <= n else total[:0] for k in sizes]
    return own, offsets, np.concatenate(grams).view(np.int64)


def _with_grams(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """Per document: its words, and the rolling hashes of every gram size one after the other."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, start = batch.column("text").to_pylist(), 0
            while start < len(texts):
                end, chars = start, 0
                while end < len(texts) and (end == start or chars + len(texts[end]) <= _GROUP_CHARS):
                    chars += len(texts[end])
                    end += 1
                parts = [gram_hashes(t.encode(), sizes) for t in texts[start:end]]
                letters = np.concatenate([own for own, _, _ in parts])
                before = np.cumsum([0, *(len(own) for own, _, _ in parts)])
                ends = np.concatenate([[0], *(offsets[1:] + shift for (_, offsets, _), shift in zip(parts, before[:-1], strict=True))])
                words = pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(letters)).cast(pa.string())
                per_doc = lambda sizes: pa.array(np.cumsum([0, *sizes]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).slice(start, end - start) for c in _KEY),
                        pa.ListArray.from_arrays(per_doc(len(offsets) - 1 for _, offsets, _ in parts), words),
                        pa.ListArray.from_arrays(per_doc(len(h) for _, _, h in parts), pa.array(np.concatenate([h for _, _, h in parts]))),
                    ],
                    names=[*_KEY, "words", "hashes"],
                )
                start = end

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64(text_of()).alias("text_hash"), text_of().alias("text")).mapInArrow(
        hashed, f"doc_id {kind}, text_hash long, words array<string>, hashes array<long>"
    )


def _hits(docs: DataFrame, templates: tuple[Template, ...]) -> DataFrame:
    """Verified gram hits, and one row per document with template null. Nothing is shuffled.

    The text's hash is part of the key, so that rows which share a doc_id but not the text stay apart.
    """
    sizes = sorted({t.k for t in templates})
    grams = F.broadcast(template_grams(docs.sparkSession, templates))
    # entry 0 stands for the document itself, so that one pass serves documents with and without hits
    hashed = _with_grams(docs, sizes).withColumns({"n_words": F.size("words"), "hashes": F.concat(F.array(F.lit(0).cast("long")), "hashes")})
    rows = hashed.select("doc_id", "text_hash", "words", "n_words", F.posexplode_outer("hashes").alias("entry", "d_hash"))
    first, k, pos = F.lit(1), F.lit(None).cast("int"), F.lit(-1)
    for size in sizes:  # which gram size an entry belongs to, and where its words stand
        k = F.when(F.col("entry") >= first, size).otherwise(k)
        pos = F.when(F.col("entry") >= first, F.col("entry") - first).otherwise(pos)
        first = first + F.greatest(F.col("n_words") - (size - 1), F.lit(0))
    rows = rows.withColumns({"pos": pos, "d_k": k})
    # the words themselves are compared only where the hashes agree
    same = (F.col("d_hash") == F.col("hash")) & (F.col("d_k") == F.col("k")) & (F.slice("words", F.col("pos") + 1, F.col("k")) == F.col("t_gram"))
    hit = rows.join(grams, same, "left")
    return hit.where((F.col("pos") == -1) | F.col("template").isNotNull()).select(
        "doc_id", "text_hash", F.col("n_words").cast("long").alias("n_words"), "pos", "template", "label", "exact", "t_words", "k", "t_pos"
    )


def _spans(hits: DataFrame, shift: int, min_share: float) -> DataFrame:
    """Accepted spans, and for each document one row with template null that counts its rows."""
    notice = [*_KEY, "template"]
    diagonals = (
        hits.withColumn("diagonal", F.when(F.col("template").isNotNull(), F.col("pos") - F.col("t_pos")))
        .groupBy(*notice, "diagonal")
        .agg(
            F.first("n_words").alias("n_words"), F.first("label").alias("label"), F.first("exact").alias("exact"),
            F.first("t_words").alias("t_words"), F.first("k").alias("k"), F.collect_set("t_pos").alias("t_pos"),
            F.min("pos").alias("start"), F.max("pos").alias("last"), F.count("*").alias("votes"),
        )
    )
    along = Window.partitionBy(*notice).orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > F.when(F.col("exact"), 0).otherwise(shift), F.lit(False))
    grouped = diagonals.withColumn("cluster", F.sum(apart.cast("int")).over(along))
    covered = F.size(F.array_distinct(F.flatten(F.transform(F.flatten(F.collect_set("t_pos")), lambda p: F.sequence(p, p + F.first("k") - 1)))))
    return (
        grouped.groupBy(*notice, "cluster")
        .agg(
            F.first("n_words").alias("n_words"), F.first("label").alias("label"), F.first("exact").alias("exact"), F.first("t_words").alias("t_words"),
            F.min("start").cast("long").alias("start_word"), (F.max("last") + F.first("k")).cast("long").alias("end_word"),
            F.sum("votes").alias("votes"), F.when(F.first("template").isNotNull(), covered).alias("covered"),
        )
        .withColumn("share", F.col("covered") / F.col("t_words"))
        .where(F.col("template").isNull() | F.when(F.col("exact"), F.col("share") == 1.0).otherwise(F.col("share") >= min_share))
    )


def license_spans(docs: DataFrame, templates: tuple[Template, ...] = BASE + NOTICES, shift: int = 2, min_share: float = 0.6) -> DataFrame:
    """Accepted notices: doc_id, label, exact, start_word, end_word (one past the last), covered, share."""
    return _spans(_hits(docs, templates), shift, min_share).where(F.col("template").isNotNull()).select("doc_id", "label", "exact", "start_word", "end_word", "covered", "share")


def scan_licenses(docs: DataFrame, base: tuple[Template, ...] = BASE, notices: tuple[Template, ...] = NOTICES, shift: int = 2, min_share: float = 0.6) -> DataFrame:
    """One row per document: how many base phrases stand where, and the labels found.

    ``base`` phrases count at every place where all their words stand consecutively. ``notices`` add their
    labels where at least ``min_share`` of their words are covered on diagonals at most ``shift`` apart.
    ``score`` is the largest covered share of an accepted notice, 0 without one. A null text is an empty one
    (0 words, empty labels, null positions). Rows that repeat doc_id and text get one result each; rows that
    share only the doc_id are judged apart. A null doc_id is a key like any other. Other columns of the input
    are not read. What is shuffled are hits and one narrow row per document, never texts or grams.
    """
    spans = _spans(_hits(docs, tuple(base) + tuple(notices)), shift, min_share)
    own, labelled = F.col("template").isNull(), F.col("template").isNotNull()
    labels = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    result = spans.groupBy(*_KEY).agg(
        F.max("n_words").alias("n_words"),
        F.count(F.when(F.col("exact"), 1)).alias("n_base"),
        F.min(F.when(F.col("exact"), F.col("start_word"))).alias("first_word"),
        F.max(F.when(F.col("exact"), F.col("start_word"))).alias("last_word"),
        labels(F.when(F.col("exact"), F.col("label"))).alias("base_labels"),
        labels(F.when(labelled, F.col("label"))).alias("labels"),
        F.coalesce(F.max("share"), F.lit(0.0)).alias("score"),
        F.max(F.when(own, F.col("votes"))).alias("copies"),
    )
    once = F.sequence(F.lit(1).cast("long"), F.col("copies"))
    return result.withColumn("copy", F.explode(once)).drop("copy", "copies", "text_hash")

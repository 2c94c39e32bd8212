"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from stratafold.llm.ragged import groups_of, text_slices
from stratafold.llm.shared import staged, text_of, unused_names

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
_BLOCK_LANGUAGES = 512  # languages scored together: bounds the matrix that is broadcast (64 MB); more come in further blocks
_GROUP_CHARS = 300_000  # texts scored together
_CELLS = 1 << 23  # numbers gathered from the matrix at a time
_CHUNK = 1 << 18  # characters whose n-grams are counted together
_FACTORS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], dtype=np.uint32)
UNKNOWN = "und"


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def ngram_counts(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """Occurrences of the text's 1- to 3-grams by bucket. What is no letter counts as a space; grams of spaces only do not count."""
    counts, text = np.zeros(buckets, dtype=np.int64), text.lower()
    widest = max(ORDERS)
    for start in range(0, len(text), _CHUNK):
        part = text[start : start + _CHUNK + widest - 1]  # n-grams that begin in the chunk
        codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        letter = _letters()[codes]
        codes = np.where(letter, codes, 32).astype(np.uint32)
        begins = min(_CHUNK, len(text) - start)
        for n in ORDERS:
            m = min(begins, len(codes) - n + 1)
            if m <= 0:
                break
            mixed, any_letter = np.full(m, n, dtype=np.uint32), np.zeros(m, dtype=bool)
            for i in range(n):
                mixed = (mixed ^ codes[i : i + m]) * _FACTORS[i]
                mixed ^= mixed >> np.uint32(15)
                any_letter |= letter[i : i + m]
            counts += np.bincount((mixed[any_letter] * np.uint32(0x27D4EB2F)) >> np.uint32(32 - buckets.bit_length() + 1), minlength=buckets)
    return counts


def held_out(key: str = "doc_id") -> Column:
    """Documents kept from training: CRC-32 of the id as text leaves 2 by 4. A null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit_language_counts(labelled: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """lang, bucket, n over all rows with text and lang; bucket -1 counts the documents.

    A task adds up its own rows, and sends one row for each language and bucket it has seen.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: dict[str, np.ndarray] = {}
        documents: dict[str, int] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if lang not in grams:
                    grams[lang], documents[lang] = np.zeros(buckets, dtype=np.int64), 0
                grams[lang] += ngram_counts(text, buckets)
                documents[lang] += 1
        for lang, counts in grams.items():
            seen = np.flatnonzero(counts)
            n = np.append(counts[seen], documents[lang])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n)), pa.array(np.append(seen, -1).astype(np.int32)), pa.array(n)], names=["lang", "bucket", "n"])

    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), "text")
    return rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def text_buckets(texts: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all texts at once, (text, bucket, n) of the buckets each text has, by text and bucket."""
    lowered = [t.lower() for t in texts]
    data = "\n".join(lowered).encode("utf-32-le", "surrogatepass")
    codes = np.frombuffer(data, dtype=np.uint32)
    sizes = np.fromiter(map(len, lowered), dtype=np.int64, count=len(texts))
    text = np.repeat(np.arange(len(texts)), sizes + 1)[: len(codes)]  # a text and the break behind it
    room = np.repeat(np.cumsum(sizes + 1) - 1, sizes + 1)[: len(codes)] - np.arange(len(codes))  # characters left in the text
    letter = _letters()[codes]
    codes = np.where(letter, codes, 32).astype(np.uint32)
    keys = []
    for n in ORDERS:
        m = len(codes) - n + 1
        if m <= 0:
            break
        mixed, any_letter = np.full(m, n, dtype=np.uint32), np.zeros(m, dtype=bool)
        for i in range(n):
            mixed = (mixed ^ codes[i : i + m]) * _FACTORS[i]
            mixed ^= mixed >> np.uint32(15)
            any_letter |= letter[i : i + m]
        inside = any_letter & (room[:m] >= n)
        bucket = (mixed[inside] * np.uint32(0x27D4EB2F)) >> np.uint32(32 - buckets.bit_length() + 1)
        keys.append(text[:m][inside] * buckets + bucket)
    key, n = np.unique(np.concatenate(keys) if keys else np.zeros(0, dtype=np.int64), return_counts=True)
    return key // buckets, key % buckets, n


class LanguageModel:
    """Log-probabilities of buckets (rows) by language (columns), in the order of the names.

    ``documents`` is the number of training documents of all languages, if the model holds a block of them only.
    """

    def __init__(self, counts: list[tuple[str, int, int]], buckets: int = BUCKETS, alpha: float = 0.5, documents: int | None = None) -> None:
        self.languages = sorted({lang for lang, _, _ in counts})
        column = {lang: i for i, lang in enumerate(self.languages)}
        grams, own = np.zeros((buckets, len(self.languages))), np.zeros(len(self.languages))
        for lang, bucket, n in counts:
            if bucket < 0:
                own[column[lang]] = n
            else:
                grams[bucket, column[lang]] = n
        self.buckets = buckets
        self.bucket_scores = (np.log(grams + alpha) - np.log(grams.sum(axis=0) + alpha * buckets)).astype(np.float32)
        self.prior = np.log(own / (documents or own.sum())) if len(own) else own

    def totals(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log joint probability of each text (rows) and language, and how many n-grams the text has.

        All texts are scored as one sparse matrix: their buckets' rows of the model are gathered, weighed and added up by text.
        """
        if len(texts) == 1 and len(texts[0]) > _GROUP_CHARS:  # its grams are counted by parts
            counts = ngram_counts(texts[0], self.buckets)
            (bucket,) = np.nonzero(counts)
            text, n = np.zeros(len(bucket), dtype=np.int64), counts[bucket]
        else:
            text, bucket, n = text_buckets(texts, self.buckets)
        total = np.tile(self.prior, (len(texts), 1))
        step = max(1, _CELLS // max(1, len(self.languages)))
        for start in range(0, len(text), step):
            own = text[start : start + step]
            first = np.flatnonzero(np.diff(own, prepend=-1))
            part = self.bucket_scores[bucket[start : start + step]] * n[start : start + step, None].astype(np.float64)
            total[own[first]] += np.add.reduceat(part, first)
        return total, np.bincount(text, weights=n, minlength=len(texts)).astype(np.int64)

    def judge(self, texts: list[str]) -> tuple[list[str | None], np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its log joint probability, the log of the sum over languages, and the mean log-probability of an n-gram; none without a letter."""
        names: list[str | None] = [None] * len(texts)
        top, whole, mean = np.full(len(texts), -np.inf), np.full(len(texts), -np.inf), np.full(len(texts), -np.inf)
        heard = [i for i, t in enumerate(texts) if t and self.languages and has_letter(t)]
        for a, b in groups_of([len(texts[i]) for i in heard], _GROUP_CHARS):
            total, grams = self.totals([texts[i] for i in heard[a:b]])
            best = total.argmax(axis=1)
            at = np.array(heard[a:b])
            top[at] = total[np.arange(b - a), best]
            whole[at] = top[at] + np.log(np.exp(total - top[at][:, None]).sum(axis=1))
            mean[at] = (top[at] - self.prior[best]) / np.maximum(grams, 1)
            for i, k in zip(at.tolist(), best.tolist()):
                names[i] = self.languages[k]
        return names, top, whole, mean


def _blocks(counts: DataFrame, buckets: int) -> Iterator[LanguageModel]:
    """Models of at most ``_BLOCK_LANGUAGES`` languages each, from the counted buckets."""
    own = counts.where("bucket = -1")
    documents = own.agg(F.sum("n")).first()[0]
    last = None
    while True:
        rest = own if last is None else own.where(F.col("lang") > last)
        names = [r[0] for r in rest.select("lang").orderBy("lang").limit(_BLOCK_LANGUAGES).collect()]
        if names or last is None:
            found = counts.where(F.col("lang").between(names[0], names[-1])).collect() if names else []
            yield LanguageModel([tuple(r) for r in found], buckets, documents=documents)
        if len(names) < _BLOCK_LANGUAGES:
            return
        last = names[-1]


def _judge(shared):
    """What a broadcast model says of texts."""

    @F.arrow_udf("struct<lang:string,top:double,whole:double,mean:double>")
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in text_slices(batches):
            names, top, whole, mean = shared.value.judge(texts.to_pylist())
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), *map(pa.array, (top, whole, mean))], names=["lang", "top", "whole", "mean"])

    return judge


def judge_languages(docs: DataFrame, train: DataFrame, buckets: int = BUCKETS, column: str = "judged") -> DataFrame:
    """Add a struct (lang, score, mean): the most probable language of the training rows, its probability, and the mean log-probability it gives an n-gram.

    Of equally probable languages the first by name counts. Where the text is null, empty or without a letter, or nothing could be learned,
    lang is ``und``, score 0 and mean null. Whole texts are read, and each row is judged by itself. The counts are taken once, and come to the
    driver for at most 512 languages at a time; further languages are scored in passes of their own, which keep the best so far.
    """
    counts = staged(fit_language_counts(train, buckets), "language-counts")
    kept = [c for c in docs.columns if c != column]
    table, so_far = docs.select(F.struct(*kept).alias("row"), text_of().alias("text")), None
    for number, model in enumerate(_blocks(counts, buckets)):
        shared = docs.sparkSession.sparkContext.broadcast(model)

        table = table.withColumn(f"own{number}", _judge(shared)("text"))
        own = F.col(f"own{number}")
        if so_far is not None:
            better = F.when(F.col("best.top") >= own["top"], F.col("best")).otherwise(own)
            large, small = F.greatest(F.col("best.whole"), own["whole"]), F.least(F.col("best.whole"), own["whole"])
            whole = F.when(large == float("-inf"), large).otherwise(large + F.log1p(F.exp(small - large)))
            own = F.struct(better["lang"].alias("lang"), better["top"].alias("top"), whole.alias("whole"), better["mean"].alias("mean"))
            table = staged(table.select("row", "text", own.alias("best")), "languages")
        else:
            table = table.select("row", "text", own.alias("best"))
        so_far = number
    best, known = F.col("best"), F.col("best.lang").isNotNull()
    judged = F.struct(
        F.coalesce(best["lang"], F.lit(UNKNOWN)).alias("lang"),
        F.when(known, F.exp(best["top"] - best["whole"])).otherwise(0.0).alias("score"),
        F.when(known, best["mean"]).alias("mean"),
    )
    return table.select(*[F.col("row").getField(c).alias(c) for c in kept], judged.alias(column))


def identify_languages(docs: DataFrame, train: DataFrame, buckets: int = BUCKETS, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Add lang_pred and score (or two other ``names``) to each document, as ``judge_languages`` finds them by a model of all rows of ``train`` (text, lang).

    Columns of these names are replaced; no others than the text are used.
    """
    (judged,) = unused_names(docs, "judged")
    found = judge_languages(docs, train, buckets, judged)
    return found.withColumns({names[0]: F.col(judged)["lang"], names[1]: F.col(judged)["score"]}).drop(judged)


def keep_fluent(docs: DataFrame, learns: Column, sds: float = 6.0, buckets: int = BUCKETS) -> DataFrame:
    """The documents whose n-grams are about as probable, in their most probable language, as those of its training rows.

    ``learns`` tells the training rows among ``docs`` (text, lang). For each language the mean and standard deviation, over the training rows found to
    be in it, of the mean log-probability of an n-gram are taken. A document goes that lies more than ``sds`` standard deviations (at least 0.02) below;
    three times as many for texts of under 200 characters, whose means vary more. Texts without a letter go. A language whose
    training rows are all alike, as a single one is, rejects nothing. Columns stay as they are, repeated rows are judged alike, and a null ``learns`` is no training row.
    """
    judged, learn, mean, sd, lang = unused_names(docs, "judged", "learn", "mean", "sd", "lang")
    train = docs.where(F.coalesce(learns, F.lit(False)))
    found = staged(judge_languages(docs.withColumn(learn, F.coalesce(learns, F.lit(False))), train, buckets, judged), "judged", batch_rows=1_000)
    own = F.col(judged)
    usual = found.where(F.col(learn) & (own["lang"] == F.col("lang"))).groupBy(own["lang"].alias(lang)).agg(F.avg(own["mean"]).alias(mean), F.stddev_pop(own["mean"]).alias(sd))
    near = found.where(own["lang"] != UNKNOWN).join(usual, F.col(lang) == own["lang"], "left")
    allowed = F.when(F.length("text") < 200, 3 * sds).otherwise(sds) * F.greatest(F.col(sd), F.lit(0.02))
    return near.where(F.coalesce((F.col(sd) == 0) | (own["mean"] >= F.col(mean) - allowed), F.lit(True))).select(*docs.columns)

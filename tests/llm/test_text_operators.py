"""Token counts, license scans, language identification and line dedup against plain versions of each."""

import collections
import functools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stratafold.llm import language_id, license_scan, line_spread, token_counts
from stratafold.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
EDGE = [(1, None), (2, ""), (3, " \n\t "), (4, "CC BY 4.0"), (4, "CC BY 4.0"), (None, "All rights reserved."), (None, None), (7, "word " * 30_000 + "general public license")]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, "doc_id long, text string").withColumns({"n_tokens": F.lit("mine"), "score": F.lit("mine"), "lang": F.lit("en"), "source": F.lit(None).cast("string")})


def texts_at_random(n, letters="abc  \n\t'sdtre<|endoftext|>é漢字١٢3   .,!\U0001f600ß"):
    rng = random.Random(3)
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_token_counter_equals_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = texts_at_random(3000) + ["", "a" * 5000, "ab" * 3000, "  x", "x  ", "<|endoftext|> a<|endoftext|>", "don't  'll we've", "漢字" * 2000]
    with open(path, encoding="utf-8") as file:
        counter = token_counts.TokenCounter(file.read())
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert counter.counts(texts).tolist() == want
    assert counter.counts(texts[::-1]).tolist() == want[::-1]  # from what it knows by now


def test_merger_takes_every_other_pair_of_a_run():
    merger = token_counts.RaggedMerger({**{c: i for i, c in enumerate(token_counts.byte_symbols())}, "aa": 256, "aaaa": 257}, [("a", "a"), ("aa", "aa")])
    assert merger.counts([b"a" * n for n in range(10)] + [b"", b"bab"]).tolist() == [0, 1, 1, 2, 1, 2, 2, 3, 2, 3, 0, 3]


def test_token_counts_query(spark, documents):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op1_token_counts"](spark, SF).collect()}
    rows = documents.select("doc_id", "text").collect()
    ids = library.encode_batch([r.text or "" for r in rows], add_special_tokens=False)
    assert got == {r.doc_id: (len((r.text or "").encode()), len(e.ids), len(e.ids) > 512) for r, e in zip(rows, ids, strict=True)}


def test_token_counts_of_edge_cases(edge):
    path = public_tokenizers.path("byte_bpe_50k.json")
    counted = token_counts.count_tokens(edge, path)
    rows = {(r.doc_id, r.text): (r.n_bytes, r.n_tokens, r.over_limit) for r in counted.collect()}
    assert rows[(1, None)] == rows[(2, "")] == rows[(None, None)] == (0, 0, False)
    assert rows[EDGE[-1]][2] and counted.count() == len(EDGE) and counted.columns.count("n_tokens") == 1
    assert token_counts.count_tokens(edge.limit(0), path).collect() == []


def plain_licenses(text):
    fold = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(fold))
    places = [(i, t.label) for t in license_scan.BASE for i in range(len(words)) if words[i : i + len(t.words.split())] == t.words.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in places}))


def test_license_scan_query(spark, documents):
    got = {r.doc_id: r for r in QUERIES["op2_license_scans"](spark, SF).collect()}
    rows = documents.collect()
    assert len(got) == len(rows)
    for r in rows:
        g = got[r.doc_id]
        assert (g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels) == plain_licenses(r.text)
        assert set(filter(None, g.base_labels.split(","))) <= set(filter(None, g.labels.split(","))) and 0 <= g.score <= 1


def test_license_notices_survive_edits(spark):
    notice = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    changed = notice.replace("to any person", "to any natural person").replace("software and", "software &")
    rows = [(1, f"so {notice} so"), (2, f"so {changed} so"), (3, "permission is hereby granted"), (4, "to any person obtaining a copy " * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.labels for r in license_scan.scan_licenses(docs).collect()} == {1: "mit", 2: "mit", 3: "", 4: ""}
    spans = {r.doc_id: (r.start_word, r.end_word) for r in license_scan.license_spans(docs).collect()}
    assert spans[1] == (1, 21) and spans[2] == (1, 21)  # a word more, a word less


def test_license_scan_of_edge_cases(edge):
    rows = [(r.doc_id, r.n_words, r.n_base, r.base_labels) for r in license_scan.scan_licenses(edge).collect()]
    want = [(d, *(plain_licenses(t)[i] for i in (0, 1, 4))) for d, t in EDGE]
    assert sorted(rows, key=str) == sorted(want, key=str)
    assert license_scan.scan_licenses(edge.limit(0)).collect() == []


def test_gram_hashes_depend_on_the_words_only():
    one = license_scan.gram_hashes(b"The cat sat, on the CAT sat", [2, 3])[2]
    two = license_scan.gram_hashes(b"x the cat sat", [2, 3])[2]
    assert one[0] == one[4] == two[1] and one[6] == two[4] and len(one) == 6 + 5 and len(set(one.tolist())) == 8
    assert [len(a) for a in license_scan.gram_hashes(b" .,", [2, 3])] == [0, 1, 0]


def test_language_query_learns_from_the_rest_only(spark, documents):
    rows = QUERIES["op3_language_id"](spark, SF).collect()
    truth = {r.doc_id: r.lang for r in documents.collect()}
    assert len(rows) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out and truth[r.doc_id]]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_model_equals_brute_force(spark):
    rng = random.Random(5)
    make = lambda letters: "".join(rng.choice(letters) for _ in range(60))
    train = [("x", make("abc de")) for _ in range(9)] + [("y", make("cde fg")) for _ in range(4)] + [(None, "abc"), ("x", None)]
    docs = spark.createDataFrame([(i, lang, text) for i, (lang, text) in enumerate(train)], "doc_id long, lang string, text string")
    got = {r.text: (r.lang_pred, r.score) for r in language_id.identify_languages(docs, docs).collect()}
    known = [(lang, text) for lang, text in train if lang and text]
    grams = {lang: sum(language_id.ngram_counts(t) for own, t in known if own == lang) for lang in "xy"}
    for _, text in train:
        if text is None:
            assert got[text] == ("und", 0.0)
            continue
        own = language_id.ngram_counts(text)
        logs = [np.log(sum(lang == own_lang for own_lang, _ in known) / len(known)) + own @ (np.log(g + 0.5) - np.log(g.sum() + 0.5 * len(g))) for lang, g in grams.items()]
        best = int(np.argmax(logs))
        assert got[text][0] == "xy"[best] and got[text][1] == pytest.approx(1 / np.exp(np.array(logs) - logs[best]).sum(), abs=1e-3)


def test_long_texts_are_counted_in_whole(monkeypatch):
    text = " ".join(texts_at_random(40, "abc déf! "))
    whole = language_id.ngram_counts(text)
    monkeypatch.setattr(language_id, "_CHUNK", 7)
    assert (language_id.ngram_counts(text) == whole).all() and language_id.ngram_counts("").sum() == 0


def plain_grams(text):
    """Every 1- to 3-gram of the lower-case text, what is no letter as a space, but those of spaces only."""
    line = "".join(c if c.isalpha() else " " for c in text.lower())
    return [line[i : i + n] for n in (1, 2, 3) for i in range(len(line) - n + 1) if line[i : i + n].strip()]


def test_buckets_of_a_batch_are_the_grams_of_each_text():
    texts = [*texts_at_random(300, "abc déf!12\n漢 "), "", "a", " ", "ß"]

    def counted(batch):
        out = [collections.Counter() for _ in batch]
        for i, b, n in zip(*(a.tolist() for a in language_id.text_buckets(batch))):
            out[i][b] += n
        return out

    @functools.cache
    def bucket(gram):
        """What a gram adds to the buckets of its own grams."""
        (own,) = counted([gram])
        for g in plain_grams(gram):
            if g != gram:
                own.subtract(bucket(g))
        return own

    for text, got in zip(texts, counted(texts), strict=True):
        want = collections.Counter()
        for g in plain_grams(text):
            want.update(bucket(g))
        assert +want == got and sum(got.values()) == len(plain_grams(text))
        assert got == collections.Counter({b: n for b, n in enumerate(language_id.ngram_counts(text).tolist()) if n})


def test_languages_come_in_blocks(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(i, f"l{i % 7}", "".join(rng.choice("abcdefg"[i % 7 :] + "xyz ") for _ in range(80))) for i in range(210)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").withColumn("best", F.lit("mine"))
    whole = language_id.identify_languages(docs, docs)
    want = {r.doc_id: (r.lang_pred, r.score) for r in whole.collect()}
    monkeypatch.setattr(language_id, "_BLOCK_LANGUAGES", 3)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify_languages(docs, docs).collect()}
    assert whole.columns == ["doc_id", "lang", "text", "best", "lang_pred", "score"] and len({p for p, _ in want.values()}) > 4
    assert all(got[d][0] == want[d][0] and got[d][1] == pytest.approx(want[d][1], rel=1e-6) for d in want)


def test_texts_in_no_learned_language_go(spark, documents):
    strange = ["Быстрая коричневая лиса прыгает через ленивую собаку и убегает в тёмный лес.", "これは日本語の文章です。今日は天気がとてもいいですね。", "aaaa bbbb", "<div><p><b></b></p></div>" * 9, "12 34 !"]
    rows = [(10**6 + i, t, None) for i, t in enumerate(strange)]
    more = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    docs = documents.select("doc_id", "text", "lang").unionByName(more).withColumn("judged", F.lit("mine"))
    kept = {r.doc_id for r in language_id.keep_fluent(docs, ~language_id.held_out()).collect()}
    assert {10**6, 10**6 + 1, 10**6 + 4}.isdisjoint(kept)
    clean = documents.where("lang is not null and length(text) > 200").count()
    assert documents.where("lang is not null and length(text) > 200").where(F.col("doc_id").isin(list(kept))).count() >= 0.98 * clean


def test_language_of_edge_cases(edge):
    rows = language_id.identify_languages(edge, edge).collect()
    assert len(rows) == len(EDGE) and all((r.lang_pred == "und") == (not r.text or not any(map(str.isalpha, r.text))) for r in rows)
    assert {r.lang_pred for r in language_id.identify_languages(edge, edge.limit(0)).collect()} == {"und"}
    assert language_id.identify_languages(edge.limit(0), edge).collect() == []


def test_boilerplate_goes_from_every_document(spark):
    rows = [(i, f"own line {i}\n Cookie notice \n\nshared", f"site{i % 12}") for i in range(24)] + [(90, "shared\nCookie notice\nshared", None), (91, None, "site0"), (92, "", None)]
    rows += [(93, "one site only\n" * 50, "site3")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_cut", F.lit("mine"))
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_cut) for r in line_spread.strip_boilerplate(docs, min_sites=13).collect()), key=str)
    want = [(i, f"own line {i}\n", 3, 2) for i in range(24)] + [(90, "", 3, 3), (91, None, 0, 0), (92, "", 0, 0)] + [(93, "one site only\n" * 50, 50, 0)] * 2
    assert got == sorted(want, key=str)
    kept = {r.doc_id: r.n_cut for r in line_spread.strip_boilerplate(docs, min_sites=14).collect()}
    assert set(kept.values()) == {0}  # thirteen sites, with the null one
    assert line_spread.strip_boilerplate(docs.limit(0)).collect() == []


def test_far_lines_are_decided_by_the_sketch(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("everywhere").alias("text"), F.concat(F.lit("s"), F.col("id")).alias("source"))
    (row,) = line_spread.boilerplate_lines(docs, min_sites=100).collect()
    assert abs(row.sites - 4000) < 500

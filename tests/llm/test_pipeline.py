"""The pipeline against a plain version of its stages."""

import re

import numpy as np

from test_near_copies import plain_groups
from test_record_operators import plain_targets, plain_tokens

import corpus_pipeline
from stratafold.llm import edit_decontam, language_id
from stratafold.llm.shared import staged

SF = "/root/testdata/sf0.001"


def test_stages_equal_their_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept, names = docs.columns, {}, [name for name, _ in corpus_pipeline.STAGES]
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, SF), name)
        assert name == names[-1] or docs.columns == columns
        kept[name] = docs.collect()
    # languages: what is said of every text by a model of the training rows, against the spread over these
    rows = before.collect()
    held = {r.doc_id for r in before.where(language_id.held_out()).collect()}
    train = [(r.lang, r.text) for r in rows if r.doc_id not in held and r.lang is not None and r.text is not None]
    languages = sorted({lang for lang, _ in train})
    grams = [sum(language_id.ngram_counts(t) for own, t in train if own == lang) for lang in languages]
    table = np.stack([np.log(g + 0.5) - np.log(g.sum() + 0.5 * len(g)) for g in grams])
    prior = np.log([sum(own == lang for own, _ in train) / len(train) for lang in languages])
    judged = {}
    for i, r in enumerate(rows):
        if r.text and language_id.has_letter(r.text):
            own = language_id.ngram_counts(r.text)
            best = int(np.argmax(table @ own + prior))
            judged[i] = languages[best], (table[best] @ own) / own.sum()
    spread = {lang: [m for i, (own, m) in judged.items() if own == lang and rows[i].doc_id not in held and rows[i].lang == lang] for lang in languages}
    known = []
    for i, (lang, mean) in judged.items():
        allowed = (18 if len(rows[i].text) < 200 else 6) * max(np.std(spread[lang]), 0.02)
        if mean >= np.mean(spread[lang]) - allowed:
            known.append((rows[i].doc_id, rows[i].text))
    assert sorted((r.doc_id, r.text) for r in kept[names[0]]) == sorted(known) and len(known) < len(rows)
    # near copies: brute force over all pairs of texts
    group, pairs, _ = plain_groups(known)
    first = [(doc, text) for doc, text in known if group[doc] == doc]
    gone = {doc for doc, _ in known} - {r.doc_id for r in kept[names[1]]}
    assert all(group[doc] != doc for doc in gone) and len(gone) >= 0.9 * (len(known) - len(first)) > 0
    first = [(r.doc_id, r.text) for r in kept[names[1]]]
    # benchmark: no item stands in what is kept, and one stands, with few edits, in what goes
    items = [edit_decontam.normal(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {doc for doc, text in first if any(i in edit_decontam.normal(text) for i in items)}
    assert {r.doc_id for r in kept[names[2]]} == {doc for doc, _ in first} - leaks and leaks
    # mixing: each document as often as its source needs
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in kept[names[2]]}
    source = {r.doc_id: r.source for r in kept[names[2]]}
    target = plain_targets({s: sum(n for d, n in size.items() if source[d] == s) for s in set(source.values())})
    taken = dict.fromkeys(target, 0)
    for r in kept[names[3]]:
        taken[r.source] += size[r.doc_id]
    assert max(sum(r.doc_id == d for r in kept[names[3]]) for d in size) <= 2
    assert all(abs(taken[s] - target[s]) <= 2 * max(n for d, n in size.items() if source[d] == s) for s in target)
    # ids
    mixed = [(r.doc_id, r.text) for r in kept[names[3]]]
    assert sorted(map(tuple, kept[names[4]])) == plain_tokens(mixed)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    sf = str(tmp_path)
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{sf}/{name}.parquet")
    assert corpus_pipeline.run(spark, sf).collect() == []


def test_pipeline_of_odd_rows(spark, tmp_path):
    sf = str(tmp_path)
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{sf}/benchmark.parquet")
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, copies string"
    rows = [(1, None, None, None, None, "x", "y"), (2, "", "en", "a", 0, None, "y"), (3, "hello there you", "en", None, 15, "x", None), (3, "hello there you", "en", None, 15, "x", None), (None, "bonjour à tous", None, "a", None, None, None), (5, "word " * 20_000, "en", "a", 9, "x", "y")]
    spark.createDataFrame(rows, schema).write.parquet(f"{sf}/documents.parquet")
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in got} <= {3, None, 5} and all(r.n_tokens > 1 for r in got)

"""Forced-boundary encoding against the tokenizers library, and its round trip."""

import hashlib
import json
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stratafold.llm import forced_boundaries as fb
from stratafold.llm.queries import QUERIES
from stratafold.llm.ragged import RaggedMemo, flattened

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def spec():
    with open(PATH, encoding="utf-8") as file:
        return file.read()


def ids_of(encoder, texts):
    ids, counts = encoder.encode([t.encode() for t in texts])
    return [a.tolist() for a in np.split(ids, np.cumsum(counts)[:-1])]


def texts_at_random(n, seed=5, letters="abc  \n\t\r'sdtrevml<|endoftext|>é漢字١٢3   .,!^~`\"-_()\U0001f600ß\x85\xa0 　\x1c\x00ſ"):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_encoder_equals_library(library, spec):
    texts = texts_at_random(6000) + ["", "a" * 3000, " " * 3000, "  x", " \na", "^'s", "''s", "a's'", "don't  'll we've", "<|endoftext|>", "x<|endoftext|> y<|endoftext", "漢字" * 2000]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    encoder = fb.BoundaryEncoder(spec)
    assert ids_of(encoder, texts) == want
    assert ids_of(encoder, texts[::-1]) == want[::-1]  # from what it knows by now
    for text, ids in list(zip(texts, want))[:300]:  # alone, so that no neighbour changes how it is cut
        assert ids_of(encoder, [text]) == [ids]


def test_every_pair_of_ascii_characters_and_every_character(library, spec):
    encoder = fb.BoundaryEncoder(spec)
    marks = [chr(c) for c in range(128)]
    texts = [f"{a}{b}{c}" for a in marks for b in marks for c in ("s", "'", " ")]
    texts += [f"a{chr(c)}b'{chr(c)} {chr(c)}{chr(c)}" for c in range(128, 0x3100) if not 0xD800 <= c < 0xE000]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert ids_of(encoder, texts) == want


def test_special_strings_as_text(spec):
    library = Tokenizer.from_file(PATH)
    library.encode_special_tokens = True
    texts = ["<|endoftext|>", "a<|endoftext|>b", *texts_at_random(500)]
    assert ids_of(fb.BoundaryEncoder(spec, special_as_text=True), texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_cuts_are_never_inside_a_token(spec):
    encoder = fb.BoundaryEncoder(spec)
    whole = encoder.certain.reshape(256, 256)
    for token in encoder.tokens[:50256]:
        assert not any(whole[a, b] for a, b in zip(token, token[1:]))
    fragments, per_text = encoder.fragments(["the cat, the hat".encode(), b"", b"x"])
    assert fragments == [b"the", b" cat", b",", b" the", b" hat", b"x"] and per_text.tolist() == [5, 0, 1]


def test_decoding_equals_library(library, spec):
    tokens = fb.TokenBytes(fb.token_bytes(json.loads(spec)))
    rng = random.Random(1)
    sequences = [[rng.randrange(50257) for _ in range(rng.randint(0, 12))] for _ in range(2000)]  # often no UTF-8
    flat = np.array([i for s in sequences for i in s], dtype=np.int32)
    got = tokens.decode(flat, np.array([len(s) for s in sequences]))
    assert got == library.decode_batch(sequences, skip_special_tokens=False)
    assert tokens.decode(np.array([-1, 10**6]), np.array([2])) == [""]


def test_memo_forgets_long_and_many_keys():
    asked = []
    memo = RaggedMemo(lambda keys: asked.append(sorted(keys)) or flattened([[len(k)] * len(k) for k in keys]), longest=3, most=4)
    memo.fix("special", [9])
    for _ in range(2):
        ids, counts = memo.gather(["a", "bb", "a", "dddd", "special"])
        assert ids.tolist() == [1, 2, 2, 1, 4, 4, 4, 4, 9] and counts.tolist() == [1, 2, 1, 4, 1]
    assert [a for a in asked if a] == [["a", "bb"], ["dddd"], ["dddd"]]
    memo.gather(list("efghij"))
    assert memo.gather(["a", "special"])[0].tolist() == [1, 9] and len(memo.place) == 2


def test_query(spark, library):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op13_bpe_round_trip"](spark, SF).collect()}
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    want = {}
    for r in rows:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id] = (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
    assert got == want and len(got) == len(rows)


def test_edge_cases(spark, library):
    long = "word <|endoftext|>\n" * 20_000
    data = [(1, None), (2, ""), (3, " \n\t "), (4, "tie"), (4, "tie"), (None, "é" * 70), (7, long)]
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumns({"ids": F.lit("mine"), "batches": F.lit("mine"), "decoded": F.lit(1)})
    done = fb.decode_ids(fb.encode_texts(docs, PATH), PATH)
    assert done.columns == ["doc_id", "text", "ids", "batches", "decoded"]
    rows = done.collect()
    assert len(rows) == len(data)
    for r in rows:
        assert r.ids == library.encode(r.text or "", add_special_tokens=False).ids and r.decoded == (r.text or "") and r.batches == "mine"
    both = fb.round_trip(docs, PATH)
    assert both.columns == ["doc_id", "text", "batches", "ids", "decoded"]
    assert sorted((str(r.doc_id), r.ids, r.decoded) for r in both.collect()) == sorted((str(r.doc_id), r.ids, r.decoded) for r in rows)
    assert fb.round_trip(docs.limit(0), PATH).collect() == []
    assert fb.decode_ids(fb.encode_texts(docs.limit(0), PATH), PATH).collect() == []
    odd = spark.createDataFrame([(None,), ([],), ([None, 464, -5, 99_999_999],)], "ids array<int>")
    assert sorted((r.decoded for r in fb.decode_ids(odd, PATH).collect()), key=str) == ["", None, "The"]

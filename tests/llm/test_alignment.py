"""Cross-tokenizer alignment against plain byte ranges of the two libraries' own tokens."""

import collections
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stratafold.llm import alignment as al
from stratafold.llm.queries import QUERIES
from stratafold.llm.token_counts import byte_symbols

SF = "/root/testdata/sf0.001"
PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Plain:
    def __init__(self):
        self.a = Tokenizer.from_file(PATHS[0])
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
        self.byte = {c: b for b, c in enumerate(byte_symbols())}

    def tokens(self, text):
        if not text:
            return [], []
        a = [(i, bytes(self.byte[c] for c in self.a.id_to_token(i))) for i in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode()) for i in self.b.encode(text) for p in [self.b.id_to_piece(i)]]
        want = (" " + text).encode()
        return (a, b) if b"".join(t for _, t in a) == want == b"".join(t for _, t in b) else ([], [])

    def align(self, text):
        """Every pair of tokens whose ranges overlap, and the groups, by walking both lists."""
        a, b = self.tokens(text)
        ends_a, ends_b = np.cumsum([len(t) for _, t in a]), np.cumsum([len(t) for _, t in b])
        links, j = [], 0
        for i, (token, data) in enumerate(a):
            low, high = ends_a[i] - len(data), ends_a[i]
            while j and ends_b[j - 1] > low:
                j -= 1
            while j < len(b) and (ends_b[j] - len(b[j][1])) < high:
                if ends_b[j] > low:
                    links.append((token, b[j][0]))
                j += 1
        groups, i, j = [], 0, 0
        for end in sorted({*ends_a.tolist()} & {*ends_b.tolist()}):
            to_i, to_j = np.searchsorted(ends_a, end) + 1, np.searchsorted(ends_b, end) + 1
            groups.append(",".join(str(t) for t, _ in a[i:to_i]) + "|" + ",".join(str(t) for t, _ in b[j:to_j]))
            i, j = to_i, to_j
        return len(a), len(b), links, groups

    def table(self, texts):
        found = [self.align(t) for t in texts]
        count = collections.Counter(p for *_, links, _ in found for p in set(links))
        most = collections.Counter()
        for (a, _), c in count.items():
            most[a] = max(most[a], c)
        out = []
        for n_a, n_b, links, groups in found:
            out.append((n_a, n_b, len(groups), len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links), ";".join(groups)))
        return out


@pytest.fixture(scope="module")
def plain():
    return Plain()


def texts_at_random(n):
    rng = random.Random(7)
    letters = "abc  \n\t'sdtre<|endoftext|><s>é漢字١٢3   .,!\U0001f600ß▁\x00\xa0ﬁ"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_encoders_equal_their_libraries(plain):
    with open(PATHS[1], "rb") as file:
        encoder = al.PieceEncoder(file.read())
    assert encoder.by_word
    texts = [t for t in texts_at_random(4000) if t] + [" ", "  ", "a ", " a  b ", "x" * 500, "\n", " \n "]
    ids, counts = encoder.encode([" " + t for t in texts])
    assert [p.tolist() for p in np.split(ids, np.cumsum(counts)[:-1])] == plain.b.encode(texts)


@pytest.mark.parametrize("steps", [1, 2, 3, 7, 1000])
def test_pieces_are_equal_and_give_one_merge(steps):
    rng = np.random.default_rng(steps)
    for _ in range(60):
        end = int(rng.integers(1, 60))
        a, b = (np.unique(np.append(rng.integers(1, end + 1, rng.integers(0, 40)), end)) for _ in "ab")
        i, j = al.diagonal_cuts(a, b, steps)
        work = np.diff(i) + np.diff(j)
        assert (work[:-1] == steps).all() and 0 < work[-1] <= steps and i[-1] == len(a) and j[-1] == len(b)
        got = al.align_ends(a, b, a, b, np.array([0, len(a)]), np.array([0, len(b)]), steps)
        start_a, start_b = np.append(0, a)[:-1], np.append(0, b)[:-1]
        want = {(x, y) for x in range(len(a)) for y in range(len(b)) if max(start_a[x], start_b[y]) < min(a[x], b[y])}
        links = list(zip(got.link_a.tolist(), got.link_b.tolist()))
        assert set(links) == want and len(links) == len(want)
        assert a[got.group_a - 1].tolist() == b[got.group_b - 1].tolist() == sorted({*a.tolist()} & {*b.tolist()})
        assert got.text_group.tolist() == [0, len(got.group_a)]


def test_query_equals_plain_ranges(spark, plain):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op11_tokenizer_alignment"](spark, SF).collect()}
    want = {r.doc_id: (*w[:6], hashlib.sha256(w[6].encode()).hexdigest() if w[6] else "") for r, w in zip(rows, plain.table([r.text for r in rows]))}
    assert got == want and len(got) == len(rows)


def test_blocks_and_pieces_change_nothing(spark, plain, monkeypatch):
    texts = texts_at_random(400) * 2 + ["word " * 3000 + "<|endoftext|>"]
    rows = [(i, t, "mine", "old") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block string, n_a string")
    want = plain.table(texts)
    for parts in (1, 9):
        got = al.align_tokenizers(docs.repartition(parts), *PATHS)
        assert got.columns == ["doc_id", "text", "block", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
        rows = got.collect()
        assert {r.doc_id: tuple(r)[3:] for r in rows} == dict(enumerate(want)) and len(rows) == len(texts)
        assert all(r.text == texts[r.doc_id] and r.block == "mine" for r in rows)


def test_small_blocks_and_pieces(plain, monkeypatch):
    monkeypatch.setattr(al, "PIECE_STEPS", 5)
    with open(PATHS[0], encoding="utf-8") as spec, open(PATHS[1], "rb") as model:
        aligner = al.Aligner(spec.read(), model.read())
    texts = texts_at_random(200)
    found = aligner.align(texts)
    small = al.align_ends(found.a, found.b, np.cumsum(aligner.bytes_a.sizes(found.a)), np.cumsum(aligner.bytes_b.sizes(found.b)), found.text_a, found.text_b, steps=5)
    assert aligner.group_texts(small) == aligner.group_texts(found) == [w[6] for w in plain.table(texts)]


def test_edge_cases(spark, plain):
    data = [(1, None), (2, ""), (3, " \n\t "), (4, "tie of two"), (4, "tie of two"), (None, "é" * 70), (7, "a▁b"), (8, " "), (9, "漢字 kanji " * 5_000)]
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumns({"row": F.lit(1), "pairs": F.lit("x"), "number": F.current_timestamp()})
    rows = al.align_tokenizers(docs, *PATHS).collect()
    key = lambda r: (str(r[0]), str(r[1]))
    want = sorted(((d, t, *w) for (d, t), w in zip(data, plain.table([t for _, t in data]))), key=key)
    assert sorted(((r.doc_id, r.text, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in rows), key=key) == want
    assert {r.pairs for r in rows} == {"x"} and {r.row for r in rows} == {1}
    assert al.align_tokenizers(docs.limit(0), *PATHS).collect() == []
    assert al.align_tokenizers(docs.where("doc_id < 3"), *PATHS).select("n_a", "count_sum", "groups").distinct().collect() == [(0, 0, "")]

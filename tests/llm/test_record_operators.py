"""Near and exact dedup, decontamination, mixing, token output and chat rotation against plain versions of each."""

import hashlib
import random
import re
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stratafold.llm import chat_rotation, edit_decontam, golomb_dedup, mixing, simhash, token_store
from stratafold.llm.line_spread import strip_boilerplate
from stratafold.llm.components import connected_components
from stratafold.llm.queries import QUERIES, SQL
from tools.compare import compare

SF = "/root/testdata/sf0.001"
EDGE = [(1, None), (2, ""), (3, " "), (3, " "), (None, "\t "), (5, "a  b"), (5, "a b"), (5, "a b"), (None, "x y z w"), (None, "x y z w"), (9, "long " * 30_000)]
UNARY = 1 << 64


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, "doc_id long, text string").withColumns({"source": F.lit("s"), "keep_id": F.lit("mine"), "size": F.lit("mine"), "matches": F.lit("mine")})


class Groups:
    def __init__(self, nodes):
        self.parent = {n: n for n in nodes}

    def of(self, n):
        while self.parent[n] != n:
            n = self.parent[n]
        return n

    def link(self, a, b):
        a, b = self.of(a), self.of(b)
        self.parent[max(a, b)] = min(a, b)


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints):
    values = np.array(sorted(set(prints)), dtype=np.uint64)
    groups = Groups(map(int, values))
    for v in values:
        for near in values[np.bitwise_count(values ^ v) <= 2]:
            groups.link(int(v), int(near))
    return groups


def plain_components(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    groups, first = plain_groups(prints), {}
    for (doc, _), p in zip(rows, prints, strict=True):
        if doc is not None:
            first[groups.of(p)] = min(first.get(groups.of(p), doc), doc)
    return [(doc, p, first.get(groups.of(p))) for (doc, _), p in zip(rows, prints, strict=True)]


def test_simhash_query(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    got = [(r.doc_id, int(r.fingerprint, 16), r.component_id) for r in QUERIES["op7_simhash_near_dedup"](spark, SF).collect()]
    assert sorted(got) == sorted(plain_components(rows))


def test_simhash_of_edge_cases(edge):
    got = [(r.doc_id, r.fingerprint_bits % UNARY, r.component_id) for r in simhash.simhash_components(edge).collect()]
    assert sorted(got, key=str) == sorted(plain_components(EDGE), key=str)
    kept = [(r.doc_id, r.text, r.keep_id) for r in simhash.simhash_dedup(edge).collect()]
    assert sorted(kept, key=str) == sorted([(1, None, "mine"), (5, "a b", "mine"), (5, "a  b", "mine"), (None, "x y z w", "mine"), (9, "long " * 30_000, "mine")], key=str)
    assert simhash.simhash_components(edge.limit(0)).collect() == simhash.simhash_dedup(edge.limit(0)).collect() == []


def test_full_files_are_split_without_losing_links(spark, monkeypatch):
    monkeypatch.setattr(simhash, "_FILE_LIMIT", 16)
    rng, prints = np.random.default_rng(0), set()
    bases = [int(b) for b in rng.integers(0, 1 << 63, 2, dtype=np.uint64)]
    for i in range(260):
        value = bases[i % 2]
        for b in rng.choice(64, rng.integers(0, 4), replace=False):
            value ^= 1 << int(b)
        prints.add(value)
    table = spark.createDataFrame([(p - UNARY if p >= UNARY // 2 else p,) for p in prints], "p long")
    found = {}
    for r in connected_components(simhash.hamming_links(table, "p"), "a", "b").collect():
        found.setdefault(r.component, set()).add(r.node % UNARY)
    groups, want = plain_groups(prints), {}
    for p in prints:
        want.setdefault(groups.of(p), set()).add(p)
    assert {frozenset(g) for g in found.values()} == {frozenset(g) for g in want.values() if len(g) > 1}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (300, 299)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100), 299: 299, 300: 299}


@pytest.mark.parametrize(("span", "n"), [(UNARY, 0), (UNARY, 1), (UNARY, 5000), (1 << 20, 3000), (5, 5), (3, 1)])
def test_golomb_round_trip(span, n):
    rng = np.random.default_rng(n)
    values = np.sort(rng.choice(span, n, replace=False)).astype(np.uint64) if span < UNARY else np.unique(rng.integers(0, UNARY - 1, n, dtype=np.uint64, endpoint=True))
    low, code = golomb_dedup.golomb_encode(values, span)
    assert (golomb_dedup.golomb_decode(len(values), low, code) == values).all()
    assert n < 1000 or len(code) * 8 <= len(values) * (low + 3)


def test_exact_dedup_of_edge_cases(edge):
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in golomb_dedup.exact_dedup(edge).collect()), key=str)
    # null and empty texts are equal, one of repeated rows stays, and ids stay before null ids
    want = [(1, 1, 2, True), (2, 1, 2, False), (3, 3, 3, True), (3, 3, 3, False), (None, 3, 3, False), (5, 5, 3, True), (5, 5, 3, False), (5, 5, 3, False), (None, None, 2, True), (None, None, 2, False), (9, 9, 1, True)]
    assert got == sorted(want, key=str)
    shas = {r.text_sha256 for r in golomb_dedup.exact_dedup(edge).where("doc_id = 5").collect()}
    assert shas == {hashlib.sha256(b"a b").hexdigest()} and golomb_dedup.exact_dedup(edge.limit(0)).collect() == []


def test_exchange_between_many_partitions_and_owners(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(golomb_dedup, "_OWNER_PRINTS", 50)
    values = [int(v) for v in np.random.default_rng(4).integers(-(1 << 63), 1 << 63, 300)]
    once, many = values[:200], values[200:]
    path = str(tmp_path / "prints")
    spark.createDataFrame([(v,) for v in once + many * 2 + many[:3] * 20], "print long").repartition(7).write.parquet(path)
    assert sorted(r[0] for r in golomb_dedup.suspect_prints(spark.read.parquet(path)).collect()) == sorted(many)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    ok, text = compare(spark, con, name, QUERIES[name], SQL[name], SF)
    assert ok, text


def plain_distance(item, window):
    row = [0] * (len(window) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, w in enumerate(window, 1):
            new.append(min(row[j - 1] + (c != w), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def changed(rng, text, edits, letters="abc"):
    chars = list(text)
    for _ in range(edits):
        at = rng.randint(0, len(chars))
        chars[at : at + rng.randint(0, 1)] = rng.choice(["", "", rng.choice(letters)])
    return "".join(chars)


def test_bit_parallel_distance_equals_the_table():
    rng = random.Random(1)
    for _ in range(600):
        item = "".join(rng.choice("abc ") for _ in range(rng.randint(2, 90)))
        window = "ca" + changed(rng, item, rng.randint(0, 6)) + "b"
        budget, want = rng.randint(0, 8), plain_distance(item, window)
        got = edit_decontam.best_match(item, window, budget)
        assert (got and got[0]) == (want if want <= budget else None)


def test_pieces_cover_the_item():
    for n, budget in [(20, 1), (33, 2), (200, 14), (7, 6)]:
        item = "".join(map(chr, range(n)))
        cut = edit_decontam.pieces(item, budget)
        assert "".join(p for _, p in cut) == item and len(cut) == budget + 1 and all(item[o : o + len(p)] == p for o, p in cut)


def test_matches_equal_brute_force(spark):
    rng = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta", "eta"]
    items = [" ".join(rng.choice(words) for _ in range(12)) for _ in range(6)]
    rows = []
    for i in range(60):
        inner = changed(rng, rng.choice(items), rng.randint(0, 9)) if i % 2 else " ".join(rng.choice(words) for _ in range(12))
        rows.append((i, f"Intro {inner.upper()}\n end " * (1 + i % 2)))
    rows += [(90, None), (91, ""), (92, "x " * 20_000 + items[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("matches", F.lit("mine"))
    bench = spark.createDataFrame([*enumerate(items), (70, None), (71, ""), (72, "the"), (0, items[0])], "item_id long, text string")
    found = edit_decontam.benchmark_matches(docs, bench).select("doc_id", F.explode("matches").alias("m")).collect()
    got = {(r.doc_id, r.m.item_id): r.m.distance for r in found}
    want = {}
    for d, t in rows:
        for n, item in enumerate(items):
            distance = plain_distance(item, edit_decontam.normal(t or "")) if d != 92 else (0 if n == 0 else 99)
            if distance <= int(len(item) * edit_decontam.ERROR_SHARE):
                want[(d, n)] = distance
    assert got == want and len(found) == len(got) and len(got) > 10
    kept = edit_decontam.decontaminate(docs, bench)
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in rows} - {d for d, _ in got} and kept.columns == docs.columns
    assert edit_decontam.decontaminate(docs, bench.limit(0)).count() == len(rows)
    assert edit_decontam.benchmark_matches(docs.limit(0), bench).collect() == []


def test_short_items_stand_as_they_are_between_word_borders(spark):
    texts = ["Well, what is 2  plus 2? Four.", "what is 2 plus 22?", "somewhat is 2 plus 2?", "what is 2 plus 3?", "what is 2 plus 2?", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([("q", "What is 2 plus 2?"), ("n", "2 plus 2"), ("none", None), ("blank", " ")], "item_id string, text string")
    found = edit_decontam.benchmark_matches(docs, bench).select("doc_id", F.explode("matches").alias("m")).collect()
    got = {(r.doc_id, r.m.item_id, r.m.distance, r.m.end_char) for r in found}
    assert got == {(0, "q", 0, 23), (0, "n", 0, 22), (2, "n", 0, 20), (4, "q", 0, 17), (4, "n", 0, 16)}


def test_blocks_of_items_give_the_same_matches(spark, monkeypatch):
    rng = random.Random(3)
    items = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(9)) for _ in range(8)]
    docs = spark.createDataFrame([(i, f"so {changed(rng, items[i % 8], i % 4)} end") for i in range(40)] + [(1, None), (1, None)], "doc_id long, text string").withColumn("_own", F.lit("mine"))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")

    def matches():
        rows = edit_decontam.benchmark_matches(docs, bench).collect()
        return sorted(((r.doc_id, r.text, r["_own"], sorted(map(tuple, r.matches))) for r in rows), key=str)

    want = matches()
    monkeypatch.setattr(edit_decontam, "_BLOCK_CHARS", 100)
    assert matches() == want and sum(bool(m) for *_, m in want) > 20


def test_matches_end_where_the_item_ends(spark):
    rng = random.Random(4)
    item = "a passage that stands in the benchmark and nowhere else in the world"
    for edits in range(4):
        inner = changed(rng, item, edits, "xyz")
        text = f"Before  it.\n{inner} after it"
        (row,) = edit_decontam.benchmark_matches(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
        (m,) = row.matches
        whole = edit_decontam.normal(text)
        assert m.distance == plain_distance(item, whole)
        assert m.end_char == min(e for e in range(len(whole) + 1) if plain_tail(item, whole[:e]) == m.distance)


def plain_tail(item, text):
    """Smallest number of edits from the item to a part of the text that ends where the text ends."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, w in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != w), row[j] + 1, new[j - 1] + 1))
        row = new
    return row[-1]


def test_benchmark_query_finds_whole_items(spark, documents):
    items = {r.item_id: edit_decontam.normal(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    want = {(r.doc_id, i) for r in documents.collect() for i, t in items.items() if t in edit_decontam.normal(r.text or "")}
    got = {(r.doc_id, r.item_id): r.distance for r in QUERIES["op9_benchmark_decontamination"](spark, SF).collect()}
    assert {k for k, d in got.items() if d == 0} == want and want


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight, full, total = {s: weights[i % 3] for i, s in enumerate(order)}, set(), share * sum(sizes.values())
    while True:
        free = total - sum(most * sizes[s] for s in full)
        target = {s: most * sizes[s] if s in full else free * weight[s] / sum(weight[o] for o in order if o not in full) for s in order}
        above = {s for s in order if target[s] > most * sizes[s]} - full
        if not above:
            return target
        full |= above


def test_mixing_query(spark, documents):
    rows = QUERIES["op5_mixing_sources"](spark, SF).collect()
    text = {r.doc_id: (r.source, r.text) for r in documents.collect()}
    by_source = {}
    for r in rows:
        source, words = text[r.doc_id]
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", words or "")) and r.taken <= 2 * r.size and r.taken % max(r.size, 1) == 0
        by_source.setdefault(source, []).append(r)
    target = plain_targets({s: sum(r.size for r in own) for s, own in by_source.items()})
    for s, own in by_source.items():
        assert {r.source_size for r in own} == {sum(r.size for r in own)} and own[0].target == pytest.approx(target[s])
        assert abs(sum(r.taken for r in own) - target[s]) <= 2 * max(r.size for r in own)
    assert sorted(rows) == sorted(QUERIES["op5_mixing_sources"](spark, SF).collect())


def test_rounding_keeps_the_sum_and_the_chances(spark):
    half = mixing._ONE // 2
    units = spark.range(3000).select(
        F.lit(False).alias("no_source"), F.lit("hot").alias("source_text"), F.col("id").alias("doc_id"), F.col("id").alias("text_hash"), F.lit(0).alias("nth"),
        (F.col("id") % 7 + 1).alias("size"), F.when(F.col("id") % 3 == 0, half).otherwise(half // 4).cast("long").alias("mass"),
    )
    up = {r.doc_id: r.up for r in mixing.rounded_up(units).collect()}
    assert len(up) == 3000 and set(up.values()) == {0, 1}
    assert abs(sum(up.values()) - 1000 * 0.5 - 2000 * 0.125) <= 1
    assert abs(sum(v for d, v in up.items() if d % 3 == 0) - 500) < 100
    words = sum((d % 7 + 1) * v for d, v in up.items())
    assert abs(words - sum((d % 7 + 1) * (0.5 if d % 3 == 0 else 0.125) for d in up)) <= 60


def test_repeated_rows_come_near_the_target(spark):
    rows = [(5, " ".join("w" * 10), "a")] * 1_000 + [(100 + i, " ".join("abc" * (1 + i % 5)), "a") for i in range(1_000)] + [(9_000 + i, "x y", "b") for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7).withColumns({"_key": F.lit("mine"), "_NTH": F.lit(1), "copies": F.lit(2)})
    plan = mixing.mix_plan(docs).collect()
    for source in "ab":
        own = [r for r in plan if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 2 * max(r.size for r in own) and all(0 <= r.copies <= 2 for r in own)
    mixed = mixing.mix(docs)
    counts = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert mixed.columns == docs.columns and counts.get(5, 0) == sum(r.copies for r in plan if r.doc_id == 5)
    assert sum(counts.values()) == sum(r.copies for r in plan)
    assert sorted(map(tuple, mixing.mix_plan(docs).collect()), key=str) == sorted(map(tuple, plan), key=str)


def test_text_ids_and_clashing_names(spark):
    names = {c: F.lit("mine") for c in ("_key", "_cut", "_copies", "_copy", "_text_hash", "_no_id", "_id_or_0", "_matches", "_language", "_judged", "row")}
    rows = [("a", "one two\nshared", "s1"), ("b", "one two\nshared", "s2"), (None, "three", None), ("a", "one two\nshared", "s1"), (None, None, "s1")]
    docs = spark.createDataFrame(rows, "doc_id string, text string, source string").withColumns(names)
    for done, size in ((strip_boilerplate(docs, min_sites=2), 5), (mixing.mix(docs, share=1.0), None), (simhash.simhash_dedup(docs), 3)):
        got = done.collect()
        assert set(docs.columns) <= set(done.columns) and (size is None or len(got) == size) and all(r[c] == "mine" for r in got for c in names)
    assert {r.doc_id for r in simhash.simhash_dedup(docs).collect()} == {"a", None}
    bench = spark.createDataFrame([("i", "three")], "item_id string, text string")
    kept = edit_decontam.decontaminate(docs, bench)
    assert kept.count() == 4 and {r["_matches"] for r in kept.collect()} == {"mine"}


def test_mixing_of_edge_cases(edge, spark):
    plan = mixing.mix_plan(edge).collect()
    assert len(plan) == len(EDGE) and all(0 <= r.copies <= 2 for r in plan)
    mixed = mixing.mix(edge)
    assert mixed.columns == edge.columns and mixed.count() == sum(r.copies for r in plan)
    assert mixing.mix_plan(edge.limit(0)).collect() == mixing.mix(edge.limit(0)).collect() == []
    nulls = spark.createDataFrame([(1, "a b", None), (2, "c", "b"), (3, None, "b")], "doc_id long, text string, source string")
    assert {r.doc_id: (r.source_size, r.target) for r in mixing.mix_plan(nulls).collect()} == {1: (2, 2.5), 2: (1, 2.0), 3: (1, 2.0)}


@pytest.mark.parametrize("kind", ["bit", "byte"])
@pytest.mark.parametrize("ids", [[], [0], [5, 70_000, 2**32 - 1], list(range(999))])
def test_planes_round_trip(kind, ids):
    block = np.array(ids, dtype=np.uint32)
    assert (token_store.from_planes(token_store.to_planes(block, kind), len(block), kind) == block).all()


def test_words_are_encoded_as_their_text_is():
    path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as file:
        encoder = token_store.WordEncoder(file.read())
    rng, letters = random.Random(6), "abc \n\t́\x0b'sdtre<|endoftext|>é漢字١3 .,!\U0001f600ßÉ\x1c\x85"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["x<|endoftext|>y <|startoftext|>"]
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert encoder.by_word and [np.frombuffer(e, "<u4").tolist() for e in encoder.encode(texts)] == want


def test_marks_after_letters_that_the_normaliser_takes_apart():
    path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as file:
        encoder = token_store.WordEncoder(file.read())
    apart = [c for c in map(chr, range(0x110000)) if c.isalnum() and not unicodedata.normalize("NFC", c).lower()[-1].isalnum()]
    assert len(apart) >= 60 and {"\u0130", "\u0958", "\u09df", "\ufb4e"} <= set(apart)
    texts = [f"a{c}{marks} b" for c in apart for marks in (",", ".!", "?")]
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(e, "<u4").tolist() for e in encoder.encode(texts)] == want


def plain_tokens(rows):
    library, start, out = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for doc, text in sorted(rows):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        out.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_token_output_query(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert sorted(tuple(r) for r in QUERIES["op6_token_id_output"](spark, SF).collect()) == plain_tokens(rows)


def test_documents_longer_than_blocks(spark, documents):
    docs, path = documents.where("doc_id < 60"), token_store.scratch(spark, "small-blocks")
    token_store.write_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), path, end_id=2, kind="bit", block_ids=100)
    got = token_store.ids_crc32(token_store.read_tokens(spark, path)).collect()
    assert sorted(map(tuple, got)) == plain_tokens([(r.doc_id, r.text) for r in docs.collect()])


def test_token_output_of_edge_cases(edge):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = sorted((r.start, r.n_tokens, r.doc_id) for r in token_store.token_table(edge, path, 2).collect())
    ends = [s + n for s, n, _ in rows]
    assert [s for s, _, _ in rows] == [0, *ends[:-1]] and len(rows) == len(EDGE)
    ids = [d for _, _, d in rows]
    assert ids == sorted(ids, key=lambda d: (d is not None, d)) and token_store.token_table(edge.limit(0), path, 2).collect() == []


CHAT = [(1, 2, "bo", "yes <|im_end|>"), (1, 1, "ann", "hi"), (1, 0, "system", "be kind"), (1, 3, None, None), (1, 3, None, None), (2, 0, "system", "alone"), (None, 5, "ann", ""), (3, None, "ann", "late?"), (3, 0, "bo", "no")]


def plain_rotation(turns):
    out = {}
    for conv in {t[0] for t in turns}:
        own = sorted({(t[1], t[2] or "unknown", t[3] or "") for t in turns if t[0] == conv}, key=lambda t: (t[0] is not None, t[0], *t[1:]))
        for speaker in {r for _, r, _ in own} - {"system"}:
            text, spans = "", []
            for _, role, words in own:
                name = "assistant" if role == speaker else role if role == "system" else f"user name={role}"
                text += f"<|im_start|>{name}\n"
                body = words.replace("<|im_", "<| im_") + "<|im_end|>\n"
                spans += [(len(text), len(text) + len(body))] if role == speaker else []
                text += body
            out[conv, speaker] = (text, spans, sum(b - a for a, b in spans))
    return out


def test_every_participant_is_the_assistant_once(spark):
    turns = spark.createDataFrame(CHAT, "conv_id long, turn long, role string, text string").withColumn("speaker", F.lit("mine"))
    got = {(r.conv_id, r.speaker): (r.text, [tuple(s) for s in r.spans], r.n_trained) for r in chat_rotation.rotate_perspectives(turns).collect()}
    assert got == plain_rotation(CHAT)
    assert chat_rotation.rotate_perspectives(turns.limit(0)).collect() == []


def plain_parts(turns, size):
    """Plain rotation of each run of ``size`` turns in order; every participant of the conversation has every run."""
    out = {}
    for conv in {t[0] for t in turns}:
        own = sorted({(t[1], t[2] or "unknown", t[3] or "") for t in turns if t[0] == conv}, key=lambda t: (t[0] is not None, t[0], *t[1:]))
        for speaker in {r for _, r, _ in own} - {"system"}:
            for part in range(0, len(own), size):
                some = [(conv, *t) for t in own[part : part + size]]
                out[conv, part // size, speaker] = plain_rotation([*some, (conv, 10**9, speaker, "")])[conv, speaker][0].removesuffix("<|im_start|>assistant\n<|im_end|>\n")
    return out


@pytest.mark.parametrize("crowd", [255, 256, 257, 5_000])
def test_conversations_are_cut_by_exact_rank(spark, crowd):
    turns = [(1, 4, "ab"[i % 2], f"same number {i}") for i in range(crowd)] + [(1, None, "a", f"no number {i}") for i in range(3)] + [(1, 9, "c", "last")]
    turns += [(2, i, "ab"[i % 2], f"t{i}") for i in range(1_000)] + [(3, 0, "a", "short"), (None, 1, "b", "no conversation")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(7)
    rows = chat_rotation.rotate_perspectives(df).collect()
    got = {(r.conv_id, r.part, r.speaker): r.text for r in rows}
    assert got == plain_parts(turns, 256) and len(got) == len(rows)


def test_long_conversations_come_in_parts(spark):
    turns = [(1, i, "ab"[i % 2], f"t{i}") for i in range(25)] + [(1, 30, "b", f"same number {i}") for i in range(40)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    rows = chat_rotation.rotate_perspectives(df, part_turns=10).collect()
    assert {(r.conv_id, r.part, r.speaker): r.text for r in rows} == plain_parts(turns, 10) and max(r.n_turns for r in rows) == 10


def test_native_operators_run_no_python(spark):
    for name in ("op5_mixing_sources", "op8_chat_rotation"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow|BatchEval", plan)

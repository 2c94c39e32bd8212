"""Near copies by wide fingerprints against brute force over all pairs of texts."""

import random
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratafold.llm import near_copies as nc
from stratafold.llm.shared import staged

SF = "/root/testdata/sf0.01"


def plain_groups(rows, similarity=0.8, shingle=5):
    """Smallest doc_id reachable over pairs of texts whose sets of shingles are alike, by doc_id; and the pairs of different word sequences."""
    words = {d: tuple(nc.words_of(t or "")) for d, t in rows}
    sets = {w: {w[i : i + shingle] for i in range(max(1, len(w) - shingle + 1))} for w in set(words.values())}
    texts, parent = list(sets), {w: w for w in sets}

    def root(w):
        while parent[w] != w:
            w = parent[w]
        return w

    pairs, where = set(), {}
    for w, own in sets.items():
        for s in own:
            for other in where.setdefault(s, []):
                pairs.add((other, w))
            where[s].append(w)
    pairs = {(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])}
    for a, b in pairs:
        parent[root(a)] = root(b)
    smallest = {}
    for d, w in words.items():
        smallest[root(w)] = min(d, smallest.get(root(w), d))
    return {d: smallest[root(w)] for d, w in words.items()}, pairs, len(texts)


def edited(words, rng, changes):
    words = list(words)
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return words


def test_recall_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want, pairs, _ = plain_groups(rows)
    got = {r.doc_id: r.group_id for r in nc.near_copy_groups(docs).collect()}
    linked = [d for d in want if want[d] != d]
    assert len(got) == len(rows) and len(pairs) >= 5
    assert sum(got[d] == want[d] for d in linked) >= 0.9 * len(linked)
    assert all(got[d] == d for d in want if want[d] == d)  # nothing else is linked


def test_recall_of_made_copies(spark):
    rng = random.Random(11)
    rows = []
    for group in range(150):
        base = [f"w{int(rng.paretovariate(0.6)) % 20_000}" for _ in range(rng.randint(60, 400))]
        rows.append((10 * group, " ".join(base)))
        rows.append((10 * group + 1, " ".join(edited(base, rng, max(1, len(base) // 60)))))
    want, pairs, _ = plain_groups(rows)
    got = {r.doc_id: r.group_id for r in nc.near_copy_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    linked = [d for d in want if want[d] != d]
    assert len(linked) > 100 and sum(got[d] == want[d] for d in linked) >= 0.9 * len(linked)
    assert all(got[d] == d for d in want if want[d] == d)


def test_a_large_group_stays_whole(spark, monkeypatch):
    monkeypatch.setattr(nc, "_PART", 40)
    rng = random.Random(12)
    base = [f"w{rng.randrange(5_000)}" for _ in range(300)]
    rows = [(i, " ".join(edited(base, rng, 1))) for i in range(600)] + [(1_000 + i, " ".join(base)) for i in range(50)]
    got = {r.group_id for r in nc.near_copy_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0}
    assert [r.doc_id for r in nc.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()] == [0]


def test_links_of_a_file_hold_it_together():
    assert nc.wide_fingerprint([]).tobytes() == bytes(96) and len(nc.wide_fingerprint([b"a"])) == 96
    one, many = nc.wide_fingerprint([b"a", b"b", b"c"]), nc.wide_fingerprint([b"c", b"b", b"a", b"a"])
    assert (one == many).all()
    spread = np.unpackbits(nc.wide_fingerprint([f"w{i}".encode() for i in range(501)])).mean()
    assert 0.4 < spread < 0.6


@pytest.mark.parametrize("kind", ["long", "string"])
def test_edge_cases(spark, kind):
    data = [(1, None), (2, ""), (3, " \n\t "), (4, "a tie of two"), (4, "a tie of two"), (5, "A TIE  of two"), (None, "a tie of two"), (None, "alone"), (7, "word " * 30_000), (4, "other text of the same id")]
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumn("doc_id", F.col("doc_id").cast(kind))
    docs = docs.withColumns({"_node": F.lit("mine"), "_KEY": F.lit(1), "_print": F.lit(None).cast("string"), "node": F.lit(2)})
    kept = nc.drop_near_copies(docs)
    rows = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    id_ = (lambda i: i) if kind == "long" else str
    assert kept.columns == docs.columns and rows == sorted([(id_(1), None), (id_(4), "a tie of two"), (id_(4), "other text of the same id"), (None, "alone"), (id_(7), "word " * 30_000)], key=str)
    assert {r["_node"] for r in kept.collect()} == {"mine"}
    assert nc.drop_near_copies(docs.limit(0)).collect() == nc.near_copy_groups(docs.limit(0)).collect() == []


def test_every_alike_pair_is_linked(spark):
    """Short texts at the threshold, whose fingerprints differ in many bits."""
    rng = random.Random(13)
    rows = []
    for group in range(250):
        base = [f"v{rng.randrange(50_000)}" for _ in range(rng.randint(14, 44))]
        rows.append((10 * group, " ".join(base)))
        for copy in range(1, 4):  # words in front or behind change the set of different words most, for the shingles they cost
            more = [f"x{rng.randrange(50_000)}" for _ in range(rng.randint(1, max(1, len(base) // 5)))]
            rows.append((10 * group + copy, " ".join(more + base if copy % 2 else base + more)))
    want, pairs, _ = plain_groups(rows)
    got = {r.doc_id: r.group_id for r in nc.near_copy_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(pairs) > 300 and got == want
    assert nc.prefix_of(np.arange(10, dtype=np.uint64), 0.8, np.array([0, 1]), np.array([9, 8])).tolist() == [2, 3, 4]


def test_bitmaps_of_shingles_refuse_no_alike_pair():
    """Sets at and around the threshold, of sizes whose bitmaps have different lengths; far ones are refused."""
    rng = np.random.default_rng(14)
    refused = 0
    for n in [1, 2, 5, 30, 31, 32, 33, 64, 65, 500, 1_030]:
        for _ in range(40):
            base = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            other = np.unique(np.concatenate([base[rng.random(len(base)) < rng.choice([0.2, 0.8, 0.9, 1.0])], rng.integers(0, 1 << 63, rng.integers(0, n // 4 + 2), dtype=np.uint64)]))
            both = len(np.intersect1d(base, other))
            similarity = both / (len(base) + len(other) - both)
            may = nc.may_be_alike((nc.parity_of(base), nc.parity_of(other)), (len(base), len(other)), 0.8)
            assert may or similarity < 0.8
            assert nc.may_be_alike((nc.parity_of(base), nc.parity_of(other)), (len(base), len(other)), similarity)
            refused += not may
    assert refused > 100


def test_bitmaps_of_keys_lose_no_row(spark, monkeypatch):
    monkeypatch.setattr(nc, "_MAPS", 2)
    monkeypatch.setattr(nc, "_MAP_BITS", 64)
    ids = [None, *range(3_000)]
    rows = spark.createDataFrame([(i, f"text {i}") for i in ids for _ in range(1 + (i == 7))], "doc_id long, text string").select(F.struct("doc_id").alias("key"), "text")
    keys = spark.createDataFrame([(i, -1 if i is None else i) for i in [None, 7, *range(100, 160), 5_000]], "doc_id long, node long").select("node", F.struct("doc_id").alias("key"))
    got = sorted((r.node, r.text) for r in nc._rows_of(rows, keys).collect())
    assert got == sorted([(-1, "text None"), (7, "text 7"), (7, "text 7"), *((i, f"text {i}") for i in range(100, 160))])
    assert nc._rows_of(rows, keys.limit(0)).collect() == []


def shuffle_bytes(spark):
    """Bytes of shuffle files on the disk of this local session."""
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return sum(f.stat().st_size for d in folders for f in Path(d).rglob("shuffle_*.data") if f.exists())


def test_shuffles_of_written_tables_leave_the_disk(spark):
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(setting, None)
    df = spark.range(300_000).select(F.xxhash64("id").alias("key")).repartition(4, "key").groupBy("key").count()
    before = shuffle_bytes(spark)
    table = staged(df, "counted")
    end = time.monotonic() + 3  # soon, not when Java happens to collect its garbage
    while shuffle_bytes(spark) > before + 1_000_000 and time.monotonic() < end:
        time.sleep(0.1)
    assert shuffle_bytes(spark) <= before + 1_000_000  # the keys alone have 2.4 MB
    assert table.count() == 300_000 and spark.conf.get(setting, None) == was


def test_texts_are_shuffled_once_to_drop_copies(spark):
    docs = spark.createDataFrame([(i, f"text number {i % 900} of {i % 900} others") for i in range(1_000)], "doc_id long, text string")
    plan = nc.drop_near_copies(docs)._jdf.queryExecution().executedPlan().toString()
    last = plan[: plan.index("LeftSemi")]
    assert "Exchange hashpartitioning" not in last

"""Mixing sources to target weights by pivotal dependent rounding.

A document of a source is to be taken ``target / source size`` times. The whole part is taken as it is. Of the
fractional parts two are paired at a time, and mass moves at random from one to the other until one of them is
0 or 1; the other goes on to the next pair. The sum of a source's parts never changes, so what the source takes is its
target but for the sizes of the documents that were paired, which are alike: documents are paired by size.
Pairs are made inside small groups; what each group leaves over is grouped again, a tree with one root for each
source. Numbers of mass are integers of 2^-30, and every draw is a hash of the pair, so runs agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from stratafold.llm.shared import NOT_WHITE, staged, text_of, unused_names, with_nth

_ONE = 1 << 30
_FAN_IN = 32  # documents, or leftovers, that a node of the tree pairs
_SOURCE = ["no_source", "source_text"]  # a source without nulls
_UNIT = ["doc_id", "text_hash", "nth"]  # nth tells rows that repeat the others apart


def document_sizes(docs: DataFrame) -> DataFrame:
    """Key, source and number of words (runs of what is not white space) of each row."""
    return docs.select(
        "doc_id", F.xxhash64(text_of()).alias("text_hash"), F.col("source").isNull().alias("no_source"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source_text"), F.regexp_count(text_of(), F.lit(NOT_WHITE)).cast("long").alias("size"),
    )


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Per source: its size and target. Sources by code point, null last, take the weights in turn.

    All targets together are ``share`` of all sizes; none exceeds ``most`` times its source's size, and what is
    above goes to the others by weight until none is above. The rank of a source comes from sorted ranges and
    their counts, so that no task holds all sources.
    """
    spark = sizes.sparkSession
    order = [F.col(c) for c in _SOURCE]
    sources = sizes.groupBy(*_SOURCE).agg(F.sum("size").alias("source_size"))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = staged(sources.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "sources")
    placed = placed.withColumn("range", F.shiftright("place", 33))
    before = placed.groupBy("range").agg(F.count("*").alias("n"))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    before = before.select("range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    rank = F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    weight = F.get(F.array(*map(F.lit, weights)), (rank % len(weights)).cast("int"))
    weighted = staged(placed.join(before, "range").select(*_SOURCE, "source_size", weight.cast("long").alias("weight")), "source-weights")
    # raise the level (words for each unit of weight) until it no longer puts a source above its limit
    level, full = None, -1
    while True:
        above = F.lit(False) if level is None else F.col("weight") * F.lit(level) > F.col("source_size") * F.lit(most)
        now = weighted.agg(
            F.sum("source_size").alias("size"), F.count(F.when(above, 1)).alias("full"),
            F.coalesce(F.sum(F.when(above, F.col("source_size"))), F.lit(0)).alias("full_size"),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)).alias("open_weight"),
        ).first()
        if now.full == full or not now.open_weight:
            break
        full = now.full
        level = (share * now["size"] - most * now.full_size) / now.open_weight
    limit = F.col("source_size") * F.lit(most)
    target = limit if level is None or not now.open_weight else F.least(F.col("weight") * F.lit(level), limit)
    return weighted.select(*_SOURCE, "source_size", target.cast("double").alias("target"))


def _draw(seed: int, a: Column, b: Column) -> Column:
    return F.xxhash64(F.lit(seed), a.doc_id, a.text_hash, a.nth, b.doc_id, b.text_hash, b.nth).bitwiseAND(F.lit(_ONE - 1))


def _paired(items: Column, seed: int) -> Column:
    """Fold of a node's items: what is left over, and each settled item with 0 or 1."""

    def settled(item: Column, up: int) -> Column:
        return F.array(F.struct(*[item[c].alias(c) for c in _UNIT], F.lit(up).alias("up")))

    def left(item: Column, mass: Column) -> Column:
        return F.struct(item.size.alias("size"), *[item[c].alias(c) for c in _UNIT], mass.alias("mass"))

    def step(state: Column, item: Column) -> Column:
        own, mass, both = state.left, item.mass, state.left.mass + item.mass
        draw = _draw(seed, own, item)
        keeps = draw * both < own.mass * _ONE  # own gets all the mass, the item none
        rises = draw * (2 * _ONE - both) < (_ONE - mass) * _ONE  # own becomes 1, the item keeps the rest
        return (
            F.when(own.mass == _ONE, F.struct(left(item, mass).alias("left"), F.concat(state.done, settled(own, 1)).alias("done")))
            .when((both <= _ONE) & keeps, F.struct(left(own, both).alias("left"), F.concat(state.done, settled(item, 0)).alias("done")))
            .when(both <= _ONE, F.struct(left(item, both).alias("left"), F.concat(state.done, settled(own, 0)).alias("done")))
            .when(rises, F.struct(left(item, both - _ONE).alias("left"), F.concat(state.done, settled(own, 1)).alias("done")))
            .otherwise(F.struct(left(own, both - _ONE).alias("left"), F.concat(state.done, settled(item, 1)).alias("done")))
        )

    first = F.get(items, F.lit(0))
    none = F.slice(settled(first, 0), 1, 0)
    return F.aggregate(F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0))), F.struct(left(first, first.mass).alias("left"), none.alias("done")), step)


def rounded_up(units: DataFrame, seed: int = 42) -> DataFrame:
    """``units`` (source, key, size, mass of 2^-30) with ``up`` 0 or 1: the pivotal rounding of their masses.

    Units are grouped by size: a leaf holds some of one class of sizes within a quarter of an octave, and leaves
    are numbered from large to small sizes. How many leaves a class needs follows from its count, so a hot
    source has many leaves, and a key's hash says which one it is in.
    """
    sized = units.where(F.col("mass") > 0).withColumn("size_class", F.when(F.col("size") > 0, 1 + F.floor(4 * F.log2("size"))).otherwise(0).cast("int"))
    classes = sized.groupBy(*_SOURCE, "size_class").agg(F.ceil(F.count("*") / _FAN_IN).alias("leaves"))
    larger = Window.partitionBy(*_SOURCE).orderBy(F.desc("size_class")).rowsBetween(Window.unboundedPreceding, -1)
    classes = staged(classes.withColumn("before", F.coalesce(F.sum("leaves").over(larger), F.lit(0))), "size-classes")
    leaf = F.col("before") + F.pmod(F.xxhash64(F.lit(seed), *_UNIT), F.col("leaves"))
    items = sized.join(classes, [*_SOURCE, "size_class"]).select(*_SOURCE, leaf.alias("node"), F.struct("size", *_UNIT, "mass").alias("item"))
    done = None
    nodes = classes.groupBy(*_SOURCE).agg(F.sum("leaves").alias("n")).agg(F.max("n")).first()[0] or 0
    while True:
        gathered = items.groupBy(*_SOURCE, "node").agg(F.sort_array(F.collect_list("item"), asc=False).alias("items"))
        level = staged(gathered.select(*_SOURCE, "node", _paired(F.col("items"), seed).alias("s")).select(*_SOURCE, "node", "s.left", "s.done"), "mix-level")
        settled = level.select(*_SOURCE, F.explode("done").alias("d")).select(*_SOURCE, "d.*")
        done = settled if done is None else done.union(settled)
        if nodes <= 1:
            break
        nodes = -(-nodes // _FAN_IN)
        items = level.select(*_SOURCE, F.floor(F.col("node") / _FAN_IN).alias("node"), F.col("left").alias("item"))
    draw = F.xxhash64(F.lit(seed), F.lit("root"), *[f"left.{c}" for c in _UNIT]).bitwiseAND(F.lit(_ONE - 1))
    root = level.select(*_SOURCE, *[f"left.{c}" for c in _UNIT], (draw < F.col("left.mass")).cast("int").alias("up"))
    return done.union(root)


def _rows(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sizes of all rows with a null-safe ``key`` of doc_id, source and text, and ``nth``, which numbers the rows of a key; and the keys that repeat."""
    key = F.struct("doc_id", "no_source", "source_text", "text_hash").alias("key")
    sizes = staged(document_sizes(docs).select("*", key, F.monotonically_increasing_id().alias("place")), "sizes")
    again = staged(sizes.groupBy("key").count().where("count > 1").select("key", F.lit(True).alias("again")), "repeated")
    marked = sizes.join(again, "key", "left")
    numbered = with_nth(marked.where("again"), "key", "place", "nth")
    return staged(marked.where(F.col("again").isNull()).withColumn("nth", F.lit(0).cast("long")).unionByName(numbered).drop("place"), "rows"), again


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 42) -> DataFrame:
    """Per row of the input: doc_id, source, size, source_size, target, copies and taken (words).

    ``size`` counts words, 0 for a null text. A null source is a source of its own, the last. Rows that repeat
    doc_id, source and text are units of their own, told apart by a number; a null doc_id is a key like any other, and ids may have any type.
    A source without words has target 0 and takes no copies. Other columns are not read.
    """
    return _planned(_rows(docs)[0], weights, share, most, seed).select(
        "doc_id", "text_hash", F.when(~F.col("no_source"), F.col("source_text")).alias("source"), "size", "source_size", "target",
        "copies", (F.col("copies") * F.col("size")).alias("taken"),
    )


def _planned(rows: DataFrame, weights: tuple[int, ...], share: float, most: float, seed: int) -> DataFrame:
    """``rows`` with the size and target of their source, and ``copies``."""
    wanted = staged(source_targets(rows, weights, share, most), "targets")
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    mass = F.round((F.col("times") - F.floor("times")) * _ONE).cast("long")
    keyed = rows.join(wanted.withColumn("times", times), _SOURCE)
    units = keyed.select(*_SOURCE, *_UNIT, "size", mass.alias("mass"))
    up = rounded_up(units, seed).select(F.struct("doc_id", *_SOURCE, "text_hash").alias("key"), "nth", "up")
    whole = F.floor("times") + F.floor(mass / _ONE)  # a part that rounds to 1 is a whole copy
    return keyed.join(up, ["key", "nth"], "left").withColumn("copies", whole + F.when(mass % _ONE > 0, F.coalesce("up", F.lit(0))).otherwise(0))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 42) -> DataFrame:
    """The mixed corpus: each row of the input as many times as the plan takes it, with its own columns.

    Rows that repeat doc_id, source and text are numbered among themselves, and share the plan's copies by number.
    """
    key, place, nth, copies, copy = unused_names(docs, "key", "place", "nth", "copies", "copy")
    rows, again = _rows(docs)
    taken = _planned(rows, weights, share, most, seed).where(F.col("copies") > 0)
    plan = taken.select(F.col("key").alias(key), F.col("nth").alias(nth), F.col("copies").cast("long").alias(copies))
    source = F.col("source")
    keyed = docs.withColumn(key, F.struct("doc_id", source.isNull().alias("no_source"), F.coalesce(source.cast("string"), F.lit("")).alias("source_text"), F.xxhash64(text_of()).alias("text_hash")))
    repeated = again.select(F.col("key").alias(key))
    several = staged(keyed.join(repeated, key, "left_semi").withColumn(place, F.monotonically_increasing_id()), "repeated-rows")
    numbered = with_nth(several, key, place, nth).drop(place)
    every = keyed.join(repeated, key, "left_anti").withColumn(nth, F.lit(0).cast("long")).unionByName(numbered)
    return every.join(plan, [key, nth]).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*docs.columns)

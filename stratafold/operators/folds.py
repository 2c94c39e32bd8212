"""Stratified folds and hold-outs: exact cut points and ranks inside a class, without one task per class."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..bounded import join_small, local_if_small, pin
from ..session import checkpoint_dir, kept, short_shuffles


def hash_order(key: list[str], seed: int | Column) -> Column:
    """A reproducible random order: md5 of the seed and every key part with its length, '-' where it is NULL."""
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    text = [F.col(k).cast("string") for k in key]
    return F.md5(F.concat(seed.cast("string"), *[F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]))


def with_group_rank(
    df: DataFrame, group: list[str], order: list[Column], bucket: str, rank: str = "_rank", per_group: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Exact row_number of every row inside its group, by ``order``, for groups of any size.

    ``bucket`` names a column that is a coarse version of the order: rows with a smaller bucket come
    first. Rows are ranked inside (group, bucket), and the number of rows in the group's earlier
    buckets is added. A group holding a third of the table is thereby spread over all its buckets;
    only the counts per (group, bucket) are added up per group. The counts join on the columns the
    ranking was partitioned by, so the table itself is shuffled and sorted once. NULL is a group, and a
    bucket, like any other. ``per_group`` adds columns to a table of one row per group (group columns and ``size``);
    they end up on every row.
    """
    parts = ["_in_bucket", "_in_group"]  # structs: their NULLs are equal
    keyed = df.withColumns({"_in_bucket": F.struct(bucket), "_in_group": F.struct(*group)})
    counts = keyed.groupBy(*parts).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_in_group").orderBy("_in_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*parts, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    extra: list[str] = []
    if per_group is not None:
        groups = counts.groupBy("_in_group").agg(F.sum("_n").alias("size")).select("_in_group", "_in_group.*", "size")
        added = per_group(groups)
        extra = [c for c in added.columns if c not in groups.columns]
        offsets = offsets.join(added.select("_in_group", *extra), "_in_group")
    local = keyed.withColumn("_local", F.row_number().over(Window.partitionBy(*parts).orderBy(*order)))
    return local.join(offsets, parts).withColumn(rank, F.col("_local") + F.col("_before")).select(*df.columns, rank, *extra)


SLICE_DIGITS = 3  # hex digits of the order by which a search for cut points narrows at a time: 4,096 slices of a group
FEW_CUTS = 16  # cut points of a group that are compared one by one in a compiled expression
SLICE_ROWS = 500_000  # rows of one slice that a task may sort; larger slices are cut into finer ones first


def running_total(df: DataFrame, within: list[str], order: list[str], value: Column, out: str) -> DataFrame:
    """Add the sum of ``value`` over the rows that come before, in hash order of the columns ``order``, for tables of any size.

    Two levels: rows are added up inside 256 ranges of the hash, and the ranges' totals are added up in turn, so that no
    window holds all rows. ``within`` are the columns each sum starts anew for.
    """
    hashed = df.withColumns({"_h": hash_order(order, "class"), "_within": F.struct(F.lit(0), *within)})
    ranged = hashed.withColumn("_range", F.substring("_h", 1, 2))
    totals = ranged.groupBy("_within", "_range").agg(F.sum(value).alias("_total"))
    before = Window.partitionBy("_within").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = totals.select("_within", "_range", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_within", "_range").orderBy("_h", *order).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("_local", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return local.join(starts, ["_within", "_range"]).withColumn(out, F.col("_start") + F.col("_local")).select(*df.columns, out)


def _cut(df: DataFrame, key: list[str], group: list[str], seed: int | Column, per_group: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Add ``_passed``, how many cut points of its group lie at or before a row in hash order, and what ``per_group`` adds.

    ``per_group`` gets one row for each group (its columns and ``size``) and adds ``_ranks``, the ranks (from 0) of the rows that are cut points.
    These rows are found by counting: rows are counted by group and slice of the hash, the slices the ranks fall in
    are counted by finer slices while they are large, and only what is left is sorted. The table itself is read, never shuffled: at last each
    row is compared with the cut points of its group, a small table that is fetched and broadcast (joined, if there are very many groups).
    """
    grouped = df.withColumn("_in_group", F.struct(*group))
    # the hash is made anew after a shuffle: it is longer than what it is made from
    salt = [seed.cast("string").alias("_salt")] if isinstance(seed, Column) else []
    narrow = grouped.select("_in_group", *salt, F.struct(*key).alias("_key"))
    hash_ = hash_order([f"_key.{c}" for c in key], F.col("_salt") if salt else seed)
    place = F.struct(hash_.alias("_hash"), "_key.*")
    checkpoint_dir(df.sparkSession)
    digits = SLICE_DIGITS

    def counted(rows: DataFrame, digits: int) -> DataFrame:
        return rows.groupBy("_in_group", F.substring(hash_, 1, digits).alias("_slice")).agg(F.count("*").alias("_n")).checkpoint()

    counts = counted(narrow, digits)
    groups = counts.groupBy("_in_group").agg(F.sum("_n").alias("size")).select("_in_group", "_in_group.*", "size")
    added = _once(per_group(groups).drop(*group, "size"))
    wanted = added.select("_in_group", F.posexplode("_ranks").alias("_i", "_rank"))

    def located(counts: DataFrame, wanted: DataFrame, within: list[str]) -> DataFrame:
        """The slice of each wanted rank, and its rank in there."""
        before = Window.partitionBy(*within).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # 4,096 rows at most
        starts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        inside = (F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_n"))
        found = starts.join(wanted, within).where(inside)
        return _once(found.select("_in_group", "_slice", "_i", (F.col("_rank") - F.col("_before")).alias("_rank"), "_n"))

    places = located(counts, wanted, ["_in_group"])
    while (places.agg(F.max("_n")).first()[0] or 0) > SLICE_ROWS and digits < 30:
        digits, coarse = digits + SLICE_DIGITS, digits
        near = _near(narrow, hash_, places, coarse)
        finer = counted(near, digits).withColumn("_coarse", F.substring("_slice", 1, coarse))
        places = located(finer, places.select("_in_group", F.col("_slice").alias("_coarse"), "_i", "_rank"), ["_in_group", "_coarse"])
    ranked = _near(narrow, hash_, places, digits).withColumn("_place", place).withColumn("_at", F.row_number().over(Window.partitionBy("_in_group", "_slice").orderBy("_place")) - 1)
    cuts = ranked.join(places.select("_in_group", "_slice", F.col("_rank").alias("_at")), ["_in_group", "_slice", "_at"])
    per = _once(added.drop("_ranks").join(cuts.groupBy("_in_group").agg(F.collect_list("_place").alias("_cuts")), "_in_group", "left"))
    near = join_small(grouped, per, ["_in_group"]).withColumn("_hash", hash_order(key, seed))
    place, most = F.struct("_hash", *key), added.agg(F.max(F.size("_ranks"))).first()[0] or 0
    if most <= FEW_CUTS:  # plain comparisons, which Spark compiles
        passed = sum((F.coalesce((F.get("_cuts", F.lit(i)) <= place).cast("int"), F.lit(0)) for i in range(most)), F.lit(0))
    else:
        passed = F.size(F.filter(F.coalesce("_cuts", F.array()), lambda c: c <= place))
    extra = [c for c in per.columns if c not in ("_in_group", "_cuts")]
    return near.withColumn("_passed", passed).select(*df.columns, "_passed", *extra)


def _near(narrow: DataFrame, hash_: Column, places: DataFrame, digits: int) -> DataFrame:
    """Rows of the slices that hold a cut point."""
    sliced = narrow.withColumn("_slice", F.substring(hash_, 1, digits))
    return join_small(sliced, places.select("_in_group", "_slice").distinct(), ["_in_group", "_slice"])


def _once(df: DataFrame) -> DataFrame:
    """The same table, computed once: local if it is small, else written."""
    pinned = pin(df)
    return kept(df, "cuts") if pinned is None else pinned.df


def _dealt(df: DataFrame, key: list[str], label: str, seed: int | Column, k: int, fold: str, within: list[str]) -> DataFrame:
    """Each class in k runs of its hash order, the first in the fold where the class before has ended."""

    def start(groups: DataFrame) -> DataFrame:
        share, more = F.floor(F.col("size") / k), F.col("size") % k
        ranks = F.array(*[share * i + F.least(F.lit(i).cast("long"), more) for i in range(1, k)])
        real = F.filter(ranks, lambda r: r < F.col("size"))
        return running_total(groups, within, [label], F.col("size"), "_start").withColumn("_ranks", F.array_distinct(real))

    with short_shuffles(df.sparkSession):
        cut = _cut(df, key, [*within, label], seed, start)
    return cut.withColumn(fold, F.pmod(F.col("_start") + F.col("_passed"), F.lit(k)).cast("int")).drop("_passed", "_start")


def stratified_kfold(
    df: DataFrame, key: list[str], label: str, k: int = 3, seed: int = 42, fold: str = "fold"
) -> DataFrame:
    """Add ``fold`` in 0..k-1: the rows of a class in hash order, cut into k runs.

    ``key`` must identify rows. The cut points are found when this is called; the fold is then a comparison with
    them, and no row moves. Fold sizes differ by at most one inside every class, and in total. NULL is a class.
    """
    return _dealt(df, key, label, seed, k, fold, [])


def hashed_kfold(df: DataFrame, key: list[str], k: int = 3, seed: int = 42, fold: str = "fold") -> DataFrame:
    """Approximately stratified folds in one narrow pass: class shares hold up to sampling error."""
    number = F.conv(F.substring(hash_order(key, seed), 1, 12), 16, 10).cast("long")
    return df.withColumn(fold, F.pmod(number, F.lit(k)).cast("int"))


def repeated_stratified_kfold(
    df: DataFrame, key: list[str], label: str, seeds: list[int], k: int = 3, run: str = "run", fold: str = "fold"
) -> DataFrame:
    """One copy of each row per seed, with ``run`` and ``fold``. Pass key and label only; join features later."""
    runs = F.array(*[F.struct(F.lit(i).alias(run), F.lit(s).alias("_seed")) for i, s in enumerate(seeds)])
    copies = df.select("*", F.inline(runs))
    return _dealt(copies, key, label, F.col("_seed"), k, fold, [run]).drop("_seed")


def stratified_holdout(
    df: DataFrame, key: list[str], label: str, fraction: float = 0.2, seed: int = 42, part: str = "part"
) -> DataFrame:
    """Add ``part``: 'test' for ceil(fraction * n) rows, shared among the classes in proportion, else 'train'.

    A class gets the whole part of its share; what is left goes to the largest remainders (ties: to the smaller
    class, then in hash order of the class), one row each. The first rows of a class in hash order are its test rows. At least one
    row of every class trains, so that a class of one row is not counted in n and never tested.
    """

    def share(groups: DataFrame) -> DataFrame:
        # classes of one size have one quota: what is shared out is worked out for the sizes, of which a table of n rows has at most sqrt(2 n)
        sizes = groups.where("size > 1").groupBy("size").agg(F.count("*").alias("_classes"))
        everywhere = Window.partitionBy()
        total = F.sum(F.col("size") * F.col("_classes")).over(everywhere)
        wanted = F.ceil(F.lit(float(fraction)) * total)
        shared = sizes.withColumns({"_wanted": wanted, "_quota": wanted.cast("double") * F.col("size") / total})
        before = Window.orderBy(F.desc(F.col("_quota") - F.floor("_quota")), "size").rowsBetween(Window.unboundedPreceding, -1)
        left = F.col("_wanted") - F.sum(F.floor("_quota") * F.col("_classes")).over(everywhere) - F.coalesce(F.sum("_classes").over(before), F.lit(0))
        more = shared.select("size", F.floor("_quota").alias("_whole"), left.alias("_more"))
        ranked = running_total(groups, ["size"], [label], F.lit(1), "_nth").join(more, "size", "left")
        take = F.least(F.col("_whole") + (F.col("_nth") < F.col("_more")).cast("int"), F.col("size") - 1)
        return ranked.withColumn("_ranks", F.array(F.coalesce(take, F.lit(0)).cast("long"))).drop("_nth", "_whole", "_more")

    with short_shuffles(df.sparkSession):
        cut = _cut(df, key, [label], seed, share)
    return cut.withColumn(part, F.when(F.col("_passed") == 0, "test").otherwise("train")).drop("_passed")


def class_weights(df: DataFrame, label: str, weight: str = "weight") -> DataFrame:
    """(label, weight) with weight n / (n_classes * n_class)."""
    counts = local_if_small(df.groupBy(label).agg(F.count("*").alias("_n")))
    total = counts.agg(F.sum("_n")).scalar()
    n_classes = counts.agg(F.count("*")).scalar()
    return counts.select(label, (total / (n_classes * F.col("_n"))).cast("double").alias(weight))


def balanced_weights(df: DataFrame, label: str, weight: str = "weight") -> DataFrame:
    """Add the class weight to every row."""
    return join_small(df, class_weights(df, label, weight), [label], "left").select(*df.columns, weight)

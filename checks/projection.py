"""Projections, label handling, value mapping and set operations."""

from pyspark.sql import functions as F

from stratafold.bounded import is_in
from stratafold.functions.scalar import log1p_clipped, num
from stratafold.operators import projection as p
from stratafold.plans.registry import FeatureRegistry

from .base import LINE_KEY, LK, Checks, r, rounded, table

CHECKS = Checks()


@CHECKS.add(f"SELECT {LK}, l_quantity, l_extendedprice, l_linestatus, l_returnflag FROM lineitem")
def split_features_label(spark, sf_dir):
    """Features without the label and without superseded columns, and the label half beside them."""
    features, labels = p.split_features_label(
        table(spark, sf_dir, "lineitem"), LINE_KEY, "l_returnflag", ["l_discount", "l_tax", "l_shipdate"]
    )
    return features.join(labels, LINE_KEY)


@CHECKS.add(
    f"""SELECT {LK}, CASE WHEN (SELECT min(l_linenumber) FROM lineitem) = 1
          THEN l_linenumber - 1 ELSE l_linenumber END AS label FROM lineitem"""
)
def normalize_label(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(*LINE_KEY, F.col("l_linenumber").alias("label"))
    return p.normalize_label(lines, "label")


@CHECKS.add(f"SELECT {LK}, l_linenumber - 1 AS zero_based, l_linenumber AS one_based FROM lineitem")
def shift_label(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(*LINE_KEY, F.col("l_linenumber").alias("zero_based"))
    shifted = p.shift_label(lines, "zero_based", 1).withColumn("one_based", F.col("zero_based"))
    return p.shift_label(shifted, "one_based", -1)


@CHECKS.add("SELECT CAST(l_linenumber AS VARCHAR) AS category, count(*) AS n FROM lineitem GROUP BY 1")
def cast_label(spark, sf_dir):
    lines = p.cast_label(table(spark, sf_dir, "lineitem"), "l_linenumber", "category")
    return lines.groupBy(F.col("l_linenumber").alias("category")).agg(F.count("*").alias("n"))


@CHECKS.add(f"SELECT {LK}, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem")
def select_columns(spark, sf_dir):
    """Columns by name part and type."""
    lines = table(spark, sf_dir, "lineitem")
    names = p.select_columns(lines, prefix="l_", not_prefix=tuple(LINE_KEY), numeric=True)
    return lines.select(*LINE_KEY, *names)


@CHECKS.add(
    """SELECT s_suppkey AS c_custkey, s_name AS c_name, s_nationkey AS c_nationkey, s_acctbal AS c_acctbal,
       '0' AS c_mktsegment FROM supplier"""
)
def align_columns(spark, sf_dir):
    """Missing columns are filled, extra ones dropped, order as in the target."""
    supplier = table(spark, sf_dir, "supplier").toDF("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    return p.align_columns(supplier.withColumn("extra", F.lit(1)), table(spark, sf_dir, "customer"))


@CHECKS.add("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < -500)")
def filter_in(spark, sf_dir):
    debtors = table(spark, sf_dir, "customer").where(F.col("c_acctbal") < -500).select("c_custkey")
    return is_in(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", debtors)


@CHECKS.add("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < -500)")
def filter_not_in(spark, sf_dir):
    debtors = table(spark, sf_dir, "customer").where(F.col("c_acctbal") < -500).select("c_custkey")
    return is_in(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", debtors, keep=False)


_PARTIES = "SELECT c_custkey AS id, c_nationkey AS nation, c_acctbal AS balance, 'train' AS split FROM customer UNION ALL SELECT s_suppkey, s_nationkey, s_acctbal, 'test' FROM supplier"


def _parties(spark, sf_dir):
    names = ["id", "nation", "balance"]
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal").toDF(*names)
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal").toDF(*names)
    return customer, supplier


@CHECKS.add(_PARTIES)
def tag_split(spark, sf_dir):
    return p.tag_split(*_parties(spark, sf_dir))


@CHECKS.add(f"SELECT id, nation, balance FROM ({_PARTIES}) WHERE split = 'test'")
def untag(spark, sf_dir):
    return p.untag(p.tag_split(*_parties(spark, sf_dir)))[1]


@CHECKS.add(f"SELECT nation, count(*) AS n, {r('sum(balance)', 2)} AS balance FROM ({_PARTIES}) GROUP BY nation")
def union_tables(spark, sf_dir):
    both = p.union_tables(*_parties(spark, sf_dir))
    return both.groupBy("nation").agg(F.count("*").alias("n"), rounded(F.sum("balance"), 2).alias("balance"))


def _registry():
    registry = FeatureRegistry()
    registry.add("revenue", lambda: [rounded(num("l_extendedprice") * (1 - num("l_discount")), 4).alias("revenue")], drops=["l_discount"])
    registry.add("unit", lambda: [rounded(num("l_extendedprice") / num("l_quantity"), 8).alias("unit_price")])
    registry.add("unit_root", lambda: [rounded(F.sqrt("unit_price")).alias("unit_price_root")], after=["unit"])
    registry.add("tax", lambda: [rounded(num("l_extendedprice") * num("l_tax"), 4).alias("tax_due")])
    return registry


@CHECKS.add(
    f"""SELECT {LK}, l_quantity, l_extendedprice, l_tax, {r('l_extendedprice * (1 - l_discount)', 4)} AS revenue,
        {r('l_extendedprice / l_quantity', 8)} AS unit_price,
        {r('sqrt(' + r('l_extendedprice / l_quantity', 8) + ')')} AS unit_price_root FROM lineitem"""
)
def feature_set(spark, sf_dir):
    """Feature groups switched on by name: one of four stays off."""
    lines = table(spark, sf_dir, "lineitem").select(*LINE_KEY, "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return _registry().apply(lines, ["unit_root", "revenue", "unit"])


@CHECKS.add(
    """WITH rare AS (SELECT c_nationkey FROM customer GROUP BY c_nationkey HAVING count(*) <
         (SELECT avg(n) FROM (SELECT count(*) AS n FROM customer GROUP BY c_nationkey)))
       SELECT CASE WHEN c_nationkey IN (SELECT c_nationkey FROM rare) THEN -1 ELSE c_nationkey END AS c_nationkey,
         count(*) AS n FROM customer GROUP BY 1"""
)
def replace_values(spark, sf_dir):
    """All nations with fewer customers than average become one value."""
    customer = table(spark, sf_dir, "customer")
    counts = customer.groupBy("c_nationkey").agg(F.count("*").alias("n"))
    small = counts.where(F.col("n") < counts.agg(F.avg("n")).scalar()).select("c_nationkey")
    replaced = p.replace_values(customer, "c_nationkey", small, F.lit(-1))
    return replaced.groupBy("c_nationkey").agg(F.count("*").alias("n"))


@CHECKS.add(
    """SELECT CASE c_mktsegment WHEN 'BUILDING' THEN 'HOUSE' WHEN 'FURNITURE' THEN 'HOUSE' ELSE c_mktsegment END AS segment,
       count(*) AS n FROM customer GROUP BY 1"""
)
def map_values(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").withColumn("segment", F.col("c_mktsegment"))
    mapped = p.map_values(customer, "segment", {"BUILDING": "HOUSE", "FURNITURE": "HOUSE"})
    return mapped.groupBy("segment").agg(F.count("*").alias("n"))


@CHECKS.add(f"SELECT c_custkey, {r('ln(1 + c_nationkey)')} AS nation_log1p FROM customer")
def add_if_all(spark, sf_dir):
    """A log column is added only where every value is non-negative: balances are not."""
    customer = table(spark, sf_dir, "customer")
    added = p.add_if_all(
        customer.select("c_custkey", "c_acctbal", "c_nationkey"),
        {
            "balance_log1p": (F.col("c_acctbal") >= 0, rounded(log1p_clipped("c_acctbal"))),
            "nation_log1p": (F.col("c_nationkey") >= 0, rounded(log1p_clipped("c_nationkey"))),
        },
    )
    return added.drop("c_acctbal", "c_nationkey")


@CHECKS.add(f"SELECT {LK}, {r('l_extendedprice / l_quantity', 8)} AS unit_price FROM lineitem")
def drop_intermediates(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(*LINE_KEY, "l_extendedprice", "l_quantity")
    derived = lines.withColumn("unit_price", rounded(num("l_extendedprice") / num("l_quantity"), 8))
    return p.drop_intermediates(derived, ["l_extendedprice", "l_quantity"])

"""Fitted preprocessing."""

from pyspark.sql import functions as F

from stratafold.functions.builders import sparse_cross
from stratafold.operators import scaling as s
from stratafold.operators.projection import tag_split, untag

from .aggregate import HOLED, holed
from .base import FEATURES, FOLDS, LINE_KEY, LK, Checks, fold_sql, r, rounded, table
from .keyed import folded_lines

CHECKS = Checks()


def _std(c, source, x=None):
    return r(f"({x or c} - (SELECT avg({c}) FROM {source})) / (SELECT stddev_pop({c}) FROM {source})")


def _mm(c, source, x=None):
    return r(f"({x or c} - (SELECT min({c}) FROM {source})) / (SELECT max({c}) - min({c}) FROM {source})")


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(*LINE_KEY, *FEATURES, F.lit(3.0).alias("flat"))


def _shown(df, cols, extra=()):
    return df.select(*LINE_KEY, *extra, *[rounded(c).alias(c) for c in cols])


@CHECKS.add(f"SELECT {LK}, " + ", ".join(f"{_std(c, 'lineitem')} AS {c}" for c in FEATURES) + ", 0.0::DOUBLE AS flat FROM lineitem")
def standardize(spark, sf_dir):
    """Population standard deviation; a constant column becomes 0."""
    cols = [*FEATURES, "flat"]
    return _shown(s.standardize(_lines(spark, sf_dir), cols), cols)


@CHECKS.add(f"SELECT {LK}, " + ", ".join(f"{_mm(c, 'lineitem')} AS {c}" for c in FEATURES) + ", 0.0::DOUBLE AS flat FROM lineitem")
def minmax(spark, sf_dir):
    cols = [*FEATURES, "flat"]
    return _shown(s.minmax(_lines(spark, sf_dir), cols), cols)


_FOLDED = fold_sql("lineitem", LINE_KEY, "l_returnflag")


def _per_fold_sql(kind):
    parts = []
    for f in FOLDS:
        other = f"(SELECT * FROM f WHERE fold <> {f})"
        parts.append(f"SELECT {LK}, fold, " + ", ".join(f"{kind(c, other)} AS {c}" for c in FEATURES) + f" FROM f WHERE fold = {f}")
    return f"WITH f AS ({_FOLDED}) " + " UNION ALL ".join(parts)


@CHECKS.add(_per_fold_sql(_std))
def standardize_per_fold(spark, sf_dir):
    """Validation rows scaled with what the other folds' rows say: no leak."""
    return _shown(s.standardize_validation_rows(folded_lines(spark, sf_dir), FEATURES, FOLDS), FEATURES, ["fold"])


@CHECKS.add(_per_fold_sql(_mm))
def minmax_per_fold(spark, sf_dir):
    return _shown(s.minmax_validation_rows(folded_lines(spark, sf_dir), FEATURES, FOLDS), FEATURES, ["fold"])


# The seventh line of an order trains in every fold.
_HALVES = f"""f AS (SELECT * EXCLUDE (fold), CASE WHEN l_linenumber < 7 THEN fold END AS fold FROM ({_FOLDED})),
  h AS (SELECT CAST(unnest([0, 1, 2]) AS INTEGER) AS held_out)"""


def _halves(spark, sf_dir):
    folded = folded_lines(spark, sf_dir)
    return folded.withColumn("fold", F.when(F.col("l_linenumber") < 7, F.col("fold")))


def _halves_sql(scale):
    stats = ", ".join(f"avg({c}) AS avg_{c}, stddev_pop({c}) AS std_{c}, min({c}) AS min_{c}, max({c}) AS max_{c}" for c in FEATURES)
    return f"""WITH {_HALVES}, st AS (SELECT held_out, {stats} FROM f, h WHERE fold IS DISTINCT FROM held_out GROUP BY held_out)
      SELECT {LK}, held_out, CASE WHEN fold = held_out THEN 'valid' ELSE 'train' END AS part, {", ".join(f"{r(scale(c))} AS {c}" for c in FEATURES)} FROM f, st"""


@CHECKS.add(_halves_sql(lambda c: f"({c} - avg_{c}) / std_{c}"))
def standardize_both_halves(spark, sf_dir):
    """Training and validation rows of each fold under the statistics of its training rows, some rows training in all."""
    return _shown(s.scale_both_halves(_halves(spark, sf_dir), FEATURES, FOLDS), FEATURES, ["held_out", "part"])


@CHECKS.add(_halves_sql(lambda c: f"({c} - min_{c}) / (max_{c} - min_{c})"))
def minmax_both_halves(spark, sf_dir):
    return _shown(s.scale_both_halves(_halves(spark, sf_dir), FEATURES, FOLDS, how="minmax"), FEATURES, ["held_out", "part"])


@CHECKS.add(
    f"""SELECT s_suppkey, {r('(s_acctbal - (SELECT avg(c_acctbal) FROM customer)) / (SELECT stddev_pop(c_acctbal) FROM customer)')} AS balance FROM supplier"""
)
def fit_train_apply_test(spark, sf_dir):
    """Statistics of one table applied to another."""
    train = table(spark, sf_dir, "customer").select(F.col("c_acctbal").alias("balance"))
    test = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("balance"))
    return s.apply_standard(test, s.fit_stats(train, ["balance"]), ["balance"]).withColumn("balance", rounded("balance"))


_BOTH = "(SELECT c_acctbal AS b FROM customer UNION ALL SELECT s_acctbal FROM supplier)"


@CHECKS.add(f"SELECT s_suppkey AS id, {r(f'(s_acctbal - (SELECT min(b) FROM {_BOTH})) / (SELECT max(b) - min(b) FROM {_BOTH})')} AS balance FROM supplier")
def fit_on_train_and_test(spark, sf_dir):
    """Joint scaling of the stacked tables, then the test rows alone."""
    train = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    test = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    scaled = s.minmax(tag_split(train, test), ["balance"])
    return untag(scaled)[1].withColumn("balance", rounded("balance"))


@CHECKS.add(
    f"""SELECT {LK}, {r(f'''CASE WHEN price IS NULL OR isnan(price) THEN (SELECT avg(price) FROM ({HOLED}) WHERE NOT isnan(price)) ELSE price END''', 4)} AS price
        FROM ({HOLED})"""
)
def impute_mean(spark, sf_dir):
    """NULL and NaN are both missing."""
    filled = s.impute_mean(holed(spark, sf_dir).drop("quantity"), ["price"])
    return filled.withColumn("price", rounded("price", 4))


@CHECKS.add(
    f"""WITH h AS ({HOLED}),
        a AS (SELECT *, coalesce(quantity, (SELECT median(quantity) FROM h)) AS q1,
               CASE WHEN price IS NULL OR isnan(price) THEN (SELECT median(price) FROM h WHERE NOT isnan(price)) ELSE price END AS p1 FROM h)
        SELECT {LK}, p1 AS price, CASE WHEN isinf(q1) THEN (SELECT median(q1) FROM a WHERE NOT isinf(q1)) ELSE q1 END AS quantity FROM a"""
)
def impute_median(spark, sf_dir):
    return s.impute_median(holed(spark, sf_dir), ["price", "quantity"])


@CHECKS.add(
    f"""WITH h AS ({HOLED}) SELECT {LK}, CASE WHEN quantity = 'inf'::DOUBLE THEN (SELECT max(quantity) + 1 FROM h WHERE isfinite(quantity))
          WHEN quantity = '-inf'::DOUBLE THEN (SELECT min(quantity) - 1 FROM h WHERE isfinite(quantity)) ELSE quantity END AS quantity FROM h"""
)
def cap_infinite(spark, sf_dir):
    return s.cap_infinite(holed(spark, sf_dir).drop("price"), ["quantity"])


@CHECKS.add(f"SELECT {LK}, {r('l_quantity + l_extendedprice + l_discount + l_tax', 4)} AS total, CAST(4 AS INTEGER) AS width FROM lineitem")
def assemble_features(spark, sf_dir):
    """Feature array of every row, seen through its sum and size."""
    packed = s.assemble_array(_lines(spark, sf_dir), FEATURES)
    total = F.aggregate("features", F.lit(0.0), lambda acc, x: acc + x)
    return packed.select(*LINE_KEY, rounded(total, 4).alias("total"), F.size("features").alias("width"))


_FLAGS = ["A", "N", "R"]


@CHECKS.add(
    f"""SELECT {LK}, CAST(2 + {len(_FLAGS) * 2} AS INTEGER) AS width,
          array_to_string([CAST(0 AS INTEGER)] || CASE WHEN l_discount <> 0 THEN [CAST(1 AS INTEGER)] ELSE [] END ||
          [CAST(2 + 2 * (list_position({_FLAGS}, l_returnflag) - 1) + CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS INTEGER)], ',') AS places, {r('l_quantity + l_discount + l_quantity', 4)} AS total
        FROM lineitem"""
)
def assemble_sparse(spark, sf_dir):
    """Two columns and a cross of flags with status, weighted by quantity, as one sparse vector."""
    flags = [F.when(F.col("l_returnflag") == f, F.col("l_quantity")).otherwise(0.0).alias(f"flag_{f}") for f in _FLAGS]
    states = [(F.col("l_linestatus") == t).cast("double").alias(f"state_{t}") for t in ("F", "O")]
    lines = table(spark, sf_dir, "lineitem").select(*LINE_KEY, "l_quantity", "l_discount", *flags, *states)
    crossed = lines.withColumn("cross", sparse_cross([f"flag_{f}" for f in _FLAGS], ["state_F", "state_O"]))
    packed = s.assemble_sparse(crossed, ["l_quantity", "l_discount"], ["cross"])
    # seen through the vector's own text: (size,[indices],[values])
    text = F.col("features").cast("string")
    places = F.regexp_extract(text, r",\[([0-9,]*)\],", 1)
    total = F.aggregate(F.split(F.regexp_extract(text, r",\[([^\]]*)\]\)$", 1), ",").cast("array<double>"), F.lit(0.0), lambda acc, x: acc + x)
    return packed.select(*LINE_KEY, F.regexp_extract(text, r"^\(([0-9]+),", 1).cast("int").alias("width"), places.alias("places"), rounded(total, 4).alias("total"))

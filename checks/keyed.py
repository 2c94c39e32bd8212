"""Row gathering by key."""

from pyspark.sql import functions as F

from stratafold.operators import keyed as k
from stratafold.operators.aggregates import class_counts
from stratafold.operators.folds import stratified_kfold
from stratafold.operators.knn import knn_join
from stratafold.operators.vector_index import build_index, search_index, visited_share

from .base import FEATURES, LINE_KEY, LK, Checks, fold_sql, r, rounded, table

CHECKS = Checks()
_FOLDED = fold_sql("lineitem", LINE_KEY, "l_returnflag")


def folded_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(*LINE_KEY, "l_returnflag", *FEATURES)
    return stratified_kfold(lines, LINE_KEY, "l_returnflag")


@CHECKS.add(f"SELECT {LK}, l_returnflag FROM ({_FOLDED}) WHERE fold <> 1")
def train_of_fold(spark, sf_dir):
    return k.train_of(folded_lines(spark, sf_dir), 1).select(*LINE_KEY, "l_returnflag")


@CHECKS.add(f"SELECT {LK}, l_returnflag FROM ({_FOLDED}) WHERE fold = 1")
def valid_of_fold(spark, sf_dir):
    return k.valid_of(folded_lines(spark, sf_dir), 1).select(*LINE_KEY, "l_returnflag")


@CHECKS.add(
    f"""WITH f AS ({_FOLDED}), p AS (SELECT {LK}, CASE WHEN l_quantity > 25 THEN 'R' ELSE 'N' END AS prediction FROM f WHERE fold <> 2)
        SELECT {LK}, l_returnflag, prediction FROM f LEFT JOIN p USING ({LK})"""
)
def collect_oof(spark, sf_dir):
    """Predictions of two of three folds back on the table; the third fold's rows have none."""
    folded = folded_lines(spark, sf_dir)
    guess = F.when(F.col("l_quantity") > 25, "R").otherwise("N")
    parts = [k.valid_of(folded, f).withColumn("prediction", guess) for f in (0, 1)]
    return k.collect_oof(folded.select(*LINE_KEY, "l_returnflag"), parts, LINE_KEY)


@CHECKS.add(
    """SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS
       (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 48)"""
)
def drop_keys(spark, sf_dir):
    large = table(spark, sf_dir, "lineitem").where(F.col("l_quantity") > 48).select(F.col("l_orderkey").alias("o_orderkey"))
    return k.drop_keys(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), large.distinct())


@CHECKS.add(
    """SELECT event_id, event_type FROM events WHERE event_type IN (SELECT event_type FROM
       (SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, event_type LIMIT 2))"""
)
def rows_of_classes(spark, sf_dir):
    """Rows of the two most frequent classes."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    return k.rows_of_classes(events, "event_type", class_counts(events, "event_type").limit(2).select("event_type"))


@CHECKS.add(
    """SELECT o_orderkey, o_custkey FROM orders WHERE o_orderpriority < '3' AND o_custkey IN
       (SELECT o_custkey FROM orders WHERE o_orderpriority >= '3')"""
)
def filter_unseen_labels(spark, sf_dir):
    """Validation rows whose label occurs among the training rows."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    valid = orders.where(F.col("o_orderpriority") < "3").drop("o_orderpriority")
    return k.filter_unseen_labels(valid, orders.where(F.col("o_orderpriority") >= "3"), "o_custkey")


@CHECKS.add(
    """SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END AS prediction FROM orders"""
)
def attach_predictions(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    preds = orders.select("o_orderkey", F.when(F.col("o_totalprice") > 100000, 1).otherwise(0).alias("prediction"))
    return k.attach_predictions(orders.select("o_orderkey"), preds, ["o_orderkey"])


@CHECKS.add(
    f"""SELECT {LK}, l_returnflag, CASE WHEN fold <> 2 THEN fold END AS fold, CASE WHEN fold <> 2 THEN CASE WHEN l_quantity > 25 THEN 'R' ELSE 'N' END END AS prediction FROM ({_FOLDED})"""
)
def collect_scored(spark, sf_dir):
    """The same by a union of the scored rows; rows of the third fold are in no fold."""
    folded = folded_lines(spark, sf_dir).withColumn("fold", F.when(F.col("fold") != 2, F.col("fold")))
    guess = F.when(F.col("l_quantity") > 25, "R").otherwise("N")
    parts = [k.valid_of(folded, f).withColumn("prediction", guess) for f in (0, 1)]
    return k.collect_scored(folded, parts).select(*LINE_KEY, "l_returnflag", "fold", "prediction")


@CHECKS.add("SELECT doc_id, n_chars, lang, quality, toxic FROM documents FULL JOIN labels USING (doc_id)")
def bind_columns(spark, sf_dir):
    """Columns of two tables side by side; not every document has labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    return k.bind_columns(docs, table(spark, sf_dir, "labels"), ["doc_id"])


@CHECKS.add(
    f"""WITH d AS (SELECT q.vec_id AS query_id, p.vec_id AS point_id, p.label AS point_label,
          sqrt(list_sum(list_transform(range(1, len(q.embedding) + 1), lambda i:
            (q.embedding[i]::DOUBLE - p.embedding[i]::DOUBLE) * (q.embedding[i]::DOUBLE - p.embedding[i]::DOUBLE)))) AS distance
          FROM embeddings q, embeddings p WHERE q.label % 2 <> p.label % 2),
        n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, point_id) AS rank FROM d)
        SELECT query_id, point_id, point_label, {r('distance')} AS distance, CAST(rank AS INTEGER) AS rank FROM n WHERE rank <= 5"""
)
def knn_join_labels(spark, sf_dir):
    """The five nearest vectors of even label for those of odd label, and the other way round."""
    vectors = table(spark, sf_dir, "embeddings")
    found = []
    for own in (0, 1):
        queries = vectors.where(F.col("label") % 2 == own).select(F.col("vec_id").alias("query_id"), "embedding")
        points = vectors.where(F.col("label") % 2 != own).select(F.col("vec_id").alias("point_id"), F.col("label").alias("point_label"), "embedding")
        found.append(knn_join(queries, points, 5, "embedding", ["query_id"], "point_id", ["point_label"]))
    return found[0].unionByName(found[1]).withColumn("distance", rounded("distance"))


@CHECKS.add(
    """WITH d AS (SELECT q.vec_id AS query_id, p.vec_id AS point_id, list_sum(list_transform(range(1, len(q.embedding) + 1), lambda i:
          (q.embedding[i]::DOUBLE - p.embedding[i]::DOUBLE) * (q.embedding[i]::DOUBLE - p.embedding[i]::DOUBLE))) AS d2 FROM embeddings q, embeddings p),
        n AS (SELECT query_id, count(*) AS n_found FROM (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d2, point_id) <= 10) GROUP BY query_id)
      SELECT count(*) AS n_queries, CAST(sum(n_found) AS BIGINT) AS n_pairs, true AS recall_reached, true AS few_visited FROM n"""
)
def knn_index_recall(spark, sf_dir):
    """Every vector searched for in the inverted index of all; the ten found are compared with the exact ten."""
    vectors = table(spark, sf_dir, "embeddings")
    points = vectors.select(F.col("vec_id").alias("point_id"), "embedding")
    queries = vectors.select(F.col("vec_id").alias("query_id"), "embedding")
    index = build_index(points, "point_id", "embedding", centres=64)
    found = search_index(index, queries, ["query_id"], 10, probes=36)
    exact = knn_join(queries, points, 10, "embedding", ["query_id"], "point_id").select("query_id", "point_id", F.lit(1).alias("exact"))
    both = found.join(exact, ["query_id", "point_id"], "left")
    few = visited_share(index, queries, probes=36) < 0.7
    return both.agg(
        F.countDistinct("query_id").alias("n_queries"), F.count("*").alias("n_pairs"),
        (F.count("exact") >= 0.9 * F.count("*")).alias("recall_reached"), F.lit(few).alias("few_visited"),
    )

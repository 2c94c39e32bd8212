import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from checks import sources
from stratafold.bounded import is_in, join_small, pin
from stratafold.operators import keyed as k
from stratafold.operators import projection as p
from stratafold.plans import terrain
from stratafold.sources.tables import derive_scoring_set, read_optional, read_table, write_predictions


def test_csv_with_schema_and_optional(spark, tmp_path):
    path = str(tmp_path / "train.csv")
    header = ",".join(terrain.LABELLED_SCHEMA.names)
    row = ",".join(["1", "2596", "51", "3", "258", "0", "510", "221", "232", "148", "6279"] + ["1", "0", "0", "0"] + ["0"] * 40 + ["5"])
    with open(path, "w") as f:
        f.write(header + "\n" + row + "\n")
    got = read_table(spark, path, terrain.LABELLED_SCHEMA, "csv").first()
    assert got["Id"] == 1 and got["Cover_Type"] == 5
    assert read_optional(spark, path, terrain.LABELLED_SCHEMA).count() == 1
    empty = read_optional(spark, str(tmp_path / "absent.csv"), terrain.UNLABELLED_SCHEMA)
    assert empty.count() == 0 and empty.columns == terrain.UNLABELLED_SCHEMA.names
    with pytest.raises(ValueError):
        read_table(spark, path, None, "csv")


def test_csv_header_must_match(spark, tmp_path):
    path = str(tmp_path / "x.csv")
    with open(path, "w") as f:
        f.write("b,a\n1,2\n")
    with pytest.raises(Exception):
        read_table(spark, path, "a int, b int", "csv").collect()


def test_predictions_round_trip(spark, tmp_path):
    out = str(tmp_path / "new" / "submission")
    write_predictions(spark.createDataFrame([(15120, 3, 0.5), (15121, 7, 0.1)], "Id long, Cover_Type int, p double"), out, "Id", "Cover_Type")
    assert rows(read_table(spark, out, "Id long, Cover_Type int", "csv")) == [(15120, 3), (15121, 7)]


def test_scoring_set(spark):
    df = spark.createDataFrame([(1, 9, "a"), (2, 8, "b")], "id long, x int, y string")
    assert rows(derive_scoring_set(df, "y", "id")) == [(3, 9), (4, 8)]
    assert derive_scoring_set(df.limit(0), "y", "id").count() == 0


def test_pin_and_its_bound(spark):
    assert pin(spark.range(5), 4) is None
    assert pin(spark.range(4), 4).values("id") == [0, 1, 2, 3]


@pytest.mark.parametrize("bound", [0, 100])
def test_membership_same_on_both_sides_of_the_bound(spark, bound):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "c")], "id int, v string")
    values = spark.createDataFrame([("a",), ("c",), (None,)], "w string")
    assert rows(is_in(df, "v", values, max_rows=bound), "id") == [(1,), (4,)]
    assert rows(is_in(df, "v", values, keep=False, max_rows=bound), "id") == [(2,), (3,)]
    small = spark.createDataFrame([("a", 10), ("b", 20)], "v string, n int")
    assert rows(join_small(df, small, ["v"], "left", max_rows=bound), "id", "n") == [(1, 10), (2, 20), (3, None), (4, None)]
    assert rows(is_in(df, "v", values.limit(0), max_rows=bound)) == []
    assert is_in(df, "v", values.limit(0), keep=False, max_rows=bound).count() == 4


def test_labels(spark):
    df = spark.createDataFrame([(1,), (3,)], "y int")
    assert rows(p.normalize_label(df, "y")) == [(0,), (2,)]
    assert rows(p.normalize_label(df.where("y = 3"), "y")) == [(3,)]
    assert rows(p.cast_label(df, "y", "category")) == [("1",), ("3",)]
    assert rows(p.cast_label(p.cast_label(df, "y", "category"), "y", "int")) == [(1,), (3,)]


def test_column_selection(spark):
    df = spark.createDataFrame([(1, 2.0, "x", 3)], "Soil_Type1 int, Elevation double, name string, Wilderness_Area1 int")
    assert p.select_columns(df, contains="Type") == ["Soil_Type1"]
    assert p.select_columns(df, not_prefix=("Soil_", "Wilderness_"), numeric=True) == ["Elevation"]
    assert p.select_columns(df, among=["name", "gone"]) == ["name"]
    assert p.schema_difference(df, df.drop("name")) == ["name"]


def test_align(spark):
    train = spark.createDataFrame([(1, 2.0, 3)], "a int, b double, c int")
    test = spark.createDataFrame([(7, 9, 5)], "c int, extra int, a int")
    aligned = p.align_columns(test, train)
    assert aligned.columns == ["a", "b", "c"] and rows(aligned) == [(5, 0.0, 7)]
    assert [f.dataType for f in aligned.schema.fields] == [f.dataType for f in train.schema.fields]


def test_add_if_all_and_null(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, 3.0)], "a double, b double")
    out = p.add_if_all(df, {"la": (F.col("a") >= 0, F.log1p("a")), "lb": (F.col("b") >= 0, F.log1p("b"))})
    assert out.columns == ["a", "b", "la"]
    assert p.add_if_all(df.limit(0), {"la": (F.col("a") >= 0, F.log1p("a"))}).columns == ["a", "b", "la"]


def test_tag_and_untag(spark):
    a, b = spark.range(2), spark.range(5, 8)
    train, test = p.untag(p.tag_split(a, b))
    assert rows(train) == rows(a) and rows(test) == rows(b)


def test_fold_gathering(spark):
    df = spark.createDataFrame([(1, 0), (2, 1), (3, None)], "id int, fold int")
    assert rows(k.train_of(df, 0), "id") == [(2,), (3,)] and rows(k.valid_of(df, 0), "id") == [(1,)]
    more = k.add_rows_to_training(df, spark.createDataFrame([(9,)], "id int"))
    assert rows(k.train_of(more, 1), "id") == [(1,), (3,), (9,)] and rows(k.valid_of(more, 1), "id") == [(2,)]


def test_oof_and_keys(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, y string")
    parts = [spark.createDataFrame([(1, "a")], "id int, prediction string"), spark.createDataFrame([(3, "b")], "id int, prediction string")]
    assert rows(k.collect_oof(df, parts, ["id"])) == [(1, "a", "a"), (2, "b", None), (3, "c", "b")]
    assert rows(k.drop_keys(df, spark.createDataFrame([(2,)], "id int")), "id") == [(1,), (3,)]
    assert rows(k.filter_unseen_labels(df, df.where("id < 3"), "y"), "id") == [(1,), (2,)]
    assert rows(k.attach_predictions(df.select("id"), parts[0], ["id"])) == [(1, "a")]
    other = spark.createDataFrame([(3, 0.5), (4, 0.6)], "id int, z double")
    assert rows(k.bind_columns(df, other, ["id"]), "id", "y", "z") == [(1, "a", None), (2, "b", None), (3, "c", 0.5), (4, None, 0.6)]


def test_map_and_replace(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "v int")
    assert rows(p.map_values(df, "v", {1: 9})) == [(2,), (9,), (None,)]
    assert rows(p.replace_values(df, "v", spark.createDataFrame([(2,)], "w int"), F.lit(0))) == [(0,), (1,), (None,)]


def test_run_logs_grow_in_number_and_not_in_size(spark, tmp_path, monkeypatch):
    """A user with all events has many logs, each of a bounded block of event ids."""
    monkeypatch.setattr(sources, "_LOG_EVENTS", 10, raising=False)
    monkeypatch.setattr(sources, "_shared", lambda spark, name: str(tmp_path / name))
    events = [(i, 7 if i < 95 else None, f'{{"k": {i}}}') for i in range(100)]
    spark.createDataFrame(events, "event_id long, user_id long, props string").write.parquet(str(tmp_path / "events.parquet"))
    got = sources.CHECKS.queries["run_logs_written_and_read"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(user, "k", str(i)) for i, user, _ in events], key=repr)
    logs = [len(json.loads(p.read_text())) for p in (tmp_path / "logs").rglob("part-*.txt")]
    assert sum(logs) == 100 and max(logs) <= 10


def test_run_logs_of_many_users_share_a_file(spark, tmp_path, monkeypatch):
    data = [(i, i % 40, '{"k%d": "v"}' % i) for i in range(200)] + [(None, 3, '{"a": 1}'), (None, None, '{"b": 2}'), (7, 7, '{"c": 3}'), (8, None, None)]
    spark.createDataFrame(data, "event_id long, user_id long, props string").write.parquet(str(tmp_path / "events.parquet"))
    read = []
    monkeypatch.setattr(sources, "read_run_logs", lambda spark, path: read.append(path) or spark.read.text(path, wholetext=True).select(F.lit("x").alias("run"), F.col("value").alias("state")))
    got = sources.CHECKS.queries["run_logs_written_and_read"](spark, str(tmp_path))
    assert rows(got) == sorted([(u, key, str(value)) for _, u, p in data if p for key, value in json.loads(p).items()], key=repr)
    assert spark.read.text(read[0], wholetext=True).count() == 3  # one block of ids, events without an id by user

import json

import pytest
from conftest import rows

from stratafold.plans import experiments as x
from stratafold.plans import run_report as rr
from stratafold.sources.run_logs import log_entries, read_run_logs

GOOD = {
    "task_name": "cover",
    "seed": 42,
    "lower": False,
    "num_solutions": 2,
    "code": "print(1)",
    "init_code_exec_result_1_1": {"score": 0.90, "execution_time": 10.0, "returncode": 0},
    "init_code_exec_result_1_0": {"score": 0.95, "execution_time": 4000.0, "returncode": 0},
    "merger_code_exec_result_1_1": {"score": 0.95, "execution_time": 61.0, "returncode": 0},
    "train_code_exec_result_0_1": {"score": None, "execution_time": 5.0, "returncode": 1},
    "ablation_code_exec_result_0_1": {"score": None, "execution_time": 7.0, "returncode": 0, "ablation_result": "\n Baseline: 0.9\nmore"},
    "ablation_code_exec_result_1_1": {"execution_time": 1.0, "returncode": 0, "ablation_result": ""},
    "train_code_improve_exec_result_2_0_1": {"score": 0.91, "returncode": 0},
    "train_code_improve_exec_result_0_0_1": {"score": 0.93, "execution_time": 12.5, "returncode": None},
    "ensemble_code_exec_result_0": {"score": 0.94, "execution_time": 3.0, "returncode": 0},
    "submission_code_exec_result": {"score": 0.92, "execution_time": 2.0, "returncode": 0},
    "submission_code_exec_result_x": {"score": 9.0, "execution_time": 2.0, "returncode": 0},
    "init_code_exec_result_1": {"score": 9.0, "returncode": 0},
    "train_code_exec_result_5_1": {"note": "no record"},
}
LOW = {
    "lower": True,
    "init_code_exec_result_0_0": {"score": 3.0, "execution_time": 1.0, "returncode": 0},
    "ensemble_code_exec_result_0": {"score": 1.0, "execution_time": None, "returncode": 0},
    "ensemble_code_exec_result_1": {"score": 1.0, "execution_time": 9.0, "returncode": 0},
}
NONE = {"task_name": "empty", "train_code_exec_result_0_1": {"score": None, "execution_time": 2.0, "returncode": 2}}


@pytest.fixture(scope="module")
def logs(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("logs")
    for name, state in {"good": GOOD, "low": LOW, "none": NONE}.items():
        (folder / f"{name}.json").write_text(json.dumps(state, indent=1))
    read = read_run_logs(spark, str(folder / "*.json"))
    from pyspark.sql import functions as F

    return log_entries(read.withColumn("run", F.regexp_extract("run", r"(\w+)\.json$", 1))).cache()


@pytest.fixture(scope="module")
def steps(logs):
    return rr.PARSERS["flat_state"](logs).cache()


@pytest.fixture(scope="module")
def directions(logs):
    return rr.run_directions(logs)


def test_steps(steps):
    got = [tuple(r) for r in rr.order_steps(steps.where("run = 'good'")).select("phase", "ident", "score", "time_s", "returncode", "note").collect()]
    assert got == [
        ("Init", "sol1 cand0", 0.95, 4000.0, 0, ""),
        ("Init", "sol1 cand1", 0.90, 10.0, 0, ""),
        ("Merge", "sol1 round1", 0.95, 61.0, 0, ""),
        ("Base", "step0", None, 5.0, 1, "FAILED"),
        ("Ablation", "step0", None, 7.0, 0, "Baseline: 0.9"),
        ("Improve", "step0 plan0", 0.93, 12.5, None, ""),
        ("Improve", "step0 plan2", 0.91, None, 0, ""),
        ("Ablation", "step1", None, 1.0, 0, "ablation study"),
        ("Ensemble", "round0", 0.94, 3.0, 0, ""),
        ("Submit", "final", 0.92, 2.0, 0, ""),
    ]


def test_header(logs):
    got = [tuple(r) for r in rr.run_header(logs).where("run = 'good'").orderBy("place").select("setting", "value").collect()]
    assert got == [("task", "cover"), ("seed", "42"), ("num solutions", "2")]


def test_directions(directions):
    assert rows(directions) == [("good", False), ("low", True), ("none", False)]


def test_totals(steps):
    assert rows(rr.run_totals(steps)) == [("good", 10, 7, 1, 4101.5), ("low", 3, 3, 0, 10.0), ("none", 1, 0, 1, 2.0)]


def test_best(steps, directions):
    best = rr.best_step(steps, directions)
    assert rows(best, "run", "best_score", "best_phase", "best_ident") == [("good", 0.95, "Init", "sol1 cand0"), ("low", 1.0, "Ensemble", "round0")]
    marked = rr.mark_best(steps, directions)
    assert rows(marked.where("is_best"), "run", "ident") == [("good", "sol1 cand0"), ("low", "round0")] and marked.count() == steps.count()


def test_summary(steps, directions):
    got = {r["run"]: r.asDict() for r in rr.run_summary(steps, directions).collect()}
    assert got["good"]["total_time_text"] == "1.14h" and got["good"]["final_score"] == 0.92 and got["good"]["final_returncode"] == 0
    assert got["low"]["metric"] == "lower-is-better" and got["low"]["final_score"] is None and got["low"]["best_score"] == 1.0
    assert got["none"]["best_phase"] is None and got["none"]["metric"] == "higher-is-better"


def test_tables(steps, directions):
    def numbered(sort, run):
        return [r["ident"] for r in rr.run_table(steps, directions, sort).where(f"run = '{run}'").orderBy("number").collect()]

    assert numbered("order", "low") == ["sol0 cand0", "round0", "round1"]
    assert numbered("time", "low") == ["round1", "sol0 cand0", "round0"]
    assert numbered("score", "low") == ["sol0 cand0", "round0", "round1"]
    assert numbered("score", "good")[:3] == ["sol1 cand0", "sol1 round1", "round0"]
    assert numbered("score", "good")[-3:] == ["step0", "step0", "step1"]
    first = rr.run_table(steps, directions).where("run = 'good' and number = 1").first()
    assert (first["score_text"], first["time_text"], first["is_best"]) == ("0.95000", "1.11h", True)
    with pytest.raises(ValueError):
        rr.run_table(steps, directions, "name")


# --- experiments ---


def effects(spark, pairs):
    scores = spark.createDataFrame([("base", 0.9), *[(n, 0.9 - d) for n, d in pairs]], "variant string, score double")
    return x.ablation_effects(scores, "base")


def top(spark, pairs, rule, threshold=1e-4):
    row = x.top_effect(effects(spark, pairs), rule, threshold).first()
    return row["variant"], row["verdict"]


def test_top_effect_rules(spark):
    mixed = [("a", 0.05), ("b", -0.10), ("c", 0.02)]
    assert top(spark, mixed, "drop") == ("a", "helps")
    assert top(spark, mixed, "magnitude") == ("b", "hurts")
    assert top(spark, mixed, "stronger_side") == ("b", "hurts")
    assert top(spark, mixed, "drop_else_gain") == ("a", "helps")
    assert top(spark, mixed, "most_negative") == ("b", "hurts")
    gains = [("a", -0.05), ("b", -0.10)]
    assert top(spark, gains, "drop") == (None, "none")
    assert top(spark, gains, "drop_else_gain") == ("b", "hurts")
    flat = [("a", 0.0), ("b", 0.00005)]
    assert top(spark, flat, "drop") == (None, "none") and top(spark, flat, "stronger_side") == (None, "none")
    assert top(spark, flat, "drop", 0.0) == ("b", "helps")
    with pytest.raises(ValueError):
        top(spark, flat, "other")


def test_signs_ranks_and_best(spark):
    e = effects(spark, [("a", 0.05), ("b", -0.10)])
    assert rows(x.positive_effects(e), "variant") == [("a",)]
    assert x.rank_effects(e).first()["variant"] == "b" and x.rank_effects(e, None).count() == 2
    scores = spark.createDataFrame([("b", 0.5), ("a", 0.5), ("c", 0.1)], "variant string, score double")
    assert tuple(x.best_variant(scores).first()) == ("a", 0.5)
    change = x.ablation_effects(scores, "c", "change")
    assert [round(r["effect"], 6) for r in change.collect()] == [0.4, 0.4]
    with pytest.raises(ValueError):
        x.ablation_effects(scores, "c", "up")

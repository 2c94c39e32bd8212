"""Reports over many run logs at once: typed steps, totals, best step, orderings.

The input is (run, pos, entry, payload): one row per top-level key of a log, with ``pos`` its place in
the log and ``payload`` its value as JSON text. Runs are never gathered into one task: totals and best
steps pre-aggregate, and numbering ranks inside slices of a run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalar import first_line, format_score, format_seconds, present
from ..operators.folds import with_group_rank

# Record keys of a log. Each pattern comes with its phase, the four order numbers and the
# label; {n} stands for the n-th number in the key.
STEP_KEYS = [
    (r"init_code_exec_result_\d+_\d+", "Init", ("0", "0", "0", "{2}"), "sol{1} cand{2}"),
    (r"merger_code_exec_result_\d+_\d+", "Merge", ("0", "1", "0", "{2}"), "sol{1} round{2}"),
    (r"train_code_exec_result_\d+_\d+", "Base", ("1", "{1}", "0", "0"), "step{1}"),
    (r"ablation_code_exec_result_\d+_\d+", "Ablation", ("1", "{1}", "1", "0"), "step{1}"),
    (r"train_code_improve_exec_result_\d+_\d+_\d+", "Improve", ("1", "{2}", "2", "{1}"), "step{2} plan{1}"),
    (r"ensemble_code_exec_result_\d+", "Ensemble", ("2", "0", "0", "{1}"), "round{1}"),
    (r"submission_code_exec_result", "Submit", ("3", "0", "0", "0"), "final"),
]

# Settings shown in a run's header, in display order, with their titles.
HEADER_KEYS = {
    "task_name": "task",
    "task_type": "task type",
    "agent_model": "agent model",
    "seed": "seed",
    "num_solutions": "num solutions",
    "num_model_candidates": "model candidates",
    "num_top_plans": "top plans / step",
    "outer_loop_round": "outer rounds",
    "inner_loop_round": "inner rounds",
    "ensemble_loop_round": "ensemble rounds",
    "max_debug_round": "max debug rounds",
    "exec_timeout": "exec timeout (s)",
    "workspace_dir": "workspace",
}

ORDER = ["o1", "o2", "o3", "o4"]


def _filled(template: str) -> Column:
    """Column for a template whose {n} are the numbers in the key."""
    parts, rest = [], template
    while "{" in rest:
        head, _, tail = rest.partition("{")
        number, _, rest = tail.partition("}")
        parts += [F.lit(head), F.get("_numbers", F.lit(int(number) - 1))]
    return F.concat(*parts, F.lit(rest)) if parts else F.lit(template)


def _by_kind(value: Callable[[tuple], Column]) -> Column:
    out = None
    for i, spec in enumerate(STEP_KEYS):
        hit = F.col("_kind") == i
        out = F.when(hit, value(spec)) if out is None else out.when(hit, value(spec))
    return out


def parse_steps(entries: DataFrame) -> DataFrame:
    """(run, pos, entry, o1..o4, phase, ident, score, time_s, returncode, note): one row per recognised record.

    A record is an object with an execution time or a return code. Other entries are ignored. The key
    is matched once; its kind and numbers give all the columns that depend on it.
    """
    kinds = None
    for i, spec in enumerate(STEP_KEYS):
        hit = F.col("entry").rlike(f"^{spec[0]}$")
        kinds = F.when(hit, i) if kinds is None else kinds.when(hit, i)
    parsed = F.struct(
        kinds.alias("_kind"),
        F.regexp_extract_all("entry", F.lit(r"(\d+)")).alias("_numbers"),
        F.from_json("payload", "map<string,string>").alias("_r"),
    )
    # generated, not projected: the filter below would otherwise be pushed through and parse the text again
    known = entries.where(F.col("entry").contains("_code_")).select("run", "pos", "entry", F.inline(F.array(parsed)))
    timed = F.map_contains_key("_r", "execution_time") | F.map_contains_key("_r", "returncode")
    r = F.col("_r")
    fields = {
        "score": r["score"].try_cast("double"),
        "time_s": r["execution_time"].try_cast("double"),
        "returncode": r["returncode"].try_cast("int"),
        "_told": F.coalesce(first_line(r["ablation_result"]), F.lit("ablation study")),
        "_study": F.map_contains_key("_r", "ablation_result"),
    }
    records = known.where(F.col("_kind").isNotNull() & timed).withColumns(fields)
    note = (
        F.when(F.col("score").isNull() & F.col("_study"), F.col("_told"))
        .when(F.coalesce("returncode", F.lit(0)) != 0, "FAILED")
        .otherwise("")
    )
    return records.select(
        "run",
        "pos",
        "entry",
        *[_by_kind(lambda s, i=i: _filled(s[2][i])).cast("int").alias(name) for i, name in enumerate(ORDER)],
        _by_kind(lambda s: F.lit(s[1])).alias("phase"),
        _by_kind(lambda s: _filled(s[3])).alias("ident"),
        "score",
        "time_s",
        "returncode",
        note.alias("note"),
    )


# Log formats by name; a new one is a function from entries to the step columns above.
PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {"flat_state": parse_steps}


def run_header(entries: DataFrame) -> DataFrame:
    """(run, place, setting, value): the settings a log has, under their titles and in display order."""
    title = F.create_map(*[F.lit(x) for kv in HEADER_KEYS.items() for x in kv])
    place = F.create_map(*[F.lit(x) for i, k in enumerate(HEADER_KEYS) for x in (k, i)])
    return entries.where(F.col("entry").isin(list(HEADER_KEYS))).select(
        "run", place[F.col("entry")].alias("place"), title[F.col("entry")].alias("setting"), F.col("payload").alias("value")
    )


def run_directions(entries: DataFrame) -> DataFrame:
    """(run, lower_is_better) for every run; false unless the log says otherwise."""
    false = ["false", "0", "0.0", "", "[]", "{}"]
    says = F.when(F.col("entry") == "lower", ~F.coalesce(F.col("payload"), F.lit("")).isin(false))
    return entries.groupBy("run").agg(F.coalesce(F.max(says), F.lit(False)).alias("lower_is_better"))


def run_totals(steps: DataFrame) -> DataFrame:
    """Per run: executions, scored steps, failures and total time."""
    return steps.groupBy("run").agg(*_totals())


def _totals() -> list[Column]:
    return [
        F.count("*").alias("executions"),
        F.count("score").alias("scored"),
        F.count_if(F.coalesce("returncode", F.lit(0)) != 0).alias("failures"),
        F.coalesce(F.sum("time_s"), F.lit(0.0)).alias("total_time"),
    ]


_CHRONOLOGICAL = [*ORDER, "pos"]


_STEP = ("pos", "score", "phase", "ident")


def _both_best() -> list[Column]:
    """The lowest and the highest scored step of a group, the earliest one on equal scores; both, so that
    a run's direction is only needed once its steps are aggregated."""
    step, scored = F.struct(*_STEP), F.col("score").isNotNull()
    low = F.when(scored, F.struct("score", *_CHRONOLOGICAL))
    high = F.when(scored, F.struct((-F.col("score")).alias("score"), *_CHRONOLOGICAL))
    return [F.min_by(step, low).alias("_low"), F.min_by(step, high).alias("_high")]


def _directed(per_run: DataFrame, directions: DataFrame) -> DataFrame:
    """Add ``lower_is_better`` and the best step ``b`` of each run."""
    joined = per_run.join(directions, ["run"], "left")
    joined = joined.withColumn("lower_is_better", F.coalesce("lower_is_better", F.lit(False)))
    return joined.withColumn("b", F.when(F.col("lower_is_better"), F.col("_low")).otherwise(F.col("_high"))).drop("_low", "_high")


def best_step(steps: DataFrame, directions: DataFrame) -> DataFrame:
    """(run, best_pos, best_score, best_phase, best_ident); no row for a run without scores."""
    best = _directed(steps.where(F.col("score").isNotNull()).groupBy("run").agg(*_both_best()), directions)
    return best.select("run", *[F.col(f"b.{c}").alias(f"best_{c}") for c in _STEP])


def mark_best(steps: DataFrame, directions: DataFrame) -> DataFrame:
    """Steps with ``is_best`` for the one best step of each run."""
    best = best_step(steps, directions).select("run", "best_pos")
    marked = steps.join(best, ["run"], "left")
    return marked.withColumn("is_best", F.coalesce(F.col("pos") == F.col("best_pos"), F.lit(False))).drop("best_pos")


def run_summary(steps: DataFrame, directions: DataFrame) -> DataFrame:
    """One row per run: totals, best step, final submission and metric direction, from one aggregation of the steps."""
    submitted = F.when(F.col("phase") == "Submit", F.struct(*_CHRONOLOGICAL))
    final = F.min_by(F.struct("score", "returncode"), submitted).alias("s")
    grouped = _directed(steps.groupBy("run").agg(*_totals(), *_both_best(), final), directions)
    return grouped.select(
        "run",
        "executions",
        "scored",
        "failures",
        "total_time",
        format_seconds("total_time").alias("total_time_text"),
        F.col("b.score").alias("best_score"),
        F.col("b.phase").alias("best_phase"),
        F.col("b.ident").alias("best_ident"),
        F.col("s.score").alias("final_score"),
        F.col("s.returncode").alias("final_returncode"),
        F.when(F.col("lower_is_better"), "lower-is-better").otherwise("higher-is-better").alias("metric"),
    )


SORTS = ("order", "time", "score")


def _sort_keys(by: str) -> tuple[list[Column], Column]:
    """Sort columns of an ordering, and a coarse version of it to slice large runs by.

    Equal sort values are sliced further by the order of execution. For times and scores that is done at
    whole numbers, where the stand-ins for missing values lie. NaN is missing.
    """
    steps = [F.col(c) for c in _CHRONOLOGICAL]
    fine = F.struct(*ORDER, F.floor(F.col("pos") / 10_000).alias("block"))
    if by == "order":
        return steps, fine
    if by == "time":
        value = -F.coalesce(present("time_s"), F.lit(0.0))
        unit = value
    elif by == "score":
        value = -F.coalesce(present("score"), F.lit(-1e9))
        unit = value * 1024  # a power of two keeps distinct values distinct
    else:
        raise ValueError(f"sort is one of {SORTS}")
    low = F.floor(unit)
    return [value, *steps], F.struct(low.alias("low"), (unit > low).alias("above"), F.when(unit == low, fine).alias("fine"))


def order_steps(steps: DataFrame, by: str = "order") -> DataFrame:
    """Steps of each run in order of execution, slowest first (missing as 0), or highest score first (missing last), with ``position``."""
    return _numbered(steps, by, "position").orderBy("run", "position")


def _numbered(steps: DataFrame, by: str, number: str) -> DataFrame:
    keys, slice_by = _sort_keys(by)
    return with_group_rank(steps.withColumn("_slice", slice_by), ["run"], keys, "_slice", rank=number).drop("_slice")


def run_table(steps: DataFrame, directions: DataFrame, sort: str = "order") -> DataFrame:
    """Numbered steps per run with display texts and the best mark."""
    return mark_best(_numbered(steps, sort, "number"), directions).select(
        "run",
        F.col("number").cast("int").alias("number"),
        "phase",
        "ident",
        "score",
        format_score("score").alias("score_text"),
        "time_s",
        format_seconds("time_s").alias("time_text"),
        "returncode",
        "note",
        "is_best",
    )

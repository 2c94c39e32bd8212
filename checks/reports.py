"""Experiment and run reports.

Experiment scores are the mean event value per event type, or cross-validated accuracies. Run logs are
derived from the events: a user is a run, an event is one entry of its log.
"""

from pyspark.sql import functions as F

from stratafold.plans import experiments as x
from stratafold.plans import run_report as rr

from .base import FEATURES, FOLDS, LINE_KEY, Checks, fold_sql, r, rounded, table
from .keyed import folded_lines
from .learn import nb_sql

CHECKS = Checks()

# --- experiments -----------------------------------------------------------------------------

_SCORES_SQL = f"SELECT event_type AS variant, {r('avg(value)')} AS score FROM events GROUP BY event_type"
_EFFECTS_SQL = f"SELECT variant, score, {r('(SELECT score FROM s WHERE variant = $base$) - score')} AS effect FROM s WHERE variant <> $base$"


def _effects_sql(baseline="click"):
    return f"s AS ({_SCORES_SQL}), e AS ({_EFFECTS_SQL.replace('$base$', chr(39) + baseline + chr(39))})"


def _scores(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.groupBy(F.col("event_type").alias("variant")).agg(rounded(F.avg("value")).alias("score"))


def _effects(spark, sf_dir, baseline="click"):
    return x.ablation_effects(_scores(spark, sf_dir), baseline).withColumn("effect", rounded("effect"))


_VARIANTS = {"baseline": FEATURES, "no_quantity": FEATURES[1:], "no_price": [FEATURES[0], *FEATURES[2:]], "no_rates": FEATURES[:2]}


def _nb_score_sql(cols):
    body = nb_sql(fold_sql("lineitem", LINE_KEY, "l_returnflag"), "l_returnflag", cols)
    return f"(WITH {body} SELECT {r('avg(a)')} FROM (SELECT avg(CASE WHEN l_returnflag = prediction THEN 1.0 ELSE 0.0 END) AS a FROM pr GROUP BY fold))"


@CHECKS.add(" UNION ALL ".join(f"SELECT '{v}' AS variant, {_nb_score_sql(cols)} AS score" for v, cols in _VARIANTS.items()))
def ablation_scores(spark, sf_dir):
    """Cross-validated accuracy with feature groups left out; the folded table is shared."""

    def scorer(cols):
        return lambda df: x.nb_cv_score(df, "l_returnflag", cols, ["A", "N", "R"], FOLDS)

    folded = folded_lines(spark, sf_dir).drop(*LINE_KEY)  # half of what is cached otherwise, and no variant reads it
    scores = x.ablation_scores(folded, {v: scorer(cols) for v, cols in _VARIANTS.items()})
    return scores.withColumn("score", rounded("score"))


@CHECKS.add(" UNION ALL ".join(f"SELECT '{v}' AS variant, {_nb_score_sql(cols)} AS score" for v, cols in _VARIANTS.items()))
def ablation_scores_one_scan(spark, sf_dir):
    """The same variants from one fit and one pass over the rows."""
    scores = x.nb_ablation_scores(folded_lines(spark, sf_dir), "l_returnflag", _VARIANTS, ["A", "N", "R"], FOLDS)
    return scores.withColumn("score", rounded("score"))


@CHECKS.add(f"WITH {_effects_sql()} SELECT variant, score, effect FROM e")
def ablation_effects(spark, sf_dir):
    return _effects(spark, sf_dir)


@CHECKS.add(f"WITH {_effects_sql()} SELECT variant, score, {r('-effect')} AS effect FROM e")
def ablation_changes(spark, sf_dir):
    """The opposite sign: variant minus baseline."""
    return x.ablation_effects(_scores(spark, sf_dir), "click", "change").withColumn("effect", rounded("effect"))


@CHECKS.add(f"WITH {_effects_sql()} SELECT variant, effect FROM e ORDER BY effect, variant LIMIT 1")
def rank_effects(spark, sf_dir):
    return x.rank_effects(_effects(spark, sf_dir).select("variant", "effect"))


@CHECKS.add(f"WITH {_effects_sql()} SELECT variant, score, effect FROM e WHERE effect > 0")
def positive_effects(spark, sf_dir):
    return x.positive_effects(_effects(spark, sf_dir))


_TOP = "CASE WHEN effect > 0 THEN 'helps' WHEN effect < 0 THEN 'hurts' ELSE 'none' END AS verdict"


@CHECKS.add(
    f"""WITH {_effects_sql()}, hi AS (SELECT * FROM e ORDER BY effect DESC, variant LIMIT 1), lo AS (SELECT * FROM e ORDER BY effect, variant LIMIT 1),
        big AS (SELECT * FROM e ORDER BY abs(effect) DESC, variant LIMIT 1), u AS (
        SELECT 'drop' AS rule, variant, effect FROM hi WHERE effect > 0.0001
        UNION ALL SELECT 'magnitude', variant, effect FROM big WHERE abs(effect) > 0.0001
        UNION ALL SELECT 'stronger_side', variant, effect FROM hi WHERE abs(effect) > (SELECT abs(effect) FROM lo) AND effect > 0.0001
        UNION ALL SELECT 'stronger_side', variant, effect FROM lo WHERE abs(effect) >= (SELECT abs(effect) FROM hi) AND effect < -0.0001
        UNION ALL SELECT 'drop_else_gain', variant, effect FROM hi WHERE effect > 0.0001
        UNION ALL SELECT 'drop_else_gain', variant, effect FROM lo WHERE effect < 0 AND (SELECT effect FROM hi) <= 0.0001
        UNION ALL SELECT 'most_negative', variant, effect FROM lo WHERE effect < -0.0001)
        SELECT t.rule, u.variant, u.effect, {_TOP} FROM (SELECT unnest(['drop', 'magnitude', 'stronger_side', 'drop_else_gain', 'most_negative']) AS rule) t
        LEFT JOIN u USING (rule)"""
)
def top_effect(spark, sf_dir):
    """The conclusion under each rule."""
    effects = _effects(spark, sf_dir)
    rows = [x.top_effect(effects, rule, 0.0001).withColumn("rule", F.lit(rule)) for rule in x.RULES]
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    return out


@CHECKS.add(f"WITH s AS ({_SCORES_SQL}) SELECT variant, score FROM s ORDER BY score DESC, variant LIMIT 1")
def best_variant(spark, sf_dir):
    return x.best_variant(_scores(spark, sf_dir))


# --- run logs --------------------------------------------------------------------------------

_KIND = """CASE WHEN event_id % 11 = 0 THEN 'other' WHEN event_id % 13 = 0 THEN 'ensemble' WHEN event_id % 17 = 0 THEN 'submit'
  WHEN event_type = 'view' THEN 'init' WHEN event_type = 'signup' THEN 'merge' WHEN event_type = 'click' THEN 'improve'
  WHEN event_type = 'purchase' THEN 'ablation' ELSE 'base' END"""
_ENTRY = """CASE kind WHEN 'other' THEN concat('plan_list_', b) WHEN 'ensemble' THEN concat('ensemble_code_exec_result_', b)
  WHEN 'submit' THEN 'submission_code_exec_result' WHEN 'init' THEN concat('init_code_exec_result_', a, '_', b)
  WHEN 'merge' THEN concat('merger_code_exec_result_', a, '_', b) WHEN 'improve' THEN concat('train_code_improve_exec_result_', b, '_', c, '_', a)
  WHEN 'ablation' THEN concat('ablation_code_exec_result_', c, '_', a) ELSE concat('train_code_exec_result_', c, '_', a) END"""


def _entries(spark, sf_dir):
    """One log entry per event, its record as JSON, plus settings of each run."""
    events = table(spark, sf_dir, "events").selectExpr(
        "cast(user_id AS string) AS run",
        "event_id AS pos",
        "event_id",
        "value",
        f"{_KIND} AS kind",
        "event_id % 3 AS a",
        "event_id % 7 AS b",
        "event_id % 5 AS c",
    )
    records = events.selectExpr(
        "run",
        "pos",
        f"{_ENTRY} AS entry",
        """to_json(named_struct(
             'score', CASE WHEN kind NOT IN ('ablation', 'base') AND event_id % 4 <> 0 THEN value END,
             'execution_time', CASE WHEN event_id % 9 <> 0 THEN value * 10 END,
             'returncode', CASE WHEN kind = 'base' THEN 1 ELSE 0 END,
             'ablation_result', CASE WHEN kind = 'ablation' AND event_id % 4 = 0 THEN ' ' WHEN kind = 'ablation'
                THEN concat(' Study of event number ', event_id, ' with a first line that is cut at sixty\\n', 'more') END)) AS payload""",
    )
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    settings = users.selectExpr(
        "cast(user_id AS string) AS run",
        "inline(array(named_struct('pos', -1L, 'entry', 'lower', 'payload', cast(user_id % 2 = 0 AS string)),"
        " named_struct('pos', -2L, 'entry', 'seed', 'payload', cast(user_id AS string)),"
        " named_struct('pos', -3L, 'entry', 'task_name', 'payload', concat('task ', user_id % 5))))",
    )
    return records.unionByName(settings)


_STEPS_SQL = f"""k AS (SELECT CAST(user_id AS VARCHAR) AS run, event_id AS pos, event_id, user_id, value, {_KIND} AS kind,
    event_id % 3 AS a, event_id % 7 AS b, event_id % 5 AS c FROM events),
  st AS (SELECT run, pos, user_id, {_ENTRY} AS entry,
    CAST(CASE kind WHEN 'init' THEN 0 WHEN 'merge' THEN 0 WHEN 'ensemble' THEN 2 WHEN 'submit' THEN 3 ELSE 1 END AS INTEGER) AS o1,
    CAST(CASE kind WHEN 'merge' THEN 1 WHEN 'improve' THEN c WHEN 'ablation' THEN c WHEN 'base' THEN c ELSE 0 END AS INTEGER) AS o2,
    CAST(CASE kind WHEN 'ablation' THEN 1 WHEN 'improve' THEN 2 ELSE 0 END AS INTEGER) AS o3,
    CAST(CASE WHEN kind IN ('init', 'merge', 'improve', 'ensemble') THEN b ELSE 0 END AS INTEGER) AS o4,
    CASE kind WHEN 'init' THEN 'Init' WHEN 'merge' THEN 'Merge' WHEN 'improve' THEN 'Improve' WHEN 'ablation' THEN 'Ablation'
      WHEN 'ensemble' THEN 'Ensemble' WHEN 'submit' THEN 'Submit' ELSE 'Base' END AS phase,
    CASE kind WHEN 'init' THEN concat('sol', a, ' cand', b) WHEN 'merge' THEN concat('sol', a, ' round', b) WHEN 'improve' THEN concat('step', c, ' plan', b)
      WHEN 'ensemble' THEN concat('round', b) WHEN 'submit' THEN 'final' ELSE concat('step', c) END AS ident,
    CASE WHEN kind NOT IN ('ablation', 'base') AND event_id % 4 <> 0 THEN value END AS score,
    CASE WHEN event_id % 9 <> 0 THEN value * 10 END AS time_s,
    CAST(CASE WHEN kind = 'base' THEN 1 ELSE 0 END AS INTEGER) AS returncode,
    CASE WHEN kind = 'ablation' AND event_id % 4 = 0 THEN 'ablation study'
      WHEN kind = 'ablation' THEN substr(concat('Study of event number ', event_id, ' with a first line that is cut at sixty'), 1, 60)
      WHEN kind = 'base' THEN 'FAILED' ELSE '' END AS note
    FROM k WHERE kind <> 'other'),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY CASE WHEN user_id % 2 = 0 THEN score ELSE -score END NULLS LAST, o1, o2, o3, o4, pos) AS i FROM st),
  best AS (SELECT * FROM ranked WHERE i = 1 AND score IS NOT NULL)"""


def _steps(spark, sf_dir):
    entries = _entries(spark, sf_dir)
    return rr.PARSERS["flat_state"](entries), rr.run_directions(entries)


@CHECKS.add(f"WITH {_STEPS_SQL} SELECT run, pos, entry, o1, o2, o3, o4, phase, ident, score, time_s, returncode, note FROM st")
def parse_steps(spark, sf_dir):
    """Keys that say phase and place, JSON records, notes."""
    return _steps(spark, sf_dir)[0]


@CHECKS.add(
    """SELECT DISTINCT CAST(user_id AS VARCHAR) AS run, CAST(3 AS INTEGER) AS place, 'seed' AS setting, CAST(user_id AS VARCHAR) AS value FROM events
       UNION ALL SELECT DISTINCT CAST(user_id AS VARCHAR), CAST(0 AS INTEGER), 'task', concat('task ', user_id % 5) FROM events"""
)
def run_header(spark, sf_dir):
    return rr.run_header(_entries(spark, sf_dir))


@CHECKS.add(
    f"""WITH {_STEPS_SQL} SELECT run, count(*) AS executions, count(score) AS scored, count(*) FILTER (returncode <> 0) AS failures,
        {r('coalesce(sum(time_s), 0)', 2)} AS total_time FROM st GROUP BY run"""
)
def run_totals(spark, sf_dir):
    return rr.run_totals(_steps(spark, sf_dir)[0]).withColumn("total_time", rounded("total_time", 2))


@CHECKS.add(f"WITH {_STEPS_SQL} SELECT run, pos AS best_pos, score AS best_score, phase AS best_phase, ident AS best_ident FROM best")
def best_step(spark, sf_dir):
    """Lowest or highest score by the run's direction, the earliest on ties."""
    return rr.best_step(*_steps(spark, sf_dir))


@CHECKS.add(f"WITH {_STEPS_SQL} SELECT st.run, st.pos, st.score, best.pos IS NOT NULL AS is_best FROM st LEFT JOIN best USING (run, pos)")
def mark_best(spark, sf_dir):
    return rr.mark_best(*_steps(spark, sf_dir)).select("run", "pos", "score", "is_best")


@CHECKS.add(
    f"""WITH {_STEPS_SQL}, sub AS (SELECT run, score, returncode FROM st WHERE phase = 'Submit' QUALIFY row_number() OVER (PARTITION BY run ORDER BY pos) = 1)
        SELECT st.run, count(*) AS executions, count(st.score) AS scored, count(*) FILTER (st.returncode <> 0) AS failures,
          {r('coalesce(sum(st.time_s), 0)', 2)} AS total_time, any_value(best.score) AS best_score, any_value(best.phase) AS best_phase,
          any_value(best.ident) AS best_ident, any_value(sub.score) AS final_score, any_value(sub.returncode) AS final_returncode,
          CASE WHEN any_value(st.user_id) % 2 = 0 THEN 'lower-is-better' ELSE 'higher-is-better' END AS metric
        FROM st LEFT JOIN best USING (run) LEFT JOIN sub USING (run) GROUP BY st.run"""
)
def run_summary(spark, sf_dir):
    summary = rr.run_summary(*_steps(spark, sf_dir))
    return summary.withColumn("total_time", rounded("total_time", 2)).drop("total_time_text")


def _table_sql(order):
    return f"""WITH {_STEPS_SQL} SELECT st.run, CAST(row_number() OVER (PARTITION BY st.run ORDER BY {order}, st.o1, st.o2, st.o3, st.o4, st.pos) AS INTEGER) AS number,
      st.phase, st.ident, st.score, CASE WHEN st.score IS NULL THEN '-' ELSE printf('%.5f', st.score) END AS score_text, st.time_s,
      CASE WHEN st.time_s IS NULL THEN '-' WHEN st.time_s >= 3600 THEN printf('%.2fh', st.time_s / 3600) WHEN st.time_s >= 60 THEN printf('%.1fm', st.time_s / 60)
        ELSE printf('%.1fs', st.time_s) END AS time_text, st.returncode, st.note, best.pos IS NOT NULL AS is_best
      FROM st LEFT JOIN best USING (run, pos)"""


@CHECKS.add(_table_sql("1"))
def run_table_by_order(spark, sf_dir):
    return rr.run_table(*_steps(spark, sf_dir))


@CHECKS.add(_table_sql("coalesce(st.time_s, 0) DESC"))
def run_table_by_time(spark, sf_dir):
    """Slowest first; a missing time counts as zero."""
    return rr.run_table(*_steps(spark, sf_dir), sort="time")


@CHECKS.add(_table_sql("coalesce(st.score, -1e9) DESC"))
def run_table_by_score(spark, sf_dir):
    """Highest first whatever the direction; missing scores last."""
    return rr.run_table(*_steps(spark, sf_dir), sort="score")


@CHECKS.add(f"""WITH {_STEPS_SQL} SELECT run, pos, o1, o2, o3, o4, score,
  row_number() OVER (PARTITION BY run ORDER BY coalesce(score, -1e9) DESC, o1, o2, o3, o4, pos) AS position FROM st""")
def order_steps(spark, sf_dir):
    steps, _ = _steps(spark, sf_dir)
    return rr.order_steps(steps, "score").select("run", "pos", *rr.ORDER, "score", "position")

"""Every query with SQL gives the same columns, types and rows on the second engine, by a plan without surprises.

The tree and regression learners take long; tests/test_models.py has them on a small table, and
tools/compare.py runs them here.
"""

import duckdb
import pytest

from __spark_entry__ import entry, queries
from checks import all_queries, all_sql
from tools.compare import TABLES, compare

SF = "/root/testdata/sf0.01"
ARROW = {"knn_join_labels", "knn_out_of_fold_k7", "knn_index_recall"}
SLOW = ("random_", "boosted_", "logistic_", "voting_", "seed_ensemble", "grid_search", "repeated_cv_forest", "final_fit")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_every_query_has_sql():
    assert set(all_sql()) == set(all_queries()) <= set(queries())


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["score"] and df.count() == 1


@pytest.mark.parametrize("name", [n for n in sorted(all_sql()) if not n.startswith(SLOW)])
def test_query_matches_sql(spark, con, name):
    def no_cross_join_no_python_rows(df):
        text = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
        assert "PythonUDF" not in text and "BatchEvalPython" not in text and "ArrowEvalPython" not in text
        assert name in ARROW or ("MapInArrow" not in text and "CoGroup" not in text)

    ok, text = compare(spark, con, name, queries()[name], all_sql()[name], SF, no_cross_join_no_python_rows)
    assert ok, text

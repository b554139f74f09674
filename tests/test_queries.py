"""Every registered query against its SQL, its plan, and the shape of the registry."""

import re
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))
import check  # noqa: E402
import __spark_entry__ as entry_point  # noqa: E402
from strainshift.plans import catalog  # noqa: E402

WITHOUT_SQL = set()
#: Grouped UDFs, and the mixed models, which are minimised in numpy for many models at a time.
PYTHON = {"udf_grouped_map", "udf_row_map", "random_intercept_fit", "random_intercept_effects", "nested_lrt", "many_model_sweep",
          "random_intercept_profile_ci", "part_profile_ci", "sweep_profile_ci", "bootstrap_second_step"}


@pytest.fixture(scope="module")
def con(sf):
    return check.connect(sf)


def test_registry_is_whole():
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == WITHOUT_SQL
    assert set(entry_point.queries()) >= set(catalog.QUERIES)
    assert len(catalog.QUERIES) >= 115


def test_entry_has_rows(spark):
    assert entry_point.entry(spark).count() > 0


def no_nested_loop_and_no_python(name):
    def inspect(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan
        if name not in PYTHON:
            assert not re.search("ArrowEvalPython|BatchEvalPython|InPandas|MapInArrow", plan)
    return inspect


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, con, sf, name):
    text, _, _, ok = check.compare(spark, con, name, sf, no_nested_loop_and_no_python(name))
    assert ok, text

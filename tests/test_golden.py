"""Published numbers as small literals, run through the operators."""

import pytest
from pyspark.sql import functions as F

from strainshift.functions.labels import perturbation_label
from strainshift.operators import windows as O
from strainshift.operators.reshape import wide_to_long
from strainshift.sources import sinks, tables
from strainshift.session import scratch_path

# Best score, k and a under varied fixed parameters.
SWEEPS = {
    "R0": [(59976.1804701163, 0.994903309331372, 8.39766232926901, 2.0), (56340.7182894606, 0.996378921874184, 4.99569367033765, 2.25),
           (55008.735752261, 0.993751751199037, 3.77742501942083, 2.5), (54329.8565963373, 0.999749623426479, 3.10040958365124, 2.75),
           (54003.6548814015, 0.999999996242934, 2.63712080127131, 3.0)],
    "SN0": [(60007.639302319, 0.998162317961122, 8.17305029694205, 0.72), (56336.3733154357, 0.99997909540916, 5.05387843326178, 0.81),
            (55008.735752261, 0.993751751199037, 3.77742501942083, 0.9), (54412.4414016458, 0.988877599801775, 3.07673490542923, 0.99)],
}
REFERENCE = {"R0": 2.5, "SN0": 0.9}


@pytest.fixture(scope="module")
def sweeps(spark):
    paths = {}
    for name, rows in SWEEPS.items():
        df = spark.createDataFrame([(v, "Successful completion", k, a, x) for v, k, a, x in rows],
                                   f"Value double, Convergence string, k double, a double, {name} double").coalesce(1)
        paths[name] = sinks.write_csv(df, scratch_path(spark, f"golden-{name}"))
    return tables.read_sweeps(spark, paths, ["Value", "Convergence", "k", "a"])


def test_sweep_labels(sweeps):
    ref = F.when(F.col("fixed_parm") == "R0", 2.5).otherwise(0.9)
    rows = sweeps.select("fixed_parm", "fixed_parm_value", perturbation_label(F.col("fixed_parm_value"), ref).alias("var")).collect()
    assert {(r["fixed_parm"], r["fixed_parm_value"]): r["var"] for r in rows} == {
        ("R0", 2.0): "2 (-20%)", ("R0", 2.25): "2.25 (-10%)", ("R0", 2.5): "2.5", ("R0", 2.75): "2.75 (+10%)", ("R0", 3.0): "3 (+20%)",
        ("SN0", 0.72): "0.72 (-20%)", ("SN0", 0.81): "0.81 (-10%)", ("SN0", 0.9): "0.9", ("SN0", 0.99): "0.99 (+10%)"}


def test_best_score_of_each_sweep(sweeps):
    best = {r["fixed_parm"]: r["fixed_parm_value"] for r in O.bottom_rows(sweeps, ["fixed_parm"], "Value").collect()}
    assert best == {"R0": 3.0, "SN0": 0.99}


def test_sensitivity_to_the_reference(sweeps):
    ref = F.when(F.col("fixed_parm") == "R0", 2.5).otherwise(0.9)
    long = wide_to_long(sweeps.withColumn("is_ref", F.col("fixed_parm_value") == ref),
                        ["fixed_parm", "fixed_parm_value", "is_ref"], ["k", "a"], "estim_parm", "estimates")
    out = O.relative_to_reference(long, ["fixed_parm", "estim_parm"], "estimates", "is_ref", "estimates_var")
    got = {(r["fixed_parm"], r["fixed_parm_value"], r["estim_parm"]): r["estimates_var"] for r in out.collect()}
    assert got[("R0", 2.0, "a")] == pytest.approx(8.39766232926901 / 3.77742501942083 - 1)
    assert got[("SN0", 0.9, "k")] == 0.0 and len(got) == 18


def test_profile_minimum_skips_missing_scores(spark):
    df = spark.createDataFrame([(0.1, 1267866.22011792), (3.7, None), (3.8, 14027.68), (3.9, 14100.0)], "parm double, wls double")
    assert [tuple(r) for r in O.bottom_rows(df, [], "wls").collect()] == [(3.8, 14027.68)]

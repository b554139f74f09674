import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strainshift.functions import control as C
from strainshift.functions import hashing as H
from strainshift.functions import labels as L
from strainshift.functions import tail
from strainshift.functions import transforms as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def values(spark, xs, fn, kind="double"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("x")).alias("y")).collect()]


def test_logit_edges(spark):
    got = values(spark, [None, 0.0, 0.1, 0.5, 1.0], T.logit)
    assert got[0] is None and got[1] is None and got[4] is None
    assert got[2] == pytest.approx(math.log(1 / 9)) and got[3] == 0.0


def test_log_ab_round_trip_and_bounds(spark):
    xs = [0.001, 0.05, 0.1999]
    back = values(spark, xs, lambda x: T.inv_log_ab(T.log_ab(x, 0, 0.2), 0, 0.2))
    assert back == pytest.approx(xs, rel=1e-12)
    assert values(spark, [-0.1, 0.0, 0.2, 0.3, None], lambda x: T.log_ab(x, 0, 0.2)) == [None] * 5
    assert values(spark, [1e4, -1e4], lambda y: T.inv_log_ab(y, 0, 0.2)) == pytest.approx([0.2, 0.0])
    with pytest.raises(Exception, match="not between"):
        values(spark, [0.3], lambda x: T.log_ab(x, 0, 0.2, strict=True))


def test_every_parameter_round_trips(spark):
    row = {n: 0.004 if n in T.INTERVAL_PARAMETERS else 0.3 for n in T.CANONICAL_PARAMETERS}
    df = spark.createDataFrame([tuple(row.values())], list(row))
    back = T.params_from_real(T.params_to_real(df)).first().asDict()
    assert back == pytest.approx(row, rel=1e-12)


def test_canonical_order(spark):
    df = spark.range(1).selectExpr("1 AS mu", "2 AS k", "3 AS repeat", "4 AS beta", "5 AS pS")
    assert T.canonical_order(df).columns == ["repeat", "pS", "beta", "k", "mu"]


def test_selection_forms(spark):
    assert one(spark, C.selection_coef(0.1, -0.02)) == pytest.approx(0.05)
    assert one(spark, C.selection_coef(0.1, -0.02, form="legacy")) == pytest.approx(0.06)
    with pytest.raises(ValueError):
        C.selection_coef(0.1, 0.1, form="other")


def test_effectiveness_without_an_index_is_zero(spark):
    assert values(spark, [None, 100.0], lambda p: C.effectiveness(p, 0.9, 2.0)) == [0.0, 0.9]


def test_reporting_rate_prefers_the_constant(spark):
    assert one(spark, C.reporting_rate(10.0, None, 0.1, 0.01)) == pytest.approx(0.2)
    assert one(spark, C.reporting_rate(10.0, 0.5, 0.1, 0.01)) == 0.5


def test_initial_state_sums_to_population(spark):
    state = C.initial_state(1000.0, 2.0, 0.9, 0.001, 0.5, 0.2, 0.1)
    parts = {k: one(spark, v) for k, v in state.items()}
    assert parts["ISd"] == 4 and parts["ISr"] == pytest.approx(36) and parts["IA"] == pytest.approx(160)
    assert sum(v for k, v in parts.items() if k not in ("D", "IS_cumul")) == pytest.approx(1000)
    shares = C.shares_state(1000.0, 0.9, 0.01, 0.02, 0.01, 0.005)
    assert one(spark, shares["R"]) == pytest.approx(55)


def test_zero_divisors_do_not_stop_a_job(spark):
    assert math.isnan(one(spark, C.transmission_integrand(1.0, kappa=0.1, gamma_w=0.1)))
    state = C.initial_state(1000.0, 2.0, 0.9, 0.001, 0.5, 0.2, 0.0)
    assert one(spark, state["ISr"]) is None and one(spark, state["ISd"]) == 4
    assert one(spark, C.r0_from_beta(0.25, 0.1, 0.0, 0.1, 0.1)) is None


def test_r0_is_inverted_by_beta(spark):
    args = (0.1, 0.9, 0.08, 0.02)
    beta = C.beta_from_r0(2.5, *args)
    assert one(spark, C.r0_from_beta(beta, *args)) == pytest.approx(2.5)
    assert one(spark, C.corrected_r0(2.5, *args)) == pytest.approx(one(spark, C.r0_from_beta(0.25, *args)))


def test_selection_gradient_is_undefined_at_zero(spark):
    assert one(spark, C.selection_gradient(0.0, 10, 10, d1=0.3)) is None
    assert one(spark, C.selection_gradient(1.0, 10, 10, d1=0.3)) == pytest.approx(0.03)
    assert one(spark, C.selection_gradient(1.5, 10, 10, d2=0.3)) == pytest.approx(
        0.3 * 0.5 / 10 + 1.5 * (-0.6 * math.log(1.5)) / 10)


@pytest.mark.parametrize("digits", [0, 2])
def test_signed_label_rounds_like_c(spark, digits):
    rng = np.random.default_rng(1)
    xs = [0.0, 1e-9, -1e-9, 0.125, 0.375, -0.5, 0.5, 1.5, 2.5, -61.315, 0.005, 1.005, 2.675, 20.0, -10.0, 99.995,
          0.285, 1234567.125] + [float(x) for x in np.round(rng.normal(0, 50, 300), 3)]
    want = [(f"% .{digits}f" if abs(x) < 1.5e-8 else f"%+.{digits}f") % x for x in xs]
    assert values(spark, xs, lambda x: L.signed_label(x, digits)) == want


def test_perturbation_label(spark):
    df = spark.createDataFrame([(2.25, 2.5), (2.5, 2.5), (0.11, 0.1), (0.24, 0.2)], "v double, r double")
    got = [r[0] for r in df.select(L.perturbation_label(F.col("v"), F.col("r"))).collect()]
    assert got == ["2.25 (-10%)", "2.5", "0.11 (+10%)", "0.24 (+20%)"]


def test_codes_at_their_cuts(spark):
    ps = [0.0005, 0.001, 0.01, 0.05, 0.1, 0.5, None]
    assert values(spark, ps, L.significance_code) == ["***", "***", "**", "*", ".", " ", None]
    assert [x and x[:7] for x in values(spark, ps, L.p_interval)] == [
        "p < 0.0", "0.001 <", "0.01 < ", "p > 0.0", "p > 0.0", "p > 0.0", None]


def test_rounding(spark):
    assert values(spark, [0.00012345, 1234.5, 0.0, -98765.0], lambda x: L.signif(x, 3)) == pytest.approx(
        [0.000123, 1230.0, 0.0, -98800.0])
    assert values(spark, [0.6826, 0.75, 0.7499], lambda x: L.floor_to(x, 0.05)) == pytest.approx([0.65, 0.75, 0.70])


def test_convergence_codes_are_matched_whole(spark):
    got = values(spark, [0, 1, 10, 7], L.convergence_label, "int")
    assert got == ["Successful completion", "iteration limit had been reached",
                   "Degeneracy of the Nelder-Mead simplex", None]


def test_hash_uniform_known_value(spark):
    assert one(spark, H.hash_uniform("1", "7", "k")) == pytest.approx(0.1934101283182279, abs=1e-15)


@pytest.mark.parametrize("law", ["Rademacher", "Mammen2", "Standard normal"])
def test_wild_weights_have_mean_zero_and_variance_one(spark, law):
    row = (spark.range(40000).select(H.wild_weight(law, 456, F.col("id")).alias("w"))
           .agg(F.avg("w"), F.var_samp("w")).first())
    assert abs(row[0]) < 0.02 and abs(row[1] - 1) < 0.03


def test_wild_weights_do_not_depend_on_partitioning(spark):
    def draw(n):
        df = spark.range(500).repartition(n).select("id", H.wild_weight("Mammen2", 1, F.col("id")).alias("w"))
        return sorted(map(tuple, df.collect()))
    assert draw(1) == draw(7)
    with pytest.raises(ValueError):
        H.wild_weight("cauchy", 1)


def test_tail_probabilities(spark):
    df = spark.createDataFrame([(2.0, 10.0), (0.0, 5.0), (-3.5, 2.0)], "t double, v double")
    got = [r[0] for r in df.select(tail.t_two_sided("t", "v")).collect()]
    assert got == pytest.approx([0.07338803, 1.0, 1 - 3.5 / math.sqrt(2 + 3.5 ** 2)], rel=1e-5)
    f = spark.createDataFrame([(4.0, 2.0, 10.0), (0.0, 1.0, 5.0)], "f double, a double, b double")
    assert [r[0] for r in f.select(tail.f_upper("f", "a", "b")).collect()] == pytest.approx(
        [(1 + 2 * 4 / 10) ** -5, 1.0], rel=1e-9)
    c = spark.createDataFrame([(3.841458820694124,), (None,)], "x double")
    assert [r[0] for r in c.select(tail.chi2_upper_1("x")).collect()] == [pytest.approx(0.05), None]


def test_t_quantiles_invert_the_tail(spark):
    df = spark.range(1, 400).select(F.col("id").cast("double").alias("v"))
    rows = df.withColumn("q", tail.t_quantile_975(F.col("v"))).withColumn("p", tail.t_two_sided("q", "v")).collect()
    assert max(abs(r["p"] - 0.05) for r in rows) < 5e-9


def test_tails_against_quadrature(spark):
    rows = [(t, v) for v in (1.0, 3.0, 28.0, 400.0, 5000.0) for t in (0.01, 0.7, 2.5, 6.0)]
    df = spark.createDataFrame(rows, "t double, v double")
    u = np.linspace(0, 1, 200_001)

    def share(top, p):  # integral of sin^p up to top over that up to pi / 2
        def area(hi):
            y = np.sin(hi * u) ** p
            return hi * np.trapezoid(y, u)
        return area(top) / area(math.pi / 2)

    for r in df.withColumn("p", tail.t_two_sided("t", "v")).collect():
        assert r["p"] == pytest.approx(share(math.asin(math.sqrt(r["v"] / (r["v"] + r["t"] ** 2))), r["v"] - 1), rel=1e-5)
    chi = spark.createDataFrame([(x,) for x in (0.0, 1e-8, 0.5, 5.999, 6.0, 6.001, 30.0, 500.0)], "x double")
    for r in chi.withColumn("p", tail.chi2_upper_1("x")).collect():
        assert r["p"] == pytest.approx(math.erfc(math.sqrt(r["x"] / 2)), rel=1e-9)

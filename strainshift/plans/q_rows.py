"""Queries of filters, derived columns and recoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from strainshift.functions import control as C
from strainshift.functions.labels import convergence_label
from strainshift.functions.transforms import canonical_order
from strainshift.operators import rows as R
from strainshift.plans import views as V
from strainshift.plans.registry import query
from strainshift.session import materialise

LABEL_SQL = ("CASE code WHEN 0 THEN 'Successful completion' WHEN 1 THEN 'iteration limit had been reached' "
             "ELSE 'Degeneracy of the Nelder-Mead simplex' END")
# Reference values of the first step and of the second.
REF = {"R0": 2.5, "kappa": 0.2, "gamma": 0.1, "SN0": 0.9}


@query("entity_filter", """
    SELECT event_id AS id, CAST(ts AS DATE) AS date, value AS new_tests FROM events WHERE event_type = 'view'""")
def entity_filter(spark, sf):
    view = R.entity_filter(V.table(spark, sf, "events"), "event_type", "view",
                           {"event_id": "id", "ts": "date", "value": "new_tests"})
    return view.withColumn("date", F.to_date("date"))


@query("derive_complement", """
    SELECT CAST(ts AS DATE) AS date, COUNT(*) AS new_tests, COUNT(*) FILTER (WHERE event_type = 'click') AS new_cases,
           COUNT(*) - COUNT(*) FILTER (WHERE event_type = 'click') AS negative_tests FROM events GROUP BY 1""")
def derive_complement(spark, sf):
    tests = V.table(spark, sf, "events").groupBy(F.to_date("ts").alias("date")).agg(
        F.count(F.lit(1)).alias("new_tests"), F.count_if(F.col("event_type") == "click").alias("new_cases"))
    return R.derive_complement(tests, "new_tests", "new_cases", "negative_tests")


@query("date_window_filter", f"""
    WITH weeks AS (SELECT min(date_trunc('week', ts)) AS lo, max(date_trunc('week', ts)) AS hi FROM
                   (SELECT o_orderdate AS ts FROM orders WHERE o_orderstatus = 'P') p)
    SELECT CAST(l_shipdate AS DATE) AS day, COUNT(*) AS n, round(1000 * avg(l_discount) + 0.0, 6) AS psi
    FROM lineitem, weeks WHERE CAST(l_shipdate AS DATE) BETWEEN CAST(lo AS DATE) - 7 AND CAST(hi AS DATE) + 6
    GROUP BY 1""")
def date_window_filter(spark, sf):
    weeks = (V.table(spark, sf, "orders").filter("o_orderstatus = 'P'")
             .select(V.period_of("o_orderdate", "week").alias("week")))
    lines = R.date_window(V.table(spark, sf, "lineitem"), F.col("l_shipdate"), weeks, "week")
    return (lines.groupBy(F.to_date("l_shipdate").alias("day"))
            .agg(F.count(F.lit(1)).alias("n"), F.round(1000 * F.avg("l_discount") + 0.0, 6).alias("psi")))


@query("threshold_filter", f"""
    WITH {V.panel_sql()}
    SELECT 'at least' AS mode, region, period, round(fm, 6) AS fm FROM panel WHERE fm >= 0.35
    UNION ALL SELECT 'above', region, period, round(fm, 6) FROM panel WHERE fm > 0.35""")
def threshold_filter(spark, sf):
    cells = V.panel(spark, sf).select("region", "period", "fm")
    return R.threshold_modes(cells, "fm", 0.35).withColumn("fm", F.round("fm", 6))


@query("converged_filter", f"""
    WITH {V.PARAMS_SQL}
    SELECT model_id, {LABEL_SQL} AS convergence, value FROM params
    WHERE code = 0 AND kind <> 'ECONOMY'""")
def converged_filter(spark, sf):
    fits = V.model_params(spark, sf).select(
        "model_id", convergence_label(F.col("code")).alias("convergence"),
        F.when(F.col("kind") != "ECONOMY", F.col("value")).alias("value"))
    return R.converged_filter(fits)


@query("drop_na_rows", f"""
    WITH {V.panel_sql('week')}
    SELECT region, period, round(fm, 6) AS fm, round(logit_fm, 6) AS logit_fm FROM panel WHERE logit_fm IS NOT NULL""")
def drop_na_rows(spark, sf):
    cells = V.panel(spark, sf, "week").select("region", "period", "fm", "logit_fm")
    return R.drop_na_rows(cells, ["logit_fm"]).withColumns(
        {"fm": F.round("fm", 6), "logit_fm": F.round("logit_fm", 6)})


@query("split_origin", """
    WITH tagged AS (SELECT CASE o_orderstatus WHEN 'O' THEN 'observed' WHEN 'P' THEN 'best' ELSE 'replicate' END AS origin,
                           o_orderpriority, o_totalprice FROM orders)
    SELECT origin AS part, o_orderpriority AS series, COUNT(*) AS n, round(sum(o_totalprice), 1) AS total
    FROM tagged GROUP BY 1, 2""")
def split_origin(spark, sf):
    tagged = V.table(spark, sf, "orders").select(
        F.when(F.col("o_orderstatus") == "O", "observed").when(F.col("o_orderstatus") == "P", "best")
        .otherwise("replicate").alias("origin"), F.col("o_orderpriority").alias("series"), "o_totalprice")
    sums = materialise(tagged.groupBy("origin", "series").agg(  # orders are read once, the parts from their sums
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 1).alias("total")))
    parts = [df.drop("origin").withColumn("part", F.lit(name)) for name, df in R.split_origin(sums).items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("exclude_category", f"""
    WITH {V.PARAMS_SQL}, bad AS (SELECT model_id FROM params WHERE code = 10)
    SELECT model_id, kind, round(k, 6) AS k FROM params
    WHERE (kind IS NULL OR kind <> 'ECONOMY') AND model_id NOT IN (SELECT model_id FROM bad)""")
def exclude_category(spark, sf):
    fits = V.model_params(spark, sf)
    kept = R.exclude_category(fits, "kind", "ECONOMY")
    return R.exclude_ids(kept, fits.filter("code = 10"), "model_id").select(
        "model_id", "kind", F.round("k", 6).alias("k"))


@query("clamp_floor", """
    SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS clamped,
           CASE WHEN c_acctbal < 1000 THEN 1000.0 ELSE c_acctbal END AS raised FROM customer""")
def clamp_floor(spark, sf):
    balance = F.col("c_acctbal")
    return V.table(spark, sf, "customer").select(
        "c_custkey", R.clamp_floor(balance).alias("clamped"), R.clamp_floor(balance, 1000.0).alias("raised"))


@query("const_columns", f"""
    WITH {V.PARAMS_SQL}
    SELECT model_id, 'seed1234_' || brand AS "group", 0.25::DOUBLE AS beta,
           round(2.5 * 0.1 * (exit_rate + omega * p * (0.1 - exit_rate)) / (0.1 * exit_rate), 6) AS R0 FROM params""")
def const_columns(spark, sf):
    return V.model_params(spark, sf).select(
        "model_id", F.concat(F.lit("seed1234_"), "brand").alias("group"),
        F.round(F.lit(2.5) * 0.1, 6).alias("beta"),
        F.round(C.corrected_r0(2.5, 0.1, F.col("exit_rate"), F.col("omega"), F.col("p")), 6).alias("R0"))


SWEEP_SQL = (
    V.PARAMS_SQL + ", names(fixed_parm) AS (VALUES ('R0'), ('kappa'), ('gamma'), ('SN0'))"
    ", mult(multiplier) AS (VALUES (0.8::DOUBLE), (0.9::DOUBLE), (1.0::DOUBLE), (1.1::DOUBLE), (1.2::DOUBLE))"
    ", swept AS (SELECT model_id, k, a, fixed_parm, multiplier,"
    " 2.5::DOUBLE * CASE WHEN fixed_parm = 'R0' THEN multiplier ELSE 1 END AS r0,"
    " 0.2::DOUBLE * CASE WHEN fixed_parm = 'kappa' THEN multiplier ELSE 1 END AS kappa,"
    " 0.1::DOUBLE * CASE WHEN fixed_parm = 'gamma' THEN multiplier ELSE 1 END AS gamma,"
    " 0.9::DOUBLE * CASE WHEN fixed_parm = 'SN0' THEN multiplier ELSE 1 END AS sn0"
    " FROM params, names, mult WHERE NOT (fixed_parm = 'SN0' AND multiplier = 1.2))")


def swept(spark, sf):
    """Every parameter row under every admissible perturbation of the fixed parameters."""
    defaults = {n: F.lit(v) for n, v in REF.items()}
    return R.cross_sweep(V.model_params(spark, sf).select("model_id", "k", "a"), defaults, {"SN0": 1.0})


def fixed_value():
    out = F.col("SN0")
    for name in ("R0", "kappa", "gamma"):
        out = F.when(F.col("fixed_parm") == name, F.col(name)).otherwise(out)
    return out


VALUE_SQL = "CASE fixed_parm WHEN 'R0' THEN r0 WHEN 'kappa' THEN kappa WHEN 'gamma' THEN gamma ELSE sn0 END"


@query("recode_param", f"""
    WITH {SWEEP_SQL}
    SELECT model_id, multiplier, CASE WHEN fixed_parm = 'R0' THEN 'beta' ELSE fixed_parm END AS fixed_parm,
           round(CASE WHEN fixed_parm = 'R0' THEN 0.1 * r0 ELSE {VALUE_SQL} END, 6) AS fixed_parm_value FROM swept""")
def recode_param(spark, sf):
    long = swept(spark, sf).select("model_id", "multiplier", "fixed_parm", fixed_value().alias("fixed_parm_value"))
    return (R.recode_param(long, "fixed_parm", "fixed_parm_value", "R0", "beta", REF["gamma"])
            .withColumn("fixed_parm_value", F.round("fixed_parm_value", 6)))


@query("param_override", f"""
    WITH {SWEEP_SQL}
    SELECT model_id, fixed_parm, multiplier, round(CASE WHEN fixed_parm = 'R0' THEN r0 * 0.1 ELSE 0.25 END, 6) AS beta_w,
           round(CASE WHEN fixed_parm = 'kappa' THEN kappa ELSE 0.2 END, 6) AS kappa,
           round(CASE WHEN fixed_parm = 'gamma' THEN gamma ELSE 0.1 END, 6) AS gamma_w FROM swept""")
def param_override(spark, sf):
    """beta_w follows a varied R0 at the default recovery rate; it stays put when another parameter varies."""
    long = swept(spark, sf).select("model_id", "multiplier", "fixed_parm", fixed_value().alias("value"))
    wide = R.param_override(long, "fixed_parm", "value", {"R0": 2.5, "kappa": C.KAPPA, "gamma": C.GAMMA_W})
    return wide.select("model_id", "fixed_parm", "multiplier", F.round(F.col("R0") * C.GAMMA_W, 6).alias("beta_w"),
                       F.round("kappa", 6).alias("kappa"), F.round("gamma", 6).alias("gamma_w"))


@query("canonical_param_order", f"""
    WITH {V.PARAMS_SQL}
    SELECT model_id, 'model_id,value,pE,exit_rate,k,a,omega,p,eta,mu' AS column_order, value,
           round(pE, 6) AS "pE", round(exit_rate, 6) AS exit_rate, round(k, 6) AS k, round(a, 6) AS a FROM params""")
def canonical_param_order(spark, sf):
    shuffled = V.model_params(spark, sf).select("mu", "a", "model_id", "eta", "pE", "value", "p", "k", "omega", "exit_rate")
    ordered = canonical_order(shuffled)
    return ordered.select("model_id", F.lit(",".join(ordered.columns)).alias("column_order"), "value",
                          *[F.round(c, 6).alias(c) for c in ("pE", "exit_rate", "k", "a")])


@query("cross_sweep", f"""
    WITH {SWEEP_SQL}
    SELECT model_id, fixed_parm, multiplier, round(r0, 6) AS "R0", round(kappa, 6) AS kappa, round(gamma, 6) AS gamma,
           round(sn0, 6) AS "SN0" FROM swept""")
def cross_sweep(spark, sf):
    return swept(spark, sf).select("model_id", "fixed_parm", "multiplier",
                                   *[F.round(n, 6).alias(n) for n in REF])

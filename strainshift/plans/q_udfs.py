"""Queries of the escape hatches: functions per group and per row, other scores, tails."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from strainshift.functions import labels as L
from strainshift.functions.tail import chi2_upper_1, f_upper, t_two_sided
from strainshift.operators import regression as G
from strainshift.operators import reshape as S
from strainshift.operators import score
from strainshift.plans import views as V
from strainshift.plans.q_aggregates import CANDIDATES_SQL, OBS_SQL, candidates, observations
from strainshift.plans.q_models import CORR_SQL, NATIONAL_SQL, NESTED_SQL, WITH_P_SQL, chi2_sql, code_sql, place_pairs, signif_sql
from strainshift.plans.q_windows import RESIDUAL_SQL, S_SQL, selection_with_control
from strainshift.plans.registry import query
from strainshift.session import materialise


def _differences(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("period")
    s = (group["logit_fm"].shift(-1) - group["logit_fm"].shift(1)) / 2
    return group.assign(s=s.round(6))[["region", "period", "s"]].dropna()


@query("udf_grouped_map", f"WITH {V.panel_sql()}, {S_SQL} SELECT region, period, round(s, 6) AS s FROM diffs")
def udf_grouped_map(spark, sf):
    """Central differences by a pandas function per region, on cells that are aggregated already."""
    cells = V.panel(spark, sf).filter((F.col("fm") > 0.1) & F.col("logit_fm").isNotNull())
    return S.grouped_map(cells.select("region", "period", "logit_fm"), ["region"], _differences,
                         "region string, period date, s double")


def _last_state(batch: pd.DataFrame) -> pd.DataFrame:
    return batch.assign(share=(batch["k"] * batch["omega"] + batch["p"]).round(6))[["model_id", "share"]]


@query("udf_row_map", f"WITH {V.PARAMS_SQL} SELECT model_id, round(k * omega + p, 6) AS share FROM params")
def udf_row_map(spark, sf):
    return S.row_map(V.model_params(spark, sf).select("model_id", "k", "omega", "p"), _last_state,
                     "model_id long, share double")


@query("pluggable_score", f"""
    WITH {OBS_SQL}, {CANDIDATES_SQL}
    SELECT candidate, round(sum(abs(value - base * mu * exp(eta * t))), 4) AS score FROM cand, points GROUP BY 1""")
def pluggable_score(spark, sf):
    """Another curve and another loss given as functions of columns."""
    def growth():
        return F.col("base") * F.col("mu") * F.exp(F.col("eta") * F.col("t"))

    def absolute(observed, expected, floor):
        return F.abs(observed - expected)

    scored = score.score_candidates(candidates(spark, sf), materialise(observations(spark, sf)), growth, loss=absolute)
    return scored.select("candidate", F.round("score", 4).alias("score"))


TAIL_SQL = f"""
    WITH {RESIDUAL_SQL}, {NATIONAL_SQL}, {CORR_SQL}{WITH_P_SQL}, {NESTED_SQL},
    tests AS (SELECT 'corr ' || place AS test, t_raw AS stat, p_raw AS p FROM tp
    UNION ALL SELECT '+ x', f_12, p_12 FROM fp UNION ALL SELECT 'x by region', f_23, p_23 FROM fp
    UNION ALL SELECT 'square of corr ' || place, t_raw * t_raw, {chi2_sql('t_raw * t_raw')} FROM tp)
    SELECT test, round(stat, 6) AS stat, {signif_sql('p')} AS p, {code_sql('p')} AS code FROM tests"""


@query("tail_prob", TAIL_SQL)
def tail_prob(spark, sf):
    """p-values of the correlation and nested-model tests, with their codes."""
    corr = G.corr_test(place_pairs(spark, sf), ["place"], "x", "s").select(
        F.concat(F.lit("corr "), "place").alias("test"), F.col("t_stat").alias("stat"),
        t_two_sided("t_stat", F.col("df").cast("double")).alias("p"))
    groups = G.group_sums(selection_with_control(spark, sf), [], "region", ["x"], "s")
    f = G.nested_f_test(groups, [], "x", "s").select(F.inline(F.array(
        F.struct(F.lit("+ x").alias("test"), F.col("f_12").alias("stat"), F.col("df_12").cast("double").alias("d1"),
                 F.col("df_2").cast("double").alias("d2")),
        F.struct(F.lit("x by region").alias("test"), F.col("f_23").alias("stat"), F.col("df_23").cast("double").alias("d1"),
                 F.col("df_3").cast("double").alias("d2")))))
    tests = f.select("test", "stat", f_upper("stat", "d1", "d2").alias("p"))
    chi2 = corr.select(F.concat(F.lit("square of "), "test").alias("test"),
                       (F.col("stat") * F.col("stat")).alias("stat")).withColumn("p", chi2_upper_1("stat"))
    rows = corr.unionByName(tests).unionByName(chi2)
    return rows.select("test", F.round("stat", 6).alias("stat"), L.signif(F.col("p"), 3).alias("p"),
                       L.significance_code(F.col("p")).alias("code"))

"""Queries of unions and reshaping."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strainshift.operators import reshape as S
from strainshift.operators.resample import wild_replicates
from strainshift.operators.summaries import ensemble_curves as envelope
from strainshift.plans import views as V
from strainshift.plans.q_rows import REF
from strainshift.plans.registry import query
from strainshift.session import materialise, scratch_path
from strainshift.sources import sinks

REPLICATES = 1000
MAMMEN_SQL = "CASE WHEN u < (sqrt(5) + 1) / (2 * sqrt(5)) THEN (1 - sqrt(5)) / 2 ELSE (1 + sqrt(5)) / 2 END"


def uniform_sql(*parts: str) -> str:
    text = " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"(CAST(('0x' || substr(md5({text}), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE)"


RESIDUALS_SQL = (
    V.EVENTS_SQL + ", smooth AS (SELECT series, day, CAST(n AS DOUBLE) AS value,"
    " avg(n) OVER (PARTITION BY series ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS expected FROM daily)"
    ", resid AS (SELECT *, value - expected AS residual FROM smooth)")
REPLICATES_SQL = (
    RESIDUALS_SQL + f", b AS (SELECT CAST(unnest(generate_series(1, {REPLICATES})) AS INTEGER) AS replicate)"
    f", drawn AS (SELECT series, day, replicate, expected, residual, {uniform_sql('456', 'replicate', 'series', 'day')} AS u FROM resid, b)"
    f", reps AS (SELECT series, day, replicate, expected + residual * ({MAMMEN_SQL}) AS value FROM drawn)")


def residuals(spark, sf):
    """Daily counts, their trailing mean as expected value, and the difference."""
    daily = V.daily_events(spark, sf).select("series", "day", F.col("n").cast("double").alias("value"))
    fit = F.avg("value").over(W.partitionBy("series").orderBy("day").rowsBetween(-6, 0))
    return S.residual_table(daily, daily.select("series", "day", fit.alias("expected")), ["series", "day"])


def replicates(spark, sf, law: str = "Mammen2", n: int = REPLICATES):
    source = materialise(residuals(spark, sf).drop("value"))
    return wild_replicates(source, ["series", "day"], n, law, 456)


@query("residual_table", f"""
    WITH {RESIDUALS_SQL}
    SELECT series, day, value, round(expected, 6) AS expected, round(residual, 6) AS residual FROM resid""")
def residual_table(spark, sf):
    return residuals(spark, sf).withColumns({c: F.round(c, 6) for c in ("expected", "residual")})


@query("ensemble_union", f"""
    WITH {REPLICATES_SQL}
    SELECT 'observed' AS origin, CAST(NULL AS INTEGER) AS replicate, series, day, value FROM smooth
    UNION ALL SELECT 'best', 0, series, day, round(expected, 6) FROM smooth
    UNION ALL SELECT 'replicate', replicate, series, day, round(value, 6) FROM reps""")
def ensemble_union(spark, sf):
    base = residuals(spark, sf)
    keys = ["series", "day"]
    out = S.ensemble_union(base.select(*keys, "value"), base.select(*keys, F.col("expected").alias("value")),
                           replicates(spark, sf).select(*keys, "replicate", "value"))
    return out.withColumn("value", F.round("value", 6))


@query("accumulate_union", f"""
    WITH {V.PARAMS_SQL}
    SELECT brand, code, COUNT(*) AS n, round(min(k), 6) AS k_min, round(max(a), 6) AS a_max FROM params GROUP BY 1, 2""")
def accumulate_union(spark, sf):
    """The union of the committed batches of a run, then its summary."""
    rows = sinks.run_batches(V.model_params(spark, sf), lambda tasks: tasks.select("model_id", "brand", "code", "k", "a"),
                             scratch_path(spark, "accumulate"), "model_id", batches=4)
    return rows.groupBy("brand", "code").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.min("k"), 6).alias("k_min"), F.round(F.max("a"), 6).alias("a_max"))


@query("defaults_union", f"""
    WITH {V.PARAMS_SQL}
    SELECT 'kappa' AS fixed_parm, model_id, 2.5::DOUBLE AS "R0", round(0.2 * exit_rate, 6) AS kappa, 0.1::DOUBLE AS gamma, 0.9::DOUBLE AS "SN0" FROM params WHERE code = 0
    UNION ALL SELECT 'gamma', model_id, 2.5, 0.2, round(0.1 * exit_rate, 6), 0.9 FROM params WHERE code = 1
    UNION ALL SELECT 'SN0', model_id, 2.5, 0.2, 0.1, round(0.9 * exit_rate, 6) FROM params WHERE code = 10""")
def defaults_union(spark, sf):
    fits = V.model_params(spark, sf)
    parts = [fits.filter(F.col("code") == code).select(
        F.lit(name).alias("fixed_parm"), "model_id", F.round(REF[name] * F.col("exit_rate"), 6).alias(name))
        for name, code in (("kappa", 0), ("gamma", 1), ("SN0", 10))]
    filled = S.defaults_union([p.withColumn("R0", F.lit(REF["R0"])) for p in parts], REF)
    return filled.select("fixed_parm", "model_id", *REF)


@query("seed_union", f"""
    WITH {V.PARAMS_SQL}, best AS (SELECT brand, arg_min(model_id, (value, model_id)) AS model_id FROM params WHERE code = 0 GROUP BY 1)
    SELECT 'best' AS seed, p.brand, p.model_id, round(p.k, 6) AS k FROM params p JOIN best USING (model_id)
    UNION ALL SELECT 'start', brand, model_id, round(k, 6) FROM params""")
def seed_union(spark, sf):
    fits = V.model_params(spark, sf).select("brand", "model_id", "value", "code", "k")
    row = F.min_by(F.struct("model_id", "k"), F.struct("value", "model_id"))
    best = fits.filter("code = 0").groupBy("brand").agg(row.alias("r")).select("brand", "r.*")
    both = S.union_tagged({"best": best, "start": fits.select("brand", "model_id", "k")}, "seed")
    return both.withColumn("k", F.round("k", 6))


LONG = ["k", "a", "pE", "omega", "p", "exit_rate", "mu"]


@query("wide_to_long", f"""
    WITH {V.PARAMS_SQL} """ + " UNION ALL ".join(
    f"SELECT model_id, '{c}' AS estim_parm, {i + 1} AS sort_key, round({c}, 6) AS estimates FROM params" for i, c in enumerate(LONG)))
def wide_to_long(spark, sf):
    long = S.wide_to_long(V.model_params(spark, sf), ["model_id"], LONG, "estim_parm", "estimates")
    rank = F.element_at(F.create_map(*[x for i, c in enumerate(LONG) for x in (F.lit(c), F.lit(i + 1))]), F.col("estim_parm"))
    return long.select("model_id", "estim_parm", rank.alias("sort_key"), F.round("estimates", 6).alias("estimates"))


@query("stack_series", f"""
    WITH {V.panel_sql('week')}
    SELECT region, period, 'Confirmed S-gene' AS legend, n_total - n_variant AS numbers, round(1 - fm, 6) AS share FROM panel
    UNION ALL SELECT region, period, 'Confirmed SGTF', n_variant, round(fm, 6) FROM panel
    UNION ALL SELECT region, period, 'Total tests', n_total, 1.0::DOUBLE FROM panel""")
def stack_series(spark, sf):
    cells = V.panel(spark, sf, "week").select(
        "region", "period", (F.col("n_total") - F.col("n_variant")).alias("n_other"), "n_variant", "n_total",
        F.round(1 - F.col("fm"), 6).alias("pct_other"), F.round("fm", 6).alias("pct_variant"),
        F.lit(1.0).alias("pct_total"))
    return S.stack_measures(cells, ["region", "period"], {
        "Confirmed S-gene": {"numbers": "n_other", "share": "pct_other"},
        "Confirmed SGTF": {"numbers": "n_variant", "share": "pct_variant"},
        "Total tests": {"numbers": "n_total", "share": "pct_total"}}, "legend")


@query("long_to_wide", f"""
    WITH {V.EVENTS_SQL}
    SELECT day, max(n) FILTER (WHERE series = 'view') AS "view", max(n) FILTER (WHERE series = 'click') AS click,
           max(n) FILTER (WHERE series = 'error') AS error FROM daily GROUP BY 1""")
def long_to_wide(spark, sf):
    return S.long_to_wide(V.daily_events(spark, sf), ["day"], "series", "n", ["view", "click", "error"])


@query("ensemble_curves", f"""
    WITH {REPLICATES_SQL}
    SELECT series, day, round(quantile_cont(value, 0.025), 5) AS lower, round(quantile_cont(value, 0.5), 5) AS median,
           round(quantile_cont(value, 0.975), 5) AS upper FROM reps GROUP BY 1, 2""")
def ensemble_curves(spark, sf):
    drawn = materialise(replicates(spark, sf).select("series", "day", "value"))  # drawn once, read by every pass
    out = envelope(drawn, ["series", "day"], "value")
    return out.withColumns({c: F.round(c, 5) for c in ("lower", "median", "upper")})


@query("replicate_first_day", f"""
    WITH {REPLICATES_SQL}
    SELECT replicate, series, min(day) AS day, round(arg_min(value, day), 6) AS first_value FROM reps GROUP BY 1, 2""")
def replicate_first_day(spark, sf):
    """The first day's value of every replicate of every series, from which its trajectory starts."""
    rows = replicates(spark, sf).groupBy("replicate", "series").agg(F.min("day").alias("day"), F.min_by("value", "day").alias("first_value"))
    return rows.withColumn("first_value", F.round("first_value", 6))


LAWS = {"Rademacher": "CASE WHEN u < 0.5 THEN 1.0 ELSE -1.0 END", "Mammen2": MAMMEN_SQL,
        "Standard normal": "sqrt(-2 * ln(1 - u)) * cos(2 * pi() * v)"}


@query("wild_replicates", f"""
    WITH {RESIDUALS_SQL}, b AS (SELECT CAST(unnest(generate_series(1, {REPLICATES})) AS INTEGER) AS replicate),
    drawn AS (SELECT series, day, replicate, expected, residual, {uniform_sql('456', 'replicate', 'series', 'day')} AS u,
        {uniform_sql('456', 'replicate', 'series', 'day', "'angle'")} AS v FROM resid, b)
    """ + " UNION ALL ".join(
    f"SELECT '{law}' AS law, replicate, COUNT(*) AS n, round(sum(expected + residual * ({sql})), 4) AS total, "
    f"round(avg({sql}), 6) AS mean_weight FROM drawn GROUP BY 2" for law, sql in LAWS.items()))
def wild_replicate_totals(spark, sf):
    source = materialise(residuals(spark, sf).drop("value"))
    drawn = wild_replicates(source, ["series", "day"], REPLICATES, list(LAWS), 456)
    return drawn.groupBy("law", "replicate").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("weight"), 6).alias("mean_weight"))



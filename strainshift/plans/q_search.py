"""Queries of searches per replicate and per profile value."""

from __future__ import annotations

from pyspark.sql import functions as F

from strainshift.operators import mixed as X
from strainshift.operators import race as R
from strainshift.operators import regression as G
from strainshift.operators.resample import wild_replicates
from strainshift.operators.rows import cross_sweep
from strainshift.operators.windows import relative_to_reference
from strainshift.plans import views as V
from strainshift.plans.q_aggregates import OBS_SQL, expected_line, observations
from strainshift.plans.q_models import (BOOT_LAWS, BOOT_REPLICATES, DESIGN_TAIL_SQL, MODEL_DAYS_SQL, PROFILE_POINTS, SEARCH_BOXES, SWEEP_COLUMNS,
                                        centred_sql, design_rows, fit_sql, groups_sql, limits_sql)
from strainshift.plans.q_reshape import RESIDUALS_SQL, residuals, uniform_sql
from strainshift.plans.q_rows import REF
from strainshift.plans.registry import query
from strainshift.session import materialise


def race_sql(by: list[str], boxes: dict, expected: str, starts: int, keep: int, rounds: int, points: str, own: bool,
             fixed: str | None = None, near: str | None = None) -> str:
    """The same search without racing: ``keys`` and ``points`` are given, best{rounds} is the result."""
    k, names, parts = ", ".join(by), list(boxes), []
    match = near or " AND ".join(f"b.{c} = k.{c}" for c in by)
    for i in range(1, rounds + 1):
        if i == 1:
            spans = ", ".join(f"{lo}::DOUBLE AS {n}_0, {hi}::DOUBLE AS {n}_1" for n, (lo, hi) in boxes.items())
            parts.append(f"box1 AS (SELECT {k}, {spans} FROM keys)")
        else:
            spans = ", ".join(f"coalesce(min({n}), {lo}) AS {n}_0, coalesce(max({n}), {hi}) AS {n}_1" for n, (lo, hi) in boxes.items())
            parts.append(f"box{i} AS (SELECT {', '.join(f'k.{c}' for c in by)}, {spans} FROM keys k LEFT JOIN best{i - 1} b ON {match} GROUP BY ALL)")
        draw = {n: f"{n}_0 + ({n}_1 - {n}_0) * {uniform_sql(repr(f'1234-{i}'), *by, 'candidate', repr(n))}" for n in names}
        if fixed:
            draw = {n: fixed.format(name=n, draw=d, lo=boxes[n][0], hi=boxes[n][1]) for n, d in draw.items()}
        parts.append(f"start{i} AS MATERIALIZED (SELECT {k}, candidate, {', '.join(f'{d} AS {n}' for n, d in draw.items())} FROM box{i},"
                     f" (SELECT unnest(generate_series(1, {starts})) AS candidate))")
        join = f"JOIN {points} USING ({k})" if own else f", {points}"
        parts.append(f"loss{i} AS (SELECT {k}, candidate, {', '.join(names)}, value, floor_at, {expected} AS ex FROM start{i} {join})")
        parts.append(f"score{i} AS (SELECT {k}, {i} AS round, candidate, {', '.join(f'any_value({n}) AS {n}' for n in names)},"
                     f" CASE WHEN min(ex) > 0 THEN sum(power(value - ex, 2) / greatest(ex, floor_at)) END AS score FROM loss{i} GROUP BY {k}, candidate)")
        before = f" UNION ALL SELECT * FROM best{i - 1}" if i > 1 else ""
        parts.append(f"best{i} AS MATERIALIZED (SELECT * FROM (SELECT * FROM score{i} WHERE score IS NOT NULL{before})"
                     f" QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY score, round, candidate) <= {keep})")
    parts.append(f"top AS (SELECT * FROM best{rounds} QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY score, round, candidate) = 1)")
    return ", ".join(parts)


# --- every replicate refitted by its score ----------------------------------------------------

REFIT_STARTS, REFIT_KEEP, REFIT_ROUNDS = 32, 6, 4
REFIT_SQL = (
    f"{RESIDUALS_SQL}, base_of AS (SELECT series, avg(n) AS base, (SELECT min(day) FROM daily) AS first FROM daily GROUP BY 1)"
    ", three AS (SELECT series, day, expected, residual, base, date_diff('day', first, day) + 1 AS t FROM resid JOIN base_of USING (series)"
    " WHERE series IN ('view', 'click', 'error'))"
    f", reps AS (SELECT CAST(unnest(generate_series(1, {BOOT_REPLICATES})) AS INTEGER) AS replicate)"
    f", drawn AS (SELECT *, {uniform_sql('456', 'replicate', 'series', 'day')} AS u FROM three, reps)"
    ", stars AS (" + " UNION ALL ".join(f"SELECT '{law}' AS law, replicate, base, t, expected + residual * ({sql}) AS value FROM drawn" for law, sql in BOOT_LAWS.items())
    + "), points AS (SELECT *, greatest(0.001, min(value) OVER (PARTITION BY law, replicate)) AS floor_at FROM stars)"
    ", keys AS (SELECT DISTINCT law, replicate FROM points), "
    + race_sql(["law", "replicate"], SEARCH_BOXES, "base * (mu + eta * t)", REFIT_STARTS, REFIT_KEEP, REFIT_ROUNDS, "points", True))


def refits(spark, sf):
    """The best parameters of the line for every replicate of both laws, by score."""
    level = observations(spark, sf)
    names = {"view": "negative", "click": "positive", "error": "deaths"}
    series = F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), F.col("_series"))
    source = residuals(spark, sf).filter(F.col("series").isin(*names)).select(F.col("series").alias("_series"), "day", "expected", "residual")
    source = source.withColumn("series", series).join(level.select("series", "day", "t", "base"), ["series", "day"])
    source = source.drop("series").withColumnRenamed("_series", "series")
    drawn = wild_replicates(materialise(source), ["series", "day"], BOOT_REPLICATES, list(BOOT_LAWS), 456)
    drawn = materialise(drawn.select("law", "replicate", "series", "t", "base", "value"))
    keys = drawn.select("law", "replicate").distinct()
    best = R.race_search(keys, drawn, ["series", "t"], SEARCH_BOXES, expected_line, REFIT_STARTS, REFIT_KEEP, REFIT_ROUNDS)
    return R.best_of_each(keys, best, ["score", "mu", "eta"])


@query("wild_score_refit", f"""
    WITH {REFIT_SQL}
    SELECT law, replicate, CASE WHEN score IS NULL THEN 'No convergence' ELSE 'Successful completion' END AS convergence,
           round(mu, 6) AS mu, round(eta, 6) AS eta, round(score, 4) AS score FROM keys LEFT JOIN top USING (law, replicate)""")
def wild_score_refit(spark, sf):
    """Both parameters of the line searched on the score of every replicate of both laws; no finished start gives a row of NULLs."""
    fits = refits(spark, sf)
    return fits.select("law", "replicate", "convergence", F.round("mu", 6).alias("mu"), F.round("eta", 6).alias("eta"), F.round("score", 4).alias("score"))


# --- the second step over all pairs of the bootstrap -------------------------------------------

#: Stands in for the control parameters that a replicate's refit would give: k from the slope, a from the level.
PAIR_K, PAIR_A = "0.5 + 20 * eta", "mu"


@query("bootstrap_second_step", f"""
    WITH {REFIT_SQL}, {V.RETAINED_SQL}, {V.CONTROL_INDEX_SQL},
    params AS (SELECT law || '|' || replicate AS model_id, {PAIR_K} AS k, {PAIR_A} AS a FROM top),
    {MODEL_DAYS_SQL}, {DESIGN_TAIL_SQL}, {groups_sql('design')}, {centred_sql()}, {fit_sql()}, {limits_sql()},
    ends AS (SELECT model_id, {', '.join(f"max(CASE WHEN effect = '{e}' THEN {side} END) AS delta_{e}_{side}" for e in ('beta', 'gamma') for side in ('lower', 'upper'))}
    FROM lim GROUP BY 1)
    SELECT split_part(model_id, '|', 1) AS law, CAST(split_part(model_id, '|', 2) AS INTEGER) AS replicate, n_rows,
           {', '.join(f'round({c}, 3) AS {c}' for c in SWEEP_COLUMNS)} FROM fit JOIN ends USING (model_id)""")
def bootstrap_second_step(spark, sf):
    """Random-intercept fit with profile limits for the pair of every replicate of both laws; a replicate without a fit has no pair."""
    fits = refits(spark, sf).filter("score IS NOT NULL")
    pairs = fits.select(F.concat_ws("|", "law", F.col("replicate").cast("string")).alias("model_id"), F.expr(PAIR_K).alias("k"), F.expr(PAIR_A).alias("a"))
    groups = G.model_groups(design_rows(spark, sf, materialise(pairs)))
    out = X.selection_fit_profiled(X.selection_groups(groups, ["model_id"]), ["model_id"])
    name = F.split("model_id", "[|]")
    return out.select(name[0].alias("law"), name[1].cast("int").alias("replicate"), "n_rows", *[F.round(c, 3).alias(c) for c in SWEEP_COLUMNS])


# --- a search under every perturbation of the fixed parameters ---------------------------------

PERTURB_BOXES = {"mu": (0.5, 1.5), "control": (0.0, 1.0)}
PERTURB_STARTS, PERTURB_KEEP, PERTURB_ROUNDS = 500, 10, 3
_FIXED = {n: f"({v} * CASE WHEN fixed_parm = '{n}' THEN multiplier ELSE 1 END)" for n, v in REF.items()}
#: Growth while few are infected: the larger root of the linear part of the compartment model, at a constant control.
PERTURB_LINE = ("base * mu * exp(t * (sqrt(power({kappa} - {gamma}, 2) + 4 * {kappa} * {gamma} * {R0} * {SN0} * (1 - control)) - {kappa} - {gamma}) / 2)"
                .format(**_FIXED))


@query("perturbation_search", f"""
    WITH {OBS_SQL}, pts AS (SELECT series, t, value, base, (SELECT greatest(0.001, min(value)) FROM obs) AS floor_at FROM points),
    keys AS (SELECT fixed_parm, multiplier FROM (VALUES ('R0'), ('kappa'), ('gamma'), ('SN0')) AS p(fixed_parm),
        (VALUES (0.8::DOUBLE), (0.9::DOUBLE), (1.0::DOUBLE), (1.1::DOUBLE), (1.2::DOUBLE)) AS m(multiplier) WHERE NOT (fixed_parm = 'SN0' AND multiplier = 1.2)),
    {race_sql(["fixed_parm", "multiplier"], PERTURB_BOXES, PERTURB_LINE, PERTURB_STARTS, PERTURB_KEEP, PERTURB_ROUNDS, "pts", False)}
    SELECT fixed_parm, multiplier, CASE WHEN score IS NULL THEN 'No convergence' ELSE 'Successful completion' END AS convergence, round(mu, 6) AS mu,
           round(control, 6) AS control, round(score, 4) AS score,
           round(control / nullif(max(CASE WHEN multiplier = 1 THEN control END) OVER (PARTITION BY fixed_parm), 0) - 1, 6) AS control_var
    FROM keys LEFT JOIN top USING (fixed_parm, multiplier)""")
def perturbation_search(spark, sf):
    """500 starts searched under each of 19 settings of the fixed parameters, and the change of the control against the unperturbed setting."""
    one = spark.range(1).select(F.lit(1).alias("_one"))
    keys = cross_sweep(one, {n: F.lit(v) for n, v in REF.items()}, {"SN0": 1.0}).select("fixed_parm", "multiplier")
    obs = materialise(observations(spark, sf).select("series", "t", "value", "base"))
    best = R.race_search(keys, obs, ["series", "t"], PERTURB_BOXES, lambda: F.expr(PERTURB_LINE), PERTURB_STARTS, PERTURB_KEEP, PERTURB_ROUNDS)
    fits = R.best_of_each(keys, best, ["score", *PERTURB_BOXES]).withColumn("is_ref", F.col("multiplier") == 1)
    out = relative_to_reference(fits, ["fixed_parm"], "control", "is_ref", "control_var")
    return out.select("fixed_parm", "multiplier", "convergence", F.round("score", 4).alias("score"),
                      *[F.round(c, 6).alias(c) for c in ("mu", "control", "control_var")])


# --- eight profiles ---------------------------------------------------------------------------

#: A level and a slope for each series, and a bend and a weekly wave that all share.
PROFILE_BOXES = {"mu_negative": (0.5, 1.5), "mu_positive": (0.5, 1.5), "mu_deaths": (0.5, 1.5), "eta_negative": (-0.02, 0.02),
                 "eta_positive": (-0.02, 0.02), "eta_deaths": (-0.02, 0.02), "bend": (-0.0004, 0.0004), "wave": (-0.3, 0.3)}
PROFILE_STARTS, PROFILE_KEEP, PROFILE_ROUNDS = 24, 6, 4
_BY_SERIES = "CASE series WHEN 'negative' THEN {0}_negative WHEN 'positive' THEN {0}_positive ELSE {0}_deaths END"
PROFILE_LINE = f"base * ({_BY_SERIES.format('mu')} + ({_BY_SERIES.format('eta')}) * t + bend * t * t + wave * cos(2 * pi() * t / 7))"
PROFILES_SQL = (
    f"{OBS_SQL}, pts AS (SELECT series, t, value, base, (SELECT greatest(0.001, min(value)) FROM obs) AS floor_at FROM points)"
    f", keys AS (SELECT parm, g FROM (SELECT unnest([{', '.join(map(repr, PROFILE_BOXES))}]) AS parm),"
    f" (SELECT CAST(unnest(generate_series(0, {PROFILE_POINTS - 1})) AS INTEGER) AS g)), "
    + race_sql(["parm", "g"], PROFILE_BOXES, PROFILE_LINE, PROFILE_STARTS, PROFILE_KEEP, PROFILE_ROUNDS, "pts", False,
               f"CASE WHEN parm = '{{name}}' THEN {{lo}}::DOUBLE + ({{hi}}::DOUBLE - ({{lo}}::DOUBLE)) * g / {PROFILE_POINTS - 1} ELSE {{draw}} END",
               "b.parm = k.parm AND abs(b.g - k.g) <= 1"))


@query("profile_scan_searched", f"""
    WITH {PROFILES_SQL}
    SELECT parm, g, round(score, 4) AS wls FROM keys LEFT JOIN top USING (parm, g)""")
def profile_scan_searched(spark, sf):
    """Eight profiles of 100 values: at each value the other seven parameters are searched, from the best rows of the value and its neighbours."""
    last = PROFILE_POINTS - 1
    keys = spark.range(len(PROFILE_BOXES) * PROFILE_POINTS).select(
        F.element_at(F.lit(list(PROFILE_BOXES)), (F.floor(F.col("id") / PROFILE_POINTS) + 1).cast("int")).alias("parm"),
        (F.col("id") % PROFILE_POINTS).cast("int").alias("g"))
    fixed = {n: (lambda draw, n=n, lo=lo, hi=hi: F.when(F.col("parm") == n, lo + (F.lit(hi) - F.lit(lo)) * F.col("g") / last).otherwise(draw))
             for n, (lo, hi) in PROFILE_BOXES.items()}
    obs = materialise(observations(spark, sf).select("series", "t", "value", "base"))
    best = R.race_search(keys, obs, ["series", "t"], PROFILE_BOXES, lambda: F.expr(PROFILE_LINE), PROFILE_STARTS, PROFILE_KEEP, PROFILE_ROUNDS,
                         fixed=fixed, informs=lambda rows: R.neighbours(rows, "g", last))
    return R.best_of_each(keys, best, ["score"]).select("parm", "g", F.round("score", 4).alias("wls"))

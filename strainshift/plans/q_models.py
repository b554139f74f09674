"""Queries of regressions, tests, search, bootstrap and summaries."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import functions as F

from strainshift.functions import control as C
from strainshift.functions import labels as L
from strainshift.functions.tail import Z_975, chi2_upper_1
from strainshift.operators import mixed as X
from strainshift.operators import regression as G
from strainshift.operators import score as S
from strainshift.operators import summaries as M
from strainshift.operators import windows as O
from strainshift.operators.expand import expand_range
from strainshift.operators.resample import wild_replicates
from strainshift.operators.rows import cross_sweep
from strainshift.plans import views as V
from strainshift.plans.q_aggregates import OBS_SQL, candidates, expected_line, observations
from strainshift.plans.q_joins import week_control
from strainshift.plans.q_reshape import MAMMEN_SQL, uniform_sql
from strainshift.plans.q_rows import REF
from strainshift.plans.q_scalars import s_sql
from strainshift.plans.q_windows import MODEL_DAYS_SQL, RESIDUAL_SQL, selection_with_control
from strainshift.plans.registry import query
from strainshift.session import materialise

X1Z = ["x1", "z"]


def quadrature_sql(upper: str, integrand: str, n: int) -> str:
    """Simpson's rule from 0 to upper; the integrand is SQL in the angle {u}."""
    weight = f"(CASE WHEN i = 0 OR i = {n} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"
    return (f"(({upper}) / {3 * n} * list_sum(list_transform(range(0, {n + 1}), lambda i: {weight} * "
            + integrand.replace("{u}", f"(({upper}) * i / {n})") + ")))")


def share_sql(x: str, d1: str, d2: str, n: int = 2000) -> str:
    """I_x(d1 / 2, d2 / 2) as a ratio of integrals of sin^(d1 - 1) cos^(d2 - 1)."""
    f = f"pow(sin({{u}}), {d1} - 1) * pow(cos({{u}}), {d2} - 1)"
    return f"({quadrature_sql(f'asin(sqrt({x}))', f, n)} / {quadrature_sql('pi() / 2', f, n)})"


def t_sql(t: str, df: str, n: int = 2000) -> str:
    return f"CASE WHEN {df} > 0 THEN {share_sql(f'{df} / ({df} + {t} * {t})', df, '1', n)} END"


def f_sql(f: str, d1: str, d2: str) -> str:
    return f"CASE WHEN {d1} > 0 AND {d2} > 0 AND {f} >= 0 THEN {share_sql(f'{d2} / ({d2} + {d1} * {f})', d2, d1)} END"


def chi2_sql(x: str, n: int = 2000) -> str:
    return f"({quadrature_sql('pi() / 2', f'exp(-({x}) / (2 * greatest(pow(sin({{u}}), 2), 1e-300)))', n)} * 2 / pi())"


def signif_sql(p: str, digits: int = 3) -> str:
    scale = f"pow(10, {digits - 1} - floor(log10(abs({p}))))"
    return f"CASE WHEN {p} = 0 THEN 0 ELSE round({p} * {scale}, 0) / {scale} END"


def code_sql(p: str) -> str:
    cuts = " ".join(f"WHEN {p} <= {cut} THEN '{code}'" for cut, code in L.SIGNIFICANCE_CODES)
    return f"CASE WHEN {p} > 0 THEN CASE {cuts} END END"


# --- designs -----------------------------------------------------------------

def design_rows(spark, sf, models):
    panel = materialise(V.retained_panel(spark, sf))
    return G.logit_regressors(models, panel, V.control_index(spark, sf))


def part_models(spark, sf):
    return V.model_params(spark, sf).select("model_id", "k", "a")


def brand_models(spark, sf):
    """The best converged parameters of every brand."""
    fits = V.model_params(spark, sf).select("brand", "model_id", "value", "code", "k", "a")
    return S.best_candidate(fits, ["brand"], "value", "model_id", F.col("code") == 0).select("brand", "k", "a")


def design_groups(spark, sf, models):
    """Group sums of the design of all models, from its nested form."""
    panel = materialise(V.retained_panel(spark, sf))
    return G.model_groups(G.logit_regressors(models, panel, V.control_index(spark, sf), nested=True), panel=panel)


def part_groups(spark, sf):
    return design_groups(spark, sf, part_models(spark, sf))


DESIGN_TAIL_SQL = (
    "pts AS (SELECT DISTINCT t FROM retained), st AS (SELECT region, min(t) AS t0 FROM retained GROUP BY 1)"
    ", ptab AS (SELECT model_id, t, p1 + (t - floor(t)) * f1 AS i1, p2 + (t - floor(t)) * f2 AS i2 FROM pre JOIN pts ON day_idx = floor(t))"
    ", rhos AS (SELECT model_id, coalesce(-0.5::DOUBLE * (0.1::DOUBLE * i2 + t) / nullif(0.15::DOUBLE * i1, 0), 0) AS rho FROM ptab WHERE t = (SELECT max(t) FROM pts))"
    ", raw_design AS (SELECT e.model_id, r.region, r.t, r.y, 0.15::DOUBLE * (e.i1 - s.i1) AS x1,"
    " -0.5::DOUBLE * (0.1::DOUBLE * (e.i2 - s.i2) + r.t - st.t0) AS x2"
    " FROM retained r JOIN st USING (region) JOIN ptab e ON e.t = r.t JOIN ptab s ON s.t = st.t0 AND s.model_id = e.model_id)"
    ", design AS (SELECT *, x2 - rho * x1 AS z FROM raw_design JOIN rhos USING (model_id))")
DESIGN_SQL = f"{V.RETAINED_SQL}, {V.CONTROL_INDEX_SQL}, {V.PARAMS_SQL}, {MODEL_DAYS_SQL}, {DESIGN_TAIL_SQL}"


def groups_sql(source: str, by: str = "model_id", x: list[str] = X1Z, y: str = "y", name: str = "g") -> str:
    cols = [*x, y]
    parts = [f"avg({c}) AS m_{c}" for c in cols] + (["any_value(rho) AS rho"] if "z" in x else [])
    parts += [f"covar_pop({a}, {b}) * COUNT(*) AS c_{a}_{b}" for a, b in combinations_with_replacement(cols, 2)]
    return f"{name} AS (SELECT {by}, region, COUNT(*) AS n, {', '.join(parts)} FROM {source} GROUP BY {by}, region)"


def _t_series() -> str:
    """97.5 % point of Student's t by its series in 1/df, exact to rounding for the df at hand."""
    z = 1.959963984540054
    terms = ((z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96,
             (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
             (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160)
    return f"({z!r}::DOUBLE" + "".join(f" + {t!r}::DOUBLE / power(df, {i})" for i, t in enumerate(terms, 1)) + ")"


T_SQL = _t_series()


def ancova_sql(by: str = "model_id", g: str = "g", name: str = "ancova") -> str:
    cols = [*X1Z, "y"]
    sums = ", ".join(f"sum(c_{a}_{b}) AS c_{a}_{b}" for a, b in combinations_with_replacement(cols, 2))
    return (
        f"{name}_s AS (SELECT {by}, sum(n) AS n, COUNT(*) AS n_groups, any_value(rho) AS rho, {sums} FROM {g} GROUP BY {by})"
        f", {name}_q AS (SELECT *, c_z_z + 2 * rho * c_x1_z + rho * rho * c_x1_x1 AS c_x2_x2, c_x1_x1 * c_z_z - c_x1_z * c_x1_z AS full_det FROM {name}_s)"
        f", {name}_d AS (SELECT *, n - n_groups - 2 AS df, coalesce(full_det / nullif(c_x1_x1 * c_x2_x2, 0) < 1e-12, TRUE) AS rank_deficient FROM {name}_q)"
        f", {name}_e AS (SELECT *, CASE WHEN NOT rank_deficient THEN full_det END AS det FROM {name}_d)"
        f", {name}_b AS (SELECT *, (c_z_z * c_x1_y - c_x1_z * c_z_y) / det AS b1, (c_x1_x1 * c_z_y - c_x1_z * c_x1_y) / det AS delta_gamma FROM {name}_e)"
        f", {name}_r AS (SELECT *, b1 - rho * delta_gamma AS delta_beta, c_y_y - b1 * c_x1_y - delta_gamma * c_z_y AS rss FROM {name}_b)"
        f", {name} AS (SELECT *, sqrt(rss / df * c_x2_x2 / det) AS se_beta, sqrt(rss / df * c_x1_x1 / det) AS se_gamma FROM {name}_r)")


@query("logit_regressors", f"""
    WITH {DESIGN_SQL}
    SELECT model_id, region, COUNT(*) AS n, round(avg(x1), 4) AS x1_mean, round(avg(x2), 4) AS x2_mean,
           round(max(x1), 4) AS x1_last, round(min(x2), 4) AS x2_last, round(avg(x1 * y), 4) AS x1_y FROM design GROUP BY 1, 2""")
def logit_regressors(spark, sf):
    """Regressors of all models, summed up per model and region for the comparison."""
    rows = design_rows(spark, sf, part_models(spark, sf))
    return rows.groupBy("model_id", "region").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("x1"), 4).alias("x1_mean"), F.round(F.avg("x2"), 4).alias("x2_mean"),
        F.round(F.max("x1"), 4).alias("x1_last"), F.round(F.min("x2"), 4).alias("x2_last"),
        F.round(F.avg(F.col("x1") * F.col("y")), 4).alias("x1_y"))


ANCOVA_COLUMNS = ["delta_beta", "delta_gamma", "se_beta", "se_gamma", "rss"]


@query("ancova_fit", f"""
    WITH {DESIGN_SQL}, {groups_sql('design')}, {ancova_sql()}
    SELECT model_id, n, n_groups, df, rank_deficient, {', '.join(f'round({c}, 4) AS {c}' for c in ANCOVA_COLUMNS)},
           round(delta_beta - {T_SQL} * se_beta, 4) AS delta_beta_lower, round(delta_beta + {T_SQL} * se_beta, 4) AS delta_beta_upper,
           round(delta_gamma - {T_SQL} * se_gamma, 4) AS delta_gamma_lower, round(delta_gamma + {T_SQL} * se_gamma, 4) AS delta_gamma_upper
    FROM ancova""")
def ancova_fit(spark, sf):
    fits = G.ancova_fit(part_groups(spark, sf), ["model_id"])
    return fits.withColumns({c: F.round(c, 4) for c, t in fits.dtypes if t == "double"})


@query("ancova_effects", f"""
    WITH {DESIGN_SQL}, {groups_sql('design')}, {ancova_sql()},
    lev AS (SELECT model_id, region, m_y - delta_beta * m_x1 - delta_gamma * (m_z + g.rho * m_x1) AS intercept FROM g JOIN ancova USING (model_id))
    SELECT model_id, region, round(intercept, 4) AS intercept,
           round(intercept - first_value(intercept) OVER (PARTITION BY model_id ORDER BY region), 4) AS effect FROM lev""")
def ancova_effects(spark, sf):
    """Region levels of every model, and their differences to the first region by name."""
    groups = materialise(part_groups(spark, sf))
    levels = G.ancova_intercepts(groups, G.ancova_fit(groups, ["model_id"]), ["model_id"], "region")
    return levels.select("model_id", "region", F.round("intercept", 4).alias("intercept"), F.round("effect", 4).alias("effect"))


@query("rank_deficiency_guard", f"""
    WITH {V.RETAINED_SQL}, {V.CONTROL_INDEX_SQL}, {V.PARAMS_SQL.replace('params AS', 'raw AS')},
    params AS (SELECT model_id, a, CASE WHEN code = 10 THEN 0.0 ELSE k END::DOUBLE AS k FROM raw),
    {MODEL_DAYS_SQL}, {DESIGN_TAIL_SQL}, {groups_sql('design')}, {ancova_sql()}
    SELECT model_id, rank_deficient, delta_beta IS NULL AS no_estimate FROM ancova""")
def rank_deficiency_guard(spark, sf):
    """Without control both integrals are straight lines in time: such models get no estimates."""
    k = F.when(F.col("code") == 10, 0.0).otherwise(F.col("k"))
    models = V.model_params(spark, sf).select("model_id", k.alias("k"), "a")
    groups = design_groups(spark, sf, models)
    return G.ancova_fit(groups, ["model_id"]).select(
        "model_id", "rank_deficient", F.col("delta_beta").isNull().alias("no_estimate"))


# --- random intercept ----------------------------------------------------------

def centred_sql(by: str = "model_id", g: str = "g", name: str = "cg") -> str:
    cols = [*X1Z, "y"]
    parts = [f"m_{c} - sum(n * m_{c}) OVER w / sum(n) OVER w AS d_{c}" for c in cols]
    parts += [f"sum(c_{a}_{b}) OVER w AS w_{a}_{b}" for a, b in combinations_with_replacement(cols, 2)]
    return (f"{name}_0 AS (SELECT {by}, region, n, rho, sum(n) OVER w AS n_rows, {', '.join(f'm_{c}' for c in cols)}, {', '.join(parts)}"
            f" FROM {g} WINDOW w AS (PARTITION BY {by}))"
            f", {name} AS (SELECT *, m_z + rho * m_x1 AS m_x2, d_z + rho * d_x1 AS d_x2, w_z_y + rho * w_x1_y AS w_x2_y,"
            f" w_z_z + 2 * rho * w_x1_z + rho * rho * w_x1_x1 AS w_x2_x2 FROM {name}_0)")


def evaluate_sql(source: str, name: str, x: list[str], reml: bool, by: str = "model_id") -> str:
    cols = [*x, "y"]
    pairs = list(combinations_with_replacement(cols, 2))
    sums = [f"sum(v * d_{c}) AS s_{c}" for c in cols] + [f"sum(v * d_{a} * d_{b}) AS s_{a}_{b}" for a, b in pairs]
    sums += [f"any_value(w_{a}_{b}) AS w_{a}_{b}" for a, b in pairs]
    sums += ["sum(v * v) AS tv"] + [f"sum(v * v * d_{c}) AS t_{c}" for c in cols] + [f"sum(v * v * d_{a} * d_{b}) AS t_{a}_{b}" for a, b in pairs]
    full = ", ".join([f"w_{a}_{b} + s_{a}_{b} - s_{a} * s_{b} / sv AS a_{a}_{b}" for a, b in pairs]
                     + [f"(t_{a} * s_{b} + s_{a} * t_{b}) / sv - t_{a}_{b} - s_{a} * s_{b} * tv / (sv * sv) AS h_{a}_{b}" for a, b in pairs])
    dq = "h_y_y" + "".join(f" - 2 * b_{c} * h_{c}_y" for c in x) + "".join(
        f" + {1 if a == b else 2} * b_{a} * b_{b} * h_{a}_{b}" for a, b in combinations_with_replacement(x, 2))
    trace = (f"h_{x[0]}_{x[0]} / det" if len(x) == 1 else
             f"(a_{x[1]}_{x[1]} * h_{x[0]}_{x[0]} - 2 * a_{x[0]}_{x[1]} * h_{x[0]}_{x[1]} + a_{x[0]}_{x[0]} * h_{x[1]}_{x[1]}) / det")
    if len(x) == 1:
        (p,) = x
        solve = f"a_{p}_{p} AS det, a_{p}_y / nullif(a_{p}_{p}, 0) AS b_{p}, a_y_y - a_{p}_y * a_{p}_y / nullif(a_{p}_{p}, 0) AS q, 1 / nullif(a_{p}_{p}, 0) AS i_{p}"
        inner = f"{name}_2 AS (SELECT *, {solve} FROM {name}_1)"
    else:
        p, q = x
        inner = (f"{name}_d AS (SELECT *, CASE WHEN (a_{p}_{p} * a_{q}_{q} - a_{p}_{q} * a_{p}_{q}) / nullif(a_{p}_{p} * a_{q}_{q}, 0) >= 1e-12"
                 f" THEN a_{p}_{p} * a_{q}_{q} - a_{p}_{q} * a_{p}_{q} END AS det FROM {name}_1)"
                 f", {name}_b AS (SELECT *, (a_{q}_{q} * a_{p}_y - a_{p}_{q} * a_{q}_y) / det AS b_{p}, (a_{p}_{p} * a_{q}_y - a_{p}_{q} * a_{p}_y) / det AS b_{q},"
                 f" a_{q}_{q} / det AS i_{p}, a_{p}_{p} / det AS i_{q}, -a_{p}_{q} / det AS i_cross FROM {name}_d)"
                 f", {name}_2 AS (SELECT *, a_y_y - b_{p} * a_{p}_y - b_{q} * a_{q}_y AS q FROM {name}_b)")
    free = f"(n_rows - {len(x) + 1})::DOUBLE" if reml else "n_rows::DOUBLE"
    extra = " + ln(sv) + ln(det)" if reml else ""
    level = "s_y / sv" + "".join(f" - b_{c} * s_{c} / sv" for c in x)
    inverse = [*x, "cross"] if len(x) == 2 else x
    return (
        f"{name}_0 AS (SELECT {by}, lam, sum(v) AS sv, sum(ln(1 + n * lam)) AS slog, any_value(n_rows) AS n_rows, COUNT(*) AS n_groups, {', '.join(sums)}"
        f" FROM (SELECT *, n / (1 + n * lam) AS v FROM {source}) GROUP BY {by}, lam)"
        f", {name}_1 AS (SELECT *, {full} FROM {name}_0), {inner}"
        f", {name} AS (SELECT {by}, lam, n_rows, n_groups, {free} * ln(2 * pi() * q / {free}) + {free} + slog{extra} AS deviance, q / {free} AS sigma2,"
        f" {free} * ({dq}) / q + sv{f' - tv / sv + {trace}' if reml else ''} AS slope, {level} AS level, {', '.join(f'b_{c}' for c in x)}, {', '.join(f'q / {free} * i_{c} AS var_{c}' for c in inverse)}"
        f" FROM {name}_2 WHERE q > 0)")


POINTS = 32


def coarse_sql(name: str, x: list[str], reml: bool, by: str, cg: str) -> str:
    """The likelihood on the grid, as {name}_ce."""
    grid = ", ".join(f"({v!r}::DOUBLE)" for v in X.COARSE)
    return f"{name}_grid(lam) AS (VALUES {grid}), {name}_c AS (SELECT * FROM {cg}, {name}_grid), " + evaluate_sql(f"{name}_c", f"{name}_ce", x, reml, by)


def bracket_sql(name: str, source: str, value: str, by: str) -> str:
    """{name}: the grid's neighbours of the least value."""
    lam = "[" + ", ".join(f"{v!r}::DOUBLE" for v in X.COARSE) + "]"
    return (f"{name}_i AS (SELECT {by}, list_position({lam}, arg_min(lam, ({value}, lam))) AS i FROM {source} WHERE {value} IS NOT NULL GROUP BY ALL)"
            f", {name} AS MATERIALIZED (SELECT {by}, {lam}[greatest(i - 1, 1)] AS lo, {lam}[least(i + 1, {len(X.COARSE)})] AS hi FROM {name}_i)")


def zoom_sql(name: str, r: int, x: list[str], reml: bool, by: str, cg: str, pick: str, on: str = "", extra: str = "") -> str:
    """Round r: POINTS steps inside the bracket {name}_{r - 1}, and the next bracket beside the one that is picked."""
    e = f"{name}_e{r}"
    first, last = ("k", "k + 1") if "slope" in pick else ("greatest(k - 1, 0)", f"least(k + 1, {POINTS})")
    return (f"{name}_p{r} AS (SELECT {cg}.*{extra}, step, lo + (hi - lo) * step / {POINTS} AS lam FROM {cg} JOIN {name}_{r - 1} b USING (model_id){on},"
            f" (SELECT CAST(unnest(generate_series(0, {POINTS})) AS INTEGER) AS step)), "
            + evaluate_sql(f"{name}_p{r}", e, x, reml, f"{by}, step")
            + f", {name}_k{r} AS ({pick.format(e=e)})"
            f", {name}_{r} AS MATERIALIZED (SELECT {by}, lo + (hi - lo) * ({first}) / {POINTS} AS lo, lo + (hi - lo) * ({last}) / {POINTS} AS hi, {name}_k{r}.best"
            f" FROM {name}_k{r} JOIN {name}_{r - 1} USING ({by}))")


def lambda_sql(name: str, x: list[str], reml: bool, by: str = "model_id", cg: str = "cg") -> str:
    """Grid, then finer and finer steps: to the change of sign of the slope (REML), or about the least deviance (ML)."""
    slope = f"SELECT {by}, coalesce(max(step) FILTER (WHERE NOT slope > 0 AND step < {POINTS}), 0) AS k, NULL::DOUBLE AS best FROM {{e}} GROUP BY ALL"
    least = f"SELECT {by}, arg_min(step, (deviance, step)) AS k, min(deviance) AS best FROM {{e}} GROUP BY {by}"
    rounds = 10 if reml else 6
    out = f"{coarse_sql(name, x, reml, by, cg)}, {bracket_sql(f'{name}_0', f'{name}_ce', 'deviance', by)}, "
    out += ", ".join(zoom_sql(name, r, x, reml, by, cg, slope if reml else least) for r in range(1, rounds + 1))
    return out + f", {name} AS (SELECT {by}, CASE WHEN lo > 0 THEN (lo + hi) / 2 ELSE lo END AS lam, best AS low FROM {name}_{rounds})"


def limits_sql(name: str = "lim") -> str:
    """Profile limits: the outermost end, over all lambda, of the effects that keep the deviance below the level."""
    sides = ", ".join(f"('{e}', '{side}', {sign})" for e in ("beta", "gamma") for side, sign in (("lower", -1), ("upper", 1)))
    est = "CASE WHEN effect = 'beta' THEN b_x1 - rho * b_z ELSE b_z END"
    var = "CASE WHEN effect = 'beta' THEN var_x1 - 2 * rho * var_cross + rho * rho * var_z ELSE var_z END"
    reach = (f"CASE WHEN deviance <= bar THEN -sign * ({est}) - sqrt(({var}) * n_rows * (exp((bar - deviance) / n_rows) - 1))"
             " ELSE 1e30 * (deviance - bar) END AS reach")
    pick = (f"SELECT model_id, effect, side, arg_min(step, (reach, step)) AS k, min(reach) AS best FROM (SELECT e.*, {reach} FROM {{e}} e"
            " JOIN lim_level USING (model_id) JOIN lim_v USING (effect, side)) GROUP BY 1, 2, 3")
    by, rounds = "model_id, effect, side", 6
    return (f"{lambda_sql('lim_full', X1Z, False)}, lim_v(effect, side, sign) AS (VALUES {sides})"
            f", lim_level AS (SELECT model_id, low + {Z_975!r} * {Z_975!r} AS bar, any_value(rho) AS rho FROM lim_full JOIN cg USING (model_id) GROUP BY 1, 2)"
            f", lim_c AS (SELECT c.*, effect, side, {reach} FROM lim_full_ce c JOIN lim_level USING (model_id), lim_v)"
            f", {bracket_sql(f'{name}_0', 'lim_c', 'reach', by)}, "
            + ", ".join(zoom_sql(name, r, X1Z, False, by, "cg", pick, extra=", effect, side") for r in range(1, rounds + 1))
            + f", {name} AS (SELECT model_id, effect, max(CASE WHEN side = 'lower' THEN best END) AS lower, max(CASE WHEN side = 'upper' THEN -best END) AS upper"
            f" FROM {name}_{rounds} GROUP BY 1, 2)")


def fit_sql(name: str = "fit", by: str = "model_id") -> str:
    return (lambda_sql(f"{name}_lam", X1Z, True, by) + f", {name}_src AS (SELECT cg.*, lam FROM cg JOIN {name}_lam USING ({by})), "
            + evaluate_sql(f"{name}_src", f"{name}_raw", X1Z, True, by)
            + f", {name}_rho AS (SELECT {by}, any_value(rho) AS rho FROM cg GROUP BY 1)"
            f", {name} AS (SELECT *, b_x1 - rho * b_z AS delta_beta, b_z AS delta_gamma, sqrt(var_z) AS se_gamma,"
            f" sqrt(var_x1 - 2 * rho * var_cross + rho * rho * var_z) AS se_beta FROM {name}_raw JOIN {name}_rho USING ({by}))")


MIXED_COLUMNS = {"delta_beta": 4, "delta_gamma": 4, "se_beta": 4, "se_gamma": 4, "sigma2": 6, "deviance": 4}
RSS_SQL = (
    "eff AS (SELECT cg.*, fit.lam, level, b_x1, b_z, d_y - level - b_x1 * d_x1 - b_z * d_z AS gap FROM cg JOIN fit USING (model_id))"
    ", rss AS (SELECT model_id, any_value(w_y_y - 2 * b_x1 * w_x1_y + b_x1 * b_x1 * w_x1_x1 - 2 * b_z * w_z_y + b_z * b_z * w_z_z + 2 * b_x1 * b_z * w_x1_z)"
    " + sum(n * power(gap / (1 + n * lam), 2)) AS rss FROM eff GROUP BY 1)")


def centred(groups, by=("model_id",)):
    return materialise(X.selection_groups(groups, list(by)))


def mixed_fits(rows, by=("model_id",)):
    """Fits with the residual sum of squares of their fitted values."""
    by = list(by)
    fits = materialise(X.selection_fit(rows, by))
    rss = X.mixed_rss(X.group_effects(rows, fits, by, X1Z, "y"), by, X1Z, "y")
    return fits.join(rss, by)


@query("random_intercept_fit", f"""
    WITH {DESIGN_SQL}, {groups_sql('design')}, {centred_sql()}, {fit_sql()}, {RSS_SQL}
    SELECT model_id, n_rows, n_groups, {', '.join(f'round({c}, {d}) AS {c}' for c, d in MIXED_COLUMNS.items())},
           round(delta_beta - 1.959963984540054 * se_beta, 4) AS delta_beta_lower, round(delta_gamma + 1.959963984540054 * se_gamma, 4) AS delta_gamma_upper,
           round(lam, 5) AS lam, round(rss, 4) AS rss FROM fit JOIN rss USING (model_id)""")
def random_intercept_fit(spark, sf):
    fits = mixed_fits(centred(part_groups(spark, sf)))
    return fits.select("model_id", "n_rows", "n_groups", *[F.round(c, d).alias(c) for c, d in MIXED_COLUMNS.items()],
                       F.round("delta_beta_lower", 4).alias("delta_beta_lower"), F.round("delta_gamma_upper", 4).alias("delta_gamma_upper"),
                       F.round("lam", 5).alias("lam"), F.round("rss", 4).alias("rss"))


@query("random_intercept_effects", f"""
    WITH {DESIGN_SQL}, {groups_sql('design')}, {centred_sql()}, {fit_sql()}, {RSS_SQL}
    SELECT model_id, region, round(n * lam / (1 + n * lam) * gap, 5) AS effect,
           round(m_y - d_y + level - b_x1 * (m_x1 - d_x1) - b_z * (m_z - d_z) + n * lam / (1 + n * lam) * gap, 4) AS intercept FROM eff""")
def random_intercept_effects(spark, sf):
    """Predicted region effects of every model; fitted values start from ``intercept``."""
    rows = centred(part_groups(spark, sf))
    fits = materialise(X.selection_fit(rows, ["model_id"]))
    eff = X.group_effects(rows, fits, ["model_id"], X1Z, "y")
    return eff.select("model_id", "region", F.round("effect", 5).alias("effect"), F.round("intercept", 4).alias("intercept"))


@query("nested_lrt", f"""
    WITH {DESIGN_SQL}, {groups_sql('design')}, {centred_sql()}, {lambda_sql('full_ml', X1Z, False)},
    {lambda_sql('only_x2', ['x2'], False)}, {lambda_sql('only_x1', ['x1'], False)},
    both_tests AS (SELECT r.model_id, 'x1' AS dropped, greatest(r.low - f.low, 0) AS chi2 FROM only_x2 r JOIN full_ml f USING (model_id)
    UNION ALL SELECT r.model_id, 'x2', greatest(r.low - f.low, 0) FROM only_x1 r JOIN full_ml f USING (model_id))
    SELECT model_id, dropped, round(chi2, 4) AS chi2, round(""" + chi2_sql("round(chi2, 4)") + """, 4) AS p, CASE WHEN chi2 > 10.827566170662733 THEN 'p < 0.001 (***)' WHEN chi2 > 6.634896601021213
           THEN '0.001 < p < 0.01 (**)' WHEN chi2 > 3.841458820694124 THEN '0.01 < p < 0.05 (*)' ELSE 'p > 0.05 ( )' END AS signif FROM both_tests""")
def nested_lrt(spark, sf):
    tests = X.selection_lrt(centred(part_groups(spark, sf)), ["model_id"])
    chi2 = F.round("chi2", 4)  # p of the statistic as it is shown
    return tests.select("model_id", "dropped", chi2.alias("chi2"), F.round(chi2_upper_1(chi2), 4).alias("p"), "signif")


# --- sweeps ----------------------------------------------------------------------

DIRECT = {"kappa": C.KAPPA, "beta_w": C.BETA_W, "gamma_w": C.GAMMA_W, "sn": C.SUSCEPTIBLE}


def sweep_models(spark, sf):
    """Per brand: 20 direct perturbations and 19 that come from the first step.

    In the propagated ones k and a stand for re-estimates under the perturbation,
    beta_w follows R0 only, and the susceptible share is floored to a multiple of 0.05.
    """
    brands = brand_models(spark, sf)
    direct = cross_sweep(brands, {n: F.lit(v) for n, v in DIRECT.items()}, {}).withColumn("kind", F.lit("direct"))
    first = cross_sweep(brands, {n: F.lit(v) for n, v in REF.items()}, {"SN0": 1.0})
    m = F.col("multiplier")
    propagated = first.select(
        "brand", (F.col("k") * F.least(m, F.lit(1.0))).alias("k"), (F.col("a") * m).alias("a"), "fixed_parm", "multiplier",
        "kappa", F.when(F.col("fixed_parm") == "R0", F.col("R0") * C.GAMMA_W).otherwise(C.BETA_W).alias("beta_w"),
        F.col("gamma").alias("gamma_w"), L.floor_to(F.col("SN0") * 0.83, 0.05).alias("sn"),
        F.lit("propagated").alias("kind"))
    both = direct.unionByName(propagated)
    name = F.concat_ws("|", "kind", "brand", "fixed_parm", F.format_string("%.1f", "multiplier"))
    return both.withColumn("model_id", name).select("model_id", "k", "a", *DIRECT)


SWEEP_MODELS_SQL = (
    V.PARAMS_SQL.replace("params AS", "raw AS") +
    ", brands AS (SELECT brand, arg_min(model_id, (value, model_id)) AS model_id FROM raw WHERE code = 0 GROUP BY 1)"
    ", bp AS (SELECT raw.brand, k, a FROM raw JOIN brands USING (model_id))"
    ", mult(m, lab) AS (VALUES (0.8::DOUBLE, '0.8'), (0.9::DOUBLE, '0.9'), (1.0::DOUBLE, '1.0'), (1.1::DOUBLE, '1.1'), (1.2::DOUBLE, '1.2'))"
    ", dn(p) AS (VALUES ('kappa'), ('beta_w'), ('gamma_w'), ('sn')), pn(p) AS (VALUES ('R0'), ('kappa'), ('gamma'), ('SN0'))"
    ", params AS (SELECT 'direct|' || brand || '|' || p || '|' || lab AS model_id, k, a, 0.2::DOUBLE * CASE WHEN p = 'kappa' THEN m ELSE 1 END AS kappa,"
    " 0.25::DOUBLE * CASE WHEN p = 'beta_w' THEN m ELSE 1 END AS beta_w, 0.1::DOUBLE * CASE WHEN p = 'gamma_w' THEN m ELSE 1 END AS gamma_w,"
    " 0.75::DOUBLE * CASE WHEN p = 'sn' THEN m ELSE 1 END AS sn FROM bp, dn, mult"
    " UNION ALL SELECT 'propagated|' || brand || '|' || p || '|' || lab, k * least(m, 1), a * m, 0.2::DOUBLE * CASE WHEN p = 'kappa' THEN m ELSE 1 END,"
    " CASE WHEN p = 'R0' THEN 2.5::DOUBLE * m * 0.1 ELSE 0.25 END, 0.1::DOUBLE * CASE WHEN p = 'gamma' THEN m ELSE 1 END,"
    " floor(0.9::DOUBLE * CASE WHEN p = 'SN0' THEN m ELSE 1 END * 0.83::DOUBLE / 0.05::DOUBLE) * 0.05::DOUBLE FROM bp, pn, mult WHERE NOT (p = 'SN0' AND m > 1.15))")
SWEEP_DESIGN_SQL = (
    f"{V.RETAINED_SQL}, {V.CONTROL_INDEX_SQL}, {SWEEP_MODELS_SQL}"
    ", f AS (SELECT params.*, day_idx, coalesce(k * pow(psi / 100, a), 0) AS c FROM params, control_idx)"
    ", h AS (SELECT *, sqrt(power(kappa - gamma_w, 2) + 4 * kappa * (1 - c) * beta_w * sn) AS root FROM f)"
    ", pre AS (SELECT model_id, day_idx, (1 - c) / root AS f1, 1 / root AS f2,"
    " coalesce(sum((1 - c) / root) OVER w, 0) AS p1, coalesce(sum(1 / root) OVER w, 0) AS p2 FROM h"
    " WINDOW w AS (PARTITION BY model_id ORDER BY day_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"
    ", pts AS (SELECT DISTINCT t FROM retained), st AS (SELECT region, min(t) AS t0 FROM retained GROUP BY 1)"
    ", ptab AS (SELECT model_id, t, p1 + (t - floor(t)) * f1 AS i1, p2 + (t - floor(t)) * f2 AS i2 FROM pre JOIN pts ON day_idx = floor(t))"
    ", rhos AS (SELECT model_id, coalesce(-0.5::DOUBLE * ((kappa - gamma_w) * i2 + t) / nullif(kappa * sn * i1, 0), 0) AS rho"
    " FROM ptab JOIN params USING (model_id) WHERE t = (SELECT max(t) FROM pts))"
    ", raw_design AS (SELECT e.model_id, r.region, r.t, r.y, kappa * sn * (e.i1 - s.i1) AS x1,"
    " -0.5::DOUBLE * ((kappa - gamma_w) * (e.i2 - s.i2) + r.t - st.t0) AS x2"
    " FROM retained r JOIN st USING (region) JOIN ptab e ON e.t = r.t JOIN ptab s ON s.t = st.t0 AND s.model_id = e.model_id JOIN params ON params.model_id = e.model_id)"
    ", design AS (SELECT *, x2 - rho * x1 AS z FROM raw_design JOIN rhos USING (model_id))")


SWEEP_COLUMNS = [f"delta_{e}{end}" for end in ("", "_lower", "_upper") for e in ("beta", "gamma")] + ["se_beta", "se_gamma"]


@query("many_model_sweep", f"""
    WITH {SWEEP_DESIGN_SQL}, {groups_sql('design')}, {centred_sql()}, {fit_sql()}, {limits_sql()},
    ends AS (SELECT model_id, {', '.join(f"max(CASE WHEN effect = '{e}' THEN {side} END) AS delta_{e}_{side}" for e in ('beta', 'gamma') for side in ('lower', 'upper'))}
    FROM lim GROUP BY 1)
    SELECT model_id, n_rows, {', '.join(f'round({c}, 4) AS {c}' for c in SWEEP_COLUMNS)} FROM fit JOIN ends USING (model_id)""")
def many_model_sweep(spark, sf):
    """All models of the sweep by REML, with profile limits."""
    groups = design_groups(spark, sf, sweep_models(spark, sf))
    fits = X.selection_fit_profiled(X.selection_groups(groups, ["model_id"]), ["model_id"])
    return fits.select("model_id", "n_rows", *[F.round(c, 4).alias(c) for c in SWEEP_COLUMNS])


PROFILE_DESIGN_SQL = (
    f"{V.RETAINED_SQL}, {V.CONTROL_INDEX_SQL}, {V.PARAMS_SQL.replace('params AS', 'raw AS')}"
    ", params AS (SELECT brand AS model_id, arg_min(k, (value, model_id)) AS k, arg_min(a, (value, model_id)) AS a FROM raw WHERE code = 0 GROUP BY brand)"
    f", {MODEL_DAYS_SQL}, {DESIGN_TAIL_SQL}")
PROFILE_TAIL_SQL = (
    f"{groups_sql('design')}, {centred_sql()}, {limits_sql()}"
    " SELECT model_id, effect, round(lower, 3) AS lower, round(upper, 3) AS upper, 'profile' AS ci_method,"
    " CASE WHEN lower IS NULL OR upper IS NULL THEN 'no fit' ELSE 'bracketed' END AS status FROM lim")


PROFILE_SQL = f"WITH {PROFILE_DESIGN_SQL}, {PROFILE_TAIL_SQL}"


def profiled(spark, sf, models, digits=3):
    groups = design_groups(spark, sf, models)
    limits = X.profile_limits(X.selection_groups(groups, ["model_id"]), ["model_id"])
    return limits.withColumns({c: F.round(c, digits) for c in ("lower", "upper")})


@query("random_intercept_profile_ci", PROFILE_SQL)
def random_intercept_profile_ci(spark, sf):
    """Profile-likelihood limits of both slopes for the best parameters of each brand."""
    return profiled(spark, sf, brand_models(spark, sf).withColumnRenamed("brand", "model_id"))


@query("part_profile_ci", f"WITH {DESIGN_SQL}, {PROFILE_TAIL_SQL}")
def part_profile_ci(spark, sf):
    """The same for the parameters of every part."""
    return profiled(spark, sf, part_models(spark, sf))


@query("sweep_profile_ci", f"WITH {SWEEP_DESIGN_SQL}, {PROFILE_TAIL_SQL}")
def sweep_profile_ci(spark, sf):
    """The same for every model of the sweep."""
    return profiled(spark, sf, sweep_models(spark, sf))


@query("coord_table", f"""
    WITH {DESIGN_SQL}, {groups_sql('design')}, {ancova_sql()}
    SELECT model_id, round(delta_beta, 4) AS delta_beta, round(delta_gamma, 4) AS delta_gamma,
           round(delta_beta - {T_SQL} * se_beta, 4) AS delta_beta_lower, round(delta_gamma + {T_SQL} * se_gamma, 4) AS delta_gamma_upper,
           round(rss, 4) AS rss FROM ancova WHERE delta_beta IS NOT NULL ORDER BY rss DESC, model_id""")
def coord_table(spark, sf):
    fits = G.ancova_fit(part_groups(spark, sf), ["model_id"]).dropna(subset=["delta_beta"])
    return fits.orderBy(F.desc("rss"), "model_id").select(
        "model_id", F.round("delta_beta", 4).alias("delta_beta"), F.round("delta_gamma", 4).alias("delta_gamma"),
        F.round("delta_beta_lower", 4).alias("delta_beta_lower"), F.round("delta_gamma_upper", 4).alias("delta_gamma_upper"),
        F.round("rss", 4).alias("rss"))


# --- selection against control ------------------------------------------------------

CORR_SQL = (
    "pairs AS (SELECT region AS place, s, x FROM xs UNION ALL SELECT 'national', s, x FROM nat JOIN mc USING (period))"
    ", c AS (SELECT place, COUNT(*) AS n, covar_pop(s, x) / nullif(sqrt(var_pop(s) * var_pop(x)), 0) AS r FROM pairs GROUP BY 1)")
NATIONAL_SQL = (
    "nat_p AS (SELECT period, CAST(n_variant AS DOUBLE) / n_total AS fm FROM (SELECT period, sum(n_variant) AS n_variant, sum(n_total) AS n_total FROM counts GROUP BY 1))"
    ", nat_s AS (SELECT period, (lead(ln(fm / (1 - fm))) OVER w - lag(ln(fm / (1 - fm))) OVER w) / 2 AS s FROM nat_p"
    " WHERE fm > 0.1 AND fm < 1 WINDOW w AS (ORDER BY period)), nat AS (SELECT * FROM nat_s WHERE s IS NOT NULL)")
WITH_P_SQL = (", t AS (SELECT *, CASE WHEN n > 2 AND abs(r) < 1 THEN r * sqrt((n - 2) / (1 - r * r)) END AS t_raw, CAST(n - 2 AS DOUBLE) AS v FROM c)"
              f", tp AS (SELECT *, {t_sql('t_raw', 'v')} AS p_raw FROM t)")
TEST_COLUMNS_SQL = f"""{signif_sql('p_raw')} AS p, {code_sql('p_raw')} AS code, n, round(r, 6) AS r,
    CASE WHEN n >= 4 AND abs(r) < 1 THEN round(tanh(atanh(r) - 1.959963984540054 / sqrt(n - 3)), 6) END AS ci_lower,
    CASE WHEN n >= 4 AND abs(r) < 1 THEN round(tanh(atanh(r) + 1.959963984540054 / sqrt(n - 3)), 6) END AS ci_upper,
    CASE WHEN n > 2 AND abs(r) < 1 THEN round(r * sqrt((n - 2) / (1 - r * r)), 6) END AS t_stat,
    CASE WHEN n > 2 THEN n - 2 END AS df"""


def place_pairs(spark, sf):
    """(place, s, x): monthly central differences and the mean control, by region and in total.

    The counts by region are kept once; the national ones are their sums, so orders
    are read and joined a single time.
    """
    cells = materialise(V.counts(spark, sf)).withColumnRenamed("region", "place")
    total = cells.groupBy("period").agg(F.sum("n_total").alias("n_total"), F.sum("n_variant").alias("n_variant"))
    both = V.with_logit(cells.unionByName(total.withColumn("place", F.lit("national"))))
    kept = both.filter((F.col("fm") > 0.1) & F.col("logit_fm").isNotNull())
    s = O.selection_coef_diff(kept, ["place"], "period", "logit_fm")
    return s.join(week_control(spark, sf, "month").withColumnRenamed("psi_mean", "x"), "period").select("place", "s", "x")


@query("selection_vs_control", f"""
    WITH {RESIDUAL_SQL}, {NATIONAL_SQL}, {CORR_SQL}{WITH_P_SQL} SELECT place, {TEST_COLUMNS_SQL} FROM tp""")
def selection_vs_control(spark, sf):
    """Correlation of the selection coefficient with the control index, by place."""
    return rounded_tests(G.corr_test(place_pairs(spark, sf), ["place"], "x", "s"))


def rounded_tests(tests):
    return tests.withColumns({**{c: F.round(c, 6) for c in ("r", "ci_lower", "ci_upper", "t_stat")}, "p": L.signif(F.col("p"), 3)})


@query("corr_test", """
    WITH c AS (SELECT l_partkey AS place, COUNT(*) AS n, covar_pop(l_extendedprice, l_quantity)
    / nullif(sqrt(var_pop(l_extendedprice) * var_pop(l_quantity)), 0) AS r FROM lineitem GROUP BY 1)""" + WITH_P_SQL + """
    SELECT place, """ + TEST_COLUMNS_SQL + " FROM tp")
def corr_test(spark, sf):
    """Price against quantity for each part, with Fisher limits."""
    lines = V.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("place"), "l_quantity", "l_extendedprice")
    return rounded_tests(G.corr_test(lines, ["place"], "l_quantity", "l_extendedprice"))


NESTED_SQL = f"""{groups_sql('xs', "'all' AS tag", ['x'], 's').replace("GROUP BY 'all' AS tag, region", 'GROUP BY region')},
    tot AS (SELECT sum(n) AS n, COUNT(*) AS g, sum(c_s_s) AS rss1, sum(c_x_x) AS xx, sum(c_x_s) AS xy,
        sum(c_s_s - CASE WHEN c_x_x > 0 THEN c_x_s * c_x_s / c_x_x ELSE 0 END) AS rss3 FROM g),
    varied AS (SELECT COUNT(*) AS gx FROM (SELECT region FROM xs GROUP BY 1 HAVING COUNT(DISTINCT x) > 1)),
    r AS (SELECT *, rss1 - CASE WHEN gx > 0 THEN xy * xy / xx ELSE 0 END AS rss2 FROM tot, varied),
    ft AS (SELECT *, (rss1 - rss2) / nullif(rss2 / (n - g - 1), 0) AS f_12,
        ((rss2 - rss3) / (gx - 1)) / nullif(rss3 / (n - g - gx), 0) AS f_23 FROM r),
    fp AS (SELECT *, {f_sql('f_12', '1.0', 'CAST(n - g - 1 AS DOUBLE)')} AS p_12,
        {f_sql('f_23', 'CAST(gx - 1 AS DOUBLE)', 'CAST(n - g - gx AS DOUBLE)')} AS p_23 FROM ft)"""


@query("nested_f_test", f"""
    WITH {RESIDUAL_SQL}, {NESTED_SQL}
    SELECT CAST(n AS BIGINT) AS n, g, round(rss1, 6) AS rss1, round(rss2, 6) AS rss2, round(rss3, 6) AS rss3,
           CAST(least(gx, 1) AS INTEGER) AS df_12, CAST(n - g - least(gx, 1) AS BIGINT) AS df_2,
           CAST(gx - least(gx, 1) AS BIGINT) AS df_23, CAST(n - g - gx AS BIGINT) AS df_3,
           round(f_12, 6) AS f_12, round(f_23, 6) AS f_23, round(p_12, 6) AS p_12, round(p_23, 6) AS p_23 FROM fp""")
def nested_f_test(spark, sf):
    groups = G.group_sums(selection_with_control(spark, sf), [], "region", ["x"], "s")
    test = G.nested_f_test(groups, [], "x", "s")
    return test.withColumns({c: F.round(c, 6) for c, t in test.dtypes if t == "double"})


@query("interaction_lines", f"""
    WITH {RESIDUAL_SQL}, g AS (SELECT region, COUNT(*) AS n, covar_pop(x, s) / nullif(var_pop(x), 0) AS b, avg(s) AS ms, avg(x) AS mx FROM xs GROUP BY 1)
    , m AS (SELECT region, var_pop(x) * COUNT(*) AS xx, sum(power(s, 2)) - COUNT(*) * power(avg(s), 2) AS yy, covar_pop(x, s) * COUNT(*) AS xy FROM xs GROUP BY 1)
    , v AS (SELECT sum(yy - coalesce(xy * xy / nullif(xx, 0), 0)) / (sum(n) - COUNT(*) - COUNT(b)) AS var, CAST(sum(n) - COUNT(*) - COUNT(b) AS BIGINT) AS df FROM g JOIN m USING (region))
    , e AS (SELECT region, n, df, b AS slope, ms - b * mx AS intercept, sqrt(var / xx) AS se_slope, sqrt(var * (1.0 / n + mx * mx / xx)) AS se_intercept FROM g JOIN m USING (region), v)
    SELECT region, n, df, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(se_slope, 6) AS se_slope, round(se_intercept, 6) AS se_intercept,
           round(slope / se_slope, 5) AS t_slope, round(intercept / se_intercept, 5) AS t_intercept,
           round({t_sql('(slope / se_slope)', 'df')}, 5) AS p_slope, round({t_sql('(intercept / se_intercept)', 'df')}, 5) AS p_intercept FROM e""")
def interaction_lines(spark, sf):
    """Coefficients of the full interaction model, a line per region."""
    groups = G.group_sums(selection_with_control(spark, sf), [], "region", ["x"], "s")
    lines = G.slopes_by_group(groups, [], "region", "x", "s")
    return lines.withColumns({c: F.round(c, 5 if c[:2] in ("t_", "p_") else 6) for c, t in lines.dtypes if t == "double"})


@query("national_trend", f"""
    WITH {RESIDUAL_SQL}, {NATIONAL_SQL}
    SELECT COUNT(*) AS n, round(regr_slope(s, x), 6) AS slope, round(regr_intercept(s, x), 6) AS intercept, round(regr_r2(s, x), 6) AS r2
    FROM nat JOIN mc USING (period)""")
def national_trend(spark, sf):
    rows = place_pairs(spark, sf).filter("place = 'national'")
    trend = G.national_trend(rows, [], "x", "s")
    return trend.withColumns({c: F.round(c, 6) for c in ("slope", "intercept", "r2")})


# --- search and profiles ----------------------------------------------------------------

SEARCH_BOXES = {"mu": (0.5, 1.5), "eta": (-0.02, 0.02)}
SEARCH_KEEP, SEARCH_ROUNDS = 10, 3


def _search_sql() -> str:
    parts, selects = [], []
    for i in range(1, SEARCH_ROUNDS + 1):
        if i == 1:
            (m0, m1), (e0, e1) = SEARCH_BOXES.values()
            parts.append(f"box1 AS (SELECT {m0}::DOUBLE AS m0, {m1}::DOUBLE AS m1, {e0}::DOUBLE AS e0, {e1}::DOUBLE AS e1)")
        else:
            parts.append(f"box{i} AS (SELECT min(mu) AS m0, max(mu) AS m1, min(eta) AS e0, max(eta) AS e1 FROM best{i - 1})")
        seed = f"'1234-{i}'"
        parts.append(f"start{i} AS (SELECT p_partkey AS candidate, m0 + (m1 - m0) * {uniform_sql(seed, 'p_partkey', repr('mu'))} AS mu,"
                     f" e0 + (e1 - e0) * {uniform_sql(seed, 'p_partkey', repr('eta'))} AS eta FROM part, box{i})")
        parts.append(f"score{i} AS (SELECT candidate, any_value(mu) AS mu, any_value(eta) AS eta, sum(power(value - base * (mu + eta * t), 2)"
                     f" / greatest(base * (mu + eta * t), greatest(0.001, (SELECT min(value) FROM obs)))) AS score FROM start{i}, points GROUP BY 1)")
        parts.append(f"best{i} AS (SELECT * FROM score{i} ORDER BY score, candidate LIMIT {SEARCH_KEEP})")
        selects.append(f"SELECT {i} AS round, candidate, round(mu, 6) AS mu, round(eta, 6) AS eta, round(score, 4) AS score FROM best{i}")
    return f"WITH {OBS_SQL}, {', '.join(parts)} {' UNION ALL '.join(selects)}"


@query("candidate_search", _search_sql())
def candidate_search(spark, sf):
    """Three rounds over a start per part; boxes shrink to the span of the best ten."""
    ids = V.table(spark, sf, "part").select(F.col("p_partkey").alias("candidate"))
    best = S.candidate_search(ids, observations(spark, sf), SEARCH_BOXES, expected_line, SEARCH_KEEP, SEARCH_ROUNDS)
    return best.select("round", "candidate", F.round("mu", 6).alias("mu"), F.round("eta", 6).alias("eta"),
                       F.round("score", 4).alias("score"))


def _keyed_search_sql() -> str:
    """Rounds per fixed value g of mu, each with its own box of eta."""
    parts, last = [], PROFILE_POINTS - 1
    for i in range(1, SEARCH_ROUNDS + 1):
        if i == 1:
            e0, e1 = SEARCH_BOXES["eta"]
            parts.append(f"box1 AS (SELECT DISTINCT g, {e0}::DOUBLE AS e0, {e1}::DOUBLE AS e1 FROM ids)")
        else:
            parts.append(f"box{i} AS (SELECT g, min(eta) AS e0, max(eta) AS e1 FROM best{i - 1} GROUP BY 1)")
        seed = f"'1234-{i}'"
        parts.append(f"start{i} AS (SELECT g, candidate, e0 + (e1 - e0) * {uniform_sql(seed, 'g', 'candidate', repr('eta'))} AS eta FROM ids JOIN box{i} USING (g))")
        parts.append(f"score{i} AS (SELECT g, candidate, any_value(eta) AS eta, sum(power(value - base * (0.5::DOUBLE + 1.0::DOUBLE * g / {last} + eta * t), 2)"
                     f" / greatest(base * (0.5::DOUBLE + 1.0::DOUBLE * g / {last} + eta * t), greatest(0.001, (SELECT min(value) FROM obs)))) AS score FROM start{i}, points GROUP BY 1, 2)")
        parts.append(f"best{i} AS (SELECT * FROM score{i} QUALIFY row_number() OVER (PARTITION BY g ORDER BY score, candidate) <= {SEARCH_KEEP // 2})")
    return (f"WITH {OBS_SQL}, ids AS (SELECT p_partkey AS candidate, CAST(p_partkey % {PROFILE_POINTS} AS INTEGER) AS g FROM part), {', '.join(parts)}"
            f" SELECT g, round(min(score), 4) AS wls FROM best{SEARCH_ROUNDS} GROUP BY 1")


PROFILE_POINTS = 100


@query("profile_search", _keyed_search_sql())
def profile_search(spark, sf):
    """Profile of mu: at each of its fixed values eta is searched in rounds, all values in one job per round."""
    ids = V.table(spark, sf, "part").select(F.col("p_partkey").alias("candidate"),
                                            (F.col("p_partkey") % PROFILE_POINTS).cast("int").alias("g"))

    def line():
        mu = 0.5 + 1.0 * F.col("g") / (PROFILE_POINTS - 1)
        return F.col("base") * (mu + F.col("eta") * F.col("t"))

    best = S.candidate_search(ids, observations(spark, sf), {"eta": SEARCH_BOXES["eta"]}, line, SEARCH_KEEP // 2, SEARCH_ROUNDS, by=["g"])
    return best.filter(F.col("round") == SEARCH_ROUNDS).groupBy("g").agg(F.round(F.min("score"), 4).alias("wls"))


@query("profile_scan", f"""
    WITH {OBS_SQL}, raw AS (SELECT p_partkey AS candidate, p_partkey % {PROFILE_POINTS} AS g, p_partkey % 3 AS code, 0.5 + p_size / 51.0::DOUBLE AS mu0,
        (p_retailprice - 950) / 5000 AS eta0 FROM part),
    cand AS (SELECT 'eta' AS parm, candidate, g, code, mu0 AS mu, -0.01::DOUBLE + 0.02::DOUBLE * g / {PROFILE_POINTS - 1} AS eta FROM raw
        UNION ALL SELECT 'mu', candidate, g, code, 0.5::DOUBLE + 1.0::DOUBLE * g / {PROFILE_POINTS - 1}, eta0 FROM raw),
    sc AS (SELECT parm, candidate, g, code, sum(power(value - base * (mu + eta * t), 2)
        / greatest(base * (mu + eta * t), greatest(0.001, (SELECT min(value) FROM obs)))) AS score FROM cand, points GROUP BY ALL)
    SELECT parm, g, round(min(CASE WHEN code = 0 THEN score END), 4) AS wls FROM sc GROUP BY 1, 2""")
def profile_scan(spark, sf):
    """Profiles of both line parameters: fixed on a grid, the other one free over the candidates."""
    key = F.col("candidate")
    g, last = (key % PROFILE_POINTS), PROFILE_POINTS - 1
    rows = candidates(spark, sf).withColumns({"g": g, "code": key % 3})
    eta = rows.withColumns({"parm": F.lit("eta"), "eta": -0.01 + 0.02 * F.col("g") / last})
    mu = rows.withColumns({"parm": F.lit("mu"), "mu": 0.5 + 1.0 * F.col("g") / last})
    table = eta.unionByName(mu).withColumn("candidate", F.concat_ws("|", "parm", key.cast("string")))
    scored = S.score_candidates(table, materialise(observations(spark, sf)), expected_line)
    return S.profile_scan(scored, "g", "score", F.col("code") == 0, ["parm"]).withColumn("wls", F.round("wls", 4))


TRAJECTORY_DAYS = 30  # the span of the given events, for the SQL only


@query("trajectory_score", f"""
    WITH {OBS_SQL}, {V.PARAMS_SQL}, o AS (SELECT series, t, value FROM obs WHERE t <= {TRAJECTORY_DAYS}),
    traj AS (SELECT brand, model_id AS candidate, t, 40000 * exp(-0.01::DOUBLE * k * t) AS s, 100 * a * t AS ia, 30 * k * t AS ic, 20 * a * t AS d
        FROM params, (SELECT unnest(generate_series(0, {TRAJECTORY_DAYS})) AS t)),
    f AS (SELECT brand, candidate, t, (0.0021937::DOUBLE + 0.000031741::DOUBLE * t) * s AS negative,
        ic - lag(ic) OVER w + (0.0021937::DOUBLE + 0.000031741::DOUBLE * t) * ia AS positive, d - lag(d) OVER w AS deaths
        FROM traj WINDOW w AS (PARTITION BY candidate ORDER BY t)),
    long AS (SELECT brand, candidate, t, 'negative' AS series, negative AS expected FROM f UNION ALL SELECT brand, candidate, t, 'positive', positive FROM f
        UNION ALL SELECT brand, candidate, t, 'deaths', deaths FROM f),
    sc AS (SELECT brand, candidate, sum(power(value - expected, 2) / greatest(expected, greatest(0.001, (SELECT min(value) FROM o)))) AS score
        FROM long JOIN o USING (series, t) GROUP BY 1, 2)
    SELECT brand, arg_min(candidate, (score, candidate)) AS candidate, round(min(score), 4) AS score FROM sc GROUP BY 1""")
def trajectory_score(spark, sf):
    """Trajectories of daily states, their observables, the loss per point, and the best candidate of each brand."""
    k, a, t = F.col("k"), F.col("a"), F.col("t")
    obs = materialise(observations(spark, sf).select("series", "t", "value"))
    last = obs.agg(F.max("t")).scalar()
    days = expand_range(V.model_params(spark, sf).select("brand", F.col("model_id").alias("candidate"), "k", "a"), "t", 0, last)
    states = days.select("brand", "candidate", "t", (40000 * F.exp(-0.01 * k * t)).alias("S"), (100 * a * t).alias("IA"),
                         (30 * k * t).alias("IS_cumul"), (20 * a * t).alias("D"))
    seen = O.observables(states, ["brand", "candidate"], "t", C.reporting_rate(t, None, 0.0021937, 0.000031741))
    expected = seen.unpivot(["brand", "candidate", "t"], ["negative", "positive", "deaths"], "series", "expected")
    scores = S.wls_score(S.point_losses(obs, expected, ["series", "t"]), ["brand", "candidate"])
    best = S.best_candidate(scores, ["brand"], "score", "candidate", F.lit(True))
    return best.select("brand", "candidate", F.round("score", 4).alias("score"))


# --- bootstrap of the second step -----------------------------------------------------------

BOOT_LAWS = {"Rademacher": "CASE WHEN u < 0.5 THEN 1.0 ELSE -1.0 END", "Mammen2": MAMMEN_SQL}
BOOT_REPLICATES = 1000
BEST_DESIGN_SQL = (
    f"{V.RETAINED_SQL}, {V.CONTROL_INDEX_SQL}, {V.PARAMS_SQL.replace('params AS', 'raw AS')}"
    ", params AS (SELECT 1 AS model_id, arg_min(k, (value, model_id)) AS k, arg_min(a, (value, model_id)) AS a FROM raw WHERE code = 0)"
    f", {MODEL_DAYS_SQL}, {DESIGN_TAIL_SQL}")
BOOT_SQL = (
    f"{BEST_DESIGN_SQL}, {groups_sql('design')}, {ancova_sql()}"
    ", base AS (SELECT d.region, d.t, d.x1, d.z, d.rho, d.y, g.m_y + b1 * (d.x1 - g.m_x1) + delta_gamma * (d.z - g.m_z) AS expected"
    " FROM design d JOIN g USING (model_id, region) JOIN ancova USING (model_id))"
    f", b AS (SELECT CAST(unnest(generate_series(1, {BOOT_REPLICATES})) AS INTEGER) AS replicate)"
    f", drawn AS (SELECT *, y - expected AS residual, {uniform_sql('456', 'replicate', 'region', 'period_text')} AS u"
    " FROM (SELECT *, CAST(CAST(floor(t) AS INTEGER) AS VARCHAR) AS period_text FROM base), b)"
    ", ystar AS (" + " UNION ALL ".join(
        f"SELECT '{law}|' || replicate AS model_id, region, rho, x1, z, expected + residual * ({sql}) AS y FROM drawn" for law, sql in BOOT_LAWS.items())
    + f"), {groups_sql('ystar', name='bg')}, {ancova_sql(g='bg', name='boot')}")


def bootstrap_fits(spark, sf):
    """ANCOVA of every replicate of both laws at the best control parameters of the table."""
    fits = V.model_params(spark, sf).select("model_id", "value", "code", "k", "a")
    models = S.best_candidate(fits, [], "value", "model_id", F.col("code") == 0).withColumn("model_id", F.lit(1))
    design = materialise(design_rows(spark, sf, models))
    groups = G.model_groups(design)
    levels = G.ancova_intercepts(groups, G.ancova_fit(groups, ["model_id"]), ["model_id"], "region")
    fitted = G.fitted_rows(design, levels, ["model_id"], "region").select(
        "region", "rho", "x1", "z", F.floor("t").cast("int").alias("day_idx"),
        F.col("fitted").alias("expected"), "residual")
    fitted = materialise(fitted)
    rows = wild_replicates(fitted, ["region", "day_idx"], BOOT_REPLICATES, list(BOOT_LAWS), 456).withColumnRenamed("value", "y")
    return G.ancova_fit(G.model_groups(rows, ["law", "replicate"]), ["law", "replicate"])


@query("wild_refit", f"""
    WITH {BOOT_SQL}
    SELECT split_part(model_id, '|', 1) AS law, CAST(split_part(model_id, '|', 2) AS INTEGER) AS replicate,
           CASE WHEN rank_deficient THEN 'No convergence' ELSE 'Successful completion' END AS convergence,
           round(delta_beta, 5) AS delta_beta, round(delta_gamma, 5) AS delta_gamma, round(rss, 4) AS rss FROM boot""")
def wild_refit(spark, sf):
    label = F.when(F.col("rank_deficient"), "No convergence").otherwise("Successful completion")
    return bootstrap_fits(spark, sf).select(
        "law", "replicate", label.alias("convergence"), F.round("delta_beta", 5).alias("delta_beta"),
        F.round("delta_gamma", 5).alias("delta_gamma"), F.round("rss", 4).alias("rss"))


@query("bootstrap_summary", f"""
    WITH {BOOT_SQL}, v AS (SELECT split_part(model_id, '|', 1) AS law, delta_beta, delta_gamma, {s_sql('delta_beta', 'delta_gamma')} AS s_day FROM boot),
    long AS (SELECT law, 'delta_beta' AS param, delta_beta AS x FROM v UNION ALL SELECT law, 'delta_gamma', delta_gamma FROM v
        UNION ALL SELECT law, 's_day', s_day FROM v UNION ALL SELECT law, 's_week', 7 * s_day FROM v)
    SELECT law, param, COUNT(x) AS n, round(min(x), 5) AS min, round(avg(x), 5) AS mean, round(max(x), 5) AS max, round(stddev_samp(x), 5) AS sd,
           round(quantile_cont(x, 0.025), 5) AS lower, round(quantile_cont(x, 0.25), 5) AS q1, round(quantile_cont(x, 0.5), 5) AS median,
           round(quantile_cont(x, 0.75), 5) AS q3, round(quantile_cont(x, 0.975), 5) AS upper FROM long GROUP BY 1, 2""")
def bootstrap_summary(spark, sf):
    """Limits, quartiles, mean and deviation per law and parameter, with s per day and week."""
    fits = materialise(bootstrap_fits(spark, sf))
    s = C.selection_coef(F.col("delta_beta"), F.col("delta_gamma"))
    wide = fits.select("law", "delta_beta", "delta_gamma", s.alias("s_day"), (7 * s).alias("s_week"))
    long = wide.unpivot(["law"], ["delta_beta", "delta_gamma", "s_day", "s_week"], "param", "x")
    named = {"lower": .025, "q1": .25, "median": .5, "q3": .75, "upper": .975}
    out = M.summary_with_quantiles(long, ["law", "param"], "x", named)
    return out.withColumns({c: F.round(c, 5) for c, t in out.dtypes if t == "double"})


@query("density_table", """
    WITH cut AS (SELECT event_type, quantile_cont(value, 0.025) AS lo, quantile_cont(value, 0.975) AS hi FROM events GROUP BY 1),
    kept AS (SELECT event_type, value, lo, hi FROM events JOIN cut USING (event_type) WHERE value BETWEEN lo AND hi),
    bw AS (SELECT event_type, COUNT(*) AS n, any_value(lo) AS lo, any_value(hi) AS hi, 0.9 * least(stddev_samp(value),
        (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / 1.34) * power(COUNT(*), -0.2::DOUBLE) AS bw FROM kept GROUP BY 1),
    grid AS (SELECT event_type, n, bw, g, lo + g * (hi - lo) / 511 AS x FROM bw, (SELECT CAST(unnest(generate_series(0, 511)) AS INTEGER) AS g) WHERE bw > 0)
    SELECT event_type, g, round(x, 6) AS x, round(bw, 6) AS bw, round(sum(exp(-power((value - x) / bw, 2) / 2)) / any_value(n * bw * sqrt(2 * pi())), 6) AS density
    FROM grid JOIN kept USING (event_type) GROUP BY event_type, g, x, bw""")
def density_table(spark, sf):
    events = V.table(spark, sf, "events").select("event_type", "value")
    out = M.density_table(events, ["event_type"], "value")
    return out.select("event_type", "g", *[F.round(c, 6).alias(c) for c in ("x", "bw", "density")])


@query("sensitivity_table", """
    WITH est AS (SELECT p_brand, p_type, AVG(p_size) AS k, AVG(p_retailprice) AS a FROM part GROUP BY 1, 2),
    long AS (SELECT p_brand, p_type, 'k' AS estim_parm, k AS estimates FROM est UNION ALL SELECT p_brand, p_type, 'a', a FROM est)
    SELECT p_brand, p_type, estim_parm, round(estimates, 6) AS estimates, round(estimates / nullif(max(CASE WHEN p_type = 'STANDARD' THEN estimates END)
           OVER (PARTITION BY p_brand, estim_parm), 0) - 1, 6) AS estimates_var FROM long""")
def sensitivity_table(spark, sf):
    """Change of each estimate against the reference variant of its brand."""
    est = V.table(spark, sf, "part").groupBy("p_brand", "p_type").agg(
        F.avg("p_size").alias("k"), F.avg("p_retailprice").alias("a"))
    long = est.unpivot(["p_brand", "p_type"], ["k", "a"], "estim_parm", "estimates")
    long = long.withColumn("is_ref", F.col("p_type") == "STANDARD")
    out = O.relative_to_reference(long, ["p_brand", "estim_parm"], "estimates", "is_ref", "estimates_var")
    return out.select("p_brand", "p_type", "estim_parm", F.round("estimates", 6).alias("estimates"),
                      F.round("estimates_var", 6).alias("estimates_var"))


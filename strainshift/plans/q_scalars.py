"""Queries of scalar functions."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strainshift.functions import control as C
from strainshift.functions import labels as L
from strainshift.functions import transforms as T
from strainshift.functions.hashing import hash_uniform, wild_weight
from strainshift.operators.align import day_index
from strainshift.operators.expand import expand_calendar, expand_range, expand_values
from strainshift.operators.integral import daily_integrands
from strainshift.operators.score import uniform_starts as draw_starts
from strainshift.operators.windows import observables as observed_of
from strainshift.plans import views as V
from strainshift.plans.q_joins import GRID, param_grid
from strainshift.plans.q_reshape import LAWS, uniform_sql
from strainshift.plans.q_rows import LABEL_SQL
from strainshift.plans.registry import query


def rounded(df, digits: int = 6, *, keep: tuple[str, ...] = ()):
    """Round every double column but the named ones."""
    return df.withColumns({c: F.round(c, digits) for c, t in df.dtypes if t == "double" and c not in keep})


@query("parse_dates", """
    SELECT o_orderkey, CAST(o_orderdate AS DATE) AS iso, CAST(o_orderdate AS DATE) AS dayfirst,
           CAST(NULL AS DATE) AS dirty FROM orders""")
def parse_dates(spark, sf):
    text = V.table(spark, sf, "orders").select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("iso_text"),
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("day_text"))
    return text.select("o_orderkey", F.to_date("iso_text", "yyyy-MM-dd").alias("iso"),
                       F.to_date("day_text", "dd/MM/yyyy").alias("dayfirst"),
                       F.try_to_date(F.concat(F.lit("week "), "day_text"), "dd/MM/yyyy").alias("dirty"))


@query("day_index", """
    SELECT o_orderkey, date_diff('day', (SELECT CAST(min(o_orderdate) AS DATE) FROM orders), CAST(o_orderdate AS DATE)) + 3.5::DOUBLE AS t,
           CAST(o_orderdate AS DATE) AS back FROM orders""")
def day_index_query(spark, sf):
    orders = V.table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    origin = orders.agg(F.min("day")).scalar()
    t = orders.withColumn("t", day_index(F.col("day"), origin, 3.5))
    return t.select("o_orderkey", "t", F.date_add(origin, F.floor("t").cast("int") - 3).alias("back"))


@query("floor_index", f"""
    WITH {V.CONTROL_INDEX_SQL}, o AS (SELECT o_orderkey, o_custkey, epoch(o_orderdate) AS s,
        date_diff('day', (SELECT lo FROM bounds), CAST(o_orderdate AS DATE)) + (o_orderkey % 4) / 4.0::DOUBLE AS t FROM orders)
    SELECT o_orderkey, t, CAST(floor(t) AS INTEGER) AS day_idx, round(psi, 6) AS psi
    FROM o LEFT JOIN control_idx ON day_idx = floor(t)""")
def floor_index(spark, sf):
    """The control index at a real time: the day that holds it, by an equi-join."""
    index = V.control_index(spark, sf)
    origin = V.table(spark, sf, "orders").agg(F.min(V.period_of("o_orderdate", "month"))).scalar()
    orders = V.table(spark, sf, "orders").select(
        "o_orderkey", (F.date_diff(F.to_date("o_orderdate"), origin) + (F.col("o_orderkey") % 4) / 4).alias("t"))
    return (orders.withColumn("day_idx", F.floor("t").cast("int")).join(index, "day_idx", "left")
            .select("o_orderkey", "t", "day_idx", F.round("psi", 6).alias("psi")))


@query("logit_pair", f"""
    WITH {V.panel_sql('week')}
    SELECT region, period, round(fm, 6) AS fm, round(logit_fm, 6) AS logit_fm, round(1 / (1 + exp(-logit_fm)), 6) AS back FROM panel""")
def logit_pair(spark, sf):
    cells = V.panel(spark, sf, "week").select("region", "period", "fm", T.logit(F.col("fm")).alias("logit_fm"))
    return rounded(cells.withColumn("back", T.inv_logit(F.col("logit_fm"))))


@query("log_ab", """
    SELECT o_orderkey, CASE WHEN x > 0 AND x < 0.2 THEN round(ln(x / (0.2 - x)), 6) END AS y FROM
    (SELECT o_orderkey, o_totalprice / 2000000 AS x FROM orders)""")
def log_ab(spark, sf):
    return V.table(spark, sf, "orders").select(
        "o_orderkey", F.round(T.log_ab(F.col("o_totalprice") / 2000000, 0.0, 0.2), 6).alias("y"))


@query("inv_log_ab", """
    SELECT c_custkey, round(0.2 / (1 + exp(-c_acctbal / 1000)), 6) AS x, CASE WHEN c_acctbal > 0 THEN 0.2 ELSE 0 END::DOUBLE AS far FROM customer""")
def inv_log_ab(spark, sf):
    y = F.col("c_acctbal") / 1000
    return V.table(spark, sf, "customer").select(
        "c_custkey", F.round(T.inv_log_ab(y, 0.0, 0.2), 6).alias("x"),
        F.round(T.inv_log_ab(F.signum(y) * 1e6, 0.0, 0.2), 6).alias("far"))


REAL_SQL = ("SELECT model_id, ln(a) AS a, ln(exit_rate / (1 - exit_rate)) AS exit_rate, ln(k / (1 - k)) AS k,"
            " ln(omega / (1 - omega)) AS omega, ln(eta / (1 - eta)) AS eta, ln(mu / (1 - mu)) AS mu,"
            " CASE WHEN pE > 0 AND pE < 0.01 THEN ln(pE / (0.01 - pE)) END AS pE, ln(p / (0.2 - p)) AS p FROM params")
PARAMETERS = ["pE", "exit_rate", "k", "a", "omega", "p", "eta", "mu"]


def parameter_rows(spark, sf):
    return V.model_params(spark, sf).select("model_id", *PARAMETERS)


def _rounded_sql(source: str) -> str:
    return "SELECT model_id, " + ", ".join(f'round({c}, 6) AS "{c}"' for c in PARAMETERS) + f" FROM {source}"


@query("param_to_real", f"WITH {V.PARAMS_SQL}, r AS ({REAL_SQL}) {_rounded_sql('r')}")
def param_to_real(spark, sf):
    return rounded(T.params_to_real(parameter_rows(spark, sf)))


@query("param_from_real", f"WITH {V.PARAMS_SQL} {_rounded_sql('params')}")
def param_from_real(spark, sf):
    """There and back again."""
    return rounded(T.params_from_real(T.params_to_real(parameter_rows(spark, sf))))


@query("control_effectiveness", f"""
    WITH {V.CONTROL_INDEX_SQL}
    SELECT day_idx, 'best' AS curve, round(coalesce({C.BEST_K} * pow(psi / 100, {C.BEST_A}), 0), 6) AS c FROM control_idx
    UNION ALL SELECT day_idx, 'real', round(coalesce(0.99::DOUBLE * pow(psi / 100, 3.78), 0), 6) FROM control_idx""")
def control_effectiveness(spark, sf):
    index = V.control_index(spark, sf)
    curves = F.array(*[F.struct(F.lit(n).alias("curve"), F.lit(k).alias("k"), F.lit(a).alias("a"))
                       for n, k, a in (("best", C.BEST_K, C.BEST_A), ("real", 0.99, 3.78))])
    both = index.select("*", F.inline(curves))
    return both.select("day_idx", "curve", F.round(C.effectiveness(F.col("psi"), F.col("k"), F.col("a")), 6).alias("c"))


@query("reporting_rate", f"""
    WITH {V.PARAMS_SQL}, d AS (SELECT CAST(unnest(generate_series(1, 30)) AS INTEGER) AS t)
    SELECT model_id, t, round(1000 * CASE WHEN code = 10 THEN p ELSE mu + eta * t END, 6) AS rho_permille FROM params, d""")
def reporting_rate(spark, sf):
    """A constant rate where the fit has one, a line in time elsewhere."""
    rows = expand_range(V.model_params(spark, sf), "t", 1, 30)
    rho = F.when(F.col("code") == 10, F.col("p"))
    rate = C.reporting_rate(F.col("t"), rho, F.col("mu"), F.col("eta"))
    return rows.select("model_id", "t", F.round(1000 * rate, 6).alias("rho_permille"))


TRAJECTORY_SQL = (
    "byday AS (SELECT o_custkey AS candidate, CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) / 1000 AS amount,"
    " max(o_totalprice) / 5000 AS ia, COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS dead, COUNT(*) FILTER (WHERE o_orderstatus <> 'P') AS fresh"
    " FROM orders GROUP BY 1, 2)"
    ", traj AS (SELECT candidate, date_diff('day', (SELECT min(day) FROM byday), day) AS t, sum(amount) OVER w AS s, ia,"
    " sum(dead) OVER w AS d, sum(fresh) OVER w AS is_cumul, row_number() OVER w AS i FROM byday WINDOW w AS (PARTITION BY candidate ORDER BY day))")


def trajectories(spark, sf):
    """A trajectory per customer: t in days, S, IA and two cumulative states.

    Orders are summed by day first, so no window is longer than the calendar.
    """
    status = F.col("o_orderstatus")
    daily = V.table(spark, sf, "orders").groupBy(
        F.col("o_custkey").alias("candidate"), F.to_date("o_orderdate").alias("day")).agg(
        (F.sum("o_totalprice") / 1000).alias("amount"), (F.max("o_totalprice") / 5000).alias("IA"),
        F.count_if(status == "F").alias("dead"), F.count_if(status != "P").alias("fresh"))
    origin = V.table(spark, sf, "orders").agg(F.to_date(F.min("o_orderdate"))).scalar()
    w = W.partitionBy("candidate").orderBy("day")
    return daily.select("candidate", F.date_diff("day", origin).alias("t"), F.sum("amount").over(w).alias("S"), "IA",
                        F.sum("dead").over(w).alias("D"), F.sum("fresh").over(w).alias("IS_cumul"))


@query("observables", f"""
    WITH {TRAJECTORY_SQL}, f AS (SELECT *, d - lag(d) OVER v AS dd, is_cumul - lag(is_cumul) OVER v AS ds FROM traj
        WINDOW v AS (PARTITION BY candidate ORDER BY t))
    SELECT candidate, CAST(t AS INTEGER) AS t, round((0.0021937::DOUBLE + 0.000031741::DOUBLE * t) * s, 6) AS negative,
           round(ds + (0.0021937::DOUBLE + 0.000031741::DOUBLE * t) * ia, 6) AS positive, CAST(dd AS BIGINT) AS deaths FROM f WHERE i > 1""")
def observables(spark, sf):
    """Negative tests, positive tests and deaths from a trajectory table."""
    rho = C.reporting_rate(F.col("t"), None, 0.0021937, 0.000031741)
    rows = observed_of(trajectories(spark, sf), ["candidate"], "t", rho)
    return rows.withColumns({c: F.round(c, 6) for c in ("negative", "positive")})


@query("final_state_share", f"""
    WITH {TRAJECTORY_SQL}, last AS (SELECT candidate, max(t) AS t, arg_max(s, t) AS s, arg_max(d, t) AS d FROM traj GROUP BY 1)
    SELECT candidate, t, round(s / 10007, 6) AS s_share, round(d / 10007.0::DOUBLE, 6) AS d_share FROM last""")
def final_state_share(spark, sf):
    """States of the last day of each trajectory over the population size."""
    last = trajectories(spark, sf).groupBy("candidate").agg(
        F.max("t").alias("t"), F.max_by("S", "t").alias("S"), F.max_by("D", "t").alias("D"))
    return last.select("candidate", "t", F.round(F.col("S") / 10007, 6).alias("s_share"),
                       F.round(F.col("D") / 10007, 6).alias("d_share"))


@query("initial_state", f"""
    WITH {V.PARAMS_SQL}, e AS (SELECT CAST(ts AS DATE) AS day, COUNT(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1),
    d AS (SELECT avg(n) AS d1 FROM e WHERE day <= (SELECT min(day) + 6 FROM e)),
    s AS (SELECT model_id, 0.9::DOUBLE * 66000000 AS "S", pE * 66000000 AS "E", d1 / exit_rate AS isd, p, omega FROM params, d),
    r AS (SELECT *, isd * (1 - p) / p AS isr FROM s), i AS (SELECT *, (isr + isd) * (1 - omega) / omega AS ia FROM r)
    SELECT model_id, round("S", 3) AS "S", round("E", 3) AS "E", round(ia, 3) AS "IA", round(isr, 3) AS "ISr", round(isd, 3) AS "ISd",
           round(66000000 - ("S" + "E" + ia + isr + isd), 3) AS "R" FROM i""")
def initial_state(spark, sf):
    """Start of every fit, with the mean daily deaths of the first week as its level."""
    deaths = (V.table(spark, sf, "events").filter("event_type = 'error'")
              .groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n")))
    week = deaths.filter(F.col("day") <= deaths.agg(F.date_add(F.min("day"), 6)).scalar())
    level = week.agg(F.avg("n")).scalar()
    fits = V.model_params(spark, sf).withColumn("d1", level)
    state = C.initial_state(66_000_000, F.col("d1"), 0.9, F.col("pE"), F.col("exit_rate"), F.col("omega"), F.col("p"))
    return fits.select("model_id", *[F.round(state[c], 3).alias(c) for c in ("S", "E", "IA", "ISr", "ISd", "R")])


@query("r0_formula", f"""
    WITH {V.PARAMS_SQL}
    SELECT model_id, round(0.25 * ((1 - omega * p) / 0.1 + omega * p / exit_rate), 6) AS "R0",
           round(2.5 / ((1 - omega * p) / 0.1 + omega * p / exit_rate), 6) AS beta, round(2.5 * 0.1, 6)::DOUBLE AS beta_approx FROM params""")
def r0_formula(spark, sf):
    w = (0.1, F.col("exit_rate"), F.col("omega"), F.col("p"))
    return V.model_params(spark, sf).select(
        "model_id", F.round(C.r0_from_beta(0.25, *w), 6).alias("R0"), F.round(C.beta_from_r0(2.5, *w), 6).alias("beta"),
        F.round(F.lit(2.5) * 0.1, 6).alias("beta_approx"))


H_SQL = "sqrt(0.1::DOUBLE * 0.1 + 4 * 0.2 * 0.25 * 0.75)"


def s_sql(db: str, dg: str, form: str = "gradient") -> str:
    if form == "gradient":
        return f"(0.2 * {db} * 0.75 / {H_SQL} - (0.1 / {H_SQL} + 1) * {dg} / 2)"
    return f"((2 * 0.2 * {db} * 0.75 - (0.1 + 2 * {H_SQL}) * {dg}) / (2 * {H_SQL}))"


@query("selection_coef", f"""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round({s_sql('l_tax', '(-l_discount)')}, 6) AS s_day,
           round(7 * {s_sql('l_tax', '(-l_discount)')}, 6) AS s_week, round({s_sql('l_tax', '(-l_discount)', 'legacy')}, 6) AS s_day_legacy FROM lineitem""")
def selection_coef(spark, sf):
    db, dg = F.col("l_tax"), -F.col("l_discount")
    s = C.selection_coef(db, dg)
    return V.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(s, 6).alias("s_day"),
        F.round(7 * s, 6).alias("s_week"), F.round(C.selection_coef(db, dg, form="legacy"), 6).alias("s_day_legacy"))


@query("gradient_integrands", f"""
    WITH {V.CONTROL_INDEX_SQL}, brands AS (SELECT p_brand AS brand, avg(p_size) / 51 AS k, 1 + avg(p_size) / 10 AS a FROM part GROUP BY 1),
    f AS (SELECT brand, day_idx, coalesce(k * pow(psi / 100, a), 0) AS c FROM brands, control_idx)
    SELECT brand, day_idx, round((1 - c) / sqrt(0.01::DOUBLE + 4 * 0.2 * (1 - c) * 0.25 * 0.75), 6) AS f1,
           round(1 / sqrt(0.01::DOUBLE + 4 * 0.2 * (1 - c) * 0.25 * 0.75), 6) AS f2 FROM f""")
def gradient_integrands(spark, sf):
    brands = V.table(spark, sf, "part").groupBy(F.col("p_brand").alias("brand")).agg(
        (F.avg("p_size") / 51).alias("k"), (1 + F.avg("p_size") / 10).alias("a"))
    rows = daily_integrands(expand_calendar(brands, V.control_index(spark, sf)))
    return rows.select("brand", "day_idx", F.round("f1", 6).alias("f1"), F.round("f2", 6).alias("f2"))


def gradient_rows(spark, sf, approximate=False):
    """R = 0, .01, .., 2 for three effects, as large as the brand's sizes say."""
    brands = V.table(spark, sf, "part").groupBy(F.col("p_brand").alias("brand")).agg((F.avg("p_size") / 103.9).alias("d"))
    grid = expand_values(expand_range(brands, "i", 0, 200), "effect", [1, 2, 3]).withColumn("R", F.col("i") / 100)
    d = [F.when(F.col("effect") == e, F.col("d")).otherwise(0.0) for e in (1, 2, 3)]
    return grid.withColumn("s", C.selection_gradient(F.col("R"), 10, 10, *d, approximate=approximate))


def gradient_sql(log: str) -> str:
    return (f"CASE effect WHEN 1 THEN r * d / 10 WHEN 2 THEN d * (r - 1) * 10 / 100 + r * (-2 * d * {log}) / 10"
            f" ELSE -2 * d * (r - 1) * 10 / 100 + r * (2 * d * {log}) / 10 END")


GRADIENT_SQL = ("brands AS (SELECT p_brand AS brand, avg(p_size) / 103.9::DOUBLE AS d FROM part GROUP BY 1), grid AS (SELECT brand, d, i,"
                " CAST(i AS DOUBLE) / 100 AS r, effect FROM brands, (SELECT CAST(unnest(generate_series(0, 200)) AS INTEGER) AS i),"
                " (SELECT CAST(unnest(generate_series(1, 3)) AS INTEGER) AS effect))")
EXACT_S = f"CASE WHEN r > 0 THEN {gradient_sql('ln(CASE WHEN r > 0 THEN r ELSE 1 END)')} END"
APPROX_S = gradient_sql("(r - 1)")


@query("selection_gradient_R", f"WITH {GRADIENT_SQL} SELECT brand, effect, i, round({EXACT_S}, 6) AS s FROM grid")
def selection_gradient_r(spark, sf):
    """The whole expression needs ln R, so the point R = 0 has no value."""
    return gradient_rows(spark, sf).select("brand", "effect", "i", F.round("s", 6).alias("s"))


@query("selection_gradient_R_approx", f"WITH {GRADIENT_SQL} SELECT brand, effect, i, round({APPROX_S}, 6) AS s FROM grid")
def selection_gradient_r_approx(spark, sf):
    return gradient_rows(spark, sf, True).select("brand", "effect", "i", F.round("s", 6).alias("s"))


@query("gradient_grid", f"""
    WITH {GRADIENT_SQL} SELECT brand, effect, round(r, 2) AS "R", round({EXACT_S}, 6) AS s, round({APPROX_S}, 6) AS s_approx FROM grid""")
def gradient_grid(spark, sf):
    exact = gradient_rows(spark, sf)
    d = [F.when(F.col("effect") == e, F.col("d")).otherwise(0.0) for e in (1, 2, 3)]
    both = exact.withColumn("s_approx", C.selection_gradient(F.col("R"), 10, 10, *d, approximate=True))
    return both.select("brand", "effect", F.round("R", 2).alias("R"), F.round("s", 6).alias("s"),
                       F.round("s_approx", 6).alias("s_approx"))


@query("selection_grid", f"""
    WITH kinds AS (SELECT p_type AS kind, max(p_size) / 142.0::DOUBLE AS reach FROM part GROUP BY 1),
    g AS (SELECT CAST(unnest(generate_series(0, {GRID - 1})) AS INTEGER) AS i),
    p AS (SELECT kind, x.i, y.i AS j, -reach + 2 * reach * x.i / {GRID - 1} AS db, -reach / 2.8 + 2 * reach / 2.8 * y.i / {GRID - 1} AS dg FROM kinds, g x, g y)
    SELECT kind, i, j, round({s_sql('db', 'dg')}, 6) AS s FROM p""")
def selection_grid(spark, sf):
    s = C.selection_coef(F.col("delta_beta"), F.col("delta_gamma"))
    return param_grid(spark, sf).select("kind", "i", "j", F.round(s, 6).alias("s"))


@query("convergence_label", f"WITH {V.PARAMS_SQL} SELECT model_id, code, {LABEL_SQL} AS convergence FROM params")
def convergence_label(spark, sf):
    return V.model_params(spark, sf).select("model_id", "code", L.convergence_label(F.col("code")).alias("convergence"))


@query("signed_label", """
    SELECT c_custkey, CASE WHEN abs(x) < 1.5e-8 THEN printf('% .0f', x) ELSE printf('%+.0f', x) END AS label0,
           CASE WHEN abs(x) < 1.5e-8 THEN printf('% .2f', x) ELSE printf('%+.2f', x) END AS label2
    FROM (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE (c_acctbal - 5000) / 64 END::DOUBLE AS x FROM customer)""")
def signed_label(spark, sf):
    x = F.when(F.col("c_acctbal") < 0, 0.0).otherwise((F.col("c_acctbal") - 5000) / 64)
    return V.table(spark, sf, "customer").select(
        "c_custkey", L.signed_label(x, 0).alias("label0"), L.signed_label(x, 2).alias("label2"))


@query("perturbation_label", f"""
    WITH {V.PARAMS_SQL}, mult(m) AS (VALUES (0.8::DOUBLE), (0.9::DOUBLE), (1.0::DOUBLE), (1.1::DOUBLE), (1.2::DOUBLE)),
    x AS (SELECT model_id, m, value / 100 * m AS v, value / 100 AS ref FROM params, mult),
    l AS (SELECT *, CASE WHEN abs(100 * (v - ref) / ref) < 1.5e-8 THEN ' 0' ELSE printf('%+.0f', 100 * (v - ref) / ref) END AS pct,
        regexp_replace(regexp_replace(printf('%.6f', v), '0+$', ''), '\\.$', '') AS shown FROM x)
    SELECT model_id, m AS multiplier, CASE WHEN pct = ' 0' THEN shown ELSE shown || ' (' || pct || '%)' END AS label FROM l""")
def perturbation_label(spark, sf):
    ref = F.col("value") / 100
    rows = expand_values(V.model_params(spark, sf), "multiplier", [0.8, 0.9, 1.0, 1.1, 1.2])
    return rows.select("model_id", "multiplier", L.perturbation_label(ref * F.col("multiplier"), ref).alias("label"))


@query("signif_code", """
    WITH p AS (SELECT event_id, value / 500 AS p FROM events)
    SELECT event_id, CASE WHEN p <= 0 THEN NULL WHEN p <= 0.001 THEN '***' WHEN p <= 0.01 THEN '**' WHEN p <= 0.05 THEN '*'
           WHEN p <= 0.1 THEN '.' WHEN p <= 1 THEN ' ' END AS code,
           CASE WHEN p < 0.001 THEN 'p < 0.001 (***)' WHEN p < 0.01 THEN '0.001 < p < 0.01 (**)'
           WHEN p < 0.05 THEN '0.01 < p < 0.05 (*)' WHEN p < 1 THEN 'p > 0.05 ( )' END AS interval_label FROM p""")
def signif_code(spark, sf):
    p = F.col("value") / 500
    return V.table(spark, sf, "events").select(
        "event_id", L.significance_code(p).alias("code"), L.p_interval(p).alias("interval_label"))


@query("rounding", """
    SELECT o_orderkey, round(o_totalprice / 7, 3) AS r3, floor(o_totalprice / 1000000 / 0.05::DOUBLE) * 0.05::DOUBLE AS floored,
           CASE WHEN o_totalprice = 0 THEN 0 ELSE round(o_totalprice / 7 * pow(10.0, 2 - floor(log10(abs(o_totalprice / 7)))))
           / pow(10.0, 2 - floor(log10(abs(o_totalprice / 7)))) END AS s3 FROM orders""")
def rounding(spark, sf):
    x = F.col("o_totalprice")
    return V.table(spark, sf, "orders").select(
        "o_orderkey", F.round(x / 7, 3).alias("r3"), L.floor_to(x / 1000000, 0.05).alias("floored"),
        L.signif(x / 7, 3).alias("s3"))


@query("percent_to_share", f"""
    WITH {V.counts_sql('week')}
    SELECT region, period, round(round(100 * CAST(n_variant AS DOUBLE) / n_total, 2) / 100, 6) AS fm FROM counts""")
def percent_to_share(spark, sf):
    percent = F.round(100 * F.col("n_variant").cast("double") / F.col("n_total"), 2)
    return V.counts(spark, sf, "week").select("region", "period", F.round(percent / 100, 6).alias("fm"))


# Boxes of the starting values.
BOXES = {"pE": (0.0, 0.01), "exit_rate": (0.0, 1.0), "k": (0.0, 1.0), "a": (0.0, 10.0), "omega": (0.2, 0.8),
         "p": (0.0, 0.1), "eta": (0.0, 1e-4), "mu": (0.0, 0.01)}


@query("uniform_starts", "SELECT p_partkey AS start, " + ", ".join(
    f"round({1000 if hi < 1 else 1} * ({lo}::DOUBLE + ({hi}::DOUBLE - {lo}::DOUBLE) * {uniform_sql('1234', 'p_partkey', repr(n))}), 6) AS \"{n}\""
    for n, (lo, hi) in BOXES.items()) + " FROM part")
def uniform_starts(spark, sf):
    ids = V.table(spark, sf, "part").select(F.col("p_partkey").alias("start"))
    starts = draw_starts(ids, "start", 1234, BOXES)
    return starts.select("start", *[F.round((1000 if hi < 1 else 1) * F.col(n), 6).alias(n) for n, (_, hi) in BOXES.items()])


@query("wild_weights", f"""
    WITH d AS (SELECT o_orderkey, {uniform_sql('456', 'o_orderkey')} AS u, {uniform_sql('456', 'o_orderkey', "'angle'")} AS v FROM orders)
    SELECT o_orderkey, round(u, 9) AS u, {LAWS['Rademacher']}::DOUBLE AS rademacher, round({LAWS['Mammen2']}, 6) AS mammen2,
           round({LAWS['Standard normal']}, 6) AS standard_normal FROM d""")
def wild_weights(spark, sf):
    key = F.col("o_orderkey")
    return V.table(spark, sf, "orders").select(
        "o_orderkey", F.round(hash_uniform(456, key), 9).alias("u"), wild_weight("Rademacher", 456, key).alias("rademacher"),
        F.round(wild_weight("Mammen2", 456, key), 6).alias("mammen2"),
        F.round(wild_weight("Standard normal", 456, key), 6).alias("standard_normal"))

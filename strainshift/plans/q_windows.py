"""Queries of ordered operators, sorts and top-k."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strainshift.operators import integral as I
from strainshift.operators import regression as G
from strainshift.operators import summaries as M
from strainshift.operators import windows as O
from strainshift.operators.align import lookup
from strainshift.plans import views as V
from strainshift.plans.q_joins import week_control
from strainshift.plans.q_rows import SWEEP_SQL, swept
from strainshift.plans.registry import query
from strainshift.session import materialise, task_count


@query("flow_from_cumulative", f"""
    WITH {V.EVENTS_SQL}, s AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY day) AS i FROM daily)
    SELECT series, day, n AS flow FROM s WHERE i > 1""")
def flow_from_cumulative(spark, sf):
    """Running totals, and the daily counts regained from them."""
    run = F.sum("n").over(W.partitionBy("series").orderBy("day"))
    cum = V.daily_events(spark, sf).select("series", "day", run.alias("total"))
    return O.flow_from_cumulative(cum, ["series"], "day", "total", "flow").select("series", "day", "flow")


S_SQL = ("s AS (SELECT region, period, (lead(logit_fm) OVER w - lag(logit_fm) OVER w) / 2 AS s FROM panel"
         " WHERE fm > 0.1 AND logit_fm IS NOT NULL WINDOW w AS (PARTITION BY region ORDER BY period))"
         ", diffs AS (SELECT * FROM s WHERE s IS NOT NULL)")


def selection(spark, sf, unit: str = "month"):
    cells = V.panel(spark, sf, unit).filter((F.col("fm") > 0.1) & F.col("logit_fm").isNotNull())
    return O.selection_coef_diff(cells, ["region"], "period", "logit_fm")


@query("selection_coef_diff", f"""
    WITH {V.panel_sql('week')}, {S_SQL} SELECT region, period, round(s, 6) AS s FROM diffs""")
def selection_coef_diff(spark, sf):
    return selection(spark, sf, "week").withColumn("s", F.round("s", 6))


@query("first_value_region", f"""
    WITH {V.RETAINED_SQL}
    SELECT region, round(arg_min(y, t), 6) AS logit_fm_0, min(t) AS t0 FROM retained GROUP BY 1""")
def first_value_region(spark, sf):
    first = O.first_value(V.retained_panel(spark, sf), ["region"], "t", {"y": "logit_fm_0", "t": "t0"})
    return first.withColumn("logit_fm_0", F.round("logit_fm_0", 6))


MODEL_DAYS_SQL = (
    "f AS (SELECT model_id, day_idx, coalesce(k * pow(psi / 100, a), 0) AS c FROM params, control_idx)"
    ", h AS (SELECT model_id, day_idx, c, sqrt(0.1 * 0.1 + 4 * 0.2 * (1 - c) * 0.25 * 0.75) AS root FROM f)"
    ", pre AS (SELECT model_id, day_idx, (1 - c) / root AS f1, 1 / root AS f2,"
    " coalesce(sum((1 - c) / root) OVER w, 0) AS p1, coalesce(sum(1 / root) OVER w, 0) AS p2 FROM h"
    " WINDOW w AS (PARTITION BY model_id ORDER BY day_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))")


@query("control_prefix_integral", f"""
    WITH {V.RETAINED_SQL}, {V.CONTROL_INDEX_SQL}, {V.PARAMS_SQL}, {MODEL_DAYS_SQL}, pts AS (SELECT DISTINCT t FROM retained)
    SELECT model_id, t, round(p1 + (t - floor(t)) * f1, 4) AS int_f1, round(p2 + (t - floor(t)) * f2, 4) AS int_f2
    FROM pre JOIN pts ON day_idx = floor(t)""")
def control_prefix_integral(spark, sf):
    panel = materialise(V.retained_panel(spark, sf))
    points = G.evaluation_points(panel)
    models = (V.model_params(spark, sf).select("model_id", "k", "a")
              .repartition(task_count(spark), "model_id"))
    ints = I.prefix_integrals(models, I.segment_weights(points, V.control_index(spark, sf)),
                              {"t": F.lit(1.0), "int_f1": F.col("f1"), "int_f2": F.col("f2")})
    return ints.select("model_id", "t", F.round("int_f1", 4).alias("int_f1"), F.round("int_f2", 4).alias("int_f2"))


@query("relative_to_reference", f"""
    WITH {SWEEP_SQL}
    SELECT model_id, fixed_parm, multiplier, round(k * multiplier / nullif(max(CASE WHEN multiplier = 1 THEN k END)
           OVER (PARTITION BY model_id, fixed_parm), 0) - 1, 6) AS estimates_var FROM swept""")
def relative_to_reference(spark, sf):
    rows = swept(spark, sf).select("model_id", "fixed_parm", "multiplier",
                                   (F.col("k") * F.col("multiplier")).alias("estimates"),
                                   (F.col("multiplier") == 1).alias("is_ref"))
    out = O.relative_to_reference(rows, ["model_id", "fixed_parm"], "estimates", "is_ref", "estimates_var")
    return out.select("model_id", "fixed_parm", "multiplier", F.round("estimates_var", 6).alias("estimates_var"))


@query("repeat_index", """
    SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS repeat,
           row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS repeat_in_customer FROM orders""")
def repeat_index(spark, sf):
    orders = V.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    numbered = O.repeat_index(orders, [], ["o_orderkey"])
    return O.repeat_index(numbered, ["o_custkey"], ["o_orderdate", "o_orderkey"], "repeat_in_customer").select(
        "o_orderkey", "repeat", "repeat_in_customer")


@query("rolling_mean7", f"""
    WITH {V.EVENTS_SQL}
    SELECT series, day, round(avg(n) OVER (PARTITION BY series ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS trailing7,
           round(avg(n) OVER (PARTITION BY series ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS centred7 FROM daily""")
def rolling_mean7(spark, sf):
    daily = V.daily_events(spark, sf)
    return daily.select("series", "day", F.round(O.rolling_mean("n", ["series"], "day", 6, 0), 6).alias("trailing7"),
                        F.round(O.rolling_mean("n", ["series"], "day", 3, 3), 6).alias("centred7"))


RESIDUAL_SQL = (
    f"{V.panel_sql()}, {S_SQL}, mc AS (SELECT CAST(date_trunc('month', day) AS DATE) AS period, avg(psi) AS x FROM"
    " (SELECT CAST(l_shipdate AS DATE) AS day, round(1000 * avg(l_discount) + 0.0, 7) AS psi FROM lineitem GROUP BY 1) GROUP BY 1)"
    ", xs AS (SELECT region, period, s, x FROM diffs JOIN mc USING (period))"
    ", fit AS (SELECT region, covar_pop(s, x) / nullif(var_pop(x), 0) AS b, avg(s) AS ms, avg(x) AS mx FROM xs GROUP BY 1)"
    ", res AS (SELECT region, period, s - ms - coalesce(b, 0) * (x - mx) AS e FROM xs JOIN fit USING (region))")


def selection_with_control(spark, sf):
    """Monthly central differences with the mean control index of the month."""
    dim = week_control(spark, sf, "month").withColumnRenamed("psi_mean", "x")
    return lookup(selection(spark, sf), dim, "period").filter("x IS NOT NULL")


def interaction_residuals(spark, sf):
    """Residuals of s ~ region * x: a line per region from group sums."""
    rows = materialise(selection_with_control(spark, sf))
    lines = G.group_sums(rows, [], "region", ["x"], "s")
    slope = F.coalesce(F.try_divide(F.col("c_x_s"), F.nullif("c_x_x", F.lit(0.0))), F.lit(0.0))
    fit = F.col("m_s") + F.col("slope") * (F.col("x") - F.col("m_x"))
    return (rows.join(lines.select("region", "m_s", "m_x", slope.alias("slope")), "region")
            .select("region", "period", (F.col("s") - fit).alias("e")))


@query("lag1_residual_stat", f"""
    WITH {RESIDUAL_SQL}, o AS (SELECT e, lag(e) OVER (ORDER BY region, period) AS before FROM res)
    SELECT COUNT(*) AS n, round(sum(power(e - before, 2)) / nullif(sum(e * e), 0), 6) AS dw FROM o""")
def lag1_residual_stat(spark, sf):
    stat = O.durbin_watson(interaction_residuals(spark, sf), [], "region", "period", "e")
    return stat.select("n", F.round("dw", 6).alias("dw"))


# Rational approximation of the normal quantile (absolute error below 4.5e-4).
NORMAL_NUM = (2.515517, 0.802853, 0.010328)
NORMAL_DEN = (1.0, 1.432788, 0.189269, 0.001308)


def _normal_score_sql(p: str) -> str:
    t = f"sqrt(-2 * ln(least({p}, 1 - {p})))"
    num = f"({NORMAL_NUM[0]} + {NORMAL_NUM[1]} * {t} + {NORMAL_NUM[2]} * {t} * {t})"
    den = f"(1 + {NORMAL_DEN[1]} * {t} + {NORMAL_DEN[2]} * {t} * {t} + {NORMAL_DEN[3]} * {t} * {t} * {t})"
    return f"(CASE WHEN {p} < 0.5 THEN -1 ELSE 1 END * ({t} - {num} / {den}))"


def normal_score(p):
    """Normal quantile of a share, from the rational approximation."""
    t = F.sqrt(-2 * F.ln(F.least(p, 1 - p)))
    num = sum((c * F.pow(t, F.lit(float(i))) for i, c in enumerate(NORMAL_NUM)), F.lit(0.0))
    den = sum((c * F.pow(t, F.lit(float(i))) for i, c in enumerate(NORMAL_DEN)), F.lit(0.0))
    return F.when(p < 0.5, -1.0).otherwise(1.0) * (t - num / den)


@query("normal_scores", f"""
    WITH {RESIDUAL_SQL},
    r AS (SELECT region, e, (row_number() OVER (PARTITION BY region ORDER BY e, period) - 0.375)::DOUBLE
          / (COUNT(*) OVER (PARTITION BY region) + 0.25::DOUBLE) AS p FROM res),
    z AS (SELECT region, e, {_normal_score_sql('p')} AS z FROM r)
    SELECT region, COUNT(*) AS n, round(power(covar_pop(e, z), 2) / nullif(var_pop(e) * var_pop(z), 0), 6) AS w FROM z GROUP BY 1""")
def normal_scores(spark, sf):
    """Squared correlation of ordered residuals with normal scores, per region."""
    out = M.normal_scores(interaction_residuals(spark, sf), ["region"], "e", ["period"], normal_score)
    return out.withColumn("w", F.round("w", 6))


@query("order_results", f"""
    WITH {V.PARAMS_SQL} SELECT model_id, value FROM params ORDER BY model_id""")
def order_results(spark, sf):
    return V.model_params(spark, sf).select("model_id", "value").orderBy("model_id")


PART_RSS_SQL = "SELECT l_partkey AS model_id, round(var_pop(l_quantity) * COUNT(*), 6) AS rss FROM lineitem GROUP BY 1"


def part_rss(spark, sf):
    return V.table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("model_id")).agg(
        F.round(F.var_pop("l_quantity") * F.count(F.lit(1)), 6).alias("rss"))


@query("rank_by_rss", f"""
    WITH r AS ({PART_RSS_SQL}) SELECT model_id, rss FROM r ORDER BY rss DESC, model_id""")
def rank_by_rss(spark, sf):
    return part_rss(spark, sf).orderBy(F.desc("rss"), "model_id")


@query("drop_worst", f"""
    WITH r AS ({PART_RSS_SQL}) SELECT model_id, rss FROM r
    QUALIFY row_number() OVER (ORDER BY rss DESC, model_id) > 1""")
def drop_worst(spark, sf):
    return O.drop_worst(materialise(part_rss(spark, sf)), "rss", "model_id")


@query("topk_candidates", f"""
    WITH {V.PARAMS_SQL}, t AS (SELECT brand, model_id, value, row_number() OVER (PARTITION BY brand ORDER BY value, model_id) AS i,
        row_number() OVER (ORDER BY value, model_id) AS g FROM params WHERE code = 0)
    SELECT brand AS grp, model_id, value FROM t WHERE i <= 5 UNION ALL SELECT 'all', model_id, value FROM t WHERE g <= 10""")
def topk_candidates(spark, sf):
    fits = V.model_params(spark, sf).filter("code = 0").select(F.col("brand").alias("grp"), "model_id", "value")
    per_group = O.top_k(fits, ["grp"], ["value", "model_id"], 5)
    overall = O.top_k(fits, [], ["value", "model_id"], 10).withColumn("grp", F.lit("all"))
    return per_group.unionByName(overall)


@query("bottom_of_profile", f"""
    WITH {V.PARAMS_SQL}, w AS (SELECT kind, round(k, 6) AS parm, min(CASE WHEN code = 0 THEN value END) AS wls FROM params GROUP BY 1, 2)
    SELECT kind, parm, wls FROM w WHERE wls = (SELECT min(wls) FROM w v WHERE v.kind = w.kind)""")
def bottom_of_profile(spark, sf):
    profile = V.model_params(spark, sf).groupBy("kind", F.round("k", 6).alias("parm")).agg(
        F.min(F.when(F.col("code") == 0, F.col("value"))).alias("wls"))
    return O.bottom_rows(profile, ["kind"], "wls")


"""Queries of calendars, alignment, lookups and grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from strainshift.functions import control as C
from strainshift.operators import align as A
from strainshift.operators import integral as I
from strainshift.operators.expand import expand_range
from strainshift.plans import views as V
from strainshift.plans.q_rows import REF, SWEEP_SQL, VALUE_SQL, fixed_value, swept
from strainshift.plans.registry import query
from strainshift.session import materialise


def _day(unit_ts):
    return F.to_date(unit_ts)


@query("calendar", """
    SELECT CAST(unnest(generate_series(CAST(min(l_shipdate) AS DATE), CAST(max(l_shipdate) AS DATE), INTERVAL 1 DAY)) AS DATE)
           AS day FROM lineitem""")
def calendar(spark, sf):
    days = V.table(spark, sf, "lineitem").select(_day("l_shipdate").alias("day"))
    return A.calendar(A.date_bounds(days, "day"), "first_day", "last_day")


ALIGN_DAYS_SQL = ("days AS (SELECT CAST(unnest(generate_series(CAST(min(o_orderdate) AS DATE) - 3,"
                  " CAST(max(o_orderdate) AS DATE), INTERVAL 1 DAY)) AS DATE) AS day FROM orders)")


def _order_days(spark, sf):
    days = V.table(spark, sf, "orders").select(_day("o_orderdate").alias("day"))
    return A.calendar(A.date_bounds(days, "day", before=3), "first_day", "last_day")


@query("calendar_align", f"""
    WITH {ALIGN_DAYS_SQL}, firsts AS (SELECT CAST(o_orderdate AS DATE) AS day, arg_min(o_totalprice, o_orderkey) AS total,
        arg_min(o_custkey, o_orderkey) AS customer FROM orders GROUP BY 1)
    SELECT day, total, customer FROM days LEFT JOIN firsts USING (day)""")
def calendar_align(spark, sf):
    """The first order of each day on the calendar of all days."""
    orders = V.table(spark, sf, "orders").select(
        _day("o_orderdate").alias("day"), F.col("o_totalprice").alias("total"), F.col("o_custkey").alias("customer"),
        "o_orderkey")
    return A.calendar_align(_order_days(spark, sf), orders, "day", "o_orderkey", ["total", "customer"])


@query("multi_series_align", f"""
    WITH {ALIGN_DAYS_SQL}, s AS (SELECT CAST(o_orderdate AS DATE) AS day, COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS neg,
        COUNT(*) FILTER (WHERE o_orderstatus = 'O') AS pos, COUNT(*) FILTER (WHERE o_orderstatus = 'P') AS dead
        FROM orders GROUP BY 1)
    SELECT day, nullif(neg, 0) AS negative_tests, nullif(pos, 0) AS positive_tests, nullif(dead, 0) AS deaths
    FROM days LEFT JOIN s USING (day)""")
def multi_series_align(spark, sf):
    orders = V.table(spark, sf, "orders").select(_day("o_orderdate").alias("day"), "o_orderstatus")
    counts = A.series_counts(orders, "day", "o_orderstatus", {"negative_tests": "F", "positive_tests": "O", "deaths": "P"})
    return A.lookup(_order_days(spark, sf), counts, "day")


WEEK_CONTROL_SQL = (V.CONTROL_SQL + ", week_control AS (SELECT CAST(date_trunc('week', day) AS DATE) AS period,"
                    " avg(psi) AS psi_mean FROM control GROUP BY 1)")


def week_control(spark, sf, unit: str = "week"):
    return (V.daily_control(spark, sf).groupBy(V.period_of("day", unit).alias("period"))
            .agg(F.avg("psi").alias("psi_mean")))


@query("lookup_week_mean", f"""
    WITH {V.panel_sql('week')}, {WEEK_CONTROL_SQL}
    SELECT region, period, round(fm, 6) AS fm, round(psi_mean, 6) AS psi_mean
    FROM panel LEFT JOIN week_control USING (period)""")
def lookup_week_mean(spark, sf):
    cells = V.panel(spark, sf, "week").select("region", "period", F.round("fm", 6).alias("fm"))
    return A.lookup(cells, week_control(spark, sf), "period").withColumn("psi_mean", F.round("psi_mean", 6))


@query("sparse_assign", f"""
    WITH {V.counts_sql('week', True)}, b AS (SELECT min(period) AS lo, max(period) + 6 AS hi FROM counts),
    days AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM b)
    SELECT day, n_total AS cases, n_variant AS variant_cases FROM days LEFT JOIN counts ON period = day""")
def sparse_assign(spark, sf):
    weekly = V.counts(spark, sf, "week", national=True)
    days = A.calendar(A.date_bounds(weekly, "period", after=6), "first_day", "last_day")
    return days.join(weekly, days["day"] == weekly["period"], "left").select(
        "day", F.col("n_total").alias("cases"), F.col("n_variant").alias("variant_cases"))


@query("composite_key_join", f"""
    WITH {SWEEP_SQL}
    SELECT model_id, fixed_parm, multiplier, round({VALUE_SQL}, 6) AS fixed_parm_value, round(k, 6) AS k, round(a, 6) AS a
    FROM swept""")
def composite_key_join(spark, sf):
    """Long rows of k and of a, paired again by the identity of the perturbation."""
    rows = swept(spark, sf).withColumn("fixed_parm_value", fixed_value())
    long = rows.select("model_id", "fixed_parm", "multiplier", "fixed_parm_value", "k", "a").unpivot(
        ["model_id", "fixed_parm", "multiplier", "fixed_parm_value"], ["k", "a"], "estim_parm", "estimates")
    keys = ["model_id", "fixed_parm", "multiplier"]
    k = long.filter("estim_parm = 'k'").select(*keys, "fixed_parm_value", F.col("estimates").alias("k"))
    a = long.filter("estim_parm = 'a'").select(*keys, F.col("estimates").alias("a"))
    return A.composite_key_join(k, a, keys).withColumns(
        {c: F.round(c, 6) for c in ("fixed_parm_value", "k", "a")})


@query("ref_value_lookup", f"""
    WITH {SWEEP_SQL}, ref(fixed_parm, ref_value) AS (VALUES ('R0', 2.5::DOUBLE), ('kappa', 0.2::DOUBLE), ('gamma', 0.1::DOUBLE), ('SN0', 0.9::DOUBLE))
    SELECT model_id, fixed_parm, multiplier, ref_value, round({VALUE_SQL} / ref_value - 1, 6) AS change
    FROM swept JOIN ref USING (fixed_parm)""")
def ref_value_lookup(spark, sf):
    ref = F.create_map(*[x for n, v in REF.items() for x in (F.lit(n), F.lit(v))])
    rows = swept(spark, sf).withColumn("ref_value", ref[F.col("fixed_parm")])
    return rows.select("model_id", "fixed_parm", "multiplier", "ref_value",
                       F.round(fixed_value() / F.col("ref_value") - 1, 6).alias("change"))


@query("columnbind_keyed", f"""
    WITH {V.counts_sql('week')}, taq AS (SELECT r_name AS region, CAST(date_trunc('week', l_shipdate) AS DATE) AS period,
        COUNT(*) AS n_taqpath FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2)
    SELECT region, period, n_total, n_variant, n_taqpath FROM counts JOIN taq USING (region, period)""")
def columnbind_keyed(spark, sf):
    places = (V.table(spark, sf, "supplier")
              .join(V.table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
              .join(V.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
              .select("s_suppkey", F.col("r_name").alias("region")))
    taq = (V.table(spark, sf, "lineitem").select("l_suppkey", V.period_of("l_shipdate", "week").alias("period"))
           .join(places, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("region", "period")
           .agg(F.count(F.lit(1)).alias("n_taqpath")))
    return V.counts(spark, sf, "week").join(taq, ["region", "period"])


@query("cross_ensemble", f"""
    WITH {V.PARAMS_SQL}
    SELECT model_id AS replicate, lev AS psi, round(k * pow(lev / 100.0, a), 6) AS c
    FROM params, (SELECT CAST(unnest(generate_series(0, 100)) AS INTEGER) AS lev)""")
def cross_ensemble(spark, sf):
    pairs = V.model_params(spark, sf).select(F.col("model_id").alias("replicate"), "k", "a")
    curve = C.effectiveness(F.col("psi"), F.col("k"), F.col("a"))
    return expand_range(pairs, "psi", 0, 100).select("replicate", "psi", F.round(curve, 6).alias("c"))


GRID = 300  # points per axis


@query("cross_param_grid", f"""
    WITH kinds AS (SELECT p_type AS kind, max(p_size) / 142.0::DOUBLE AS reach FROM part GROUP BY 1),
    g AS (SELECT CAST(unnest(generate_series(0, {GRID - 1})) AS INTEGER) AS i)
    SELECT kind, x.i, y.i AS j, round(-reach + 2 * reach * x.i / {GRID - 1}, 6) AS delta_beta,
           round(-reach / 2.8 + 2 * reach / 2.8 * y.i / {GRID - 1}, 6) AS delta_gamma FROM kinds, g x, g y""")
def cross_param_grid(spark, sf):
    return param_grid(spark, sf).withColumns({c: F.round(c, 6) for c in ("delta_beta", "delta_gamma")}) \
        .select("kind", "i", "j", "delta_beta", "delta_gamma")


def param_grid(spark, sf, points: int = GRID):
    """A square grid of both effects per type of part, as wide as the sizes of its parts."""
    reach = V.table(spark, sf, "part").groupBy(F.col("p_type").alias("kind")).agg(
        (F.max("p_size") / F.lit(142.0)).alias("reach"))
    grid = expand_range(expand_range(reach, "i", 0, points - 1), "j", 0, points - 1)
    r, last = F.col("reach"), points - 1
    return grid.withColumns({"delta_beta": -r + 2 * r * F.col("i") / last,
                             "delta_gamma": -r / 2.8 + 2 * r / 2.8 * F.col("j") / last})


@query("control_interval_join", f"""
    WITH {V.RETAINED_SQL}, {V.CONTROL_INDEX_SQL},
    spans AS (SELECT region, period, t AS hi, min(t) OVER (PARTITION BY region) AS lo FROM retained),
    f AS (SELECT day_idx, coalesce({C.BEST_K} * pow(psi / 100, {C.BEST_A}), 0) AS c FROM control_idx),
    d AS (SELECT region, period, lo, hi, unnest(generate_series(CAST(floor(lo) AS INTEGER),
        CAST(greatest(ceil(hi) - 1, floor(lo)) AS INTEGER))) AS day_idx FROM spans),
    h AS (SELECT d.*, coalesce(c, 0) AS c, sqrt(0.1 * 0.1 + 4 * 0.2 * (1 - coalesce(c, 0)) * 0.25 * 0.75) AS root FROM d LEFT JOIN f USING (day_idx))
    SELECT region, period, round(sum((1 - c) / root * (least(hi, day_idx + 1) - greatest(lo, day_idx))), 5) AS f1,
           round(sum(1 / root * (least(hi, day_idx + 1) - greatest(lo, day_idx))), 5) AS f2 FROM h GROUP BY 1, 2""")
def control_interval_join(spark, sf):
    panel = materialise(V.retained_panel(spark, sf))
    first = panel.groupBy("region").agg(F.min("t").alias("lo"))
    spans = panel.join(first, "region").select("region", "period", "lo", F.col("t").alias("hi"))
    daily = I.daily_integrands(V.control_index(spark, sf).withColumns(
        {"k": F.lit(C.BEST_K), "a": F.lit(C.BEST_A)}))
    return I.interval_integrals(spans, daily, ["f1", "f2"], missing=I.uncontrolled()).select(
        "region", "period", F.round("f1", 5).alias("f1"), F.round("f2", 5).alias("f2"))



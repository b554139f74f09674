"""Queries of scores, block means, quantiles and other aggregates."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strainshift.operators import align as A
from strainshift.operators import score as S
from strainshift.operators import summaries as M
from strainshift.operators.expand import expand_blocks
from strainshift.plans import views as V
from strainshift.plans.registry import query
from strainshift.session import materialise, task_count

# Daily counts of three event types as the three observed series; t counts days from 1.
SERIES = {"view": "negative", "click": "positive", "error": "deaths"}
OBS_SQL = (V.EVENTS_SQL + ", obs AS (SELECT CASE series WHEN 'view' THEN 'negative' WHEN 'click' THEN 'positive' ELSE 'deaths' END AS series,"
           " day, date_diff('day', (SELECT min(day) FROM daily), day) + 1 AS t, n AS value"
           " FROM daily WHERE series IN ('view', 'click', 'error'))"
           ", level AS (SELECT series, avg(value) AS base FROM obs GROUP BY 1)"
           ", points AS (SELECT series, day, t, value, base FROM obs JOIN level USING (series))")


def observations(spark, sf):
    """series, day, t, value and the mean of the series as its base level."""
    daily = V.daily_events(spark, sf)
    names = F.create_map(*[x for k, v in SERIES.items() for x in (F.lit(k), F.lit(v))])
    first = daily.agg(F.min("day")).scalar()
    obs = daily.filter(F.col("series").isin(*SERIES)).select(
        names[F.col("series")].alias("series"), "day", (F.date_diff("day", first) + 1).alias("t"),
        F.col("n").alias("value"))
    level = obs.groupBy("series").agg(F.avg("value").alias("base"))
    return obs.join(level, "series")


def candidates(spark, sf):
    """A candidate line per part: mu and eta scale the base level of each series."""
    size = F.col("p_size").cast("double")
    return V.table(spark, sf, "part").select(
        F.col("p_partkey").alias("candidate"), (0.5 + size / 51).alias("mu"),
        ((F.col("p_retailprice") - 950) / 5000).alias("eta"))


CANDIDATES_SQL = ("cand AS (SELECT p_partkey AS candidate, 0.5 + p_size / 51.0::DOUBLE AS mu,"
                  " (p_retailprice - 950) / 5000 AS eta FROM part)")
LOSS_SQL = ("lost AS (SELECT candidate, series, power(value - base * (mu + eta * t), 2)"
            " / greatest(base * (mu + eta * t), greatest(0.001, (SELECT min(value) FROM obs))) AS loss"
            " FROM cand, points)")


def expected_line():
    return F.col("base") * (F.col("mu") + F.col("eta") * F.col("t"))


def predictions(spark, sf):
    """Expected value per candidate, day and series, as a trajectory table would give it."""
    obs = materialise(observations(spark, sf))
    ids = candidates(spark, sf).repartition(task_count(spark), "candidate")
    spread = expand_blocks(ids, obs.select("series", "day", "t", "base"))
    return obs.select("series", "day", "value"), spread.select(
        "candidate", "series", "day", expected_line().alias("expected"))


@query("wls_score", f"""
    WITH {OBS_SQL}, {CANDIDATES_SQL}, {LOSS_SQL}
    SELECT candidate, round(sum(loss), 4) AS score FROM lost GROUP BY 1""")
def wls_score(spark, sf):
    obs, expected = predictions(spark, sf)
    losses = S.point_losses(obs, expected, ["series", "day"])
    return S.wls_score(losses, ["candidate"]).withColumn("score", F.round("score", 4))


@query("wls_by_series", f"""
    WITH {OBS_SQL}, {CANDIDATES_SQL}, {LOSS_SQL}
    SELECT candidate, series, round(sum(loss), 4) AS score FROM lost GROUP BY GROUPING SETS ((candidate, series), (candidate))""")
def wls_by_series(spark, sf):
    obs, expected = predictions(spark, sf)
    losses = S.point_losses(obs, expected, ["series", "day"])
    return S.wls_by_series(losses, ["candidate"]).withColumn("score", F.round("score", 4))


@query("best_candidate", f"""
    WITH {V.PARAMS_SQL}, ok AS (SELECT * FROM params WHERE code = 0 AND value IS NOT NULL)
    SELECT 'first' AS ties, brand, arg_min(model_id, (value, model_id)) AS model_id, min(value) AS value FROM ok GROUP BY brand
    UNION ALL SELECT 'all', brand, model_id, value FROM ok
    WHERE value = (SELECT min(value) FROM ok o WHERE o.brand = ok.brand)""")
def best_candidate(spark, sf):
    fits = V.model_params(spark, sf).select("brand", "model_id", "value", "code")
    ok = F.col("code") == 0
    first = S.best_candidate(fits, ["brand"], "value", "model_id", ok).drop("code")
    ties = S.all_minima(fits.filter(ok & F.col("value").isNotNull()).drop("code"), ["brand"], "value")
    return first.withColumn("ties", F.lit("first")).unionByName(ties.withColumn("ties", F.lit("all")))


@query("bootstrap_best_start", f"""
    WITH starts AS (SELECT o_custkey AS replicate, o_totalprice AS value, o_orderkey % 3 AS code,
        o_orderkey AS start FROM orders),
    ok AS (SELECT replicate, arg_min(start, (value, start)) AS start, min(value) AS value FROM starts WHERE code = 0 GROUP BY 1)
    SELECT replicate, CASE WHEN start IS NULL THEN 'No convergence' ELSE 'Successful completion' END AS convergence,
           value, start FROM (SELECT DISTINCT replicate FROM starts) LEFT JOIN ok USING (replicate)""")
def bootstrap_best_start(spark, sf):
    starts = V.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("replicate"), F.col("o_totalprice").alias("value"),
        (F.col("o_orderkey") % 3).alias("code"), F.col("o_orderkey").alias("start"))
    return S.best_start(starts, "replicate", "value", "code", ["start"])


@query("weekly_mean_blocks", f"""
    WITH {V.CONTROL_SQL}, w AS (SELECT CAST(date_trunc('week', min(o_orderdate)) AS DATE) - 7 AS lo FROM orders),
    b AS (SELECT lo, date_diff('day', lo, day) // 7 AS b, psi FROM control, w WHERE day >= lo)
    SELECT lo + CAST(7 * b AS INTEGER) AS week, round(avg(psi) + 0.0, 4) AS block_mean FROM b GROUP BY lo, b
    HAVING COUNT(psi) = 7""")
def weekly_mean_blocks(spark, sf):
    origin = (V.table(spark, sf, "orders")
              .agg(F.date_sub(F.min(V.period_of("o_orderdate", "week")), 7)).scalar())
    return (A.block_means(V.daily_control(spark, sf), "day", "psi", origin)
            .withColumn("block_mean", F.round(F.col("block_mean") + 0.0, 4)))


@query("centred_mean_scalar", """
    WITH d AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, o_totalprice AS x FROM orders),
    mid AS (SELECT o_custkey, min(day) + 3 AS day FROM d GROUP BY 1)
    SELECT d.o_custkey, COUNT(*) AS n, round(avg(x), 3) AS centred_mean FROM d JOIN mid ON d.o_custkey = mid.o_custkey
    AND d.day BETWEEN mid.day - 3 AND mid.day + 3 GROUP BY 1""")
def centred_mean_scalar(spark, sf):
    """Seven-day mean around the fourth day of each customer."""
    rows = V.table(spark, sf, "orders").select("o_custkey", F.to_date("o_orderdate").alias("day"), "o_totalprice")
    daily = rows.groupBy("o_custkey", "day").agg(F.sum("o_totalprice").alias("s"), F.count("o_totalprice").alias("c"),
                                                 F.count(F.lit(1)).alias("n"))
    mid = F.date_add(F.min("day").over(W.partitionBy("o_custkey")), 3)
    near = daily.withColumn("gap", F.date_diff("day", mid)).filter("gap between -3 and 3")
    whole = F.sum("c") == F.sum("n")
    return near.groupBy("o_custkey").agg(
        F.sum("n").alias("n"), F.round(F.when(whole, F.sum("s") / F.sum("c")), 3).alias("centred_mean"))


@query("date_bounds", """
    SELECT o_custkey, CAST(min(date_trunc('week', o_orderdate)) AS DATE) AS first_week,
           CAST(max(date_trunc('week', o_orderdate)) AS DATE) AS last_week FROM orders GROUP BY 1""")
def date_bounds(spark, sf):
    week = V.period_of("o_orderdate", "week")
    return V.table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.min(week).alias("first_week"), F.max(week).alias("last_week"))


@query("first_crossing", f"""
    WITH {V.panel_sql('week')}
    SELECT region, min(period) AS first_period, min(period) - 1 AS phase_end FROM panel WHERE fm > 0.35 GROUP BY 1""")
def first_crossing(spark, sf):
    return A.first_crossing(V.panel(spark, sf, "week"), "period", "fm", 0.35, ["region"])


@query("distinct_regions", f"""
    WITH {V.counts_sql('week')}
    SELECT region, COUNT(*) AS n_weeks, (SELECT COUNT(DISTINCT region) FROM counts) AS n_regions FROM counts GROUP BY 1""")
def distinct_regions(spark, sf):
    regions = V.counts(spark, sf, "week").groupBy("region").agg(F.count(F.lit(1)).alias("n_weeks"))
    return regions.withColumn("n_regions", F.count("region").over(W.partitionBy(F.lit(0))))  # a row per region


@query("quantile_ci", """
    SELECT event_type AS param, round(quantile_cont(value, 0.025), 6) AS lower, round(quantile_cont(value, 0.5), 6) AS median,
           round(quantile_cont(value, 0.975), 6) AS upper FROM events GROUP BY 1""")
def quantile_ci(spark, sf):
    q = M.exact_quantiles(V.table(spark, sf, "events").withColumnRenamed("event_type", "param"),
                          ["param"], "value", [.025, .5, .975])
    return q.select("param", *[F.round(F.element_at("q", i + 1), 6).alias(n)
                               for i, n in enumerate(("lower", "median", "upper"))])


@query("five_number_summary", """
    SELECT event_type AS param, COUNT(value) AS n, min(value) AS min, round(quantile_cont(value, 0.25), 6) AS q1,
           round(quantile_cont(value, 0.5), 6) AS median, round(avg(value), 6) AS mean,
           round(quantile_cont(value, 0.75), 6) AS q3, max(value) AS max, round(stddev_samp(value), 6) AS sd
    FROM events GROUP BY 1""")
def five_number_summary(spark, sf):
    s = M.five_number_summary(V.table(spark, sf, "events").withColumnRenamed("event_type", "param"), ["param"], "value")
    return s.withColumns({c: F.round(c, 6) for c in ("q1", "median", "mean", "q3", "sd")})


CORR_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("corr_matrix", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT l_returnflag AS distrib, '{p}' AS p, '{q}' AS q, round(covar_pop({p}, {q}) / nullif(sqrt(var_pop({p}) * var_pop({q})), 0), 6) AS r "
    "FROM lineitem GROUP BY 1" for i, p in enumerate(CORR_COLUMNS) for q in CORR_COLUMNS[i + 1:]) + ")")
def corr_matrix(spark, sf):
    rows = V.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("distrib"), *CORR_COLUMNS)
    return M.corr_matrix(rows, ["distrib"], CORR_COLUMNS).withColumn("r", F.round("r", 6))


@query("rss", """
    WITH m AS (SELECT l_partkey AS model_id, avg(l_extendedprice / 1000) AS fit FROM lineitem GROUP BY 1)
    SELECT l_partkey AS model_id, round(sum(power(l_extendedprice / 1000 - fit, 2)), 4) AS rss FROM lineitem JOIN m ON l_partkey = model_id
    GROUP BY 1""")
def rss(spark, sf):
    """Residual squares about the mean of each part; one pass, centred as it goes."""
    x = F.col("l_extendedprice") / 1000
    return V.table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("model_id")).agg(
        F.round(F.var_pop(x) * F.count(x), 4).alias("rss"))


@query("prevalence_total", f"""
    WITH d AS (SELECT CAST(ts AS DATE) AS day, COUNT(*) FILTER (WHERE event_type = 'view') AS s, COUNT(*) FILTER (WHERE event_type = 'signup') AS e,
        COUNT(*) FILTER (WHERE event_type = 'click') AS ia, COUNT(*) FILTER (WHERE event_type = 'purchase') AS isr,
        COUNT(*) FILTER (WHERE event_type = 'error') AS isd FROM events GROUP BY 1)
    SELECT day, ia + isr + isd AS prevalence, s + e + ia + isr + isd AS total FROM d""")
def prevalence_total(spark, sf):
    wide = (V.table(spark, sf, "events").groupBy(F.to_date("ts").alias("day"))
            .pivot("event_type", ["view", "signup", "click", "purchase", "error"]).count().na.fill(0))
    sick = F.col("click") + F.col("purchase") + F.col("error")
    return wide.select("day", sick.alias("prevalence"), (F.col("view") + F.col("signup") + sick).alias("total"))

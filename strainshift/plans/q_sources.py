"""Queries of the scans and sinks: tables are written in the input formats and read back."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strainshift.plans import views as V
from strainshift.plans.registry import query
from strainshift.session import scratch_path
from strainshift.sources import sinks, tables

# A header of parameter files, in which two parameters have other names.
EARLY_NAMES = {"v": "exit_rate", "exit_rate": "eta"}
FIT_COLUMNS = ["Repeat", "Value", "Convergence", "pE", "v", "k", "a", "omega", "p", "exit_rate", "mu", "R0", "group"]


@query("scan_tests", f"""
    WITH {V.EVENTS_SQL}
    SELECT series AS entity, upper(substr(series, 1, 3)) AS code, day,
           CASE WHEN n % 7 = 0 THEN NULL ELSE CAST(n AS INTEGER) END AS new_tests,
           'tests performed' AS annotations, round(value7, 5) AS new_cases FROM daily""")
def scan_tests(spark, sf):
    source = V.daily_events(spark, sf).select(
        F.col("series").alias("Entity"), F.upper(F.substring("series", 1, 3)).alias("Code"),
        F.col("day").alias("Day"),
        F.when(F.col("n") % 7 != 0, F.col("n")).cast("int").alias("new_tests_7day_smoothed"),
        F.lit("tests performed").alias("142752-annotations"),
        F.round("value7", 5).alias(tables.CASES_HEADER))
    return tables.read_tests(spark, sinks.write_csv(source, scratch_path(spark, "tests")))


@query("scan_decimal_comma", f"""
    WITH {V.EVENTS_SQL}
    SELECT 'overview' AS area_type, series AS area, 'K' || length(series) AS area_code, day,
           CAST(n AS INTEGER) AS new_deaths,
           CAST(sum(n) OVER (PARTITION BY series ORDER BY day) AS INTEGER) AS cum_deaths,
           CASE WHEN n % 7 = 0 THEN NULL ELSE round(value7, 4) END AS average7 FROM daily""")
def scan_decimal_comma(spark, sf):
    cum = F.sum("n").over(W.partitionBy("series").orderBy("day"))
    text = F.regexp_replace(F.round("value7", 4).cast("string"), "\\.", ",")
    source = V.daily_events(spark, sf).select(
        F.lit("overview").alias("areaType"), F.col("series").alias("areaName"),
        F.concat(F.lit("K"), F.length("series")).alias("areaCode"), F.col("day").alias("date"),
        F.col("n").cast("int").alias("newDailyNsoDeathsByDeathDate"),
        cum.cast("int").alias("cumDailyNsoDeathsByDeathDate"),
        F.when(F.col("n") % 7 == 0, "NA").otherwise(text).alias("7-day_average"))
    return tables.read_deaths(spark, sinks.write_csv(source, scratch_path(spark, "deaths")))


@query("scan_control", """
    SELECT l_returnflag AS entity, 'flag' AS code, CAST(l_shipdate AS DATE) AS day,
           round(1000 * avg(l_discount) + 0.0, 5) AS psi FROM lineitem GROUP BY 1, 3""")
def scan_control(spark, sf):
    source = (V.table(spark, sf, "lineitem")
              .groupBy(F.col("l_returnflag").alias("Entity"), F.to_date("l_shipdate").alias("Day"))
              .agg(F.round(1000 * F.avg("l_discount") + 0.0, 5).alias("stringency_index"))
              .select("Entity", F.lit("flag").alias("Code"), "Day", "stringency_index"))
    return tables.read_control(spark, sinks.write_csv(source, scratch_path(spark, "control")))


@query("scan_regional", f"""
    WITH {V.counts_sql('week')}
    SELECT region, period AS week, CAST(n_total - n_variant AS INTEGER) AS n_other,
           CAST(n_variant AS INTEGER) AS n_variant,
           round(100 * CAST(n_total - n_variant AS DOUBLE) / n_total, 4) AS pct_other,
           round(100 * CAST(n_variant AS DOUBLE) / n_total, 4) AS pct_variant FROM counts""")
def scan_regional(spark, sf):
    other = F.col("n_total") - F.col("n_variant")
    source = V.counts(spark, sf, "week").select(
        F.col("region").alias("Region"), F.date_format("period", "dd/MM/yyyy").alias("week"),
        other.cast("int").alias("n_Confirmed S-gene"), F.col("n_variant").cast("int").alias("n_Confirmed SGTF"),
        F.round(100 * other.cast("double") / F.col("n_total"), 4).alias("percent_Confirmed S-gene"),
        F.round(100 * F.col("n_variant").cast("double") / F.col("n_total"), 4).alias("percent_Confirmed SGTF"))
    return tables.read_regional(spark, sinks.write_csv(source, scratch_path(spark, "regional")))


def _fit_rows(spark, sf):
    ok = F.col("code") == 0
    return V.model_params(spark, sf).select(
        F.col("model_id").alias("Repeat"), F.when(ok, F.col("value")).alias("Value"),
        F.when(ok, "Successful completion").otherwise("No convergence").alias("Convergence"),
        F.col("pE"), F.col("exit_rate").alias("v"), F.col("k"), F.col("a"), F.col("omega"), F.col("p"),
        F.col("eta").alias("exit_rate"), F.col("mu"), F.lit(2.5).alias("R0"), F.col("brand").alias("group"))


@query("scan_param_table", f"""
    WITH {V.PARAMS_SQL}
    SELECT model_id AS "Repeat", CASE WHEN code = 0 THEN value END AS "Value",
           CASE WHEN code = 0 THEN 'Successful completion' ELSE 'No convergence' END AS "Convergence",
           round(pE, 6) AS "pE", round(exit_rate, 6) AS exit_rate, round(k, 6) AS k, round(a, 6) AS a,
           round(omega, 6) AS omega, round(p, 6) AS p, round(1000 * eta, 6) AS eta_permille,
           round(mu, 6) AS mu, 2.5::DOUBLE AS "R0", brand AS "group" FROM params""")
def scan_param_table(spark, sf):
    path = scratch_path(spark, "fits")
    _fit_rows(spark, sf).write.option("header", True).option("nullValue", "NA").csv(path)
    df = tables.read_params(spark, path, FIT_COLUMNS, EARLY_NAMES)
    return df.select("Repeat", "Value", "Convergence",
                     *[F.round(c, 6).alias(c) for c in ("pE", "exit_rate", "k", "a", "omega", "p", "mu")],
                     F.round(1000 * F.col("eta"), 6).alias("eta_permille"), "R0", "group")


# Reference values of the varied parameters.
VARIED = {"R0": 2.5, "kappa": 0.2, "gamma": 0.1, "SN0": 0.9}


@query("scan_union_sources", f"""
    WITH {V.PARAMS_SQL},
    varied(fixed_parm, ref) AS (VALUES ('R0', 2.5::DOUBLE), ('kappa', 0.2::DOUBLE), ('gamma', 0.1::DOUBLE), ('SN0', 0.9::DOUBLE))
    SELECT fixed_parm, model_id AS "Repeat", value AS "Value", round(k, 6) AS k, round(a, 6) AS a,
           round(ref * (0.8 + 0.1 * (model_id % 5)), 6) AS fixed_parm_value FROM params, varied""")
def scan_union_sources(spark, sf):
    paths = {}
    for name, ref in VARIED.items():
        part = V.model_params(spark, sf).select(
            F.col("model_id").alias("Repeat"), F.col("value").alias("Value"), "k", "a",
            (ref * (0.8 + 0.1 * (F.col("model_id") % 5))).alias(name))
        paths[name] = sinks.write_csv(part, scratch_path(spark, f"sweep-{name}"))
    df = tables.read_sweeps(spark, paths, ["Repeat", "Value", "k", "a"])
    return df.select("fixed_parm", "Repeat", "Value", F.round("k", 6).alias("k"), F.round("a", 6).alias("a"),
                     F.round("fixed_parm_value", 6).alias("fixed_parm_value"))


@query("sink_table", f"""
    WITH {V.PARAMS_SQL}
    SELECT brand, COUNT(*) AS n, round(sum(value), 2) AS total, 'part' AS source FROM params GROUP BY 1""")
def sink_table(spark, sf):
    path = sinks.write_table(V.model_params(spark, sf).withColumn("source", F.lit("part")),
                             scratch_path(spark, "fit-table"), ["brand"])
    return (sinks.read_table(spark, path).groupBy("brand", "source")
            .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")))


@query("sink_checkpoint", f"""
    WITH {V.PARAMS_SQL}
    SELECT code, COUNT(*) AS n, COUNT(DISTINCT model_id) AS n_ids, round(sum(k * 0.5), 4) AS total
    FROM params GROUP BY 1""")
def sink_checkpoint(spark, sf):
    """The first run dies midway; the second keeps what was committed and does the rest."""
    path, calls = scratch_path(spark, "batches"), []

    def work(tasks):
        return tasks.select("model_id", "code", (F.col("k") * 0.5).alias("result"))

    def dies(tasks):
        calls.append(1)
        if len(calls) > 4:
            raise InterruptedError
        return work(tasks)

    tasks = V.model_params(spark, sf)
    try:
        sinks.run_batches(tasks, dies, path, "model_id")
    except InterruptedError:
        pass
    done = sinks.run_batches(tasks, work, path, "model_id")
    return done.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("model_id").alias("n_ids"),
                                    F.round(F.sum("result"), 4).alias("total"))

"""The inputs of the engine as views on the given tables, in Spark and in SQL.

orders x customer x nation x region gives counts of a variant per region and period,
lineitem gives a daily control index, events gives daily series, part gives a table
of parameters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strainshift.functions.transforms import logit

OFFSET_DAYS = 3.5


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def period_of(ts: str, unit: str) -> Column:
    return F.to_date(F.date_trunc(unit, F.col(ts)))


def counts(spark: SparkSession, sf: str, unit: str = "month", national: bool = False) -> DataFrame:
    """n_total and n_variant per region and period.

    The variant is an order of status F. Customers are unique in their table, so a
    customer with very many orders is a skewed equi-join that AQE splits, and the
    counts are combined before they are shuffled by (region, period).
    """
    orders = table(spark, sf, "orders").select(
        "o_custkey", period_of("o_orderdate", unit).alias("period"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("hit"))
    sums = [F.count(F.lit(1)).alias("n_total"), F.sum("hit").alias("n_variant")]
    if national:
        return orders.groupBy("period").agg(*sums)
    nations = table(spark, sf, "nation").join(
        table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    customers = (table(spark, sf, "customer").select("c_custkey", "c_nationkey")
                 .join(nations.select("n_nationkey", F.col("r_name").alias("region")),
                       F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "region"))
    return (orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
            .groupBy("region", "period").agg(*sums))


def with_logit(df: DataFrame) -> DataFrame:
    share = F.col("n_variant").cast("double") / F.col("n_total")
    return df.withColumn("fm", share).withColumn("logit_fm", logit(F.col("fm")))


def panel(spark: SparkSession, sf: str, unit: str = "month", national: bool = False) -> DataFrame:
    return with_logit(counts(spark, sf, unit, national))


def first_period(spark: SparkSession, sf: str, unit: str = "month") -> Column:
    """The period of the first order, read from one column."""
    return table(spark, sf, "orders").agg(F.to_date(F.date_trunc(unit, F.min("o_orderdate")))).scalar()


def retained_panel(spark: SparkSession, sf: str, threshold: float = 0.1) -> DataFrame:
    """Region, period, t and logit of the cells above the threshold, as the models use them."""
    all_cells = panel(spark, sf)
    origin = first_period(spark, sf)
    return (all_cells.withColumn("t", F.date_diff("period", origin) + F.lit(OFFSET_DAYS))
            .filter((F.col("fm") >= threshold) & F.col("logit_fm").isNotNull())
            .select("region", "period", "t", F.col("logit_fm").alias("y")))


def daily_control(spark: SparkSession, sf: str) -> DataFrame:
    return (table(spark, sf, "lineitem").groupBy(F.to_date("l_shipdate").alias("day"))
            .agg(F.round(1000 * F.avg("l_discount") + 0.0, 7).alias("psi")))


def control_index(spark: SparkSession, sf: str, unit: str = "month") -> DataFrame:
    """day_idx and psi on the calendar of the panel; day 0 is its first period."""
    first, last = F.min("o_orderdate"), F.max("o_orderdate")
    bounds = table(spark, sf, "orders").agg(
        F.to_date(F.date_trunc(unit, first)).alias("lo"),
        F.date_add(F.to_date(F.date_trunc(unit, last)), 7).alias("hi"))
    days = bounds.select("lo", F.explode(F.sequence("lo", "hi", F.expr("interval 1 day"))).alias("day"))
    return (days.join(daily_control(spark, sf), "day", "left")
            .select(F.date_diff("day", "lo").alias("day_idx"), "psi"))


def daily_events(spark: SparkSession, sf: str) -> DataFrame:
    """Count, and a seventh of the summed value, per day and event type."""
    return (table(spark, sf, "events").groupBy(F.to_date("ts").alias("day"), F.col("event_type").alias("series"))
            .agg(F.count(F.lit(1)).alias("n"), (F.sum("value") / 7).alias("value7")))


def model_params(spark: SparkSession, sf: str) -> DataFrame:
    """A parameter row per part: control parameters inside their boxes, code and value."""
    size, key, price = F.col("p_size").cast("double"), F.col("p_partkey"), F.col("p_retailprice")
    return table(spark, sf, "part").select(
        key.alias("model_id"), F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"),
        (size / 51).alias("k"), (1 + key % 5 + (price - 900) / 100).alias("a"),
        (size / 5100).alias("pE"), ((size + 1) / 52).alias("exit_rate"),
        (0.2 + 0.6 * size / 51).alias("omega"), (0.1 * size / 51).alias("p"),
        (size / 510000).alias("eta"), (size / 5100).alias("mu"),
        price.alias("value"), F.element_at(F.array(F.lit(0), F.lit(1), F.lit(10)),
                                           (key % 3 + 1).cast("int")).alias("code"))


# The same views as SQL, to be placed after WITH.
def counts_sql(unit: str = "month", national: bool = False, name: str = "counts") -> str:
    period = f"CAST(date_trunc('{unit}', o_orderdate) AS DATE)"
    if national:
        return (f"{name} AS (SELECT {period} AS period, COUNT(*) AS n_total, "
                "COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS n_variant FROM orders GROUP BY 1)")
    return (f"{name} AS (SELECT r_name AS region, {period} AS period, COUNT(*) AS n_total, "
            "COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS n_variant "
            "FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey "
            "JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2)")


def panel_sql(unit: str = "month", national: bool = False) -> str:
    return counts_sql(unit, national) + (
        ", shares AS (SELECT *, CAST(n_variant AS DOUBLE) / n_total AS fm FROM counts)"
        ", panel AS (SELECT *, CASE WHEN fm > 0 AND fm < 1 THEN ln(fm / (1 - fm)) END AS logit_fm FROM shares)")


RETAINED_SQL = panel_sql() + (
    ", retained AS (SELECT region, period, date_diff('day', (SELECT min(period) FROM panel), period) + 3.5::DOUBLE AS t,"
    " logit_fm AS y FROM panel WHERE fm >= 0.1 AND logit_fm IS NOT NULL)")
CONTROL_SQL = ("control AS (SELECT CAST(l_shipdate AS DATE) AS day, round(1000 * avg(l_discount) + 0.0, 7) AS psi "
               "FROM lineitem GROUP BY 1)")
CONTROL_INDEX_SQL = CONTROL_SQL + (
    ", bounds AS (SELECT CAST(date_trunc('month', min(o_orderdate)) AS DATE) AS lo,"
    " CAST(date_trunc('month', max(o_orderdate)) AS DATE) + 7 AS hi FROM orders)"
    ", days AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day, lo FROM bounds)"
    ", control_idx AS (SELECT date_diff('day', lo, days.day) AS day_idx, psi FROM days LEFT JOIN control USING (day))")
EVENTS_SQL = ("daily AS (SELECT CAST(ts AS DATE) AS day, event_type AS series, COUNT(*) AS n, "
              "sum(value) / 7 AS value7 FROM events GROUP BY 1, 2)")
PARAMS_SQL = (
    "params AS (SELECT p_partkey AS model_id, p_brand AS brand, p_type AS kind, p_size / 51.0::DOUBLE AS k,"
    " 1 + p_partkey % 5 + (p_retailprice - 900) / 100 AS a, p_size / 5100.0::DOUBLE AS pE,"
    " (p_size + 1) / 52.0::DOUBLE AS exit_rate, 0.2::DOUBLE + 0.6::DOUBLE * p_size / 51 AS omega,"
    " 0.1::DOUBLE * p_size / 51 AS p, p_size / 510000.0::DOUBLE AS eta, p_size / 5100.0::DOUBLE AS mu,"
    " p_retailprice AS value, CASE p_partkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 10 END AS code FROM part)")

"""Readers of the input tables; every schema is stated, none is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strainshift.operators.reshape import union_tagged

# Headers of the input files.
CASES_HEADER = "Daily new confirmed cases due to COVID-19 (rolling 7-day average, right-aligned)"
TESTS_SCHEMA = (f"Entity STRING, Code STRING, Day DATE, new_tests_7day_smoothed INT, "
                f"`142752-annotations` STRING, `{CASES_HEADER}` DOUBLE")
DEATHS_SCHEMA = ("areaType STRING, areaName STRING, areaCode STRING, date DATE, "
                 "newDailyNsoDeathsByDeathDate INT, cumDailyNsoDeathsByDeathDate INT, `7-day_average` STRING")
CONTROL_SCHEMA = "Entity STRING, Code STRING, Day DATE, stringency_index DOUBLE"
REGIONAL_SCHEMA = ("Region STRING, week STRING, `n_Confirmed S-gene` INT, `n_Confirmed SGTF` INT, "
                   "`percent_Confirmed S-gene` DOUBLE, `percent_Confirmed SGTF` DOUBLE")


def read_csv(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """A headed CSV in which empty cells and NA are NULL; another header or a malformed cell is an error."""
    return (spark.read.schema(schema).option("header", True).option("nullValue", "NA")
            .option("mode", "FAILFAST").option("enforceSchema", False).csv(path))


def read_tests(spark: SparkSession, path: str) -> DataFrame:
    raw = read_csv(spark, path, TESTS_SCHEMA)
    return raw.select(F.col("Entity").alias("entity"), F.col("Code").alias("code"), F.col("Day").alias("day"),
                      F.col("new_tests_7day_smoothed").alias("new_tests"),
                      F.col("`142752-annotations`").alias("annotations"),
                      F.col(f"`{CASES_HEADER}`").alias("new_cases"))


def decimal_comma(x: Column) -> Column:
    """A number written with a decimal comma; an empty cell is NULL, anything else an error."""
    number = F.regexp_replace(x, ",", ".").try_cast("double")
    wrong = (F.trim(x) != "") & number.isNull()
    return F.when(wrong, F.raise_error(F.concat(F.lit("no number: "), x)).cast("double")).otherwise(number)


def read_deaths(spark: SparkSession, path: str) -> DataFrame:
    raw = read_csv(spark, path, DEATHS_SCHEMA)
    return raw.select(F.col("areaType").alias("area_type"), F.col("areaName").alias("area"),
                      F.col("areaCode").alias("area_code"), F.col("date").alias("day"),
                      F.col("newDailyNsoDeathsByDeathDate").alias("new_deaths"),
                      F.col("cumDailyNsoDeathsByDeathDate").alias("cum_deaths"),
                      decimal_comma(F.col("`7-day_average`")).alias("average7"))


def read_control(spark: SparkSession, path: str) -> DataFrame:
    raw = read_csv(spark, path, CONTROL_SCHEMA)
    return raw.select(F.col("Entity").alias("entity"), F.col("Code").alias("code"), F.col("Day").alias("day"),
                      F.col("stringency_index").alias("psi"))


def day_first(name: str) -> Column:
    """A date as dd/MM/yyyy; an empty cell is NULL, anything else an error."""
    date = F.try_to_date(name, "dd/MM/yyyy")
    wrong = (F.trim(F.col(name)) != "") & date.isNull()
    return F.when(wrong, F.raise_error(F.concat(F.lit("no date: "), F.col(name))).cast("date")).otherwise(date)


def read_regional(spark: SparkSession, path: str) -> DataFrame:
    """Weekly counts by region, exported from the spreadsheet with day-first dates."""
    raw = read_csv(spark, path, REGIONAL_SCHEMA)
    return raw.select(F.col("Region").alias("region"), day_first("week").alias("week"),
                      F.col("`n_Confirmed S-gene`").alias("n_other"), F.col("`n_Confirmed SGTF`").alias("n_variant"),
                      F.col("`percent_Confirmed S-gene`").alias("pct_other"),
                      F.col("`percent_Confirmed SGTF`").alias("pct_variant"))


def param_schema(columns: list[str]) -> str:
    kinds = {"Repeat": "LONG", "Convergence": "STRING", "group": "STRING", "var": "STRING",
             "fixed_parm": "STRING", "estim_parm": "STRING"}
    return ", ".join(f"`{c}` {kinds.get(c, 'DOUBLE')}" for c in columns)


def read_params(spark: SparkSession, path: str | list[str], columns: list[str],
                rename: dict[str, str] | None = None) -> DataFrame:
    """A parameter table of known columns; ``rename`` applies to all names at once."""
    rename = rename or {}
    raw = read_csv(spark, path, param_schema(columns))
    return raw.select(*[F.col(f"`{c}`").alias(rename.get(c, c)) for c in columns])


def read_sweeps(spark: SparkSession, paths: dict[str, str], columns: list[str]) -> DataFrame:
    """One table per varied parameter, stacked: its value and its name become columns."""
    parts = {}
    for name, path in paths.items():
        df = read_params(spark, path, [*columns, name])
        parts[name] = df.withColumnRenamed(name, "fixed_parm_value")
    return union_tagged(parts, "fixed_parm")

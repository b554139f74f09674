"""Unions and reshaping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_tagged(parts: dict[str, DataFrame], tag: str) -> DataFrame:
    """Stack tables by column name under a tag; absent columns become NULL."""
    tagged = [df.withColumn(tag, F.lit(name)) for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def defaults_union(parts: list[DataFrame], defaults: dict[str, float]) -> DataFrame:
    """Stack tables and fill the parameters a table did not vary with their defaults."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return out.withColumns({n: F.coalesce(F.col(n), F.lit(v)) for n, v in defaults.items()})


def ensemble_union(observed: DataFrame, best: DataFrame, replicates: DataFrame) -> DataFrame:
    """Observed rows, best-fit rows and replicate rows in one table with an origin."""
    null = F.lit(None).cast("int")
    return (observed.withColumns({"origin": F.lit("observed"), "replicate": null})
            .unionByName(best.withColumns({"origin": F.lit("best"), "replicate": F.lit(0)}))
            .unionByName(replicates.withColumn("origin", F.lit("replicate"))))


def wide_to_long(df: DataFrame, ids: list[str], values: list[str], name: str, value: str) -> DataFrame:
    return df.unpivot(ids, values, name, value)


def stack_measures(df: DataFrame, ids: list[str], legends: dict[str, dict[str, str]], legend: str) -> DataFrame:
    """One output row per legend entry; each entry maps output columns to input columns."""
    rows = [F.struct(F.lit(name).alias(legend), *[F.col(f"`{c}`").alias(o) for o, c in cols.items()])
            for name, cols in legends.items()]
    return df.select(*ids, F.inline(F.array(*rows)))


def long_to_wide(df: DataFrame, ids: list[str], name: str, value: str, names: list[str]) -> DataFrame:
    """Fixed names become columns; Spark needs no extra pass to find them."""
    return df.groupBy(*ids).pivot(name, names).agg(F.first(value))


def residual_table(observed: DataFrame, fitted: DataFrame, keys: list[str]) -> DataFrame:
    """Observed, fitted and residual per key."""
    return (observed.join(fitted, keys, "inner")
            .withColumn("residual", F.col("value") - F.col("expected")))


def grouped_map(df: DataFrame, by: list[str], fn, schema: str) -> DataFrame:
    """Apply a pandas function per group; for work no built-in expression states.

    A group is one task's input, so use it on pre-aggregated groups only.
    """
    return df.groupBy(*by).applyInPandas(fn, schema)


def row_map(df: DataFrame, fn, schema: str) -> DataFrame:
    """Apply a pandas function to batches of rows."""
    return df.mapInPandas(lambda batches: (fn(b) for b in batches), schema)

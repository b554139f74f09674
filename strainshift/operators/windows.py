"""Ordered operators; every order is an explicit key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strainshift.session import materialise, task_count


def flow_from_cumulative(df: DataFrame, by: list[str], order: str, column: str | list[str], out: str | list[str]) -> DataFrame:
    """Differences of one or several cumulative columns; the first row of each group drops out."""
    columns, names = ([x] if isinstance(x, str) else list(x) for x in (column, out))
    w = W.partitionBy(*by).orderBy(order)
    flows = {n: F.col(c) - F.lag(c).over(w) for c, n in zip(columns, names)}
    return df.withColumns({**flows, "_n": F.row_number().over(w)}).filter("_n > 1").drop("_n")


def observables(trajectories: DataFrame, by: list[str], order: str, rate: Column) -> DataFrame:
    """Negative tests, positive tests and deaths of trajectories with S, IA, IS_cumul and D.

    ``rate`` is the daily share of the untested that are tested. The first day of a
    trajectory has no flows and drops out.
    """
    rows = flow_from_cumulative(trajectories, by, order, ["IS_cumul", "D"], ["_cases", "deaths"])
    return rows.select(*by, order, (rate * F.col("S")).alias("negative"),
                       (F.col("_cases") + rate * F.col("IA")).alias("positive"), "deaths")


def selection_coef_diff(df: DataFrame, by: list[str], period: str, logit: str,
                        contiguous_days: int | None = None) -> DataFrame:
    """Central difference of the logit-frequency; both ends of a group drop out.

    Rows that a filter left side by side count as adjacent, unless
    ``contiguous_days`` bounds the span between the outer two.
    """
    w = W.partitionBy(*by).orderBy(period)
    out = df.withColumns({
        "_before": F.lag(period).over(w), "_after": F.lead(period).over(w),
        "s": (F.lead(logit).over(w) - F.lag(logit).over(w)) / 2})
    out = out.filter(F.col("_before").isNotNull() & F.col("_after").isNotNull())
    if contiguous_days is not None:
        out = out.filter(F.date_diff("_after", "_before") <= contiguous_days)
    return out.select(*by, period, "s")


def first_value(df: DataFrame, by: list[str], order: str, columns: dict[str, str]) -> DataFrame:
    """Values of the first row of each group along a unique order, under new names."""
    return df.groupBy(*by).agg(*[F.min_by(c, order).alias(n) for c, n in columns.items()])


def rolling_mean(value: str, by: list[str], order: str, before: int, after: int) -> Column:
    return F.avg(value).over(W.partitionBy(*by).orderBy(order).rowsBetween(-before, after))


def relative_to_reference(df: DataFrame, by: list[str], estimate: str, is_ref: str, out: str) -> DataFrame:
    """Estimate over the estimate of the reference variant, minus one."""
    ref = F.max(F.when(F.col(is_ref), F.col(estimate))).over(W.partitionBy(*by))
    return df.withColumn(out, F.col(estimate) / F.nullif(ref, F.lit(0.0)) - 1)


def repeat_index(df: DataFrame, by: list[str], order: list[str], out: str = "repeat") -> DataFrame:
    """Number the rows of each group 1..n along a key, the group being the whole table if ``by`` is empty.

    Rows are dealt out in ranges of (by, order), of any type, so that a group of any size
    spans as many tasks as its rows need; each range is numbered on its own and moved by
    the group's rows in the ranges before. NULL is a value of its own, before all others.
    """
    dealt = df.repartitionByRange(task_count(df.sparkSession), *by, *order).withColumn("_r", F.spark_partition_id())
    ranged = materialise(dealt)  # the ranges are drawn once
    sizes = ranged.groupBy(*by, "_r").agg(F.count(F.lit(1)).alias("_n"))
    run = F.sum("_n").over(W.partitionBy(*by).orderBy("_r"))  # a row per range of the group
    before = sizes.select(*[F.col(c).alias(f"_b_{c}") for c in by], F.col("_r").alias("_b_r"), (run - F.col("_n")).alias("_before"))
    numbered = ranged.withColumn("_k", F.row_number().over(W.partitionBy(*by, "_r").orderBy(*order)))
    same = F.col("_r") == F.col("_b_r")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_b_{c}"))
    return numbered.join(before, same).withColumn(out, F.col("_k") + F.col("_before")).select(*df.columns, out)


def top_k(df: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """The k best rows of each group; without groups Spark keeps k rows per task."""
    if not by:
        return df.orderBy(*order).limit(k)
    rank = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    return df.withColumn("_k", rank).filter(F.col("_k") <= k).drop("_k")


def bottom_rows(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """All rows that reach the minimum of their group, NULL ignored."""
    low = df.groupBy(*by).agg(F.min(value).alias("_low"))
    if not by:
        return df.filter(F.col(value) == df.agg(F.min(value)).scalar())
    return df.join(low, by).filter(F.col(value) == F.col("_low")).drop("_low")


def drop_worst(df: DataFrame, value: str, key: str) -> DataFrame:
    """Remove the single worst row; the smaller key goes first among equals."""
    worst = df.agg(F.max_by(F.col(key), F.struct(F.col(value), -F.col(key)))).scalar()
    return df.filter(F.col(key) != worst)


def durbin_watson(df: DataFrame, by: list[str], group: str, order: str, residual: str) -> DataFrame:
    """Lag-one statistic of residuals ordered by (group, order) within each ``by``.

    Steps inside a group come from a window per group, the steps from one group to
    the next from a table with one row per group, so no window spans all rows.
    """
    e = F.col(residual)
    step = e - F.lag(residual).over(W.partitionBy(*by, group).orderBy(order))
    groups = (df.withColumn("_step", step).groupBy(*by, group)
              .agg(F.sum(F.col("_step") * F.col("_step")).alias("_inner"),
                   F.sum(e * e).alias("_den"), F.count(residual).alias("_n"),
                   F.min_by(residual, order).alias("_first"),
                   F.max_by(residual, order).alias("_last")))
    jump = F.col("_first") - F.lag("_last").over(W.partitionBy(*by).orderBy(group))
    return (groups.withColumn("_jump", F.coalesce(jump * jump, F.lit(0.0))).groupBy(*by)
            .agg((F.sum(F.coalesce("_inner", F.lit(0.0)) + F.col("_jump"))
                  / F.nullif(F.sum("_den"), F.lit(0.0))).alias("dw"),
                 F.sum("_n").alias("n")))

"""Calendars, alignment by key, and period arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def calendar(bounds: DataFrame, first: str, last: str, out: str = "day") -> DataFrame:
    """Every day between two date columns of a one-row table."""
    return bounds.select(F.explode(F.sequence(F.col(first), F.col(last), F.expr("interval 1 day"))).alias(out))


def date_bounds(df: DataFrame, column: str, before: int = 0, after: int = 0) -> DataFrame:
    """One row with the first and the last date, moved outwards by whole days."""
    return df.agg(F.date_sub(F.min(column), before).alias("first_day"),
                  F.date_add(F.max(column), after).alias("last_day"))


def calendar_align(days: DataFrame, series: DataFrame, day: str, order: str, values: list[str]) -> DataFrame:
    """Left-align a series to a calendar: the first of several rows wins, a gap is NULL.

    ``order`` is unique within a day, so that all values come from the same row.
    """
    first = series.groupBy(day).agg(*[F.min_by(v, order).alias(v) for v in values])
    return days.join(first, day, "left")


def multi_series_align(days: DataFrame, series: dict[str, DataFrame], day: str) -> DataFrame:
    """Several one-value series side by side on one calendar."""
    out = days
    for name, df in series.items():
        value = [c for c in df.columns if c != day][0]
        out = out.join(df.select(day, F.col(value).alias(name)), day, "left")
    return out


def series_counts(df: DataFrame, day: str, kind: str, names: dict[str, object]) -> DataFrame:
    """Rows per day of each named kind side by side, from one pass; none is NULL."""
    return df.filter(F.col(kind).isin(*names.values())).groupBy(day).agg(*[
        F.nullif(F.count_if(F.col(kind) == value), F.lit(0)).alias(name) for name, value in names.items()])


def lookup(df: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Attach the columns of a dimension with unique keys; no match gives NULL."""
    return df.join(dim, key, "left")


def composite_key_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Pair the rows of two tables of like size by all keys.

    Both are shuffled and sorted: the plan knows the bytes of a file, not how many rows an
    expansion makes of them, and would gather the expanded side on the driver for a broadcast.
    """
    return left.join(right.hint("merge"), keys, "inner")


def first_crossing(df: DataFrame, period: str, share: str, threshold: float, by: list[str] = ()) -> DataFrame:
    """First period above a threshold, and the day before it as the end of the phase."""
    return (df.filter(F.col(share) > threshold).groupBy(*by)
            .agg(F.min(period).alias("first_period"))
            .withColumn("phase_end", F.date_sub("first_period", 1)))


def day_index(day: Column, origin: Column, offset: float = 0.0) -> Column:
    """Days since an origin, as a number; half-day offsets stand for mid-period."""
    return F.date_diff(day, origin) + F.lit(float(offset))


def block_means(df: DataFrame, day: str, value: str, origin: Column, by: list[str] = ()) -> DataFrame:
    """Means of seven-day blocks counted from an origin; incomplete blocks are left out."""
    block = F.floor(F.date_diff(F.col(day), origin) / 7)
    return (df.withColumn("_o", origin).withColumn("_b", block).filter("_b >= 0")
            .groupBy(*by, "_b")
            .agg(F.min("_o").alias("_o"), F.avg(value).alias("block_mean"),
                 F.count(value).alias("n_days"))
            .filter("n_days = 7")
            .select(*by, F.expr("date_add(_o, cast(7 * _b as int))").alias("week"), "block_mean"))


def guarded_mean(value: Column) -> Column:
    """Mean that is NULL as soon as one value is NULL."""
    return F.when(F.count(value) == F.count(F.lit(1)), F.avg(value))

"""Exact integrals of the control curve, which is constant within each day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strainshift.functions import control as C
from strainshift.operators.expand import expand_calendar


def daily_integrands(df: DataFrame, psi: str = "psi", fixed: dict | None = None) -> DataFrame:
    """Both integrands for rows that carry psi, k and a."""
    fixed = fixed or {}
    c = C.effectiveness(F.col(psi), F.col("k"), F.col("a"))
    return (df.withColumn("_c", c)
            .withColumns({"f1": C.transmission_integrand(F.col("_c"), **fixed),
                          "f2": C.recovery_integrand(F.col("_c"), **fixed)}).drop("_c"))


def overlap(lo: Column, hi: Column, day: Column) -> Column:
    """Length of [lo, hi] inside the unit day [day, day + 1)."""
    return F.least(hi, day + 1) - F.greatest(lo, day)


def uncontrolled(fixed: dict | None = None) -> dict[str, Column]:
    """Both integrands on a day without control (c = 0)."""
    none = F.lit(0.0)
    return {"f1": C.transmission_integrand(none, **(fixed or {})), "f2": C.recovery_integrand(none, **(fixed or {}))}


def interval_integrals(intervals: DataFrame, daily: DataFrame, values: list[str],
                       missing: dict[str, Column] | None = None) -> DataFrame:
    """Integrals of daily values over [lo, hi], the general form.

    Each interval is cut into the days it touches, so that the overlap condition is
    an equi-join on the day and never a range join. A touched day without a value
    makes the integral NULL, unless ``missing`` gives the value of such days.
    """
    keys = intervals.columns
    days = intervals.withColumn("day_idx", F.explode(F.sequence(
        F.floor("lo").cast("int"), F.greatest(F.ceil("hi") - 1, F.floor("lo")).cast("int"))))
    part = overlap(F.col("lo"), F.col("hi"), F.col("day_idx"))
    rows = days.join(daily, "day_idx", "left").withColumns(
        {v: F.coalesce(F.col(v), (missing or {}).get(v, F.lit(None))) * part for v in values})
    whole = F.count(F.lit(1))
    return rows.groupBy(*keys).agg(*[F.when(F.count(v) == whole, F.sum(v)).alias(v) for v in values])


def segment_weights(points: DataFrame, control: DataFrame, fill: str = "zero") -> DataFrame:
    """Overlap weights (segment, psi, weight) of days with the gaps between time points.

    A day without an index has no control under ``fill='zero'``, as in ``uncontrolled``;
    under 'null' its weight is NULL, and so are the integrals from there on. ``points`` has the columns j = 1..m and t, the ordered evaluation times. Days of
    equal psi within one segment share a row: the integrand depends on psi only.
    """
    w = W.orderBy("j")  # one row per period of the calendar
    gaps = points.select("j", F.coalesce(F.lag("t").over(w), F.lit(0.0)).alias("lo"), F.col("t").alias("hi"))
    days = gaps.withColumn("day_idx", F.explode(F.sequence(
        F.floor("lo").cast("int"), F.greatest(F.ceil("hi") - 1, F.floor("lo")).cast("int"))))
    part = overlap(F.col("lo"), F.col("hi"), F.col("day_idx"))
    if fill not in ("zero", "null"):
        raise ValueError(f"fill is 'zero' or 'null', not {fill!r}")
    rows = days.join(control, "day_idx", "left")
    weight = F.sum(part) if fill == "zero" else F.when(F.count("psi") == F.count(F.lit(1)), F.sum(part))
    return rows.groupBy("j", "psi").agg(weight.alias("weight"))


def prefix_integrals(models: DataFrame, weights: DataFrame, values: dict[str, Column],
                     fixed: dict | None = None) -> DataFrame:
    """Integrals from 0 to each time point of expressions in f1 and f2, for every model.

    The segment weights are bounded by the calendar and travel as one array. Models
    must be partitioned by ``model_id``; then neither the sum per segment nor the
    running sum needs another exchange.
    """
    rows = daily_integrands(expand_calendar(models, weights), fixed=fixed)
    segments = rows.groupBy("model_id", "j").agg(
        *[F.sum(F.col("weight") * v).alias(n) for n, v in values.items()], (F.count("weight") < F.count(F.lit(1))).alias("_gap"))
    run = W.partitionBy("model_id").orderBy("j")
    return segments.select("model_id", "j", *[F.when(~F.max("_gap").over(run), F.sum(n).over(run)).alias(n) for n in values])


def daily_prefix(df: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Running sums over the full days before each day."""
    w = W.partitionBy(*by).orderBy("day_idx").rowsBetween(W.unboundedPreceding, -1)
    return df.withColumns({f"p_{v}": F.coalesce(F.sum(v).over(w), F.lit(0.0)) for v in values})


def integral_at(prefix: str, value: str, t: Column) -> Column:
    """Prefix of the full days plus the started part of the day that holds t."""
    return F.col(prefix) + (t - F.floor(t)) * F.col(value)

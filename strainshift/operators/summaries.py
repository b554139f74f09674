"""Quantiles, moments, correlations and densities."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strainshift.operators.expand import expand_range
from strainshift.operators.windows import repeat_index
from strainshift.session import materialise, task_count

# Rank error of the bracket sketch is at most one part in this many.
SKETCH_ACCURACY = 10_000
# Brackets reach this many times the sketch's error to both sides, and a missed one so many times further.
REACH, WIDEN = 4, 8


def exact_quantiles(df: DataFrame, by: list[str], value: str, probs: list[float], accuracy: int = SKETCH_ACCURACY,
                    reach: float = REACH) -> DataFrame:
    """Linearly interpolated quantiles (type 7) as an array column ``q``; NULL and NaN do not count.

    Between an infinite and a finite value a quantile is NaN.

    A sketch of fixed size brackets both order statistics of each quantile. A second pass
    counts what lies below each bracket and finds the values next to it; only the few
    values inside are shuffled and ranked, so no task holds a group, whatever its size.
    The counts tell whether a bracket holds its ranks. Groups where one does not are asked
    again with wider brackets, at last from the least to the greatest value, which holds
    every rank; usually there are none, and one look at the written result shows it.
    """
    if not by:
        return exact_quantiles(df.withColumn("_all", F.lit(1)), ["_all"], value, probs, accuracy, reach).drop("_all")
    clean = df.select(*by, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    rows, slack, found = clean, reach / accuracy, []
    while True:
        asked = materialise(_bracket_quantiles(rows, by, probs, slack, accuracy))
        found.append(asked.filter("_hit").select(*by, "q"))
        missed = asked.filter("NOT _hit").select(*by)
        if missed.isEmpty():
            return reduce(DataFrame.unionByName, found)
        rows = clean.join(missed.withColumnsRenamed({c: f"_by_{c}" for c in by}), _same_group(by), "left_semi")
        slack = WIDEN * max(slack, 1 / accuracy)


def _same_group(by: list[str]) -> Column:
    """A group and its copy under ``_by_`` names; NULL is a group."""
    return reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by])


def _bracket_quantiles(clean: DataFrame, by: list[str], probs: list[float], slack: float, accuracy: int) -> DataFrame:
    """``q`` per group from brackets that reach ``slack`` in rank to both sides, and whether they held every rank.

    The value next to a bracket counts as held where the counts prove that it is the one.
    """
    v, size = F.col("_v"), len(probs)
    marks = [p + s for p in probs for s in (-slack, slack)]
    sketched = F.percentile_approx("_v", F.array(*[F.lit(min(max(m, 0.0), 1.0)) for m in marks]), accuracy)
    frame = clean.groupBy(*by).agg(sketched.alias("_m"), F.min("_v").alias("_min"), F.max("_v").alias("_max"), F.count(F.lit(1)).alias("_total"))
    ends = [F.col("_min") if m <= 0 else F.col("_max") if m >= 1 else F.element_at("_m", i + 1) for i, m in enumerate(marks)]
    lo, hi = ends[::2], ends[1::2]

    other = [f"_by_{c}" for c in by]
    same = _same_group(by)
    rows = clean.join(frame.withColumnsRenamed(dict(zip(by, other))), same).drop(*other)
    ends = rows.groupBy(*by).agg(F.first("_total").alias("_total"), *[x for i in range(size) for x in (
        F.count_if(v < lo[i]).alias(f"_below{i}"), F.max(F.when(v < lo[i], v)).alias(f"_prev{i}"), F.min(F.when(v > hi[i], v)).alias(f"_next{i}"))])
    ends = ends.select(*by, F.inline(F.array(*[F.struct(
        F.lit(i).alias("_i"), ((F.col("_total") - 1) * F.lit(float(p))).alias("_h"), F.col(f"_below{i}").alias("_below"),
        F.col(f"_prev{i}").alias("_prev"), F.col(f"_next{i}").alias("_next")) for i, p in enumerate(probs)])))
    within = F.array_compact(F.array(*[F.when((v >= lo[i]) & (v <= hi[i]), i) for i in range(size)]))
    inside = rows.select(*by, "_v", F.explode(within).alias("_i")).groupBy(*by, "_i", "_v").agg(F.count(F.lit(1)).alias("_n"))
    inside = inside.withColumn("_cum", F.sum("_n").over(W.partitionBy(*by, "_i").orderBy("_v")))
    ends = ends.withColumnsRenamed(dict(zip(by, other)))
    ranked = inside.withColumnRenamed("_i", "_j").join(ends, same & (F.col("_i") == F.col("_j"))).drop(*other)
    reached = F.col("_below") + F.col("_cum")
    pair = ranked.groupBy(*by, "_i").agg(
        F.first("_h").alias("_h"), F.first("_below").alias("_below"), F.first("_prev").alias("_prev"), F.first("_next").alias("_next"),
        F.min(F.when(reached > F.floor("_h"), v)).alias("_v0"), F.min(F.when(reached > F.floor("_h") + 1, v)).alias("_v1"), F.min(v).alias("_first"))
    before = F.col("_below") > F.floor("_h")  # the lower statistic is the value just below the bracket
    low = F.when(before & (F.col("_below") == F.floor("_h") + 1), F.col("_prev")).when(~before, F.col("_v0"))
    high = F.when(before, F.col("_first")).otherwise(F.coalesce("_v1", "_next", "_v0"))
    part = F.col("_h") - F.floor("_h")
    q = low + F.when(part > 0, part * (high - low)).otherwise(F.lit(0.0))
    return (pair.withColumns({"_low": low, "_q": q}).groupBy(*by)
            .agg((F.count("_low") == size).alias("_hit"), F.transform(F.sort_array(F.collect_list(F.struct("_i", "_q"))), lambda s: s["_q"]).alias("q")))


def moments(value: str) -> list[Column]:
    return [F.count(value).alias("n"), F.min(value).alias("min"), F.avg(value).alias("mean"),
            F.max(value).alias("max"), F.stddev_samp(value).alias("sd")]


def five_number_summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Minimum, quartiles, mean, maximum and standard deviation per group."""
    return summary_with_quantiles(df, by, value, {"q1": .25, "median": .5, "q3": .75})


def summary_with_quantiles(df: DataFrame, by: list[str], value: str, named: dict[str, float]) -> DataFrame:
    q = exact_quantiles(df, by, value, list(named.values()))
    base = df.groupBy(*by).agg(*moments(value))
    out = base.join(q, by, "left") if by else base.select("*", q.scalar().alias("q"))
    return out.select("*", *[F.element_at("q", i + 1).alias(n) for i, n in enumerate(named)]).drop("q")


def pearson(x: Column, y: Column) -> Column:
    """Correlation; NULL where a variance is zero."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(x, y), F.nullif(F.sqrt(F.var_pop(x) * F.var_pop(y)), F.lit(0.0)))


def corr_matrix(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """All pairwise correlations over complete rows, long, from one aggregation."""
    pairs = list(combinations(columns, 2))
    wide = df.dropna(subset=columns).groupBy(*by).agg(
        *[pearson(F.col(p), F.col(q)).alias(f"_{i}") for i, (p, q) in enumerate(pairs)])
    rows = [F.struct(F.lit(p).alias("p"), F.lit(q).alias("q"), F.col(f"_{i}").alias("r"))
            for i, (p, q) in enumerate(pairs)]
    return wide.select(*by, F.inline(F.array(*rows)))


def density_table(df: DataFrame, by: list[str], value: str, tail: float = 0.05, points: int = 512) -> DataFrame:
    """Gaussian kernel density on a grid between the tail/2 quantiles: the exact sum over all values.

    Only values between the quantiles count. Equal values are counted before they meet the
    grid, and the grid is expanded in place; its sums are combined within a task, so that no
    more than a row per task and grid point is shuffled. The work is distinct values times points.
    Groups of zero bandwidth have no rows.
    """
    if not 0 <= tail < 1:
        raise ValueError(f"the share of both tails is at least 0 and below 1, not {tail}")
    if not by:
        return density_table(df.withColumn("_all", F.lit(1)), ["_all"], value, tail, points).drop("_all")
    cut = exact_quantiles(df, by, value, [tail / 2, 1 - tail / 2])
    x = F.col(value)
    kept = materialise(df.join(cut, by).filter((x >= F.element_at("q", 1)) & (x <= F.element_at("q", 2)))
                       .select(*by, x.alias("_x")))
    quart = exact_quantiles(kept, by, "_x", [.25, .75])
    size = kept.groupBy(*by).agg(F.count("_x").alias("n"), F.stddev_samp("_x").alias("_sd"))
    iqr = (F.element_at("q", 2) - F.element_at("q", 1)) / 1.34
    bandwidth = 0.9 * F.least("_sd", iqr) * F.pow(F.col("n"), F.lit(-0.2))
    spread = size.join(quart, by).withColumn("bw", bandwidth).drop("q", "_sd")
    lo, hi = F.element_at("q", 1), F.element_at("q", 2)
    frame = spread.join(cut, by).select(*by, "n", "bw", lo.alias("_lo"), ((hi - lo) / (points - 1)).alias("_step"))
    frame = materialise(frame.filter("bw > 0"))

    # counts are few bytes but grow by the grid, so they are spread by an explicit number of tasks
    counted = kept.groupBy(*by, "_x").agg(F.count(F.lit(1)).alias("_c")).repartition(task_count(df.sparkSession))
    grid = expand_range(counted.join(frame, by), "g", 0, points - 1)
    z = (F.col("_x") - (F.col("_lo") + F.col("g") * F.col("_step"))) / F.col("bw")
    sums = grid.groupBy(*by, "g").agg(F.sum(F.col("_c") * F.exp(-z * z / 2)).alias("_w")).join(frame, by)
    return sums.select(*by, "g", (F.col("_lo") + F.col("g") * F.col("_step")).alias("x"), "bw",
                       (F.col("_w") / (F.col("n") * F.col("bw") * math.sqrt(2 * math.pi))).alias("density"))


def normal_scores(df: DataFrame, by: list[str], value: str, order: list[str], score: Callable[[Column], Column]) -> DataFrame:
    """Squared correlation of a value with the normal scores of its ranks in the group: by, n, w.

    Rows are ranked by ``value`` and then ``order``; ranks come from ranges of that key, so a
    group of any size spans as many tasks as its rows need. ``score`` gives the normal
    quantile of a share. w is NULL where a variance is zero; NULL values have no rank.
    """
    ranked = repeat_index(df.filter(F.col(value).isNotNull()).select(*by, value, *order), by, [value, *order], "_rank")
    sizes = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("_size")).withColumnsRenamed({c: f"_by_{c}" for c in by})
    share = (F.col("_rank") - 0.375) / (F.col("_size") + 0.25)
    scored = ranked.join(sizes, _same_group(by)).withColumn("_z", score(share))
    w = F.pow(F.covar_pop(value, "_z"), F.lit(2.0)) / F.nullif(F.var_pop(value) * F.var_pop("_z"), F.lit(0.0))
    return scored.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), w.alias("w"))


def ensemble_curves(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Median and 95 % envelope by day and series across replicates."""
    q = exact_quantiles(df, by, value, [.025, .5, .975])
    return q.select(*by, *[F.element_at("q", i + 1).alias(n) for i, n in enumerate(("lower", "median", "upper"))])

"""Scoring of candidate tables by weighted least squares, search and profiles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strainshift.functions.hashing import hash_uniform
from strainshift.operators.expand import expand_blocks
from strainshift.operators.windows import top_k
from strainshift.session import materialise, task_count

# Fixed value: expected values are not allowed to divide by less than this.
SMALLEST_DIVISOR = 1e-3

Expected = Callable[[Column, Column], Column]
Loss = Callable[[Column, Column, Column], Column]


def weighted_square(observed: Column, expected: Column, floor: Column) -> Column:
    """(obs - exp)^2 over the floored expected value; the numerator is not floored."""
    return F.pow(observed - expected, F.lit(2.0)) / F.greatest(expected, floor)


def divisor_floor(obs: DataFrame, value: str = "value") -> Column:
    """max(1e-3, smallest observation), one scalar for the whole table."""
    return obs.agg(F.greatest(F.lit(SMALLEST_DIVISOR), F.min(F.col(value).cast("double")))).scalar()


def point_losses(obs: DataFrame, predictions: DataFrame, keys: list[str], loss: Loss = weighted_square) -> DataFrame:
    """Loss per point for a prediction table joined to observations on their keys.

    ``_points`` and, with a series, ``_series_points`` carry how many points there are to
    predict: a candidate that leaves one out has no score.
    """
    whole = obs.agg(F.count(F.lit(1))).scalar()
    rows = predictions.join(obs, keys).withColumn("_points", whole)
    if "series" in keys:
        rows = rows.join(obs.groupBy("series").agg(F.count(F.lit(1)).alias("_series_points")), "series")
    return rows.withColumn("loss", loss(F.col("value"), F.col("expected"), divisor_floor(obs)))


def guarded_sum(x: str) -> Column:
    """Sum that is NULL as soon as one term is NULL."""
    return F.when(F.count(x) == F.count(F.lit(1)), F.sum(x))


def wls_score(losses: DataFrame, by: list[str]) -> DataFrame:
    """Sum over all points; NULL if a point is not predicted, or more than once."""
    return losses.groupBy(*by).agg(F.when(F.count(F.lit(1)) == F.max("_points"), guarded_sum("loss")).alias("score"))


def wls_by_series(losses: DataFrame, by: list[str], series: str = "series") -> DataFrame:
    """Score per series, and the total in the row without a series."""
    grouping = losses.groupingSets([[F.col(c) for c in (*by, series)], [F.col(c) for c in by]],
                                   *by, series)
    there = F.when(F.grouping(series) == 0, F.max("_series_points")).otherwise(F.max("_points"))
    return grouping.agg(F.when(F.count(F.lit(1)) == there, guarded_sum("loss")).alias("score"))


def score_candidates(candidates: DataFrame, obs: DataFrame, expected: Callable[[], Column], key: str = "candidate",
                     loss: Loss = weighted_square, by: list[str] = ()) -> DataFrame:
    """Score candidates whose expected values are an expression of their parameters.

    Candidates are spread once by their key, which is unique (within ``by``), and meet the
    observation points block by block; few points are one block that is expanded in place,
    so one narrow row per candidate is all that is shuffled. Observations that carry the ``by`` columns are joined on them instead, and
    the divisor's floor is that of their own data set.
    """
    by = list(by)
    if by and set(by) <= set(obs.columns):
        floors = obs.groupBy(*by).agg(F.greatest(F.lit(SMALLEST_DIVISOR), F.min(F.col("value").cast("double"))).alias("_floor"))
        points, floor = candidates.join(obs.join(floors, by), by), F.col("_floor")
    else:
        floor = divisor_floor(obs)
        points = expand_blocks(candidates.repartition(task_count(candidates.sparkSession), *by, key), obs)
    losses = points.withColumn("loss", loss(F.col("value").cast("double"), expected(), floor))
    # all columns of a candidate are keys: a key of any type is hashed, a text buffer is sorted
    return losses.groupBy(*candidates.columns).agg(guarded_sum("loss").alias("score"))


def uniform_starts(ids: DataFrame, key: str, seed: int | str, boxes: dict[str, tuple]) -> DataFrame:
    """A start per id, uniform in a box per parameter; bounds are numbers or columns."""
    def draw(name, lo, hi):
        lo, hi = (x if isinstance(x, Column) else F.lit(float(x)) for x in (lo, hi))
        return lo + (hi - lo) * hash_uniform(seed, F.col(key), name)
    return ids.withColumns({n: draw(n, lo, hi) for n, (lo, hi) in boxes.items()})


def candidate_search(ids: DataFrame, obs: DataFrame, boxes: dict[str, tuple[float, float]],
                     expected: Callable[[], Column], keep: int = 10, rounds: int = 3, seed: int = 1234,
                     key: str = "candidate", loss: Loss = weighted_square, by: list[str] = ()) -> DataFrame:
    """Multi-start search: score a table of starts, shrink the boxes around the best, repeat.

    Each round is one distributed job over all starts. Between rounds only the
    ``keep`` best rows are kept, in the shared folder; the next boxes are their
    extremes. With ``by``, every key has a search of its own, with boxes from its own best
    rows, and all keys share the job of a round; observations that carry the ``by``
    columns are those of their key.
    """
    obs, by = materialise(obs), list(by)
    names = list(boxes)
    rows = spans = None
    for number in range(1, rounds + 1):
        starts = ids.select(*by, key)
        if by and spans is not None:
            starts = starts.join(spans, by)
            boxes = {n: (F.col(f"_{n}_low"), F.col(f"_{n}_high")) for n in names}
        name = F.concat_ws("|", *[F.col(c).cast("string") for c in (*by, key)]) if by else F.col(key)
        starts = uniform_starts(starts.withColumn("_name", name), "_name", f"{seed}-{number}", boxes).select(*by, key, *names)
        scored = score_candidates(starts, obs, expected, key, loss, by).filter(F.col("score").isNotNull())
        best = top_k(scored, by, [F.col("score"), F.col(key)], keep).withColumn("round", F.lit(number))
        best = materialise(best)
        rows = best if rows is None else rows.unionByName(best)
        if by:
            spans = best.groupBy(*by).agg(*[f(n).alias(f"_{n}_{end}") for n in names for f, end in ((F.min, "low"), (F.max, "high"))])
        else:
            boxes = {n: (best.agg(F.min(n)).scalar(), best.agg(F.max(n)).scalar()) for n in names}
    return rows


def best_candidate(df: DataFrame, by: list[str], value: str, key: str, ok: Column) -> DataFrame:
    """The accepted row with the smallest value per group; the smaller key among equals."""
    columns = [c for c in df.columns if c not in by]
    row = F.min_by(F.struct(*columns), F.struct(F.col(value), F.col(key)))
    return df.filter(ok & F.col(value).isNotNull()).groupBy(*by).agg(row.alias("_r")).select(*by, "_r.*")


def all_minima(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Every row that ties for the smallest value of its group."""
    low = df.groupBy(*by).agg(F.min(value).alias(value))
    return df.join(low, [*by, value])


def best_start(starts: DataFrame, replicate: str, value: str, code: str, keep: list[str]) -> DataFrame:
    """Per replicate the lowest converged start; without one a row of NULLs stays."""
    ok = (F.col(code) == 0) & F.col(value).isNotNull()
    row = F.struct(value, *keep)
    out = starts.groupBy(replicate).agg(F.min(F.when(ok, row)).alias("_r"))
    label = F.when(F.col("_r").isNull(), "No convergence").otherwise("Successful completion")
    return out.select(replicate, label.alias("convergence"),
                      *[F.col(f"_r.{c}").alias(c) for c in (value, *keep)])


def profile_scan(scored: DataFrame, parameter: str, score: str, ok: Column, by: list[str] = ()) -> DataFrame:
    """Smallest accepted score per fixed value of one parameter; none gives NULL."""
    return scored.groupBy(*by, parameter).agg(F.min(F.when(ok, F.col(score))).alias("wls"))

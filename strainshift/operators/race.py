"""Searches for many keys at once, in rounds, with racing.

Every key (a replicate, a fixed value of a profile) has starts of its own, in boxes of its
own. The points of the data are dealt in blocks; after each block a candidate whose sum so
far exceeds the worst of the key's best rows of earlier rounds leaves. Losses are not
negative, so it could not have become one of the best, and the result is that of a search
without racing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strainshift.functions.hashing import hash_uniform
from strainshift.operators.expand import expand_blocks
from strainshift.operators.score import SMALLEST_DIVISOR, divisor_floor, weighted_square
from strainshift.operators.windows import top_k
from strainshift.session import materialise, task_count


def positive_loss(observed: Column, expected: Column, floor: Column) -> Column:
    """The weighted square; NULL where nothing positive is expected, as a start that did not finish."""
    return F.when(expected > 0, weighted_square(observed, expected, floor))


def dealt_blocks(obs: DataFrame, by: list[str], point: list[str], blocks: int) -> DataFrame:
    """Observations with ``_block`` 0..blocks-1 and the divisor's floor of their own data set; written once."""
    obs = obs.withColumn("value", F.col("value").cast("double"))
    if by:
        floors = obs.groupBy(*by).agg(F.greatest(F.lit(SMALLEST_DIVISOR), F.min("value")).alias("_floor"))
        obs = obs.join(floors, by)
    else:
        obs = obs.withColumn("_floor", divisor_floor(obs))
    return materialise(obs.withColumn("_block", F.pmod(F.xxhash64(*point), F.lit(blocks))))


def raced(starts: DataFrame, blocks: list[DataFrame], by: list[str], expected: Callable[[], Column],
          loss: Callable[[Column, Column, Column], Column] = positive_loss) -> DataFrame:
    """Starts (with ``_bound``, NULL for none) that no block put beyond their bound, with their score.

    Starts are spread once and stay there: by the key, if blocks carry it and are joined on
    it, else by key and candidate, and blocks are expanded in place. A start that lacks a
    loss at a point leaves.
    """
    columns = starts.columns
    own = set(by) <= set(blocks[0].columns)
    alive = starts.repartition(task_count(starts.sparkSession), *by, *([] if own else ["candidate"])).withColumn("score", F.lit(0.0))
    for block in blocks:
        if own:
            points = alive.join(block.withColumn("_there", F.lit(1)), by, "left")  # a data set may have no point in a block
        else:
            points = expand_blocks(alive, block).withColumn("_there", F.lit(1))
        points = points.withColumn("_loss", loss(F.col("value"), expected(), F.col("_floor")))
        whole = F.count("_loss") == F.count("_there")
        alive = (points.groupBy(*columns, "score").agg(F.when(whole, F.coalesce(F.sum("_loss"), F.lit(0.0))).alias("_more"))
                 .withColumn("score", F.col("score") + F.col("_more")).drop("_more")
                 .filter(F.col("score").isNotNull() & (F.col("_bound").isNull() | (F.col("score") <= F.col("_bound")))))
    return alive


def race_search(keys: DataFrame, obs: DataFrame, point: list[str], boxes: dict[str, tuple[float, float]], expected: Callable[[], Column],
                starts: int, keep: int, rounds: int, seed: int = 1234, blocks: int = 3, fixed: dict[str, Column] | None = None,
                informs: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The ``keep`` best rows of every key: key, round, candidate, parameters, score.

    ``keys`` has a row per key. Round 1 draws ``starts`` starts uniformly in ``boxes``; a
    later round draws them in the span of the best rows so far, of the key itself or, with
    ``informs`` (which copies best rows to the keys they are a warm start for), of others too;
    without such rows in ``boxes`` again. ``fixed`` sets parameters by expressions over the
    key. ``obs`` is one data set, or one per key if it carries the key's columns. Ties go to
    the earlier round, then to the smaller candidate. A key without a finished start has no row.
    """
    by, names = keys.columns, list(boxes)
    fixed, informs = fixed or {}, informs or (lambda best: best)
    dealt = dealt_blocks(obs, by if set(by) <= set(obs.columns) else [], point, blocks)
    parts = [dealt.filter(F.col("_block") == i).drop("_block") for i in range(blocks)]
    keys, best = materialise(keys), None
    for number in range(1, rounds + 1):
        rows = keys.withColumn("_bound", F.lit(None).cast("double"))
        spans = {n: tuple(F.lit(float(x)) for x in box) for n, box in boxes.items()}
        if best is not None:
            box = informs(best).groupBy(*by).agg(*[f(n).alias(f"_{n}_{end}") for n in names for f, end in ((F.min, "low"), (F.max, "high"))])
            bound = best.groupBy(*by).agg(F.when(F.count(F.lit(1)) >= keep, F.max("score")).alias("_bound"))
            rows = keys.join(bound, by, "left").join(box, by, "left")
            spans = {n: tuple(F.coalesce(f"_{n}_{end}", x) for end, x in zip(("low", "high"), spans[n])) for n in names}
        rows = rows.withColumn("candidate", F.explode(F.sequence(F.lit(1), F.lit(starts))))
        name = F.concat_ws("|", *[F.col(c).cast("string") for c in (*by, "candidate")])
        draws = {n: lo + (hi - lo) * hash_uniform(f"{seed}-{number}", name, n) for n, (lo, hi) in spans.items()}
        rows = rows.select(*by, "candidate", "_bound", *[fixed.get(n, lambda d: d)(draws[n]).alias(n) for n in names])
        # the first round has no bound, so its points need not be dealt
        scored = raced(rows, [dealt.drop("_block")] if best is None else parts, by, expected).drop("_bound").withColumn("round", F.lit(number))
        scored = scored.select(*by, "round", "candidate", *names, "score")
        best = materialise(top_k(scored if best is None else scored.unionByName(best), by, [F.col("score"), F.col("round"), F.col("candidate")], keep))
    return best


def neighbours(best: DataFrame, grid: str, last: int) -> DataFrame:
    """Rows of a grid value copied to the value before and after it, as warm starts along the grid."""
    near = F.explode(F.array(*[F.col(grid) + d for d in (-1, 0, 1)]))
    return best.withColumn("_near", near).filter(F.col("_near").between(0, last)).withColumn(grid, F.col("_near")).drop("_near")


def best_of_each(keys: DataFrame, best: DataFrame, columns: list[str]) -> DataFrame:
    """One row per key: its best row, or NULLs and the label of no convergence."""
    rank = F.row_number().over(W.partitionBy(*keys.columns).orderBy("score", "round", "candidate"))  # at most `keep` rows a key
    first = best.withColumn("_k", rank).filter("_k = 1").select(*keys.columns, *columns)
    label = F.when(F.col(columns[0]).isNull(), "No convergence").otherwise("Successful completion")
    return keys.join(first, keys.columns, "left").withColumn("convergence", label)

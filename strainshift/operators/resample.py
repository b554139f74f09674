"""Wild bootstrap replicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strainshift.functions.hashing import wild_weight
from strainshift.operators.expand import expand_range
from strainshift.session import task_count


def wild_replicates(residuals: DataFrame, keys: list[str], replicates: int, law: str | list[str], seed: int) -> DataFrame:
    """``replicates`` data sets: expected + residual x weight.

    The weight is a function of (seed, replicate, point key), so a lost task draws
    the same numbers again. Points are spread by their key and replicates expanded in
    place: a summary per point needs no further exchange, and one per replicate is
    combined before its exchange, so no task ever holds a whole replicate. Several laws
    are drawn in the same pass and told apart by a column ``law``.
    """
    spread = residuals.repartition(task_count(residuals.sparkSession), *keys)
    out = expand_range(spread, "replicate", 1, replicates)
    point = [F.col(k).cast("string") for k in keys]
    draw = lambda name: wild_weight(name, seed, F.col("replicate"), *point)
    if isinstance(law, str):
        out = out.withColumn("weight", draw(law))
    else:
        laws = F.array(*[F.struct(F.lit(name).alias("law"), draw(name).alias("weight")) for name in law])
        out = out.select("*", F.inline(laws))
    return out.withColumn(
        "value", F.col("expected") + F.col("residual") * F.col("weight"))

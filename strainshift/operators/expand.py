"""Expand each row by a small table, without a join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strainshift.session import materialise

# A dimension up to this many rows travels as one array inside the plan.
ARRAY_ROWS = 200_000
# Rows of a block that meets other rows as one array.
BLOCK_ROWS = 4096
# So many blocks are broadcast at most.
BROADCAST_BLOCKS = 64


def as_array(dim: DataFrame, limit: int = ARRAY_ROWS) -> Column:
    """A whole small table as one array-of-struct value, sorted by its columns.

    No more than ``limit`` + 1 rows are ever gathered; a larger table stops the job.
    """
    columns, dim = dim.columns, dim.limit(limit + 1)
    rows = F.sort_array(F.collect_list(F.struct(*columns)))
    size = F.count(F.lit(1))
    message = F.lit(f"more rows than fit in one array of {limit}")
    return dim.agg(F.when(size <= limit, rows)
                   .otherwise(F.raise_error(message).cast(_array_type(dim)))).scalar()


def small_table(dim: DataFrame, limit: int = ARRAY_ROWS):
    """A whole small table in Arrow, to go with a function; a larger one than ``as_array`` takes stops the job as well."""
    rows = dim.limit(limit + 1).toArrow()
    if rows.num_rows > limit:
        raise ValueError(f"more rows than fit in one array of {limit}")
    return rows


def _array_type(dim: DataFrame) -> str:
    return f"array<{dim.schema.simpleString()}>"


def expand_calendar(df: DataFrame, dim: DataFrame) -> DataFrame:
    """Expand by a table that has at most one row per calendar day or period."""
    return df.select("*", F.explode(as_array(dim)).alias("_d")).select(*df.columns, "_d.*")


def expand_by(df: DataFrame, dim: DataFrame, rows: int | None = None, limit: int = ARRAY_ROWS) -> DataFrame:
    """Expand each row of ``df`` by each row of ``dim``.

    ``dim`` is counted first, unless the caller gives its ``rows``. It is dealt out row by
    row into as many arrays as needed, each half full, and the parts are united; up to
    ``limit`` rows that is one array.
    """
    rows = dim.count() if rows is None else rows
    if rows <= limit:
        return expand_calendar(df, dim)
    parts = -(-2 * rows // limit)
    dealt = materialise(dim.repartition(parts).withColumn("_part", F.spark_partition_id()))
    return reduce(DataFrame.unionByName,
                  [expand_calendar(df, dealt.filter(F.col("_part") == i).drop("_part")) for i in range(parts)])


def row_blocks(dim: DataFrame, rows: int = BLOCK_ROWS) -> DataFrame:
    """``dim`` in arrays ``_rows`` of at most ``rows`` rows with a key ``_block``, written once.

    Blocks are dealt within a task, so none is gathered from elsewhere and the table is not counted.
    """
    dealt = dim.hint("rebalance").withColumn("_block", F.floor(F.monotonically_increasing_id() / rows))
    return materialise(dealt.groupBy("_block").agg(F.sort_array(F.collect_list(F.struct(*dim.columns))).alias("_rows")))


def expand_blocks(df: DataFrame, dim: DataFrame, rows: int = BLOCK_ROWS, most: int = BROADCAST_BLOCKS) -> DataFrame:
    """Expand each row of ``df`` by each row of ``dim``, of any size, in one scan of ``df`` (block nested).

    A row is copied once per block, which is all that is joined; the plan holds no more of
    ``dim`` than the keys of its blocks. Up to ``most`` written blocks are broadcast, and
    the partitioning of ``df`` stays; more are joined by shuffle, where a block is one row
    of its side and AQE splits the other.
    """
    blocks = row_blocks(dim, rows)
    keys = blocks.agg(F.collect_list("_block")).scalar()
    side = F.broadcast(blocks) if blocks.count() <= most else blocks
    paired = df.withColumn("_block", F.explode(keys)).join(side, "_block")
    return paired.select(*df.columns, F.inline("_rows"))


def expand_values(df: DataFrame, name: str, values) -> DataFrame:
    """Expand by literal values."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))


def expand_range(df: DataFrame, name: str, first, last) -> DataFrame:
    """Expand by the whole numbers first..last."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(first), F.lit(last))))

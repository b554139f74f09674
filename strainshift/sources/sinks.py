"""Writers of result tables, and batches that resume after a loss."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> str:
    """A headed CSV folder with quoted headers; NULL is an empty cell."""
    df.write.mode("errorifexists").option("header", True).option("quoteAll", False).csv(path)
    return path


def write_table(df: DataFrame, path: str, partition_by: list[str] = ()) -> str:
    """A Parquet table, partitioned by the columns later reads filter on.

    Rebalancing gathers small partitions into one file each and splits large ones.
    """
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)
    return path


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _rows(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table under ``path``, empty if nothing was written there yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def committed(spark: SparkSession, path: str, run: str) -> set[int]:
    """Numbers of the batches of a run that are whole."""
    marks = _rows(spark, f"{path}/commits", "run STRING, batch INT")
    return {r["batch"] for r in marks.filter(F.col("run") == run).select("batch").distinct().collect()}


def run_batches(tasks: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, key: str,
                batches: int = 8, run: str = "1") -> DataFrame:
    """Work on the tasks in batches and give the union of all results.

    A task's batch is a hash of its key. Every batch is written under its own number and
    committed by a row of its own afterwards; a run that died is started again with the same
    call, keeps what was committed and does the other batches anew. A new ``run`` id does
    all of them again.
    """
    spark = tasks.sparkSession
    schema = work(tasks.limit(0)).schema
    done = committed(spark, path, run)
    number = F.pmod(F.xxhash64(F.lit(run), F.col(key)), F.lit(batches))
    for batch in range(batches):
        if batch not in done:
            work(tasks.filter(number == batch)).write.mode("overwrite").parquet(f"{path}/{run}/{batch}")
            mark = spark.createDataFrame([(run, batch)], "run STRING, batch INT")
            mark.coalesce(1).write.mode("append").parquet(f"{path}/commits")
    return spark.read.schema(schema).parquet(*[f"{path}/{run}/{batch}" for batch in range(batches)])

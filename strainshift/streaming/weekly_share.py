"""Weekly variant shares of an event stream, the one place where time windows stay open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strainshift.functions.transforms import logit


def weekly_share(events: DataFrame, time: str, by: list[str], is_variant: Column, late: str = "3 days") -> DataFrame:
    """Counts, share and logit-share per week (from Monday) and group.

    On a stream a week is emitted once the watermark has passed its end; the same
    call on a table gives the same rows. Counts are combined before they are
    shuffled, and the state holds one row per open week and group.
    """
    week = F.window(time, "7 days", startTime="4 days")  # epoch day 0 is a Thursday
    counts = (events.withWatermark(time, late).groupBy(week, *by)
              .agg(F.count(F.lit(1)).alias("n_total"), F.count_if(is_variant).alias("n_variant")))
    share = F.col("n_variant").cast("double") / F.col("n_total")
    return (counts.withColumn("fm", share)
            .select(*by, F.to_date(F.col("window.start")).alias("week"), "n_total", "n_variant", "fm",
                    logit(F.col("fm")).alias("logit_fm")))

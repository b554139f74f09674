import datetime as dt

from pyspark.sql import functions as F

from strainshift.plans import views as V
from strainshift.streaming.weekly_share import weekly_share


def test_stream_of_files_gives_the_weeks_of_the_table(spark, sf, tmp_path):
    events = V.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    batch = {(r["event_type"], r["week"]): (r["n_total"], r["n_variant"]) for r in
             weekly_share(events, "ts", ["event_type"], F.col("value") > 50).collect()}
    assert all(week.weekday() == 0 for _, week in batch)
    want = events.groupBy("event_type", F.to_date(F.date_trunc("week", "ts")).alias("w")).count().collect()
    assert {(r["event_type"], r["w"]): r["count"] for r in want} == {k: v[0] for k, v in batch.items()}

    source = tmp_path / "in"
    # one file per day, with a last one far ahead that closes the open weeks
    for i, (day,) in enumerate(events.select(F.to_date("ts")).distinct().orderBy(F.to_date("ts")).collect()):
        events.filter(F.to_date("ts") == day).coalesce(1).write.mode("append").parquet(str(source))
    last = events.limit(1).withColumn("ts", F.lit(dt.datetime(2030, 1, 1)).cast("timestamp"))
    last.coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 10).parquet(str(source))
    run = (weekly_share(stream, "ts", ["event_type"], F.col("value") > 50).writeStream.outputMode("append")
           .format("memory").queryName("weekly").option("checkpointLocation", str(tmp_path / "cp"))
           .trigger(availableNow=True).start())
    run.awaitTermination(300)
    got = {(r["event_type"], r["week"]): (r["n_total"], r["n_variant"]) for r in spark.table("weekly").collect()}
    assert {k: v for k, v in got.items() if k[1].year < 2030} == batch

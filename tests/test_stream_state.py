"""A stream's state has as many partitions as it was started with first, whatever the session's shuffles have."""

import os

from pyspark.sql import functions as F

from vidimus.operators.usage import measures
from vidimus.streaming import streams

KIND = "id string, ts timestamp, request_count long, input_tokens long, output_tokens long, audio_seconds double, image_count long, video_seconds double, estimated_usd double, billed_credits double"


def test_partitions_of_the_state(spark, tmp_path):
    place = {k: str(tmp_path / k) for k in ("in", "out", "cp")}
    empty = [F.lit(1).cast(f.dataType).alias(f.name) for f in spark.createDataFrame([], KIND).schema[2:]]
    rows = lambda a, b: spark.range(a, b).select(F.col("id").cast("string").alias("id"), F.timestamp_seconds(1_704_067_200 + 3600 * (F.col("id") % 400)).alias("ts"), *empty)
    for part, parts in ((rows(0, 96), 3), (rows(350, 400), 7)):
        part.write.mode("append").parquet(place["in"])
        source = spark.readStream.schema(part.schema).parquet(place["in"])
        streams.to_files(streams.usage_stream(source, "1 day", "1 day", "id"), place["out"], place["cp"], parts).awaitTermination(120)
        assert spark.conf.get("spark.sql.shuffle.partitions") == "4"
        assert {len([p for p in os.listdir(f"{place['cp']}/state/{k}") if p.isdigit()]) for k in (0, 1)} == {3}
    got = {(r.day, r.events) for r in spark.read.parquet(place["out"]).collect()}
    days = rows(0, 96).groupBy(F.date_trunc("day", "ts").alias("day")).agg(*measures())
    assert {(r.day, r.events) for r in days.collect()} <= got

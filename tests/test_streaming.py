"""Streams give what the same plan gives on a table."""

import os
import shutil

from pyspark.sql import functions as F

from framelake.operators.dedup import greedy_spacing
from framelake.streaming import incremental as inc


def parts(spark, tmp_path, rows, schema, n=3):
    for k in range(n):
        spark.createDataFrame(rows[k::n] if n > 1 else rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_spacing_equals_batch(spark, data, tmp_path):
    e = spark.read.parquet(f"{data}/events.parquet")
    # arrivals in order of time, several files
    cut = e.select(F.percentile(F.unix_micros(F.col("ts").cast("timestamp")), 0.5)).first()[0]
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    for k, part in enumerate((e.filter(us < cut), e.filter(us >= cut))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {r.event_id for r in inc.run_to_end(inc.spaced_stream(s, "user_id", "ts", "event_id", 3600)).collect()}
    want = {r.event_id for r in greedy_spacing(e, ["user_id"], us / 1e6, "event_id", 3600).collect()}
    assert got == want


def test_merge_keeps_the_latest(spark, tmp_path):
    s = parts(spark, tmp_path, [(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    inc.merge_batches(s, str(tmp_path / "out"), "k")
    assert {r.k: r.v for r in inc.latest(spark, str(tmp_path / "out")).collect()} == {1: "a", 2: "b", 3: "c"}


def test_merge_of_a_batch_again_changes_nothing(spark, tmp_path):
    out = str(tmp_path / "out")
    s = parts(spark, tmp_path, [(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    inc.merge_batches(s, out, "k", ["v"])
    versions = inc._versions(spark, out)
    want = {r.k: r.v for r in inc.latest(spark, out).collect()}
    assert want == {1: "b", 2: "c"}
    shutil.rmtree(out + "-checkpoint")  # the stream forgets what it delivered
    spark.createDataFrame([(9, "x")], "k int, v string").write.parquet(f"{out}/v=99")
    os.remove(f"{out}/v=99/_SUCCESS")  # a version that was not finished
    inc.merge_batches(s, out, "k", ["v"])
    assert inc._versions(spark, out) == versions and {r.k: r.v for r in inc.latest(spark, out).collect()} == want


def test_counts_and_dedup(spark, data):
    e = spark.read.parquet(f"{data}/events.parquet")
    s = spark.readStream.schema(e.schema).parquet(f"{data}/events*.parquet").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    assert inc.run_to_end(inc.dedup_stream(s, ["event_type"], "ts", "90 days")).count() == e.select("event_type").distinct().count()
    w = inc.run_complete(inc.windowed_counts(s, "ts", "1 day", late="1 day"), ["start"])
    assert w.agg(F.sum("n")).first()[0] == e.count()

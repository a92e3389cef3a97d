"""Incremental forms on Structured Streaming: resume, dedup, spacing, windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from framelake.session import scratch_path


def file_stream(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet", files_per_trigger: int = 8) -> DataFrame:
    """Files of a folder as they arrive, each once: the checkpoint remembers them."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(fmt).load(path)


def run_to_end(stream: DataFrame, path: str | None = None, mode: str = "append") -> DataFrame:
    """Process what is there into a parquet table and return it; the sink commits each batch once."""
    spark = stream.sparkSession
    out = path or scratch_path(spark, "stream")
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", out + "-checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_complete(stream: DataFrame, keys: list[str]) -> DataFrame:
    """The last state of an aggregate in update mode: each batch replaces the rows it renews."""
    spark = stream.sparkSession
    out = scratch_path(spark, "stream")

    def write(batch: DataFrame, n: int) -> None:
        batch.withColumn("_batch", F.lit(n)).write.mode("append").parquet(out)

    q = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", out + "-checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.parquet(out)
    vals = [c for c in stream.columns if c not in keys]
    last = got.groupBy(*keys).agg(F.max_by(F.struct(*vals), "_batch").alias("v"))
    return last.select(*keys, "v.*")


def dedup_stream(stream: DataFrame, key: list[str], event_time: str, late: str) -> DataFrame:
    """The first arrival of each key while the watermark holds its state."""
    return stream.withWatermark(event_time, late).dropDuplicatesWithinWatermark(key)


def spaced_stream(stream: DataFrame, group: str, ts: str, tie: str, gap_s: float) -> DataFrame:
    """Greedy spacing as keyed state: the moment of the last kept row. Rows of a batch are ordered in their group.

    A row earlier than the last kept one comes too late to be judged and is dropped.
    """
    kinds = {c: stream.schema[c].dataType.simpleString() for c in (group, tie)}
    out = f"{group} {kinds[group]}, {tie} {kinds[tie]}, micros long"

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values(["micros", tie])
        last = state.get[0] if state.exists else None
        keep = []
        for m in rows["micros"]:
            ok = last is None or m - last >= gap_s * 1e6
            keep.append(ok)
            last = m if ok else last
        if last is not None:
            state.update((int(last),))
        yield rows[keep][[group, tie, "micros"]]

    src = stream.select(group, tie, F.unix_micros(F.col(ts).cast("timestamp")).alias("micros"))
    return src.groupBy(group).applyInPandasWithState(step, out, "last long", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, ts: str, width: str, slide: str | None = None, late: str | None = None, keys: list[str] | None = None) -> DataFrame:
    """Counts in tumbling or sliding windows; the same plan on a table and on a stream."""
    d = events.withWatermark(ts, late) if late else events
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return d.groupBy(w.alias("w"), *(keys or [])).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *(keys or []), "n")


def session_counts(events: DataFrame, ts: str, gap: str, key: str, late: str | None = None) -> DataFrame:
    """Sessions that close after a pause of ``gap``. Unlike greedy spacing, each row prolongs its session."""
    d = events.withWatermark(ts, late) if late else events
    return d.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")


def merge_batches(stream: DataFrame, target: str, key: str, order: list[str] | None = None) -> None:
    """foreachBatch merge by key into a versioned table: later batches replace the rows they hold.

    A version is named by the number of its batch, so a batch that is delivered again changes
    nothing; one that was not finished is written anew. Of the rows of a key in one batch the
    last by ``order`` (default: by all other columns) stays.
    """

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        done = _versions(spark, target)
        if n in done:
            return
        rest = order or [c for c in batch.columns if c != key]
        new = batch.groupBy(key).agg(F.max(F.struct(*rest, *[c for c in batch.columns if c not in (key, *rest)])).alias("_r")).select(key, "_r.*").select(*batch.columns)
        if before := [v for v in done if v < n]:
            old = spark.read.parquet(done[max(before)])
            new = old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)
        new.write.mode("overwrite").parquet(f"{target}/v={n}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", target + "-checkpoint").trigger(availableNow=True).start().awaitTermination()


def latest(spark: SparkSession, target: str) -> DataFrame:
    done = _versions(spark, target)
    return spark.read.parquet(done[max(done)])


def _versions(spark: SparkSession, target: str) -> dict[int, str]:
    """Folders of the finished versions, which hold a mark of success, by number."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(target)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s.getPath() for s in fs.listStatus(p) if s.getPath().getName().startswith("v=")] if fs.exists(p) else []
    return {int(q.getName()[2:]): q.toString() for q in found if fs.exists(jvm.org.apache.hadoop.fs.Path(q, "_SUCCESS"))}

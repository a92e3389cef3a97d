"""Queries on streams and in windows (operators 142 to 149, 240 to 246)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from framelake.operators.similarity import placeholder_names
from framelake.plans.registry import query, table
from framelake.streaming import incremental as I


def arriving(s, d, name):
    """A table as a stream of its files."""
    t = table(s, d, name)
    return s.readStream.schema(t.schema).parquet(f"{d}/{name}*.parquet")


SPACED = """with recursive e as (select user_id, event_id, epoch_us(ts) / 1e6 as t, row_number() over (partition by user_id order by ts, event_id) as rn from events),
  f as (select user_id, event_id, rn, t as last, true as keep from e where rn = 1
    union all select e.user_id, e.event_id, e.rn, case when e.t - f.last >= 3600 then e.t else f.last end, e.t - f.last >= 3600 from f join e on e.user_id = f.user_id and e.rn = f.rn + 1)
  select user_id, event_id from f where keep"""


@query("op240_resume_stream", "select distinct file_path from pipeline_status where lower(trim(status)) = 'done'")
def _(s, d):
    st = arriving(s, d, "pipeline_status").filter(F.lower(F.trim("status")) == "done").select("file_path")
    return I.run_to_end(st).distinct()


@query("op241_manifest_stream", "select file_path, count(*) as scans from manifest group by file_path")
def _(s, d):
    return I.run_complete(arriving(s, d, "manifest").groupBy("file_path").agg(F.count("*").alias("scans")), ["file_path"])


@query("op243_spacing_stream", SPACED)
def _(s, d):
    return I.run_to_end(I.spaced_stream(arriving(s, d, "events"), "user_id", "ts", "event_id", 3600)).select("user_id", "event_id")


@query("op244_dedup_stream", "select count(distinct event_type || user_id) as n from events")
def _(s, d):
    e = arriving(s, d, "events").select("event_type", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    return I.run_to_end(I.dedup_stream(e, ["event_type", "user_id"], "ts", "90 days")).agg(F.count("*").alias("n"))


@query("op246_tumbling", "select epoch_us(time_bucket(interval '1 day', ts, timestamp '2000-01-01')) as start_us, event_type, count(*) as n from events group by all")
def _(s, d):
    w = I.windowed_counts(table(s, d, "events"), "ts", "1 day", keys=["event_type"])
    return w.select(F.unix_micros(F.col("start").cast("timestamp")).alias("start_us"), "event_type", "n")


@query("op246_tumbling_stream", "select epoch_us(time_bucket(interval '1 day', ts, timestamp '2000-01-01')) as start_us, count(*) as n from events group by all")
def _(s, d):
    e = arriving(s, d, "events").select(F.col("ts").cast("timestamp").alias("ts"))
    w = I.run_complete(I.windowed_counts(e, "ts", "1 day", late="1 day"), ["start"])
    return w.select(F.unix_micros("start").alias("start_us"), "n")


@query("op246_sliding", "select epoch_us(time_bucket(interval '6 hours', ts, timestamp '2000-01-01')) - k * 21600000000 as start_us, count(*) as n from events, range(4) t(k) group by 1")
def _(s, d):
    w = I.windowed_counts(table(s, d, "events"), "ts", "24 hours", "6 hours")
    return w.select(F.unix_micros(F.col("start").cast("timestamp")).alias("start_us"), "n")


@query("op246_sessions", "select user_id, epoch_us(min(ts)) as start_us, count(*) as n from (select *, sum(new) over (partition by user_id order by ts, event_id) as sess from (select *, case when lag(ts) over (partition by user_id order by ts, event_id) is null or epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts, event_id)) >= 10800000000 then 1 else 0 end as new from events)) group by user_id, sess")
def _(s, d):
    e = table(s, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    w = I.session_counts(e, "ts", "3 hours", "user_id")
    return w.select("user_id", F.unix_micros("start").alias("start_us"), "n")


@query("op143_dense_ids", "select user_id, dense_rank() over (order by user_id) as id from (select distinct user_id from events)")
def _(s, d):
    from framelake.operators.selection import global_rank

    return global_rank(table(s, d, "events").select("user_id").distinct(), ["user_id"], "id")


@query("op145_next_value", "select event_id, epoch_us(lead(ts) over (partition by user_id order by ts, event_id)) as next_us from events")
def _(s, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(s, d, "events").select("event_id", F.unix_micros(F.lead("ts").over(w).cast("timestamp")).alias("next_us"))


@query("op149_first_last_delta", "select user_id, round(last(value order by ts, event_id) - first(value order by ts, event_id), 6) as delta from events group by user_id")
def _(s, d):
    e = table(s, d, "events").groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "value")).alias("b"), F.min(F.struct("ts", "event_id", "value")).alias("a"))
    return e.select("user_id", F.round(F.col("b.value") - F.col("a.value"), 6).alias("delta"))


@query("op150_union_by_name", "select event_id, user_id, event_type from events where event_type = 'view' union all select event_id, user_id, null from events where event_type = 'click'")
def _(s, d):
    e = table(s, d, "events")
    a, b = e.filter("event_type = 'view'").select("event_id", "user_id", "event_type"), e.filter("event_type = 'click'").select("user_id", "event_id")
    return a.unionByName(b, allowMissingColumns=True)


@query("op236_best_epoch", """with e as (select user_id, row_number() over (partition by user_id order by event_id) as epoch, round(value, 1) as score from events),
b as (select *, score > coalesce(max(score) over (partition by user_id order by epoch rows between unbounded preceding and 1 preceding), '-infinity'::double) as better from e),
l as (select *, max(case when better then epoch end) over (partition by user_id order by epoch rows between unbounded preceding and current row) as last from b),
t as (select *, coalesce(max(case when epoch - last >= 3 then 1 else 0 end) over (partition by user_id order by epoch rows between unbounded preceding and 1 preceding), 0) as stopped from l)
select user_id, first(epoch order by score desc, epoch) as epoch from t where stopped = 0 group by user_id""")
def _(s, d):
    """Three epochs without a better score end the training of a user; the events are the epochs."""
    from framelake.operators.selection import best_epoch

    e = table(s, d, "events").withColumn("epoch", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")))
    e = e.select("user_id", "epoch", (-F.round("value", 1)).alias("loss"))
    return best_epoch(e, "loss", "epoch", 3, ["user_id"]).select("user_id", "epoch")


@query("op176_placeholder_names")
def _(s, d):
    return s.createDataFrame([(k, n) for k, n in enumerate(placeholder_names({"personB"}, 60))], "n int, name string")

"""Queries over labels, replies, documents and experiments: joins and summaries (operators 44 to 62, 72, 83 to 85, 112 to 131, 178 to 186, 198, 199)."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelake.functions import text as X
from framelake.operators import joins, metrics, selection
from framelake.plans.registry import query, table


@query("op044_label_join", "select l.label_id, r.row_id from labels l left join (select * from results qualify row_number() over (partition by video_stem || '/' || regexp_extract(kept_path, '([^/\\\\]*)$', 1) order by row_id) = 1) r on r.video_path = l.video_path and r.timestamp_s = l.timestamp_s")
def _(s, d):
    r = table(s, d, "results").withColumn("card", X.card_key(F.col("video_stem"), F.col("kept_path")))
    # rows without a path have no card; like a single key, the first of them counts
    first = selection.first_per_key(r, ["card"], [F.col("row_id")])
    return table(s, d, "labels").join(first.select("video_path", "timestamp_s", "row_id"), ["video_path", "timestamp_s"], "left").select("label_id", "row_id")


@query("op045_skip_exported", "select label_id from labels l where not exists (select 1 from labels e where e.is_val and e.corpus = l.corpus and e.video_path = l.video_path and e.timestamp_s = l.timestamp_s)")
def _(s, d):
    lab = table(s, d, "labels")
    keys = ["corpus", "video_path", "timestamp_s"]
    return lab.join(lab.filter("is_val").select(*keys).distinct(), keys, "left_anti").select("label_id")


@query("op046_digest_first", "select min(label_id) as label_id, sha256 from labels where sha256 is not null and sha256 not in (select sha256 from labels where corpus = 'lake_house' and sha256 is not null) group by sha256")
def _(s, d):
    lab = table(s, d, "labels").filter("sha256 is not null").select("label_id", "sha256", "corpus")
    new = lab.join(lab.filter("corpus = 'lake_house'").select("sha256").distinct(), "sha256", "left_anti")
    return selection.first_per_key(new, ["sha256"], [F.col("label_id")]).select("label_id", "sha256")


@query("op047_full_outer", "select kept_path, a, b, c from (select kept_path, count(*) as a from results where kept_path is not null group by 1) full join (select kept_path, count(*) as b from raw_outputs_a where kept_path is not null group by 1) using (kept_path) full join (select face_crop_path as kept_path, count(*) as c from labels group by 1) using (kept_path)")
def _(s, d):
    a, b = (table(s, d, t).filter("kept_path is not null").groupBy("kept_path").agg(F.count("*").alias(n)) for t, n in (("results", "a"), ("raw_outputs_a", "b")))
    c = table(s, d, "labels").groupBy(F.col("face_crop_path").alias("kept_path")).agg(F.count("*").alias("c"))
    return joins.full_outer([a, b, c], "kept_path")


@query("op048_caption_scores", "select w.raw_id, r.face_count, r.composite from raw_outputs_a w left join (select * from results where kept_path is not null qualify row_number() over (partition by kept_path order by row_id) = 1) r using (kept_path)")
def _(s, d):
    r = table(s, d, "results").filter("kept_path is not null").select("kept_path", "face_count", "composite", "row_id")
    return joins.first_match(table(s, d, "raw_outputs_a").select("raw_id", "kept_path"), r, ["kept_path"], [F.col("row_id")]).select("raw_id", "face_count", "composite")


@query("op050_merge_update", "select r.row_id, case when w.kept_path is not null then w.prompt2_raw else r.caption_description end as caption_description from results r left join (select * from raw_outputs_a where kept_path is not null qualify row_number() over (partition by kept_path order by raw_id desc) = 1) w on w.kept_path = r.kept_path")
def _(s, d):
    w = selection.first_per_key(table(s, d, "raw_outputs_a").filter("kept_path is not null"), ["kept_path"], [F.desc("raw_id")])
    new = w.select("kept_path", F.col("prompt2_raw").alias("caption_description"))
    return joins.merge_update(table(s, d, "results").select("row_id", "kept_path", "caption_description"), new, "kept_path", ["caption_description"]).select("row_id", "caption_description")


@query("op051_membership_sets", "select user_id, array_to_string(list_sort(list(distinct event_type)), ',') as names from events group by user_id")
def _(s, d):
    c = table(s, d, "events").groupBy("event_type").agg(F.collect_set("user_id").alias("ids"))
    m = joins.membership_sets(c, "ids", "user_id", "event_type")
    return m.select("user_id", F.array_join("names", ",").alias("names"))


@query("op052_last_identity", "select user_id, last(event_type order by ts, event_id) as identity from events group by user_id")
def _(s, d):
    e = table(s, d, "events").select("user_id", "event_type", "ts", "event_id")
    return selection.first_per_key(e, ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", F.col("event_type").alias("identity"))


@query("op058_identity_precedence", "select r.row_id, coalesce(a.label_id, b.label_id) as label_id from results r left join (select face_crop_path, min(label_id) as label_id from labels group by 1) a on a.face_crop_path = r.kept_path left join (select video_path, min(label_id) as label_id from labels group by 1) b on b.video_path = r.video_path")
def _(s, d):
    lab = table(s, d, "labels").select("label_id", "face_crop_path", F.col("video_path").alias("lv"))
    r = table(s, d, "results").select("row_id", "kept_path", "video_path")
    return joins.resolve_by_precedence(r, lab, [("kept_path", "face_crop_path"), ("video_path", "lv")], "label_id", [F.col("label_id")]).select("row_id", "label_id")


@query("op058_first_claim", "select row_id, label_id from (select r.row_id, l.label_id, row_number() over (partition by r.row_id order by l.label_id) as n from results r join labels l on l.video_path = r.video_path and l.timestamp_s = r.timestamp_s) where n = 1")
def _(s, d):
    j = table(s, d, "results").select("row_id", "video_path", "timestamp_s").join(table(s, d, "labels").select("label_id", "video_path", "timestamp_s"), ["video_path", "timestamp_s"])
    return joins.first_claim(j, "row_id", [F.col("label_id")]).select("row_id", "label_id")


HOURS = "(select distinct user_id, time_bucket(interval '1 day', ts) as ts from events)"


@query("op059_asof_forward", f"select t.user_id, epoch_us(t.ts) as target_us, e.event_id from {HOURS} t asof left join (select user_id, ts, min(event_id) as event_id from events group by user_id, ts) e on t.user_id = e.user_id and t.ts <= e.ts")
def _(s, d):
    e = table(s, d, "events").select("user_id", "ts", "event_id")
    t = e.select("user_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts")).distinct()
    r = joins.asof_forward(t, e, ["user_id"], "ts", ["event_id"])
    return r.select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("target_us"), "event_id")


@query("op060_interval_join", "select p.event_id as purchase, count(*) as near from events p join events e on e.user_id = p.user_id and abs(epoch_us(e.ts) - epoch_us(p.ts)) <= 1800000000 where p.event_type = 'purchase' group by p.event_id")
def _(s, d):
    e = table(s, d, "events").select("user_id", "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    p = e.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase"), F.col("us").alias("at"))
    return joins.interval_join(p, e, ["user_id"], "at", "us", 1_800_000_000).groupBy("purchase").agg(F.count("*").alias("near"))


@query("op072_refine", "select purchase, event_id from (select p.event_id as purchase, e.event_id, row_number() over (partition by p.event_id order by e.value desc nulls last, e.ts, e.event_id) as n from events p join events e on e.user_id = p.user_id and abs(epoch_us(e.ts) - epoch_us(p.ts)) <= 1800000000 where p.event_type = 'purchase') where n = 1")
def _(s, d):
    e = table(s, d, "events").select("user_id", "event_id", "event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    p = e.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase"), F.col("us").alias("at"))
    return joins.refine(joins.interval_join(p, e, ["user_id"], "at", "us", 1_800_000_000), ["purchase"], "value", ["us", "event_id"]).select("purchase", "event_id")


@query("op061_hit_box", "select row_id, true as hit from results where face_x1 is not null and (frame_w // 2) between face_x1 and face_x2 and (frame_h // 2) between face_y1 and face_y2")
def _(s, d):
    r = table(s, d, "results").filter("face_x1 is not null")
    pts = r.select("row_id", F.floor(F.col("frame_w") / 2).alias("px"), F.floor(F.col("frame_h") / 2).alias("py"))
    boxes = r.select("row_id", F.lit(1).alias("box_id"), F.lit(True).alias("accepted"), *[F.col(f"face_{k}").alias(k) for k in ("x1", "y1", "x2", "y2")])
    return joins.hit_box(pts, boxes, "row_id", "px", "py", F.lit(False)).select("row_id", F.lit(True).alias("hit"))


@query("op062_box_overlap", "select row_id, greatest(least(face_x2 + 20, 400) - greatest(face_x1 - 20, 100), 0) * greatest(least(face_y2 + 20, 400) - greatest(face_y1 - 20, 100), 0) / 90000.0 > 0.1 as covered from results where face_x1 is not null")
def _(s, d):
    c = [F.col(f"face_{k}") + p for k, p in (("x1", -20), ("y1", -20), ("x2", 20), ("y2", 20))]
    crop = [F.lit(v) for v in (100, 100, 400, 400)]
    return table(s, d, "results").filter("face_x1 is not null").select("row_id", (joins.covered_share(*crop, *c) > 0.1).alias("covered"))


@query("op083_version_order", "select row_id, cast(nullif(regexp_extract(caption_model || '_v' || (row_id % 12), '(?:^|[_-])v([0-9]+)', 1), '') as int) as version from results where caption_model is not null")
def _(s, d):
    r = table(s, d, "results").filter("caption_model is not null")
    return r.select("row_id", X.version_tag(F.concat("caption_model", F.lit("_v"), (F.col("row_id") % 12).cast("string"))).alias("version"))


@query("op084_class_winner", "select pred_label, first(quality_bucket order by n desc, quality_bucket) as winner from (select pred_label, quality_bucket, count(*) as n from results where pred_label is not null group by all) group by pred_label")
def _(s, d):
    n = table(s, d, "results").filter("pred_label is not null").groupBy("pred_label", "quality_bucket").agg(F.count("*").alias("n"))
    return selection.top_k(n, ["pred_label"], [F.desc("n"), F.col("quality_bucket")], 1).select("pred_label", F.col("quality_bucket").alias("winner"))


@query("op085_best_config", "select prompt_id, max_new_tokens from prompts where max_new_tokens <= 64 order by max_new_tokens desc, prompt_id limit 1")
def _(s, d):
    p = table(s, d, "prompts").filter("max_new_tokens <= 64")
    return p.orderBy(F.desc("max_new_tokens"), "prompt_id").limit(1).select("prompt_id", "max_new_tokens")


CAPS = ("caption_setting", "caption_activity", "caption_description", "caption_model", "caption_aesthetic_score")


@query("op112_coverage", " union all ".join(f"select '{c}' as \"column\", count({c}) as present, round(count({c}) / count(*), 6) as share from results" for c in CAPS))
def _(s, d):
    return metrics.coverage(table(s, d, "results"), list(CAPS))


@query("op113_score_stats", "select source_type, count(v) as n, round(avg(v), 6) as mean, cast(trunc(quantile_cont(v, 0.5)) as bigint) as median, min(v) as low, max(v) as high, round(coalesce(stddev_samp(v), 0), 6) as deviation from (select source_type, cast(caption_aesthetic_score as double) as v from results where caption_aesthetic_score is not null) group by source_type")
def _(s, d):
    return metrics.score_stats(table(s, d, "results"), "caption_aesthetic_score", ["source_type"])


@query("op114_histogram", "select b as bin, count(v) as n from range(1, 11) t(b) left join (select least(greatest(cast(caption_aesthetic_score as int), 1), 10) as v from results where caption_aesthetic_score is not null) on v = b group by b")
def _(s, d):
    return metrics.histogram(table(s, d, "results"), F.col("caption_aesthetic_score")).withColumn("bin", F.col("bin").cast("long"))


@query("op115_pearson", "select l_returnflag, count(*) as n, round(covar_pop(l_quantity, l_extendedprice) / (stddev_pop(l_quantity) * stddev_pop(l_extendedprice)), 6) as r from lineitem group by l_returnflag")
def _(s, d):
    return metrics.pearson(table(s, d, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"])


@query("op116_all_present", "select count(*) as n, round(avg(cast(caption_setting is not null and caption_activity is not null and caption_description is not null as int)), 6) as share from results")
def _(s, d):
    full = F.col("caption_setting").isNotNull() & F.col("caption_activity").isNotNull() & F.col("caption_description").isNotNull()
    return table(s, d, "results").agg(F.count("*").alias("n"), F.round(F.avg(full.cast("int")), 6).alias("share"))


@query("op117_non_null_counts", "select cast(caption_setting is not null as int) + cast(caption_activity is not null as int) + cast(caption_description is not null as int) as filled, count(*) as n from results group by 1")
def _(s, d):
    k = sum((F.col(c).isNotNull().cast("int") for c in CAPS[:3]), F.lit(0))
    return table(s, d, "results").groupBy(k.alias("filled")).agg(F.count("*").alias("n"))


@query("op118_face_rates", "select coalesce(face_count > 0, false) as has_face, count(*) as n, round(avg(cast(coalesce(quality_bucket = 'great', false) as int)), 6) as rate from results group by 1")
def _(s, d):
    return metrics.rates(table(s, d, "results"), F.coalesce(F.col("face_count") > 0, F.lit(False)), F.col("quality_bucket") == "great", "has_face")


@query("op119_quartile_rates", "with q as (select quantile_cont(c_acctbal, 0.25) a, quantile_cont(c_acctbal, 0.5) b, quantile_cont(c_acctbal, 0.75) c from customer) select case when c_acctbal <= a then 1 when c_acctbal <= b then 2 when c_acctbal <= c then 3 else 4 end as quartile, count(*) as n, round(avg(cast(c_mktsegment = 'BUILDING' as int)), 6) as rate from customer, q group by 1")
def _(s, d):
    return metrics.rates(metrics.quartiles(table(s, d, "customer"), "c_acctbal"), F.col("quartile"), F.col("c_mktsegment") == "BUILDING", "quartile")


@query("op120_category_rates", "select coalesce(caption_setting, '(none)') as setting, count(*) as n, round(avg(cast(composite >= 0.5 as int)), 6) as rate from results group by 1")
def _(s, d):
    return metrics.rates(table(s, d, "results"), F.coalesce("caption_setting", F.lit("(none)")), F.col("composite") >= 0.5, "setting")


LABELS = ["none", "bad", "okay", "good"]
JUDGED = "(select lower(l.label) as truth, lower(r.pred_label) as guess from labels l join results r on r.video_path = l.video_path and r.timestamp_s = l.timestamp_s)"


def judged(s, d):
    r = table(s, d, "results").select("video_path", "timestamp_s", F.lower("pred_label").alias("guess"))
    return table(s, d, "labels").select("video_path", "timestamp_s", F.lower("label").alias("truth")).join(r, ["video_path", "timestamp_s"])


@query("op121_confusion", f"select t.truth, count_if(j.guess = 'none') as as_none, count_if(j.guess = 'bad') as as_bad, count_if(j.guess = 'okay') as as_okay, count_if(j.guess = 'good') as as_good from (values ('none'), ('bad'), ('okay'), ('good')) t(truth) left join {JUDGED} j on j.truth = t.truth group by t.truth")
def _(s, d):
    return metrics.confusion(judged(s, d), "truth", "guess", LABELS)


@query("op122_class_scores", f"select label, round(p, 6) as precision, round(r, 6) as recall, round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 6) as f1, support from (select label, support, case when said > 0 then tp / said else 0 end as p, case when support > 0 then tp / support else 0 end as r from (select t.label, count_if(j.truth = t.label and j.guess = t.label) as tp, count_if(j.guess = t.label) as said, count_if(j.truth = t.label) as support from (values ('none'), ('bad'), ('okay'), ('good')) t(label) cross join {JUDGED} j group by t.label))")
def _(s, d):
    return metrics.class_scores(judged(s, d), "truth", "guess", LABELS)


@query("op123_class_weights", "select label_id, round(case lower(label) when 'good' then 2.0 else 1.0 end / count(*) over (partition by lower(label)), 9) as weight from labels")
def _(s, d):
    lab = table(s, d, "labels").select("label_id", F.lower("label").alias("label"))
    return metrics.class_weights(lab, "label", {"good": 2.0}).select("label_id", F.round("weight", 9).alias("weight"))


@query("op125_stats_line", "select count(caption_aesthetic_score) as n, round(avg(caption_aesthetic_score), 6) as mean, median(caption_aesthetic_score) as median from results where caption_model is not null")
def _(s, d):
    r = table(s, d, "results").filter("caption_model is not null")
    c = F.col("caption_aesthetic_score")
    return r.agg(F.count(c).alias("n"), F.round(F.avg(c), 6).alias("mean"), F.median(c).alias("median"))


@query("op126_text_stats", r"select count(*) as n, round(avg(w), 6) as mean, round(stddev_pop(w), 6) as deviation, min(w) as low, max(w) as high from (select len(regexp_extract_all(caption_description, '[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200c}\x{200d}]+')) as w from results where caption_description is not null)")
def _(s, d):
    r = table(s, d, "results").filter("caption_description is not null").select(X.word_count(F.col("caption_description")).cast("long").alias("w"))
    return r.agg(F.count("*").alias("n"), F.round(F.avg("w"), 6).alias("mean"), F.round(F.stddev_pop("w"), 6).alias("deviation"), F.min("w").alias("low"), F.max("w").alias("high"))


@query("op127_review_summary", "select case when greatest(p_none, p_bad, p_okay, p_good) < 0.5 then 'uncertain' else pred_label end as class, count(*) as n from results group by 1")
def _(s, d):
    from framelake.operators.views import review_class

    return table(s, d, "results").groupBy(review_class(F.greatest("p_none", "p_bad", "p_okay", "p_good"), F.col("pred_label")).alias("class")).agg(F.count("*").alias("n"))


@query("op129_rate_deltas", "with a as (select run_name, count(*) as n, count_if(duration_s is null or isnan(duration_s)) as unread from manifest group by 1), b as (select * from a where run_name = 'lake_house') select a.run_name, a.n - b.n as delta, a.unread > b.unread + 2 as flagged from a, b")
def _(s, d):
    a = table(s, d, "manifest").groupBy("run_name").agg(F.count("*").alias("n"), F.count_if(F.col("duration_s").isNull() | F.isnan("duration_s")).alias("unread"))
    b = a.filter("run_name = 'lake_house'").select(F.col("n").alias("n0"), F.col("unread").alias("u0")).limit(1)
    return a.join(F.broadcast(b), how="inner").select("run_name", (F.col("n") - F.col("n0")).alias("delta"), (F.col("unread") > F.col("u0") + 2).alias("flagged"))


@query("op131_prediction_counts", "select pred_label, count(*) as n, round(avg(face_det_score), 6) as confidence from results where face_det_score is not null and not isnan(face_det_score) group by pred_label")
def _(s, d):
    r = table(s, d, "results").filter("face_det_score is not null and not isnan(face_det_score)")
    return r.groupBy("pred_label").agg(F.count("*").alias("n"), F.round(F.avg("face_det_score"), 6).alias("confidence"))




@query("op178_key_values", "select raw_id, " + ", ".join(f"{X.last_value_sql('prompt1_raw', k)} as {k}" for k in ("setting", "activity")) + " from raw_outputs_a")
def _(s, d):
    r = table(s, d, "raw_outputs_a").select("raw_id", X.key_values(F.col("prompt1_raw"), ("setting", "activity")).alias("v"))
    return r.select("raw_id", "v.setting", "v.activity")


@query("op179_multiline_values")
def _(s, d):
    r = table(s, d, "raw_outputs_a")
    return r.select("raw_id", *[X.multiline_value(F.col("prompt1_raw"), k, ("setting", "activity", "mood")).alias(k) for k in ("setting", "activity", "mood")])


@query("op181_first_int", r"select event_id, least(greatest(cast(nullif(regexp_extract(props, '\d+', 0), '') as int), 1), 10) as score from events")
def _(s, d):
    return table(s, d, "events").select("event_id", X.first_int(F.col("props")).alias("score"))


@query("op182_malformed", "select count(*) as n from results where caption_model is not null and (caption_setting is null or caption_activity is null or caption_description is null or caption_aesthetic_score is null)")
def _(s, d):
    bad = F.col("caption_setting").isNull() | F.col("caption_activity").isNull() | F.col("caption_description").isNull() | F.col("caption_aesthetic_score").isNull()
    return table(s, d, "results").filter(F.col("caption_model").isNotNull() & bad).agg(F.count("*").alias("n"))


@query("op183_text_predicates", "select row_id, not regexp_matches(caption_description, '^(A|An|The)\\b') as no_article, contains(caption_description, ' and ') or contains(caption_description, ', ') as compound from results where caption_description is not null")
def _(s, d):
    r = table(s, d, "results").filter("caption_description is not null")
    c = F.col("caption_description")
    return r.select("row_id", (~c.rlike(r"^(A|An|The)\b")).alias("no_article"), (c.contains(" and ") | c.contains(", ")).alias("compound"))


@query("op184_flags", "select row_id, concat_ws(',', case when trim(caption_description, ' ') = '' then 'empty' end, case when starts_with(lower(caption_description), 'in the ') then 'prefix' end, case when row_number() over (partition by lower(trim(caption_description, ' ')) order by row_id) > 1 then 'duplicate' end) as flags from results where caption_description is not null")
def _(s, d):
    c = F.col("caption_description")
    r = table(s, d, "results").filter(c.isNotNull()).select("row_id", "caption_description", F.lower(F.trim(c)).alias("norm"))
    first = r.groupBy("norm").agg(F.min("row_id").alias("first"))
    flags = F.array(F.when(F.trim(c) == "", "empty"), F.when(F.lower(c).startswith("in the "), "prefix"), F.when(F.col("row_id") > F.col("first"), "duplicate"))
    return r.join(first, "norm").select("row_id", F.array_join(flags, ",").alias("flags"))


@query("op185_after_kept", "select row_id, case when instr(kept_path, '/kept/') > 0 then substr(kept_path, instr(kept_path, '/kept/') + 6) else kept_path end as short from results")
def _(s, d):
    return table(s, d, "results").select("row_id", X.after_kept(F.col("kept_path")).alias("short"))


@query("op186_shorten", r"select row_id, case when length(f) > 40 then substr(f, 1, 39) || '…' else f end as short from (select row_id, regexp_replace(caption_description, '[\r\n]+', ' ', 'g') as f from results)")
def _(s, d):
    return table(s, d, "results").select("row_id", X.shorten(F.col("caption_description"), 40).alias("short"))


@query("op087_card_key", r"select row_id, video_stem || '/' || regexp_extract(kept_path, '([^/\\]*)$', 1) as card from results")
def _(s, d):
    return table(s, d, "results").select("row_id", X.card_key(F.col("video_stem"), F.col("kept_path")).alias("card"))


@query("op088_safe_double", r"select label_id, try_cast(regexp_extract(face_crop_path, '_(\d+\.\d+)\.', 1) as double) as seconds from labels")
def _(s, d):
    return table(s, d, "labels").select("label_id", X.safe_double(F.regexp_extract("face_crop_path", r"_(\d+\.\d+)\.", 1)).alias("seconds"))


@query("op089_forward_slashes", r"select label_id, replace(face_crop_path, '\', '/') as path from labels")
def _(s, d):
    return table(s, d, "labels").select("label_id", X.forward_slashes(F.col("face_crop_path")).alias("path"))


@query("op090_json_numbers", "select event_id, cast(json_extract_string(props, '$.k') as double) as k from events")
def _(s, d):
    return table(s, d, "events").select("event_id", F.get(X.json_numbers(F.concat(F.lit("["), F.get_json_object("props", "$.k"), F.lit("]"))), F.lit(0)).alias("k"))


@query("op093_digests", "select row_id, sha256(video_path || '|' || row_id)[1:12] as id, md5(video_path) as digest from results")
def _(s, d):
    return table(s, d, "results").select("row_id", X.natural_id(F.col("video_path"), F.col("row_id")).alias("id"), F.md5("video_path").alias("digest"))


_Y8 = r"(?:^|\D)(20\d{2})(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])(?:\D|$)"
_YM = r"(20\d{2})[-_./]?(0[1-9]|1[0-2])(?:\D|$)"
_MN = rf"(?i)(?:^|[^a-z])({X.MONTH_NAMES})(?:[\s_.-]+[0-3]?\d)?[\s_.-]?(20\d{{2}})(?:\D|$)"
_YY = r"(?:^|\D)(20\d{2})(?:\D|$)"
_ISO = rf"^{X.BLANK}*(\d{{4}})(?:-(0[1-9]|1[0-2])-\d{{2}}|(0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])(?:\D|$))"


def _whole(column: str, pattern: str, *groups: int) -> str:
    return "cast(nullif(" + " || ".join(f"regexp_extract({column}, '{pattern}', {g})" for g in groups) + ", '') as int)"


def path_date_sql(c: str) -> str:
    months = ", ".join(f"'{m.lower()}'" for m in X.MONTHS_SHORT)
    return (
        f"case when regexp_matches({c}, '{_Y8}') then [{_whole(c, _Y8, 1)}, {_whole(c, _Y8, 2)}] when regexp_matches({c}, '{_YM}') then [{_whole(c, _YM, 1)}, {_whole(c, _YM, 2)}] "
        f"when regexp_matches({c}, '{_MN}') then [{_whole(c, _MN, 2)}, cast(list_position([{months}], lower(left(regexp_extract({c}, '{_MN}', 1), 3))) as int)] "
        f"when regexp_matches({c}, '{_YY}') then [{_whole(c, _YY, 1)}, 0] else [0, 0] end"
    )


def iso_date_sql(c: str) -> str:
    return f"case when {_whole(c, _ISO, 1)} >= 2000 then [{_whole(c, _ISO, 1)}, {_whole(c, _ISO, 2, 3)}] end"


@query("op096_path_dates", f"select distinct file_path, d[1] as year, d[2] as month from (select file_path, {path_date_sql('file_path')} as d from manifest)")
def _(s, d):
    return table(s, d, "manifest").select("file_path", X.path_year_month(F.col("file_path")).alias("d")).distinct().select("file_path", "d.*")


# every second row is asked as a still, which has its EXIF date in the first tag, in the second or in none
_STILL = "row_id % 2 = 0"


@query("op095_source_date", f"""select row_id, cast(d[1] as int) as year, cast(d[2] as int) as month, source from (select row_id,
  case when {_STILL} and row_id % 3 = 0 then [year(processed_at), month(processed_at)] when {_STILL} and row_id % 3 = 1 then [year(processed_at), month(processed_at)]
       when not ({_STILL}) and iso is not null then iso when p[1] > 0 then p else [year(processed_at), month(processed_at)] end as d,
  case when {_STILL} and row_id % 3 = 0 then 'exif_primary' when {_STILL} and row_id % 3 = 1 then 'exif_fallback'
       when not ({_STILL}) and iso is not null then 'video_metadata' when p[1] > 0 then 'path_regex' else 'mtime' end as source
  from (select row_id, processed_at, {iso_date_sql('caption_timestamp')} as iso, {path_date_sql('path')} as p from (select *, case when {_STILL} then coalesce(kept_path, 'x') || '.jpg' else 'clip.mkv' end as path from results)))""")
def _(s, d):
    even, kind = F.col("row_id") % 2 == 0, F.col("row_id") % 3
    exif = F.date_format("processed_at", "yyyy:MM:dd HH:mm:ss")
    path = F.when(even, F.concat(F.coalesce("kept_path", F.lit("x")), F.lit(".jpg"))).otherwise("clip.mkv")
    date = X.source_date(F.when(kind == 0, exif), F.when(kind == 1, F.concat(exif, F.lit("\0"))).otherwise("0000:00:00 00:00:00"), F.col("caption_timestamp"), path, F.col("processed_at").cast("timestamp"))
    return table(s, d, "results").select("row_id", date.alias("s")).select("row_id", "s.*")


@query("op097_exif_dates", "select o_orderkey, year(o_orderdate) as year, month(o_orderdate) as month from orders")
def _(s, d):
    t = F.date_format("o_orderdate", "yyyy:MM:dd HH:mm:ss")
    return table(s, d, "orders").select("o_orderkey", X.exif_year_month(t).alias("d")).select("o_orderkey", "d.*")


@query("op098_iso_dates", f"select row_id, d[1] as year, d[2] as month from (select row_id, {iso_date_sql('caption_timestamp')} as d from results)")
def _(s, d):
    return table(s, d, "results").select("row_id", X.iso_year_month(F.col("caption_timestamp")).alias("d")).select("row_id", "d.*")


@query("op099_section_labels", "select distinct printf('%d-%02d', source_year, source_month) as key, case when source_year = 0 then 'Unknown' when source_month = 0 then 'Unknown ' || source_year else list_extract(['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'], source_month) || ' ' || source_year end as label from results")
def _(s, d):
    y, m = F.col("source_year"), F.col("source_month")
    return table(s, d, "results").select(X.section_key(y, m).alias("key"), X.section_label(y, m).alias("label")).distinct()


@query("op194_label_case", "select label_id, case when lower(label) in ('none', 'bad', 'okay', 'good') then upper(lower(label)[1]) || lower(label)[2:] end as label from labels")
def _(s, d):
    lab = F.lower("label")
    return table(s, d, "labels").select("label_id", F.when(lab.isin(*LABELS), F.initcap(lab)).alias("label"))


@query("op197_rescored", "select row_id, round((p_good + quality_score) / 2, 6) as tta_good from results where p_good is not null and quality_score is not null")
def _(s, d):
    r = table(s, d, "results").dropna(subset=["p_good", "quality_score"])
    p = F.array("p_good", "quality_score")
    return r.select("row_id", F.round(F.aggregate(p, F.lit(0.0), lambda a, x: a + x) / F.size(p), 6).alias("tta_good"))


@query("op198_verdict", "select case when a > b then 'two-prompt' when b > a then 'combined' else 'two-prompt' end as verdict from (select avg(length(prompt1_raw)) as a, avg(length(prompt2_raw)) as b from raw_outputs_a)")
def _(s, d):
    a, b = F.avg(F.length("prompt1_raw")), F.avg(F.length("prompt2_raw"))
    return table(s, d, "raw_outputs_a").agg(F.when(a > b, "two-prompt").when(b > a, "combined").otherwise("two-prompt").alias("verdict"))


@query("op199_runtime_estimate", "select source_type, count(*) * 3.4 as batch_4, count(*) * 3.6 as batch_2, count(*) * 3.7 as batch_1 from results where caption_model is null group by source_type")
def _(s, d):
    n = F.count("*")
    return table(s, d, "results").filter("caption_model is null").groupBy("source_type").agg((n * 3.4).alias("batch_4"), (n * 3.6).alias("batch_2"), (n * 3.7).alias("batch_1"))


@query("op208_frozen_split", "select label_id, coalesce(is_val, false) as evaluation from labels")
def _(s, d):
    from framelake.operators.sampling import frozen_split

    return table(s, d, "labels").select("label_id", frozen_split(F.col("is_val")).alias("evaluation"))


@query("op057_export_counters", "select count(*) as asked, count_if(r is not null) as found, count_if(sha256 is not null) as hashed, count(distinct sha256) as kinds from (select l.*, (select min(row_id) from results r where r.video_path = l.video_path and r.timestamp_s = l.timestamp_s) as r from labels l)")
def _(s, d):
    r = table(s, d, "results").groupBy("video_path", "timestamp_s").agg(F.min("row_id").alias("r"))
    j = table(s, d, "labels").join(r, ["video_path", "timestamp_s"], "left")
    return j.agg(F.count("*").alias("asked"), F.count("r").alias("found"), F.count("sha256").alias("hashed"), F.countDistinct("sha256").alias("kinds"))


@query("op244_content_dedup", "select min(doc_id) as doc_id from documents where text is not null group by md5(text)")
def _(s, d):
    docs = table(s, d, "documents").filter("text is not null").select("doc_id", F.md5("text").alias("h"))
    return docs.groupBy("h").agg(F.min("doc_id").alias("doc_id")).select("doc_id")



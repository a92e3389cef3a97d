"""Queries over keeper rows: gates, scores, order, views (operators 21 to 35, 65 to 82, 105 to 111, 161 to 192)."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelake.functions import scoring as S
from framelake.functions import text as X
from framelake.operators import dedup, metrics, sampling, selection, views
from framelake.plans.registry import query, table

AREA_SQL = "case when face_x1 is not null and face_y1 is not null and face_x2 is not null and face_y2 is not null and frame_w > 0 and frame_h > 0 then least(greatest(cast(greatest(face_x2 - face_x1, 0) as double) * greatest(face_y2 - face_y1, 0) / (cast(frame_w as double) * frame_h), 0.0), 1.0) end"
NN = "case when isnan({0}) then null else {0} end"
SCORE_SQL = "case when p_okay is not null or p_good is not null then least(greatest(0.5 * coalesce(p_okay, 0.0) + coalesce(p_good, 0.0), 0.0), 1.0) end"
QUALITY_SQL = f"least(greatest(coalesce(0.6 * ({SCORE_SQL}) + 0.3 * least(greatest(coalesce({NN.format('aesthetics_norm')}, 0.0), 0.0), 1.0) + 0.1 * coalesce({AREA_SQL}, 0.0), least(greatest(coalesce({NN.format('aesthetics_norm')}, 0.0), 0.0), 1.0) * 0.72), 0.0), 1.0)"
DATE_OF = "make_timestamp(cast(epoch_us(processed_at) as bigint))"


def box():
    return [F.col(f"face_{k}") for k in ("x1", "y1", "x2", "y2")]


def scored(r):
    """Keeper rows with their scores; a frame here has at most one face."""
    s = F.array(S.face_score(F.col("p_okay"), F.col("p_good")))
    a = F.array(S.area_fraction(*box(), F.col("frame_w"), F.col("frame_h")))
    return r.withColumn("score", S.quality_score(s, a, S.no_nan(F.col("aesthetics_norm"))))


@query("op021_sharpness_gate", "select row_id, sharpness_center from results where sharpness_center >= 75")
def _(s, d):
    return table(s, d, "results").filter(F.col("sharpness_center") >= 75).select("row_id", "sharpness_center")


@query("op022_face_gate", "select row_id, face_x2 - face_x1 as width, (face_x2 - face_x1) * (face_y2 - face_y1) as area from results where face_x2 - face_x1 >= 80")
def _(s, d):
    r = table(s, d, "results")
    w = F.col("x2") - F.col("x1")
    faces = F.filter(F.array(F.struct(*[F.col(f"face_{k}").alias(k) for k in ("x1", "y1", "x2", "y2")])), lambda f: f["x2"] - f["x1"] >= 80)
    by_area = F.array_sort(faces, lambda a, b: (b["x2"] - b["x1"]) * (b["y2"] - b["y1"]) - (a["x2"] - a["x1"]) * (a["y2"] - a["y1"]))
    f = r.select("row_id", F.explode(by_area).alias("f")).select("row_id", "f.*")
    return f.select("row_id", w.alias("width"), (w * (F.col("y2") - F.col("y1"))).alias("area"))


REASON_SQL = "case when area < 0.004 then printf('too_small(%.4f<0.004)', area) when area < 0.025 and (cx < 0.1 * frame_w or cx > 0.9 * frame_w or cy < 0.1 * frame_h or cy > 0.9 * frame_h) then printf('small_and_edge(%.4f)', area) end"
FACES_SQL = "(select *, cast(face_x2 - face_x1 as double) * (face_y2 - face_y1) / (cast(frame_w as double) * frame_h) as area, (face_x1 + face_x2) / 2.0 as cx, (face_y1 + face_y2) / 2.0 as cy from results where face_x1 is not null)"


@query("op023_face_rejection", f"select row_id, {REASON_SQL} as reason from {FACES_SQL}")
def _(s, d):
    return table(s, d, "results").filter("face_x1 is not null").select("row_id", S.rejection(*box(), F.col("frame_w"), F.col("frame_h")).alias("reason"))


@query("op024_split_rejected", f"select row_id, {REASON_SQL} is null as passing from {FACES_SQL}")
def _(s, d):
    r = table(s, d, "results").filter("face_x1 is not null").withColumn("faces", F.array(F.struct(S.rejection(*box(), F.col("frame_w"), F.col("frame_h")).alias("reason"))))
    ok = F.filter("faces", lambda f: f["reason"].isNull())
    return r.select("row_id", (F.size(ok) > 0).alias("passing"))


@query("op103_rejection_counts", f"select kind, count(*) as n from (select split_part({REASON_SQL}, '(', 1) as kind from {FACES_SQL}) where kind is not null group by kind union all select 'frames_without_face', count(*) from (select {REASON_SQL} as r from {FACES_SQL}) where r is not null")
def _(s, d):
    r = table(s, d, "results").filter("face_x1 is not null").withColumn("reason", S.rejection(*box(), F.col("frame_w"), F.col("frame_h")))
    kinds = F.filter(F.array(S.rejection_kind(F.col("reason"))), lambda k: k.isNotNull())
    return metrics.rejection_counts(r, kinds, F.col("reason").isNull().cast("int"))


@query("op026_minimum_quality", "select row_id, lower(pred_label) as label from results where lower(pred_label) in ('good', 'okay')")
def _(s, d):
    return table(s, d, "results").filter(views.at_least(F.col("pred_label"), "okay")).select("row_id", F.lower("pred_label").alias("label"))


@query("op028_to_caption", "select row_id from results where caption_description is null and lower(pred_label) = 'good'")
def _(s, d):
    return views.to_caption(table(s, d, "results").filter(views.at_least(F.col("pred_label"), "good")), "caption_description").select("row_id")


@query("op029_view_filter", "select source_year, source_month, count(*) as n from results where lower(pred_label) in ('good', 'okay') and quality_bucket in ('high', 'great') and source_type = 'video' group by all")
def _(s, d):
    f = views.ViewFilter(qualities=frozenset({"good", "okay"}), buckets=frozenset({"high", "great"}), source="video")
    r = views.apply_filter(table(s, d, "results"), f, "pred_label", F.lit(None).cast("array<string>"), "quality_bucket", "source_type", F.lit(None).cast("boolean"))
    return r.groupBy("source_year", "source_month").agg(F.count("*").alias("n"))


@query("op029a_quality_toggle", "select row_id from results where case when lower(pred_label) in ('none', 'bad', 'okay', 'good') then lower(pred_label) else 'none' end = 'none'")
def _(s, d):
    return table(s, d, "results").filter(views.ViewFilter(qualities=frozenset({"none"})).quality(F.col("pred_label"))).select("row_id")


@query("op029b_people_and_or", "select user_id, bool_or(event_type = 'purchase') and bool_or(event_type = 'error') as every, bool_or(event_type in ('purchase', 'error')) as some from events group by user_id")
def _(s, d):
    e = table(s, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("names"))
    want = frozenset({"purchase", "error"})
    return e.select("user_id", views.ViewFilter(people=want, all_people=True).person(F.col("names")).alias("every"), views.ViewFilter(people=want).person(F.col("names")).alias("some"))


@query("op030_review_filter", "select label_id, case when l.label is null then 'unreviewed' else lower(l.label) end as truth, case when p_max < 0.5 then 'uncertain' else pred end as shown from (select l.*, r.p_max, r.pred from labels l left join (select video_path, timestamp_s, greatest(p_none, p_bad, p_okay, p_good) as p_max, pred_label as pred from results qualify row_number() over (partition by video_path, timestamp_s order by row_id) = 1) r on r.video_path = l.video_path and r.timestamp_s = l.timestamp_s) l")
def _(s, d):
    from framelake.operators.joins import first_match

    r = table(s, d, "results").select("row_id", "video_path", "timestamp_s", F.greatest("p_none", "p_bad", "p_okay", "p_good").alias("p_max"), F.col("pred_label").alias("pred"))
    j = first_match(table(s, d, "labels"), r, ["video_path", "timestamp_s"], [F.col("row_id")])
    return j.select("label_id", F.coalesce(F.lower("label"), F.lit("unreviewed")).alias("truth"), views.review_class(F.col("p_max"), F.col("pred")).alias("shown"))


@query("op031_with_face", "select row_id from results where face_x1 is not null and pred_label is not null")
def _(s, d):
    return table(s, d, "results").dropna(subset=["face_x1", "pred_label"]).select("row_id")


@query("op034_valid_keepers", "select row_id from results where length(video_path) > 0 and length(kept_path) > 0")
def _(s, d):
    return table(s, d, "results").filter((F.length("video_path") > 0) & (F.length("kept_path") > 0)).select("row_id")


@query("op035_upright_label", "select row_id, case when deg in (90, 180, 270) and conf >= 0.95 then deg end as shown from (select row_id, (row_id % 4) * 90 as deg, face_det_score as conf from results)")
def _(s, d):
    return table(s, d, "results").select("row_id", S.upright_label((F.col("row_id") % 4) * 90, F.col("face_det_score")).alias("shown"))


@query("op065_temporal_dedup", """with recursive e as (select user_id, event_id, epoch_us(ts) / 1e6 as t, row_number() over (partition by user_id order by ts, event_id) as rn from events),
  f as (select user_id, event_id, rn, t as last, true as keep from e where rn = 1
    union all select e.user_id, e.event_id, e.rn, case when e.t - f.last >= 7200 then e.t else f.last end, e.t - f.last >= 7200 from f join e on e.user_id = f.user_id and e.rn = f.rn + 1)
  select user_id, event_id from f where keep""")
def _(s, d):
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return dedup.greedy_spacing(table(s, d, "events"), ["user_id"], t, "event_id", 7200).select("user_id", "event_id")


def _hashed(s, d):
    """A 64-bit similarity hash of the whole text, so near texts have near codes."""
    docs = table(s, d, "documents").filter("text is not null and length(text) > 0")
    return docs.select("doc_id", "source", "n_chars", dedup.similarity_code(F.col("text")).alias("code"))


@query("op066_hamming_greedy")
def _(s, d):
    return dedup.greedy_hamming(_hashed(s, d), "doc_id", "code", "n_chars", 8, ["source"]).select("doc_id")


@query("op067_two_stage_hamming")
def _(s, d):
    h = _hashed(s, d).withColumn("second", F.shiftleft("code", 8))
    one = dedup.greedy_hamming(h, "doc_id", "code", "n_chars", 4, ["source"])
    return dedup.greedy_hamming(one, "doc_id", "second", "n_chars", 4, ["source"]).select("doc_id")


@query("op068_cross_file_dedup")
def _(s, d):
    return dedup.greedy_hamming(_hashed(s, d), "doc_id", "code", "n_chars", 8).select("doc_id")


@query("op069_topk_per_file", "select video_path, row_id, composite from results where composite >= 0.5 qualify row_number() over (partition by video_path order by composite desc, row_id) <= 5")
def _(s, d):
    r = table(s, d, "results").filter("composite >= 0.5").select("video_path", "row_id", "composite")
    return selection.top_k(r, ["video_path"], [F.desc("composite"), F.col("row_id")], 5)


@query("op070_video_cap", "select row_id, n > 10 as over_cap from (select row_id, count(*) over (partition by video_path) as n, row_number() over (partition by video_path order by composite desc, row_id) as rn from results) where rn <= 10")
def _(s, d):
    r = table(s, d, "results").select("row_id", "video_path", "composite")
    return selection.cap_groups(r, ["video_path"], [F.desc("composite"), F.col("row_id")], 10).select("row_id", "over_cap")


@query("op071_rank_faces", "select video_path, max(case when rn = 1 then row_id end) as face_1, max(case when rn = 2 then row_id end) as face_2, max(case when rn = 3 then row_id end) as face_3 from (select *, row_number() over (partition by video_path order by p_good desc nulls last, row_id) as rn from results) where rn <= 3 group by video_path")
def _(s, d):
    top = selection.top_k(table(s, d, "results").select("video_path", "row_id", "p_good"), ["video_path"], [F.desc_nulls_last("p_good"), F.col("row_id")], 3)
    f = top.groupBy("video_path").agg(F.array_sort(F.collect_list(F.struct(F.col("p_good").isNull().alias("n"), (-F.col("p_good")).alias("p"), "row_id"))).alias("f"))
    return f.select("video_path", *[F.get("f", F.lit(k))["row_id"].alias(f"face_{k + 1}") for k in range(3)])


@query("op073_best_of_similar", "select caption_setting, first(row_id order by quality_score desc nulls last, row_id) as best from results where caption_setting is not null group by caption_setting")
def _(s, d):
    r = table(s, d, "results").filter("caption_setting is not null").select("caption_setting", "quality_score", "row_id")
    return selection.top_k(r, ["caption_setting"], [F.desc_nulls_last("quality_score"), F.col("row_id")], 1).select("caption_setting", F.col("row_id").alias("best"))


@query("op075_caption_order", "select row_id, row_number() over (order by caption_aesthetic_score desc nulls last, coalesce(composite, 0) desc, row_id) as place from results where caption_model is not null")
def _(s, d):
    r = table(s, d, "results").filter("caption_model is not null")
    return selection.global_rank(r.select("row_id", "caption_aesthetic_score", F.coalesce("composite", F.lit(0.0)).alias("c")), [F.desc_nulls_last("caption_aesthetic_score"), F.desc("c"), "row_id"], "place").select("row_id", "place")


@query("op078_section_order", "select source_year, source_month, row_number() over (order by (source_year = 0 and source_month = 0), source_year desc, source_month desc) as place from (select distinct source_year, source_month from results)")
def _(s, d):
    sec = table(s, d, "results").select("source_year", "source_month").distinct().withColumn("last", (F.col("source_year") == 0) & (F.col("source_month") == 0))
    return selection.global_rank(sec, ["last", F.desc("source_year"), F.desc("source_month")], "place").select("source_year", "source_month", "place")


@query("op079_within_section", "select row_id, row_number() over (partition by source_year, source_month order by g, video_stem, t, composite desc, row_id) as position from (select *, min(t) over (partition by source_year, source_month, video_stem) as g from (select *, coalesce(case when isnan(timestamp_s) then null else timestamp_s end, 0) as t from results))")
def _(s, d):
    r = table(s, d, "results").withColumn("t", F.coalesce(S.no_nan(F.col("timestamp_s")), F.lit(0.0)))
    return selection.section_rank(r, ["source_year", "source_month"], "video_stem", F.col("t"), [F.desc("composite"), F.col("row_id")]).select("row_id", "position")


@query("op080_followers", "select row_id, row_number() over (order by coalesce(lead, pos), not rep, pos) as place from (select *, min(case when rep then pos end) over (partition by grp) as lead from (select row_id, row_id as pos, video_path as grp, row_number() over (partition by video_path order by composite desc, row_id) = 1 as rep from results))")
def _(s, d):
    r = table(s, d, "results").select("row_id", F.col("row_id").alias("pos"), F.col("video_path").alias("grp"), "composite")
    best = selection.top_k(r, ["grp"], [F.desc("composite"), F.col("row_id")], 1).select("row_id", F.lit(True).alias("rep"))
    r = r.join(best, "row_id", "left").fillna(False, ["rep"])
    return selection.followers_after_representative(r, "pos", "grp", "rep").select("row_id", "place")


@query("op081_top_bottom", "(select row_id, 'top' as side from results where composite is not null order by composite desc, row_id limit 10) union all (select row_id, 'bottom' as side from results where composite is not null order by composite, row_id limit 10)")
def _(s, d):
    r = table(s, d, "results").filter("composite is not null")
    top, low = (r.orderBy(o, "row_id").limit(10).select("row_id", F.lit(n).alias("side")) for o, n in ((F.desc("composite"), "top"), (F.asc("composite"), "bottom")))
    return top.unionByName(low)


@query("op082_spot_check", "select quality_bucket, row_id from results qualify row_number() over (partition by quality_bucket order by quality_score, row_id) <= 3")
def _(s, d):
    return selection.top_k(table(s, d, "results").select("quality_bucket", "row_id", "quality_score"), ["quality_bucket"], [F.asc_nulls_last("quality_score"), F.col("row_id")], 3).select("quality_bucket", "row_id")


@query("op086_justified_lines")
def _(s, d):
    r = table(s, d, "results").select("row_id", "source_year", "source_month", "frame_w", "frame_h")
    return selection.justify(r, ["source_year", "source_month"], [F.col("row_id")], F.col("frame_w") / F.col("frame_h"), 1200.0).select("row_id", "line")


@query("op109_sections_rollup", "select source_year, source_month, count(*) as n from results group by rollup (source_year, source_month)")
def _(s, d):
    return views.section_counts(table(s, d, "results"), "source_year", "source_month")


@query("op107_group_sizes", "select video_path, count(*) as size, count(*) >= 2 as grouped from results group by video_path")
def _(s, d):
    return table(s, d, "results").groupBy("video_path").agg(F.count("*").alias("size")).withColumn("grouped", F.col("size") >= 2)


@query("op110_source_counts", "select count_if(source_type = 'image') as images, count_if(source_type = 'video') as videos, count_if(face_count > 0) as faces from results")
def _(s, d):
    return table(s, d, "results").agg(F.count_if(F.col("source_type") == "image").alias("images"), F.count_if(F.col("source_type") == "video").alias("videos"), F.count_if(F.col("face_count") > 0).alias("faces"))


@query("op130_year_state", "select source_year, count(*) as sections, cast(sum(v) as bigint) as shown, case when sum(v) = count(*) then 'checked' when sum(v) > 0 then 'indeterminate' else 'none' end as state from (select source_year, source_month, max(cast(quality_bucket = 'great' as int)) as v from results group by all) group by source_year")
def _(s, d):
    return views.year_states(table(s, d, "results"), "source_year", "source_month", F.col("quality_bucket") == "great")


@query("op155_toggle", "select user_id, array_to_string(list_sort(list_concat(list_filter(a, lambda x: not list_contains(b, x)), list_filter(b, lambda x: not list_contains(a, x)))), ',') as chosen from (select user_id, list(distinct event_type) filter (value > 50) as a, list(distinct event_type) filter (value > 90) as b from events group by user_id) where a is not null and b is not null")
def _(s, d):
    e = table(s, d, "events").groupBy("user_id").agg(F.collect_set(F.when(F.col("value") > 50, F.col("event_type"))).alias("a"), F.collect_set(F.when(F.col("value") > 90, F.col("event_type"))).alias("b"))
    return e.filter((F.size("a") > 0) & (F.size("b") > 0)).select("user_id", F.array_join(views.toggled(F.col("a"), F.col("b")), ",").alias("chosen"))


@query("op156_range_select", "select row_id from (select row_id, row_number() over (order by row_id) as pos from results where source_year = 2022 and source_month = 7) where pos between 3 and 9")
def _(s, d):
    r = table(s, d, "results").filter("source_year = 2022 and source_month = 7")
    return views.between_items(selection.global_rank(r, ["row_id"], "pos"), "source_month", "pos", 9, 3).select("row_id")


@query("op161_aesthetics_norm", "select row_id, case when caption_aesthetic_score is not null then least(greatest((caption_aesthetic_score - 1.0) / 9.0, 0.0), 1.0) end as norm from results")
def _(s, d):
    return table(s, d, "results").select("row_id", S.aesthetics_norm(F.col("caption_aesthetic_score").cast("double")).alias("norm"))


@query("op162_composite", f"select row_id, round(coalesce(0.8 * p_good + (1 - 0.8) * {NN.format('aesthetics_norm')}, {NN.format('aesthetics_norm')}), 6) as score from results")
def _(s, d):
    return table(s, d, "results").select("row_id", F.round(S.composite(F.col("p_good"), S.no_nan(F.col("aesthetics_norm"))), 6).alias("score"))


@query("op163_best_pair", "select video_path, round((max(case when rn = 1 then p_good end) + max(case when rn = 2 then p_good end)) / 2.0, 6) as pair from (select *, row_number() over (partition by video_path order by p_good desc nulls last, row_id) as rn from results) group by video_path")
def _(s, d):
    top = selection.top_k(table(s, d, "results").select("video_path", "row_id", "p_good"), ["video_path"], [F.desc_nulls_last("p_good"), F.col("row_id")], 2)
    p = top.groupBy("video_path").agg(F.sort_array(F.collect_list("p_good"), asc=False).alias("p"))
    return p.select("video_path", F.round(S.best_pair(F.col("p")), 6).alias("pair"))


@query("op164_predicted_label", "select row_id, case when p_none is null or p_bad is null or p_okay is null or p_good is null then null when p_none >= p_bad and p_none >= p_okay and p_none >= p_good then 'none' when p_bad >= p_okay and p_bad >= p_good then 'bad' when p_okay >= p_good then 'okay' else 'good' end as label, greatest(p_none, p_bad, p_okay, p_good) as p from results where p_none is not null and p_bad is not null and p_okay is not null and p_good is not null")
def _(s, d):
    r = table(s, d, "results").dropna(subset=["p_none", "p_bad", "p_okay", "p_good"])
    label, p = S.predicted([F.col(f"p_{k}") for k in S.LABELS])
    return r.select("row_id", label.alias("label"), p.alias("p"))


@query("op165_face_score", f"select row_id, round({SCORE_SQL}, 6) as score from results")
def _(s, d):
    return table(s, d, "results").select("row_id", F.round(S.face_score(F.col("p_okay"), F.col("p_good")), 6).alias("score"))


@query("op166_area_fraction", f"select row_id, round({AREA_SQL}, 6) as area from results")
def _(s, d):
    return table(s, d, "results").select("row_id", F.round(S.area_fraction(*box(), F.col("frame_w"), F.col("frame_h")), 6).alias("area"))


@query("op167_face_quality", "select l_orderkey, round(least(max(sc) + least(0.15 * coalesce(sum(sc) filter (rn > 1 and sc >= 0.4), 0), 0.25), 1.0), 6) as q from (select l_orderkey, l_discount * 8 as sc, row_number() over (partition by l_orderkey order by l_discount desc, l_linenumber) as rn from lineitem) group by l_orderkey")
def _(s, d):
    li = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_discount") * 8).alias("f"))
    return li.select("l_orderkey", F.round(S.face_quality(F.col("f")), 6).alias("q"))


@query("op168_quality_score", f"select row_id, round({QUALITY_SQL}, 6) as score from results")
def _(s, d):
    return scored(table(s, d, "results")).select("row_id", F.round("score", 6).alias("score"))


@query("op169_bucket", "select row_id, case when quality_score < 0.35 then 'low' when quality_score < 0.55 then 'medium' when quality_score < 0.75 then 'high' else 'great' end as bucket from results where quality_score is not null")
def _(s, d):
    return table(s, d, "results").filter("quality_score is not null").select("row_id", S.bucket(F.col("quality_score")).alias("bucket"))


@query("op111_bucket_distribution", "with dom(bucket) as (values ('low'), ('medium'), ('high'), ('great')), c as (select case when quality_score < 0.35 then 'low' when quality_score < 0.55 then 'medium' when quality_score < 0.75 then 'high' else 'great' end as bucket, count(*) as n from results where quality_score is not null group by 1) select dom.bucket, coalesce(n, 0) as n from dom left join c using (bucket)")
def _(s, d):
    b = table(s, d, "results").filter("quality_score is not null").select(S.bucket(F.col("quality_score")).alias("bucket"))
    return metrics.filled_counts(b, "bucket", ["low", "medium", "high", "great"])


@query("op170_breakdown", f"select row_id, round({SCORE_SQL}, 3) as face, round({AREA_SQL}, 3) as area from results where row_id % 7 <> 9")
def _(s, d):
    r = table(s, d, "results")
    b = F.struct(F.round(S.face_score(F.col("p_okay"), F.col("p_good")), 3).alias("face"), F.round(S.area_fraction(*box(), F.col("frame_w"), F.col("frame_h")), 3).alias("area"))
    return r.select("row_id", b.alias("b")).select("row_id", "b.*")


@query("op171_keypoint_rules", "select l_orderkey, l_linenumber, concat_ws(',', case when not (l_tax < l_discount and l_discount < l_quantity / 50) then 'order' end, case when not (ratio between 0.25 and 0.75) then 'ratio' end, case when span < 0.25 then 'span' end) as reasons from (select *, case when l_quantity <> 0 then l_discount * 100 / l_quantity end as ratio, l_quantity / 100 as span from lineitem)")
def _(s, d):
    q = F.col("l_quantity")
    r = S.keypoint_anomalies(F.col("l_tax"), F.col("l_discount"), q / 50, F.col("l_discount") * 100, q, q, F.lit(100.0))
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(r, ",").alias("reasons"))


@query("op124_keypoint_summary", "select reason, count(*) as n from (select unnest(list_filter([case when not (l_tax < l_discount and l_discount < l_quantity / 50) then 'order' end, case when not (case when l_quantity <> 0 then l_discount * 100 / l_quantity end between 0.25 and 0.75) then 'ratio' end, case when l_quantity / 100 < 0.25 then 'span' end], lambda x: x is not null)) as reason from lineitem) group by reason")
def _(s, d):
    q = F.col("l_quantity")
    r = S.keypoint_anomalies(F.col("l_tax"), F.col("l_discount"), q / 50, F.col("l_discount") * 100, q, q, F.lit(100.0))
    return table(s, d, "lineitem").select(F.explode(r).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("op128_shown_counts", """with k as (select l_quantity < 25 as visible, (not (l_tax < l_discount and l_discount < l_quantity / 50) or not (case when l_quantity <> 0 then l_discount * 100 / l_quantity end between 0.25 and 0.75) or l_quantity / 100 < 0.25) as odd from lineitem)
select count(*) filter (visible and odd) as anomalous, count(*) filter (visible and not odd) as normal, count(*) filter (visible) as shown, count(*) as total from k""")
def _(s, d):
    q = F.col("l_quantity")
    r = S.keypoint_anomalies(F.col("l_tax"), F.col("l_discount"), q / 50, F.col("l_discount") * 100, q, q, F.lit(100.0))
    return metrics.shown_counts(table(s, d, "lineitem"), q < 25, F.size(r) > 0)


@query("op187_mmss", "select row_id, printf('%02d:%02d', cast(floor(timestamp_s) as bigint) // 60, cast(floor(timestamp_s) as bigint) % 60) as shown from results where timestamp_s is not null and not isnan(timestamp_s)")
def _(s, d):
    r = table(s, d, "results").filter("timestamp_s is not null and not isnan(timestamp_s)")
    return r.select("row_id", X.mmss(F.col("timestamp_s")).alias("shown"))


@query("op188_aesthetic_class", "select row_id, case when caption_aesthetic_score is null then 'none' when caption_aesthetic_score >= 8 then 'high' when caption_aesthetic_score >= 6 then 'mid' else 'low' end as class from results")
def _(s, d):
    return table(s, d, "results").select("row_id", S.aesthetic_class(F.col("caption_aesthetic_score")).alias("class"))


@query("op189_orientation", "select row_id, case row_id % 9 when 3 then 180 when 6 then 90 when 8 then 270 else 0 end as degrees from results")
def _(s, d):
    return table(s, d, "results").select("row_id", X.exif_degrees((F.col("row_id") % 9).cast("int")).alias("degrees"))


@query("op190_aspect", "select row_id, round(least(greatest(cast(frame_w as double) / frame_h, 0.1), 10), 6) as aspect from results")
def _(s, d):
    return table(s, d, "results").select("row_id", F.round(S.clamp(F.col("frame_w").cast("double") / F.col("frame_h"), 0.1, 10.0), 6).alias("aspect"))


@query("op191_image_cap", "select row_id, cast(round(frame_w * least(1.0, 1024.0 / greatest(frame_w, frame_h))) as int) as w, cast(round(frame_h * least(1.0, 1024.0 / greatest(frame_w, frame_h))) as int) as h from results")
def _(s, d):
    k = F.least(F.lit(1.0), 1024.0 / F.greatest("frame_w", "frame_h"))
    return table(s, d, "results").select("row_id", F.round(F.col("frame_w") * k).cast("int").alias("w"), F.round(F.col("frame_h") * k).cast("int").alias("h"))


@query("op192_keeper_name", "select row_id, printf('%.4f', composite) || '_' || video_stem || '_' || printf('%.3f', timestamp_s) || '.jpg' as name from results where timestamp_s is not null and not isnan(timestamp_s)")
def _(s, d):
    r = table(s, d, "results").filter("timestamp_s is not null and not isnan(timestamp_s)")
    return r.select("row_id", X.keeper_name(F.col("composite"), F.col("video_stem"), F.col("timestamp_s")).alias("name"))


@query("op203_stratified", "select source_type, row_id from results qualify row_number() over (partition by source_type order by md5('42|' || row_id), row_id) <= 20")
def _(s, d):
    return sampling.stratified(table(s, d, "results").select("source_type", "row_id"), ["source_type"], "row_id", 20)


@query("op204_seeded_sample", "select row_id from results order by md5('42|' || row_id), row_id limit 30")
def _(s, d):
    return sampling.sample_n(table(s, d, "results").select("row_id"), "row_id", 30)


@query("op206_clear_crops")
def _(s, d):
    r = table(s, d, "results").withColumn("faces", F.when(F.col("face_x1").isNotNull(), F.array(F.struct(*[F.col(f"face_{k}").alias(k) for k in ("x1", "y1", "x2", "y2")]))))
    return sampling.clear_crops(r, "row_id", "frame_w", "frame_h", "faces", 50)


@query("op207_split_by_source", "select row_id, cast('0x' || md5('42|' || video_path)[1:7] as bigint) < cast(floor(0.8 * 268435456) as bigint) as is_train from results")
def _(s, d):
    return sampling.split_by_source(table(s, d, "results").select("row_id", "video_path"), "video_path").select("row_id", "is_train")


@query("op209_rotations", "select row_id, k as quarter_turns from results, (values (0), (1), (2), (3)) t(k)")
def _(s, d):
    return sampling.rotations(table(s, d, "results").select("row_id"))


@query("op210_weighted_draws")
def _(s, d):
    return sampling.weighted_draws(table(s, d, "results").filter("composite > 0").select("row_id", "composite"), "row_id", "composite", 500)

"""Queries of files, faces and names that the other plans leave out (operators 02, 14, 25, 27, 32, 54, 74, 76, 77, 91, 92, 172, 174, 180, 193, 195, 205, 227, 230 to 235, 242, 245)."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import functions as F

from framelake.functions import media as M
from framelake.functions import scoring as S
from framelake.functions import text as X
from framelake.operators import dedup, sampling, selection
from framelake.operators import similarity as V
from framelake.operators.joins import first_match
from framelake.plans.registry import query, table
from framelake.session import scratch_path
from framelake.sources import files


@query("op014_json_documents", "select prompt_id, prompt_text from prompts")
def _(s, d):
    rows = [r.asDict() for r in table(s, d, "prompts").select("prompt_id", "prompt_text").limit(1000).collect()]
    doc = s.createDataFrame(rows, "prompt_id int, prompt_text string").select(F.to_json(F.collect_list(F.struct("prompt_id", "prompt_text"))).alias("value"))
    doc.write.text(p := scratch_path(s, "document"))
    return files.read_document(s, p, "prompt_id int, prompt_text string")


@query("op025_rejection_kind", "select row_id, case when instr(k, '(') > 1 then split_part(k, '(', 1) else k end as kind from (select row_id, quality_bucket || case when row_id % 2 = 0 then '(x)' else '' end as k from results)")
def _(s, d):
    k = F.concat("quality_bucket", F.when(F.col("row_id") % 2 == 0, "(x)").otherwise(""))
    return table(s, d, "results").select("row_id", S.rejection_kind(k).alias("kind"))


@query("op027_representatives", "select row_id from results r where not exists (select 1 from results q where q.video_path = r.video_path and q.row_id < r.row_id)")
def _(s, d):
    r = table(s, d, "results").select("row_id", "video_path")
    first = selection.first_per_key(r, ["video_path"], [F.col("row_id")]).select("row_id", F.lit(True).alias("rep"))
    return r.join(first, "row_id", "left").filter(F.coalesce("rep", F.lit(False))).select("row_id")


@query("op032_reason_filter", "select l_orderkey, l_linenumber from lineitem where not (l_tax < l_discount)")
def _(s, d):
    reasons = F.concat_ws(",", F.when(~(F.col("l_tax") < F.col("l_discount")), "order"), F.when(F.col("l_quantity") < 25, "span"))
    return table(s, d, "lineitem").filter(F.array_contains(F.split(reasons, ","), "order")).select("l_orderkey", "l_linenumber")


@query("op054_hamming_pairs")
def _(s, d):
    """Similarity hashes of whole texts within 8 of 64 bits; tested against brute force."""
    h = table(s, d, "documents").filter("length(text) > 0").select("doc_id", dedup.similarity_code(F.col("text")).alias("code"))
    return dedup.hamming_edges(h, "doc_id", "code", 8)


@query("op074_cluster_representative", "select quality_bucket, first(row_id order by coalesce(composite, face_det_score, 0.0) desc, row_id) as best from results group by quality_bucket")
def _(s, d):
    r = table(s, d, "results").select("quality_bucket", "row_id", F.coalesce("composite", "face_det_score", F.lit(0.0)).alias("c"))
    return selection.top_k(r, ["quality_bucket"], [F.desc("c"), F.col("row_id")], 1).select("quality_bucket", F.col("row_id").alias("best"))


@query("op076_debug_order", "select row_id, row_number() over (order by face_count is null desc, case when isnan(face_det_score) then null else face_det_score end desc nulls last, row_id) as place from results")
def _(s, d):
    r = table(s, d, "results").select("row_id", F.col("face_count").isNull().alias("odd"), S.no_nan(F.col("face_det_score")).alias("x"))
    return selection.global_rank(r, [F.desc("odd"), F.desc_nulls_last("x"), "row_id"], "place").select("row_id", "place")


@query("op077_review_order", "select row_id, row_number() over (order by case when isnan(p_good) then null else p_good end desc nulls last, row_id) as place from results")
def _(s, d):
    r = table(s, d, "results").select("row_id", S.no_nan(F.col("p_good")).alias("x"))
    return selection.global_rank(r, [F.desc_nulls_last("x"), "row_id"], "place").select("row_id", "place")


def _movie(turn: int) -> bytes:
    """A movie header of one video track that is turned."""
    box = lambda kind, body: struct.pack(">I4s", 8 + len(body), kind) + body
    c, n = {0: (65536, 0), 90: (0, 65536), 180: (-65536, 0), 270: (0, -65536)}[turn]
    tkhd = box(b"tkhd", bytes(40) + struct.pack(">ii", c, n) + bytes(36))
    hdlr = box(b"hdlr", bytes(8) + b"vide" + bytes(13))
    return box(b"ftyp", b"isom") + box(b"moov", box(b"trak", tkhd + box(b"mdia", hdlr)))


@query("op091_container_rotation", "select row_id, cast((row_id % 4) * 90 as int) as rotation from results")
def _(s, d):
    heads = F.array(*[F.lit(bytearray(_movie(t))) for t in (0, 90, 180, 270)])
    r = table(s, d, "results").select("row_id", F.get(heads, (F.col("row_id") % 4).cast("int")).alias("content"))
    return M.rotations_of(r, "content").select("row_id", "rotation")


@query("op092_head_digest", "select doc_id, md5(unhex(left(hex(encode(text)), 2 * 65536))) as digest from documents where text is not null")
def _(s, d):
    docs = table(s, d, "documents").filter("text is not null")
    return docs.select("doc_id", X.content_digest(F.encode("text", "utf-8")).alias("digest"))


@query("op172_crop_boxes", "select row_id, greatest(face_x1 - 20, 0) as x1, greatest(face_y1 - 20, 0) as y1, least(face_x2 + 20, frame_w) as x2, least(face_y2 + 20, frame_h) as y2 from results where face_x1 is not null")
def _(s, d):
    c = M.crop_box(*[F.col(f"face_{k}") for k in ("x1", "y1", "x2", "y2")], F.col("frame_w"), F.col("frame_h"))
    return table(s, d, "results").filter("face_x1 is not null").select("row_id", c.alias("c")).select("row_id", "c.*")


@query("op173_sharpness_hash")
def _(s, d):
    """Images made of vectors: 16 x 32 grey values of a usable embedding."""
    r = table(s, d, "results").filter("size(embedding) = 512").select("row_id", "embedding")

    def measure(rows: list) -> list:
        g = [np.nan_to_num(np.array(x, dtype=np.float64)).reshape(16, 32) for x in rows]
        return [(M.sharpness(M.centre(x)), M.difference_hash(x)) for x in g]

    return V.embed(r, "row_id", "embedding", measure, "sharpness double, code long")


KV = ", ".join(f"{X.last_value_sql('t', k)} as {k}" for k in ("setting", "activity", "description"))


@query("op180_combined_values", rf"select raw_id, {KV} from (select raw_id, concat_ws(chr(10), prompt1_raw, 'description: ' || prompt2_raw) as t from raw_outputs_a)")
def _(s, d):
    t = F.concat_ws("\n", "prompt1_raw", F.concat(F.lit("description: "), "prompt2_raw"))
    v = X.key_values(t, ("setting", "activity", "description"))
    return table(s, d, "raw_outputs_a").select("raw_id", v.alias("v")).select("raw_id", "v.*")


@query("op193_checkpoint_names", "select row_id, cast(nullif(regexp_extract(n, '(?i)(?:^|[_-])v([0-9]+)', 1), '') as int) as version from (select row_id, 'face_' || quality_bucket || '_V' || (row_id % 30) || '.pt' as n from results)")
def _(s, d):
    n = F.concat(F.lit("face_"), "quality_bucket", F.lit("_V"), (F.col("row_id") % 30).cast("string"), F.lit(".pt"))
    return table(s, d, "results").select("row_id", X.version_tag(n).alias("version"))


@query("op195_escaped_paths", "select row_id, replace(url_encode(video_stem), '%20', '+') as escaped from results")
def _(s, d):
    return table(s, d, "results").select("row_id", F.url_encode("video_stem").alias("escaped"))


@query("op205_sample_or_all", "select label_id from labels order by md5('7|' || label_id), label_id limit 30")
def _(s, d):
    return sampling.sample_n(table(s, d, "labels").select("label_id"), "label_id", 30, seed=7)


@query("op227_clustering")
def _(s, d):
    """From vectors to named identities: density clusters, centroids, assignment to an empty index."""
    e = table(s, d, "embeddings")
    c = V.dbscan(e, V.similar_pairs(e, "vec_id", "embedding", 0.3), "vec_id", 5).filter("cluster >= 0")
    big = c.groupBy("cluster").agg(F.count("*").alias("n")).filter("n >= 5").select("cluster")
    cents = V.centroids(e.join(c, "vec_id").join(big, "cluster"), "cluster", "embedding")
    empty = s.createDataFrame([], "name string, display_name string, centroid array<double>, member_count long")
    return V.resolve_identities(empty, cents).select("name", "display_name", "member_count")


@query("op230_model_hook", "select row_id, round(composite * 2, 6) as score from results")
def _(s, d):
    """Any batch model over a column; here one that doubles."""
    return V.embed(table(s, d, "results"), "row_id", "composite", lambda xs: [(round(x * 2, 6),) for x in xs], "score double")


@query("op242_cache_first", "select w.raw_id, r.row_id from raw_outputs_a w join (select kept_path, min(row_id) as row_id from results where kept_path is not null group by 1) r using (kept_path)")
def _(s, d):
    r = table(s, d, "results").filter("kept_path is not null").select("kept_path", "row_id")
    return first_match(table(s, d, "raw_outputs_a").select("raw_id", "kept_path").filter("kept_path is not null"), r, ["kept_path"], [F.col("row_id")], "inner").select("raw_id", "row_id")


@query("op245_json_drop", "select raw_id from raw_outputs_a where prompt1_raw is not null")
def _(s, d):
    from framelake.streaming.incremental import file_stream, run_to_end

    src = table(s, d, "raw_outputs_a").filter("prompt1_raw is not null").select("raw_id", "prompt1_raw")
    src.write.json(p := scratch_path(s, "drop"))
    return run_to_end(file_stream(s, p, src.schema, "json").select("raw_id"))


@query("op020_viewer_payload", "select source_year, source_month, count(*) as cards, count_if(quality_bucket = 'great') as great, count(distinct video_path) as clips from results group by all")
def _(s, d):
    return table(s, d, "results").groupBy("source_year", "source_month").agg(F.count("*").alias("cards"), F.count_if(F.col("quality_bucket") == "great").alias("great"), F.countDistinct("video_path").alias("clips"))

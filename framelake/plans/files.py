"""Queries over the manifest and the status log (operators 01 to 20, 36, 40 to 46, 63, 64, 100 to 104, 150 to 156)."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelake.functions import text as X
from framelake.operators import dedup, joins, metrics, selection
from framelake.plans.registry import query, table
from framelake.session import scratch_path
from framelake.sources import files


@query("op001_dir_list", "select distinct regexp_extract(file_path, '^(.*)/[^/]*$', 1) as dir from manifest")
def _(s, d):
    m = table(s, d, "manifest").select(F.regexp_extract("file_path", "^(.*)/[^/]*$", 1).alias("dir")).distinct()
    lines = m.select(F.concat(F.lit("  "), "dir", F.lit(" ")).alias("value")).unionByName(m.select(F.concat(F.lit("# "), "dir").alias("value"))).unionByName(m.select(F.lit(" ").alias("value")))
    lines.write.text(p := scratch_path(s, "dirs"))
    return files.folder_list(s, p)


@query("op003_classify_extension", r"""select file_type_of as file_type, ext, count(*) as n from (
  select lower(regexp_extract(file_path, '(\.[^./\\]+)$', 1)) as ext,
    case when lower(regexp_extract(file_path, '(\.[^./\\]+)$', 1)) in ('.mp4','.mov','.avi','.mkv','.m4v') then 'video'
         when lower(regexp_extract(file_path, '(\.[^./\\]+)$', 1)) in ('.jpg','.jpeg','.png','.heic','.heif','.tif','.tiff','.bmp','.webp') then 'image' end as file_type_of
  from manifest) group by all""")
def _(s, d):
    p = F.col("file_path")
    return table(s, d, "manifest").groupBy(X.file_type(p).alias("file_type"), X.extension(p).alias("ext")).agg(F.count("*").alias("n"))


@query("op005_csv_manifest", "select file_path, file_type, size_bytes, hash, is_duplicate, canonical_path, duration_s, coalesce(len(sample_windows_s), 0) as windows, epoch_us(scanned_at) as scanned_us from manifest")
def _(s, d):
    files.write_csv(table(s, d, "manifest"), p := scratch_path(s, "manifest"))
    m = files.read_csv(s, p, files.MANIFEST)
    n = F.coalesce(F.size(F.from_json("sample_windows_s", "array<int>")), F.lit(0)).alias("windows")
    return m.select("file_path", "file_type", "size_bytes", "hash", "is_duplicate", "canonical_path", "duration_s", F.when(F.col("sample_windows_s").isNull(), 0).otherwise(n).alias("windows"), F.unix_micros(F.col("scanned_at").cast("timestamp")).alias("scanned_us"))


@query("op007_parquet_version", "select row_id, kept_path, composite from results where composite >= 0.5")
def _(s, d):
    p = files.write_version(table(s, d, "results").filter("composite >= 0.5"), scratch_path(s, "version"))
    return s.read.parquet(p).select("row_id", "kept_path", "composite")


@query("op010_append_status", "select file_path, status, keepers, epoch_us(processed_at) as processed_us from pipeline_status")
def _(s, d):
    st, p = table(s, d, "pipeline_status"), scratch_path(s, "status")
    for part in (0, 1):
        files.write_csv(st.filter(F.pmod(F.xxhash64("file_path"), F.lit(2)) == part), p, "append")
    r = files.read_csv(s, p, files.STATUS)
    return r.select("file_path", "status", "keepers", F.unix_micros(F.col("processed_at").cast("timestamp")).alias("processed_us"))


@query("op011_jsonl_last_wins", "select kept_path, prompt1_raw from raw_outputs_a where kept_path is not null qualify row_number() over (partition by kept_path order by raw_id desc) = 1")
def _(s, d):
    raw = table(s, d, "raw_outputs_a")
    last = selection.first_per_key(raw.filter("kept_path is not null"), ["kept_path"], [F.desc("raw_id")])
    # as lines, between blank and malformed ones, and read again
    lines = last.select(F.to_json(F.struct("kept_path", "prompt1_raw")).alias("value"))
    lines.unionByName(last.select(F.lit("{broken").alias("value"))).unionByName(last.select(F.lit(" ").alias("value"))).write.text(p := scratch_path(s, "jsonl"))
    return files.read_jsonl(s, p, "kept_path string, prompt1_raw string", "kept_path").select("kept_path", "prompt1_raw")


@query("op013_jsonl_strict", "select raw_id, kept_path from raw_outputs_a")
def _(s, d):
    table(s, d, "raw_outputs_a").select("raw_id", "kept_path").write.json(p := scratch_path(s, "jsonl"))
    return files.read_jsonl(s, p, "raw_id long, kept_path string", "raw_id", strict=True)


@query("op015_embedding_cache", "select count(*) as missing from results r where not exists (select 1 from results c where c.batch_no = 0 and c.kept_path = r.kept_path) and r.kept_path is not null")
def _(s, d):
    r = table(s, d, "results")
    cache = r.filter("batch_no = 0").select("kept_path").distinct()
    return r.filter("kept_path is not null").join(cache, "kept_path", "left_anti").agg(F.count("*").alias("missing"))


@query("op019_export_names", r"""select row_id, case when n > 1 then regexp_replace(b, '\.[^.]*$', '') || '_' || n || regexp_extract(b, '(\.[^.]*)$', 1) else b end as export_name from (
  select row_id, regexp_extract(kept_path, '([^/\\]*)$', 1) as b, row_number() over (partition by regexp_extract(kept_path, '([^/\\]*)$', 1) order by row_id) as n from results where kept_path is not null)""")
def _(s, d):
    r = table(s, d, "results").filter("kept_path is not null")
    return files.unique_names(r, "kept_path", [F.col("row_id")]).select("row_id", "export_name")


@query("op040_new_files", "select distinct file_path from manifest m where not exists (select 1 from pipeline_status p where p.file_path = m.file_path)")
def _(s, d):
    return files.new_files(table(s, d, "manifest").select("file_path"), table(s, d, "pipeline_status"))


@query("op041_resume", "select file_path, hash, epoch_us(scanned_at) as scanned_us from manifest m where not exists (select 1 from pipeline_status p where p.file_path = m.file_path and lower(trim(p.status)) = 'done')")
def _(s, d):
    r = joins.resume(table(s, d, "manifest"), table(s, d, "pipeline_status"))
    return r.select("file_path", "hash", F.unix_micros(F.col("scanned_at").cast("timestamp")).alias("scanned_us"))


@query("op042_prior_and_fresh", """with fresh as (select * from results where batch_no = 9), prior as (select * from results where batch_no < 9)
  select row_id, video_path from prior p where not exists (select 1 from fresh f where f.video_path = p.video_path) union all select row_id, video_path from fresh""")
def _(s, d):
    r = table(s, d, "results")
    fresh = r.filter("batch_no = 9")
    return joins.prior_and_fresh(r.filter("batch_no < 9"), fresh, fresh, "video_path").select("row_id", "video_path")


@query("op043_known_canonical", """with known as (select hash, canonical_path from manifest where run_name = 'lake_house' qualify row_number() over (partition by hash order by scanned_at, file_path) = 1),
  own as (select hash, min(file_path) as first from manifest where hash is not null group by hash)
  select m.file_path, epoch_us(m.scanned_at) as scanned_us, coalesce(k.canonical_path, o.first, m.file_path) as canonical, m.file_path <> coalesce(k.canonical_path, o.first, m.file_path) as repeated
  from manifest m left join known k on k.hash = m.hash left join own o on o.hash = m.hash""")
def _(s, d):
    m = table(s, d, "manifest")
    known = m.filter("run_name = 'lake_house'").select("hash", "canonical_path", F.struct("scanned_at", "file_path").alias("rank"))
    r = dedup.canonical(m.drop("canonical_path", "is_duplicate"), "hash", "file_path", known)
    return r.select("file_path", F.unix_micros(F.col("scanned_at").cast("timestamp")).alias("scanned_us"), F.col("canonical_path").alias("canonical"), F.col("is_duplicate").alias("repeated"))


@query("op063_smallest_first", "select file_path, size_bytes, row_number() over (order by size_bytes, file_path, scanned_at) as place from manifest where not is_duplicate")
def _(s, d):
    m = table(s, d, "manifest").filter("not is_duplicate")
    return selection.global_rank(m, ["size_bytes", "file_path", "scanned_at"], "place").select("file_path", "size_bytes", "place")


@query("op064_type_limits", "select file_path, file_type, size_bytes from (select *, row_number() over (partition by file_type order by size_bytes, file_path, scanned_at) rn from manifest) where file_type = 'video' and rn <= 25")
def _(s, d):
    order = [F.col("size_bytes"), F.col("file_path"), F.col("scanned_at")]
    return selection.type_limits(table(s, d, "manifest"), "file_type", order, {"video": 25, "image": 0}).select("file_path", "file_type", "size_bytes")


@query("op100_canonical", "select m.file_path, epoch_us(m.scanned_at) as scanned_us, coalesce(o.first, m.file_path) as canonical, m.file_path <> coalesce(o.first, m.file_path) as repeated from manifest m left join (select hash, min(file_path) as first from manifest where hash is not null group by hash) o on o.hash = m.hash")
def _(s, d):
    r = dedup.canonical(table(s, d, "manifest").drop("canonical_path", "is_duplicate"), "hash", "file_path")
    return r.select("file_path", F.unix_micros(F.col("scanned_at").cast("timestamp")).alias("scanned_us"), F.col("canonical_path").alias("canonical"), F.col("is_duplicate").alias("repeated"))


@query("op101_duplicate_report", "select hash, count(*) as n, min(file_path) as kept, array_to_string(list_slice(list_sort(list(distinct file_path)), 2, 4), '|') as skipped from manifest group by hash having count(distinct file_path) > 1")
def _(s, d):
    # of a group only the four least paths are needed: they are ranked below the shuffle
    m = table(s, d, "manifest")
    four = selection.top_k(m.select("hash", "file_path").distinct(), ["hash"], [F.col("file_path")], 4)
    p = four.groupBy("hash").agg(F.array_sort(F.collect_list("file_path")).alias("p"))
    n = m.groupBy("hash").agg(F.count("*").alias("n"))
    return n.join(p, "hash").filter(F.size("p") > 1).select("hash", "n", F.col("p")[0].alias("kept"), F.array_join(F.slice("p", 2, 3), "|").alias("skipped"))


@query("op102_manifest_summary", "select file_type, is_duplicate, count(*) as n, min(size_bytes) as low, max(size_bytes) as high, cast(floor(quantile_cont(size_bytes, 0.5)) as bigint) as median from manifest group by file_type, is_duplicate")
def _(s, d):
    return table(s, d, "manifest").groupBy("file_type", "is_duplicate").agg(F.count("*").alias("n"), F.min("size_bytes").alias("low"), F.max("size_bytes").alias("high"), F.percentile("size_bytes", 0.5).cast("long").alias("median"))


@query("op104_stage_shares", "select lower(trim(status)) as stage, round(sum(elapsed_s), 4) as total, round(sum(elapsed_s) / (select count(distinct file_path) from pipeline_status), 6) as mean, max(elapsed_s) as longest, round(sum(elapsed_s) / sum(sum(elapsed_s)) over (), 6) as share from pipeline_status group by 1")
def _(s, d):
    p = table(s, d, "pipeline_status").withColumn("stage", F.lower(F.trim("status")))
    n = p.agg(F.countDistinct("file_path")).first()[0]
    return metrics.stage_shares(p, "stage", "elapsed_s", F.lit(n))


@query("op105_run_summary", """with dom(pred_label) as (values ('none'), ('bad'), ('okay'), ('good')), c as (select pred_label, count(*) as n from results group by 1)
  select dom.pred_label, coalesce(c.n, 0) as n from dom left join c using (pred_label)""")
def _(s, d):
    return metrics.filled_counts(table(s, d, "results"), "pred_label", ["none", "bad", "okay", "good"])


@query("op151_manifest_union", "select file_path, run_name from manifest where run_name = 'lake_house' union all select file_path, run_name from manifest where run_name = 'spring_batch'")
def _(s, d):
    m = table(s, d, "manifest").select("file_path", "run_name")
    return m.filter("run_name = 'lake_house'").unionByName(m.filter("run_name = 'spring_batch'"))


@query("op152_distinct_first", "select file_path, epoch_us(min(scanned_at)) as first_us from manifest group by file_path")
def _(s, d):
    m = selection.first_per_key(table(s, d, "manifest"), ["file_path"], [F.col("scanned_at")])
    return m.select("file_path", F.unix_micros(F.col("scanned_at").cast("timestamp")).alias("first_us"))


@query("op153_except", "select row_id, video_path from results r where not exists (select 1 from labels l where l.video_path = r.video_path)")
def _(s, d):
    return table(s, d, "results").join(table(s, d, "labels").select("video_path").distinct(), "video_path", "left_anti").select("row_id", "video_path")


@query("op154_seen_hashes", "select sha256 as digest from labels where sha256 is not null union select hash from manifest where hash is not null")
def _(s, d):
    a = table(s, d, "labels").select(F.col("sha256").alias("digest")).unionByName(table(s, d, "manifest").select(F.col("hash").alias("digest")))
    return a.filter("digest is not null").distinct()


_SIZE = "when size_bytes < {top} then case when size_bytes / {unit}.0 < 10 then printf('%.1f {name}', round_even(size_bytes / {unit}.0, 1)) else printf('%d {name}', cast(round_even(size_bytes / {unit}.0, 0) as bigint)) end"


@query("op160_format_bytes", "select file_path, epoch_us(scanned_at) as scanned_us, case when size_bytes < 1024 then size_bytes || ' B' " + " ".join(_SIZE.format(unit=1024**k, top=1024 ** (k + 1) if k < 3 else 1 << 62, name=n) for k, n in enumerate(("KB", "MB", "GB"), 1)) + " end as shown from manifest")
def _(s, d):
    return table(s, d, "manifest").select("file_path", F.unix_micros(F.col("scanned_at").cast("timestamp")).alias("scanned_us"), X.format_bytes(F.col("size_bytes")).alias("shown"))


@query("op094_truthy", "select lower(trim(status)) in ('true', '1', 'yes') as flag, count(*) as n from pipeline_status where status is not null group by 1")
def _(s, d):
    return table(s, d, "pipeline_status").filter("status is not null").groupBy(X.truthy(F.col("status")).alias("flag")).agg(F.count("*").alias("n"))


@query("op196_corpus_name", r"""select label_id, coalesce(nullif(trim(corpus), ''), case when st = 'results' then par else st end) as corpus from (
  select label_id, corpus, regexp_replace(regexp_extract(video_path, '([^/\\]*)$', 1), '\.[^.]+$', '') as st, regexp_extract(video_path, '([^/\\]+)[/\\][^/\\]*$', 1) as par from labels)""")
def _(s, d):
    return table(s, d, "labels").select("label_id", X.corpus_name(F.col("corpus"), F.col("video_path")).alias("corpus"))


@query("op200_sample_windows")
def _(s, d):
    from framelake.operators.sampling import with_sample_windows

    m = selection.first_per_key(table(s, d, "manifest").filter("file_type = 'video' and hash rlike '^[0-9a-f]{8}' and duration_s < double('infinity')"), ["file_path"], [F.col("scanned_at")])
    return with_sample_windows(m, "hash", "duration_s").select("file_path", "windows")


@query("op201_uniform_targets", "select file_path, i as target_index, i / 0.5 as target_s from (select file_path, duration_s from manifest where duration_s < 'infinity'::double qualify row_number() over (partition by file_path order by scanned_at) = 1), lateral (select unnest(range(greatest(1, cast(floor(duration_s * 0.5) as bigint)))) as i)")
def _(s, d):
    from framelake.operators.sampling import uniform_targets

    m = selection.first_per_key(table(s, d, "manifest").filter("duration_s < double('infinity')"), ["file_path"], [F.col("scanned_at")])
    return uniform_targets(m, "duration_s", 0.5).select("file_path", F.col("target_index").cast("long").alias("target_index"), "target_s")


@query("op202_windowed_targets", "select file_path, w * 2 + j as target_index, start + j / 2.0 as target_s from (select file_path, unnest(sample_windows_s) as start, generate_subscripts(sample_windows_s, 1) - 1 as w from (select * from manifest where sample_windows_s is not null qualify row_number() over (partition by file_path order by scanned_at) = 1)), (values (0), (1)) t(j)")
def _(s, d):
    from framelake.operators.sampling import windowed_targets

    m = selection.first_per_key(table(s, d, "manifest").filter("sample_windows_s is not null"), ["file_path"], [F.col("scanned_at")])
    t = windowed_targets(m, "file_path", "sample_windows_s", 2.0)
    return t.select("file_path", F.col("target_index").cast("long").alias("target_index"), F.col("target_s").cast("double").alias("target_s"))

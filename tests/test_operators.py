"""Operators against brute force, with nulls, ties, edges, repeats and empty tables."""

import json
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.functions import media, scoring, text
from framelake.operators import dedup, joins, metrics, sampling, selection, similarity, views
from framelake.operators.graph import connected_components
from framelake.sources import files


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]
    lab = list(range(300))
    for _ in range(300):
        for a, b in edges:
            lab[a] = lab[b] = min(lab[a], lab[b])
    df = spark.createDataFrame([*edges, (None, 3), (7, 7)], "src long, dst long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert got == {n: lab[n] for e in edges for n in e if e[0] != e[1]}
    assert connected_components(df.limit(0)).count() == 0
    path = spark.createDataFrame([(i, i + 1) for i in range(200)], "src long, dst long")
    assert {r.component for r in connected_components(path).collect()} == {0}


def test_greedy_spacing(spark):
    rng = random.Random(2)
    rows = [(g, round(rng.uniform(0, 60), 1), i) for i, g in enumerate(rng.choices("abc", k=300))]
    rows += [("a", 5.0, 900), ("a", 5.0, 901), ("b", None, 902)]
    want = set()
    for g in "abc":
        last = None
        for _, t, i in sorted((r for r in rows if r[0] == g and r[1] is not None), key=lambda r: (r[1], r[2])):
            if last is None or t - last >= 2.0:
                want.add(i)
                last = t
    df = spark.createDataFrame(rows, "g string, t double, i long")
    assert {r.i for r in dedup.greedy_spacing(df, ["g"], F.col("t"), "i", 2.0).collect()} == want
    edge = spark.createDataFrame([("x", 0.0, 1), ("x", 2.0, 2), ("x", 3.9, 3)], "g string, t double, i long")
    assert {r.i for r in dedup.greedy_spacing(edge, ["g"], F.col("t"), "i", 2.0).collect()} == {1, 2}
    assert dedup.greedy_spacing(df.limit(0), ["g"], F.col("t"), "i", 2.0).count() == 0


@pytest.mark.parametrize("radius", [3, 8])
def test_greedy_hamming(spark, radius):
    rng = random.Random(radius)
    seeds = [rng.getrandbits(63) for _ in range(25)]
    rows = []
    for i in range(200):
        h = rng.choice(seeds)
        for _ in range(rng.randrange(radius + 2)):
            h ^= 1 << rng.randrange(63)
        rows.append((i, h, float(rng.randrange(6))))
    rows += [(500, None, 9.0), (501, None, None), (502, seeds[0], None)]
    kept, want = [], {500, 501}
    for i, h, _ in sorted((r for r in rows if r[1] is not None), key=lambda r: (-(r[2] if r[2] is not None else float("-inf")), r[0])):
        if all((h ^ k).bit_count() > radius for k in kept):
            kept.append(h)
            want.add(i)
    df = spark.createDataFrame(rows, "i long, h long, s double")
    assert {r.i for r in dedup.greedy_hamming(df, "i", "h", "s", radius).collect()} == want


def test_hamming_edges_of_64_bits(spark):
    rng = random.Random(5)
    codes = [rng.getrandbits(64) - (1 << 63) for _ in range(60)]
    codes += [c ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) for c in codes]
    df = spark.createDataFrame(list(enumerate(codes)), "i long, h long")
    want = {(a, b) for a in range(120) for b in range(a + 1, 120) if codes[a] != codes[b] and bin((codes[a] ^ codes[b]) & (2**64 - 1)).count("1") <= 8}
    for start in (1, 50_000):  # wide bands that are probed, and narrow ones
        got = [(min(r.a, r.b), max(r.a, r.b)) for r in dedup.hamming_edges(df, "i", "h", 8, probe_from=start).collect()]
        assert set(got) == want and len(got) == len(want)


def test_canonical(spark):
    df = spark.createDataFrame([("b", "h1"), ("a", "h1"), ("c", None), ("d", None), ("e", "h2")], "file_path string, hash string")
    got = {r.file_path: (r.canonical_path, r.is_duplicate) for r in dedup.canonical(df, "hash", "file_path").collect()}
    assert got == {"a": ("a", False), "b": ("a", True), "c": ("c", False), "d": ("d", False), "e": ("e", False)}
    known = spark.createDataFrame([("h2", "old", 2), ("h2", "older", 1)], "hash string, canonical_path string, rank int")
    assert {r.file_path: r.canonical_path for r in dedup.canonical(df, "hash", "file_path", known).collect()}["e"] == "older"


def test_rank_cap_limits(spark):
    df = spark.createDataFrame([(1, "a", 5.0), (2, "a", 5.0), (3, "a", None), (4, "b", 1.0)], "i int, g string, s double")
    order = [F.desc_nulls_last("s"), F.col("i")]
    assert {r.i for r in selection.top_k(df, ["g"], order, 1).collect()} == {1, 4}
    assert {r.i: r.over_cap for r in selection.cap_groups(df, ["g"], order, 2).collect()} == {1: True, 2: True, 4: False}
    assert selection.cap_groups(df, ["g"], order, 0).count() == 4
    assert {r.i for r in selection.type_limits(df, "g", [F.col("i")], {"a": 2, "b": 0}).collect()} == {1, 2}
    assert selection.type_limits(df, "g", [F.col("i")], {"a": 0, "b": 0}).count() == 4
    assert [r.k for r in selection.global_rank(df, ["i"], "k").orderBy("i").collect()] == [1, 2, 3, 4]


def test_justify(spark):
    df = spark.createDataFrame([(i, "s", 1.0) for i in range(7)], "i int, sec string, a double")
    got = {r.i: r.line for r in selection.justify(df, ["sec"], [F.col("i")], F.col("a"), 3 * 204.0).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 2, 4: 2, 5: 2, 6: 3}


def test_best_epoch(spark):
    log = spark.createDataFrame([(1, 0.9), (2, 0.5), (3, 0.6), (4, 0.7), (5, 0.1)], "epoch int, loss double")
    assert selection.best_epoch(log, "loss", "epoch", 2).first().epoch == 2
    assert selection.best_epoch(log, "loss", "epoch", 9).first().epoch == 5


def test_merge_and_matches(spark):
    t = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k int, v string")
    s = spark.createDataFrame([(1, None), (2, "B")], "k int, v string")
    assert {r.k: r.v for r in joins.merge_update(t, s, "k", ["v"]).collect()} == {1: None, 2: "B", 3: "c"}
    r = spark.createDataFrame([(1, 20), (1, 10)], "k int, o int")
    assert {x.k: x.o for x in joins.first_match(t, r, ["k"], [F.col("o")]).collect()} == {1: 10, 2: None, 3: None}
    st = spark.createDataFrame([("x", " Done "), ("x", None), ("y", "failed")], "file_path string, status string")
    f = spark.createDataFrame([("x",), ("y",), ("z",)], "file_path string")
    assert {x.file_path for x in joins.resume(f, st).collect()} == {"y", "z"}


def test_intervals(spark):
    a = spark.createDataFrame([("k", 0), ("k", 10), ("q", 5)], "g string, t long")
    b = spark.createDataFrame([("k", 3), ("k", 13), ("k", 20), ("q", None)], "g string, u long")
    assert {(r.t, r.u) for r in joins.interval_join(a, b, ["g"], "t", "u", 3).collect()} == {(0, 3), (10, 13)}
    rows = spark.createDataFrame([("k", 3, 1), ("k", 3, 0), ("k", 9, 2)], "g string, t long, v int")
    assert {(r.t, r.next_t, r.v) for r in joins.asof_forward(a, rows, ["g"], "t", ["v"]).collect()} == {(0, 3, 0), (10, None, None), (5, None, None)}


def test_scores(spark):
    r = one(
        spark,
        edge=scoring.bucket(F.lit(0.35)), top=scoring.bucket(F.lit(0.75)), none=scoring.bucket(F.lit(None).cast("double")),
        q=scoring.face_quality(F.array(F.lit(0.9), F.lit(0.5), F.lit(0.39))), empty=scoring.face_quality(F.array().cast("array<double>")),
        both=scoring.face_score(F.lit(None).cast("double"), F.lit(None).cast("double")), half=scoring.face_score(F.lit(0.4), F.lit(None).cast("double")),
        zero=scoring.quality_score(F.array().cast("array<double>"), F.array().cast("array<double>"), F.lit(0.5)),
        pair=scoring.best_pair(F.array(F.lit(0.4))), lab=scoring.predicted([F.lit(0.3), F.lit(0.3), F.lit(0.2), F.lit(0.2)])[0],
        kind=scoring.rejection_kind(F.lit("(x)")), comp=scoring.composite(F.lit(None).cast("double"), F.lit(0.5)),
    )
    assert (r.edge, r.top, r.none, r.lab, r.kind, r.comp) == ("medium", "great", None, "none", "(x)", 0.5)
    assert r.q == pytest.approx(0.975) and r.empty is None and r.both is None and r.half == pytest.approx(0.2)
    assert r.zero == pytest.approx(0.36) and r.pair is None


def test_rejection_edges(spark):
    def reason(x1, y1, x2, y2, w=1000, h=1000):
        return one(spark, r=scoring.rejection(*[F.lit(v) for v in (x1, y1, x2, y2, w, h)])).r

    assert reason(400, 400, 440, 500) is None  # exactly 0.004
    assert reason(400, 400, 439, 500).startswith("too_small(0.0039")
    assert reason(50, 450, 150, 550) is None  # centre exactly on the band's line
    assert reason(0, 450, 100, 550) == "small_and_edge(0.0100)"
    assert reason(0, 400, 125, 600) is None  # exactly 0.025


def test_text(spark):
    s = F.lit("- Setting: [kitchen]\r\nsetting: \nactivity:  baking \nSETTING: yard")
    r = one(
        spark, v=text.key_values(s, ("setting", "activity", "mood")), none=text.key_values(F.lit(None).cast("string"), ("a",)),
        i=text.first_int(F.lit("about 15 of 3")), j=text.first_int(F.lit("none")), nan=text.safe_double(F.lit("NaN")), bad=text.safe_double(F.lit("x")),
        t=text.truthy(F.lit(" YES ")), f=text.truthy(F.lit(None).cast("string")), card=text.card_key(F.lit("s"), F.lit("a\\b/c.jpg")),
        m=text.multiline_value(F.lit("setting: a\nb\nactivity: c"), "setting", ("setting", "activity")), sh=text.shorten(F.lit("ab\ncd"), 4),
        size=text.format_bytes(F.lit(1536)), big=text.format_bytes(F.lit(20 * 1024**2)), lab=text.section_label(F.lit(2025), F.lit(5)), unk=text.section_label(F.lit(2025), F.lit(0)),
    )
    assert (r.v.setting, r.v.activity, r.v.mood, r.none.a) == ("yard", "baking", None, None)
    assert (r.i, r.j, r.nan, r.bad, r.t, r.f, r.card) == (10, None, None, None, True, False, "s/c.jpg")
    assert (r.m, r.sh, r.size, r.big, r.lab, r.unk) == ("a b", "ab …", "1.5 KB", "20 MB", "May 2025", "Unknown 2025")


@pytest.mark.parametrize("n,want", [(1023, "1023 B"), (1280, "1.2 KB"), (1408, "1.4 KB"), (1433, "1.4 KB"), (10752, "10 KB"), (11776, "12 KB"), (1 << 20, "1.0 MB"), (5 << 40, "5120 GB"), (None, None)])
def test_sizes(spark, n, want):
    assert one(spark, s=text.format_bytes(F.lit(n).cast("long"))).s == want


@pytest.mark.parametrize("line,want", [("* setting: *bright* [hall]", "*bright* [hall"), ("• setting: hall", None), ("> setting: hall", None), ("the setting: hall", None), ("- * Setting :\u00a0[ hall ]\u00a0", "hall"), ("setting: a\u2028setting: b", "b"), ("setting: []", None)])
def test_key_values(spark, line, want):
    assert one(spark, v=text.key_values(F.lit(line), ("setting",))).v.setting == want


@pytest.mark.parametrize("path,first,second,meta,want", [
    ("/2019/a.jpg", "2020:03:04 01:02:03", "2021:01:01 00:00:00", "2022-05-06", (2020, 3, "exif_primary")), ("/2019/a.jpg", "0000:00:00 00:00:00", "2021:01:01 00:00:00\0", None, (2021, 1, "exif_fallback")),
    ("/2019/a.MP4", "2020:03:04 01:02:03", None, "2022-05-06T01:02:03Z", (2022, 5, "video_metadata")), ("/2019/a.jpg", None, None, "2022-05-06", (2019, 0, "path_regex")),
    ("/a/b.mov", None, None, "1904-01-01T00:00:00Z", (2024, 2, "mtime")), ("/a/b", "x", None, None, (2024, 2, "mtime")), (None, None, None, None, (2024, 2, "mtime")),
])
def test_source_dates(spark, path, first, second, meta, want):
    d = one(spark, d=text.source_date(*[F.lit(x).cast("string") for x in (first, second, meta, path)], F.lit("2024-02-03").cast("timestamp"))).d
    assert (d.year, d.month, d.source) == want


@pytest.mark.parametrize("path,kind", [("/a/b.MKV", "video"), ("/a/b.webm", None), ("/a/b.3gp", None), ("/a/b.TIF", "image"), ("/a/mp4", None), (None, None)])
def test_file_types(spark, path, kind):
    assert one(spark, k=text.file_type(F.lit(path).cast("string"))).k == kind


@pytest.mark.parametrize("path,want", [("/x/IMG_20240512_1.jpg", (2024, 5)), ("/a/2024-05/x.jpg", (2024, 5)), ("/a/May 3 2021/x", (2021, 5)), ("/a/2019/x", (2019, 0)), ("/a/x", (0, 0)), ("/a/12024051/x", (0, 0)), ("/a/Jan2019/x", (2019, 1)), ("/a/January.2019/x", (2019, 1)), ("/a/May.5 2018/x", (2018, 5)), ("/a/Marching 2019/x", (2019, 0)), ("/a/decoration 2020/x", (2020, 0)), ("/a/12019-05/x", (2019, 5)), ("/a/sept-2016/x", (2016, 9)), ("/a/SEPTEMBER 12_2016/x", (2016, 9))])
def test_path_dates(spark, path, want):
    d = one(spark, d=text.path_year_month(F.lit(path))).d
    assert (d.year, d.month) == want


def test_metrics(spark):
    df = spark.createDataFrame([("g", 1.0, 2.0), ("g", 2.0, 4.0), ("c", 1.0, 5.0), ("c", 1.0, 6.0), ("n", 1.0, None), ("n", None, 1.0)], "g string, x double, y double")
    assert {r.g: r.r for r in metrics.pearson(df, "x", "y", ["g"]).collect()} == {"g": 1.0, "c": None}
    q = spark.createDataFrame([(v,) for v in (1.0, 1.0, 1.0, 4.0, None)], "v double")
    assert sorted((str(r.v), r.quartile) for r in metrics.quartiles(q, "v").collect()) == [("1.0", 1)] * 3 + [("4.0", 4), ("None", None)]
    c = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b")], "t string, p string")
    s = {r.label: (r.precision, r.recall, r.f1, r.support) for r in metrics.class_scores(c, "t", "p", ["a", "b", "z"]).collect()}
    assert s == {"a": (1.0, 0.5, 0.666667, 2), "b": (0.5, 1.0, 0.666667, 1), "z": (0.0, 0.0, 0.0, 0)}
    m = {r.t: (r.as_a, r.as_b, r.as_z) for r in metrics.confusion(c, "t", "p", ["a", "b", "z"]).collect()}
    assert m == {"a": (1, 1, 0), "b": (0, 1, 0), "z": (0, 0, 0)}
    h = spark.createDataFrame([(0,), (15,), (None,)], "v int")
    assert {r.bin: r.n for r in metrics.histogram(h, F.col("v")).collect() if r.n} == {1: 1, 10: 1}
    assert metrics.score_stats(spark.createDataFrame([("7",), ("x",)], "v string"), "v").first().deviation == 0.0


def test_views(spark):
    f = views.ViewFilter(qualities=frozenset({"good"}), buckets=frozenset({"high"}), people=frozenset({views.UNKNOWN_PERSON}), source="image", representatives_only=True)
    df = spark.createDataFrame([(1, "Good", None, "high", "image", None), (2, "good", ["a"], "high", "image", None), (3, "good", None, None, "image", True), (4, "good", None, "high", "image", False)], "i int, l string, n array<string>, b string, s string, r boolean")
    assert [r.i for r in views.apply_filter(df, f, "l", F.col("n"), "b", "s", F.col("r")).collect()] == [1]
    pos = spark.createDataFrame([(1, "g", False), (2, None, False), (3, "g", True)], "p long, g string, rep boolean")
    assert [r.p for r in selection.followers_after_representative(pos, "p", "g", "rep").orderBy("place").collect()] == [2, 3, 1]


def test_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((200, 8)).round(3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 8), (902, [])], "i long, v array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = np.round(u @ u.T, 12)
    got = {(r.a, r.b) for r in similarity.similar_pairs(df, "i", "v", 0.7, block_rows=64).collect()}
    assert got == {(i, j) for i in range(200) for j in range(i + 1, 200) if sim[i, j] > 0.7}
    # density clusters as published: cores in order, each expanded fully
    nb = [np.flatnonzero(sim[i] > 0.7) for i in range(200)]
    lab, k = np.full(200, -1), 0
    for i in range(200):
        if lab[i] >= 0 or len(nb[i]) < 5:
            continue
        todo = [i]
        while todo:
            p = todo.pop()
            if lab[p] >= 0:
                continue
            lab[p] = k
            if len(nb[p]) >= 5:
                todo += [q for q in nb[p] if lab[q] < 0]
        k += 1
    rows = df.filter("i < 200")
    pairs = similarity.similar_pairs(rows, "i", "v", 0.7)
    assert {r.i: r.cluster for r in similarity.dbscan(rows, pairs, "i", 5).collect()} == dict(enumerate(lab.tolist()))


def test_assignment():
    rng = np.random.default_rng(4)
    from itertools import permutations

    for n, m in ((3, 3), (2, 5), (5, 2), (4, 4)):
        for _ in range(30):
            c = rng.random((n, m))
            got = sum(c[i, j] for i, j in similarity.least_cost(c))
            small, big = (c, m) if n <= m else (c.T, n)
            want = min(sum(small[i, p[i]] for i in range(len(small))) for p in permutations(range(big), len(small)))
            assert got == pytest.approx(want)
    assert similarity.placeholder_names({"personB"}, 27)[:2] == ["personA", "personC"]
    assert similarity.placeholder_names(set(), 28)[-2:] == ["personAA", "personAB"]


def test_sampling(spark):
    assert sampling.sample_windows(1.0, 1, 5, 5) == [] and sampling.sample_windows(None, 1, 5, 5) == []
    w = sampling.sample_windows(100.0, 7, 10, 5)
    assert w == sorted(w) and all(b - a >= 5 for a, b in zip(w, w[1:])) and 0 < len(w) <= 10
    df = spark.createDataFrame([(i, float(i % 5)) for i in range(100)], "i long, w double")
    d = sampling.weighted_draws(df, "i", "w", 400).collect()
    assert sorted(r.draw for r in d) == list(range(400)) and all(r.i % 5 for r in d)
    assert abs(sum(r.i % 5 == 4 for r in d) - 160) <= 20


def test_media():
    flat = np.full((20, 30), 7.0)
    assert media.sharpness(flat) == 0.0 and media.difference_hash(flat) == 0 and media.difference_hash(np.zeros((3, 3))) is None
    ramp = np.tile(np.arange(90.0), (80, 1))
    assert media.difference_hash(ramp) == -1
    assert media.rotation(None) == 0 and media.rotation(b"junk") == 0
    assert media.rotation(struct.pack(">I4s", 3, b"moov")) == 0
    from framelake.plans.media import _movie

    assert [media.rotation(_movie(t)) for t in (0, 90, 180, 270)] == [0, 90, 180, 270]


def test_files(spark, tmp_path):
    (tmp_path / "dirs.txt").write_text(" /a \n\n# no\n/b\n")
    assert {r.dir for r in files.folder_list(spark, str(tmp_path / "dirs.txt")).collect()} == {"/a", "/b"}
    media_dir = tmp_path / "m" / "sub"
    media_dir.mkdir(parents=True)
    for n in ("a.MP4", "b.jpg", "c.txt"):
        (media_dir / n).write_bytes(b"xy")
    found = files.crawl(spark, [str(tmp_path / "m")])
    assert {(r.file_path[-5:], r.file_type, r.size_bytes) for r in found.collect()} == {("a.MP4", "video", 2), ("b.jpg", "image", 2)}
    (tmp_path / "c.yaml").write_text("name: june\nlong_video_windows: 3\n")
    c = files.RunConfig.load(str(tmp_path / "c.yaml"))
    assert (c.name, c.long_video_windows, c.long_video_threshold_s) == ("june", 3, 60.0)
    files.write_document({"a": 1}, str(tmp_path / "d.json"))
    for n in (1, 2):
        files.write_document({"n": n}, f"file://{tmp_path}/e.json", spark)
    assert json.loads((tmp_path / "e.json").read_text()) == {"n": 2} and not (tmp_path / "e.json.part").exists()
    assert files.read_document(spark, str(tmp_path / "d.json"), "a int").first().a == 1
    assert files.read_document(spark, str(tmp_path / "missing.json"), "a int").count() == 0
    v = [files.write_version(spark.range(n), str(tmp_path / "table")) for n in (1, 2)]
    assert v[1].endswith("v=1") and spark.read.parquet(v[1]).count() == 2
    names = spark.createDataFrame([(1, "/x/a.jpg"), (2, "/y/a.jpg"), (3, "/z/b")], "i int, p string")
    assert {r.i: r.export_name for r in files.unique_names(names, "p", [F.col("i")]).collect()} == {1: "a.jpg", 2: "a_2.jpg", 3: "b"}
    assert files.with_optional(names, "rep", "boolean", True).first().rep is True


def test_image_source(spark, tmp_path):
    """A grey ramp as BMP: rows are stored bottom up and padded to four bytes."""
    w, h = 24, 16
    row = b"".join(bytes((v, v, v)) for v in range(0, 10 * w, 10)) + bytes(-3 * w % 4)
    body = row * h
    head = struct.pack("<2sIHHI", b"BM", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(body), 0, 0, 0, 0)
    (tmp_path / "ramp.bmp").write_bytes(head + body)
    r = media.measure_images(spark.read.format("image").load(str(tmp_path))).first()
    # inside a ramp the Laplacian is nought, mirrored borders are not
    assert r.code == -1 and r.sharpness > 0 and r.origin.endswith("ramp.bmp")


def test_probe_survives_broken_files(spark):
    df = spark.createDataFrame([(1, bytearray(b"ok")), (2, bytearray(b"")), (3, None)], "i int, content binary")
    got = {r.i: r.size for r in media.probe(df, "content", lambda c: {"size": 1 // (len(c) > 1)}, "size double").collect()}
    assert got[1] == 1.0 and all(got[k] is None or got[k] != got[k] for k in (2, 3))


def test_crop_and_roll(spark):
    r = one(spark, c=media.crop_box(*[F.lit(v) for v in (10, 30, 90, 95, 100, 100)]), tilt=media.roll(*[F.lit(v) for v in (0.0, 0.0, 10.0, 10.0)], F.lit(True)), flat=media.roll(*[F.lit(v) for v in (0.0, 0.0, 100.0, 1.0)], F.lit(True)), odd=media.roll(*[F.lit(v) for v in (0.0, 0.0, 10.0, 10.0)], F.lit(False)))
    assert tuple(r.c) == (0, 10, 100, 100) and r.tilt == pytest.approx(45) and r.flat == 0 and r.odd == 0


def test_precedence_and_claims(spark):
    left = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, None, None)], "i int, p string, q string")
    right = spark.createDataFrame([("a", "z", 10), ("c", "x", 20), ("d", "x", 19)], "rp string, rq string, v int")
    got = {r.i: r.v for r in joins.resolve_by_precedence(left, right, [("p", "rp"), ("q", "rq")], "v", [F.col("v")]).collect()}
    assert got == {1: 10, 2: 19, 3: None}
    claims = spark.createDataFrame([(1, "n"), (2, "n"), (3, "m")], "i int, name string")
    assert {r.i for r in joins.first_claim(claims, "name", [F.col("i")]).collect()} == {1, 3}


def test_hit_box(spark):
    pts = spark.createDataFrame([("f", 5, 5), ("f", 50, 50), ("f", 99, 99)], "k string, x int, y int")
    bx = spark.createDataFrame([("f", 2, False, 0, 0, 60, 60), ("f", 1, True, 0, 0, 10, 10)], "k string, box_id int, accepted boolean, x1 int, y1 int, x2 int, y2 int")
    assert {(r.x, r.box_id) for r in joins.hit_box(pts, bx, "k", "x", "y", F.lit(True)).collect()} == {(5, 1), (50, 2)}
    assert {(r.x, r.box_id) for r in joins.hit_box(pts, bx, "k", "x", "y", F.lit(False)).collect()} == {(5, 1)}


def test_groups_and_representatives(spark):
    rows = spark.createDataFrame([(1, 0.5, 9), (2, 0.9, 1), (3, None, 5), (4, None, 7), (5, 0.1, 1)], "i long, q double, size int")
    pairs = spark.createDataFrame([(1, 2), (3, 4)], "a long, b long")
    g = similarity.similarity_groups(rows, pairs, "i")
    assert {r.i: (r.group_id, r.size) for r in g.collect()} == {1: (1, 2), 2: (1, 2), 3: (2, 2), 4: (2, 2), 5: (None, None)}
    rep = similarity.representatives(rows.withColumnRenamed("size", "bytes"), g.drop("size"), "i", "q", "bytes")
    assert {r.i for r in rep.filter("is_representative").collect()} == {2, 4, 5}


def test_resolve_identities(spark):
    unit = lambda k: [1.0 if i == k else 0.0 for i in range(4)]
    index = spark.createDataFrame([("ann", "Ann", unit(0), 3)], "name string, display_name string, centroid array<double>, member_count long")
    new = spark.createDataFrame([(0, [0.9, 0.1, 0.0, 0.0], 8), (1, unit(2), 5)], "cluster int, centroid array<double>, member_count long")
    got = {r.name: (r.display_name, r.member_count) for r in similarity.resolve_identities(index, new).collect()}
    assert got == {"ann": ("Ann", 8), "personA": ("personA", 5)}
    assert similarity.assign(new, index.limit(0), "cluster", "name", 0.5).count() == 0


def test_empty_tables(spark):
    e = spark.createDataFrame([], "i long, g string, s double, t double, h long, v array<double>, hash string, file_path string")
    assert selection.top_k(e, ["g"], [F.col("i")], 3).count() == 0 and selection.global_rank(e, ["i"], "k").count() == 0
    assert dedup.greedy_hamming(e, "i", "h", "s").count() == 0 and dedup.canonical(e, "hash", "file_path").count() == 0
    assert similarity.similar_pairs(e, "i", "v", 0.5).count() == 0 and similarity.centroids(e, "g", "v").count() == 0
    assert metrics.coverage(e, ["g"]).first().share is None and metrics.pearson(e, "s", "t", ["g"]).count() == 0
    assert sampling.weighted_draws(e, "i", "s", 5).count() == 0 and sampling.sample_n(e, "i", 5).count() == 0


def test_nearest(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0])], "i long, v array<double>")
    c = spark.createDataFrame([("b", [0.0, 2.0]), ("a", [3.0, 0.0])], "g string, centroid array<double>")
    got = {r.i: (r.g, r.distance) for r in similarity.nearest(df, c, "i", "v", "g").collect()}
    assert got == {1: ("a", 0.0), 2: ("a", pytest.approx(1 - 0.5**0.5)), 3: ("a", 1.0)}
    assert similarity.nearest(df, c.limit(0), "i", "v", "g").count() == 0
    with pytest.raises(ValueError):
        similarity.nearest(df, c, "i", "v", "g", max_centroids=1)


def test_targets_and_windows_of_very_long_files(spark, data):
    from framelake.plans import catalogue

    manifest = spark.read.parquet(f"{data}/manifest.parquet").filter("duration_s >= 100000")
    long = {r.file_path: int(r.duration_s * 0.5) for r in manifest.collect()}
    assert long
    got = catalogue.queries()["op201_uniform_targets"](spark, data)
    n = {r.file_path: (r.n, r.u, r.hi) for r in got.groupBy("file_path").agg(F.count("*").alias("n"), F.count_distinct("target_index").alias("u"), F.max("target_s").alias("hi")).collect()}
    assert {p: n[p] for p in long} == {p: (k, k, (k - 1) / 0.5) for p, k in long.items()}
    parts = got.filter(F.col("file_path").isin(*long)).select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(parts) > 1
    w = {r.file_path: r.windows for r in catalogue.queries()["op200_sample_windows"](spark, data).collect()}
    assert all(len(w[p]) == 20 for p in long)


def test_targets_at_block_edges(spark):
    df = spark.createDataFrame([(i, d) for i, d in enumerate([None, float("nan"), float("inf"), float("-inf"), -3.0, 0.0, 3.9, 4.0, 4.1, 9.0])], "i int, d double")
    got = sorted((r.i, r.target_index) for r in sampling.uniform_targets(df, "d", 1.0, block=4).collect())
    assert got == [(i, k) for i, n in ((4, 1), (5, 1), (6, 3), (7, 4), (8, 4), (9, 9)) for k in range(n)]
    assert sampling.sample_windows(float("inf"), 1, 5, 5) == []


def whole_text_documents(spark, tmp_path):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9))) for _ in range(400)]
    say = lambda k: " ".join(rng.choice(words) for _ in range(k))
    texts = [say(40)[:140] + say(60) for _ in range(40)]
    texts += [texts[0][:130] + say(80), texts[1][:130] + say(80), "x" + texts[2], texts[3][:200] + "y" + texts[3][200:], texts[4], "a", "ab", "é" * 9]
    rows = [(i, "s" if i % 3 else "t", len(t), t) for i, t in enumerate(texts)]
    rows += [(900, "s", 0, None), (901, "s", 0, "")]
    spark.createDataFrame(rows, "doc_id long, source string, n_chars int, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path), [r for r in rows if r[3]]


def bits_apart(a, b):
    return ((a ^ b) & (2**64 - 1)).bit_count()


def test_hamming_dedup_reads_whole_texts(spark, tmp_path):
    from framelake.plans import catalogue

    d, rows = whole_text_documents(spark, tmp_path)
    code = {r[0]: dedup.similarity_hash(r[3]) for r in rows}

    def greedy(rows, code, radius, grouped):
        kept = []
        for r in sorted(rows, key=lambda r: (-r[2], r[0])):
            if all(bits_apart(code[r[0]], code[k[0]]) > radius for k in kept if not grouped or k[1] == r[1]):
                kept.append(r)
        return kept

    low = {i: c << 8 & (2**64 - 1) for i, c in code.items()}
    want = {"op066_hamming_greedy": greedy(rows, code, 8, True), "op068_cross_file_dedup": greedy(rows, code, 8, False), "op067_two_stage_hamming": greedy(greedy(rows, code, 4, True), low, 4, True)}
    for name, kept in want.items():
        assert sorted(r.doc_id for r in catalogue.queries()[name](spark, d).collect()) == sorted(k[0] for k in kept)
    across = {k[0] for k in want["op068_cross_file_dedup"]}
    # a text that differs after 128 characters is another text; one inserted character makes a near copy
    assert {0, 1, 40, 41} <= across and len(across & {2, 42}) == len(across & {3, 43}) == len(across & {4, 44}) == 1


def test_similarity_hash_in_parts():
    long = " ".join(map(str, range(9000)))
    assert len(long) > 1 << 15 and bits_apart(dedup.similarity_hash(long), dedup.similarity_hash("q" + long)) <= 2
    assert bits_apart(dedup.similarity_hash(long), dedup.similarity_hash(long[:20000] + long[:20000])) > 2


def test_hamming_pairs_of_whole_texts(spark, tmp_path):
    from framelake.plans import catalogue

    d, rows = whole_text_documents(spark, tmp_path)
    rep = {}
    for r in rows:
        rep.setdefault(dedup.similarity_hash(r[3]), r[0])
    want = sorted((min(i, j), max(i, j)) for a, i in rep.items() for b, j in rep.items() if i < j and bits_apart(a, b) <= 8)
    got = sorted((r.a, r.b) for r in catalogue.queries()["op054_hamming_pairs"](spark, d).collect())
    assert got == want and {(2, 42), (3, 43)} <= set(got) and not {(0, 40), (1, 41)} & set(got)


def test_text_stats_cover_all_captions(spark, tmp_path):
    import re

    from framelake.plans import catalogue

    texts = ["two words", "Le garçon dévore une crêpe", "Бабушка кормит уток", "line\nbreak here", "", None, "弟が公園で", "a_1 – b"]
    spark.createDataFrame([(t,) for t in texts], "caption_description string").write.parquet(f"{tmp_path}/results.parquet")
    w = [len(re.findall(r"\w+", t)) for t in texts if t is not None]
    got = catalogue.queries()["op126_text_stats"](spark, str(tmp_path)).first()
    assert (got.n, got.low, got.high) == (len(w), min(w), max(w))
    assert got["mean"] == pytest.approx(np.mean(w), abs=1e-6) and got.deviation == pytest.approx(np.std(w), abs=1e-6)


def test_head_digest_cuts_long_texts(spark, tmp_path):
    import hashlib

    from framelake.plans import catalogue

    texts = ["", "short", "a" * 65_535 + "é tail", "b" * 65_536, "c" * 65_536 + "d", "é" * 40_000, None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.digest for r in catalogue.queries()["op092_head_digest"](spark, str(tmp_path)).collect()}
    assert got == {i: hashlib.md5(t.encode()[:65_536]).hexdigest() for i, t in enumerate(texts) if t is not None}

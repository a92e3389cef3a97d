"""Problems 1, 3 and 4 against brute force: repeats, ties, unusable vectors, hot groups, empty tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.llm import clusters, history, permutation, vectors
from framelake.llm.clusters import boruvka, cluster, linked_groups
from framelake.llm.history import HistoryIndex, repeats_by_batch
from framelake.llm.knn import knn, similar_pairs
from framelake.llm.names import same_file_key

SCHEMA = "row_id long, batch_no int, kept_path string, embedding array<float>, face_count int, vec string, unit int, family int"


def people(n_people=12, each=12, noise=0.55, seed=1, loners=40):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n_people):
        c = rng.standard_normal(512)
        c /= np.linalg.norm(c)
        for _ in range(each):
            e = rng.standard_normal(512)
            v = c + noise * e / np.linalg.norm(e)
            out.append(v / np.linalg.norm(v))
    out += [v / np.linalg.norm(v) for v in rng.standard_normal((loners, 512))]
    return np.array(out, dtype=np.float32)


def table(spark, x, **cols):
    n = len(x)
    rows = [(int(cols.get("ids", range(n))[i]), int(cols.get("batch", [0] * n)[i]), cols.get("paths", [None] * n)[i], None if x[i] is None else [None if v is None else float(v) for v in x[i]], 1, "clash", 0, 0) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def cosines(x):
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    return np.round(u @ u.T, 12)


def bad_vectors():
    return [None, [0.0] * 512, [float("nan")] + [1.0] * 511, [float("inf")] + [1.0] * 511, [1.0] * 256, [], [None] + [1.0] * 511]


def test_pack_is_exact():
    rng = np.random.default_rng(0)
    x = np.concatenate([np.rint(rng.normal(0, 20, (5, 512))) / 256, rng.normal(0, 0.05, (5, 512)).astype(np.float16), rng.normal(0, 0.05, (5, 512))]).astype(np.float32)
    x[0] *= 2.0**-60
    packed = vectors.pack(x)
    assert {p[0] for p in packed} == {vectors.INT8, vectors.HALF, vectors.FULL}
    import pyarrow as pa

    assert (vectors.unpack(pa.array(packed, pa.binary())).astype(np.float32) == x).all()


def test_usable(spark):
    import pyarrow as pa

    at, x = vectors.usable_matrix(pa.array([*bad_vectors(), [1.0] * 512], pa.list_(pa.float32())))
    assert at.tolist() == [7] and x.shape == (1, 512)


def test_footrule():
    rng = np.random.default_rng(1)
    pv = permutation.fit(people(30, 4, loners=200), 256, permutation.IndexParams(), 0.5)
    x = rng.standard_normal((6, 512)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = (x @ pv.code.T) - pv.centre
    half = np.argsort(np.argsort(-s, axis=1), axis=1) < permutation.CODE_PIVOTS // 2  # the half of the order in which a pivot is
    want = [[int((a != b).sum()) for b in half] for a in half]
    codes = pv.codes(x @ pv.code.T)
    assert permutation.footrule(codes, codes).tolist() == want


def pairs_of_two(n, pairs, cos, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 512)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for k in range(0, 2 * pairs, 2):
        z = x[k + 1] - (x[k + 1] @ x[k]) * x[k]
        x[k + 1] = cos * x[k] + np.sqrt(1 - cos * cos) * z / np.linalg.norm(z)
    return x


def test_pairs_of_two_are_found_and_others_rejected(spark):
    x = pairs_of_two(4000, 600, 0.52)
    got = {(r.row_id_1, r.row_id_2) for r in similar_pairs(table(spark, list(x))).collect()}
    want = {(k, k + 1) for k in range(0, 1200, 2)}
    assert len(got & want) >= 0.97 * len(want) and not got - want
    # unrelated rows that share a pivot are rejected by the footrule
    pv = permutation.fit(x[:1500], 1024, permutation.IndexParams(), 0.5)
    assert pv.prefix < 60 and pv.max_footrule < 330
    d = permutation.footrule(*[pv.codes(y @ pv.code.T) for y in (x[1200:2000], x[2000:])])
    assert (d > pv.max_footrule).mean() > 0.9999


def test_dense_vectors(spark):
    rng = np.random.default_rng(3)
    y = rng.standard_normal((1500, 24)) @ rng.standard_normal((24, 512))
    y = 0.8 * y / np.linalg.norm(y, axis=1, keepdims=True) + 0.02
    x = np.concatenate([(y / np.linalg.norm(y, axis=1, keepdims=True)).astype(np.float32), people(2, 3, loners=3)])
    got = {(r.row_id_1, r.row_id_2) for r in similar_pairs(table(spark, list(x)), params=permutation.IndexParams(block_rows=256)).collect()}
    want = nearest(x, list(range(len(x))), 5, 0.5)
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)


def nearest(x, ids, k, floor):
    s = cosines(x)
    out = set()
    for i in range(len(x)):
        o = sorted((j for j in range(len(x)) if j != i and s[i, j] > floor), key=lambda j: (-s[i, j], ids[j]))[:k]
        out |= {(min(ids[i], ids[j]), max(ids[i], ids[j])) for j in o}
    return out


@pytest.mark.parametrize("pivots,block", [(2048, 4096), (24, 16)])
def test_knn_recall(spark, pivots, block):
    x = people()
    x = np.concatenate([x, x[:3], 4 * x[3:5]])  # ties, and lengths that do not matter
    ids = [1000 - i for i in range(len(x))]
    df = table(spark, [*x, *bad_vectors()], ids=[*ids, *range(5000, 5007)])
    got = {(r.row_id_1, r.row_id_2) for r in similar_pairs(df, params=permutation.IndexParams(n_pivots=pivots, block_rows=block)).collect()}
    want = nearest(x, ids, 5, 0.5)
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)
    assert similar_pairs(df.limit(0)).count() == 0
    assert similar_pairs(df.filter("row_id >= 5000")).count() == 0


def test_knn_of_many_copies(spark):
    x = np.concatenate([np.repeat(people(1, 1, loners=0), 60, axis=0), people(3, 5, seed=5, loners=5)])
    df = table(spark, list(x))
    assert {(r.row_id_1, r.row_id_2) for r in similar_pairs(df).collect()} == nearest(x, list(range(len(x))), 5, 0.5)
    assert knn(df).groupBy("row_id").count().filter("count > 5").count() == 0


def groups(x, floor, least):
    s = cosines(x) > floor
    lab = list(range(len(x)))
    while True:
        new = [min(lab[j] for j in np.flatnonzero(s[i])) for i in range(len(x))]
        if new == lab:
            break
        lab = new
    return {(i, c) for i, c in enumerate(lab) if lab.count(c) >= least}


def test_linked_groups(spark):
    x = people(15, 9, noise=0.7, seed=3)
    chain = [x[0]]
    rng = np.random.default_rng(9)
    for _ in range(8):  # rows that hang together one by one only
        e = rng.standard_normal(512)
        e -= (e @ chain[-1]) * chain[-1]
        chain.append(0.55 * chain[-1] + np.sqrt(1 - 0.55**2) * e / np.linalg.norm(e))
    x = np.concatenate([x, np.array(chain[1:], dtype=np.float32), np.repeat(x[20:21], 30, axis=0), np.repeat(people(1, 1, seed=77, loners=0), 9, axis=0)])
    df = table(spark, [*x, *bad_vectors()])
    for p in (permutation.IndexParams(), permutation.IndexParams(n_pivots=40, block_rows=16)):
        assert {(r.row_id, r.cluster_id) for r in linked_groups(df, params=p).collect()} == groups(x, 0.5, 5)
    assert linked_groups(df.limit(0)).count() == 0


def test_boruvka(spark):
    rng = np.random.default_rng(2)
    e = {(min(a, b), max(a, b)): round(float(w), 3) for a, b, w in zip(rng.integers(0, 60, 300), rng.integers(0, 60, 300), rng.random(300)) if a != b}
    lab, want = list(range(60)), []
    for (a, b), w in sorted(e.items(), key=lambda t: (t[1], t[0])):
        if lab[a] != lab[b]:
            old, new = lab[a], lab[b]
            lab = [new if v == old else v for v in lab]
            want.append((a, b, w))
    df = spark.createDataFrame([(int(a), int(b), w) for (a, b), w in e.items()], "a long, b long, dist double")
    assert sorted((r.a, r.b, r.dist) for r in boruvka(df).collect()) == sorted((int(a), int(b), w) for a, b, w in want)


def test_clusters_have_stable_members(spark):
    x = people(6, 10, noise=0.5, seed=4)
    got = {r.cluster_id: r for r in cluster(table(spark, list(x))).collect()}
    assert set(got) == {10 * i for i in range(6)} and all(r.size == 10 and len(r.exemplars) == 3 for r in got.values())
    assert all(e // 10 * 10 == c for c, r in got.items() for e in r.exemplars)
    assert cluster(table(spark, list(x)).limit(0)).count() == 0


def test_large_trees_are_cut_on_the_ladder(spark):
    x = people(4, 8, noise=0.45, seed=4, loners=3)
    df = table(spark, list(x))
    got, on_ladder = ({(r.cluster_id, r.size) for r in cluster(df, task_rows=n).collect()} for n in (1000, 1))
    assert got == on_ladder == {(8 * i, 8) for i in range(4)}


def test_condense():
    # two dense groups of five on a chain, joined by a long edge, and one row that hangs on loosely
    a = np.array([0, 1, 2, 3, 5, 6, 7, 8, 4, 9])
    b = np.array([1, 2, 3, 4, 6, 7, 8, 9, 5, 10])
    dist = np.array([0.1] * 4 + [0.1, 0.1, 0.1, 0.05] + [0.4, 0.45])
    got = clusters.condense(11, a, b, dist, 0.5, 5)
    assert [(round(d, 9), m.tolist()) for d, _, m, _ in got] == [(0.4, [0, 1, 2, 3, 4]), (0.4, [5, 6, 7, 8, 9])]
    assert [round(s, 6) for _, s, _, _ in got] == [round(5 * (10 - 2.5), 6)] * 2
    # without a split the whole tree is the cluster; copies are of finite density; too small a tree is none
    (d, s, m, leave), = clusters.condense(6, np.arange(5), np.arange(1, 6), np.zeros(5), 0.5, 5)
    assert (d, m.tolist(), s) == (0.5, list(range(6)), 6 * (100 - 2.0)) and (leave == 100).all()
    # an edge too many changes nothing
    again = clusters.condense(11, np.r_[a, a], np.r_[b, b], np.r_[dist, dist], 0.5, 5)
    assert [m.tolist() for _, _, m, _ in again] == [[0, 1, 2, 3, 4], [5, 6, 7, 8, 9]]
    assert clusters.condense(3, np.arange(2), np.arange(1, 3), np.zeros(2), 0.5, 5) == []


@pytest.mark.parametrize("a,b", [("/a/B.jpg", "\\A\\b.JPG"), ("/a/x y.jpg", "file:///a/x%20y.jpg"), ("/a/ü.jpg", "/a/ü.jpg"), ("/a/k/b", "/a//./k/../k/b "), ("/a/b", "/a/b\n"), ("/a/ü", "/a/%C3%BC")])
def test_same_file(a, b):
    assert same_file_key(a) == same_file_key(b)


def test_other_files():
    assert len({same_file_key(p) for p in ("/a/b", "/a/bc", "/c/a/b", "a/b", "/a/b%2", "/a/100%.jpg", "/a/%ff")}) == 7
    assert same_file_key(None) is None and same_file_key(" ") is None and same_file_key("") is None


def greedy(x, batch, paths):
    s = cosines(x) if len(x) else None
    seen, cases = [], set()
    for i in sorted(range(len(x)), key=lambda i: (batch[i], i)):
        hit = any((paths[i] and paths[j] and same_file_key(paths[i]) == same_file_key(paths[j])) or s[i, j] > 0.95 for j in seen)
        if batch[i] and hit:
            cases.add(i)
        else:
            seen.append(i)
    return cases


@pytest.mark.parametrize("growing", [False, True])
def test_history(spark, growing):
    rng = np.random.default_rng(6)
    x, batch, paths = list(people(8, 6, seed=8)), [], []
    for i in range(60):  # near repeats, some in chains
        e = rng.standard_normal(512)
        v = x[rng.integers(0, len(x))] + 0.2 * e / np.linalg.norm(e)
        x.append((v / np.linalg.norm(v)).astype(np.float32))
    x += [x[3]] * 20  # copies
    n = len(x)
    batch = [0 if i < 40 else int(rng.integers(0, 4)) for i in range(n)]
    paths = [None if i % 7 == 0 else f"/s/{i if i % 5 else i // 10}.jpg" for i in range(n)]
    df = table(spark, x, batch=batch, paths=paths)
    ix = HistoryIndex(spark, bucket_rows=2) if growing else None
    got = {r.row_id for r in repeats_by_batch(df, index=ix, least_rows=1 if growing else 20_000).collect()}
    assert got == greedy(np.array(x), batch, paths)
    assert not growing or ix.generation > 0


def test_history_edges(spark):
    df = table(spark, [*bad_vectors(), None], ids=range(8), batch=[0, 1, 1, 2, 2, 0, 1, 2], paths=["/a", "/A", None, "/b", "/b ", None, "", "/a"])
    assert {r.row_id for r in repeats_by_batch(df).collect()} == {1, 4, 7}
    assert repeats_by_batch(df.limit(0)).count() == 0
    assert repeats_by_batch(df.filter("batch_no = 0")).count() == 0
    assert {r.row_id for r in repeats_by_batch(df.filter("batch_no > 0")).collect()} == {4, 7}


def test_index_goes_on_in_another_session(spark, tmp_path):
    x = people(4, 6, seed=10, loners=10)
    n = len(x)
    df = table(spark, [*x, *x[:5], *x[2:4], -x[0], -x[0]], batch=[0] * n + [1] * 5 + [2] * 4, paths=["/p/0.jpg"] + [None] * (n + 6) + ["/P/0.JPG", None])
    ix = HistoryIndex(spark, path=f"file://{tmp_path}/index")
    assert repeats_by_batch(df.filter("batch_no < 2"), index=ix).count() == 5
    assert not spark.catalog.tableExists(ix.name)
    assert spark.read.parquet(f"{ix.path}/postings-0").select("vkey").distinct().count() == n
    again = HistoryIndex.open(spark.newSession(), ix.path)
    assert (again.threshold, again.buckets, again.counts) == (ix.threshold, ix.buckets, {k: v for k, v in again.counts.items() if v <= ix.counts[k]})
    assert {r.row_id for r in repeats_by_batch(df.filter("batch_no = 2"), index=again).collect()} == {n + 5, n + 6, n + 7}
    # a delivery of batch 0 to an index with a history is a delivery like any other
    assert repeats_by_batch(df.filter("batch_no = 0"), index=HistoryIndex.open(spark, ix.path)).count() == n


def test_a_small_delivery_reads_few_parts(spark):
    x = people(0, 0, seed=3, loners=400)
    ix = HistoryIndex(spark)
    df = table(spark, [*x, x[7]], batch=[0] * 400 + [1])
    assert [r.row_id for r in repeats_by_batch(df, index=ix).collect()] == [400]
    ix = HistoryIndex.open(spark, ix.path)
    vec, _ = ix.represent(df.filter("batch_no = 1").withColumn("b", F.lit(1)), ["b"])
    few = ix.lookup(vec.select(F.col("vkey").alias("key")), True)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in few and "part#" in few.split("PartitionFilters: [")[1].split("]")[0]
    assert len(ix.weigh(vec)) <= 16 and ix.candidates(vec, [1, 2])._jdf.queryExecution().executedPlan().toString().count("SelectedBucketsCount: 2 out of 24") == 1
    ix.close()

def test_overlap_is_verified():
    def rows(keys, tops, token, home):
        t = {"vkey": pa.array(keys, pa.int64()), "token": pa.array([token << 20] * len(keys), pa.int64()), "sketch": pa.array([b"\0" * 64] * len(keys), pa.binary()), "top": pa.array(tops, pa.list_(pa.int16()))}
        return pa.table(t | ({"home": pa.array([True] * len(keys))} if home else {}))

    import pyarrow as pa

    run = history._near_keys(10, 3, 4)
    for token, want in ((history.PIVOT_BASE + 1, {(1, 11)}), (5, {(1, 11), (1, 12), (1, 13)})):
        got = run(rows([1], [[1, 2, 3, 4]], token, True), rows([11, 12, 13], [[4, 3, 2, 9], [1, 2, 8, 9], [1, 2]], token, False))
        assert set(zip(got["key"].to_pylist(), got["other"].to_pylist())) == want


def test_hot_tokens_are_salted(spark):
    x = people(1, 60, noise=0.3, seed=11, loners=0)
    df = table(spark, [*x, *x[:10]], batch=[0] * 60 + [1] * 10)
    ix = HistoryIndex(spark, salt_rows=16)
    assert repeats_by_batch(df, index=ix).agg(F.count("*")).first()[0] == 10
    assert spark.read.parquet(f"{ix.path}/postings-0").select("token").distinct().count() > 1


def test_repeats_without_vectors_in_batch_0(spark):
    rng = np.random.default_rng(5)
    v = rng.standard_normal((6, 512)).astype(np.float32)
    nan = np.full(512, np.nan, np.float32)
    later = [(10, 2, v[0]), (11, 2, v[1]), (12, 3, v[0] * 2), (13, 4, v[2]), (14, 5, v[1]), (15, 5, v[3])]
    for start in ([], [(1, 0, nan), (2, 0, np.zeros(512, np.float32)), (3, 1, nan)]):
        df = spark.createDataFrame([(i, b, f"/p/{i}.jpg", x.tolist()) for i, b, x in [*start, *later]], "row_id long, batch_no int, kept_path string, embedding array<float>")
        assert {r.row_id for r in repeats_by_batch(df).collect()} == {12, 14}


def test_far_rows_meet_in_every_pair_of_blocks(spark, monkeypatch):
    x = pairs_of_two(900, 150, 0.6, seed=8)
    pv = permutation.fit(x[600:], 256, permutation.IndexParams(), 0.5)
    staged = permutation.stage(table(spark, list(x)), pv, permutation.IndexParams(), low=True).cache()
    plain = {r.row_id: r for r in staged.filter("size(top) > 0").collect()}
    code = {i: np.frombuffer(r.sketch, np.uint64)[None] for i, r in plain.items()}
    low = {i: permutation.scaled(np.frombuffer(r.low, np.int8)[None].astype(np.float32))[0] for i, r in plain.items()}
    want = sorted((i, j) for i in plain for j in plain if i < j and set(plain[i].top) & set(plain[j].top) and low[i] @ low[j] > pv.least_low and permutation.footrule(code[i], code[j])[0, 0] <= pv.max_footrule)
    assert len(want) >= 140
    ties = {min(e) if k == "lo" else max(e): None for e in want for k in ("lo", "hi")}
    for rows in (10**6, 100):  # one block of all rows, and many; no posting is shuffled
        monkeypatch.setattr(permutation, "BLOCK_FAR", rows)
        links = permutation.far_links(staged, pv, permutation.IndexParams())
        assert "Exchange" not in links._jdf.queryExecution().executedPlan().toString()
        got = [(r.src, r.dst) for r in links.collect()]
        assert {v for e in got for v in e} == set(ties)
        assert components(got) == components(want)
    staged.unpersist()


def components(edges):
    lab = {v: v for e in edges for v in e}
    while True:
        old = dict(lab)
        for a, b in edges:
            lab[a] = lab[b] = min(lab[a], lab[b])
        if lab == old:
            return lab


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_clusters_do_not_depend_on_task_rows(spark, seed):
    # nested groups, which no ladder of levels tells apart, chains, ties, small trees
    rng = np.random.default_rng(seed)
    edges = []
    for tree, n in enumerate((160, 40, 7, 3)):
        base = 1000 * tree
        for v in range(1, n):
            up = int(rng.integers(max(0, v - 12), v))
            edges.append((base + v, base + up, 0.2 if rng.random() < 0.1 else round(float(rng.choice([0.05, 0.111, 0.112, 0.3]) + 0.1 * rng.random()), 3), base))
    want = {}
    for tree in {e[3] for e in edges}:
        own = [e for e in edges if e[3] == tree]
        a, b, d = (np.array([e[k] for e in own]) for k in range(3))
        for born, stability, members, leave in clusters.condense(len(own) + 1, a - tree, b - tree, d, 0.5, 5):
            want[tree + int(members[0]), len(members), round(1 - born, 9), tuple((tree + members[np.lexsort((members, -leave))[:3]]).tolist())] = stability
    assert len(want) > 4
    df = spark.createDataFrame(edges, "a long, b long, dist double, tree long")
    got = [sorted(map(tuple, clusters.condensed(df, 0.5, 5, 3, rows).collect())) for rows in (1000, 60, 25)]
    assert got[0] == got[1] == got[2]
    stable = {(i, n, level, tuple(e)): s for i, n, level, s, e in got[0]}
    assert len(got[0]) == len(stable) and stable.keys() == want.keys() and all(abs(stable[k] - want[k]) < 2e-6 for k in want)


def test_groups_far_from_all_pivots_span_blocks(spark, monkeypatch):
    x = people(40, 6, noise=0.6, seed=21, loners=60)
    df, sent = table(spark, list(x)), []
    of = permutation.FarRows.of
    monkeypatch.setattr(permutation, "BLOCK_FAR", 64)
    monkeypatch.setattr(permutation.FarRows, "of", lambda t: sent.append(len(t)) or of(t))
    assert {(r.row_id, r.cluster_id) for r in linked_groups(df, params=permutation.IndexParams(n_pivots=16)).collect()} == groups(x, 0.5, 5)
    assert len(sent) > 2 and max(sent) < len(x) / 2


@pytest.mark.parametrize("listed", [1 << 20, 0])
def test_copies_are_left_out_before_they_meet_pivots(spark, monkeypatch, listed):
    once = people(6, 5, noise=0.6, seed=31, loners=10)
    x = np.concatenate([once] * 8)
    bad = bad_vectors() * 8
    df, staged = table(spark, [*x, *bad]), []
    of = permutation.stage
    monkeypatch.setattr(permutation, "stage", lambda d, *a, **k: staged.append(d.count()) or of(d, *a, **k))
    monkeypatch.setattr(permutation, "LISTED", listed, raising=False)
    assert {(r.row_id, r.cluster_id) for r in linked_groups(df).collect()} == groups(x, 0.5, 5)
    assert {(r.row_id_1, r.row_id_2) for r in similar_pairs(df).collect()} == nearest(x, list(range(len(x))), 5, 0.5)
    if listed:  # else lists are too long, and what is staged is filtered
        assert staged == [len(once) + 4, 6 * (len(once) + 4) + 3 * 8]  # four bad vectors and three of other lengths
    assert linked_groups(df, min_cos=1.0).count() == 0


def test_prefixes_are_the_nearest_pivots():
    sim = np.random.default_rng(4).standard_normal((50, 4103))
    for length in (1, 24, 57, 600):  # by chunks, and without
        assert (permutation.permutations(sim, length) == np.argsort(-sim, axis=1)[:, :length]).all()
    assert permutation.permutations(sim[:0], 24).shape == (0, 24)

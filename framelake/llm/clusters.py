"""Grouping records into similarity clusters (problem 4): hierarchical density clustering.

1. The permutation index brings candidates together (``permutation.build``).
2. In each family a minimum spanning forest of the mutual-reachability graph is grown; edges
   longer than the cut are left out. An edge that is not in the forest of a family cannot be in
   the forest of the whole, so only forest edges leave the task: one a row at most.
3. Families overlap in few rows. Their forests are joined by distributed Boruvka rounds on
   the components that such rows tie together; all others are final already.
4. A tree is condensed from short to long edges: where two components of ``min_size`` rows meet, each
   has been a cluster, smaller ones are shed, and the most stable clusters are selected
   (``fold``). A component is known by its size, two sums and its typical rows, so a tree of more
   than ``task_rows`` edges is folded in runs of so many edges, each on the components of the run
   before, by the same steps in the same order: the clusters do not depend on ``task_rows``.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.knn import top_k
from framelake.llm.permutation import IndexParams, blocked, build, slices
from framelake.llm.vectors import exact_cos, unit, unpack
from framelake.operators.graph import connected_components
from framelake.operators.selection import global_rank
from framelake.session import materialize


def _forest(dist: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Root, parent (-1 at roots) and parent distance of each row, by Prim over edges below limit."""
    n = len(dist)
    root, parent, length = np.arange(n), np.full(n, -1), np.full(n, np.inf)
    best, via, out = np.full(n, np.inf), np.full(n, -1), np.ones(n, dtype=bool)
    start = 0
    for _ in range(n):
        cand = np.where(out, best, np.inf)
        v = int(cand.argmin())
        if cand[v] >= limit:
            while not out[start]:
                start += 1
            v = start
        else:
            parent[v], length[v], root[v] = via[v], best[v], root[via[v]]
        out[v] = False
        closer = out & (dist[v] < best)
        best[closer] = dist[v][closer]
        via[closer] = v
    return root, parent, length


def _forest_in_unit(limit: float, dim: int):
    schema = pa.schema([("row_id", pa.int64()), ("local", pa.int64()), ("parent", pa.int64()), ("dist", pa.float64())])

    def run(t: pa.Table) -> pa.Table:
        ids, fam, core = (t[c].to_numpy() for c in ("row_id", "family", "core"))
        u64 = unit(unpack(t["packed"], dim))
        u32 = u64.astype(np.float32)
        parts: list[tuple[np.ndarray, ...]] = []
        for at in slices(fam):
            if len(at) < 2:
                continue
            at = at[np.argsort(ids[at], kind="stable")]
            d = 1.0 - u32[at] @ u32[at].T
            i, j = np.nonzero(np.triu(np.abs(d - limit) < 1e-5, 1))
            if len(i):  # which side of the cut is decided in double precision
                c = 1.0 - exact_cos(u64[at[i]], u64[at[j]])
                d[i, j] = d[j, i] = np.where(c < limit, limit - 2e-6, limit + 2e-6)
            if core.any():
                d = np.maximum(d, np.maximum(core[at][:, None], core[at][None, :]))
            root, parent, length = _forest(d, limit)
            p = np.where(parent < 0, -1, ids[at[np.maximum(parent, 0)]])
            parts.append((ids[at], ids[at[root]], p, np.where(parent < 0, np.nan, np.maximum(length, 0.0))))
        none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0),)
        a, b, c, w = (np.concatenate([x[k] for x in [none, *parts]]) for k in range(4))
        return pa.table([pa.array(a), pa.array(b), pa.array(c, mask=c < 0), pa.array(w, mask=np.isnan(w))], schema=schema)

    return run


def forests(files: DataFrame, min_cos: float, min_samples: int, p: IndexParams) -> DataFrame:
    """(row_id, local, parent, dist): the forests of all families; ``local`` is the smallest id of the tree."""
    if min_samples > 1:
        far = top_k(files, min_samples - 1, min_cos, p).filter(F.col("rank") == min_samples - 1).select("row_id", (1 - F.col("cos")).alias("core"))
        files = files.join(far, "row_id")  # rows of too few neighbours are noise
    else:
        files = files.withColumn("core", F.lit(0.0))
    cut = blocked(files, "family", p.block_rows)
    out = "row_id long, local long, parent long, dist double"
    return cut.groupBy("unit").applyInArrow(_forest_in_unit(1.0 - min_cos, p.dim), out)


def _tree_ties(f: DataFrame, exact: bool) -> DataFrame:
    """Components of trees that share rows: (local, component).

    Two trees of one smallest id have one component already; with ``exact`` they are named all
    the same, since their edges are not those of one tree.
    """
    ties = f.groupBy("row_id").agg(F.min("local").alias("lo"), F.max("local").alias("hi"), F.count("*").alias("n"), F.collect_set("local").alias("all")).filter("n > 1")
    edges = ties.filter("lo <> hi").select(F.col("lo").alias("src"), F.explode("all").alias("dst")).filter("src <> dst").distinct()
    comp = connected_components(edges).withColumnRenamed("node", "local")
    if not exact:
        return comp
    alone = ties.filter("lo = hi").select(F.col("lo").alias("local")).distinct().join(comp, "local", "left_anti")
    return comp.unionByName(alone.withColumn("component", F.col("local")))


def linked_groups(df: DataFrame, min_cos: float = 0.5, min_size: int = 5, params: IndexParams | None = None) -> DataFrame:
    """(row_id, cluster_id): the hierarchy cut at one level, without a density demand.

    Rows are linked if their cosine is above ``min_cos``; linked rows and those linked through
    others form a group, named by its smallest id. Groups of fewer than ``min_size`` rows, rows
    without a usable vector and empty tables give no rows. Other columns are not read.
    """
    f = spanning_forest(df, min_cos, 1, params, exact=False)
    lab = f.select(F.explode(F.array("a", "b")).alias("row_id"), F.col("tree").alias("cluster_id")).distinct()
    size = lab.groupBy("cluster_id").agg(F.count("*").alias("n")).filter(F.col("n") >= min_size).select("cluster_id")
    return lab.join(size, "cluster_id").select("row_id", "cluster_id")


def boruvka(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Minimum spanning forest (a, b, dist) of an edge table, ties by (a, b).

    Each round keeps, for every component, its shortest edge to another one, then contracts, so the
    components halve at least; a forest that is not done after ``max_rounds`` is refused.
    """
    edges = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "dist").groupBy("a", "b").agg(F.min("dist").alias("dist")), "edges")
    cur, kept = edges.select("a", "b", "dist", F.col("a").alias("ca"), F.col("b").alias("cb")), []
    for _ in range(max_rounds):
        both = cur.select(F.col("ca").alias("c"), F.struct("dist", "a", "b", "ca", "cb").alias("e")).union(cur.select(F.col("cb").alias("c"), F.struct("dist", "a", "b", "ca", "cb").alias("e")))
        pick = materialize(both.groupBy("c").agg(F.min("e").alias("e")).select("e.*").distinct(), "pick")
        if pick.isEmpty():
            break
        kept.append(pick.select("a", "b", "dist"))
        comp = connected_components(pick, "ca", "cb")
        for side in ("ca", "cb"):
            cur = cur.join(comp.select(F.col("node").alias(side), F.col("component").alias("n")), side, "left").withColumn(side, F.coalesce("n", side)).drop("n")
        cur = materialize(cur.filter("ca <> cb"), "edges")
    else:
        raise RuntimeError(f"no spanning forest after {max_rounds} rounds")
    return reduce(DataFrame.union, kept) if kept else edges.select("a", "b", "dist")


def spanning_forest(df: DataFrame, min_cos: float = 0.5, min_samples: int = 5, params: IndexParams | None = None, exact: bool = True) -> DataFrame:
    """(a, b, dist, tree): minimum spanning forest of the mutual-reachability graph up to the cut.

    ``tree`` is the smallest id of the tree that an edge is in. Copies of a vector that the index
    leaves out hang on the first of them. Without ``exact`` a tree that two families hold may come
    out with the edges of both, which is enough to tell trees apart.
    """
    p = params or IndexParams()
    # where density counts for nothing, one copy of a vector ties as much as all of them
    files, extra = build(df.select("row_id", "embedding"), p, min_cos, copies=1 if min_samples == 1 else max(6, min_samples + 1))
    if min_samples > 1:
        files = materialize(files, "files")
    f = materialize(forests(files, min_cos, min_samples, p), "forest")
    comp = _tree_ties(f, exact)
    e = f.filter("parent is not null").join(comp, "local", "left").select(F.col("row_id").alias("a"), F.col("parent").alias("b"), "dist", "component", "local")
    final = e.filter("component is null").select("a", "b", "dist", F.col("local").alias("tree"))
    tied = e.filter("component is not null")
    of = tied.select(F.explode(F.array("a", "b")).alias("a"), F.col("component").alias("tree")).distinct()
    out = final.unionByName(boruvka(tied).join(of, "a").select("a", "b", "dist", "tree"))
    if extra is not None and min_cos < 1:
        trees = out.select(F.explode(F.array("a", "b")).alias("b"), "tree").distinct()
        hung = extra.select(F.col("row_id").alias("a"), F.col("first")[0].alias("b"), F.lit(0.0).alias("dist")).join(trees, "b", "left")
        out = out.unionByName(hung.select("a", "b", "dist", F.coalesce("tree", "b").alias("tree")))
    return out


SHORTEST = 0.01  # shorter edges count as this long, so that copies have a finite density


def condense(n: int, a: np.ndarray, b: np.ndarray, dist: np.ndarray, longest: float, min_size: int) -> list[tuple[float, float, np.ndarray, np.ndarray]]:
    """Selected clusters of one tree: (distance at birth, stability, members, density at which each leaves).

    Rows 0..n-1; the edges of a spanning tree, in any order. The whole tree is born at ``longest``.
    This is the plain form, top-down over a whole tree; ``fold`` gives the same clusters.
    """
    order = np.lexsort((b, a, dist))
    top, left, right, size = list(range(n)), [-1] * n, [-1] * n, [1] * n
    at, lam = [np.inf] * n, 1.0 / np.maximum(dist[order], SHORTEST)
    node = list(range(n))  # of each root

    def find(v: int) -> int:
        while top[v] != v:
            top[v] = top[top[v]]
            v = top[v]
        return v

    for x, y, w in zip(a[order].tolist(), b[order].tolist(), lam.tolist()):
        rx, ry = find(x), find(y)
        if rx == ry:
            continue
        left.append(node[rx])
        right.append(node[ry])
        size.append(size[node[rx]] + size[node[ry]])
        at.append(w)
        top[ry] = rx
        node[rx] = len(left) - 1
    leave, cluster_of = np.zeros(n), np.zeros(n, dtype=np.int64)
    born, stable, parent = [1.0 / max(longest, SHORTEST)], [0.0], [-1]
    todo = [(len(left) - 1, 0, 0.0)]  # a node, its cluster, the density at which it is shed (0: it stays)
    while todo:
        v, c, shed = todo.pop()
        if v < n:
            leave[v], cluster_of[v] = shed or born[c], c
            stable[c] += leave[v] - born[c]
            continue
        kids = (left[v], right[v])
        if shed:
            todo += [(k, c, shed) for k in kids]
            continue
        big = [k for k in kids if size[k] >= min_size]
        if len(big) == 2:
            stable[c] += (at[v] - born[c]) * size[v]
            for k in kids:
                born.append(at[v])
                stable.append(0.0)
                parent.append(c)
                todo.append((k, len(born) - 1, 0.0))
        else:
            todo += [(k, c, 0.0 if k in big else at[v]) for k in kids]
    best, own, kids = stable[:], [True] * len(born), [0.0] * len(born)
    for c in range(len(born) - 1, -1, -1):  # children have higher numbers
        own[c] = stable[c] >= kids[c]
        best[c] = max(stable[c], kids[c])
        if parent[c] >= 0:
            kids[parent[c]] += best[c]
    chosen = list(range(len(born)))  # the first selected cluster on the way down
    for c in range(len(born)):
        up = chosen[parent[c]] if parent[c] >= 0 else -1
        chosen[c] = up if up >= 0 else (c if own[c] else -1)
    of = np.array(chosen)[cluster_of]
    return [(1.0 / born[c], stable[c], np.flatnonzero(of == c), leave[of == c]) for c in np.unique(of[of >= 0])] if n >= min_size else []


FOLDED = "kind int, tree long, node long, holder long, covered boolean, size long, trunk double, kids double, neg array<double>, ids array<long>, level double"
STATE, MOVED, CLUSTER = 0, 1, 2


def fold(tree: int, ends: tuple[np.ndarray, np.ndarray], order: np.ndarray, dist: np.ndarray, known: dict[int, tuple], longest: float | None, min_size: int, exemplars: int) -> list[tuple]:
    """Rows of FOLDED: what a run of edges makes of its components.

    ``ends`` are names (smallest ids) of components; those that are not ``known`` are single rows. ``trunk``
    sums the densities at which rows leave a component, ``kids`` the stabilities selected below it, and
    ``neg`` and ``ids`` are its typical rows by negative density. With ``longest`` the run is the
    tree's last, and its root is a cluster born at that distance.

    CLUSTER rows are selected unless a later run makes their ``holder`` part of a selected cluster; MOVED rows
    tell the new holder of each component, and whether it is covered that way.
    """
    names, at = np.unique(np.concatenate(ends), return_inverse=True)
    names, n = names.tolist(), len(names)
    state = [known.get(v, (1, 0.0, 0.0, [0.0], [v])) for v in names]
    size, trunk, kids = ([x[k] for x in state] for k in range(3))
    typical = [list(zip(x[3], x[4])) for x in state]
    live = [[v] if size[v] >= min_size else [] for v in range(n)]  # what is selected: numbers are components of earlier runs
    least, top = list(range(n)), list(range(n))

    def find(v: int) -> int:
        while top[v] != v:
            top[v] = top[top[v]]
            v = top[v]
        return v

    def value(c: int, lam: float) -> float:
        """The best stability below and at a component that is a cluster born at lam."""
        own = trunk[c] - size[c] * lam
        if own >= kids[c] - 1e-11 * trunk[c]:  # a tie but for rounding
            live[c] = [(names[least[c]], size[c], round(1 - 1 / lam, 9), max(round(own, 6), 0.0), [i for _, i in typical[c]])]
        return max(own, kids[c])

    lam = (1.0 / np.maximum(dist[order], SHORTEST)).tolist()
    for x, y, w in zip(at[: len(order)][order].tolist(), at[len(order) :][order].tolist(), lam):
        x, y = find(x), find(y)
        if x == y:
            continue
        if size[x] < size[y] or (size[x] == size[y] and names[least[x]] > names[least[y]]):
            x, y = y, x
        both = size[x] + size[y]
        if size[y] >= min_size:
            kids[x] = value(x, w) + value(y, w)
            trunk[x] = both * w
        elif both >= min_size:  # what is smaller leaves here
            leaving = [z for z in (x, y) if size[z] < min_size]
            for z in leaving:
                trunk[x] += size[z] * w
                typical[z] = [(-w, i) for _, i in typical[z]]
        typical[x] = sorted(typical[x] + typical[y])[:exemplars]
        if len(live[x]) < len(live[y]):
            live[x], live[y] = live[y], live[x]
        live[x] += live[y]
        live[y], typical[y] = [], []
        size[x], top[y], least[x] = both, x, min(least[x], least[y])
    roots = [v for v in range(n) if top[v] == v]
    if longest is not None:
        for v in roots:
            if size[v] >= min_size:
                value(v, 1.0 / max(longest, SHORTEST))
    uncovered = {x for v in roots for x in live[v] if isinstance(x, int)}
    out = [(MOVED, tree, names[v], names[least[find(v)]], v not in uncovered, 0, 0.0, 0.0, [], [], 0.0) for v in range(n)]
    for v in roots:
        name = names[least[v]]
        out += [(CLUSTER, tree, x[0], name, False, x[1], x[3], 0.0, [], x[4], x[2]) for x in live[v] if not isinstance(x, int)]
        if longest is None:
            out.append((STATE, tree, name, name, False, size[v], trunk[v], kids[v], [d for d, _ in typical[v]], [i for _, i in typical[v]], 0.0))
    return out


def _fold_in_unit(longest: float, min_size: int, exemplars: int):
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.float64())
    names = [c.split()[0] for c in FOLDED.split(", ")]

    def run(t: pa.Table, states: pa.Table | None = None) -> pa.Table:
        if not len(t):
            return pa.table([pa.array([], k) for k in kinds], names=names)
        a, b, ca, cb, dist, tree, last = (t[c].to_numpy() for c in ("a", "b", "ca", "cb", "dist", "tree", "last"))
        known = {} if states is None else {r["node"]: (r["size"], r["trunk"], r["kids"], r["neg"], r["ids"]) for r in states.to_pylist()}
        rows: list[tuple] = []
        for at in slices(tree):
            order = np.lexsort((b[at], a[at], dist[at]))
            rows += fold(int(tree[at[0]]), (ca[at], cb[at]), order, dist[at], known, longest if last[at[0]] else None, min_size, exemplars)
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], names=names)

    return run


def cluster(df: DataFrame, min_cos: float = 0.5, min_samples: int = 5, min_size: int = 5, exemplars: int = 3, task_rows: int = 1_000_000, params: IndexParams | None = None) -> DataFrame:
    """(cluster_id, size, level, stability, exemplars): clusters selected for their stability.

    ``level`` is the cosine at which a cluster is born. ``exemplars`` are the members that stay
    longest, ties by id. ``task_rows`` bounds the edges that a task folds and changes no result.
    Empty input and input without dense groups give no rows.
    """
    return condensed(spanning_forest(df, min_cos, min_samples, params), min_cos, min_size, exemplars, task_rows)


def condensed(forest: DataFrame, min_cos: float, min_size: int, exemplars: int, task_rows: int) -> DataFrame:
    """The clusters of the trees of a forest (a, b, dist, tree)."""
    if min_size < 2:
        raise ValueError("a cluster has two rows at least")
    mst = materialize(forest, "mst")
    sizes = materialize(mst.groupBy("tree").agg(F.count("*").alias("n")), "trees")
    total, largest = sizes.agg(F.sum("n"), F.max("n")).first()
    units = max(1, -(-(total or 0) // max(1, min(task_rows, 50_000))))
    runs = -(-(largest or 0) // task_rows)
    edges = mst.select("tree", "a", "b", "dist", F.col("a").alias("ca"), F.col("b").alias("cb"))
    if runs > 1:  # edges are numbered over tasks, not in one
        edges = global_rank(edges, ["tree", "dist", "a", "b"], "rank")
        first = edges.groupBy("tree").agg(F.min("rank").alias("first"), F.count("*").alias("n"))
        edges = edges.join(first, "tree").withColumn("run", F.floor((F.col("rank") - F.col("first")) / task_rows)).withColumn("last", F.col("run") == F.floor((F.col("n") - 1) / task_rows))
        edges = materialize(edges.drop("rank", "first", "n"), "runs")
    else:
        edges = edges.withColumn("run", F.lit(0).cast("long")).withColumn("last", F.lit(True))
    step = _fold_in_unit(1.0 - min_cos, min_size, exemplars)
    now = edges.filter("run = 0").groupBy(F.pmod(F.xxhash64("tree"), F.lit(units)).alias("unit")).applyInArrow(lambda t: step(t), FOLDED)
    if runs <= 1:
        return _clusters(now)
    now = materialize(now, "folded")
    states, found = now.filter(F.col("kind") == STATE), now.filter(F.col("kind") == CLUSTER)
    for n in range(1, runs):
        moved = now.filter(F.col("kind") == MOVED).select("node", "holder", "covered")
        edges = edges.filter(F.col("run") >= n)
        for side in ("ca", "cb"):
            edges = edges.join(moved.select(F.col("node").alias(side), F.col("holder").alias("to")), side, "left").withColumn(side, F.coalesce("to", side)).drop("to")
        edges = materialize(edges, "runs")
        run = edges.filter(F.col("run") == n)
        met = run.select(F.explode(F.array("ca", "cb")).alias("node")).distinct()
        now = materialize(run.groupBy("tree").cogroup(states.join(met, "node", "left_semi").select("tree", "node", "size", "trunk", "kids", "neg", "ids").groupBy("tree")).applyInArrow(lambda t, u: step(t, u), FOLDED), "folded")
        states = materialize(states.join(met, "node", "left_anti").unionByName(now.filter(F.col("kind") == STATE)), "states")
        moved = now.filter(F.col("kind") == MOVED).select(F.col("node").alias("holder"), F.col("holder").alias("to"), F.col("covered").alias("gone"))
        held = found.join(moved, "holder", "left").filter(~F.coalesce("gone", F.lit(False))).withColumn("holder", F.coalesce("to", "holder")).drop("to", "gone")
        found = materialize(held.unionByName(now.filter(F.col("kind") == CLUSTER)), "found")
    return _clusters(found)


def _clusters(folded: DataFrame) -> DataFrame:
    return folded.filter(F.col("kind") == CLUSTER).select(F.col("node").alias("cluster_id"), "size", "level", F.col("trunk").alias("stability"), F.col("ids").alias("exemplars"))

"""Vectors of any length: products, centroids, neighbours, similar pairs, density clusters, assignment.

Similar pairs are exact. Rows are cut into blocks, blocks meet pairwise, and a task multiplies two
of them as matrices; for tables that this square outgrows there is the permutation index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.operators.graph import connected_components
from framelake.session import materialize


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null for a zero vector."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def normalized(a: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def centroids(df: DataFrame, group: str, vec: str) -> DataFrame:
    """(group, centroid, member_count): the normalized mean of each group's normalized vectors."""
    e = df.filter(F.col(vec).isNotNull()).select(group, F.posexplode(normalized(F.col(vec))).alias("p", "x"))
    mean = e.groupBy(group, "p").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    packed = mean.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda s: s["x"]).alias("c"), F.max("n").alias("member_count"))
    return packed.select(group, normalized(F.col("c")).alias("centroid"), "member_count")


def nearest(df: DataFrame, cents: DataFrame, id_col: str, vec: str, group: str, max_centroids: int = 10_000) -> DataFrame:
    """(id, group, distance): the nearest centroid by 1 - cosine, of equals the smallest group.

    Centroids are a dimension table; beyond ``max_centroids`` rows the call is refused rather than
    broadcast. Rows are multiplied with all of them a batch at a time. Null vectors and vectors of
    another length are left out; a zero vector is at distance 1 from all.
    """
    got = cents.select(group, normalized(F.col("centroid")).alias("c")).orderBy(group).limit(max_centroids + 1).toPandas()
    if len(got) > max_centroids:
        raise ValueError(f"more than {max_centroids} centroids")
    spark, kind = df.sparkSession, df.schema[id_col].dataType.simpleString()
    names = spark.createDataFrame([(k, g.item() if hasattr(g, "item") else g) for k, g in enumerate(got[group])], f"_at int, {group} {cents.schema[group].dataType.simpleString()}")
    table = spark.sparkContext.broadcast(np.stack(got["c"].to_list()) if len(got) else np.zeros((0, 0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = table.value
        for b in batches:
            if not b.num_rows or not len(c):
                continue
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
            n = np.sqrt((x * x).sum(axis=1, keepdims=True))
            d = np.round(1.0 - (x / np.where(n > 0, n, 1.0)) @ c.T, 12)
            at = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at.astype(np.int32)), pa.array(d[np.arange(len(at)), at])], names=[id_col, "_at", "distance"])

    width = table.value.shape[1]
    ok = df.filter(F.col(vec).isNotNull() & (F.size(vec) == width)).select(id_col, vec)
    return ok.mapInArrow(run, f"{id_col} {kind}, _at int, distance double").join(F.broadcast(names), "_at").select(id_col, group, "distance")


def _pairs_in_blocks(floor: float, inclusive: bool):
    def run(t: pa.Table) -> pa.Table:
        ids, blk = t["id"].to_numpy(), t["blk"].to_numpy()
        x = np.array(t["v"].to_pylist(), dtype=np.float64)
        x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
        lo, hi = blk.min(), blk.max()
        # a block pair holds cross pairs; rows of one block meet in the unit of that block alone
        same = t["own"][0].as_py()
        left, right = (np.arange(len(ids)),) * 2 if same else (np.flatnonzero(blk == lo), np.flatnonzero(blk == hi))
        out = []
        for s in range(0, len(left), 1024):
            sim = np.round(x[left[s : s + 1024]] @ x[right].T, 12)
            i, j = np.nonzero(sim >= floor if inclusive else sim > floor)
            a, b = ids[left[i + s]], ids[right[j]]
            m = a < b if same else a != b
            out.append((np.minimum(a, b)[m], np.maximum(a, b)[m], sim[i, j][m]))
        a, b, c = (np.concatenate([o[k] for o in out]) for k in range(3))
        return pa.table({"a": a.astype(np.int64), "b": b.astype(np.int64), "cos": c.astype(np.float64)})

    return run


def similar_pairs(df: DataFrame, id_col: str, vec: str, floor: float, inclusive: bool = False, block_rows: int = 2048) -> DataFrame:
    """(a, b, cos), a < b: pairs of a cosine above ``floor`` (or at it, where inclusive). Exact.

    Null, empty and zero vectors have no pairs; all vectors must be of one length.
    """
    ok = df.filter(F.coalesce(F.size(vec), F.lit(0)) > 0).filter(norm(F.col(vec)) > 0)
    src = ok.select(F.col(id_col).cast("long").alias("id"), F.col(vec).alias("v"))
    nb = max(1, -(-src.count() // block_rows))
    src = src.withColumn("blk", F.pmod(F.xxhash64("id"), F.lit(nb)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(nb - 1))))
    src = src.withColumn("own", F.col("blk") == F.col("other")).withColumn("unit", F.least("blk", "other") * nb + F.greatest("blk", "other"))
    return src.groupBy("unit").applyInArrow(_pairs_in_blocks(floor, inclusive), "a long, b long, cos double")


def similarity_groups(rows: DataFrame, pairs: DataFrame, id_col: str) -> DataFrame:
    """(id, group_id, size): components of at least two rows, numbered from 1 by their smallest id; null for the rest."""
    comp = connected_components(pairs, "a", "b")
    heads = comp.filter("node = component").select("component")
    from framelake.operators.selection import global_rank

    numbered = global_rank(heads, ["component"], "group_id")
    sized = comp.groupBy("component").agg(F.count("*").alias("size"))
    lab = comp.join(numbered, "component").join(sized, "component").select(F.col("node").alias(id_col), "group_id", "size")
    return rows.select(id_col).join(lab, id_col, "left")


def representatives(rows: DataFrame, groups: DataFrame, id_col: str, score: str, fallback: str) -> DataFrame:
    """``is_representative``: the best scored row of a group, else its largest; rows without a group represent themselves."""
    j = rows.join(groups, id_col)
    best = j.filter("group_id is not null").groupBy("group_id").agg(F.max(F.struct(F.coalesce(F.col(score).cast("double"), F.lit(float("-inf"))).alias("s"), F.when(F.col(score).isNull(), F.col(fallback)).alias("f"), (-F.col(id_col)).alias("n"))).alias("b"))
    j = j.join(best.select("group_id", (-F.col("b.n")).alias("_rep")), "group_id", "left")
    return j.withColumn("is_representative", F.col("group_id").isNull() | (F.col("_rep") == F.col(id_col))).drop("_rep")


def dbscan(rows: DataFrame, pairs: DataFrame, id_col: str, min_samples: int) -> DataFrame:
    """(id, cluster): density clusters over neighbour pairs, -1 for noise; numbered from 0 by their smallest core.

    A row counts itself as a neighbour. A row at the border of several clusters goes to the first.
    """
    sym = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    deg = sym.groupBy("a").agg((F.count("*") + 1).alias("n"))
    core = materialize(deg.filter(F.col("n") >= min_samples).select(F.col("a").alias("c")), "core") if min_samples > 1 else rows.select(F.col(id_col).alias("c"))
    near = sym.join(core, sym["b"] == core["c"]).select("a", "b")
    links = near.join(core.withColumnRenamed("c", "a"), "a", "left_semi")
    comp = connected_components(links, "a", "b")
    lab = core.join(comp, core["c"] == comp["node"], "left").select("c", F.coalesce("component", "c").alias("k"))
    from framelake.operators.selection import global_rank

    num = global_rank(lab.select("k").distinct(), ["k"], "cluster").withColumn("cluster", F.col("cluster") - 1)
    lab = materialize(lab.join(num, "k").select("c", "cluster"), "cores")
    border = near.join(core.withColumnRenamed("c", "a"), "a", "left_anti").join(lab.withColumnRenamed("c", "b"), "b").groupBy("a").agg(F.min("cluster").alias("cluster"))
    both = lab.unionByName(border.withColumnRenamed("a", "c"))
    return rows.select(F.col(id_col)).join(both.withColumnRenamed("c", id_col), id_col, "left").fillna(-1, ["cluster"])


def least_cost(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of least total cost; one for each of the shorter side. Potentials and shortest augmenting paths."""
    flip = cost.shape[0] > cost.shape[1]
    c = cost.T if flip else cost
    n, m = c.shape
    u, v, owner = np.zeros(n), np.zeros(m), np.full(m, -1)
    for i in range(n):
        far, seen, back = np.full(m, np.inf), np.zeros(m, dtype=bool), np.full(m, -1)
        row, col, base = i, -1, 0.0
        rows_in, cols_in = [(i, 0.0)], []
        while True:
            slack = base + c[row] - u[row] - v
            closer = ~seen & (slack < far)
            far[closer], back[closer] = slack[closer], col
            col = int(np.where(seen, np.inf, far).argmin())
            base = far[col]
            seen[col] = True
            if owner[col] < 0:
                break
            cols_in.append((col, base))
            row = owner[col]
            rows_in.append((row, base))
        for r, d in rows_in:
            u[r] += base - d
        for k, d in cols_in:
            v[k] -= base - d
        while col >= 0:
            prev = back[col]
            owner[col] = i if prev < 0 else owner[prev]
            col = prev
    pairs = [(int(owner[k]), k) for k in range(m) if owner[k] >= 0]
    return sorted((b, a) for a, b in pairs) if flip else sorted(pairs)


def assign(found: DataFrame, known: DataFrame, found_id: str, known_id: str, limit: float, inclusive: bool = False, max_side: int = 2000) -> DataFrame:
    """(found_id, known_id, distance): one-to-one matches of centroids of least total distance, within ``limit``.

    Both sides are clusters and identities, not rows; more than ``max_side`` of either are refused.
    """
    a, b = (d.select(F.col(i).alias("i"), normalized(F.col("centroid")).alias("c")).orderBy("i").limit(max_side + 1).toPandas() for d, i in ((found, found_id), (known, known_id)))
    if max(len(a), len(b)) > max_side:
        raise ValueError(f"more than {max_side} centroids to assign")
    rows = []
    if len(a) and len(b):
        cost = 1.0 - np.stack(a["c"].to_list()) @ np.stack(b["c"].to_list()).T
        plain = lambda v: v.item() if hasattr(v, "item") else v
        rows = [(plain(a["i"][i]), plain(b["i"][j]), float(cost[i, j])) for i, j in least_cost(cost) if (cost[i, j] <= limit if inclusive else cost[i, j] < limit)]
    kinds = [d.schema[i].dataType.simpleString() for d, i in ((found, found_id), (known, known_id))]
    return found.sparkSession.createDataFrame(rows, f"{found_id} {kinds[0]}, {known_id} {kinds[1]}, distance double")


def placeholder_names(taken: set[str], n: int, prefix: str = "person") -> list[str]:
    """The next n free names prefixA .. prefixZ, prefixAA .."""
    out, k = [], 0
    while len(out) < n:
        k += 1
        letters, r = "", k
        while r:
            r, d = divmod(r - 1, 26)
            letters = chr(65 + d) + letters
        if f"{prefix}{letters}" not in taken:
            out.append(f"{prefix}{letters}")
    return out


def resolve_identities(index: DataFrame, clusters: DataFrame, limit: float = 0.5) -> DataFrame:
    """The identity index after a run: matched rows get the new centroid and count, the rest of the clusters new names."""
    m = assign(clusters, index, "cluster", "name", limit)
    taken = {r["name"] for r in index.select("name").collect()}
    fresh = clusters.join(m, "cluster", "left_anti").orderBy("cluster").select("cluster").collect()
    named = index.sparkSession.createDataFrame([(r["cluster"], n) for r, n in zip(fresh, placeholder_names(taken, len(fresh)))], f"cluster {clusters.schema['cluster'].dataType.simpleString()}, name string")
    new = clusters.join(m.select("cluster", "name").unionByName(named), "cluster").select("name", F.col("centroid").alias("c"), F.col("member_count").alias("n"))
    return index.join(new, "name", "full").select("name", F.coalesce("display_name", "name").alias("display_name"), F.coalesce("c", "centroid").alias("centroid"), F.coalesce("n", "member_count").alias("member_count"))


def embed(images: DataFrame, id_col: str, content: str, model, schema: str = "embedding array<float>") -> DataFrame:
    """Batches of contents through a model: ``model(list of bytes)`` gives a list of rows of ``schema``."""
    kind = images.schema[id_col].dataType.simpleString()
    names = [p.strip().split(" ")[0] for p in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = pd.DataFrame(model(b[content].to_list()), columns=names)
            yield pd.concat([b[[id_col]].reset_index(drop=True), got], axis=1)

    return images.select(id_col, content).mapInPandas(run, f"{id_col} {kind}, {schema}")



"""Most similar vectors for every vector (problem 3), on the permutation index."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.permutation import IndexParams, blocked, build, slices
from framelake.llm.vectors import exact_cos, unit, unpack


def _top_in_unit(k: int, floor: float, dim: int):
    def run(t: pa.Table) -> pa.Table:
        ids, fam = (t[c].to_numpy() for c in ("row_id", "family"))
        raw = unpack(t["packed"], dim)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        u64 = unit(raw)
        u32 = u64.astype(np.float32)
        for at in slices(fam):
            if len(at) < 2:
                continue
            at = at[np.argsort(ids[at], kind="stable")]
            x = u32[at]
            for s in range(0, len(at), 1024):
                sim = x[s : s + 1024] @ x.T
                own = np.arange(len(sim))
                sim[own, own + s] = -2.0
                # everything that rounding could lift to the k-th place or tie with it
                kth = np.partition(sim, len(at) - k, axis=1)[:, len(at) - k] if len(at) > k else np.full(len(sim), -1.0)
                bar = np.maximum(kth - 1e-5, floor - 1e-5)
                i, j = np.nonzero(sim >= bar[:, None])
                if not len(i):
                    continue
                c = exact_cos(u64[at[s + i]], u64[at[j]])
                m = c > floor
                i, j, c = i[m], j[m], c[m]
                o = np.lexsort((ids[at[j]], -c, i))
                i, j, c = i[o], j[o], c[o]
                new = np.r_[True, i[1:] != i[:-1]] if len(i) else np.zeros(0, dtype=bool)
                rank = np.arange(len(i)) - np.maximum.accumulate(np.where(new, np.arange(len(i)), 0)) if len(i) else np.zeros(0, dtype=int)
                m = rank < k
                out.append((ids[at[s + i[m]]], ids[at[j[m]]], c[m]))
        a, b, c = (np.concatenate([o[n] for o in out]) for n in range(3)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"row_id": a, "other": b, "cos": c}, schema=pa.schema([("row_id", pa.int64()), ("other", pa.int64()), ("cos", pa.float64())]))

    return run


def knn(df: DataFrame, k: int = 5, floor: float = 0.5, params: IndexParams | None = None) -> DataFrame:
    """(row_id, other, cos, rank): up to k most similar usable rows of each usable row.

    Ties in the cosine go to the smaller id; neighbours at or below ``floor`` are left out.
    Null, short, non-finite and all-zero vectors neither ask nor answer; an empty table gives
    an empty result. Repeated ids are not expected. Further columns are not read. Exact copies of a
    vector beyond its k + 1 smallest ids are answered without being compared.
    """
    p = params or IndexParams()
    files, extra = build(df.select("row_id", "embedding"), p, floor, copies=k + 1)
    near = top_k(files, k, floor, p)
    if extra is None or floor >= 1:
        return near
    # a copy beyond the k + 1 of the smallest ids has the first k of these for neighbours
    more = extra.select("row_id", F.posexplode(F.slice("first", 1, k)).alias("pos", "other"))
    return near.unionByName(more.select("row_id", "other", F.lit(1.0).alias("cos"), (F.col("pos") + 1).alias("rank")))


def top_k(files: DataFrame, k: int, floor: float, p: IndexParams) -> DataFrame:
    cut = blocked(files, "family", 2 * p.block_rows)
    per = cut.groupBy("unit").applyInArrow(_top_in_unit(k, floor, p.dim), "row_id long, other long, cos double")
    best = per.groupBy("row_id").agg(F.slice(F.array_sort(F.collect_set(F.struct((-F.col("cos")).alias("neg"), F.col("other").alias("other")))), 1, k).alias("best"))
    return best.select("row_id", F.posexplode("best").alias("pos", "b")).select("row_id", F.col("b.other").alias("other"), (-F.col("b.neg")).alias("cos"), (F.col("pos") + 1).alias("rank"))


def similar_pairs(df: DataFrame, k: int = 5, floor: float = 0.5, params: IndexParams | None = None) -> DataFrame:
    """Distinct unordered pairs (row_id_1 < row_id_2) of knn()."""
    nn = knn(df, k, floor, params)
    return nn.select(F.least("row_id", "other").alias("row_id_1"), F.greatest("row_id", "other").alias("row_id_2")).distinct()

"""Removal of repeats: by content, by spacing in time, by distance of hashes."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.session import materialize


def canonical(df: DataFrame, digest: str, path: str, known: DataFrame | None = None) -> DataFrame:
    """``canonical_path`` and ``is_duplicate``: the known path of the content, else the least of the new ones.

    ``known`` has (digest, canonical_path, rank); its first row of a digest counts. Rows without a
    digest are canonical for themselves.
    """
    # a grouped minimum is combined before the shuffle; a hot digest costs no more than others
    least = df.filter(F.col(digest).isNotNull()).groupBy(digest).agg(F.min(path).alias("_own"))
    d = df.join(least, digest, "left").withColumn("_own", F.coalesce("_own", path))
    if known is not None:
        first = known.withColumn("_rn", F.row_number().over(Window.partitionBy(digest).orderBy("rank"))).filter("_rn = 1").select(digest, F.col("canonical_path").alias("_known"))
        d = d.join(first, digest, "left")
    else:
        d = d.withColumn("_known", F.lit(None).cast("string"))
    d = d.withColumn("canonical_path", F.coalesce("_known", "_own"))
    return d.withColumn("is_duplicate", F.col(path) != F.col("canonical_path")).drop("_own", "_known")


def greedy_spacing(df: DataFrame, group: list[str], ts: Column, tie: str, gap: float) -> DataFrame:
    """Rows kept if at least ``gap`` after the last kept row of their group, in order of time.

    A row that comes ``gap`` after the row before it is kept whatever came before, so a group falls
    into chains at such rows, and each chain is folded by itself over (time, tie) pairs. Rows
    without a time are left out.
    """
    w = Window.partitionBy(*group).orderBy("_t", tie)
    rows = df.select(*group, ts.cast("double").alias("_t"), F.col(tie)).filter("_t is not null")
    fresh = F.coalesce((F.col("_t") - F.lag("_t").over(w) >= gap).cast("int"), F.lit(1))
    rows = rows.withColumn("_new", fresh).withColumn("_chain", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    packed = rows.groupBy(*group, "_chain").agg(F.array_sort(F.collect_list(F.struct(F.col("_t").alias("t"), F.col(tie).alias("k")))).alias("_e"))
    start = F.struct(F.lit(None).cast("double").alias("last"), F.array().cast(f"array<{df.schema[tie].dataType.simpleString()}>").alias("kept"))

    def step(s: Column, e: Column) -> Column:
        keep = s["last"].isNull() | (e["t"] - s["last"] >= gap)
        return F.struct(F.when(keep, e["t"]).otherwise(s["last"]).alias("last"), F.when(keep, F.concat(s["kept"], F.array(e["k"]))).otherwise(s["kept"]).alias("kept"))

    kept = packed.select(F.explode(F.aggregate("_e", start, step)["kept"]).alias(tie))
    return df.join(kept, tie, "left_semi")


def similarity_hash(text: str, n: int = 8) -> int:
    """64 bits of all runs of n characters of a text; texts that share most runs share most bits."""
    c = np.concatenate([np.zeros(n - 1, np.uint32), np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), np.zeros(n - 1, np.uint32)]).astype(np.uint64)
    size, ones = len(c) - n + 1, np.zeros(64, np.int64)
    for lo in range(0, size, 1 << 14):
        hi = min(size, lo + (1 << 14))
        h = np.zeros(hi - lo, np.uint64)
        for k in range(n):
            h = (h + c[lo + k : hi + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(27)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > size).view(np.int64)[0])


def similarity_code(text: Column) -> Column:
    """``similarity_hash`` of a text column; null texts have none."""

    def run(t: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else similarity_hash(x) for x in t], dtype="Int64")

    return F.pandas_udf(run, "long")(text)


def _bands(c: Column, n: int) -> list[Column]:
    """n bands of 64 bits, the last takes what is left."""
    width = 64 // n
    mask = [(1 << (width if k < n - 1 else 64 - width * (n - 1))) - 1 for k in range(n)]
    return [F.shiftrightunsigned(c, k * width).bitwiseAND(F.lit(m if m < 1 << 63 else -1)) for k, m in enumerate(mask)]


def _flips(width: int, most: int) -> list[int]:
    """All masks of at most so many of the lowest bits."""
    return [sum(1 << i for i in at) for k in range(most + 1) for at in combinations(range(width), k)]


def hamming_edges(df: DataFrame, id_col: str, hash_col: str, radius: int, group: list[str] | None = None, probe_from: int = 50_000) -> DataFrame:
    """(a, b), a < b: rows of distinct hashes within ``radius`` bits.

    Of ``radius + 1`` bands one is without a difference, so few hashes are joined on equal bands. From
    ``probe_from`` hashes on bands of so few bits hold too many rows each; then there are three
    wide bands, one of which differs in a third of the bits at most, and each hash is looked for under
    all values of a band that are so near. Either way a pair is kept at its first band. Equal
    hashes are represented by their smallest id, so copies cost a row each; null hashes have no edges.
    """
    keys = group or []
    reps = df.filter(F.col(hash_col).isNotNull()).groupBy(*keys, hash_col).agg(F.min(id_col).alias("rep"))
    wide = radius >= 3 and reps.count() >= probe_from
    n, flips = (3, radius // 3) if wide else (radius + 1, 0)
    of = lambda h: _bands(h, n)
    e = reps.select(*keys, F.col(hash_col).alias("h"), "rep", F.posexplode(F.array(*of(F.col(hash_col)))).alias("band", "bits"))
    probes = e
    if flips:
        near = F.explode(F.array(*[F.lit(m).cast("long") for m in _flips(64 // n, flips)]))
        last = F.explode(F.array(*[F.lit(m).cast("long") for m in _flips(64 - 64 // n * (n - 1), flips)]))
        parts = [e.filter(F.col("band") < n - 1).withColumn("flip", near), e.filter(F.col("band") == n - 1).withColumn("flip", last)]
        probes = parts[0].unionByName(parts[1]).withColumn("bits", F.col("bits").bitwiseXOR(F.col("flip"))).drop("flip")
    j = probes.alias("x").join(e.alias("y"), [*keys, "band", "bits"]).filter("x.rep < y.rep")
    diff = F.col("x.h").bitwiseXOR(F.col("y.h"))
    first = F.coalesce(*[F.when(F.bit_count(b) <= flips, F.lit(k)) for k, b in enumerate(of(diff))])
    return j.filter((F.bit_count(diff) <= radius) & (F.col("band") == first)).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))


def greedy_hamming(df: DataFrame, id_col: str, hash_col: str, score: str, radius: int = 8, group: list[str] | None = None) -> DataFrame:
    """Rows kept if no kept row of a higher score (of equals, a smaller id) is within ``radius`` bits.

    Rows without a hash are kept and compared with nothing. What a row's fate depends on are rows
    before it, so rounds settle it: a row all of whose earlier neighbours are dropped is kept, and
    what is near a kept row and after it is dropped. Of equal hashes only the first can be kept.
    """
    keys = group or []
    rank = F.struct((-F.coalesce(F.col(score).cast("double"), F.lit(float("-inf")))).alias("s"), F.col(id_col).alias("i"))
    first = df.filter(F.col(hash_col).isNotNull()).groupBy(*keys, hash_col).agg(F.min(rank).alias("o")).select(*keys, hash_col, F.col("o.i").alias(id_col), "o")
    first = materialize(first, "first")
    pos = first.select(F.col(id_col).alias("n"), "o")
    e = hamming_edges(first, id_col, hash_col, radius, keys)
    e = e.join(pos.select(F.col("n").alias("a"), F.col("o").alias("oa")), "a").join(pos.select(F.col("n").alias("b"), F.col("o").alias("ob")), "b")
    before = F.col("oa") < F.col("ob")
    open_ = materialize(e.select(F.when(before, F.col("a")).otherwise(F.col("b")).alias("early"), F.when(before, F.col("b")).otherwise(F.col("a")).alias("late")), "edges")
    kept = first.select(id_col)
    while not open_.isEmpty():
        safe = open_.select("early").distinct().join(open_.select(F.col("late").alias("early")).distinct(), "early", "left_anti")
        gone = materialize(open_.join(safe, "early", "left_semi").select(F.col("late").alias("n")).distinct(), "gone")
        kept = kept.join(gone.withColumnRenamed("n", id_col), id_col, "left_anti")
        for side in ("early", "late"):
            open_ = open_.join(gone.withColumnRenamed("n", side), side, "left_anti")
        open_ = materialize(open_, "edges")
    return df.filter(F.col(hash_col).isNull()).unionByName(df.join(kept, id_col, "left_semi"))

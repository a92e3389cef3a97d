"""Deterministic sampling: by hash of the key, never by position or partition."""

from __future__ import annotations

import random
from array import array

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stratified(df: DataFrame, group: list[str], key: str, k: int, seed: int = 42) -> DataFrame:
    """At most k rows of each group, those of the smallest seeded hashes of the key."""
    w = Window.partitionBy(*group).orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string"))), key)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")


def sample_n(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows in seeded hash order; all rows if there are fewer."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string"))), key).limit(n)


def uniform_targets(df: DataFrame, duration: str, fps: float, block: int = 4096) -> DataFrame:
    """``target_index`` and ``target_s`` of max(1, int(duration * fps)) moments; unread and infinite durations have none.

    Files are cut into blocks of moments that are spread over tasks, so one very long file is not one task.
    """
    d = F.col(duration)
    n = F.greatest(F.lit(1), F.floor(d * fps).cast("long"))
    t = df.filter(F.abs(d) < float("inf")).withColumn("_n", n).withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(block).cast("long"))))
    t = t.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_from", duration)
    t = t.withColumn("target_index", F.explode(F.sequence("_from", F.least(F.col("_from") + block, "_n") - 1))).drop("_n", "_from")
    return t.withColumn("target_s", F.col("target_index") / fps)


def windowed_targets(df: DataFrame, key: str, windows: str, fps: float) -> DataFrame:
    """Moments in windows of a second, numbered through the file."""
    per = max(1, int(fps))
    e = df.select(key, F.posexplode(windows).alias("w", "start")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(per - 1))))
    return e.select(key, (F.col("w") * per + F.col("j")).alias("target_index"), (F.col("start") + F.col("j") / fps).alias("target_s"))


def sample_windows(duration: float | None, seed: int, count: int, spacing: int) -> list[int]:
    """Starts of windows, in a seeded order taken if at least ``spacing`` from all taken; sorted."""
    if duration is None or not 2 <= duration < float("inf"):
        return []
    starts = array("q", range(int(duration) - 1))  # 8 bytes a second, for files of months
    random.Random(seed).shuffle(starts)
    taken: list[int] = []
    for s in starts:
        if len(taken) >= count:
            break
        if all(abs(s - t) >= spacing for t in taken):
            taken.append(s)
    return sorted(taken)


def with_sample_windows(df: DataFrame, digest: str, duration: str, count: int = 20, spacing: int = 5, name: str = "windows") -> DataFrame:
    def run(h: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([sample_windows(None if pd.isna(b) else b, int(a[:8], 16), count, spacing) for a, b in zip(h, d)])

    return df.withColumn(name, F.pandas_udf(run, "array<int>")(F.col(digest), F.col(duration)))


def split_by_source(df: DataFrame, source: str, share: float = 0.8, seed: int = 42) -> DataFrame:
    """``is_train`` by hash of the source, so that all rows of a source are on one side."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col(source))), 1, 7), 16, 10).cast("long")
    return df.withColumn("is_train", h < F.lit(int(share * 16**7)))


def rotations(df: DataFrame) -> DataFrame:
    return df.withColumn("quarter_turns", F.explode(F.array(*[F.lit(k) for k in range(4)])))


def frozen_split(flag: Column) -> Column:
    """Evaluation only where the stored flag says so; a missing flag is training."""
    return F.coalesce(flag, F.lit(False))


def weighted_draws(df: DataFrame, key: str, weight: str, n: int, seed: int = 42) -> DataFrame:
    """n draws with replacement, each row in proportion to its weight: (draw, key).

    Draw d falls on u = (d + hash) / n of the running weight; ranges of the running weight are joined
    on cells, so no row list is collected.
    """
    total = df.agg(F.sum(weight).alias("t"), F.count("*").alias("c")).first()
    if not total["t"]:
        return df.select(F.lit(0).alias("draw"), key).limit(0)
    parts = df.groupBy(F.pmod(F.xxhash64(key), F.lit(256)).alias("_b")).agg(F.sum(weight).alias("_w"))
    before = parts.withColumn("_s", F.sum("_w").over(Window.orderBy("_b")) - F.col("_w")).select("_b", "_s")
    own = df.select(key, F.col(weight).alias("_w"), F.pmod(F.xxhash64(key), F.lit(256)).alias("_b")).join(F.broadcast(before), "_b")
    run = F.sum("_w").over(Window.partitionBy("_b").orderBy(key)) + F.col("_s")
    own = own.withColumn("_hi", run).withColumn("_lo", F.col("_hi") - F.col("_w"))
    rng = np.random.default_rng(seed)
    shift = float(rng.random())
    step = float(total["t"]) / n
    first, last = F.ceil(F.col("_lo") / step - shift), F.ceil(F.col("_hi") / step - shift) - 1
    return own.filter(last >= first).select(key, F.explode(F.sequence(first, last)).alias("draw")).filter(F.col("draw").between(0, n - 1))


def clear_crops(frames: DataFrame, key: str, width: str, height: str, faces: str, want: int, size: int = 64, tries: int = 10, pad: int = 20, limit: float = 0.10, seed: int = 42) -> DataFrame:
    """(key, x, y): a crop of each sampled frame that no padded face covers by more than ``limit``.

    3 * want frames by hash, up to ``tries`` seeded places each, the first clear one counts.
    """
    picked = sample_n(frames, key, 3 * want, seed)

    def run(k: pd.Series, w: pd.Series, h: pd.Series, f: pd.Series) -> pd.DataFrame:
        out = []
        for kk, ww, hh, ff in zip(k, w, h, f):
            rng, hit = np.random.default_rng([seed, *map(ord, str(kk)[:64])]), (None, None)
            for _ in range(tries if ww > size and hh > size else 0):
                x, y = int(rng.integers(0, ww - size)), int(rng.integers(0, hh - size))
                over = (max(0, min(x + size, b["x2"] + pad) - max(x, b["x1"] - pad)) * max(0, min(y + size, b["y2"] + pad) - max(y, b["y1"] - pad)) for b in (ff if ff is not None else []))
                if all(o <= limit * size * size for o in over):
                    hit = (x, y)
                    break
            out.append(hit)
        return pd.DataFrame(out, columns=["x", "y"]).astype("Int64")

    p = F.pandas_udf(run, "x long, y long")(F.col(key), F.col(width), F.col(height), F.col(faces))
    return picked.select(key, p.alias("p")).select(key, "p.x", "p.y").filter("x is not null").limit(want)

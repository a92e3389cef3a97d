"""Same or near-same records across splits (problem 5), by segmented similarity hashes.

Each record gets a 64-bit similarity hash of the character trigrams of its name. Two codes within
``radius`` bits agree in at least one of ``radius + 1`` segments, so records of the two splits
are joined on (segment number, segment bits). A moment in seconds is part of the record: two
grids of cells twice as wide as the tolerance, shifted by half a cell, are such that close
moments share a cell of at least one grid. The cell is part of the join key, which also breaks
up a hot clip. Pairs are kept at their first shared segment and grid only, so nothing has to be
made distinct, then the Hamming distance, the similarity of the texts and the moment are verified.

Rows that state the same text and moment are one class, which is joined once however many rows it
has; counts are those of classes, and only pairs of rows that are asked for are spelled out.
"""


from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.llm.names import clip_and_second
from framelake.session import materialize


@lru_cache(maxsize=1 << 16)
def _bits(gram: str) -> np.ndarray:
    return np.unpackbits(np.frombuffer(xxhash.xxh64_digest(gram.encode()), dtype=np.uint8)).astype(np.int32) * 2 - 1


@lru_cache(maxsize=1 << 16)
def similarity_hash(text: str) -> int:
    """64 bits; texts that share most trigrams share most bits."""
    t = f"  {text} "
    total = sum(_bits(t[i : i + 3]) for i in range(len(t) - 2))
    return int(np.packbits(total > 0).view(">i8")[0])


def _named_moments(path: pd.Series) -> pd.DataFrame:
    got = [clip_and_second(p) for p in path]
    rows = [(None, None, None) if g is None else (*g, similarity_hash(g[0])) for g in got]
    return pd.DataFrame(rows, columns=["stem", "micros", "code"]).astype({"stem": object, "micros": "Int64", "code": "Int64"})


def _segment(code: Column, n: int, parts: int) -> Column:
    width = 64 // parts
    return F.shiftrightunsigned(code, n * width).bitwiseAND(F.lit((1 << width) - 1))


def _trigrams_shared(a: pd.Series, b: pd.Series) -> pd.Series:
    """Jaccard similarity of the trigrams of two names."""

    def grams(t: str) -> set[str]:
        t = f"  {t} "
        return {t[i : i + 3] for i in range(len(t) - 2)}

    return pd.Series([len(x & y) / len(x | y) for x, y in ((grams(s), grams(t)) for s, t in zip(a, b))], dtype=float)


def moments(df: DataFrame, id_col: str = "label_id", path_col: str = "face_crop_path", val_col: str = "is_val", source_col: str = "corpus") -> DataFrame:
    """(id, val, source, stem, micros, code) of the rows whose path states a stem and a second."""
    m = F.pandas_udf(_named_moments, "stem string, micros long, code long")(F.col(path_col))
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(val_col), F.lit(False)).alias("val"), F.col(source_col).alias("source"), m.alias("m"))
    return rows.select("id", "val", "source", "m.*").filter("code is not null")


def twins(classes: DataFrame, tolerance_s: float = 0.25, radius: int = 3, similarity: float = 1.0) -> DataFrame:
    """(v_stem, v_micros, t_stem, t_micros, exact): evaluation and training classes of one moment of one clip.

    ``classes`` are distinct (val, stem, micros, code). Stems are the same if the Jaccard
    similarity of their trigrams is ``similarity`` at least; of unequal stems, those whose codes differ in
    more than ``radius`` bits are not found.
    """
    parts, tol = radius + 1, round(tolerance_s * 1e6)
    cells = F.array(*[F.struct(F.lit(g).alias("grid"), F.floor((F.col("micros") + g * tol) / F.lit(2 * tol)).alias("cell")) for g in (0, 1)])
    segs = F.array(*[F.struct(F.lit(s).alias("seg"), _segment(F.col("code"), s, parts).alias("bits")) for s in range(parts)])
    keyed = classes.select("*", F.explode(cells).alias("c")).select("*", F.explode(segs).alias("s")).select("val", "stem", "micros", "code", "c.grid", "c.cell", "s.seg", "s.bits")
    v, t = (keyed.filter(side).select(*[F.col(c).alias(f"{x}_{c}") for c in ("stem", "micros", "code")], "grid", "cell", "seg", "bits") for x, side in (("v", "val"), ("t", "not val")))
    j = v.join(t, ["grid", "cell", "seg", "bits"])
    diff = F.col("v_code").bitwiseXOR(F.col("t_code"))
    first_seg = F.coalesce(*[F.when(_segment(diff, s, parts) == 0, F.lit(s)) for s in range(parts)])
    cell0 = [F.floor(F.col(f"{x}_micros") / F.lit(2 * tol)) for x in "vt"]
    first_grid = F.when(cell0[0] == cell0[1], 0).otherwise(1)
    near = (F.bit_count(diff) <= radius) & (F.abs(F.col("v_micros") - F.col("t_micros")) <= tol)
    j = j.filter((F.col("seg") == first_seg) & (F.col("grid") == first_grid) & near)
    exact = F.col("v_stem") == F.col("t_stem")
    j = j.select("v_stem", "v_micros", "t_stem", "t_micros", exact.alias("exact"))
    if similarity >= 1:
        return j.filter("exact")
    return j.filter(F.col("exact") | (F.pandas_udf(_trigrams_shared, "double")("v_stem", "t_stem") >= similarity))


def overlaps(df: DataFrame, tolerance_s: float = 0.25, radius: int = 3, similarity: float = 1.0, **columns: str) -> DataFrame:
    """(val_id, train_id, exact): evaluation and training rows of one moment of one clip.

    ``is_val`` true is evaluation, false or null training. Null paths and names that state no
    second overlap with nothing. Repeated rows count each. Every pair comes out once. An empty
    table, or one with a single split, gives no rows; other columns are not read.
    """
    rows = moments(df, **columns)
    pairs = twins(rows.select("val", "stem", "micros", "code").distinct(), tolerance_s, radius, similarity)
    v, t = (rows.filter(side).select(F.col("id").alias(name), F.col("stem").alias(f"{x}_stem"), F.col("micros").alias(f"{x}_micros")) for x, side, name in (("v", "val", "val_id"), ("t", "not val", "train_id")))
    return pairs.join(v, ["v_stem", "v_micros"]).join(t, ["t_stem", "t_micros"]).select("val_id", "train_id", "exact")


def overlap_pairs(df: DataFrame, **kw) -> DataFrame:
    o = overlaps(df, **kw)
    return o.select(F.least("val_id", "train_id").alias("label_id_1"), F.greatest("val_id", "train_id").alias("label_id_2"))


def overlap_report(df: DataFrame, tolerance_s: float = 0.25, radius: int = 7, similarity: float = 0.8, **columns: str) -> DataFrame:
    """(split, corpus, exact_rows, near_rows, exact_pairs, near_pairs), from the sizes of classes.

    Rows of each split and source that have a twin of the same stem in the other split, or of a
    similar one, and the pairs of rows that they are in.
    """
    rows = moments(df, **columns)
    sized = rows.groupBy("val", "stem", "micros", "code", "source").agg(F.count("*").alias("n"))
    sized = materialize(sized, "classes")
    pairs = materialize(twins(sized.select("val", "stem", "micros", "code").distinct(), tolerance_s, radius, similarity), "twins")
    totals = sized.groupBy("val", "stem", "micros").agg(F.sum("n").alias("others"))
    out = []
    for own, other, side, split in (("v", "t", "val", "evaluation"), ("t", "v", "not val", "training")):
        there = totals.filter(~F.col("val") if own == "v" else F.col("val")).select(F.col("stem").alias(f"{other}_stem"), F.col("micros").alias(f"{other}_micros"), "others")
        met = pairs.join(there, [f"{other}_stem", f"{other}_micros"]).groupBy(f"{own}_stem", f"{own}_micros").agg(F.sum(F.when(F.col("exact"), F.col("others")).otherwise(0)).alias("exact"), F.sum(F.when(~F.col("exact"), F.col("others")).otherwise(0)).alias("near"))
        here = sized.filter(side).select(F.col("stem").alias(f"{own}_stem"), F.col("micros").alias(f"{own}_micros"), F.col("source").alias("corpus"), "n")
        out.append(here.join(met, [f"{own}_stem", f"{own}_micros"]).select(F.lit(split).alias("split"), "corpus", "n", "exact", "near"))
    each = out[0].unionByName(out[1])
    n = F.col("n")
    return each.groupBy("split", "corpus").agg(*[F.sum(F.when(F.col(k) > 0, n).otherwise(0)).alias(f"{k}_rows") for k in ("exact", "near")], *[F.sum(n * F.col(k)).alias(f"{k}_pairs") for k in ("exact", "near")])

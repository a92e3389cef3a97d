"""Connected components of an edge table, by alternating large-star and small-star steps.

Each round is two aggregations and two joins over the current edges; edges that are
copies collapse at once, so hubs shrink from round to round. Nothing is collected: the
driver sees one row of counters per round. Rounds are written to the shared scratch
folder, so lineage stays short and a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.session import materialize


def _min_neighbour(sym: DataFrame) -> DataFrame:
    return sym.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    sym = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return sym.join(_min_neighbour(sym), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    mins = low.groupBy("u").agg(F.min("v").alias("m"))
    moved = low.join(mins, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(mins.select("u", F.col("m").alias("v"))).filter("u <> v")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component): every node that has an edge, with the smallest node it is joined to.

    Null ends and self loops are ignored; an empty table gives an empty result; repeated
    and reversed edges count once. Other columns of ``edges`` are not read. The number of rounds
    follows the logarithm of the longest path; an answer that is not final after ``max_rounds`` is refused.
    """
    cur = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).filter("u is not null and v is not null and u <> v").distinct()
    cur = materialize(cur, "cc")
    seen = None
    for _ in range(max_rounds):
        stat = cur.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if seen == (stat["n"], stat["h"]) or not stat["n"]:
            break
        seen = (stat["n"], stat["h"])
        cur = materialize(_small_star(_large_star(cur).distinct()).distinct(), "cc")
    else:
        raise RuntimeError(f"components are not final after {max_rounds} rounds")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).union(cur.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()

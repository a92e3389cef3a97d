"""Joins with rules of their own: first match, merge, precedence, as-of, interval, boxes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def resume(files: DataFrame, status: DataFrame, path: str = "file_path", done: str = "done") -> DataFrame:
    """Files of which no status row, however spelt, says done."""
    finished = status.filter(F.lower(F.trim("status")) == done).select(path).distinct()
    return files.join(finished, path, "left_anti")


def prior_and_fresh(prior: DataFrame, processed: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Prior rows of keys that were not processed again, then the fresh rows."""
    return prior.join(processed.select(key).distinct(), key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def first_match(left: DataFrame, right: DataFrame, key: list[str], order: list[Column], how: str = "left") -> DataFrame:
    """Join to the first right row of each key; later ones of the key are left out."""
    first = right.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_rn = 1").drop("_rn")
    return left.join(first, key, how)


def merge_update(target: DataFrame, source: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Target with ``columns`` taken from source where the key is there; the rest is untouched."""
    s = source.select(key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in columns])
    j = target.join(s, key, "left")
    new = {c: F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)) for c in columns}
    return j.select(*[new[c].alias(c) if c in new else F.col(c) for c in target.columns])


def full_outer(tables: list[DataFrame], key: str) -> DataFrame:
    return reduce(lambda a, b: a.join(b, key, "full"), tables)


def first_claim(claims: DataFrame, claimed: str, order: list[Column]) -> DataFrame:
    """Each ``claimed`` value goes to the first row that asks for it."""
    return claims.withColumn("_rn", F.row_number().over(Window.partitionBy(claimed).orderBy(*order))).filter(F.col("_rn") == 1).drop("_rn")


def resolve_by_precedence(left: DataFrame, right: DataFrame, rules: list[tuple[str, str]], value: str, order: list[Column]) -> DataFrame:
    """``value`` of the right row that matches by the first rule (left column, right column) that finds any."""
    out, found = left, []
    for n, (a, b) in enumerate(rules):
        r = right.filter(F.col(b).isNotNull()).withColumn("_rn", F.row_number().over(Window.partitionBy(b).orderBy(*order))).filter("_rn = 1").select(F.col(b).alias(a), F.col(value).alias(f"_v{n}"))
        out = out.join(r, a, "left")
        found.append(f"_v{n}")
    return out.withColumn(value, F.coalesce(*found)).drop(*found)


def asof_forward(targets: DataFrame, rows: DataFrame, key: list[str], t: str, value: list[str]) -> DataFrame:
    """Each target with the first row of its key at or after its time; null if there is none.

    One shuffle: both tables are laid over each other and every target looks ahead for the next row.
    """
    pack = F.struct(F.col(t).alias("at"), *value)
    both = rows.select(*key, t, F.lit(1).alias("_k"), pack.alias("_v")).unionByName(targets.select(*key, t, F.lit(0).alias("_k")), allowMissingColumns=True)
    # backwards, so that the frame grows by a row a step; of rows at one time the smallest values come last
    w = Window.partitionBy(*key).orderBy(F.desc(t), F.desc("_k"), F.desc("_v")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = both.withColumn("_n", F.last("_v", ignorenulls=True).over(w)).filter("_k = 0")
    return out.select(*key, t, F.col("_n.at").alias("next_t"), *[F.col(f"_n.{c}").alias(c) for c in value])


def interval_join(left: DataFrame, right: DataFrame, key: list[str], lt: str, rt: str, width: float) -> DataFrame:
    """Pairs of a key whose numbers differ by at most ``width``: an equi-join on cells of that width.

    Left rows are posted to their cell and its neighbours, so every pair meets in one cell.
    """
    cell = lambda c: F.floor(F.col(c) / F.lit(width)).cast("long")
    a = left.withColumn("_c", F.explode(F.array(cell(lt) - 1, cell(lt), cell(lt) + 1)))
    return a.join(right.withColumn("_c", cell(rt)), [*key, "_c"]).filter(F.abs(F.col(lt) - F.col(rt)) <= width).drop("_c")


def refine(pairs: DataFrame, key: list[str], score: str, tie: list[str]) -> DataFrame:
    """The pair of the highest score for each key, the first of equals."""
    return pairs.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc_nulls_last(score), *tie))).filter("_rn = 1").drop("_rn")


def membership_sets(clusters: DataFrame, members: str, member: str, name: str) -> DataFrame:
    """(member, names): the sorted set of the clusters that list a member."""
    return clusters.select(F.explode(members).alias(member), name).groupBy(member).agg(F.array_sort(F.collect_set(name)).alias("names"))


def hit_box(points: DataFrame, boxes: DataFrame, key: str, x: str, y: str, show_rejected: Column) -> DataFrame:
    """(point columns, box_id): the first accepted box around a point, else the first rejected one where shown."""
    inside = F.col(x).between(F.col("x1"), F.col("x2")) & F.col(y).between(F.col("y1"), F.col("y2"))
    j = points.join(boxes, key).filter(inside & (F.col("accepted") | show_rejected))
    w = Window.partitionBy(*points.columns).orderBy(F.desc("accepted"), "box_id")
    return j.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").select(*points.columns, "box_id")


def covered_share(ax1: Column, ay1: Column, ax2: Column, ay2: Column, bx1: Column, by1: Column, bx2: Column, by2: Column) -> Column:
    """Share of box a that box b covers; null for an empty box a."""
    ix = F.greatest(F.least(ax2, bx2) - F.greatest(ax1, bx1), F.lit(0))
    iy = F.greatest(F.least(ay2, by2) - F.greatest(ay1, by1), F.lit(0))
    return F.try_divide((ix * iy).cast("double"), ((ax2 - ax1) * (ay2 - ay1)).cast("double"))

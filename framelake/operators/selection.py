"""Ranking, capping and ordering inside groups. Every order ends in a unique key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; the window limit is pushed below the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")


def cap_groups(df: DataFrame, group: list[str], order: list[Column], cap: int) -> DataFrame:
    """top_k with ``over_cap``, whether the group lost rows; a cap of 0 or less keeps all."""
    n = df.groupBy(*group).agg(F.count("*").alias("_n"))
    keep = df if cap <= 0 else top_k(df, group, order, cap)
    return keep.join(n, group).withColumn("over_cap", F.lit(cap > 0) & (F.col("_n") > cap)).drop("_n")


def type_limits(df: DataFrame, type_col: str, order: list[Column], limits: dict[str, int]) -> DataFrame:
    """The smallest rows of each type up to its limit; 0 shuts a type out if another has a limit above 0."""
    if not any(v > 0 for v in limits.values()):
        return df
    limit = F.lit(None).cast("int")
    for t, n in limits.items():
        limit = F.when(F.col(type_col) == t, n).otherwise(limit)
    rn = F.row_number().over(Window.partitionBy(type_col).orderBy(*order))
    return df.withColumn("_rn", rn).filter(limit.isNull() | (F.col("_rn") <= limit)).drop("_rn")


def first_per_key(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    return top_k(df, key, order, 1)


def section_rank(df: DataFrame, section: list[str], group: str, ts: Column, tie: list[Column]) -> DataFrame:
    """``position`` in a section: by the earliest moment of the row's group, the group, its moment, ties."""
    # the earliest moments come back by a join, so that the rows without a group are not one task
    keys = [*section, group]
    first = df.groupBy(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)]).agg(F.min(ts).alias("_first"))
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(keys)])
    d = df.join(first, same).select(*df.columns, "_first")
    return d.withColumn("position", F.row_number().over(Window.partitionBy(*section).orderBy("_first", group, ts, *tie))).drop("_first")


def followers_after_representative(df: DataFrame, pos: str, group: str, is_rep: str) -> DataFrame:
    """``place``: group members follow their representative, in order; rows without a group keep theirs."""
    reps = df.filter(F.col(group).isNotNull() & F.col(is_rep)).groupBy(group).agg(F.min(pos).alias("_rep"))
    df = df.join(reps, group, "left").select(*df.columns, "_rep")
    lead = F.coalesce("_rep", F.col(pos))
    # the place is a rank over all rows, so it is ordered without a single partition: ranges are numbered
    return global_rank(df.withColumn("_lead", lead), ["_lead", (~F.col(is_rep)).cast("int"), pos], "place").drop("_lead", "_rep")


def global_rank(df: DataFrame, order: list, name: str) -> DataFrame:
    """Row numbers of a total order, by ranges of rows rather than in one task."""
    s = df.orderBy(*order).select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_i"))
    from framelake.session import materialize

    s = materialize(s, "ranked")
    sizes = s.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_i").alias("_i0"))
    before = sizes.withColumn("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return s.join(F.broadcast(before.select("_p", "_i0", "_b")), "_p").withColumn(name, (F.col("_b") + F.col("_i") - F.col("_i0") + 1).cast("long")).drop("_p", "_i", "_i0", "_b")


def justify(df: DataFrame, section: list[str], order: list[Column], aspect: Column, width: float, height: float = 200.0, gap: float = 4.0) -> DataFrame:
    """``line`` of each card: cards fill a line of the section until their widths at ``height`` reach ``width``.

    A running state over the cards of one section, which is what a page shows.
    """
    cards = df.withColumn("_a", F.least(F.greatest(aspect, F.lit(0.1)), F.lit(10.0)))
    w = Window.partitionBy(*section).orderBy(*order)
    cards = cards.withColumn("_k", F.row_number().over(w))
    packed = cards.groupBy(*section).agg(F.array_sort(F.collect_list(F.struct("_k", "_a"))).alias("_c"))
    start = F.struct(F.lit(1).alias("line"), F.lit(0.0).alias("used"), F.array().cast("array<int>").alias("lines"))

    def step(s: Column, c: Column) -> Column:
        need = c["_a"] * height + gap
        fresh = (s["used"] > 0) & (s["used"] + need > width)
        line = s["line"] + fresh.cast("int")
        return F.struct(line.alias("line"), F.when(fresh, need).otherwise(s["used"] + need).alias("used"), F.concat(s["lines"], F.array(line)).alias("lines"))

    lines = packed.select(*section, F.posexplode(F.aggregate("_c", start, step)["lines"]).alias("_p", "line")).withColumn("_k", F.col("_p") + 1).drop("_p")
    return cards.join(lines, [*section, "_k"]).drop("_a", "_k")


def best_epoch(log: DataFrame, loss: str, epoch: str, patience: int, group: list[str] | None = None) -> DataFrame:
    """Epoch of the least loss before training would stop: after ``patience`` epochs without a better one."""
    keys = group or []
    w = Window.partitionBy(*keys).orderBy(epoch)
    best = F.min(loss).over(w.rowsBetween(Window.unboundedPreceding, -1))
    better = log.withColumn("_b", F.col(loss) < F.coalesce(best, F.lit(float("inf"))))
    since = better.withColumn("_last", F.max(F.when(F.col("_b"), F.col(epoch))).over(w))
    stop = since.withColumn("_stop", F.max(F.when(F.col(epoch) - F.col("_last") >= patience, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    seen = stop.filter(F.coalesce("_stop", F.lit(0)) == 0)
    return top_k(seen, keys, [F.col(loss).asc(), F.col(epoch).asc()], 1).drop("_b", "_last", "_stop")

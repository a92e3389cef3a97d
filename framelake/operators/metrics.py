"""Summaries: zero-filled distributions, coverage, statistics, correlation, quartiles, classification."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def filled_counts(df: DataFrame, col: str, domain: list, name: str = "n") -> DataFrame:
    """(col, n): a row for every value of the domain, 0 where it does not occur; other values are left out."""
    d = df.sparkSession.createDataFrame([(v,) for v in domain], f"{col} {df.schema[col].dataType.simpleString()}")
    return F.broadcast(d).join(df.groupBy(col).agg(F.count("*").alias(name)), col, "left").fillna(0, [name])


def coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, present, share): how often each column has a value; one pass over the table."""
    one = df.agg(F.count("*").alias("_all"), *[F.count(F.col(c)).alias(c) for c in columns])
    arms = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("present")) for c in columns])
    return one.select("_all", F.explode(arms).alias("a")).select("a.column", "a.present", F.round(F.try_divide("a.present", "_all"), 6).alias("share"))


def score_stats(df: DataFrame, col: str, group: list[str] | None = None) -> DataFrame:
    """n, mean, truncated median, min, max and sample deviation (0 for one row) of what is a number."""
    v = F.col(col).cast("string").try_cast("double")
    v = F.when(~F.isnan(v), v)
    return df.withColumn("_v", v).filter("_v is not null").groupBy(*(group or [])).agg(
        F.count("_v").alias("n"), F.round(F.avg("_v"), 6).alias("mean"), F.percentile("_v", 0.5).cast("long").alias("median"),
        F.min("_v").alias("low"), F.max("_v").alias("high"), F.round(F.coalesce(F.stddev_samp("_v"), F.lit(0.0)), 6).alias("deviation"),
    )


def histogram(df: DataFrame, value: Column, lo: int = 1, hi: int = 10) -> DataFrame:
    """(bin, n): whole numbers clamped to lo..hi, every bin present; nulls are left out."""
    bins = df.filter(value.isNotNull()).select(F.least(F.greatest(value.cast("int"), F.lit(lo)), F.lit(hi)).alias("bin"))
    return filled_counts(bins, "bin", list(range(lo, hi + 1)))


def pearson(df: DataFrame, x: str, y: str, group: list[str]) -> DataFrame:
    """(group, n, r): null for fewer than two pairs of numbers or a constant side."""
    ok = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(F.col(x).cast("double")) & ~F.isnan(F.col(y).cast("double")))
    a = ok.groupBy(*group).agg(F.count("*").alias("n"), F.covar_pop(x, y).alias("_c"), F.stddev_pop(x).alias("_x"), F.stddev_pop(y).alias("_y"))
    r = F.when((F.col("n") > 1) & (F.col("_x") > 0) & (F.col("_y") > 0), F.try_divide("_c", F.col("_x") * F.col("_y")))
    return a.select(*group, "n", F.round(r, 6).alias("r"))


def quartiles(df: DataFrame, col: str) -> DataFrame:
    """Adds ``quartile`` 1..4, right-closed at interpolated edges; equal values are never split, null stays null."""
    q = df.agg(F.percentile(col, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"))
    c = F.col(col)
    return df.join(F.broadcast(q), how="cross").withColumn("quartile", F.when(c <= F.col("_q")[0], 1).when(c <= F.col("_q")[1], 2).when(c <= F.col("_q")[2], 3).when(c.isNotNull(), 4)).drop("_q")


def rates(df: DataFrame, by: Column, cond: Column, name: str) -> DataFrame:
    """(name, n, rate): share of rows of each value that fulfil a condition; a null condition does not."""
    return df.groupBy(by.alias(name)).agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce(cond, F.lit(False)).cast("int")), 6).alias("rate"))


def confusion(df: DataFrame, truth: str, guess: str, labels: list) -> DataFrame:
    """A row for every label of the truth, a column for every guess, zero-filled."""
    kind = df.schema[truth].dataType.simpleString()
    rows = df.sparkSession.createDataFrame([(x,) for x in labels], f"{truth} {kind}")
    m = df.groupBy(truth).pivot(guess, labels).count()
    return F.broadcast(rows).join(m, truth, "left").fillna(0).select(truth, *[F.col(f"`{x}`").alias(f"as_{x}") for x in labels])


def class_scores(df: DataFrame, truth: str, guess: str, labels: list) -> DataFrame:
    """(label, precision, recall, f1, support); 0 where a share is undefined."""
    arms = [df.agg(F.lit(x).alias("label"), F.count_if((F.col(truth) == x) & (F.col(guess) == x)).alias("tp"), F.count_if(F.col(guess) == x).alias("said"), F.count_if(F.col(truth) == x).alias("support")) for x in labels]
    t = reduce(DataFrame.unionByName, arms) if len(arms) < 3 else _one_pass(df, truth, guess, labels)
    p, r = (F.coalesce(F.try_divide("tp", c), F.lit(0.0)) for c in ("said", "support"))
    f1 = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return t.select("label", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1, 6).alias("f1"), "support")


def _one_pass(df: DataFrame, truth: str, guess: str, labels: list) -> DataFrame:
    agg = [F.struct(F.lit(x).alias("label"), F.count_if((F.col(truth) == x) & (F.col(guess) == x)).alias("tp"), F.count_if(F.col(guess) == x).alias("said"), F.count_if(F.col(truth) == x).alias("support")).alias(f"s{k}") for k, x in enumerate(labels)]
    return df.agg(*agg).select(F.explode(F.array(*[f"s{k}" for k in range(len(labels))])).alias("s")).select("s.*")


def summary_scores(scores: DataFrame) -> DataFrame:
    return scores.agg(F.round(F.avg("f1"), 6).alias("macro_f1"), F.sum("support").cast("long").alias("support"))


def class_weights(df: DataFrame, label: str, boost: dict[str, float] | None = None) -> DataFrame:
    """``weight``: boost over frequency of the row's label. Frequencies are a small table joined back, not a window."""
    n = df.groupBy(label).agg(F.count("*").alias("_n"))
    b = F.lit(1.0)
    for k, v in (boost or {}).items():
        b = F.when(F.col(label) == k, v).otherwise(b)
    return df.join(n, label).withColumn("weight", b / F.col("_n")).drop("_n")


def stage_shares(df: DataFrame, stage: str, seconds: str, n_files: Column) -> DataFrame:
    """(stage, total, mean over all files, max, share of the sum of totals)."""
    a = df.groupBy(stage).agg(F.sum(seconds).alias("total"), F.max(seconds).alias("longest"))
    whole = F.sum("total").over(Window.partitionBy(F.lit(1)))
    return a.select(stage, F.round("total", 4).alias("total"), F.round(F.col("total") / n_files, 6).alias("mean"), F.col("longest"), F.round(F.try_divide(F.col("total"), whole), 6).alias("share"))


def shown_counts(df: DataFrame, visible: Column, odd: Column) -> DataFrame:
    """(anomalous, normal, shown, total) of cards; one that is not known to be odd is normal, to be visible is hidden."""
    v, o = (F.coalesce(c, F.lit(False)) for c in (visible, odd))
    return df.agg(F.count_if(v & o).alias("anomalous"), F.count_if(v & ~o).alias("normal"), F.count_if(v).alias("shown"), F.count("*").alias("total"))


def rejection_counts(df: DataFrame, kinds: Column, kept: Column) -> DataFrame:
    """(kind, n) of the rejected faces of all frames, and the frames that lost every face."""
    k = df.select(F.explode(kinds).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))
    lost = df.agg(F.lit("frames_without_face").alias("kind"), F.count_if((F.size(kinds) > 0) & (kept == 0)).alias("n"))
    return k.unionByName(lost)

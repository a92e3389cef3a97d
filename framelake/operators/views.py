"""What a viewer asks of keeper rows: filters, section counts, toggles, ranges."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN_PERSON = "__unknown__"


@dataclass(frozen=True)
class ViewFilter:
    """Empty sets ask for nothing: no people, all buckets. ``source`` is all, image or video."""

    qualities: frozenset[str] = frozenset({"good"})
    people: frozenset[str] = frozenset()
    all_people: bool = False
    buckets: frozenset[str] = frozenset()
    source: str = "all"
    representatives_only: bool = False
    known_qualities: tuple[str, ...] = field(default=("none", "bad", "okay", "good"))

    def quality(self, label: Column) -> Column:
        lab = F.when(F.lower(label).isin(*self.known_qualities), F.lower(label)).otherwise("none")
        return lab.isin(*self.qualities) if self.qualities else F.lit(False)

    def person(self, names: Column) -> Column:
        """All or any of the chosen people; a row without names is the unknown person."""
        if not self.people:
            return F.lit(True)
        have = F.when(F.coalesce(F.size(names), F.lit(0)) > 0, names).otherwise(F.array(F.lit(UNKNOWN_PERSON)))
        want = F.array(*[F.lit(p) for p in sorted(self.people)])
        return F.size(F.array_except(want, have)) == 0 if self.all_people else F.arrays_overlap(want, have)

    def bucket(self, b: Column) -> Column:
        return F.lit(True) if not self.buckets else F.coalesce(b.isin(*self.buckets), F.lit(False))

    def kind(self, source_type: Column) -> Column:
        return F.lit(True) if self.source == "all" else F.coalesce(source_type == self.source, F.lit(False))

    def representative(self, flag: Column) -> Column:
        return F.coalesce(flag, F.lit(True)) if self.representatives_only else F.lit(True)


def apply_filter(df: DataFrame, f: ViewFilter, label: str, names: Column, bucket: str, source: str, rep: Column) -> DataFrame:
    return df.filter(f.quality(F.col(label)) & f.person(names) & f.bucket(F.col(bucket)) & f.kind(F.col(source)) & f.representative(rep))


MINIMUM_QUALITY = {"good": ("good",), "okay": ("good", "okay")}


def at_least(label: Column, least: str) -> Column:
    return F.coalesce(F.lower(label).isin(*MINIMUM_QUALITY[least]), F.lit(False))


def to_caption(df: DataFrame, done: str, force: bool = False) -> DataFrame:
    return df if force else df.filter(F.col(done).isNull())


def section_counts(df: DataFrame, year: str, month: str) -> DataFrame:
    """Counts by section, by year (month null) and in all (both null)."""
    return df.rollup(year, month).agg(F.count("*").alias("n"))


def year_states(df: DataFrame, year: str, month: str, visible: Column) -> DataFrame:
    """(year, sections, shown, state): checked, indeterminate or none."""
    s = df.groupBy(year, month).agg(F.max(visible.cast("int")).alias("v"))
    y = s.groupBy(year).agg(F.count("*").alias("sections"), F.sum("v").cast("long").alias("shown"))
    state = F.when(F.col("shown") == F.col("sections"), "checked").when(F.col("shown") > 0, "indeterminate").otherwise("none")
    return y.withColumn("state", state)


def toggled(selection: Column, items: Column) -> Column:
    """Items leave the selection if they are in it, and enter it if not."""
    return F.array_sort(F.array_union(F.array_except(selection, items), F.array_except(items, selection)))


def between_items(df: DataFrame, section: str, pos: str, a: int, b: int) -> DataFrame:
    """Rows between two positions of one section, in whichever order they were chosen."""
    return df.filter(F.col(pos).between(min(a, b), max(a, b)))


def review_class(prob: Column, label: Column, least: float = 0.5) -> Column:
    """uncertain below the least confidence, else the label."""
    return F.when(prob < least, "uncertain").otherwise(label)

"""Queries pN_... of the training-data operators, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from framelake.llm.clusters import cluster, linked_groups
from framelake.llm.garbled import find_garbled
from framelake.llm.history import repeats_by_batch
from framelake.llm.knn import similar_pairs
from framelake.llm.packing import containers, fill_report
from framelake.llm.replies import defects, replies_of
from framelake.llm.splits import overlap_pairs, overlap_report
from framelake.llm.tokens import encode
from framelake.session import ship

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return defects(replies_of(table(spark, d, "raw_outputs_a"), table(spark, d, "results")), table(spark, d, "prompts"), table(spark, d, "documents"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return similar_pairs(table(spark, d, "results"), k=5, floor=0.5)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return linked_groups(table(spark, d, "results").filter("face_count >= 1"), min_cos=0.5, min_size=5)


def p4_clusters(spark: SparkSession, d: str) -> DataFrame:
    return cluster(table(spark, d, "results").filter("face_count >= 1"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap_pairs(table(spark, d, "labels"))


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap_report(table(spark, d, "labels"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return repeats_by_batch(table(spark, d, "results"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode(table(spark, d, "documents"))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return containers(table(spark, d, "documents"), table(spark, d, "context_windows"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return fill_report(p7_containers(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return find_garbled(table(spark, d, "documents")).select("doc_id")


def p8_restored(spark: SparkSession, d: str) -> DataFrame:
    return find_garbled(table(spark, d, "documents"))


def queries() -> dict[str, Query]:
    return {n: f for n, f in globals().items() if n[0] == "p" and n[1:2].isdigit()}


_USABLE = """
u0 as (select row_id, cast(embedding as double[]) as v from results where len(embedding) = 512 {where}),
u1 as (select row_id, v from u0 where len(list_filter(v, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(v, lambda x: x <> 0)) > 0),
u as (select row_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) as v from u1)"""

_P3 = (
    "with"
    + _USABLE.format(where="")
    + """,
s as (select a.row_id as r, b.row_id as o, round(list_dot_product(a.v, b.v), 12) as c from u a join u b on a.row_id <> b.row_id),
t as (select r, o from s where c > 0.5 qualify row_number() over (partition by r order by c desc, o) <= 5)
select distinct least(r, o) as row_id_1, greatest(r, o) as row_id_2 from t"""
)

_P4 = (
    "with recursive"
    + _USABLE.format(where="and face_count >= 1")
    + """,
e as (select a.row_id as a, b.row_id as b from u a join u b on a.row_id <> b.row_id where round(list_dot_product(a.v, b.v), 12) > 0.5),
n as (select distinct a from e),
reach(a, b) as (select a, a from n union select r.a, e.b from reach r join e on e.a = r.b),
lab as (select a as row_id, min(b) as cluster_id from reach group by a)
select row_id, cluster_id from lab where cluster_id in (select cluster_id from lab group by cluster_id having count(*) >= 5)"""
)


def oracle_sql() -> dict[str, str]:
    return {"p3_found": _P3, "p4_found": _P4}

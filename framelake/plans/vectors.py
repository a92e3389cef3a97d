"""Queries over vectors (operators 33, 53, 55, 56, 106, 108, 175, 177, 220 to 227, 234)."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelake.operators import similarity as V
from framelake.operators.graph import connected_components
from framelake.plans.registry import query, table

UNIT = "(select vec_id, label, list_transform(cast(embedding as double[]), lambda x: x / sqrt(list_inner_product(cast(embedding as double[]), cast(embedding as double[])))) as v from embeddings)"
PAIRS = "(select a.vec_id as a, b.vec_id as b from {u} a join {u} b on a.vec_id < b.vec_id where list_inner_product(a.v, b.v) > {t})"
REACH = "r(n, m) as (select vec_id, vec_id from embeddings union select p.b, r.m from r join (select a, b from p union all select b, a from p) p on p.a = r.n and r.m < p.b)"


def pairs(s, d, floor):
    return V.similar_pairs(table(s, d, "embeddings"), "vec_id", "embedding", floor)


@query("op033_embedding_eligible", "select count(*) as n from results where face_count > 0 and embedding is not null and len(embedding) > 0")
def _(s, d):
    return table(s, d, "results").filter((F.col("face_count") > 0) & (F.size("embedding") > 0)).agg(F.count("*").alias("n"))


@query("op053_similar_pairs", f"select a, b from {PAIRS.format(u=UNIT, t=0.35)}")
def _(s, d):
    return pairs(s, d, 0.35).select("a", "b")


CENT = f"(select label, list(x order by p) as c from (select label, p, avg(x) as x from (select label, unnest(v) as x, generate_subscripts(v, 1) as p from {UNIT}) group by label, p) group by label)"


@query("op106_centroids", f"select label, p - 1 as pos, round(c[p] / sqrt(list_inner_product(c, c)), 6) as x, n as member_count from {CENT} join (select label, count(*) as n from embeddings group by label) using (label), lateral (select unnest(range(1, 65)) as p)")
def _(s, d):
    c = V.centroids(table(s, d, "embeddings"), "label", "embedding")
    return c.select("label", "member_count", F.posexplode("centroid").alias("pos", "x")).select("label", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"), "member_count")


@query("op055_nearest_centroid", f"select vec_id, label from (select u.vec_id, c.label, row_number() over (partition by u.vec_id order by round(1 - list_inner_product(u.v, c.c) / sqrt(list_inner_product(c.c, c.c)), 12), c.label) as n from {UNIT} u, {CENT} c) where n = 1")
def _(s, d):
    e = table(s, d, "embeddings")
    return V.nearest(e.drop("label"), V.centroids(e, "label", "embedding"), "vec_id", "embedding", "label").select("vec_id", "label")


@query("op175_cosine", "select vec_id, round(sqrt(list_inner_product(cast(embedding as double[]), cast(embedding as double[]))), 6) as norm from embeddings")
def _(s, d):
    return table(s, d, "embeddings").select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"))


@query("op220_components", f"with recursive p as {PAIRS.format(u=UNIT, t=0.35)}, {REACH} select n as node, min(m) as component from r where n in (select a from p union select b from p) group by n")
def _(s, d):
    return connected_components(pairs(s, d, 0.35), "a", "b")


@query("op221_groups", f"with recursive p as {PAIRS.format(u=UNIT, t=0.35)}, {REACH}, c as (select n, min(m) as k from r where n in (select a from p union select b from p) group by n) select e.vec_id, dense_rank() over (order by c.k) as group_id, count(*) over (partition by c.k) as size from embeddings e join c on c.n = e.vec_id union all select vec_id, null, null from embeddings where vec_id not in (select n from c)")
def _(s, d):
    e = table(s, d, "embeddings")
    return V.similarity_groups(e, pairs(s, d, 0.35), "vec_id")


@query("op073_representatives", f"with recursive p as {PAIRS.format(u=UNIT, t=0.35)}, {REACH}, c as (select n, min(m) as k from r group by n) select vec_id, row_number() over (partition by k order by label desc, vec_id) = 1 as is_representative from embeddings join c on c.n = vec_id")
def _(s, d):
    e = table(s, d, "embeddings").drop("embedding").withColumn("size_bytes", F.lit(0))
    g = V.similarity_groups(e, pairs(s, d, 0.35), "vec_id")
    return V.representatives(e, g, "vec_id", "label", "size_bytes").select("vec_id", "is_representative")


@query("op108_group_summary", f"with recursive p as {PAIRS.format(u=UNIT, t=0.35)}, {REACH}, c as (select n, min(m) as k from r where n in (select a from p union select b from p) group by n) select least(s, 4) as size, count(*) as groups from (select k, count(*) as s from c group by k) group by 1")
def _(s, d):
    c = connected_components(pairs(s, d, 0.35), "a", "b").groupBy("component").agg(F.count("*").alias("s"))
    return c.groupBy(F.least("s", F.lit(4)).alias("size")).agg(F.count("*").alias("groups"))


DBSCAN = f"""with recursive p as {PAIRS.format(u=UNIT, t=0.3)}, y as (select a, b from p union all select b, a from p),
  core as (select a as c from y group by a having count(*) + 1 >= 5), l as (select a, b from y where a in (select c from core) and b in (select c from core)),
  r(n, m) as (select c, c from core union select l.b, r.m from r join l on l.a = r.n and r.m < l.b), k as (select n, dense_rank() over (order by min(m)) - 1 as cluster from r group by n),
  border as (select y.a as n, min(k.cluster) as cluster from y join k on k.n = y.b where y.a not in (select c from core) group by y.a)
  select vec_id, coalesce(k.cluster, border.cluster, -1) as cluster from embeddings left join k on k.n = vec_id left join border on border.n = vec_id"""


@query("op222_dbscan", DBSCAN)
def _(s, d):
    e = table(s, d, "embeddings")
    return V.dbscan(e, pairs(s, d, 0.3), "vec_id", 5)


@query("op223_drop_small_clusters", f"select cluster, count(*) as size from ({DBSCAN}) where cluster >= 0 group by cluster having count(*) >= 5")
def _(s, d):
    e = table(s, d, "embeddings")
    c = V.dbscan(e, pairs(s, d, 0.3), "vec_id", 5).filter("cluster >= 0")
    return c.groupBy("cluster").agg(F.count("*").alias("size")).filter("size >= 5")


@query("op056_assignment")
def _(s, d):
    e = table(s, d, "embeddings")
    odd, even = (V.centroids(e.filter(F.col("vec_id") % 2 == k), "label", "embedding") for k in (1, 0))
    return V.assign(odd.withColumnRenamed("label", "cluster"), even.withColumnRenamed("label", "name"), "cluster", "name", 2.0)


@query("op224_resolve_identities")
def _(s, d):
    e = table(s, d, "embeddings")
    old = V.centroids(e.filter("label < 6"), "label", "embedding").select(F.concat(F.lit("person"), F.element_at(F.array(*map(F.lit, "ABCDEF")), F.col("label") + 1)).alias("name"), F.lit(None).cast("string").alias("display_name"), "centroid", "member_count")
    new = V.centroids(e, "label", "embedding").withColumnRenamed("label", "cluster")
    return V.resolve_identities(old, new).select("name", "display_name", "member_count")


@query("op225_orphans")
def _(s, d):
    e = table(s, d, "embeddings")
    found, known = (V.centroids(e.filter(F.col("vec_id") % 3 == k), "label", "embedding") for k in (0, 1))
    return V.assign(found.withColumnRenamed("label", "orphan"), known.withColumnRenamed("label", "name"), "orphan", "name", 1.0, inclusive=True).select("orphan", "name")


@query("op226_member_lists", "select label, array_to_string(list(vec_id order by vec_id), ',') as ids from embeddings group by label")
def _(s, d):
    g = table(s, d, "embeddings").groupBy("label").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    return g.select("label", F.array_join("ids", ",").alias("ids"))


@query("op177_identity_confidence", f"select vec_id, label, round(least(greatest(1 - d, 0), 1), 6) as confidence from (select u.vec_id, c.label, round(1 - list_inner_product(u.v, c.c) / sqrt(list_inner_product(c.c, c.c)), 12) as d, row_number() over (partition by u.vec_id order by round(1 - list_inner_product(u.v, c.c) / sqrt(list_inner_product(c.c, c.c)), 12), c.label) as n from {UNIT} u, {CENT} c) where n = 1")
def _(s, d):
    from framelake.functions.scoring import identity_confidence

    e = table(s, d, "embeddings")
    n = V.nearest(e.drop("label"), V.centroids(e, "label", "embedding"), "vec_id", "embedding", "label")
    return n.select("vec_id", "label", F.round(identity_confidence(F.col("distance")), 6).alias("confidence"))

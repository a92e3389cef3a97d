"""Filling fixed-capacity containers with items (problem 7): conflict-constrained best fit.

Items come largest first. Open containers are ordered by what is left in them; a bit set of the
residuals in use gives the successor of a size at once. Every container carries bitmaps of its
sources and of its duplicate clusters, and the search goes on from the tightest container to the
next until one is compatible, that is, holds no text of the item's cluster; of equally tight
ones, one without a text of the item's source is preferred. Where every open container conflicts, ``conflicts="avoid"`` takes the tightest one rather than waste space, and
``"forbid"`` opens another.

Rows are packed in shards of bounded size; what is lost is at most the last container of each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.tokens import encode
from framelake.session import materialize

SHARD_ITEMS = 50_000
MOST_WINDOWS = 1000


LOOKED_AT = 16  # equally tight containers among which one without the source is looked for


def best_fit(sizes: list[int], clusters: list[int], sources: list[int], capacity: int, forbid: bool = False) -> tuple[list[int], list[bool], list[int], list[int]]:
    """Container of each item and whether it conflicts there, and the fill and source bitmap of each container.

    Sizes are in 1..capacity, cluster is -1 for none, sources are bits.
    """
    bits: dict[int, int] = {}
    for c in clusters:
        bits[c] = bits.get(c, 0) + 1
    bits = {c: 1 << k for k, c in enumerate(c for c, n in bits.items() if n > 1 and c >= 0)}
    levels: list[list[int]] = [[] for _ in range(capacity + 1)]
    used, held, fill, seen = 0, [], [], []
    stuck: dict[int, tuple[int, int]] = {}  # bit of a cluster -> containers there were, and the size from which all of them conflicted
    where, clash = [0] * len(sizes), [False] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        n, bit = sizes[k], bits.get(clusters[k], 0)
        rest = used >> n << n
        first = (rest & -rest).bit_length() - 1
        box, at = -1, first
        if bit and stuck.get(bit, (-1, 0))[0] == len(held):
            # only containers with less room than the search that failed have not been seen
            rest &= (1 << stuck[bit][1]) - 1
            at = (rest & -rest).bit_length() - 1
        if rest:
            while at >= 0 and box < 0:
                fits = -1
                for i in range(len(levels[at]) - 1, -1, -1):
                    if fits >= 0 and len(levels[at]) - i > LOOKED_AT:
                        break
                    if not held[levels[at][i]] & bit:
                        fresh = not seen[levels[at][i]] & sources[k]
                        if fresh or fits < 0:
                            fits = i
                        if fresh:
                            break
                if fits >= 0:
                    box = levels[at].pop(fits)
                else:
                    rest &= rest - 1
                    at = (rest & -rest).bit_length() - 1
        if box < 0 and bit and first >= 0:
            stuck[bit] = (len(held), n)
            if not forbid:
                at = first
                box = levels[at].pop()
        if box < 0:
            box, at = len(held), capacity
            held.append(0)
            fill.append(0)
            seen.append(0)
        elif not levels[at]:
            used &= ~(1 << at)
        clash[k] = bool(held[box] & bit)
        held[box] |= bit
        fill[box] += n
        seen[box] |= sources[k]
        if at - n:
            levels[at - n].append(box)
            used |= 1 << (at - n)
        where[k] = box
    return where, clash, fill, seen


def _pack(forbid: bool):
    schema = pa.schema([("window_name", pa.string()), ("capacity_tokens", pa.int32()), ("container_id", pa.string()), ("doc_id", pa.int64()), ("part_no", pa.int32()), ("start_token", pa.int64()), ("n_tokens", pa.int32()), ("used_tokens", pa.int32()), ("sources", pa.list_(pa.string())), ("conflict", pa.bool_())])

    def run(t: pa.Table) -> pa.Table:
        cap, shard, name = t["capacity_tokens"][0].as_py(), t["shard"][0].as_py(), t["window_name"][0].as_py()
        t = t.sort_by([("doc_id", "ascending"), ("part_no", "ascending"), ("row", "ascending")])
        names = sorted({s or "" for s in t["source"].unique().to_pylist()})
        codes = {s: 1 << i for i, s in enumerate(names)}
        clusters = np.where(t["cluster"].is_null().to_numpy(), -1, np.abs(t["cluster"].fill_null(0).to_numpy() >> 1))
        where, clash, fill, seen = best_fit(t["n_tokens"].to_pylist(), clusters.tolist(), [codes[s or ""] for s in t["source"].to_pylist()], cap, forbid)
        sources = {m: [s for s, c in codes.items() if m & c] for m in set(seen)}
        return pa.table(
            [t["window_name"], t["capacity_tokens"].cast(pa.int32()), pa.array([f"{name}-{shard}-{b}" for b in where]), t["doc_id"], t["part_no"].cast(pa.int32()), t["start_token"].cast(pa.int64()), t["n_tokens"].cast(pa.int32()), pa.array([fill[b] for b in where], pa.int32()), pa.array([sources[seen[b]] for b in where], pa.list_(pa.string())), pa.array(clash, pa.bool_())],
            schema=schema,
        )

    return run


OUT = "window_name string, capacity_tokens int, container_id string, doc_id long, part_no int, start_token long, n_tokens int, used_tokens int, sources array<string>, conflict boolean"


def pack(items: DataFrame, windows: DataFrame, conflicts: str = "avoid", shard_items: int = SHARD_ITEMS) -> DataFrame:
    """Assigns (doc_id, n_tokens, source, cluster) to containers of each window's capacity.

    One row for every text and window, or for every part of a text that alone exceeds the capacity:
    full containers first, the remainder is packed like any text. Texts of no tokens need no
    container and come out with a null ``container_id``. Windows without a positive capacity are
    left out, more than ``MOST_WINDOWS`` refused. Repeated ids and repeated rows are packed each; a
    null cluster conflicts with nothing. ``conflict`` marks a text whose container already held one of its
    cluster. Containers are named by what is in them or by their shard, the same at any partitioning.
    """
    of = ["doc_id", "n", "source", "cluster"]
    items = items.select("doc_id", F.coalesce("n_tokens", F.lit(0)).cast("int").alias("n"), "source", "cluster").groupBy(*of).count()
    items = items.select(*of, F.explode(F.sequence(F.lit(1), F.col("count"))).alias("copy")).withColumn("row", F.xxhash64(*of, "copy"))
    # the few windows become literals: a row of them for every capacity
    wins = [(r["window_name"], int(r["capacity_tokens"])) for r in windows.select("window_name", "capacity_tokens").filter("capacity_tokens > 0").distinct().orderBy("capacity_tokens").limit(MOST_WINDOWS + 1).collect()]
    if len(wins) > MOST_WINDOWS:
        raise ValueError(f"more than {MOST_WINDOWS} windows")
    if not wins:
        return items.sparkSession.createDataFrame([], OUT)
    w = F.explode(F.array(*[F.struct(F.lit(a).alias("window_name"), F.lit(c).alias("capacity_tokens")) for a, c in wins])).alias("w")
    all_ = items.select("*", w).select("doc_id", "n", "source", "cluster", "row", "w.*")
    cap, full = F.col("capacity_tokens"), F.floor(F.col("n") / F.col("capacity_tokens")).cast("int")
    cols = ["window_name", "capacity_tokens", "doc_id"]
    empty = all_.filter("n = 0").select(*cols[:2], F.lit(None).cast("string").alias("container_id"), "doc_id", F.lit(0).alias("part_no"), F.lit(0).cast("long").alias("start_token"), F.lit(0).alias("n_tokens"), F.lit(0).alias("used_tokens"), F.array().cast("array<string>").alias("sources"), F.lit(False).alias("conflict"))
    whole = all_.filter(F.col("n") >= cap).select(*cols, "source", F.explode(F.sequence(F.lit(0), full - 1)).alias("part_no"), F.hex("row").alias("k"))
    whole = whole.select(*cols[:2], F.concat_ws("-", "window_name", F.lit("full"), "k", "part_no").alias("container_id"), "doc_id", "part_no", (F.col("part_no").cast("long") * cap).alias("start_token"), cap.alias("n_tokens"), cap.alias("used_tokens"), F.array(F.coalesce("source", F.lit(""))).alias("sources"), F.lit(False).alias("conflict"))
    rest = all_.filter(F.col("n") % cap > 0).select(*cols, "source", "cluster", "row", full.alias("part_no"), (full.cast("long") * cap).alias("start_token"), (F.col("n") % cap).cast("int").alias("n_tokens"))
    total = items.filter("n > 0").count()
    shard = F.pmod(F.xxhash64("doc_id", "row"), F.lit(max(1, -(-total // shard_items)))).alias("shard")
    packed = rest.select("*", shard).groupBy("window_name", "shard").applyInArrow(_pack(conflicts == "forbid"), OUT)
    return packed.unionByName(whole).unionByName(empty)


def containers(docs: DataFrame, windows: DataFrame, vocabulary: str | None = None, conflicts: str = "avoid") -> DataFrame:
    """pack() of the texts of documents, each as long as its token ids; copies of a text form a cluster."""
    cluster = F.xxhash64(F.lower(F.regexp_replace(F.trim("text"), r"\s+", " ")))
    item = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.when(F.col("text").isNotNull(), cluster).alias("cluster"))
    ids = encode(docs.select(item.alias("item"), "text"), vocabulary, id_col="item", id_type="struct<doc_id:bigint,source:string,cluster:bigint>")
    items = materialize(ids.select("doc_id.*", F.size("ids").alias("n_tokens")), "items")
    return pack(items, windows, conflicts)


def fill_report(assigned: DataFrame) -> DataFrame:
    """(window_name, capacity_tokens, containers, tokens, unused_tokens, fill, texts, conflicts).

    ``conflicts`` are texts or parts of texts whose container already held a copy of them.
    """
    boxes = assigned.filter("container_id is not null").groupBy("window_name", "capacity_tokens", "container_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("texts"), F.sum(F.col("conflict").cast("long")).alias("conflicts"))
    agg = boxes.groupBy("window_name", "capacity_tokens").agg(F.count("*").alias("containers"), F.sum("n").alias("tokens"), F.sum("texts").alias("texts"), F.sum("conflicts").alias("conflicts"))
    room = F.col("containers") * F.col("capacity_tokens")
    return agg.select("window_name", "capacity_tokens", "containers", "tokens", (room - F.col("tokens")).alias("unused_tokens"), F.round(F.col("tokens") / room, 6).alias("fill"), "texts", "conflicts")

"""Deduplicating new batches against all history (problem 1), on an incremental inverted index.

A record is a set of tokens: its normalized path is one, its vector gives the families it reaches
and, if it is near no pivot, its nearest pivots (see ``permutation``). Pivots are ordered by how
rare they are in the sample of the history that the index is fitted on; vectors that may be within
the threshold share at least ``overlap`` of their ``prefix`` nearest pivots, so only the
``prefix - overlap + 1`` rarest are posted and probed. Postings (token, id, order of pivots) are a
table bucketed by token.

A batch is probed by joining its tokens to the postings of the same buckets, which are not moved;
buckets that the batch has no token of are not read. Candidates must have sets long enough to
overlap, share a family or ``overlap`` pivots, and be within a footrule; then the cosine is verified
on the vectors, looked up by key in those parts of the store that hold candidates. Decisions
inside the batch follow in rounds, and only accepted rows append postings.

The index lies under ``path``: the fitted pivots, the postings, the keys. ``HistoryIndex.open`` goes
on with it in another session. Buckets are doubled when the postings outgrow them, so what one
task holds stays bounded and a row is moved a constant number of times on average.

Exact copies of a vector share one key, so a group of copies costs a row each, not a pair each.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm.names import same_file_key
from framelake.llm.permutation import IndexParams, Pivots, fit_pivots, footrule, permutations, slices, stage, words
from framelake.llm.vectors import exact_cos, unit, unpack
from framelake.session import materialize, scratch_path

PARAMS = IndexParams(prefix=12, near=0.5, reach=0.3, slack=6)
PATH_SALT, VEC_SALT, PIVOT_BASE = 101, 102, 1 << 20
POSTINGS = "token bigint, vkey bigint, sketch binary, top array<smallint>, bucket int"


def _path_keys(path: pd.Series) -> pd.Series:
    return path.map(same_file_key, na_action="ignore")


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many pivots the prefixes of each pair of rows share; -1 pads short ones."""
    return ((a[:, :, None] == b[:, None, :]) & (a[:, :, None] >= 0)).sum(axis=(1, 2))


def _prefixes(col: pa.ChunkedArray, width: int) -> np.ndarray:
    col = col.combine_chunks()
    out = np.full((len(col), width), -1, dtype=np.int16)
    off = col.offsets.to_numpy()
    n = np.diff(off)
    out[np.arange(width) < n[:, None]] = col.values.to_numpy()[off[0] : off[-1]] if len(col) else []
    return out


def _near_keys(cut: int, overlap: int, width: int):
    """Pairs of a bucket's new keys with its old ones and with each other, within length, overlap and footrule."""

    def run(new: pa.Table, old: pa.Table) -> pa.Table:
        out: list[np.ndarray] = []
        if new.num_rows:
            nk, nt, ns, np_ = new["vkey"].to_numpy(), new["token"].to_numpy(), words(new["sketch"]), _prefixes(new["top"], width)
            home = np.flatnonzero(new["home"].to_numpy(zero_copy_only=False))  # each row meets the others of its batch at one salt
            met = np.isin(old["token"].to_numpy(), nt)
            old = old.filter(pa.array(met))
            ok, ot, os_, op = old["vkey"].to_numpy(), old["token"].to_numpy(), words(old["sketch"]), _prefixes(old["top"], width)
            order, mates = np.argsort(ot, kind="stable"), home[np.argsort(nt[home], kind="stable")]
            for at in slices(nt):
                token = nt[at[0]]
                by_pivot = token >> 20 >= PIVOT_BASE
                if by_pivot:  # sets that are too short cannot overlap enough
                    at = at[(np_[at] >= 0).sum(axis=1) >= overlap]
                lo, hi = np.searchsorted(ot[order], [token, token + 1])
                before = order[lo:hi]
                lo, hi = np.searchsorted(nt[mates], [token, token + 1])
                beside = mates[lo:hi]
                for keys, codes, sets in ((ok[before], os_[before], op[before]), (nk[beside], ns[beside], np_[beside])):
                    for s in range(0, len(at), 256):
                        left = at[s : s + 256]
                        i, j = np.nonzero(footrule(ns[left], codes) <= cut)
                        m = nk[left[i]] != keys[j]
                        if by_pivot:
                            m[m] = _shared(np_[left[i[m]]], sets[j[m]]) >= overlap
                        out.append(np.stack([nk[left[i[m]]], keys[j[m]]], axis=1))
        pairs = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), dtype=np.int64)
        return pa.table({"key": pa.array(pairs[:, 0]), "other": pa.array(pairs[:, 1])})

    return run


def _verify(threshold: float, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                c = exact_cos(unit(unpack(b.column(2), dim)), unit(unpack(b.column(3), dim)))
                yield pa.RecordBatch.from_arrays([x.filter(pa.array(c > threshold)) for x in b.columns[:2]], names=["key", "other"])

    return run


class HistoryIndex:
    """Accepts batches one after another; keeps what it needs under ``path`` (default: the shared scratch folder).

    ``threshold`` is the cosine above which two records are repeats. Rows with a null path and no
    usable vector match nothing and are accepted. Ids must be unique. A delivery is not a
    transaction: one that failed half way must go to a copy of the index made before.
    """

    def __init__(self, spark: SparkSession, threshold: float = 0.95, overlap: int = 3, bucket_rows: int = 200_000, salt_rows: int = 20_000, params: IndexParams = PARAMS, path: str | None = None):
        self.spark, self.threshold, self.overlap = spark, threshold, overlap
        self.bucket_rows, self.salt_rows, self.p = bucket_rows, salt_rows, params
        self.path = path or scratch_path(spark, "history")
        self.pivots: Pivots | None = None
        self.rank = np.zeros(0, dtype=int)
        self.counts: dict[int, int] = {}
        self.buckets = self.generation = 0

    # -- the index as files -----------------------------------------------------------------
    @property
    def name(self) -> str:
        return f"framelake_postings_{zlib.crc32(self.path.encode()):08x}_{self.generation}"

    def _save_model(self) -> None:
        pv, f = self.pivots, io.BytesIO()
        np.savez(f, x=pv.x, family=pv.family, code=pv.code, centre=pv.centre, rank=self.rank, bounds=np.array([pv.prefix, pv.reach, pv.max_footrule, self.threshold, self.overlap, self.bucket_rows, self.salt_rows], dtype=float))
        self.spark.createDataFrame([(bytearray(f.getvalue()),)], "model binary").coalesce(1).write.parquet(f"{self.path}/model")

    def _begin(self, buckets: int, generation: int) -> None:
        """A table of postings of so many buckets; the highest generation is the one in use."""
        self.buckets, self.generation = buckets, generation
        self._register()
        self.spark.createDataFrame([(generation, buckets)], "generation int, buckets int").coalesce(1).write.mode("append").parquet(f"{self.path}/generations")

    def _register(self) -> None:
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({POSTINGS}) USING parquet CLUSTERED BY (bucket) INTO {self.buckets} BUCKETS LOCATION '{self.path}/postings-{self.generation}'")

    @classmethod
    def open(cls, spark: SparkSession, path: str, params: IndexParams = PARAMS) -> HistoryIndex:
        """The index that lies under ``path``, to be gone on with."""
        with np.load(io.BytesIO(bytes(spark.read.parquet(f"{path}/model").first()[0]))) as z:
            prefix, reach, cut, threshold, overlap, bucket_rows, salt_rows = z["bounds"]
            ix = cls(spark, float(threshold), int(overlap), int(bucket_rows), int(salt_rows), params, path)
            ix.pivots, ix.rank = Pivots(z["x"], z["family"], z["code"], z["centre"], int(prefix), float(reach), int(cut)), z["rank"]
        ix.generation, ix.buckets = spark.read.parquet(f"{path}/generations").orderBy(F.desc("generation")).first()
        ix._register()
        ix.counts = {r[0]: r[1] for r in spark.table(ix.name).groupBy(F.shiftright("token", 20)).count().collect()}
        return ix

    def close(self) -> None:
        """Forgets the table in the session's catalogue; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    # -- tokens ---------------------------------------------------------------------------
    def fit(self, history: DataFrame) -> None:
        """Pivots from a bounded sample of the history, ranked by how rarely the sample is near them."""
        self.pivots = fit_pivots(history, self.p, self.threshold)
        x = self.pivots.x
        self.rank = np.zeros(len(x), dtype=int)
        if len(x):
            n = np.zeros(len(x), dtype=int)
            for s in range(0, len(x), 1024):
                n += np.bincount(permutations(x[s : s + 1024] @ x.T, self.pivots.prefix).ravel(), minlength=len(x))
            self.rank[np.lexsort((np.arange(len(x)), n))] = np.arange(len(x))

    def represent(self, df: DataFrame, keep: list[str]) -> tuple[DataFrame, DataFrame]:
        """Vectors (row_id, vkey, what tokens are made of, packed) and paths (row_id, pkey) of a table, both narrow."""
        vec = stage(df, self.pivots, self.p, keep=keep, rank=self.rank).withColumn("vkey", F.xxhash64("packed", F.lit(VEC_SALT)))
        pkey = F.pandas_udf(_path_keys, "string")(F.col("kept_path"))
        paths = df.select("row_id", *keep, pkey.alias("p")).select("row_id", *keep, F.when(F.col("p").isNotNull(), F.xxhash64("p", F.lit(PATH_SALT))).alias("pkey"))
        return vec, paths

    def _all_tokens(self) -> Column:
        rarest = F.slice("top", 1, max(1, self.pivots.prefix - self.overlap + 1))
        return F.concat(F.col("families").cast("array<bigint>"), F.transform(rarest, lambda x: x.cast("long") + PIVOT_BASE))

    def weigh(self, vec: DataFrame) -> dict[int, int]:
        """Counts postings by token, of which there are at most twice as many as pivots; returns those of ``vec``."""
        got = {r[0]: r[1] for r in vec.select(F.explode(self._all_tokens()).alias("t")).groupBy("t").count().collect()}
        for t, n in got.items():
            self.counts[t] = self.counts.get(t, 0) + n
        return got

    def _salts(self, token: int) -> int:
        return -(-self.counts.get(token, 1) // self.salt_rows)

    def tokens(self, vec: DataFrame, probe: bool) -> DataFrame:
        """(token, vkey, sketch, top, bucket): one row for every family and every rare pivot of a vector.

        Tokens of more than ``salt_rows`` postings are salted: a posting goes to one salt, a probe
        to all that there are by now, and is at ``home`` in one of them.
        """
        t = vec.select("vkey", "sketch", "top", F.explode(self._all_tokens()).alias("t")).dropDuplicates(["vkey", "t"])
        hot = {k: self._salts(k) for k, n in self.counts.items() if n > self.salt_rows}
        n = F.coalesce(F.create_map(*[F.lit(int(x)) for kv in hot.items() for x in kv])[F.col("t")], F.lit(1)) if hot else F.lit(1)
        own = F.pmod(F.xxhash64("vkey"), n).cast("int")
        t = t.withColumn("own", own).withColumn("salt", F.explode(F.sequence(F.lit(0), n - 1)) if probe and hot else own)
        token = F.shiftleft(F.col("t"), 20).bitwiseOR(F.col("salt").cast("long"))
        out = t.select(token.alias("token"), "vkey", "sketch", "top", self._bucket(token).alias("bucket"), (F.col("own") == F.col("salt")).alias("home"))
        return out if probe else out.drop("home")

    def _bucket(self, token: Column) -> Column:
        return F.pmod(F.shiftright(token, 20) + token.bitwiseAND((1 << 20) - 1), F.lit(self.buckets)).cast("int")

    # -- batches --------------------------------------------------------------------------
    def begin(self, vec: DataFrame, paths: DataFrame) -> None:
        """Makes the index of a first delivery, all of which is accepted."""
        self._save_model()
        self.weigh(vec)
        self._begin(max(24, -(-sum(self.counts.values()) // self.bucket_rows)), 0)
        self.append(vec, paths)

    def append(self, vec: DataFrame, paths: DataFrame) -> None:
        """Postings of accepted rows, and their keys: of paths, and of vectors with the vector."""
        self._post(self.tokens(vec, probe=False))
        keys = vec.select(F.col("vkey").alias("key"), "packed").unionByName(paths.filter("pkey is not null").select(F.col("pkey").alias("key"), F.lit(None).cast("binary").alias("packed")))
        keys = keys.withColumn("part", self._part(F.col("key"))).repartition(self.KEY_PARTS // 4, "part")
        keys.write.mode("append").partitionBy("part").option("compression", "zstd").parquet(f"{self.path}/keys")

    def _post(self, postings: DataFrame) -> None:
        postings.repartition(self.buckets, "bucket").write.mode("append").format("parquet").bucketBy(self.buckets, "bucket").option("path", f"{self.path}/postings-{self.generation}").saveAsTable(self.name)

    def _grow(self) -> None:
        """Twice the buckets, once they hold twice what they should."""
        if sum(self.counts.values()) <= 2 * self.bucket_rows * self.buckets:
            return
        old, name = self.spark.table(self.name), self.name
        self._begin(2 * self.buckets, self.generation + 1)
        self._post(old.withColumn("bucket", self._bucket(F.col("token"))))
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    KEY_PARTS = 32

    def _part(self, key: Column) -> Column:
        return F.pmod(key, F.lit(self.KEY_PARTS)).cast("int")

    def lookup(self, wanted: DataFrame, few: bool) -> DataFrame:
        """(key, packed) of the wanted keys that the history has; of few keys, parts without any are not read."""
        keys = self.spark.read.schema("key long, packed binary, part int").parquet(f"{self.path}/keys")
        if few:
            keys = keys.filter(F.col("part").isin([r[0] for r in wanted.select(self._part(F.col("key")).alias("part")).distinct().collect()]))
        return keys.select("key", "packed").join(wanted, "key", "left_semi").dropDuplicates(["key"])

    def candidates(self, vec: DataFrame, used: list[int]) -> DataFrame:
        """(key, other): keys of the batch and keys of the history or the batch that may be within the threshold.

        ``used`` are the tokens of the batch; buckets of other tokens are not read.
        """
        new, old = self.tokens(vec, probe=True), self.spark.table(self.name)
        buckets = {(t + s) % self.buckets for t in used for s in range(self._salts(t))}
        if len(buckets) < self.buckets:
            old = old.filter(F.col("bucket").isin(sorted(buckets)))
        run = _near_keys(self.pivots.max_footrule, self.overlap, self.pivots.prefix)
        return new.groupBy("bucket").cogroup(old.groupBy("bucket")).applyInArrow(run, "key long, other long").distinct()

    def ingest(self, vec: DataFrame, paths: DataFrame) -> DataFrame:
        """(row_id): the repeats of what is delivered; everything else is appended to the history.

        ``paths`` and ``vec`` carry ``b``, the delivery; rows are taken by (b, row_id). A row is a
        repeat if an accepted row, of the history or earlier in the delivery, has its path or its
        vector; repeats match nothing.
        """
        used = self.weigh(vec)
        few = sum(used.values()) < 8 * self.KEY_PARTS
        cand = materialize(self.candidates(vec, list(used)), "candidates")
        pos = F.struct("b", "row_id").alias("pos")
        own = paths.filter("pkey is not null").select(pos, F.col("pkey").alias("key")).unionByName(vec.select(pos, F.col("vkey").alias("key"))).withColumn("own", F.lit(True))
        wanted = own.select("key").union(cand.select("other")).distinct()
        known = materialize(self.lookup(materialize(wanted, "wanted") if few else wanted, few), "known")
        mine = vec.select(F.col("vkey").alias("key"), "packed").dropDuplicates(["key"])
        theirs = known.filter("packed is not null").unionByName(mine).dropDuplicates(["key"])
        both = cand.join(mine.withColumnRenamed("packed", "a"), "key").join(theirs.select(F.col("key").alias("other"), F.col("packed").alias("b")), "other")
        close = both.select("key", "other", "a", "b").mapInArrow(_verify(self.threshold, self.p.dim), "key long, other long")
        others = vec.select(pos, F.col("vkey").alias("key")).join(close, "key").select("pos", F.col("other").alias("key"), F.lit(False).alias("own"))
        watch = materialize(own.unionByName(others).join(known.select("key", F.lit(True).alias("known")), "key", "left"), "watch")
        repeats = [watch.filter("known").select("pos").distinct()]
        left = watch.join(repeats[0], "pos", "left_anti").select("pos", "key", "own")
        # only rows that share a key with another row of the delivery are in question
        shared = left.groupBy("key").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi")).filter("lo <> hi").select("key")
        rows = left.join(shared, "key", "left_semi").select("pos").distinct()
        open_ = materialize(left.join(rows, "pos", "left_semi"), "open")
        # rounds: a row falls to an earlier accepted row, and is accepted once no earlier row is open
        while not open_.isEmpty():
            done = materialize(self._round(open_), "decided")
            repeats.append(done.filter("repeat").select("pos"))
            open_ = materialize(open_.join(done, "pos", "left_anti"), "open")
        out = materialize(reduce(DataFrame.unionByName, repeats).select("pos.row_id"), "repeats")
        self._grow()
        self.append(vec.join(out, "row_id", "left_anti"), paths.join(out, "row_id", "left_anti"))
        return out

    @staticmethod
    def _round(open_: DataFrame) -> DataFrame:
        """(pos, repeat): rows without an earlier open row are accepted, those with an earlier one of these fall."""
        mine = open_.filter("own").select("pos", "key")
        first = mine.groupBy("key").agg(F.min("pos").alias("first"))
        accepted = open_.join(first, "key").groupBy("pos").agg(F.min("first").alias("first")).filter("first = pos").select("pos")
        taken = mine.join(accepted, "pos").groupBy("key").agg(F.min("pos").alias("first"))
        falls = open_.join(taken, "key").filter("first < pos").select("pos", F.lit(True).alias("repeat")).distinct()
        return accepted.select("pos", F.lit(False).alias("repeat")).unionByName(falls)


def repeats_by_batch(df: DataFrame, threshold: float = 0.95, batch_col: str = "batch_no", index: HistoryIndex | None = None, least_rows: int = 20_000) -> DataFrame:
    """(row_id): rows of later batches that repeat an accepted row; batch 0 is the history.

    Batches are delivered in ascending order; those of fewer than ``least_rows`` rows are delivered with
    the next ones, which changes the number of steps and nothing else. Rows of a null batch are not
    delivered. Without usable vectors in batch 0 the index is fitted on the earliest batch that has them. An ``index`` that
    already has a history goes on with it: then batch 0 is a delivery like any other. An empty
    table, or one of batch 0 alone, gives no rows. Other columns are not read.
    """
    spark = df.sparkSession
    ix = index or HistoryIndex(spark, threshold)
    src = df.select("row_id", F.col(batch_col).alias("b"), "kept_path", "embedding").filter("b is not null")
    fresh = ix.pivots is None
    if fresh:
        ix.fit(src.filter("b = 0"))
        if not len(ix.pivots.x):
            # the sample gave no pivots: it is taken from the usable vectors of the earliest batch that has any
            e, inf = F.col("embedding"), float("inf")
            good = src.filter((F.col("b") >= 0) & (F.size(e) == ix.p.dim) & F.forall(e, lambda v: F.coalesce(F.abs(v) < inf, F.lit(False))) & F.exists(e, lambda v: v != 0))
            earliest = good.agg(F.min("b")).first()[0]
            if earliest is not None:
                ix.fit(good.filter(F.col("b") == earliest))
    vec, paths = ix.represent(src, ["b"])
    vec, paths = materialize(vec, "vec", ["b"]), materialize(paths, "paths", ["b"])
    rows = [(r["b"], r["count"]) for r in paths.groupBy("b").count().orderBy("b").collect() if r["b"] >= (1 if fresh else 0)]
    if fresh:
        ix.begin(vec.filter("b = 0"), paths.filter("b = 0"))
    out, first, waiting = spark.createDataFrame([], "row_id long"), None, 0
    for k, (n, count) in enumerate(rows):
        first, waiting = n if first is None else first, waiting + count
        if waiting >= least_rows or k + 1 == len(rows):
            of = F.col("b").between(first, n)
            out = out.unionByName(ix.ingest(vec.filter(of), paths.filter(of)))
            first, waiting = None, 0
    ix.close()
    return out

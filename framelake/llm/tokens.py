"""Encoding of a corpus with a public byte-level BPE (problem 6).

Short texts are encoded where they are read. A text with a long run that the splitting pattern
leaves whole is cut: the run into leaves of ``leaf`` bytes, each its own row and so encoded in
parallel, then joined as a tree. At a join, a window of tokens on either side is encoded again
and grows until its outermost tokens are those of both sides; a sequence of tokens is the
encoding of its bytes if every two neighbours are, so the joined ids are exact.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=4)
def encoder(vocabulary: str) -> tuple[tiktoken.Encoding, regex.Pattern]:
    import public_tokenizers

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), regex.compile(public_tokenizers.PATTERN)


def join_ids(enc: tiktoken.Encoding, left: list[int], right: list[int], agree: int = 2) -> list[int]:
    """Ids of the concatenated bytes of two encoded sides."""
    if not left or not right:
        return left + right
    k = 4 + agree
    while True:
        a, b = left[-k:], right[:k]
        mid = enc._encode_single_piece(b"".join(enc.decode_single_token_bytes(t) for t in a + b))
        whole_a, whole_b = len(a) == len(left), len(b) == len(right)
        if (whole_a or mid[:agree] == a[:agree]) and (whole_b or mid[-agree:] == b[-agree:]):
            return left[: len(left) - len(a)] + mid + right[len(b) :]
        k *= 2


def join_tree(enc: tiktoken.Encoding, parts: list[list[int]]) -> list[int]:
    while len(parts) > 1:
        parts = [join_ids(enc, *parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0] if parts else []


def encode_tree(enc: tiktoken.Encoding, data: bytes, leaf: int) -> list[int]:
    """A run of bytes, by halves; what the distributed form computes."""
    return join_tree(enc, [enc._encode_single_piece(data[i : i + leaf]) for i in range(0, len(data), leaf)])


def _encode_short(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, _ = encoder(vocabulary)
        for b in batches:
            ids = [enc.encode_ordinary(t) if t else [] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return run


def _cut(vocabulary: str, leaf: int):
    """Pieces of the pattern as they are, several in a row; runs longer than a leaf in leaves."""
    names = ["row", "doc_id", "part", "leaf", "data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, pat = encoder(vocabulary)
        for b in batches:
            for row, doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                out: list[tuple] = []
                part, start, size = 0, 0, 0
                for m in pat.finditer(text):
                    long = (m.end() - m.start()) * 4 > leaf and len(m[0].encode()) > leaf
                    if (long or size >= 4 * leaf) and m.start() > start:
                        out.append((row, doc, part, -1, text[start : m.start()].encode()))
                        part, start, size = part + 1, m.start(), 0
                    size += m.end() - m.start()
                    if long:
                        run_ = m[0].encode()
                        out += [(row, doc, part, i // leaf, run_[i : i + leaf]) for i in range(0, len(run_), leaf)]
                        part, start, size = part + 1, m.end(), 0
                if start < len(text):
                    out.append((row, doc, part, -1, text[start:].encode()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), b.schema.field(1).type, pa.int32(), pa.int32(), pa.binary()))], names=names)

    return run


def _encode_parts(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, _ = encoder(vocabulary)
        for b in batches:
            ids = [enc.encode_ordinary(d.decode()) if n < 0 else enc._encode_single_piece(d) for n, d in zip(b.column(3).to_pylist(), b.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(ids, pa.list_(pa.int32()))], names=[*b.schema.names[:4], "ids"])

    return run


def _join_parts(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, _ = encoder(vocabulary)
        for b in batches:
            ids = []
            for parts in b.column(1).to_pylist():
                done, i = [], 0
                while i < len(parts):
                    j = i + 1
                    if parts[i]["leaf"] >= 0:
                        while j < len(parts) and parts[j]["part"] == parts[i]["part"]:
                            j += 1
                    done += join_tree(enc, [p["ids"] for p in parts[i:j]])
                    i = j
                ids.append(done)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return run


def encode(df: DataFrame, vocabulary: str | None = None, leaf: int = 4096, id_col: str = "doc_id", text_col: str = "text", id_type: str = "bigint") -> DataFrame:
    """(doc_id, ids): one row for every row of ``df``, repeated ids included.

    Null and empty texts give an empty list; blank texts are encoded as they are; names of special
    tokens are ordinary text. Texts are encoded whole, whatever their length. An empty table gives
    no rows; other columns are not read. ``id_type`` is the type of the ids, which may be a struct of
    what else a text is known by.
    """
    voc = vocabulary or default_vocabulary()
    src = df.select(F.col(id_col).cast(id_type).alias("doc_id"), F.col(text_col).alias("text"))
    long = F.coalesce(F.length("text"), F.lit(0)) > leaf
    short = src.filter(~long).mapInArrow(_encode_short(voc), f"doc_id {id_type}, ids array<int>")
    rows = src.filter(long).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    parts = rows.mapInArrow(_cut(voc, leaf), f"row long, doc_id {id_type}, part int, leaf int, data binary")
    done = parts.repartition(F.col("row"), F.col("part"), F.col("leaf")).mapInArrow(_encode_parts(voc), f"row long, doc_id {id_type}, part int, leaf int, ids array<int>")
    whole = done.groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(F.struct("part", "leaf", "ids"))).alias("parts"))
    joined = whole.select("doc_id", "parts").mapInArrow(_join_parts(voc), f"doc_id {id_type}, ids array<int>")
    return short.unionByName(joined)

"""Garbled text from a wrong character encoding (problem 8).

1. Every pair of adjacent characters with one beyond ASCII is counted over all documents, apart
   in runs that would decode as UTF-8, or as Japanese or Cyrillic words, under an inverse mapping
   and outside of them. Counts are taken relative to the size of the corpus.
2. Pairs are scored by their pointwise mutual information outside such runs; what the pair falls
   short of ``floor`` counts for a run, pairs of plain text against it. The maximum-scoring
   segments are the improbable runs of a text.
3. Only inside those runs inverse mappings are tried: the characters go back to the bytes of the
   encoding they were read with, and are read as the encoding they were written in, again and
   again while it helps. A reading is taken if the corpus finds it more likely than the text
   by ``gain`` nats; single-byte readings, which always succeed, need ``gain_bytes``.
4. Replacement characters are damage that nothing restores.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.session import materialize

# Encodings by which text is mistaken, as Python names them.
READ_AS_UTF8_BYTES = ("cp1252", "latin-1", "cp1250", "cp1251", "mac_roman", "cp437", "cp850", "cp852", "cp866", "koi8_r", "iso8859_2", "iso8859_15", "cp1254", "cp1253")
SINGLE_BYTE = (("cp1252", "cp1251"), ("latin-1", "cp1251"), ("cp1252", "koi8_r"), ("latin-1", "koi8_r"), ("koi8_r", "cp1251"), ("cp1251", "koi8_r"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("mac_roman", "cp1251"), ("cp1250", "cp1251"), ("cp437", "cp866"), ("cp437", "cp1251"), ("cp850", "cp1251"), ("cp1252", "cp866"), ("cp1252", "iso8859_5"), ("mac_cyrillic", "cp1251"), ("cp1251", "mac_cyrillic"), ("cp1252", "shift_jis"), ("latin-1", "shift_jis"), ("cp1252", "euc_jp"), ("latin-1", "euc_jp"), ("mac_roman", "shift_jis"), ("cp437", "shift_jis"), ("cp1252", "cp1250"), ("latin-1", "iso8859_2"), ("cp1250", "cp1252"), ("iso8859_2", "latin-1"), ("mac_roman", "cp1252"), ("cp1252", "mac_roman"), ("cp437", "cp1252"), ("cp1252", "cp437"), ("cp850", "cp1252"), ("cp1252", "cp850"))
LOST = "�"

_BEYOND = re.compile(r"[^\x00-\x7f]+")
_WORD = re.compile(r"\w", re.UNICODE)


@lru_cache(maxsize=64)
def byte_table(encoding: str) -> dict[int, str]:
    """Bytes of the characters of an encoding; undefined bytes are read as controls, as decoders of files do."""
    out = {}
    for b in range(256):
        try:
            ch = bytes([b]).decode(encoding)
        except UnicodeDecodeError:
            ch = chr(b)
        out.setdefault(ord(ch), chr(b))
    if encoding == "cp1252":
        for b in range(128, 160):
            out.setdefault(b, chr(b))
    return out


def to_bytes(text: str, encoding: str) -> bytes | None:
    table = byte_table(encoding)
    try:
        return "".join([table[ord(c)] for c in text]).encode("latin-1")
    except KeyError:
        return None


def as_utf8(text: str, encoding: str) -> str | None:
    raw = to_bytes(text, encoding)
    if raw is None:
        return None
    try:
        got = raw.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return got if len(got) < len(text) else None


@lru_cache(maxsize=1 << 14)
def _readings(s: str) -> tuple[str, ...]:
    """What a run is as UTF-8, under each inverse mapping that gives any."""
    return tuple(dict.fromkeys(u for e in READ_AS_UTF8_BYTES if (u := as_utf8(s, e)) is not None))


def invertible_spans(text: str) -> list[tuple[int, int]]:
    """Runs beyond ASCII that are UTF-8 under some inverse mapping."""
    return [m.span() for m in _BEYOND.finditer(text) if len(m[0]) > 1 and _readings(m[0])]


_DAMAGED = re.compile(r"(?:[^\x00-\x7f][@-~]?){4,}")
_JAPANESE = re.compile(r"[\u3000-\u30ff\u4e00-\u9fff\uff00-\uff9f@-~]+")
_CYRILLIC = re.compile(r"[А-ЯЁ]?[а-яё]{3,}")


@lru_cache(maxsize=1 << 14)
def _misread(s: str) -> bool:
    """Whether some inverse mapping turns western letters into Japanese with kana, or into a Cyrillic word."""
    for wrong, right in SINGLE_BYTE:
        if right in ("shift_jis", "euc_jp") or (right in ("cp1251", "koi8_r", "cp866", "iso8859_5") and wrong in ("cp1252", "latin-1", "cp1250", "mac_roman", "cp437", "cp850")):
            raw = to_bytes(s, wrong)
            try:
                u = raw.decode(right) if raw else ""
            except UnicodeDecodeError:
                continue
            if right in ("shift_jis", "euc_jp"):
                if _JAPANESE.fullmatch(u) and sum("\u3041" <= c <= "\u30ff" for c in u) >= 2:
                    return True
            elif _CYRILLIC.fullmatch(u):
                return True
    return False


def misread_spans(text: str) -> list[tuple[int, int]]:
    """Runs that are words of another script under some inverse mapping; ASCII trail bytes are part of them."""
    out = []
    for m in _DAMAGED.finditer(text):
        if _misread(m[0]):
            out.append(m.span())
        elif not m[0][-1] > "\x7f" and _misread(m[0][:-1]):
            out.append((m.start(), m.end() - 1))
        else:
            out += [(m.start() + k.start(), m.start() + k.end()) for k in _BEYOND.finditer(m[0]) if len(k[0]) > 3 and _misread(k[0])]
    return out


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)


FLUSH = 1 << 20  # characters that are counted at once


def _counted(keys: list[np.ndarray], outside: list[np.ndarray]) -> pa.RecordBatch:
    k, o = np.concatenate(keys), np.concatenate(outside)
    u, inv = np.unique(k, return_inverse=True)
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(np.bincount(inv, minlength=len(u)).astype(np.int64)), pa.array(np.bincount(inv, weights=o, minlength=len(u)).astype(np.int64))], names=["pair", "n", "outside"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys, outside, size = [], [], 0
        for text in b.column(0).to_pylist():
            if not text:
                continue
            c = np.concatenate([[10], _codes(text), [10]])
            k = c[:-1] << 21 | c[1:]
            use = (c[:-1] > 127) | (c[1:] > 127)
            free = np.ones(len(k), dtype=bool)
            if use.any():
                for lo, hi in [*invertible_spans(text), *misread_spans(text)]:
                    free[lo : hi + 1] = False
            # pairs inside ASCII are kept by their first character only
            keys.append(np.where(use, k, c[:-1] << 21))
            outside.append(free)
            size += len(k)
            if size > FLUSH:
                yield _counted(keys, outside)
                keys, outside, size = [], [], 0
        if keys:
            yield _counted(keys, outside)


def pair_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(pair, n, outside) over all documents; pair is first << 21 | second, second 0 inside ASCII."""
    return docs.select(text_col).mapInArrow(_count, "pair long, n long, outside long").groupBy("pair").agg(F.sum("n").alias("n"), F.sum("outside").alias("outside"))


MEMO = 50_000  # texts of which a task remembers the likelihood or the reading
MOST_PAIRS = 8_000_000  # in the model that every task gets, 24 bytes each
REFERENCE = 5_000_000  # pairs; what "rare" means is fixed for a corpus of this size


class PairModel:
    """Pair statistics as sorted arrays; its size follows the alphabet, not the corpus.

    Counts of a larger corpus are brought to those of ``reference`` pairs, so what is rare is a
    share of the corpus, and a corpus repeated gives the same model.
    """

    def __init__(self, pair: np.ndarray, n: np.ndarray, outside: np.ndarray, reference: float = REFERENCE):
        o = np.argsort(pair)
        self.pair, self.n, self.outside = pair[o], n[o].astype(float), outside[o].astype(float)
        scale = max(1.0, self.n.sum() / reference)
        self.n, self.outside = self.n / scale, self.outside / scale
        self.total = max(1.0, self.n.sum())
        first, second = self.pair >> 21, self.pair & ((1 << 21) - 1)
        self.chars, inv = np.unique(np.concatenate([first, second]), return_inverse=True)
        self.c_first = np.bincount(inv[: len(first)], weights=self.n, minlength=len(self.chars))
        self.c_second = np.bincount(inv[len(first) :], weights=self.n, minlength=len(self.chars))
        # an ASCII character is as often second as it is first, but for pairs inside ASCII it is not kept
        ascii_ = self.chars < 128
        self.c_second[ascii_] = np.maximum(self.c_second, self.c_first)[ascii_]
        self.memo: dict[str, float] = {}
        self.runs: dict[tuple[str, str, str], tuple[str, float]] = {}

    def _find(self, table: np.ndarray, key: np.ndarray, value: np.ndarray) -> np.ndarray:
        if not len(table):
            return np.zeros(len(key))
        at = np.minimum(np.searchsorted(table, key), len(table) - 1)
        return np.where(table[at] == key, value[at], 0.0)

    def information(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the pairs beyond ASCII: position, pointwise mutual information and count outside of invertible runs."""
        a, b = codes[:-1], codes[1:]
        at = np.flatnonzero((a > 127) | (b > 127))
        a, b = a[at], b[at]
        n = self._find(self.pair, a << 21 | b, self.outside)
        ca, cb = self._find(self.chars, a, self.c_first), self._find(self.chars, b, self.c_second)
        return at, np.log((n + 0.05) * self.total / ((ca + 1.0) * (cb + 1.0))), n

    def likelihood(self, text: str) -> float:
        """Log likelihood of the pairs with a character beyond ASCII, given the first character."""
        got = self.memo.get(text)
        if got is None:  # the same words come again and again
            if len(self.memo) >= MEMO:
                self.memo.clear()
            got = self.memo[text] = self._likelihood(text)
        return got

    def _likelihood(self, text: str) -> float:
        c = _codes(text)
        a, b = c[:-1], c[1:]
        use = (a > 127) | (b > 127)
        a, b = a[use], b[use]
        n, ca = self._find(self.pair, a << 21 | b, self.n), self._find(self.chars, a, self.c_first)
        return float(np.log((n + 0.02) / (ca + 0.02 * 2000)).sum())


def segments(gain: np.ndarray) -> list[tuple[int, int]]:
    """All maximum-scoring segments (first, last position) of positive total, by Ruzzo and Tompa's method."""
    at = np.flatnonzero(gain > 0)
    if not len(at):
        return []
    through = np.cumsum(gain)
    stack: list[list[float]] = []  # left, right, score before, score through
    for i, before, after in zip(at.tolist(), (through[at] - gain[at]).tolist(), through[at].tolist()):
        cur = [i, i, before, after]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= cur[2]:
                j -= 1
            if j < 0 or stack[j][3] >= cur[3]:
                stack.append(cur)
                break
            cur = [stack[j][0], cur[1], stack[j][2], cur[3]]
            del stack[j:]
    return [(int(s[0]), int(s[1])) for s in stack]


def improbable_runs(text: str, m: PairModel, floor: float = 1.0, rare: int = 3) -> list[tuple[int, int]]:
    """Spans of text whose neighbours seldom meet elsewhere."""
    c = np.concatenate([[10], _codes(text), [10]])
    at, pmi, n = m.information(c)
    short = np.full(len(c) - 1, -0.5)
    # a pair falls short of the floor, or is too rare for its information to be trusted
    short[at] = np.where(n <= rare, np.maximum(floor - pmi, 1.0), floor - pmi)
    out: list[tuple[int, int]] = []
    for lo, hi in segments(np.clip(short, -3.0, 3.0)):
        lo, hi = max(0, lo - 1), min(len(text), hi + 1)
        while lo > 0 and ord(text[lo - 1]) > 127:
            lo -= 1
        # an ASCII character after one beyond ASCII may be the trail byte of a double-byte reading
        while lo > 1 and "@" <= text[lo - 1] <= "~" and ord(text[lo - 2]) > 127:
            lo -= 2
            while lo > 0 and ord(text[lo - 1]) > 127:
                lo -= 1
        while hi < len(text) and (ord(text[hi]) > 127 or (hi > lo and ord(text[hi - 1]) > 127 and "@" <= text[hi] <= "~")):
            hi += 1
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _restore_chunk(left: str, s: str, right: str, m: PairModel, gain: float, depth: int = 3) -> tuple[str, float]:
    """Best UTF-8 reading of characters beyond ASCII between their neighbours, and what it gains."""
    readings = _readings(s)
    best, won = s, 0.0
    if not readings:
        return best, won
    base = m.likelihood(left + s + right)
    for u in readings:
        v, more = u, 0.0
        if depth > 1:
            v = _BEYOND.sub(lambda k: _restore_chunk("", k[0], "", m, gain, depth - 1)[0], u)
        for cand in dict.fromkeys((u, v)):
            more = m.likelihood(left + cand + right) - base
            if more > won and LOST not in cand:
                best, won = cand, more
    return (best, won) if won >= gain else (s, 0.0)


def restore(text: str, m: PairModel, gain: float = 2.0, gain_bytes: float = 30.0) -> tuple[bool, str]:
    """Whether a text is damaged, and the text with every passage restored that can be."""
    if text.isascii():
        return False, text
    bad, out, at = LOST in text, [], 0
    for lo, hi in improbable_runs(text, m):
        run, pos, fixed = text[lo:hi], 0, []
        for k in _BEYOND.finditer(run):
            left = run[k.start() - 1] if k.start() else (text[lo - 1] if lo else "\n")
            right = run[k.end()] if k.end() < len(run) else (text[hi] if hi < len(text) else "\n")
            s, won = _restore_chunk(left, k[0], right, m, gain)
            bad |= won > 0
            fixed += [run[pos : k.start()], s]
            pos = k.end()
        whole = "".join([*fixed, run[pos:]])
        if whole == run:
            whole, won = _restore_bytes(text, lo, hi, m, gain_bytes)
            bad |= won > 0
        out += [text[at:lo], whole]
        at = hi
    return bad, "".join([*out, text[at:]])


def _restore_bytes(text: str, lo: int, hi: int, m: PairModel, gain: float) -> tuple[str, float]:
    key = (text[lo - 1 : lo] or "\n", text[lo:hi], text[hi : hi + 1] or "\n")
    got = m.runs.get(key)
    if got is None:
        if len(m.runs) >= MEMO:
            m.runs.clear()
        got = m.runs[key] = _best_bytes(*key, m, gain)
    return got


def _best_bytes(left: str, run: str, right: str, m: PairModel, gain: float) -> tuple[str, float]:
    base = m.likelihood(left + run + right)
    best, won = run, 0.0
    if -base < gain:  # no reading is likelier than certain
        return best, won
    for wrong, right_enc in SINGLE_BYTE:
        raw = to_bytes(run, wrong)
        if raw is None:
            continue
        try:
            u = raw.decode(right_enc)
        except UnicodeDecodeError:
            continue
        if any("\x80" <= c <= "\x9f" for c in u):
            continue
        more = m.likelihood(left + u + right) - base
        if more > won:
            best, won = u, more
    return (best, won) if won >= gain else (run, 0.0)


def _restored(bc):
    def run(text: pd.Series) -> pd.DataFrame:
        m = bc.value
        rows = [(False, None) if t is None else restore(t, m) for t in text]
        return pd.DataFrame(rows, columns=["garbled", "restored"])

    run.__annotations__ = {"text": pd.Series, "return": pd.DataFrame}
    return run


def find_garbled(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", reference: float = REFERENCE) -> DataFrame:
    """(doc_id, restored): documents with a garbled passage, with the text as far as it can be restored.

    Null, empty and blank texts and texts in ASCII are never cases. Repeated rows come out as often
    as they go in; an empty table gives no rows; other columns are not read. The pair table is
    broadcast: it has a row for every pair of characters that is not negligibly rare, and more than
    ``MOST_PAIRS`` are refused.
    """
    counts = materialize(pair_counts(docs, text_col), "pairs")
    total = counts.agg(F.sum("n")).first()[0] or 0
    # a pair of less than a hundredth of an occurrence in the reference corpus is one that was not seen
    counts = counts.filter(F.col("n") * F.lit(100.0 * reference) >= F.lit(float(total)))
    if counts.count() > MOST_PAIRS:
        raise ValueError(f"more than {MOST_PAIRS} pairs of characters")
    t = counts.toArrow()
    bc = docs.sparkSession.sparkContext.broadcast(PairModel(*[t[c].to_numpy() for c in ("pair", "n", "outside")], reference))
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter(F.col("text").rlike(r"[^\x00-\x7f]"))
    got = src.select("doc_id", F.pandas_udf(_restored(bc), "garbled boolean, restored string")("text").alias("r"))
    return got.filter("r.garbled").select("doc_id", F.col("r.restored").alias("restored"))

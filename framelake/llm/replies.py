"""Broken prompt and response pairs (problem 2).

Every reply gets at most one defect, tried in this order:

* ``empty``: nothing is left without field names, marks for "no value", punctuation and blanks;
* ``echo``: most character 5-grams of the reply are those of one of the prompt wordings, which
  bears case, layout, brackets and slips of the pen;
* ``refusal``: the reply, outside of quotations, speaks of its writer as unwilling or unable;
* ``language``: naive Bayes on character trigrams, fitted on labelled documents, finds another
  language than the one that the prompt expects by ``margin`` nats, outside of quotations;
* ``truncated``: a field or quotation stays open, or the last words of the text (of either field)
  seldom end a statement: their likelihood of an end is estimated from all replies, by the last
  two words, by the last one where those are rare.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Field names of the replies, marks for no value, and phrases of refusals.
FIELDS = ("setting", "activity")
OTHER_FIELDS = ("mood", "answer", "description", "caption", "response", "reply")
NO_VALUE = ("n/a", "na", "n.a", "none", "null", "nil", "nan", "undefined", "unknown", "empty", "missing", "no value", "no answer", "not available", "tbd", "blank")
LANGUAGES = ("en", "de", "fr", "es", "pt", "pl", "ru", "ja")

_REFUSAL = re.compile(
    r"\b(?:i|we)\b[^.!?]{0,40}?\b(?:can ?not|can['’]t|could not|couldn['’]t|may not|will not|won['’]t|am not able|am unable|are unable|must decline|have to decline|decline to|refuse to|prefer not|(?:would|['’]d) rather not|(?:don['’]t|do not) (?:have the ability|feel comfortable)|have to pass)\b"
    r"|\bno way for me to\b|\bnot possible for me to\b|\bmy (?:policies|policy|guidelines|apologies;)|\bagainst my\b|\bthis assistant\b|\bthis request can|\bnot something (?:i|we)\b|\bno (?:description|caption) can be given\b|\bas an? (?:ai|language) model\b"
    r"|\bunable to (?:assist|help|comply|answer)\b"
    # in a field, where whoever is in the picture may be unable too: only of answering, or of nothing that is named
    r"|(?:^|[:\[\n])\s*(?:(?:cannot|can not|can['’]t|unable to|not able to|not allowed to|declined? to|refused? to|prefer not to)\s+(?:say|tell|describe|identify|name|answer|respond|reply|assist|help|comply|provide|give|caption|comment|summari[sz]e|speculate|determine|recogni[sz]e|share|discuss|disclose|process|view|be (?:said|told|described|identified|named|answered|given|provided|determined|shared))\b"
    r"|(?:cannot|can not|can['’]t|unable|not able|not allowed|declined?|refused?|withheld|prefer not|no comment)\s*(?:[.,;!\]\n]|$))",
    re.I,
)
_QUOTED = re.compile(r"“[^”]*”|„[^“”]*[“”]|«[^»]*»|\"[^\"\n]*\"")
_FIELD = re.compile(r"(?:^|[\s,;{(*\-•>|#\"'])(" + "|".join(FIELDS + OTHER_FIELDS) + r")\b[\"'*_\s]*[:=：]", re.I)
_NAME = re.compile(r"\b(?:" + "|".join(FIELDS + OTHER_FIELDS) + r")\b[\"'*_\s]*[:=：]?", re.I)
_NONE = re.compile(r"(?<!\w)(?:" + "|".join(re.escape(x) for x in sorted(NO_VALUE, key=len, reverse=True)) + r")(?!\w)", re.I)
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|[.!?]+|\n|[^\w\s]")
_CLOSING = re.compile(r"[\"”“’'»)\]*\u200b]+(?=\W|$)")
_LETTERS = re.compile(r"[^\W\d_]+")


def is_empty(text: str | None) -> bool:
    """Nothing but blanks, invisible characters, punctuation, field names or marks for no value."""
    return text is None or not re.search(r"\w", _NONE.sub(" ", _NAME.sub(" ", text)).replace("_", " "))


def _grams(text: str, n: int = 5) -> set[str]:
    s = " ".join(_LETTERS.findall(text.casefold()))
    return {s[i : i + n] for i in range(len(s) - n + 1)}


class Echo:
    """Share of a reply's 5-grams in the nearest prompt wording, without bare field names."""

    def __init__(self, wordings: list[str], share: float = 0.6):
        self.grams, self.share = [_grams(_NAME.sub(" ", w)) for w in wordings], share

    def __call__(self, text: str) -> bool:
        g = _grams(_NAME.sub(" ", text))
        return bool(g) and max((len(g & w) for w in self.grams), default=0) >= self.share * len(g)


def unwrap(text: str) -> str:
    """Without quotation marks around the whole."""
    s = text.strip()
    for a, b in ("“”", '""', "„“", "„”", "«»"):
        if len(s) > 2 and s[0] == a and s[-1] == b and b not in (s[1:-1] if a == b else _QUOTED.sub("", s[1:-1])):
            return s[1:-1]
    return text


def is_refusal(text: str) -> bool:
    return bool(_REFUSAL.search(_QUOTED.sub(" ", text)))


def open_quotation(text: str) -> bool:
    """A quotation that is not closed; „ may be closed by “, which then opens nothing."""
    rest = _QUOTED.sub(" ", text)
    return any(q in rest for q in "“„«\"")


def parts(text: str) -> dict[str, str]:
    """Values by field name, last one wins; a value runs to the next field name."""
    m = list(_FIELD.finditer(text))
    return {a[1].lower(): text[a.end() : b.start(1) if b else len(text)] for a, b in zip(m, [*m[1:], None])}


def tail_keys(text: str) -> tuple[str | None, str | None]:
    """The last two words and the last word."""
    w = [x.casefold() for x in _WORD.findall(text)[-2:]]
    return (" ".join(w) if len(w) == 2 else None), (w[-1] if w else None)


def ends(text: str, lines: bool) -> dict[str, bool]:
    """The words and pairs of a text, and whether they end a statement in it.

    A statement ends at a full stop, with ``lines`` also at a line. The end of the text itself
    tells nothing, since it may be the break that is looked for.
    """
    out: dict[str, bool] = {}
    before = None
    t = _TOKEN.findall(_CLOSING.sub("", text.casefold()))
    for a, b in zip(t, t[1:]):
        if not a[0].isalnum():
            if a[0] not in ".!?\n":
                before = None
            continue
        end = b[0] in ".!?" or (lines and b == "\n")
        out[a] = out.get(a, False) or end
        if before:
            k = f"{before} {a}"
            out[k] = out.get(k, False) or end
        before = a
    return out


# -- languages --------------------------------------------------------------------------------
def _trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the trigrams of all texts and the text that each belongs to; digits and marks are blanks."""
    clean = [" " + " ".join(_LETTERS.findall(t.lower())) + " " for t in texts]
    size = np.fromiter((len(c) for c in clean), dtype=np.int64, count=len(clean))
    c = np.frombuffer("".join(clean).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    if len(c) < 3:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    code = c[:-2] << 42 | c[1:-1] << 21 | c[2:]
    own = np.repeat(np.arange(len(clean)), size)
    same = own[:-2] == own[2:]
    return code[same], own[:-2][same]


def _plain(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c)) if not text.isascii() else text


def _count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        of: dict[str, list[str]] = {}
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            # letters as they are and without marks, as careless writers drop them
            of.setdefault(lang, []).extend((text or "", _plain(text or "")))
        for lang, texts in of.items():
            for part in _by_size(texts):
                u, n = np.unique(_trigrams(part)[0], return_counts=True)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), LANGUAGES.index(lang))), pa.array(u), pa.array(n.astype(np.int64))], names=["lang", "code", "n"])


def _by_size(texts: list[str], most: int = 1 << 20) -> Iterator[list[str]]:
    """The texts in lists of about so many characters."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size > most:
            yield part
            part, size = [], 0
    if part:
        yield part


class LanguageModel:
    def __init__(self, lang: np.ndarray, code: np.ndarray, n: np.ndarray):
        self.codes, at = np.unique(code, return_inverse=True)
        table = np.zeros((len(self.codes) + 1, len(LANGUAGES)))
        np.add.at(table, (at, lang), n)
        total = table.sum(axis=0)
        self.log = np.log((table + 0.05) / (total + 0.05 * (len(self.codes) + 1)))

    def posteriors(self, texts: list[str]) -> np.ndarray:
        """Log likelihood of each text in each language."""
        code, own = _trigrams(texts)
        out = np.zeros((len(texts), len(LANGUAGES)))
        if len(code) and len(self.codes):
            at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            row = self.log[np.where(self.codes[at] == code, at, len(self.codes))]
            start = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            out[own[start]] = np.add.reduceat(row, start, axis=0)
        return out


def fit_languages(docs: DataFrame, max_rows: int = 20_000) -> LanguageModel:
    """Trigram counts of at most ``max_rows`` labelled documents, those of the smallest id hashes."""
    lab = F.lower(F.substring(F.trim("lang"), 1, 2))
    use = docs.filter(F.col("text").isNotNull() & lab.isin(*LANGUAGES)).select(F.xxhash64("doc_id").alias("h"), lab.alias("lang"), "text")
    last = use.select("h").orderBy("h").limit(max_rows).agg(F.max("h")).first()[0]
    counts = use.filter(F.col("h") <= F.lit(last)).select("lang", "text").mapInArrow(_count_trigrams, "lang long, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).filter("n > 1").toArrow()
    return LanguageModel(*(counts[c].to_numpy() for c in ("lang", "code", "n")))


MOST_WORDINGS = 10_000  # they go to every task


# -- the operator -------------------------------------------------------------------------------
JUDGED = "table_name string, rec_id long, field string, defect string, probes array<struct<k2:string,k1:string>>"


def _judge(bc, margin: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lm, prompts = bc.value
        echo = Echo([w for _, w, _ in prompts])
        # a wording expects the language that is named for it, else the one it is written in; a field those of all its wordings
        own = [LANGUAGES[i] for i in lm.posteriors([w for _, w, _ in prompts]).argmax(axis=1)]
        want: dict[str, set[int]] = {}
        for (f, _, e), o in zip(prompts, own):
            want.setdefault(f, set()).add(LANGUAGES.index(e or o))
        for b in batches:
            if not b.num_rows:
                continue
            fields, texts = b.column(2).to_pylist(), [t and unwrap(t) for t in b.column(3).to_pylist()]
            post = np.concatenate([lm.posteriors(p) for p in _by_size([_NAME.sub(" ", _QUOTED.sub(" ", t or "")) for t in texts])])
            defects: list[str | None] = []
            probes: list[list[dict]] = []
            for k, (f, t) in enumerate(zip(fields, texts)):
                d, p = None, []
                exp = sorted(want.get(f, {LANGUAGES.index("en")}))
                if is_empty(t):
                    d = "empty"
                elif echo(t):
                    d = "echo"
                elif is_refusal(t):
                    d = "refusal"
                elif post[k].max() - post[k, exp].max() > margin:
                    d = "language"
                elif open_quotation(t):
                    d = "truncated"
                elif f == "prompt1":
                    vals = parts(t)
                    if any(is_empty(vals.get(x)) for x in FIELDS):
                        d = "truncated"
                    else:
                        p = [vals[x] for x in FIELDS]
                else:
                    s = re.sub(r"[\s\"”“’'»)\]*​]+$", "", t)
                    if re.search(r"[,;:\-–—(]$|\.\.\.$|…$", s):
                        d = "truncated"
                    elif not re.search(r"[.!?]$", s):
                        p = [s]
                defects.append(d)
                probes.append([dict(zip(("k2", "k1"), tail_keys(x))) for x in p])
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(defects, pa.string()), pa.array(probes, pa.list_(pa.struct([("k2", pa.string()), ("k1", pa.string())])))], names=["table_name", "rec_id", "field", "defect", "probes"])

    return run


def _count_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replies that a key is in, and those in which it ends a statement."""
    for b in batches:
        met: dict[str, Counter] = {}
        ended: dict[str, Counter] = {}
        for f, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if t:
                e = ends(t, lines=f == "prompt1")
                met.setdefault(f, Counter()).update(e.keys())
                ended.setdefault(f, Counter()).update(k for k, v in e.items() if v)
        rows = [(f, k, ended[f][k], n) for f, c in met.items() for k, n in c.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["field", "k", "ended", "n"])


def defects(replies: DataFrame, prompts: DataFrame, docs: DataFrame, margin: float = 4.0, min_end: float = 0.03, enough: int = 20, max_rows: int = 20_000) -> DataFrame:
    """(table_name, rec_id, defect) of the defective rows of (table_name, rec_id, field, text).

    Null replies are empty. Replies of an unknown field are held to be English. Repeated rows come
    out once each; empty tables give no rows. ``min_end`` is the share of an ending's occurrences
    that must close a statement; ``enough`` the occurrences from which two words are trusted. A reply
    may be in any language that a wording of its field expects. More than ``MOST_WORDINGS``
    wordings, and expected languages that are not among ``LANGUAGES``, are refused.
    """
    wordings = [(r["field_name"], r["prompt_text"] or "", (r["expected_lang"] or "").strip().lower()[:2]) for r in prompts.select("field_name", "prompt_text", "expected_lang").distinct().limit(MOST_WORDINGS + 1).collect()]
    if len(wordings) > MOST_WORDINGS:
        raise ValueError(f"more than {MOST_WORDINGS} prompt wordings")
    if unknown := {e for _, _, e in wordings} - {"", *LANGUAGES}:
        raise ValueError(f"replies cannot be judged in {sorted(unknown)}")
    bc = replies.sparkSession.sparkContext.broadcast((fit_languages(docs, max_rows), wordings))
    cols = ("table_name", F.col("rec_id").cast("long").alias("rec_id"), "field", "text")
    judged = replies.select(*cols).mapInArrow(_judge(bc, margin), JUDGED)
    first = judged.filter("defect is not null").select("table_name", "rec_id", "defect")
    stats = replies.select("field", "text").mapInArrow(_count_ends, "field string, k string, ended long, n long").groupBy("field", "k").agg(F.sum("ended").alias("ended"), F.sum("n").alias("n"))
    probe = judged.filter("defect is null and size(probes) > 0").select("table_name", "rec_id", "field", F.explode("probes").alias("p")).select("table_name", "rec_id", "field", "p.*")
    # endings are few: their likelihoods are looked up once each
    kinds = probe.select("field", "k2", "k1").distinct()
    two = stats.select("field", F.col("k").alias("k2"), F.col("ended").alias("e2"), F.col("n").alias("n2"))
    one = stats.select("field", F.col("k").alias("k1"), F.col("ended").alias("e1"), F.col("n").alias("n1"))
    rated = kinds.join(two, ["field", "k2"], "left").join(one, ["field", "k1"], "left").fillna(0, ["e2", "n2", "e1", "n1"])
    share = F.when(F.col("n2") >= enough, F.col("e2") / F.col("n2")).when(F.col("n1") > 0, F.col("e1") / F.col("n1")).otherwise(F.lit(0.0))
    broken = rated.filter(share < min_end).select("field", "k2", "k1")
    cond = (probe["field"] == broken["field"]) & probe["k2"].eqNullSafe(broken["k2"]) & probe["k1"].eqNullSafe(broken["k1"])
    cut = probe.join(broken, cond, "left_semi").select("table_name", "rec_id").distinct()
    return first.unionByName(cut.withColumn("defect", F.lit("truncated")))


def replies_of(raw: DataFrame, results: DataFrame) -> DataFrame:
    a = raw.select(F.lit("raw_outputs_a").alias("table_name"), F.col("raw_id").alias("rec_id"), F.lit("prompt1").alias("field"), F.col("prompt1_raw").alias("text"))
    b = results.filter(F.col("caption_model").isNotNull()).select(F.lit("results").alias("table_name"), F.col("row_id").alias("rec_id"), F.lit("caption_description").alias("field"), F.col("caption_description").alias("text"))
    return a.unionByName(b)

"""File names however they are written: escapes, separators, case, composed letters."""

from __future__ import annotations

import re
import unicodedata
from urllib.parse import unquote

_URL = re.compile(r"^file:(//(localhost(?=/))?)?(?=[/\\])", re.I)
_ESCAPE = re.compile(r"%[0-9A-Fa-f]{2}")


def plain(path: str) -> str:
    """Without outer blanks, URL scheme and percent escapes; composed letters; forward slashes."""
    s = path.strip()
    s = _URL.sub("", s)
    while _ESCAPE.search(s) and _decodes(s):  # escaped more than once; each step shortens it
        s = unquote(s, errors="strict")
    return unicodedata.normalize("NFC", s).replace("\\", "/").strip()


def _decodes(s: str) -> bool:
    try:
        unquote(s, errors="strict")
        return True
    except UnicodeDecodeError:
        return False


def same_file_key(path: str | None) -> str | None:
    """Equal for two paths if they name one file on a volume that ignores letter case; null for none."""
    if path is None:
        return None
    s = plain(path)
    if not s:
        return None
    out: list[str] = []
    for part in s.split("/"):
        if part in ("", "."):
            continue
        if part == "..":
            if out and out[-1] != "..":
                out.pop()
            elif not s.startswith("/"):
                out.append("..")
            continue
        out.append(part)
    key = ("/" if s.startswith("/") else "") + "/".join(out)
    return unicodedata.normalize("NFC", key.casefold())


_EXT = re.compile(r"\.[A-Za-z][A-Za-z0-9]{1,4}$")
_COPY = re.compile(r"(?:[ _-]*\(\d+\)|[ _-]+(?:copy|kopie|copie|copia)(?:[ _-]*\(?\d+\)?)?)$", re.I)
_HEX = re.compile(r"^[0-9a-f]{12}_+|_+[0-9a-f]{12}$", re.I)
_SECOND = re.compile(r"^(.*?)[\s_]+t?(\d+(?:[.,]\d+)?)s?$", re.I | re.S)
_GAPS = re.compile(r"[\s_]+")


def clip_and_second(path: str | None) -> tuple[str, int] | None:
    """Clip stem and microsecond that the name of a face crop states, or None if it states none."""
    if path is None:
        return None
    base = plain(path).rsplit("/", 1)[-1]
    base = _EXT.sub("", base.strip()).strip()
    while (cut := _COPY.sub("", base)) != base:
        base = cut.strip()
    base = _HEX.sub("", base)
    m = _SECOND.match(base)
    if not m:
        return None
    stem = unicodedata.normalize("NFC", _GAPS.sub("_", m[1].strip(" _").casefold()))
    whole, _, frac = m[2].replace(",", ".").partition(".")
    return (stem, int(whole) * 1_000_000 + int((frac + "000000")[:6])) if stem else None

"""Text, path and date parsing as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Known extensions, month names, orientation codes.
VIDEO_EXTENSIONS = (".mp4", ".mov", ".avi", ".mkv", ".m4v")
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".heic", ".heif", ".tiff", ".tif", ".bmp", ".webp")
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
MONTHS_SHORT = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
EXIF_DEGREES = {1: 0, 3: 180, 6: 90, 8: 270}
# Blanks as text files have them, and line ends, in syntax that Java and RE2 share.
BLANK = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LINE_END = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
# Names of months with what may follow the first three letters; September has a third form.
MONTH_NAMES = "|".join(["Sept", *(f"{m[:3]}(?:{m[3:]})?" for m in MONTHS)])


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def card_key(stem: Column, path: Column) -> Column:
    """The key shared by results, clusters and labels; null if either part is."""
    return F.concat(stem, F.lit("/"), basename(path))


def forward_slashes(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def file_type(path: Column) -> Column:
    """video, image, or null for what is neither."""
    e = extension(path)
    return F.when(e.isin(*VIDEO_EXTENSIONS), "video").when(e.isin(*IMAGE_EXTENSIONS), "image")


def safe_double(c: Column) -> Column:
    """A finite or infinite number, null for what is none and for NaN."""
    d = c.cast("string").try_cast("double")
    return F.when(~F.isnan(d), d)


def truthy(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("true", "1", "yes"), F.lit(False))


def json_numbers(c: Column) -> Column:
    """An array of doubles from JSON text; null if it is malformed."""
    return F.from_json(c, "array<double>")


def path_year_month(path: Column) -> Column:
    """(year, month) that a path states, by the first pattern that fits; (0, 0) if none does.

    Patterns in order: YYYYMMDD; YYYY and MM with an optional separator; a month's name that no
    letter touches, a day if any, a year; a bare year of this century, whose month is 0.
    """
    y8 = r"(?<!\d)(20\d{2})(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])(?!\d)"
    ym = r"(20\d{2})[-_./]?(0[1-9]|1[0-2])(?!\d)"
    mn = rf"(?i)(?<![a-z])({MONTH_NAMES})(?![a-z])(?:[\s_.-]+[0-3]?\d)?[\s_.-]?(20\d{{2}})(?!\d)"
    yy = r"(?<!\d)(20\d{2})(?!\d)"
    num = lambda c: c.try_cast("int")
    month = F.array_position(F.array(*[F.lit(m.lower()) for m in MONTHS_SHORT]), F.lower(F.substring(F.regexp_extract(path, mn, 1), 1, 3))).cast("int")
    pair = lambda y, m: F.struct(y.alias("year"), m.alias("month"))
    found = lambda p: F.regexp_extract(path, p, 0) != ""
    return (
        F.when(found(y8), pair(num(F.regexp_extract(path, y8, 1)), num(F.regexp_extract(path, y8, 2))))
        .when(found(ym), pair(num(F.regexp_extract(path, ym, 1)), num(F.regexp_extract(path, ym, 2))))
        .when(found(mn), pair(num(F.regexp_extract(path, mn, 2)), month))
        .when(found(yy), pair(num(F.regexp_extract(path, yy, 1)), F.lit(0)))
        .otherwise(pair(F.lit(0), F.lit(0)))
    )


def exif_year_month(c: Column) -> Column:
    t = F.try_to_timestamp(F.regexp_replace(F.trim(c), "\\x00+$", ""), F.lit("yyyy:MM:dd HH:mm:ss"))
    return F.when(t.isNotNull(), F.struct(F.year(t).alias("year"), F.month(t).alias("month")))


def iso_year_month(c: Column) -> Column:
    """Year (from 2000) and month of a text that begins with an ISO date, with separators or without, else null."""
    pat = rf"^{BLANK}*(\d{{4}})(?:-(0[1-9]|1[0-2])-\d{{2}}|(0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])(?:\D|$))"
    y, m = F.regexp_extract(c, pat, 1).try_cast("int"), F.concat(F.regexp_extract(c, pat, 2), F.regexp_extract(c, pat, 3))
    return F.when(y >= 2000, F.struct(y.alias("year"), m.try_cast("int").alias("month")))


def source_date(exif_primary: Column, exif_fallback: Column, metadata: Column, path: Column, mtime: Column) -> Column:
    """(year, month, source) by the first of the sources that knows it.

    Images are asked for the dates of their EXIF block, videos for that of their container; then
    the path, then the time of the last change. Without any: 0, 0, unknown.
    """
    tag = lambda s, n: F.when(s.isNotNull(), F.struct(s["year"].alias("year"), s["month"].alias("month"), F.lit(n).alias("source")))
    video = extension(path).isin(*VIDEO_EXTENSIONS)
    still = ~F.coalesce(video, F.lit(False))
    stated = path_year_month(path)
    return F.coalesce(
        F.when(still, tag(exif_year_month(exif_primary), "exif_primary")),
        F.when(still, tag(exif_year_month(exif_fallback), "exif_fallback")),
        F.when(video, tag(iso_year_month(metadata), "video_metadata")),
        F.when(stated["year"] > 0, tag(stated, "path_regex")),
        F.when(mtime.isNotNull(), F.struct(F.year(mtime).alias("year"), F.month(mtime).alias("month"), F.lit("mtime").alias("source"))),
        F.struct(F.lit(0).alias("year"), F.lit(0).alias("month"), F.lit("unknown").alias("source")),
    )


def section_key(year: Column, month: Column) -> Column:
    return F.format_string("%d-%02d", year, month)


def section_label(year: Column, month: Column) -> Column:
    name = F.get(F.array(*map(F.lit, MONTHS_SHORT)), (month - 1).cast("int"))
    return F.when(year == 0, "Unknown").when(month == 0, F.format_string("Unknown %d", year)).otherwise(F.concat(name, F.lit(" "), year.cast("string")))


def format_bytes(n: Column) -> Column:
    """With one decimal below ten units, whole units above; halves go to the even digit. GB are the largest unit."""
    out = F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
    for k, unit in enumerate(("KB", "MB", "GB"), 1):
        v = n / float(1024**k)
        shown = F.when(v < 10, F.format_string(f"%.1f {unit}", F.bround(v, 1))).otherwise(F.concat(F.bround(v, 0).cast("long").cast("string"), F.lit(f" {unit}")))
        out = out.when(F.lit(True) if unit == "GB" else n < 1024 ** (k + 1), shown)
    return F.when(n.isNotNull(), out)


def mmss(seconds: Column) -> Column:
    s = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d", F.floor(s / 60), s % 60)


def key_values(text: Column, keys: tuple[str, ...]) -> Column:
    """Struct of the values of ``key: value`` lines, dashes and stars before the key left out; the last that is not empty wins.

    Values lose blanks and square brackets at their ends, nothing else.
    """
    lines = F.split(F.coalesce(text, F.lit("")), LINE_END)
    ends = lambda c, what: F.regexp_replace(c, f"^{what}+|{what}+$", "")

    def value(k: str) -> Column:
        pat = rf"(?i)^{BLANK}*[-* ]*{k}{BLANK}*:(.*)$"
        hits = F.filter(F.transform(lines, lambda ln: ends(ends(ends(F.regexp_extract(ln, pat, 1), BLANK), r"[\[\]]"), BLANK)), lambda v: v != "")
        return F.when(F.size(hits) > 0, F.element_at(hits, -1)).alias(k)

    return F.struct(*[value(k) for k in keys])


def last_value_sql(text: str, key: str) -> str:
    """key_values() of one key as SQL for DuckDB."""
    v = rf"regexp_extract(x, '(?i)^{BLANK}*[-* ]*{key}{BLANK}*:(.*)$', 1)"
    for what in (BLANK, r"[\[\]]", BLANK):
        v = f"regexp_replace({v}, '^{what}+|{what}+$', '', 'g')"
    return f"list_extract(list_filter(list_transform(regexp_split_to_array(coalesce({text}, ''), '{LINE_END}'), lambda x: {v}), lambda x: x <> ''), -1)"


def multiline_value(text: Column, key: str, keys: tuple[str, ...]) -> Column:
    """A value that runs on to the next line that starts with one of the keys."""
    stop = "|".join(keys)
    v = F.trim(F.regexp_replace(F.regexp_extract(text, rf"(?is)(?:^|\n)\s*{key}\s*:(.*?)(?=\n\s*(?:{stop})\s*:|$)", 1), r"\s+", " "))
    return F.when(v != "", v)


def first_int(text: Column, lo: int = 1, hi: int = 10) -> Column:
    """The first whole number of a text, clamped; null if there is none."""
    n = F.regexp_extract(text, r"\d+", 0).try_cast("int")
    return F.when(n.isNotNull(), F.least(F.greatest(n, F.lit(lo)), F.lit(hi)))


def word_count(text: Column) -> Column:
    return F.when(text.isNotNull(), F.size(F.regexp_extract_all(text, F.lit(r"(?U)\b\w+\b"), F.lit(0))))


def shorten(text: Column, width: int) -> Column:
    flat = F.regexp_replace(text, r"[\r\n]+", " ")
    return F.when(F.length(flat) > width, F.concat(F.substring(flat, 1, width - 1), F.lit("…"))).otherwise(flat)


def after_kept(path: Column) -> Column:
    at = F.instr(path, "/kept/")
    return F.when(at > 0, F.substring(path, at + 6, F.length(path))).otherwise(path)


def keeper_name(score: Column, stem: Column, seconds: Column) -> Column:
    return F.format_string("%.4f_%s_%.3f.jpg", score, stem, seconds)


def exif_degrees(code: Column) -> Column:
    out = F.lit(0)
    for k, v in EXIF_DEGREES.items():
        out = F.when(code == k, v).otherwise(out)
    return out


def version_tag(name: Column) -> Column:
    return F.regexp_extract(name, r"(?i)(?:^|[_\-])v(\d+)", 1).try_cast("int")


def corpus_name(config: Column, path: Column) -> Column:
    """The configured name, else the folder of a file called results, else the file's stem."""
    stem = F.regexp_replace(basename(path), r"\.[^.]+$", "")
    parent = F.regexp_extract(path, r"([^/\\]+)[/\\][^/\\]*$", 1)
    return F.coalesce(F.nullif(F.trim(config), F.lit("")), F.when(stem == "results", parent).otherwise(stem))


def content_digest(content: Column, head: int = 65_536) -> Column:
    """MD5 of the first bytes of a file."""
    return F.md5(F.substring(content, 1, head))


def natural_id(video_path: Column, seconds: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", video_path, seconds.cast("string")), 256), 1, 12)

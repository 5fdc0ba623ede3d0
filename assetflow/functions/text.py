"""Recognised-text rules: clean-up, script counts, scores and URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetflow.operators.pixels import bind

# White space inside a line.
BLANK_CHARS = "\t\x0b\f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def normalize_text(col: Column | str) -> Column:
    """One line ending, no trailing blanks, runs of empty lines reduced to one, trimmed.
    Lines are cut with plain string functions; only runs of line ends need a pattern."""
    c = F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))
    c = F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    lines = F.transform(F.split(c, "\n"), lambda line: F.rtrim(line, F.lit(BLANK_CHARS)))
    joined = F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n")
    return F.btrim(joined, F.lit(BLANK_CHARS + "\n"))


def map_characters(col: Column, source_chars: str, target_chars: str) -> Column:
    """1:1 character table; ``source_chars[i]`` becomes ``target_chars[i]``."""
    return F.translate(col, source_chars, target_chars)


def map_characters_for(texts: DataFrame, table: DataFrame, language: str, wanted: str) -> DataFrame:
    """Apply a user-supplied table (``source``, ``target``: one character each) to texts of one language.
    A source listed twice takes its least target.  What reaches the driver is one row for each
    distinct source character, at most the number of code points; cells of other lengths are refused."""
    odd = table.filter("length(source) <> 1 or length(target) <> 1 or source is null or target is null")
    if not odd.isEmpty():
        raise ValueError("every cell of a character table holds one character")
    pairs = table.groupBy("source").agg(F.min("target").alias("target")).orderBy("source").collect()
    left, right = "".join(p.source for p in pairs), "".join(p.target for p in pairs)
    mapped = map_characters(F.col("text"), left, right) if pairs else F.col("text")
    return texts.withColumn("text", F.when(F.col(language) == wanted, mapped).otherwise(F.col("text")))


# Code point ranges of the counted scripts.
SCRIPTS = {
    "hangul": r"\x{AC00}-\x{D7AF}",
    "han": r"\x{4E00}-\x{9FFF}",
    "kana": r"\x{3040}-\x{30FF}",
    "cyrillic": r"\x{0400}-\x{04FF}",
    "arabic": r"\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}",
    "thai": r"\x{0E00}-\x{0E7F}",
    "latin": r"A-Za-z\x{00C0}-\x{024F}\x{1E00}-\x{1EFF}",
    "diacritic": r"\x{00C0}-\x{024F}\x{1E00}-\x{1EFF}",
}
# Unicode separators and control characters, and their share of ASCII.
INVISIBLE, INVISIBLE_ASCII = r"\p{Z}\p{Cc}", r"\x00-\x20\x7F"


def count_of(col: Column, char_class: str) -> Column:
    """Characters of a class, as the length lost when its runs are removed."""
    return (F.length(col) - F.length(F.regexp_replace(col, f"[{char_class}]+", ""))).cast("bigint")


def count_listed(col: Column, chars: str) -> Column:
    return (F.length(col) - F.length(F.translate(col, chars, ""))).cast("bigint")


def script_stats(col: Column | str, traditional_only: str = "", simplified_only: str = "") -> Column:
    """A struct of the counts per script.  ``mixed`` needs the two user-supplied character lists.

    ASCII is counted in two passes over the text; all other scripts are counted on what is
    left of it without ASCII, which is computed once.
    """
    c = F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))

    def counted(rest: Column) -> Column:
        ascii_length = F.length(c) - F.length(rest)
        other = {name: count_of(rest, ranges) for name, ranges in SCRIPTS.items()}
        visible = ascii_length - count_of(c, INVISIBLE_ASCII) + F.length(rest) - count_of(rest, INVISIBLE)
        none = F.lit(0).cast("bigint")
        trad = count_listed(rest, traditional_only) if traditional_only else none
        simp = count_listed(rest, simplified_only) if simplified_only else none
        cells = {"visible": visible.cast("bigint")} | other
        cells |= {"latin": count_of(c, "A-Za-z") + other["diacritic"], "mixed": F.least(trad, simp)}
        return F.struct(*[v.alias(n) for n, v in cells.items()])

    return bind(F.regexp_replace(c, r"[\x00-\x7F]+", ""), counted)


def with_script_stats(texts: DataFrame, col: str = "text", traditional_only: str = "", simplified_only: str = "") -> DataFrame:
    """The counts as columns.  They come from one struct, so the text is gone through once."""
    stats = script_stats(col, traditional_only, simplified_only)
    return texts.withColumn("_s", stats).select(*texts.columns, "_s.*")


# Order in which profiles win ties.
PROFILE_ORDER = ["chinese", "english", "latin", "korean", "cyrillic", "arabic", "thai"]


def script_scores(confidence: str = "confidence") -> dict[str, Column]:
    """Score per profile from the columns of :func:`script_stats`; minus infinity without text."""
    v, h, n, k = F.col("visible"), F.col("hangul"), F.col("han"), F.col("kana")
    c, a, t, lat, d, m = (F.col(x) for x in ("cyrillic", "arabic", "thai", "latin", "diacritic", "mixed"))
    x = lambda col, w: col * F.lit(float(w))
    some = lambda test, value: F.when(test, value).otherwise(F.lit(0.0))
    start = lambda col, base, w, miss: F.when(col > 0, F.lit(float(base)) + x(col, w)).otherwise(F.lit(float(miss)))
    base = x(F.col(confidence), 100) + F.least(F.lit(12.0), x(v, 0.35))
    family = {
        "chinese": some(k > 0, 22 + x(k, 0.8))
        + some(n > 0, 18 + x(n, 0.35) - x(m, 1.5))
        + some((k == 0) & (n == 0) & (lat > 0), 6 + x(lat, 0.12))
        - x(h, 1.6) - x(c, 1.2) - x(a, 1.2),
        "english": start(lat, 18, 0.3, -28) - (n + k + x(h, 1.5) + x(c, 1.4) + x(a, 1.4)) - x(d, 0.35)
        - some(lat.between(1, 3), F.lit(6.0)),
        "latin": start(lat, 18, 0.32, -28) + some(d > 0, 6 + x(d, 0.5)) - (n + k + x(h, 1.5) + x(c, 1.25) + x(a, 1.25)),
        "korean": start(h, 24, 0.9, -30) - x(n, 0.5) - x(k, 1.5) - x(c, 1.2) - x(a, 1.2),
        "cyrillic": start(c, 30, 1.05, -30) - (n + k + x(h, 1.5) + x(a, 1.25)),
        "arabic": start(a, 34, 1.15, -30) - (n + k + x(h, 1.5) + x(c, 1.25)),
        "thai": start(t, 32, 1.05, -30) - (n + k + x(h, 1.5) + x(c, 1.25) + x(a, 1.25)) - x(lat, 0.18),
    }
    return {p: F.when(v > 0, base + family[p]).otherwise(F.lit(float("-inf"))) for p in PROFILE_ORDER}


URL = r"(?i)https?://[^\s\"'<>]+"
URL_TAIL = r"[.,;:!?)\]}]+$"


def normalize_url(col: Column) -> Column:
    """Scheme and host lower-cased, an empty path written as ``/``; no host gives null.
    Full URI canonicalisation (escapes, default ports, dot segments) is not done."""
    head = F.lower(F.regexp_extract(col, r"^(?i:https?)://[^/?#]+", 0))
    tail = F.substr(col, F.length(head) + 1, F.length(col))
    full = F.when(tail.rlike("^/"), F.concat(head, tail)).otherwise(F.concat(head, F.lit("/"), tail))
    return F.when(head != "", full)


def is_single_url(col: Column) -> Column:
    text = F.trim(col)
    return F.coalesce(~text.rlike(r"[ \t\r\n]") & text.rlike(r"^(?i:https?)://[^/?#]+"), F.lit(False))


def extract_urls(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key, position, url``: distinct links of each text (ignoring case), first spelling
    and position kept.  All links of a text leave one task, so the partial aggregate
    already removes its duplicates before the shuffle."""
    found = F.regexp_extract_all(F.col(text), F.lit(URL), F.lit(0))
    links = F.transform(found, lambda u: normalize_url(F.regexp_replace(u, URL_TAIL, "")))
    rows = texts.select(key, F.posexplode(links).alias("position", "url")).filter(F.col("url").isNotNull())
    first = rows.groupBy(key, F.lower("url").alias("_k")).agg(F.min(F.struct("position", "url")).alias("f"))
    return first.select(key, F.col("f.position").cast("bigint").alias("position"), F.col("f.url").alias("url"))

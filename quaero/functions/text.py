"""Text normalisation and similarity as Column expressions.

Patterns name their character classes, because white space and word bounds
differ between regex dialects. Offsets anywhere in this package count code
points from 0.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Typographic variants and the ASCII character each stands for.
SINGLE_QUOTES = "‘’‚‛′‵"
DOUBLE_QUOTES = "“”„‟″‶"
DASHES = "‐‑‒–—―−"
#: White space as ECMAScript's \s defines it.
SPACES = r"\t\n\x0B\f\r    -     　﻿"
#: Words without weight in the name of a case, in the order they are dropped.
HONORIFICS = r"dr|shri|smt|mr|mrs|ms|m/s|justice|hon'?ble"
TITLE_NOISE = ("versus", r"vs?\.?", "and others?", r"and anr\.?", r"and ors\.?", r"anr\.?", r"ors\.?", r"etc\.?", "the")
TITLE_SUFFIXES = ("private", r"pvt\.?", "limited", r"ltd\.?", r"co\.?", "company", "corporation", "incorporated", r"inc\.?")

_L, _R = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"


def bounded(pattern: str) -> str:
    """pattern between ASCII word bounds; a dot at its end has a bound only before a word character."""
    if pattern.endswith(r"\.?"):
        stem = pattern[:-3]
        return rf"{_L}(?:{stem}\.(?=[A-Za-z0-9_])|{stem}{_R})"
    return f"{_L}(?:{pattern}){_R}"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value evaluated once a row: lambdas evaluate whatever they refer to anew for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def squeeze(col: Column) -> Column:
    """Runs of white space to one space, none at the ends."""
    return F.regexp_replace(F.regexp_replace(col, f"[{SPACES}]+", " "), "^ | $", "")


def fold_punctuation(col: Column) -> Column:
    plain = F.translate(col, SINGLE_QUOTES + DOUBLE_QUOTES + DASHES + "\u00a0", "'" * 6 + '"' * 6 + "-" * 7 + " ")
    return F.replace(F.replace(plain, F.lit("…"), F.lit("...")), F.lit("§"), F.lit("section "))


def norm_paragraph(col: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(fold_punctuation(col)), "[^a-z0-9]+", " "))


def paragraph_hash(col: Column) -> Column:
    return F.sha2(norm_paragraph(col), 256)


def norm_title(col: Column) -> Column:
    out = F.regexp_replace(F.lower(fold_punctuation(col)), r"\([^\n\r]*?\)", " ")
    out = F.regexp_replace(out, rf"{_L}(?:{HONORIFICS}){_R}\.?", " ")
    for p in TITLE_NOISE + TITLE_SUFFIXES:
        out = F.regexp_replace(out, bounded(p), " ")
    return F.trim(F.regexp_replace(out, "[^a-z0-9]+", " "))


def words(normalised: Column) -> Column:
    return F.filter(F.split(normalised, " "), lambda t: t != "")


def title_tokens(normalised: Column) -> Column:
    return F.filter(F.split(normalised, " "), lambda t: F.length(t) > 1)


def norm_citation(col: Column) -> Column:
    plain = F.replace(F.upper(fold_punctuation(col)), F.lit("."), F.lit(""))
    return F.trim(F.regexp_replace(plain, "[^A-Z0-9]+", " "))


def paragraph_ref(col: Column) -> Column:
    found = F.regexp_extract(col, r"(?i)(?:paragraphs?|paras?\.?|¶+|pp?\.)[ \t\n\x0B\f\r]*([0-9]+)", 1)
    return F.when(found != "", found)


def extract_year(col: Column) -> Column:
    return F.regexp_extract(col, rf"{_L}(1[89][0-9][0-9]|20[0-9][0-9]){_R}", 1).try_cast("int")


def provision_label(section: Column, act: Column) -> Column:
    return F.concat(F.lit("§ "), F.trim(section), F.lit(" "), F.upper(F.trim(act)))


def safe_filename(col: Column) -> Column:
    base = F.element_at(F.split(col, r"[\\/]"), -1)
    return F.coalesce(F.nullif(F.left(F.regexp_replace(base, r"[^A-Za-z0-9_.\- ]+", "_"), F.lit(200)), F.lit("")), F.lit("document"))


def format_day(day: Column) -> Column:
    return F.coalesce(F.date_format(day, "d MMMM yyyy"), F.lit("Date not recorded"))


def trigrams(normalised: Column) -> Column:
    """Distinct windows of three characters of the text with two spaces before and one after."""
    padded = F.concat(F.lit("  "), normalised, F.lit(" "))
    return once(padded, lambda p: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, 3))))


def jaccard(a: Column, b: Column) -> Column:
    """|both| / |either| of two arrays of distinct values; 1 if both are empty."""
    sizes = lambda x: F.struct(F.size(F.array_intersect(x["a"], x["b"])).alias("both"), F.size(F.array_union(x["a"], x["b"])).alias("either"))
    share = lambda x: F.when(x["either"] == 0, 1.0).otherwise(x["both"] / x["either"])
    return once(once(F.struct(a.alias("a"), b.alias("b")), sizes), share)


def levenshtein_ratio(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def containment(needle: Column, hay: Column) -> Column:
    """Share of needle's tokens, repeats counted, that hay has; 0 for an empty needle."""
    share = lambda x: F.size(F.filter(x["needle"], lambda w: F.array_contains(x["hay"], w))) / F.size(x["needle"])
    return once(F.struct(needle.alias("needle"), hay.alias("hay")), lambda x: F.when(F.size(x["needle"]) == 0, 0.0).otherwise(share(x)))


def vector_cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (F.size(a) == 0) | (norm == 0), 0.0).otherwise(dot(a, b) / norm)

"""DuckDB texts of the expressions in functions.text, for the oracle."""

from __future__ import annotations

from ..functions.text import DASHES, DOUBLE_QUOTES, HONORIFICS, SINGLE_QUOTES, TITLE_NOISE, TITLE_SUFFIXES


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def fold(x: str) -> str:
    plain = f"translate({x}, {q(SINGLE_QUOTES + DOUBLE_QUOTES + DASHES + chr(160))}, {q(chr(39) * 6 + chr(34) * 6 + '-' * 7 + ' ')})"
    return f"replace(replace({plain}, '…', '...'), '§', 'section ')"


def norm_paragraph(x: str) -> str:
    return f"trim(regexp_replace(lower({fold(x)}), '[^a-z0-9]+', ' ', 'g'))"


def norm_title(x: str) -> str:
    out = f"regexp_replace(lower({fold(x)}), '\\([^\\n\\r]*?\\)', ' ', 'g')"
    out = f"regexp_replace({out}, {q(rf'\b({HONORIFICS})\b\.?')}, ' ', 'g')"
    for p in TITLE_NOISE + TITLE_SUFFIXES:
        out = f"regexp_replace({out}, {q(rf'\b{p}\b')}, ' ', 'g')"
    return f"trim(regexp_replace({out}, '[^a-z0-9]+', ' ', 'g'))"


def norm_citation(x: str) -> str:
    return f"trim(regexp_replace(replace(upper({fold(x)}), '.', ''), '[^A-Z0-9]+', ' ', 'g'))"


def words(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda t: t <> '')"


def trigrams(x: str) -> str:
    return f"list_distinct(list_transform(range(1, length({x}) + 2), lambda i: substr('  ' || {x} || ' ', i, 3)))"


def jaccard(a: str, b: str) -> str:
    return f"(CASE WHEN len({a}) + len({b}) = 0 THEN 1.0 ELSE len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) END)"

"""What a document claims of a citation: the words around it, by offsets in code points from 0."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.text import _L, _R

#: Forums by the words that name them, first match decides.
COURTS = ((rf"{_L}supreme court{_R}", "Supreme Court of India"), (rf"{_L}nclat{_R}|{_L}appellate tribunal{_R}", "National Company Law Appellate Tribunal"),
          (rf"{_L}nclt{_R}|{_L}adjudicating authority{_R}", "National Company Law Tribunal"), (rf"{_L}high court{_R}", "High Court"))
#: Small words that a title may hold, party connectors, words that lead in, abbreviations that end no sentence.
SMALL_WORDS = {"of", "and", "the", "&", "v", "v.", "vs", "vs.", "versus", "on", "for"}
CONNECTORS = {"v", "v.", "vs", "vs.", "versus"}
LEAD_INS = {"in", "see", "per", "cf", "cf.", "also", "and", "but", "to", "of", "on", "for", "that", "from"}
ABBREVIATIONS = {"ltd.", "pvt.", "co.", "corp.", "inc.", "llp.", "pte.", "anr.", "ors.", "dr.", "mr.", "mrs.", "ms.", "m/s.", "no.", "nos.", "v.", "vs.", "st.", "govt."}
INITIALS = re.compile(r"(?:[A-Z]\.){1,4}")
MOST_TITLE_WORDS, TITLE_REACH = 16, 300
BOUNDARY = r"\n[ \t]*\n|\f"
QUOTES = '["“”]'
QUOTATION = f'{QUOTES}([^"“”]{{40,1200}}){QUOTES}'


def around(text: Column, start: Column, end: Column, before: int, after: int) -> Column:
    first = F.greatest(F.lit(0), start - before)
    return F.substring(text, first + 1, end + after - first)


def block(text: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """(text, offset) of the part between blank lines or form feeds that holds the citation."""
    head = F.substring(text, F.lit(1), start)
    lead = F.element_at(F.split(head, BOUNDARY, -1), -1)
    tail = F.substring(text, end + 1, F.length(text))
    return F.concat(lead, F.substring(text, start + 1, end - start), F.split(tail, BOUNDARY, -1)[0]), start - F.length(lead)


def paragraph_ref(text: Column, start: Column, end: Column) -> Column:
    return T.paragraph_ref(around(text, start, end, 120, 160))


def court_hint(text: Column, start: Column, end: Column) -> Column:
    near = F.lower(around(text, start, end, 200, 200))
    return F.coalesce(*[F.when(near.rlike(p), name) for p, name in COURTS])


def quotation(text: Column, start: Column, end: Column) -> Column:
    """The quoted words of the citation's block that begin nearest to it, the first on ties; null without any."""
    part, offset = block(text, start, end)
    found = F.regexp_extract_all(part, F.lit(QUOTATION), F.lit(0))
    gaps = F.split(part, QUOTATION, -1)
    # Pieces and matches interleave, so one pass with a running offset places every match.
    state = F.struct(F.lit(0).alias("at"), F.lit(None).cast("int").alias("far"), F.lit(None).cast("string").alias("best"))
    step = lambda s, x: F.struct(
        (s["at"] + F.length(x["gap"]) + F.length(x["raw"])).alias("at"),
        F.least(s["far"], F.abs(s["at"] + F.length(x["gap"]) - (start - offset))).alias("far"),
        F.when(s["far"].isNull() | (F.abs(s["at"] + F.length(x["gap"]) - (start - offset)) < s["far"]), x["raw"]).otherwise(s["best"]).alias("best"),
    )
    pairs = T.once(found, lambda all_: F.zip_with(all_, F.slice(gaps, F.lit(1), F.size(all_)), lambda r, g: F.struct(r.alias("raw"), g.alias("gap"))))
    return T.once(F.aggregate(pairs, state, step)["best"], lambda best: T.squeeze(F.substring(best, F.lit(2), F.length(best) - 2)))


def claimed_title(text: str, start: int) -> str | None:
    """The case title that ends where the citation starts: capitalised words and small words walked back to the
    first that cannot belong, with a party connector inside."""
    words = text[max(0, start - TITLE_REACH) : start].split()
    while words and not (last := words[-1].rstrip(",")):
        words.pop()
    if words:
        words[-1] = last
    run: list[str] = []
    for word in reversed(words):
        low = word.lower()
        ends = word.endswith(".") and not INITIALS.fullmatch(word) and low not in ABBREVIATIONS
        if len(run) == MOST_TITLE_WORDS or not (low in SMALL_WORDS or (not ends and (word[0] == "(" or "A" <= word[0] <= "Z"))):
            break
        run.append(word)
    run.reverse()
    if len(run) < 3 or not any(w.lower() in CONNECTORS for w in run):
        return None
    while len(run) > 1 and run[0].lower() in LEAD_INS:
        run = run[1:]
    title = " ".join(run).rstrip(" ,;:")
    return title if run[0].lower() not in CONNECTORS and len(title) >= 6 else None


def with_titles(found: DataFrame, text: str = "text", start: str = "start", out: str = "claimed_title") -> DataFrame:
    """Adds the claimed title of each citation; only the reach before it goes to Python."""
    reach = F.greatest(F.lit(0), F.col(start) - TITLE_REACH)
    window = F.substring(F.col(text), reach + 1, F.col(start) - reach)

    @F.pandas_udf("string")
    def title(s: pd.Series) -> pd.Series:
        return pd.Series([claimed_title(x, len(x)) for x in s], dtype=object)

    return found.withColumn(out, title(window))


def segments(found: DataFrame, docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """docs and found(key, start, end) -> key, nth, start, end, cited: plain runs and citations in turn, which together are
    the text; a citation that starts inside the one before is left out."""
    spans = found.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")))).alias("spans"))
    n = F.length(text).cast("long")
    empty = F.array().cast("array<struct<start:bigint,end:bigint,cited:boolean>>")
    piece = lambda a, b, c: F.struct(a.alias("start"), b.alias("end"), F.lit(c).alias("cited"))
    step = lambda s, x: F.when(x["start"] < s["at"], s).otherwise(
        F.struct(x["end"].alias("at"), F.concat(s["out"], F.when(x["start"] > s["at"], F.array(piece(s["at"], x["start"], False))).otherwise(empty), F.array(piece(x["start"], x["end"], True))).alias("out"))
    )
    last = lambda s: F.concat(s["out"], F.when(s["at"] < n, F.array(piece(s["at"], n, False))).otherwise(empty))
    cut = docs.join(spans, key, "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint>>")))
    pieces = F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out")), step, last)
    return cut.select(key, F.posexplode(pieces).alias("nth", "p")).select(key, F.col("nth").cast("long").alias("nth"), "p.*")

"""Detection of citations as one operator: anchors, merged in the row, with what the text claims of each.

Nothing is shuffled until repeats are dropped: a text's anchors are one array,
which a single pass merges. Offsets are code points from 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.text import _L, _R, SPACES
from . import claims
from .extract import GAP, PATTERNS

_S = f"[{SPACES}]"
#: What leads up to a citation and is no part of what it is cited for, in the order it is removed.
SCAFFOLDING = (
    rf"(?i){_L}it is (?:respectfully |further |also )*submitted that{_R}",
    rf"(?i){_L}the (?:hon'?ble )?(?:supreme court|court|tribunal|bench){_S}+(?:of india{_S}+)?has (?:further |also |consistently )*(?:held|observed|concluded|clarified)(?:{_S}+that)?{_R}",
    rf"(?i){_L}the (?:hon'?ble )?(?:supreme court|court|tribunal|bench){_S}+(?:of india{_S}+)?(?:held|observed|concluded|clarified|considered|noted){_R}(?:{_S}+(?:at|in){_S}+(?:paragraphs?|paras?|¶){_S}*[0-9]+)?(?:{_S}+that)?",
    rf"(?i){_L}(?:at|in){_S}+(?:paragraphs?|paras?|¶){_S}*[0-9]+(?:{_S}+that)?{_R}",
    rf"(?i){_L}that decision is directly binding on this adjudicating authority{_R}",
    rf"{_L}(?:in|see|see also|cf\.?|per){_S}+(?=[A-Z])",
    rf"(?i){_L}the same principle has been restated by a [a-z-]+ bench{_R}",
)
#: How what is left is tidied, in order.
TIDY = (
    (rf"\({_S}*\)", " "), (rf"(?i){_L}(?:in|see|per|cf\.?|also){_S}*(?=[,.;:])", " "), (rf"{_S}+([,.;:])", "$1"), (rf"([,;:.])[{SPACES},;:]*\1+", "$1"),
    (rf"([,;:]){_S}*\.", "."), (rf"^[,;:.{SPACES}]+", ""), (rf"[{SPACES},;:.]+$", "."),
)
LEAST_PROPOSITION, MOST_PROPOSITION = 25, 900
_YEAR = "1[89][0-9]{2}|20[0-9]{2}"
_ANCHOR = "struct<start:int,ord:int,end:int,neutral:string,reporter:string,year:int>"
_MERGED = "struct<start:int,end:int,n:int,neutral:string,reporter:string,year:int>"


def proposition(part: Column, start: Column, end: Column, title: Column) -> Column:
    """What the citation at start to end of its block is cited for: the block without the citation, long quotations, a leading
    number, the claimed title and the scaffolding; null where fewer than 25 characters are left, cut at 900."""
    around = F.concat(F.substring(part, F.lit(1), start), F.lit(" "), F.substring(part, end + 1, F.length(part)))
    rest = F.regexp_replace(F.regexp_replace(T.squeeze(around), claims.QUOTATION, " "), rf"^{_S}*[0-9]+\.{_S}*", "")
    rest = F.replace(rest, F.coalesce(title, F.lit("")), F.lit(" "))  # an empty search string replaces nothing
    for pattern in SCAFFOLDING:
        rest = F.regexp_replace(rest, pattern, " ")
    for pattern, by in TIDY:
        rest = F.regexp_replace(rest, pattern, by)
    return T.once(T.squeeze(rest), lambda x: F.when(F.length(x) >= LEAST_PROPOSITION, F.left(x, F.lit(MOST_PROPOSITION))))


def _anchors(text: Column) -> Column:
    """All anchors of a text, by start, then by form."""

    def of(form: str, ord_: int) -> Column:
        pattern = PATTERNS[form]
        raws, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
        pairs = T.once(raws, lambda all_: F.zip_with(all_, F.slice(gaps, F.lit(1), F.greatest(F.lit(0), F.size(all_))), lambda r, g: F.struct(r.alias("raw"), g.alias("gap"))))

        def step(s: Column, x: Column) -> Column:
            raw, start = x["raw"], s["at"] + F.length(x["gap"])
            series = F.regexp_replace(F.regexp_extract(raw, r"\)\s*[0-9]{1,3}\s*([A-Z][A-Za-z.]{1,12}(?:\s+[A-Z][A-Za-z.]{1,12})?)", 1), r"\.", "")
            one = F.struct(
                start.alias("start"), F.lit(ord_).alias("ord"), (start + F.length(raw)).alias("end"), (F.upper(T.squeeze(raw)) if form == "NEUTRAL" else F.lit(None).cast("string")).alias("neutral"),
                (F.upper(series) if form == "REPORTER" else F.lit("AIR" if form == "AIR" else None).cast("string")).alias("reporter"),
                F.regexp_extract(raw, rf"(?i)of\s+({_YEAR})" if form == "CASE_NUMBER" else f"({_YEAR})", 1).try_cast("int").alias("year"),
            )
            return F.struct((start + F.length(raw)).alias("at"), F.array_append(s["out"], one).alias("out"))

        return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_ANCHOR}>").alias("out")), step, lambda s: s["out"])

    return F.array_sort(F.concat(*[of(form, i) for i, form in enumerate(PATTERNS)]))


def _merged(found: Column, text: Column) -> Column:
    """Anchors of one citation become one: at most GAP characters of space or , ; | apart. The first identifier of each kind stays."""

    def step(out: Column, x: Column) -> Column:
        prev = F.try_element_at(out, F.lit(-1))
        between = F.substring(text, prev["end"] + 1, F.greatest(F.lit(0), x["start"] - prev["end"]))
        near = prev.isNotNull() & (x["start"] - prev["end"] <= GAP) & between.rlike(rf"^[{SPACES},;|]*$")
        joined = F.struct(
            prev["start"].alias("start"), x["end"].alias("end"), (prev["n"] + 1).alias("n"),
            F.coalesce(prev["neutral"], x["neutral"]).alias("neutral"), F.coalesce(prev["reporter"], x["reporter"]).alias("reporter"), F.coalesce(prev["year"], x["year"]).alias("year"),
        )
        alone = F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(1).alias("n"), x["neutral"].alias("neutral"), x["reporter"].alias("reporter"), x["year"].alias("year"))
        return F.when(near, F.array_append(F.slice(out, F.lit(1), F.size(out) - 1), joined)).otherwise(F.array_append(out, alone))

    return F.aggregate(found, F.array().cast(f"array<{_MERGED}>"), step)


def detected(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """docs(key, text) -> key, nth, raw, normalized, start, end, n_anchors, title, year, reporter, neutral, court, paragraph,
    quotation, proposition: each citation of a text in order, the first of those with the same normalised form and title.

    A text without an anchor, empty or null gives no row; key and text are the only columns read.
    """
    # Filters on arrays that are made here would make them once more; texts without an anchor leave as rows without a place.
    rows = docs.select(key, F.col(text).alias("text")).filter("text IS NOT NULL")
    merged = T.once(_anchors(F.col("text")), lambda found: _merged(found, F.col("text")))
    each = rows.select(key, "text", F.posexplode_outer(merged).alias("place", "m")).filter("place IS NOT NULL").select(key, "text", "place", "m.*")
    part, offset = claims.block(F.col("text"), F.col("start"), F.col("end"))
    # The text around a citation and the citation's place in it; only these travel on.
    s, e, whole, lead = F.col("start"), F.col("end"), F.col("text"), claims.TITLE_REACH
    near = each.select(
        key, "place", "start", "end", "n", "neutral", "reporter", "year", part.alias("part"), (s - offset).alias("at"), F.expr("substring(text, start + 1, end - start)").alias("found"),
        claims.around(whole, s, e, lead, lead).alias("window"), (s - F.greatest(F.lit(0), s - lead)).alias("ahead"),
    )
    named = claims.with_titles(near, "window", "ahead", "title")
    s, e, whole = F.col("ahead"), F.col("ahead") + F.col("end") - F.col("start"), F.col("window")
    p, q = F.col("at"), F.col("at") + F.col("end") - F.col("start")
    out = named.withColumn("raw", T.squeeze(F.col("found"))).select(
        key, "place", "raw", T.norm_citation(F.col("raw")).alias("normalized"), "start", "end", F.col("n").alias("n_anchors"), "title",
        F.coalesce("year", T.extract_year(F.col("raw"))).alias("year"), "reporter", "neutral", claims.court_hint(whole, s, e).alias("court"),
        claims.paragraph_ref(whole, s, e).alias("paragraph"), claims.quotation(F.col("part"), p, q).alias("quotation"), proposition(F.col("part"), p, q, F.col("title")).alias("proposition"),
    )
    again = F.row_number().over(Window.partitionBy(key, "normalized", "title").orderBy("place"))
    first = out.withColumn("again", again).filter("again = 1").drop("again")
    return first.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy("place"))).drop("place")

"""Citation anchors in running text, with offsets, from built-in functions.

split and extract-all by the same pattern interleave exactly, so a match
starts where the pieces and matches before it end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The forms of a citation, in order of precedence at equal offsets.
PATTERNS = {
    "NEUTRAL": r"(?i)(?<![A-Za-z0-9_])(?:1[89][0-9]{2}|20[0-9]{2})\s+(?:INSC|SCC?OnLine|DHC|BOMHC|MHC|KERHC|CALHC|APHC|NCLAT|NCLT)\s+[0-9]+(?![A-Za-z0-9_])",
    "REPORTER": r"\((?:1[89][0-9]{2}|20[0-9]{2})\)\s*[0-9]{1,3}\s*[A-Z][A-Za-z.]{1,12}(?:\s+[A-Z][A-Za-z.]{1,12})?\s*[0-9]{1,5}(?![A-Za-z0-9_])",
    "AIR": r"(?<![A-Za-z0-9_])AIR\s+(?:1[89][0-9]{2}|20[0-9]{2})\s+[A-Z]{2,6}\s+[0-9]{1,5}(?![A-Za-z0-9_])",
    "CASE_NUMBER": r"(?i)(?<![A-Za-z0-9_])(?:Company|Civil|Criminal|Transferred|Special\s+Leave)\s+(?:Appeal|Petition|Case)\s*(?:\([A-Z]{1,3}\)\s*)?(?:\((?:Insolvency|Ins)\)\s*)?(?:No\.?|Nos\.?)\s*[0-9]+(?:\s*-\s*[0-9]+)?\s+of\s+(?:1[89][0-9]{2}|20[0-9]{2})",
}
GAP = 6


def anchors(docs: DataFrame, key: str, text: str = "text", patterns: dict[str, str] = PATTERNS) -> DataFrame:
    """key, form, raw, start, end, form_ord, all matches of all forms; offsets in code points from 0."""
    out = None
    for ord_, (form, p) in enumerate(patterns.items()):
        found = docs.select(key, F.split(text, p, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias("raws")).filter(F.size("raws") > 0)
        # One pass with a running offset: a match starts where the gap before it ends.
        step = lambda s, x: F.struct(
            (s["at"] + F.length(x["gap"]) + F.length(x["raw"])).alias("at"),
            F.array_append(s["out"], F.struct(x["raw"].alias("raw"), (s["at"] + F.length(x["gap"])).alias("start"))).alias("out"),
        )
        pairs = F.zip_with("raws", F.slice("gaps", F.lit(1), F.size("raws")), lambda r, g: F.struct(r.alias("raw"), g.alias("gap")))
        starts = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<raw:string,start:int>>").alias("out")), step, lambda s: s["out"])
        one = found.select(key, F.lit(form).alias("form"), F.lit(ord_).alias("form_ord"), F.explode(starts).alias("m")).select(
            key, "form", "form_ord", "m.raw", "m.start", (F.col("m.start") + F.length("m.raw")).alias("end")
        )
        out = one if out is None else out.unionByName(one)
    return out


def merge_adjacent(found: DataFrame, docs: DataFrame, key: str, text: str = "text", gap: int = GAP) -> DataFrame:
    """Anchors at most gap characters of space or , ; | apart become one: key, start, end, n, raw, forms."""
    order = Window.partitionBy(key).orderBy("start", "form_ord")
    prev = found.join(docs.select(key, F.col(text).alias("_t")), key).withColumn("prev_end", F.lag("end").over(order))
    between = F.expr("substring(_t, prev_end + 1, start - prev_end)")
    new = F.col("prev_end").isNull() | (F.col("start") - F.col("prev_end") > gap) | ~((F.col("start") <= F.col("prev_end")) | between.rlike(r"^[\s,;|]*$"))
    grouped = prev.withColumn("grp", F.sum(new.cast("int")).over(order))
    out = grouped.groupBy(key, "grp").agg(
        F.min("start").alias("start"), F.max_by("end", F.struct("start", "form_ord")).alias("end"), F.count(F.lit(1)).alias("n"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "form_ord", "form"))), lambda x: x["form"]), "+").alias("forms"),
    )
    return out.join(docs.select(key, F.col(text).alias("_t")), key).select(
        key, "start", "end", F.col("n").cast("long"), "forms", F.expr("substring(_t, start + 1, end - start)").alias("raw")
    )


#: Fixed value: a reference to a statute, its section and act.
PROVISION = r"(?:Section|Sections|§|§§)\s*([0-9]+[A-Z]?(?:\([0-9a-z]+\))*)\s*(?:of\s+(?:the\s+)?)?([A-Z][A-Za-z,'’\s]{2,60}?(?:Act|Code)(?:,\s*[0-9]{4})?|IBC|ICA|CrPC|CPC|SARFAESI)?"


def provisions(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, section, act ('' if none is named): the distinct statutory references of each text."""
    pick = lambda n: F.regexp_extract_all(text, F.lit(PROVISION), F.lit(n))
    both = docs.select(key, F.explode(F.arrays_zip(pick(1).alias("section"), pick(2).alias("act"))).alias("m"))
    return both.select(key, "m.section", F.trim(F.regexp_replace(F.coalesce("m.act", F.lit("")), r"\s+", " ")).alias("act")).distinct()

"""Scored search, checks of a citation against its record, board and store rules, as columns and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Weights of the signals, factors of courts (by level) and of doctrinal standing.
WEIGHTS = {"citation": 100, "title": 40, "fuzzy": 26, "summary": 12, "issue": 10, "party": 14, "judge": 10, "provision": 18, "impact": 6}
COURT_FACTORS = (1.18, 1.06, 0.94, 0.88)
DOCTRINE_FACTORS = (1.25, 1.14, 1.0, 0.85, 0.5)
#: Thresholds of the checks.
TITLE_SAME, TITLE_CANDIDATE, TIED = 0.72, 0.45, 0.05
QUOTE_VERBATIM, QUOTE_CLOSE, RUN_VERBATIM = 0.85, 0.62, 0.45
SUPPORTED, WEAK = 0.28, 0.24
#: What a status is called, and its tone.
STATUS_LABELS = {
    "VERIFIED": "Verified", "METADATA_MISMATCH": "Metadata mismatch", "PARAGRAPH_MISMATCH": "Paragraph mismatch",
    "WEAK_PROPOSITION_SUPPORT": "Weak proposition support", "NO_AUTHORITATIVE_MATCH": "No authoritative match found", "NEEDS_REVIEW": "Needs human review",
}
STATUS_TONES = {
    "VERIFIED": "verified", "METADATA_MISMATCH": "mismatch", "PARAGRAPH_MISMATCH": "mismatch",
    "WEAK_PROPOSITION_SUPPORT": "review", "NO_AUTHORITATIVE_MATCH": "mismatch", "NEEDS_REVIEW": "review",
}
#: Length and strength of a link by its type, and the names of timeline kinds.
LINK_DISTANCE = {
    "APPEAL_OF": 90, "REVERSES": 90, "AFFIRMS": 90, "REMANDS": 90, "FOLLOWS": 150, "OVERRULES": 150, "DISTINGUISHES": 150,
    "INTERPRETS": 120, "APPLIES": 120, "MENTIONS": 120, "CHALLENGES": 120,
}
LINK_STRENGTH = {"APPEAL_OF": 1.0, "REVERSES": 1.0, "AFFIRMS": 1.0, "REMANDS": 1.0, "FOLLOWS": 0.55, "OVERRULES": 0.55, "DISTINGUISHES": 0.55}
KIND_LABELS = {
    "FILING": "Filed", "DECISION": "Decided", "APPEAL": "On appeal", "REMAND": "Remanded", "AFFIRMATION": "Affirmed below",
    "REVERSAL": "Reversed below", "STATUTORY_EVENT": "Statutory",
}
MAX_UPLOAD = 20 << 20


def looked_up(values: dict, key: Column, default=None) -> Column:
    """A literal map's value for key."""
    found = F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def title_similarity(a: Column, b: Column) -> Column:
    """Of two normalised titles: 0 if one is empty, 1 if equal, else by trigrams and tokens."""

    def scores(x: Column) -> Column:
        tok = T.jaccard(F.array_distinct(T.title_tokens(x["a"])), F.array_distinct(T.title_tokens(x["b"])))
        return F.struct(T.jaccard(T.trigrams(x["a"]), T.trigrams(x["b"])).alias("tri"), tok.alias("tok"))

    def score(x: Column) -> Column:
        like = T.once(scores(x), lambda s: F.greatest(s["tri"], (s["tri"] + s["tok"]) / 2))
        return F.when((x["a"] == "") | (x["b"] == ""), 0.0).when(x["a"] == x["b"], 1.0).otherwise(like)

    return T.once(F.struct(a.alias("a"), b.alias("b")), score)


def query_tokens(text: Column) -> Column:
    return F.filter(T.words(T.norm_paragraph(text)), lambda x: F.length(x) > 2)


def field_match(tokens: Column, field: Column) -> Column:
    """Share of the query's tokens that the field has; 0 if either is empty."""
    return T.containment(tokens, T.words(T.norm_paragraph(F.coalesce(field, F.lit("")))))


def first_match(values: Column, score, least: float) -> Column:
    """The first of values whose score reaches least, as struct(value, score); null where none does."""
    return F.get(F.filter(F.transform(values, lambda v: F.struct(v.alias("value"), score(v).alias("score"))), lambda x: x["score"] >= least), F.lit(0))


def scored(cases: DataFrame, query: str) -> DataFrame:
    """cases(ord, title, citation, summary, issues, parties, judges, section, cited, court_level, doctrine) with score > 0:
    ord, score, reasons (the three that weigh first). Every signal is a column of the row; nothing is joined."""
    q = F.lit(query)
    tokens, norm = query_tokens(q), T.norm_title(q)
    exact = T.norm_citation("citation") == T.norm_citation(q)
    same = T.norm_title(F.col("title"))
    sim = title_similarity(same, norm)
    parts = cases.withColumns({
        "exact": exact, "same": same == norm, "sim": sim, "in_title": field_match(tokens, F.col("title")), "in_summary": field_match(tokens, F.col("summary")),
        "issue": first_match(F.col("issues"), lambda v: field_match(tokens, v), 0.5),
        "party": first_match(F.col("parties"), lambda v: F.when(title_similarity(T.norm_title(v), norm) >= 0.55, 1.0).otherwise(field_match(tokens, v)), 0.8),
        "judge": first_match(F.col("judges"), lambda v: field_match(tokens, v), 0.8),
        "named": F.contains(T.norm_paragraph(q), F.concat(F.lit("section "), F.col("section"))),
    })
    base = (
        F.when(F.col("exact"), WEIGHTS["citation"]).otherwise(0)
        + F.when(F.col("same"), WEIGHTS["title"]).when(F.col("sim") >= 0.4, WEIGHTS["fuzzy"] * F.col("sim")).otherwise(0)
        + 0.5 * WEIGHTS["title"] * F.col("in_title") + WEIGHTS["summary"] * F.col("in_summary")
        + F.coalesce(WEIGHTS["issue"] * F.col("issue.score"), F.lit(0.0))
        + F.when(F.col("party").isNotNull(), WEIGHTS["party"]).otherwise(0) + F.when(F.col("judge").isNotNull(), WEIGHTS["judge"]).otherwise(0)
        + F.when(F.col("named"), WEIGHTS["provision"]).otherwise(0)
    )
    factor = F.element_at(F.array(*map(F.lit, COURT_FACTORS)), F.col("court_level")) * F.element_at(F.array(*map(F.lit, DOCTRINE_FACTORS)), F.col("doctrine"))
    with_impact = F.col("base") + WEIGHTS["impact"] * F.log10(F.col("cited") + 1) / 3
    reasons = F.slice(F.array_compact(F.array(
        F.when((F.col("court_level") == 1) & ~F.col("exact"), "authority"), F.when(F.col("exact"), "citation"), F.when(F.col("same"), "title").when(F.col("sim") >= 0.4, "similar title"),
        F.when(F.col("in_summary") >= 0.4, "summary"), F.when(F.col("issue").isNotNull(), F.concat(F.lit("issue "), F.col("issue.value"))),
        F.when(F.col("party").isNotNull(), F.concat(F.lit("party "), F.col("party.value"))), F.when(F.col("judge").isNotNull(), "judge"), F.when(F.col("named"), "provision"),
    )), 1, 3)
    out = parts.withColumn("base", base.cast("double")).filter("base > 0")
    return out.select("ord", (with_impact * F.when(F.col("exact"), 1.0).otherwise(factor)).alias("score"), F.array_join(reasons, "; ").alias("reasons"))


def resolved(claims: DataFrame, forms: DataFrame) -> DataFrame:
    """claims(claim, ids array of citations in order), forms(form, ord) -> claim, ord, method of those that an identifier
    finds: the first identifier with a record, of several records with it the last."""
    index = forms.select(T.norm_citation("form").alias("form"), "ord").filter("form <> ''").groupBy("form").agg(F.max("ord").alias("ord"))
    each = claims.select("claim", F.posexplode("ids").alias("nth", "id")).filter("id IS NOT NULL")
    hits = each.join(index, T.norm_citation(F.col("id")) == F.col("form")).groupBy("claim").agg(F.min_by("ord", "nth").alias("ord"))
    return hits.withColumn("method", F.lit("EXACT_CITATION"))


def ranked_candidates(candidates: DataFrame) -> DataFrame:
    """candidates(claim, ord, sim, reporter_ok, court_ok, year_ok, year_near, paragraph_ok) -> with rank: those within TIED of
    the best title by points, then title; the rest behind them by title."""
    best = F.max("sim").over(Window.partitionBy("claim"))
    points = 3 * F.col("reporter_ok").cast("int") + 3 * F.col("court_ok").cast("int") + F.when(F.col("year_ok"), 2).when(F.col("year_near"), 1).otherwise(0) + F.col("paragraph_ok").cast("int")
    tied = best - F.col("sim") < TIED
    rows = candidates.withColumn("tied", tied).withColumn("points", F.when(F.col("tied"), points).otherwise(-1))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("claim").orderBy(F.desc("tied"), F.desc("points"), F.desc("sim"), "ord")))


def metadata_mismatches(title_sim: Column, year: Column, years: Column, reporter: Column, forms: Column, court: Column, record_court: Column) -> Column:
    """Names of the fields that a document claims and its record contradicts; an unclaimed field (null) agrees."""
    court_ok = (title_similarity(T.norm_title(court), T.norm_title(record_court)) >= 0.5) | F.contains(F.lower(record_court), F.lower(court)) | F.contains(F.lower(court), F.lower(record_court))
    return F.array_compact(F.array(
        F.when(title_sim < TITLE_SAME, "case title"), F.when(~F.array_contains(years, year), "year"),
        F.when(~F.exists(forms, lambda x: F.contains(T.norm_citation(x), reporter)), "reporter series"), F.when(~court_ok, "forum"),
    ))


def quotation_outcome(exact: Column, score: Column, run: Column) -> Column:
    return (
        F.when(exact, "PASS").when((score >= QUOTE_VERBATIM) & (run >= RUN_VERBATIM), "PARTIAL").when(score >= QUOTE_CLOSE, "FAIL_WITH_MATCH").otherwise("FAIL")
    )


def proposition_outcome(score: Column) -> Column:
    return F.when(score >= SUPPORTED, "SUPPORTED").when(score < WEAK, "WEAK").otherwise("UNCERTAIN")


def upload_outcome(size: Column, mime: Column, head: Column) -> Column:
    """The first rule that an upload breaks, in order; ACCEPTED if none."""
    return (
        F.when(size == 0, "EMPTY").when(size > MAX_UPLOAD, "TOO_LARGE").when(~mime.isin("application/pdf", "text/plain"), "UNSUPPORTED_TYPE")
        .when((mime == "application/pdf") & (head != "%PDF-"), "NOT_A_PDF").otherwise("ACCEPTED")
    )


def without_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame, key: str = "node") -> tuple[DataFrame, DataFrame]:
    """nodes(node, ..), edges(a, b, ..) less the nodes of gone(node), and every edge that loses an end."""
    gone = gone.select(key).distinct()
    ends = lambda e: gone.withColumnRenamed(key, e)
    return nodes.join(gone, key, "left_anti"), edges.join(ends("a"), "a", "left_anti").join(ends("b"), "b", "left_anti")


def allowed_edges(wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of wanted(a, b, ..) those that are no self-link and whose ends are both nodes(node)."""
    ends = lambda e: nodes.select(F.col("node").alias(e)).distinct()
    return wanted.filter("a <> b").join(ends("a"), "a", "left_semi").join(ends("b"), "b", "left_semi")

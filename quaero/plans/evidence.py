"""Search, verification, reports, board and documents as queries over the driver's tables.

Customers stand for cases (parties from customer and nation, forum from region), suppliers for
the citations of a document, orders for what refers to a case, events for pins on a board.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import claims, evidence, similarity
from ..sources import texts
from . import duck as D
from .catalog import query, t

# ---------------------------------------------------------------- the casebook

_CASES = """SELECT c_custkey AS ord, c_name || ' v. ' || n_name AS title, c_name, n_name, r_name AS court, c_mktsegment AS summary, 1990 + c_custkey % 30 AS y,
 '(' || CAST(1990 + c_custkey % 30 AS VARCHAR) || ') ' || CAST(c_custkey % 19 + 1 AS VARCHAR) || ' SCC ' || CAST(c_custkey AS VARCHAR) AS citation,
 c_nationkey % 4 + 1 AS court_level, c_custkey % 5 + 1 AS doctrine, CAST(c_custkey % 200 + 1 AS VARCHAR) AS section, coalesce(cited, 0) AS cited, decided
 FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
 LEFT JOIN (SELECT o_custkey, count(*) AS cited, max(o_orderdate) AS decided FROM orders GROUP BY 1) ON o_custkey = c_custkey"""


def _cases(spark, d) -> DataFrame:
    per = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("cited"), F.max("o_orderdate").alias("decided"))
    rows = t(spark, d, "customer").join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    y = 1990 + F.col("c_custkey") % 30
    text = lambda c: c.cast("string")
    return rows.join(per, "c_custkey", "left").select(
        F.col("c_custkey").alias("ord"), F.concat("c_name", F.lit(" v. "), "n_name").alias("title"), "c_name", "n_name", F.col("r_name").alias("court"), F.col("c_mktsegment").alias("summary"), y.alias("y"),
        F.concat(F.lit("("), text(y), F.lit(") "), text(F.col("c_custkey") % 19 + 1), F.lit(" SCC "), text(F.col("c_custkey"))).alias("citation"),
        (F.col("c_nationkey") % 4 + 1).alias("court_level"), (F.col("c_custkey") % 5 + 1).cast("int").alias("doctrine"), text(F.col("c_custkey") % 200 + 1).alias("section"), F.coalesce("cited", F.lit(0)).alias("cited"), "decided",
    )


def _sim(a: str, b: str) -> str:
    tok = lambda x: f"list_distinct(list_filter(string_split({x}, ' '), lambda w: length(w) > 1))"
    tri = D.jaccard(D.trigrams(a), D.trigrams(b))
    return f"(CASE WHEN {a} = '' OR {b} = '' THEN 0.0 WHEN {a} = {b} THEN 1.0 ELSE greatest({tri}, ({tri} + {D.jaccard(tok(a), tok(b))}) / 2) END)"


def _share(needle: str, hay: str) -> str:
    return f"(CASE WHEN len({needle}) = 0 THEN 0.0 ELSE len(list_filter({needle}, lambda w: list_contains({hay}, w))) / len({needle}) END)"


def _field(tokens: str, field: str) -> str:
    return _share(tokens, D.words(D.norm_paragraph(field)))


# ---------------------------------------------------------------- search


def _scored_sql(q: str) -> str:
    lit = D.q(q)
    return f"""WITH c AS ({_CASES}), q AS (SELECT {D.norm_paragraph(lit)} AS np, {D.norm_title(lit)} AS nt, {D.norm_citation(lit)} AS nc, list_filter({D.words(D.norm_paragraph(lit))}, lambda w: length(w) > 2) AS tk),
      s AS (SELECT c.*, tk, {D.norm_citation('citation')} = nc AS exact, {D.norm_title('title')} AS n1, {D.norm_title('c_name')} AS p1, {D.norm_title('n_name')} AS p2, nt, contains(np, 'section ' || section) AS named FROM c, q),
      f AS (SELECT *, {_sim('n1', 'nt')} AS sim, {_field('tk', 'title')} AS in_title, {_field('tk', 'summary')} AS in_summary, {_field('tk', 'court')} AS in_judge,
        CASE WHEN {_field('tk', 'summary')} >= 0.5 THEN {_field('tk', 'summary')} END AS issue,
        CASE WHEN {_sim('p1', 'nt')} >= 0.55 OR {_field('tk', 'c_name')} >= 0.8 THEN c_name WHEN {_sim('p2', 'nt')} >= 0.55 OR {_field('tk', 'n_name')} >= 0.8 THEN n_name END AS party FROM s),
      b AS (SELECT *, CASE WHEN exact THEN 100 ELSE 0 END + CASE WHEN n1 = nt THEN 40 WHEN sim >= 0.4 THEN 26 * sim ELSE 0 END + 20 * in_title + 12 * in_summary + coalesce(10 * issue, 0)
        + CASE WHEN party IS NOT NULL THEN 14 ELSE 0 END + CASE WHEN in_judge >= 0.8 THEN 10 ELSE 0 END + CASE WHEN named THEN 18 ELSE 0 END AS base FROM f)
      SELECT ord, round((base + 6 * log10(cited + 1) / 3) * CASE WHEN exact THEN 1.0 ELSE [1.18, 1.06, 0.94, 0.88][court_level] * [1.25, 1.14, 1.0, 0.85, 0.5][doctrine] END, 6) AS score,
        array_to_string(list_filter([CASE WHEN court_level = 1 AND NOT exact THEN 'authority' END, CASE WHEN exact THEN 'citation' END, CASE WHEN n1 = nt THEN 'title' WHEN sim >= 0.4 THEN 'similar title' END,
          CASE WHEN in_summary >= 0.4 THEN 'summary' END, CASE WHEN issue IS NOT NULL THEN 'issue ' || summary END, CASE WHEN party IS NOT NULL THEN 'party ' || party END,
          CASE WHEN in_judge >= 0.8 THEN 'judge' END, CASE WHEN named THEN 'provision' END], lambda x: x IS NOT NULL)[1:3], '; ') AS reasons FROM b WHERE base > 0"""


def _search(spark, d, q: str) -> DataFrame:
    rows = _cases(spark, d).select(
        "ord", "title", "citation", "summary", F.array("summary").alias("issues"), F.array("c_name", "n_name").alias("parties"), F.array("court").alias("judges"), "section", "cited", "court_level", "doctrine"
    )
    return evidence.scored(rows, q).select("ord", F.round("score", 6).alias("score"), "reasons")


_BY_TITLE, _BY_FORUM, _BY_CITATION = "Customer#000000007 v. FRANCE building section 12", "Europe", "(1997) 8 S.C.C. 7"


@query(_scored_sql(_BY_TITLE))
def search_scored(spark, d):
    return _search(spark, d, _BY_TITLE)


@query(_scored_sql(_BY_FORUM))
def search_by_forum(spark, d):
    return _search(spark, d, _BY_FORUM)


@query(_scored_sql(_BY_CITATION))
def search_by_citation(spark, d):
    return _search(spark, d, _BY_CITATION)


@query(_scored_sql("zzzznotanauthorityzzzz"))
def search_without_hits(spark, d):
    return _search(spark, d, "zzzznotanauthorityzzzz")


_LIKE = "Customer 000000012 v. Germany"


@query(f"WITH c AS (SELECT ord, {D.norm_title('title')} AS n1, {D.norm_title(D.q(_LIKE))} AS nt FROM ({_CASES})) SELECT ord, round(s, 6) AS score FROM (SELECT ord, {_sim('n1', 'nt')} AS s FROM c) WHERE s >= 0.45")
def cases_by_title(spark, d):
    """Cases whose titles are like the given one, best first."""
    sim = evidence.title_similarity(T.norm_title(F.col("title")), T.norm_title(F.lit(_LIKE)))
    return _cases(spark, d).select("ord", F.round(sim, 9).alias("s")).filter("s >= 0.45").orderBy(F.desc("s"), "ord").select("ord", F.round("s", 6).alias("score"))


_PART = "SCC 12"


@query(f"WITH c AS (SELECT ord, {D.norm_title('title')} AS n1, {D.norm_title(D.q(_PART))} AS nt, {D.norm_citation('citation')} AS form FROM ({_CASES})), s AS (SELECT ord, CASE WHEN contains(form, {D.norm_citation(D.q(_PART))}) THEN 1.0 ELSE {_sim('n1', 'nt')} END AS score FROM c) SELECT ord, round(score, 6) AS score FROM s WHERE score >= 0.35 ORDER BY score DESC, ord LIMIT 6")
def suggest(spark, d):
    """Six suggestions: a citation that holds what was typed, else titles like it."""
    sim = evidence.title_similarity(T.norm_title(F.col("title")), T.norm_title(F.lit(_PART)))
    score = F.when(F.contains(T.norm_citation(F.col("citation")), T.norm_citation(F.lit(_PART))), 1.0).otherwise(sim)
    return _cases(spark, d).select("ord", F.round(score, 9).alias("s")).filter("s >= 0.35").orderBy(F.desc("s"), "ord").limit(6).select("ord", F.round("s", 6).alias("score"))


@query(f"SELECT ord, CAST(decided AS VARCHAR) AS decided FROM ({_CASES})")
def list_cases(spark, d):
    """All cases, the latest first, undated ones last."""
    return _cases(spark, d).orderBy(F.desc_nulls_last("decided"), "ord").select("ord", F.col("decided").cast("string").alias("decided"))


@query(f"SELECT ord, cited FROM ({_CASES}) WHERE doctrine = 1 ORDER BY cited DESC, ord LIMIT 4")
def home_landmarks(spark, d):
    return _cases(spark, d).filter("doctrine = 1").orderBy(F.desc("cited"), "ord").limit(4).select("ord", "cited")


@query(f"WITH c AS ({_CASES}), y AS (SELECT y, count(*) AS n FROM c GROUP BY 1), s AS (SELECT count(*) FILTER (WHERE doctrine = 1) AS a, count(*) FILTER (WHERE doctrine = 2) AS b, count(*) FILTER (WHERE doctrine = 5) AS e FROM c) SELECT y, n, round(greatest(0.08, n / max(n) OVER ()), 6) AS bar, n = max(n) OVER () AS peak, round(a / greatest(1, a + b + e), 6) AS share FROM y, s")
def search_analytics(spark, d):
    """Hits by year with bars against the peak year, and the share of one standing among three."""
    c = _cases(spark, d)
    years = c.groupBy("y").agg(F.count(F.lit(1)).alias("n"))
    # One row of totals goes to every year.
    top = years.agg(F.max("n").alias("top"))
    totals = c.agg(F.count_if(F.col("doctrine") == 1).alias("a"), F.count_if(F.col("doctrine") == 2).alias("b"), F.count_if(F.col("doctrine") == 5).alias("e"))
    rows = years.crossJoin(F.broadcast(top)).crossJoin(F.broadcast(totals))
    return rows.select("y", "n", F.round(F.greatest(F.lit(0.08), F.col("n") / F.col("top")), 6).alias("bar"), (F.col("n") == F.col("top")).alias("peak"), F.round(F.col("a") / F.greatest(F.lit(1), F.col("a") + F.col("b") + F.col("e")), 6).alias("share"))


@query("SELECT p_partkey, coalesce(n, 0) AS cited FROM part LEFT JOIN (SELECT l_partkey, count(DISTINCT l_orderkey) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_partkey = p_partkey")
def citation_counts(spark, d):
    n = t(spark, d, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.countDistinct("l_orderkey").alias("n"))
    return t(spark, d, "part").select("p_partkey").join(n, "p_partkey", "left").select("p_partkey", F.coalesce("n", F.lit(0)).alias("cited"))


_ASKED = "the of and these words with a question"


@query(f"SELECT doc_id, round(s, 6) AS score FROM (SELECT doc_id, {_share(D.words(D.norm_paragraph(D.q(_ASKED))), D.words(D.norm_paragraph('text')))} AS s FROM documents) WHERE s > 0.15")
def paragraphs_for_question(spark, d):
    """Texts that hold more than 15 % of the question's words."""
    s = T.containment(T.words(T.norm_paragraph(F.lit(_ASKED))), T.words(T.norm_paragraph(F.col("text"))))
    return t(spark, d, "documents").select("doc_id", s.alias("s")).filter("s > 0.15").orderBy(F.desc("s"), "doc_id").select("doc_id", F.round("s", 6).alias("score"))


# ---------------------------------------------------------------- verification

# A document's citations: one a supplier; some name a case by its citation, some by a neutral one, some by none that is known.
_CLAIMS = """SELECT s_suppkey AS claim, s_suppkey * 13 % 140 + 1 AS target, CASE WHEN s_suppkey % 5 = 0 THEN '(1950) 1 ABC ' || CAST(s_suppkey AS VARCHAR) ELSE '(' || CAST(1990 + (s_suppkey * 13 % 140 + 1) % 30 AS VARCHAR) || ') ' || CAST((s_suppkey * 13 % 140 + 1) % 19 + 1 AS VARCHAR) || ' S.C.C. ' || CAST(s_suppkey * 13 % 140 + 1 AS VARCHAR) END AS raw,
 CASE WHEN s_suppkey % 4 = 0 THEN 1 ELSE 0 END AS off, s_suppkey % 3 AS k FROM supplier"""


def _claims(spark, d) -> DataFrame:
    s = F.col("s_suppkey")
    target = s * 13 % 140 + 1
    text = lambda c: c.cast("string")
    raw = F.when(s % 5 == 0, F.concat(F.lit("(1950) 1 ABC "), text(s))).otherwise(F.concat(F.lit("("), text(1990 + target % 30), F.lit(") "), text(target % 19 + 1), F.lit(" S.C.C. "), text(target)))
    return t(spark, d, "supplier").select(s.alias("claim"), target.alias("target"), raw.alias("raw"), F.when(s % 4 == 0, 1).otherwise(0).alias("off"), (s % 3).alias("k"))


def _resolved(spark, d) -> DataFrame:
    forms = _cases(spark, d).select(F.col("citation").alias("form"), "ord")
    ids = F.array(F.when(F.col("k") == 0, F.lit("2001 INSC 1")), F.col("raw"))
    return evidence.resolved(_claims(spark, d).withColumn("ids", ids), forms)


_FOUND = f"SELECT claim, ord, 'EXACT_CITATION' AS method FROM ({_CLAIMS}) JOIN ({_CASES}) ON {D.norm_citation('raw')} = {D.norm_citation('citation')}"


@query(f"SELECT * FROM ({_FOUND})")
def resolve_authority(spark, d):
    return _resolved(spark, d).select("claim", "ord", "method")


_CLAIMED = "SELECT f.claim, c.ord, CASE WHEN k = 1 THEN 'Someone else v. Nobody' ELSE c.title END AS said, CAST(c.y + off AS INT) AS said_year, CASE WHEN k = 2 THEN 'AIR' ELSE 'SCC' END AS said_reporter, CASE WHEN f.claim % 7 = 0 THEN 'NOWHERE' ELSE lower(c.court) END AS said_court, c.title, c.y, c.citation, c.court FROM ({f}) f JOIN ({c}) c USING (ord) JOIN ({k}) k ON k.claim = f.claim".format(f=_FOUND, c=_CASES, k=_CLAIMS)
_MIS = f"""SELECT claim, ord, array_to_string(list_filter([CASE WHEN {_sim('n1', 'n2')} < 0.72 THEN 'case title' END, CASE WHEN said_year <> y THEN 'year' END, CASE WHEN NOT contains({D.norm_citation('citation')}, said_reporter) THEN 'reporter series' END,
 CASE WHEN NOT ({_sim('c1', 'c2')} >= 0.5 OR contains(lower(court), lower(said_court)) OR contains(lower(said_court), lower(court))) THEN 'forum' END], lambda x: x IS NOT NULL), ', ') AS mismatches
 FROM (SELECT *, {D.norm_title('said')} AS n1, {D.norm_title('title')} AS n2, {D.norm_title('said_court')} AS c1, {D.norm_title('court')} AS c2 FROM ({_CLAIMED}))"""


def _checked(spark, d) -> DataFrame:
    rows = _resolved(spark, d).join(_cases(spark, d), "ord").join(_claims(spark, d).select("claim", "off", "k"), "claim")
    said = F.when(F.col("k") == 1, "Someone else v. Nobody").otherwise(F.col("title"))
    bad = evidence.metadata_mismatches(
        evidence.title_similarity(T.norm_title(said), T.norm_title(F.col("title"))), (F.col("y") + F.col("off")).cast("int"), F.array(F.col("y").cast("int"), T.extract_year(F.col("citation"))),
        F.when(F.col("k") == 2, "AIR").otherwise("SCC"), F.array("citation"), F.when(F.col("claim") % 7 == 0, "NOWHERE").otherwise(F.lower("court")), F.col("court"),
    )
    return rows.withColumn("mismatches", F.array_join(bad, ", "))


@query(_MIS)
def check_metadata(spark, d):
    return _checked(spark, d).select("claim", "ord", "mismatches")


_STAT = "CASE WHEN ord IS NULL THEN 'NO_AUTHORITATIVE_MATCH' WHEN ord % 9 = 0 THEN 'NEEDS_REVIEW' WHEN mismatches <> '' THEN 'METADATA_MISMATCH' WHEN ord % 7 = 0 THEN 'PARAGRAPH_MISMATCH' WHEN ord % 5 = 0 THEN 'WEAK_PROPOSITION_SUPPORT' ELSE 'VERIFIED' END"
_VERIFIED = f"SELECT k.claim, m.ord, coalesce(mismatches, '') AS mismatches, {_STAT} AS status, raw FROM ({_CLAIMS}) k LEFT JOIN ({_MIS}) m ON m.claim = k.claim"
_EXPLAIN = """CASE status WHEN 'VERIFIED' THEN raw || ' resolves to case ' || CAST(ord AS VARCHAR) || ' and agrees with it.' WHEN 'METADATA_MISMATCH' THEN 'Case ' || CAST(ord AS VARCHAR) || ' differs in ' || mismatches || '.'
 WHEN 'PARAGRAPH_MISMATCH' THEN 'The passage is not in case ' || CAST(ord AS VARCHAR) || '.' WHEN 'WEAK_PROPOSITION_SUPPORT' THEN 'Case ' || CAST(ord AS VARCHAR) || ' hardly bears the proposition out.' WHEN 'NO_AUTHORITATIVE_MATCH' THEN raw || ' is not in the connected sources.' ELSE raw || ' needs a reader.' END"""


def _verified(spark, d) -> DataFrame:
    """Each citation with its record if it has one, the fields that disagree and the status of the ladder. A record's
    number stands for what the passage checks found: by 9 not indexed, by 7 quotation missing, by 5 weak."""
    from .catalog import status

    rows = _claims(spark, d).select("claim", "raw").join(_checked(spark, d).select("claim", "ord", "mismatches"), "claim", "left").withColumn("mismatches", F.coalesce("mismatches", F.lit("")))
    o, no = F.coalesce("ord", F.lit(0)), F.lit(False)
    name = status(F.col("ord").isNotNull(), o % 9 == 0, no, F.col("mismatches") != "", o % 7 == 0, no, F.lit(True), o % 5 == 0, F.lit(True))
    return rows.withColumn("status", name)


@query(f"SELECT claim, coalesce(ord, -1) AS ord, status, mismatches, {_EXPLAIN} AS explanation, CASE status " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in evidence.STATUS_LABELS.items()) + " END AS label, CASE status " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in evidence.STATUS_TONES.items()) + f" END AS tone FROM ({_VERIFIED})")
def verify_citations(spark, d):
    s, o = F.col("status"), F.col("ord").cast("string")
    say = (
        F.when(s == "VERIFIED", F.concat("raw", F.lit(" resolves to case "), o, F.lit(" and agrees with it."))).when(s == "METADATA_MISMATCH", F.concat(F.lit("Case "), o, F.lit(" differs in "), "mismatches", F.lit(".")))
        .when(s == "PARAGRAPH_MISMATCH", F.concat(F.lit("The passage is not in case "), o, F.lit("."))).when(s == "WEAK_PROPOSITION_SUPPORT", F.concat(F.lit("Case "), o, F.lit(" hardly bears the proposition out.")))
        .when(s == "NO_AUTHORITATIVE_MATCH", F.concat("raw", F.lit(" is not in the connected sources."))).otherwise(F.concat("raw", F.lit(" needs a reader.")))
    )
    return _verified(spark, d).select("claim", F.coalesce("ord", F.lit(-1)).alias("ord"), "status", "mismatches", say.alias("explanation"), evidence.looked_up(evidence.STATUS_LABELS, s).alias("label"), evidence.looked_up(evidence.STATUS_TONES, s).alias("tone"))


_CAND = "SELECT s_suppkey AS claim, c_custkey AS ord, 0.9 - (c_custkey % 10) / 100.0 AS sim, c_custkey % 2 = 0 AS reporter_ok, c_custkey % 3 = 0 AS court_ok, c_custkey % 5 = 0 AS year_ok, c_custkey % 5 = 1 AS year_near, c_custkey % 4 = 0 AS paragraph_ok FROM supplier JOIN customer ON s_nationkey = c_nationkey AND c_custkey % 8 = s_suppkey % 8"


@query(f"""WITH c AS ({_CAND}), b AS (SELECT *, max(sim) OVER (PARTITION BY claim) - sim < 0.05 AS tied FROM c), p AS (SELECT *, CASE WHEN tied THEN 3 * CAST(reporter_ok AS INT) + 3 * CAST(court_ok AS INT) + CASE WHEN year_ok THEN 2 WHEN year_near THEN 1 ELSE 0 END + CAST(paragraph_ok AS INT) ELSE -1 END AS points FROM b)
    SELECT claim, ord, CAST(points AS BIGINT) AS points, CAST(rank AS BIGINT) AS rank, rank BETWEEN 2 AND 3 AS near_miss, NOT tied AS rest FROM (SELECT *, row_number() OVER (PARTITION BY claim ORDER BY tied DESC, points DESC, sim DESC, ord) AS rank FROM p)""")
def disambiguate(spark, d):
    """Candidates of each citation in order; the two after the best are its near misses."""
    s, c = t(spark, d, "supplier"), t(spark, d, "customer")
    k = F.col("c_custkey")
    rows = s.join(c, (F.col("s_nationkey") == F.col("c_nationkey")) & (k % 8 == F.col("s_suppkey") % 8)).select(
        F.col("s_suppkey").alias("claim"), k.alias("ord"), (F.lit(0.9) - (k % 10) / 100.0).alias("sim"), (k % 2 == 0).alias("reporter_ok"), (k % 3 == 0).alias("court_ok"), (k % 5 == 0).alias("year_ok"), (k % 5 == 1).alias("year_near"), (k % 4 == 0).alias("paragraph_ok"),
    )
    rows = rows.withColumn("sim", F.col("sim").cast("decimal(5,3)"))
    return evidence.ranked_candidates(rows).select("claim", "ord", F.col("points").cast("long"), F.col("rank").cast("long"), F.col("rank").between(2, 3).alias("near_miss"), (~F.col("tied")).alias("rest"))


@query("SELECT p_brand AS provision, o_orderkey AS ord, CAST(max(o_orderdate) AS VARCHAR) AS decided FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2")
def cases_by_provision(spark, d):
    """Each provision's cases once, the latest first."""
    links = t(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey")).join(t(spark, d, "part").select("p_partkey", "p_brand"), "p_partkey").select(F.col("p_brand").alias("provision"), F.col("l_orderkey").alias("o_orderkey")).distinct()
    rows = links.join(t(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderkey")
    return rows.orderBy("provision", F.desc_nulls_last("o_orderdate"), "o_orderkey").select("provision", F.col("o_orderkey").alias("ord"), F.col("o_orderdate").cast("string").alias("decided"))


@query("SELECT l_orderkey AS doc, l_linenumber AS cite, coalesce(o_custkey, -1) AS case_ord, p_name AS passage FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey AND o_orderstatus = 'F' LEFT JOIN part ON p_partkey = l_partkey AND p_size < 20")
def review_rows(spark, d):
    """Every result with its case and its passage where it has them."""
    o = t(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("case_ord"))
    p = t(spark, d, "part").filter("p_size < 20").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("passage"))
    return t(spark, d, "lineitem").join(o, "l_orderkey", "left").join(p, "l_partkey", "left").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("cite"), F.coalesce("case_ord", F.lit(-1)).alias("case_ord"), "passage")


@query("SELECT l_partkey AS cite, min(l_orderkey) AS doc FROM lineitem GROUP BY 1")
def first_verification(spark, d):
    """The first document that holds a citation."""
    return t(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("cite")).agg(F.min("l_orderkey").alias("doc"))


@query("SELECT user_id, count(*) FILTER (WHERE event_id IN (SELECT l_orderkey FROM lineitem)) AS known, count(*) FILTER (WHERE event_id NOT IN (SELECT l_orderkey FROM lineitem)) AS unknown FROM events GROUP BY 1")
def known_ids(spark, d):
    """Cited ids that exist, and those that do not."""
    there = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("event_id")).distinct().withColumn("there", F.lit(True))
    rows = t(spark, d, "events").select("user_id", "event_id").join(there, "event_id", "left")
    return rows.groupBy("user_id").agg(F.count_if("there").alias("known"), F.count_if(F.col("there").isNull()).alias("unknown"))


_PARAS = "SELECT doc_id, CAST(i AS BIGINT) AS number, l AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)"


def _paras(spark, d) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "text")).select("doc_id", (F.col("i") + 1).cast("long").alias("number"), "text")


@query(f"WITH p AS ({_PARAS}), w AS (SELECT doc_id, doc_id % 12 + 1 AS cited, doc_id % 12 - 1 AS found FROM documents) SELECT w.doc_id, cited, p.doc_id IS NOT NULL AS has_number, CASE WHEN found > 0 AND found <> cited THEN 'MISMATCH' ELSE 'AGREES' END AS location, r.n AS fallback FROM w LEFT JOIN p ON p.doc_id = w.doc_id AND number = cited LEFT JOIN (SELECT doc_id, coalesce(min(number) FILTER (WHERE length(text) > 200), min(number)) AS n FROM p GROUP BY 1) r ON r.doc_id = w.doc_id")
def paragraph_lookup(spark, d):
    """Whether a cited paragraph exists, whether the quotation stood in it, and the passage that is shown instead."""
    p = _paras(spark, d)
    w = t(spark, d, "documents").select("doc_id", (F.col("doc_id") % 12 + 1).alias("cited"), (F.col("doc_id") % 12 - 1).alias("found"))
    fallback = p.groupBy("doc_id").agg(F.coalesce(F.min(F.when(F.length("text") > 200, F.col("number"))), F.min("number")).alias("fallback"))
    hit = p.select("doc_id", F.col("number").alias("cited"), F.lit(True).alias("hit"))
    location = F.when((F.col("found") > 0) & (F.col("found") != F.col("cited")), "MISMATCH").otherwise("AGREES")
    return w.join(hit, ["doc_id", "cited"], "left").join(fallback, "doc_id", "left").select("doc_id", "cited", F.coalesce("hit", F.lit(False)).alias("has_number"), location.alias("location"), "fallback")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN exact THEN 'PASS' WHEN share >= 0.85 AND run >= 0.45 THEN 'PARTIAL' WHEN share >= 0.62 THEN 'FAIL_WITH_MATCH' ELSE 'FAIL' END AS quotation, CASE WHEN share >= 0.28 THEN 'SUPPORTED' WHEN share < 0.24 THEN 'WEAK' ELSE 'UNCERTAIN' END AS proposition FROM (SELECT l_orderkey, l_linenumber, round(l_quantity / 50, 4) AS share, round(l_tax * 10, 4) AS run, l_discount = 0 AS exact FROM lineitem)")
def outcome_thresholds(spark, d):
    """What scores mean to the quotation and proposition checks; the checks themselves are in verify_brief."""
    share, run = F.round(F.col("l_quantity") / 50, 4), F.round(F.col("l_tax") * 10, 4)
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", evidence.quotation_outcome(F.col("l_discount") == 0, share, run).alias("quotation"), evidence.proposition_outcome(share).alias("proposition"))


# ---------------------------------------------------------------- graph views (G-2-G-4, G-6, P11, T2)

_TYPES = "CASE l_linenumber % 4 WHEN 0 THEN 'CITES' WHEN 1 THEN 'FOLLOWS' WHEN 2 THEN 'AFFIRMS' ELSE 'MENTIONS' END"


def _links(spark, d) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ("CITES", "FOLLOWS", "AFFIRMS", "MENTIONS"))), (F.col("l_linenumber") % 4 + 1).cast("int"))
    return t(spark, d, "lineitem").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b"), kind.alias("type")).distinct()


@query(f"SELECT type, count(*) AS n, CASE type WHEN 'AFFIRMS' THEN 90 WHEN 'FOLLOWS' THEN 150 WHEN 'MENTIONS' THEN 120 ELSE 190 END AS distance, CASE type WHEN 'AFFIRMS' THEN 1.0 WHEN 'FOLLOWS' THEN 0.55 ELSE 0.3 END AS strength FROM (SELECT DISTINCT l_suppkey, l_partkey, {_TYPES} AS type FROM lineitem) GROUP BY 1")
def edge_attributes(spark, d):
    kind = F.col("type")
    return _links(spark, d).groupBy("type").agg(F.count(F.lit(1)).alias("n")).select("type", "n", evidence.looked_up(evidence.LINK_DISTANCE, kind, 190).alias("distance"), evidence.looked_up(evidence.LINK_STRENGTH, kind, 0.3).alias("strength"))


@query(f"SELECT ord, title AS label, CASE WHEN ord % 3 = 0 THEN citation WHEN ord % 3 = 1 THEN 'Civil Appeal No. ' || CAST(ord AS VARCHAR) ELSE court END AS sublabel, CAST(year(decided) AS BIGINT) AS year FROM ({_CASES})")
def graph_nodes(spark, d):
    """Label, then citation, case number or forum, whichever there is first, and the year."""
    o = F.col("ord")
    sub = F.coalesce(F.when(o % 3 == 0, F.col("citation")), F.when(o % 3 == 1, F.concat(F.lit("Civil Appeal No. "), o.cast("string"))), F.col("court"))
    return _cases(spark, d).select("ord", F.col("title").alias("label"), sub.alias("sublabel"), F.year("decided").cast("long").alias("year"))


@query("SELECT DISTINCT o_custkey AS case_ord, p_brand AS provision, CASE l_returnflag WHEN 'R' THEN 'INTERPRETS' ELSE 'APPLIES' END AS relation FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def graph_provisions(spark, d):
    """The provisions of each visited case, one link for each case, provision and relation."""
    visited = t(spark, d, "customer").filter("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    o = t(spark, d, "orders").join(visited, "o_custkey", "left_semi").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    rows = t(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey"), "l_returnflag").join(o, "l_orderkey").join(t(spark, d, "part").select("p_partkey", "p_brand"), "p_partkey")
    return rows.select(F.col("o_custkey").alias("case_ord"), F.col("p_brand").alias("provision"), F.when(F.col("l_returnflag") == "R", "INTERPRETS").otherwise("APPLIES").alias("relation")).distinct()


@query(f"WITH e AS (SELECT DISTINCT 's' || CAST(l_suppkey AS VARCHAR) AS a, 'p' || CAST(l_partkey AS VARCHAR) AS b, {_TYPES} AS type FROM lineitem), v AS (SELECT * FROM e WHERE type <> 'MENTIONS' AND type <> 'CITES'), n AS (SELECT a AS node FROM v UNION SELECT b FROM v UNION SELECT 's1') SELECT node, coalesce(n_out, 0) AS n_out, coalesce(n_in, 0) AS n_in FROM n LEFT JOIN (SELECT a, count(*) AS n_out FROM v GROUP BY 1) ON a = node LEFT JOIN (SELECT b, count(*) AS n_in FROM v GROUP BY 1) ON b = node")
def graph_visible(spark, d):
    """With two link types hidden: the nodes that keep a link, the focus whatever it keeps, and their links by direction."""
    e = _links(spark, d).select(F.concat(F.lit("s"), "a").alias("a"), F.concat(F.lit("p"), "b").alias("b"), "type").filter(~F.col("type").isin("MENTIONS", "CITES"))
    ends = e.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("b").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x")).select("x.*")
    focus = spark.createDataFrame([("s1", 0, 0)], "node string, o int, i int")
    return ends.unionByName(focus).groupBy("node").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))


@query("SELECT o_orderkey AS ord, CASE o_orderkey % 7 " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(evidence.KIND_LABELS.values())) + " END AS label FROM orders")
def timeline_labels(spark, d):
    kind = F.element_at(F.array(*map(F.lit, evidence.KIND_LABELS)), (F.col("o_orderkey") % 7 + 1).cast("int"))
    return t(spark, d, "orders").select(F.col("o_orderkey").alias("ord"), evidence.looked_up(evidence.KIND_LABELS, kind).alias("label"))


# ---------------------------------------------------------------- research and reports


@query("SELECT url, min(src) AS first_source, count(*) AS n FROM (SELECT url, 'a-' || CAST(page_id AS VARCHAR) AS src FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT url, 'b-' || CAST(page_id AS VARCHAR) FROM pages) GROUP BY 1")
def provenance_for(spark, d):
    """Sources of cases, then of passages, each once."""
    p = t(spark, d, "pages")
    one = lambda rows, kind: rows.select("url", F.concat(F.lit(kind), F.col("page_id").cast("string")).alias("src"))
    return one(p.filter("page_id % 2 = 0"), "a-").unionByName(one(p, "b-")).groupBy("url").agg(F.min("src").alias("first_source"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH c AS (SELECT ord, doctrine, cited, court FROM ({_CASES})), r AS (SELECT *, row_number() OVER (PARTITION BY court ORDER BY ord) AS i, row_number() OVER (PARTITION BY court, doctrine ORDER BY ord) AS j FROM c),
    s AS (SELECT court, 1 AS rule, ord, 'Check the later treatment of ' || CAST(ord AS VARCHAR) AS step FROM r WHERE doctrine = 5 AND j <= 2 UNION ALL SELECT court, 2, ord, 'Read what distinguishes ' || CAST(ord AS VARCHAR) FROM r WHERE doctrine = 4 AND j <= 1
      UNION ALL SELECT court, 3, ord, 'Trace ' || CAST(cited AS VARCHAR) || ' links of ' || CAST(ord AS VARCHAR) FROM r WHERE i <= 2 AND cited > 0 UNION ALL SELECT court, 4, 0, 'Verify each passage against its source' FROM (SELECT DISTINCT court FROM c))
    SELECT court, CAST(n AS BIGINT) AS n, step FROM (SELECT *, row_number() OVER (PARTITION BY court ORDER BY rule, ord) AS n FROM s) WHERE n <= 5""")
def next_steps(spark, d):
    """Five steps at most for each forum's cases: later treatment, distinction, links, and the constant one."""
    by = lambda *cols: F.row_number().over(Window.partitionBy(*cols).orderBy("ord"))
    r = _cases(spark, d).select("ord", "doctrine", "cited", "court").withColumns({"i": by("court"), "j": by("court", "doctrine")}).filter("i <= 2 OR j <= 2")
    o = F.col("ord").cast("string")
    rules = F.array_compact(F.array(
        F.when((F.col("doctrine") == 5) & (F.col("j") <= 2), F.struct(F.lit(1).alias("rule"), F.concat(F.lit("Check the later treatment of "), o).alias("step"))),
        F.when((F.col("doctrine") == 4) & (F.col("j") <= 1), F.struct(F.lit(2).alias("rule"), F.concat(F.lit("Read what distinguishes "), o).alias("step"))),
        F.when((F.col("i") <= 2) & (F.col("cited") > 0), F.struct(F.lit(3).alias("rule"), F.concat(F.lit("Trace "), F.col("cited").cast("string"), F.lit(" links of "), o).alias("step"))),
        F.when(F.col("i") == 1, F.struct(F.lit(4).alias("rule"), F.lit("Verify each passage against its source").alias("step"))),
    ))
    steps = r.select("court", F.when(F.col("i") == 1, F.col("ord")).otherwise(F.col("ord")).alias("ord"), F.explode(rules).alias("s")).select("court", "ord", "s.*")
    n = F.row_number().over(Window.partitionBy("court").orderBy("rule", "ord"))
    return steps.withColumn("n", n.cast("long")).filter("n <= 5").select("court", "n", "step")


@query("SELECT user_id, CAST(r AS BIGINT) AS claim, event_id AS passage, CASE WHEN known THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r, event_id IN (SELECT l_orderkey FROM lineitem) AS known FROM events) WHERE r <= 5")
def grounded_claims(spark, d):
    """The first five passages of each question as claims; one without a known case has low confidence."""
    ranked = t(spark, d, "events").withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id"))).filter("r <= 5")
    known = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("event_id")).distinct().withColumn("known", F.lit(True))
    rows = ranked.join(known, "event_id", "left")
    return rows.select("user_id", F.col("r").cast("long").alias("claim"), F.col("event_id").alias("passage"), F.when(F.col("known"), "MEDIUM").otherwise("LOW").alias("confidence"))


_SECTIONS = ("click", "view", "purchase")


@query("SELECT user_id, CAST(CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 3 END AS BIGINT) AS section, event_type AS heading, count(*) AS n, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS entries FROM events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY ALL")
def investigation_report(spark, d):
    """A section for each kind of pin that a board holds."""
    e = t(spark, d, "events").filter(F.col("event_type").isin(*_SECTIONS))
    g = e.groupBy("user_id", F.col("event_type").alias("heading")).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("event_id")).alias("ids"))
    return g.select("user_id", F.array_position(F.array(*map(F.lit, _SECTIONS)), F.col("heading")).cast("long").alias("section"), "heading", "n", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("entries"))


@query(f"SELECT CASE WHEN status = 'VERIFIED' THEN 'verified' ELSE 'issues' END AS section, status, CAST(CASE status WHEN 'NO_AUTHORITATIVE_MATCH' THEN 1 WHEN 'METADATA_MISMATCH' THEN 2 WHEN 'PARAGRAPH_MISMATCH' THEN 3 WHEN 'WEAK_PROPOSITION_SUPPORT' THEN 4 WHEN 'NEEDS_REVIEW' THEN 5 ELSE 6 END AS BIGINT) AS severity, count(*) AS n, string_agg(CAST(claim AS VARCHAR), ',' ORDER BY claim) AS claims FROM ({_VERIFIED}) GROUP BY ALL")
def integrity_report(spark, d):
    """Citations by status in order of severity, issues apart from what is verified."""
    from .catalog import _STATUS

    s = F.col("status")
    g = _verified(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("claim")).alias("ids"))
    return g.select(F.when(s == "VERIFIED", "verified").otherwise("issues").alias("section"), "status", F.array_position(F.array(*map(F.lit, _STATUS)), s).cast("long").alias("severity"), "n", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("claims"))


@query(f"SELECT c.ord, title || ', ' || citation AS record, coalesce(passages, '') AS passages, coalesce(n, 0) AS n_provisions FROM ({_CASES}) c LEFT JOIN (SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS passages FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) p ON p.o_custkey = c.ord LEFT JOIN (SELECT o_custkey, count(DISTINCT l_partkey) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) q ON q.o_custkey = c.ord")
def case_report(spark, d):
    """Record, key passages and number of provisions of every case."""
    o = t(spark, d, "orders")
    passages = o.filter("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("ord")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("o_orderkey")), lambda x: x.cast("string")), ",").alias("passages"))
    used = o.select("o_custkey", F.col("o_orderkey").alias("l_orderkey")).join(t(spark, d, "lineitem").select("l_orderkey", "l_partkey"), "l_orderkey").groupBy(F.col("o_custkey").alias("ord")).agg(F.countDistinct("l_partkey").alias("n"))
    return _cases(spark, d).join(passages, "ord", "left").join(used, "ord", "left").select("ord", F.concat("title", F.lit(", "), "citation").alias("record"), F.coalesce("passages", F.lit("")).alias("passages"), F.coalesce("n", F.lit(0)).alias("n_provisions"))


# ---------------------------------------------------------------- board and documents


@query("SELECT user_id, count(*) AS nodes, count(*) FILTER (WHERE event_id % 6 <> 5) AS flagged, greatest(900, max(event_id % 3 * 320 + 320)) AS width, greatest(640, max(event_id % 50 * 40 + 200)) AS height, CAST(max(ts) AS VARCHAR) AS updated FROM events WHERE user_id % 2 = 0 GROUP BY 1")
def boards(spark, d):
    """An owner's boards, the last changed first: nodes, those not verified, and the extent of the canvas."""
    e = F.col("event_id")
    g = t(spark, d, "events").filter("user_id % 2 = 0").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("nodes"), F.count_if(e % 6 != 5).alias("flagged"), F.greatest(F.lit(900), F.max(e % 3 * 320 + 320)).alias("width"), F.greatest(F.lit(640), F.max(e % 50 * 40 + 200)).alias("height"), F.max("ts").alias("ts")
    )
    return g.orderBy(F.desc("ts"), "user_id").select("user_id", "nodes", "flagged", "width", "height", F.col("ts").cast("string").alias("updated"))


@query("SELECT user_id, event_id, CAST((n - 1) % 3 AS BIGINT) AS col, CAST((n - 1) // 3 AS BIGINT) AS row FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)")
def next_positions(spark, d):
    """Where each pin lands: three to a row, in order of arrival."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return t(spark, d, "events").select("user_id", "event_id", (n % 3).cast("long").alias("col"), F.floor(n / 3).cast("long").alias("row"))


_WANTED = "SELECT l_suppkey AS a, l_partkey AS b, l_orderkey, l_linenumber FROM lineitem"
_NODES = "SELECT p_partkey AS node FROM part WHERE p_size % 3 <> 0"


@query(f"SELECT a, b, l_orderkey, l_linenumber FROM ({_WANTED}) WHERE a <> b AND a IN ({_NODES}) AND b IN ({_NODES})")
def board_edges_allowed(spark, d):
    """Links that are no self-links and whose ends are both on the board."""
    wanted = t(spark, d, "lineitem").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b"), "l_orderkey", "l_linenumber")
    return evidence.allowed_edges(wanted, t(spark, d, "part").filter("p_size % 3 <> 0").select(F.col("p_partkey").alias("node"))).select("a", "b", "l_orderkey", "l_linenumber")


@query(f"SELECT a, b, l_orderkey, l_linenumber FROM ({_WANTED}) WHERE a NOT IN (SELECT p_partkey FROM part WHERE p_size % 3 = 0) AND b NOT IN (SELECT p_partkey FROM part WHERE p_size % 3 = 0)")
def board_edges_left(spark, d):
    """Links that stay when nodes are removed from the board."""
    edges = t(spark, d, "lineitem").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b"), "l_orderkey", "l_linenumber")
    part = t(spark, d, "part").select(F.col("p_partkey").alias("node"), "p_size")
    return evidence.without_nodes(part, edges, part.filter("p_size % 3 = 0"))[1].select("a", "b", "l_orderkey", "l_linenumber")


_UPLOAD = "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 'u' || CAST(doc_id % 7 AS VARCHAR) END AS owner, CASE doc_id % 4 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/png' ELSE 'text/plain' END AS mime, CASE WHEN doc_id % 9 = 0 THEN '' WHEN doc_id % 8 = 0 THEN '%PDF-' || text ELSE text END AS body FROM documents"


@query(f"""WITH u AS ({_UPLOAD}), v AS (SELECT *, CASE WHEN strlen(body) = 0 THEN 'EMPTY' WHEN strlen(body) > 20971520 THEN 'TOO_LARGE' WHEN mime NOT IN ('application/pdf', 'text/plain') THEN 'UNSUPPORTED_TYPE' WHEN mime = 'application/pdf' AND left(body, 5) <> '%PDF-' THEN 'NOT_A_PDF' ELSE 'ACCEPTED' END AS outcome, sha256(body) AS sha FROM u),
    k AS (SELECT *, coalesce(owner, 'anonymous') || ':' || sha AS key FROM v) SELECT doc_id, outcome, CASE WHEN outcome = 'ACCEPTED' THEN 'doc-' || left(sha256(key), 12) END AS id, CASE WHEN outcome = 'ACCEPTED' THEN 'documents/' || left(sha, 2) || '/' || sha || CASE mime WHEN 'text/plain' THEN '.txt' ELSE '.pdf' END END AS path,
    outcome = 'ACCEPTED' AND row_number() OVER (PARTITION BY outcome, key ORDER BY doc_id) > 1 AS duplicate FROM k""")
def uploads(spark, d):
    """Each upload's outcome, id, place in the content-addressed store, and whether its owner has the same already."""
    i = F.col("doc_id")
    rows = t(spark, d, "documents").select(
        "doc_id", F.when(i % 5 != 0, F.concat(F.lit("u"), (i % 7).cast("string"))).alias("owner"), F.when(i % 4 == 0, "application/pdf").when(i % 4 == 1, "image/png").otherwise("text/plain").alias("mime"),
        F.when(i % 9 == 0, "").when(i % 8 == 0, F.concat(F.lit("%PDF-"), "text")).otherwise(F.col("text")).alias("body"),
    )
    rows = rows.select("doc_id", "mime", "owner", evidence.upload_outcome(F.octet_length("body"), F.col("mime"), F.left("body", F.lit(5))).alias("outcome"), F.sha2("body", 256).alias("sha"))
    rows = rows.withColumn("key", F.concat(F.coalesce("owner", F.lit("anonymous")), F.lit(":"), "sha"))
    ok = F.col("outcome") == "ACCEPTED"
    path = texts.store_path(F.col("sha"), F.col("mime"))
    first = rows.filter(ok).groupBy("key").agg(F.min("doc_id").alias("first"))
    return rows.join(first, "key", "left").select("doc_id", "outcome", F.when(ok, F.concat(F.lit("doc-"), F.left(F.sha2("key", 256), F.lit(12)))).alias("id"), F.when(ok, path).alias("path"), (ok & (F.col("doc_id") != F.col("first"))).alias("duplicate"))


_RAW = "replace(replace(text, ' th', chr(12) || 'th'), chr(10), chr(13) || chr(10))"


@query(f"WITH p AS (SELECT doc_id, unnest(s) AS page, generate_subscripts(s, 1) AS i FROM (SELECT doc_id, string_split({_RAW}, chr(12)) AS s FROM documents)), q AS (SELECT doc_id, i, replace(page, chr(13) || chr(10), chr(10)) AS page FROM p) SELECT doc_id, count(*) AS pages, sha256(string_agg(page, chr(10) || chr(12) || chr(10) ORDER BY i)) AS text_hash, CAST(sum(start * i) AS BIGINT) AS start_sum FROM (SELECT *, coalesce(sum(length(page) + 3) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM q) GROUP BY 1")
def plain_text_pages(spark, d):
    """Pages at form feeds with one kind of line end, joined again, and where each starts: one pass with a running offset."""
    raw = F.replace(F.replace(F.col("text"), F.lit(" th"), F.lit("\fth")), F.lit("\n"), F.lit("\r\n"))
    rows = t(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", texts.pages(raw).alias("pages")).withColumn("starts", texts.page_starts(F.col("pages")))
    start_sum = F.aggregate(F.transform("starts", lambda s, i: s * (i + 1)), F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("doc_id", F.size("pages").cast("long").alias("pages"), F.sha2(texts.joined(F.col("pages")), 256).alias("text_hash"), start_sum.alias("start_sum"))


@query("SELECT l_orderkey AS page, CAST(count(*) AS BIGINT) AS glyphs, CAST(sum(CASE WHEN gap > 0.5 * 10 THEN 1 ELSE 0 END) + 1 AS BIGINT) AS lines, coalesce(CAST(list_sort(list(gap) FILTER (WHERE gap > 5))[len(list(gap) FILTER (WHERE gap > 5)) // 2 + 1] AS DOUBLE), 14.0) AS leading FROM (SELECT l_orderkey, l_quantity - lag(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_linenumber) AS gap FROM lineitem) GROUP BY 1")
def page_layout(spark, d):
    """Glyphs by height: a new line where the step exceeds half a height, and the upper median of the leadings, 14 without any."""
    gap = F.col("l_quantity") - F.lag("l_quantity").over(Window.partitionBy("l_orderkey").orderBy("l_quantity", "l_linenumber"))
    g = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), gap.alias("gap")).groupBy("page").agg(
        F.count(F.lit(1)).alias("glyphs"), (F.count_if(F.col("gap") > 5) + 1).alias("lines"), F.array_sort(F.collect_list(F.when(F.col("gap") > 5, F.col("gap")))).alias("steps")
    )
    return g.select("page", "glyphs", "lines", F.coalesce(F.get("steps", F.floor(F.size("steps") / 2).cast("int")), F.lit(14.0)).alias("leading"))


@query("SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\r\\x0B\\x0C]+', ' ', 'g')) AS text, CAST(row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS BIGINT) AS place FROM documents WHERE source IS NOT NULL")
def documents_listed(spark, d):
    """An owner's documents with white space folded, the largest first."""
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    folded = F.trim(F.regexp_replace("text", r"[ \t\n\r\x0B\x0C]+", " "))
    return t(spark, d, "documents").filter("source IS NOT NULL").select("doc_id", folded.alias("text"), place.cast("long").alias("place"))


@query("SELECT page_id, 'https://' = left(url, 8) OR 'http://' = left(url, 7) AS evidenced, list_filter(list_transform(string_split(string_split(url, '?')[2], '&'), lambda x: trim(string_split(x, '=')[1])), lambda x: x <> '')[1] AS first_key FROM pages WHERE contains(url, '?')")
def quarantined_sources(spark, d):
    """Whether a source may be asserted on, and its first parameter: blank ones dropped."""
    url = F.col("url")
    keys = F.filter(F.transform(F.split(F.get(F.split(url, r"\?"), F.lit(1)), "&"), lambda x: F.trim(F.split(x, "=")[0])), lambda x: x != "")
    return t(spark, d, "pages").filter(F.contains(url, F.lit("?"))).select("page_id", (url.startswith("https://") | url.startswith("http://")).alias("evidenced"), F.get(keys, F.lit(0)).alias("first_key"))


# ---------------------------------------------------------------- claims of a citation

_ALPHA = '"The debt of a surety is as wide as that of the debtor and no wider than it"'
_BETA = "“Nothing in this part bars a suit against the surety for the debt it guarantees”"


def _briefs(spark, d) -> DataFrame:
    k, y = F.col("o_orderkey").cast("string"), F.year("o_orderdate").cast("string")
    title = F.concat(F.lit("Firm "), F.when(F.col("o_orderkey") % 2 == 0, "Alpha").otherwise("Beta"), F.lit(" Traders Ltd. v. State Bank & Ors."))
    head = F.concat(F.lit("An earlier block. Para 3.\n\n4. It was argued. See also "), title, F.lit(", "))
    cite = F.concat(y, F.lit(" INSC "), k)
    tail = F.concat(F.lit(", where the "), F.when(F.col("o_orderkey") % 3 == 0, "NCLAT").when(F.col("o_orderkey") % 3 == 1, "High Court").otherwise("bench"), F.lit(" held at paragraph "), (F.col("o_orderkey") % 90 + 1).cast("string"), F.lit(": "),
                    F.lit(_ALPHA), F.lit(" and then "), F.lit(_BETA), F.lit(".\n \nA later block with \"a quotation that belongs to another paragraph altogether\"."))
    return t(spark, d, "orders").select("o_orderkey", F.concat(head, cite, tail).alias("text"), F.length(head).alias("start"), (F.length(head) + F.length(cite)).alias("end"))


_B = "SELECT o_orderkey, 'Firm ' || CASE WHEN o_orderkey % 2 = 0 THEN 'Alpha' ELSE 'Beta' END || ' Traders Ltd. v. State Bank & Ors.' AS title, CAST(year(o_orderdate) AS VARCHAR) || ' INSC ' || CAST(o_orderkey AS VARCHAR) AS cite FROM orders"
_HEAD_LEN = "length('An earlier block. Para 3.') + 2 + length('4. It was argued. See also ') + length(title) + 2"


@query(f"SELECT o_orderkey, title AS claimed_title, CASE o_orderkey % 3 WHEN 0 THEN 'National Company Law Appellate Tribunal' WHEN 1 THEN 'High Court' END AS court, '3' AS nearest_ref, trim({D.q(_ALPHA)}, chr(34)) AS quotation, CAST({_HEAD_LEN} - length('An earlier block. Para 3.') - 2 AS BIGINT) AS place_in_block FROM ({_B})")
def citation_claims(spark, d):
    """Title, forum, paragraph and quotation that a document gives with each citation, within its own block."""
    b = claims.with_titles(_briefs(spark, d))
    text, start, end = F.col("text"), F.col("start"), F.col("end")
    return b.select("o_orderkey", "claimed_title", claims.court_hint(text, start, end).alias("court"), claims.paragraph_ref(text, start, end).alias("nearest_ref"), claims.quotation(text, start, end).alias("quotation"), (start - claims.block(text, start, end)[1]).cast("long").alias("place_in_block"))


@query(f"WITH b AS (SELECT o_orderkey, {_HEAD_LEN} AS s, {_HEAD_LEN} + length(cite) AS e FROM ({_B})) SELECT o_orderkey, CAST(0 AS BIGINT) AS nth, CAST(0 AS BIGINT) AS start, CAST(s AS BIGINT) AS \"end\", false AS cited FROM b UNION ALL SELECT o_orderkey, 1, s, e, true FROM b")
def review_segments(spark, d):
    """Plain runs and citations in turn, up to the citation's end."""
    b = _briefs(spark, d)
    parts = claims.segments(b.select("o_orderkey", "start", "end"), b.select("o_orderkey", F.substring(F.col("text"), F.lit(1), F.col("end")).alias("text")), "o_orderkey")
    return parts.select("o_orderkey", "nth", "start", "end", "cited")


@query("SELECT 'd' || CAST(l_orderkey AS VARCHAR) || '--c' || CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS VARCHAR) AS id, l_orderkey, CAST(l_quantity AS BIGINT) // 10 + 1 AS page FROM lineitem")
def extracted_ids(spark, d):
    """Ids of a document's citations in order, with their pages."""
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    rows = t(spark, d, "lineitem").withColumn("n", n)
    return rows.select(F.concat(F.lit("d"), F.col("l_orderkey").cast("string"), F.lit("--c"), F.col("n").cast("string")).alias("id"), "l_orderkey", (F.floor(F.col("l_quantity").cast("long") / 10) + 1).alias("page"))


# ---------------------------------------------------------------- similarity over all texts


@query(f"WITH x AS (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark), w AS (SELECT kind, id, unnest(list_distinct({D.words(D.norm_paragraph('text'))})) AS term FROM x) SELECT term, count(*) AS df, round(ln((n + 1) / (count(*) + 1)) + 1, 6) AS weight FROM w, (SELECT count(*) AS n FROM x) GROUP BY term, n")
def corpus_idf(spark, d):
    """Term weights over passages and provisions together."""
    x = t(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), "text").unionByName(t(spark, d, "benchmark").select(F.concat(F.lit("b"), "item_id").alias("id"), "text"))
    words = x.select("id", F.explode(F.array_distinct(T.words(T.norm_paragraph(F.col("text"))))).alias("term"))
    return similarity.idf(words, x).select("term", "df", F.round("weight", 6).alias("weight"))

"""Briefs, what is detected in them, and its verification against records and their texts.

Every document is the text of a record, its lines the paragraphs; every document
also makes a brief, which cites its record. The brief's number only decides what
it says (a wrong number, a foreign quotation, ..); what is wrong with it is found by
detection and verification of the texts alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import detect, verify
from ..operators.tables import written
from . import duck as D
from .catalog import query, t
from .evidence import _sim

DIGITS, LETTERS = "0123456789", "bdfgklmnrt"
FOREIGN = "Nothing in this part bars a suit against the surety for the debt it guarantees"
UNRELATED = "zebras quietly juggle violet umbrellas beyond frozen jetties"
LEAST_LINE, COVERED = 60, 300

# ---------------------------------------------------------------- the casebook


def _name(k: Column) -> Column:
    return F.initcap(F.translate((k * 7919 % 1000003).cast("string"), DIGITS, LETTERS))


def _sql_name(k: str) -> str:
    x = f"translate(CAST(({k}) * 7919 % 1000003 AS VARCHAR), '{DIGITS}', '{LETTERS}')"
    return f"(upper({x}[1]) || {x}[2:])"


def _title(k: Column) -> Column:
    return F.concat(_name(k), F.lit(" Traders v. "), _name(F.floor(k / 50) + 500000))


_SQL_TITLE = f"{_sql_name('doc_id')} || ' Traders v. ' || {_sql_name('doc_id // 50 + 500000')}"


def _records(spark, d) -> DataFrame:
    k = F.col("doc_id")
    y = (1990 + k % 30).cast("int")
    forms = F.array(F.concat(y.cast("string"), F.lit(" INSC "), k.cast("string")), F.concat(F.lit("("), (y + 1).cast("string"), F.lit(") "), (k % 19 + 1).cast("string"), F.lit(" SCC "), (k % 90000 + 1).cast("string")))
    court = F.when(F.col("lang") == "fr", "National Company Law Tribunal").otherwise("Supreme Court of India")
    return t(spark, d, "documents").select(k.alias("ord"), _title(k).alias("title"), court.alias("court"), F.array(y, y + 1).alias("years"), forms.alias("forms"), (F.col("n_chars") < COVERED).alias("coverage_only"))


def _paragraphs(spark, d) -> DataFrame:
    lines = t(spark, d, "documents").select(F.col("doc_id").alias("ord"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "text"))
    return lines.filter(T.norm_paragraph(F.col("text")) != "").select("ord", "pos", (F.col("pos") + 1).cast("string").alias("number"), "text", (F.length("text") > 200).alias("is_ratio"))


def _first_line(docs: DataFrame) -> DataFrame:
    """doc_id, pos, line: the first line long enough to be quoted, without quotation marks."""
    lines = docs.select("doc_id", F.filter(F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("pos"), F.trim(F.regexp_replace(F.translate(x, '"“”', ""), r"[ \t\r\x0B\x0C]+", " ")).alias("line"))), lambda x: F.length(x["line"]) >= LEAST_LINE).alias("lines"))
    return lines.select("doc_id", F.get("lines", F.lit(0)).alias("l")).select("doc_id", "l.pos", "l.line")


def _briefs(spark, d) -> DataFrame:
    """doc_id, text: one brief of each document with a line that can be quoted."""
    k = F.col("doc_id")
    v, y = k % 8, (1990 + k % 30).cast("string")
    lines = _first_line(t(spark, d, "documents")).filter("line IS NOT NULL")
    title = F.when(v == 2, F.concat(F.lit("Quux Xyzzy v. Wibble Wobble"))).otherwise(_title(k))
    cite = F.concat(y, F.lit(" INSC "), F.when(v.isin(1, 2), k + 5000000).otherwise(k).cast("string"), F.when(v == 6, ", AIR 1991 SC 77").otherwise(""))
    at = F.when(v == 4, " at paragraph 999999").when(v.isin(5, 7), "").otherwise(F.concat(F.lit(" at paragraph "), (F.col("pos") + 1).cast("string")))
    said = F.when(v == 5, UNRELATED).otherwise(F.array_join(F.slice(T.words(T.norm_paragraph(F.col("line"))), 1, 12), " "))
    quote = F.when(v == 3, FOREIGN).when(v == 7, F.concat(F.lit("Verily "), F.left("line", F.lit(150)))).otherwise(F.left("line", F.lit(150)))
    quoted = F.when(v == 5, "").otherwise(F.concat(F.lit(' "'), quote, F.lit('"')))
    head = F.concat(F.lit("An earlier block of the brief.\n\n1. In "), title, F.lit(", "))
    text = F.concat(head, cite, F.lit(", the Supreme Court of India held"), at, F.lit(" that "), said, quoted, F.lit(".\n \nA later block repeats "), cite, F.lit(" without its name."))
    return lines.select(k, text.alias("text"))


_SQL_LINE = r"""SELECT doc_id, lang, n_chars, l.pos AS pos, l.line AS line FROM (SELECT doc_id, lang, n_chars, list_filter(list_transform(string_split(text, chr(10)), lambda x, i: {'pos': i - 1, 'line': trim(regexp_replace(translate(x, '"“”', ''), '[ \t\r\x0B\x0C]+', ' ', 'g'))}), lambda x: length(x.line) >= 60)[1] AS l FROM documents) WHERE l IS NOT NULL"""
#: What each brief claims, stated without looking for it.
_SQL_CLAIMS = f"""SELECT *, CASE WHEN length(regexp_replace(said, ' (in|see|per|cf|also)$', '')) + 1 >= 25 THEN regexp_replace(said, ' (in|see|per|cf|also)$', '') || '.' END AS proposition FROM (
 SELECT doc_id, lang, doc_id % 8 AS v, 1990 + doc_id % 30 AS y, CASE WHEN doc_id % 8 = 2 THEN 'Quux Xyzzy v. Wibble Wobble' ELSE {_SQL_TITLE} END AS title,
 CAST(1990 + doc_id % 30 AS VARCHAR) || ' INSC ' || CAST(CASE WHEN doc_id % 8 IN (1, 2) THEN doc_id + 5000000 ELSE doc_id END AS VARCHAR) AS neutral, CASE WHEN doc_id % 8 = 6 THEN 'AIR' END AS reporter,
 CASE doc_id % 8 WHEN 4 THEN '999999' WHEN 5 THEN NULL WHEN 7 THEN NULL ELSE CAST(pos + 1 AS VARCHAR) END AS paragraph,
 CASE WHEN doc_id % 8 = 5 THEN '{UNRELATED}' ELSE array_to_string(({D.words(D.norm_paragraph('line'))})[1:12], ' ') END AS said,
 CASE doc_id % 8 WHEN 5 THEN NULL WHEN 3 THEN '{FOREIGN}' WHEN 7 THEN 'Verily ' || trim(left(line, 150)) ELSE trim(left(line, 150)) END AS quotation
 FROM ({_SQL_LINE}))"""


@query(f"SELECT doc_id, CAST(1 AS BIGINT) AS nth, neutral || CASE WHEN v = 6 THEN ', AIR 1991 SC 77' ELSE '' END AS raw, CAST(CASE WHEN v = 6 THEN 2 ELSE 1 END AS BIGINT) AS n_anchors, title, CAST(y AS BIGINT) AS year, coalesce(reporter, '') AS reporter, neutral, 'Supreme Court of India' AS court, coalesce(paragraph, '') AS paragraph, coalesce(quotation, '') AS quotation, coalesce(proposition, '') AS proposition FROM ({_SQL_CLAIMS})"
       " UNION ALL " f"SELECT doc_id, 2, neutral || CASE WHEN v = 6 THEN ', AIR 1991 SC 77' ELSE '' END, CASE WHEN v = 6 THEN 2 ELSE 1 END, '', y, coalesce(reporter, ''), neutral, '', '', '', 'A later block repeats without its name.' FROM ({_SQL_CLAIMS})")
def detect_citations(spark, d):
    """All that a brief claims of its citations; the second mention has no title, so it is another claim."""
    found = _detected(spark, d)
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    # What stands around the second mention depends on how long the first block is.
    near = lambda c: F.when(F.col("nth") == 1, F.coalesce(c, F.lit(""))).otherwise("").alias(c)
    return found.select("doc_id", F.col("nth").cast("long").alias("nth"), "raw", F.col("n_anchors").cast("long").alias("n_anchors"), blank("title"), F.col("year").cast("long").alias("year"), blank("reporter"), "neutral", near("court"), near("paragraph"), near("quotation"), blank("proposition"))


def _detected(spark, d) -> DataFrame:
    # Written first: detection reads a text in many places, and Spark would make the brief anew in each.
    return detect.detected(written(_briefs(spark, d), "briefs"), "doc_id")


_W = D.words


def _profile(title: str) -> str:
    """SQL columns of a title's trigrams and tokens."""
    return f"{D.trigrams(title)} AS tri, list_distinct(list_filter(string_split({title}, ' '), lambda w: length(w) > 1)) AS tok"


_LIKE = f"round(CASE WHEN a.n = b.n THEN 1.0 ELSE greatest({D.jaccard('a.tri', 'b.tri')}, ({D.jaccard('a.tri', 'b.tri')} + {D.jaccard('a.tok', 'b.tok')}) / 2) END, 9)"
_SQL_VERIFIED = f"""WITH c AS MATERIALIZED ({_SQL_CLAIMS}),
r AS MATERIALIZED (SELECT doc_id AS ord, {_SQL_TITLE} AS title, {D.norm_title(_SQL_TITLE)} AS nt, lang, 1990 + doc_id % 30 AS y, n_chars < {COVERED} AS coverage FROM documents),
p AS MATERIALIZED (SELECT ord, pos, norm, length(text) > 200 AS ratio FROM (SELECT doc_id AS ord, text, pos, {D.norm_paragraph('text')} AS norm FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)) WHERE norm <> ''),
e AS (SELECT c.doc_id, r.ord FROM c JOIN r ON neutral = CAST(r.y AS VARCHAR) || ' INSC ' || CAST(r.ord AS VARCHAR)),
b AS MATERIALIZED (SELECT *, {_profile('n')} FROM (SELECT *, nt AS n FROM r)),
a AS MATERIALIZED (SELECT *, {_profile('n')} FROM (SELECT doc_id, paragraph, y AS cy, {D.norm_title('title')} AS n FROM c WHERE doc_id NOT IN (SELECT doc_id FROM e))),
s AS (SELECT a.doc_id, b.ord, {_LIKE} AS sim, 3 * CAST(lang <> 'fr' AS INT) + CASE WHEN cy IN (b.y, b.y + 1) THEN 2 WHEN abs(cy - b.y) <= 1 OR abs(cy - b.y - 1) <= 1 THEN 1 ELSE 0 END
   + CAST(EXISTS (SELECT 1 FROM p WHERE p.ord = b.ord AND CAST(pos + 1 AS VARCHAR) = a.paragraph) AS INT) AS points FROM a, b),
m AS (SELECT *, max(sim) OVER (PARTITION BY doc_id) - sim < 0.05 AS tied FROM s WHERE sim >= 0.45),
k AS (SELECT doc_id, list({{'ord': ord, 'sim': sim}} ORDER BY tied DESC, CASE WHEN tied THEN points ELSE -1 END DESC, sim DESC, ord) AS top FROM m GROUP BY 1),
f AS (SELECT c.*, coalesce(e.ord, CASE WHEN top[1].sim >= 0.72 THEN top[1].ord END) AS ord, CASE WHEN e.ord IS NOT NULL THEN 'EXACT_CITATION' WHEN top[1].sim >= 0.72 THEN 'FUZZY_TITLE' ELSE 'NONE' END AS method,
   CASE WHEN e.ord IS NOT NULL OR top IS NULL THEN '' ELSE array_to_string(list_transform(CASE WHEN top[1].sim >= 0.72 THEN top[2:3] ELSE top[1:3] END, lambda x: x.ord), ',') END AS near_misses FROM c LEFT JOIN e USING (doc_id) LEFT JOIN k USING (doc_id)),
g AS (SELECT f.*, r.coverage, r.lang AS rl, r.y AS ry, round({_sim(D.norm_title('f.title'), 'r.nt')}, 9) AS ts FROM f LEFT JOIN r USING (ord)),
x AS MATERIALIZED (SELECT doc_id, ord, {D.norm_paragraph('quotation')} AS quote, {D.norm_paragraph('proposition')} AS prop FROM g WHERE ord IS NOT NULL AND NOT coverage),
qt AS (SELECT x.doc_id, pos, quote, norm, contains(norm, quote) AS whole, round(len(list_filter({_W('quote')}, lambda w: list_contains({_W('norm')}, w))) / len({_W('quote')}), 9) AS share FROM x JOIN p USING (ord) WHERE quote IS NOT NULL),
qb AS (SELECT doc_id, min(pos) FILTER (WHERE whole) AS exact_pos, (list(pos ORDER BY share DESC, pos))[1] AS best_pos, max(share) AS share FROM qt GROUP BY 1),
al AS (SELECT doc_id, {_W('quote')} AS a, {_W('norm')} AS b FROM qb JOIN qt USING (doc_id) WHERE exact_pos IS NULL AND qt.pos = best_pos),
aw AS (SELECT doc_id, unnest(a) AS w, generate_subscripts(a, 1) AS i, least(len(a), len(b)) AS n FROM al), bw AS (SELECT doc_id, unnest(b) AS w, generate_subscripts(b, 1) AS j FROM al),
isl AS (SELECT doc_id, n, i - j AS dg, i - row_number() OVER (PARTITION BY doc_id, i - j ORDER BY i) AS grp FROM aw JOIN bw USING (doc_id, w)),
rn AS (SELECT doc_id, max(len) / any_value(n) AS run FROM (SELECT doc_id, n, dg, grp, count(*) AS len FROM isl GROUP BY ALL) GROUP BY 1),
pt AS MATERIALIZED (SELECT ord, pos, w, count(*) AS c FROM (SELECT ord, pos, unnest({_W('norm')}) AS w FROM p) GROUP BY ALL),
wt AS MATERIALIZED (SELECT w, ln((nn + 1) / (count(*) + 1)) + 1 AS wt FROM pt, (SELECT count(*) AS nn FROM p) GROUP BY w, nn),
un AS (SELECT ln(count(*) + 1) + 1 AS u FROM wt),
pw AS (SELECT doc_id, ord, w, count(*) * any_value(coalesce(wt, u)) AS nw FROM (SELECT doc_id, ord, unnest({_W('prop')}) AS w FROM x WHERE prop IS NOT NULL) LEFT JOIN wt USING (w), un GROUP BY ALL),
ma AS (SELECT doc_id, sum(nw) AS mass, sqrt(sum(nw * nw)) AS na FROM pw GROUP BY 1), hn AS (SELECT ord, pos, sqrt(sum(c * wt * c * wt)) AS nb FROM pt JOIN wt USING (w) GROUP BY ALL),
ps AS (SELECT doc_id, pos, round(greatest(sum(nw) / any_value(mass), sum(nw * c * wt) / (any_value(na) * any_value(nb))), 9) AS score FROM pw JOIN pt USING (ord, w) JOIN wt USING (w) JOIN ma USING (doc_id) JOIN hn USING (ord, pos) GROUP BY ALL),
pb AS (SELECT doc_id, max(score) AS support FROM ps GROUP BY 1),
sh AS (SELECT ord, count(*) AS np, coalesce(min(pos) FILTER (WHERE ratio), min(pos)) AS shown FROM p GROUP BY 1),
o AS (SELECT g.*, coalesce(np, 0) AS np, shown, ord IS NOT NULL AND NOT coverage AS text, (SELECT min(pos) FROM p WHERE p.ord = g.ord AND CAST(pos + 1 AS VARCHAR) = g.paragraph) AS cited_pos, exact_pos, best_pos, coalesce(share, 0) AS share, coalesce(run, 0) AS run, coalesce(support, 0) AS sup,
   CASE WHEN ord IS NULL THEN '' ELSE array_to_string(list_filter([CASE WHEN ts < 0.72 THEN 'case title' END, CASE WHEN g.y NOT IN (ry, ry + 1) THEN 'year' END, CASE WHEN reporter = 'AIR' THEN 'reporter series' END, CASE WHEN rl = 'fr' THEN 'forum' END], lambda z: z IS NOT NULL), ', ') END AS mismatches
   FROM g LEFT JOIN qb USING (doc_id) LEFT JOIN rn USING (doc_id) LEFT JOIN pb USING (doc_id) LEFT JOIN sh USING (ord)),
z AS (SELECT *, CASE WHEN NOT text OR paragraph IS NULL THEN 'SKIPPED' WHEN cited_pos IS NOT NULL THEN 'PASS' ELSE 'FAIL' END AS paragraph_check,
   CASE WHEN NOT text OR quotation IS NULL THEN 'SKIPPED' WHEN exact_pos IS NOT NULL THEN 'PASS' WHEN share >= 0.85 AND run >= 0.45 THEN 'PARTIAL' WHEN share >= 0.62 THEN 'FAIL_WITH_MATCH' ELSE 'FAIL' END AS quotation_check,
   CASE WHEN NOT text OR proposition IS NULL THEN 'SKIPPED' WHEN sup >= 0.28 THEN 'PASS' WHEN sup < 0.24 THEN 'FAIL' ELSE 'PARTIAL' END AS proposition_check, CASE WHEN text AND quotation IS NOT NULL THEN coalesce(exact_pos, CASE WHEN share >= 0.62 THEN best_pos END) END AS quoted_pos FROM o),
st AS (SELECT *, coalesce(text AND cited_pos <> quoted_pos, false) AS moved FROM z),
fin AS (SELECT *, CASE WHEN ord IS NULL THEN 'NO_AUTHORITATIVE_MATCH' WHEN coverage THEN 'NEEDS_REVIEW' WHEN method = 'FUZZY_TITLE' OR mismatches <> '' THEN 'METADATA_MISMATCH' WHEN quotation_check LIKE 'FAIL%' OR moved OR paragraph_check = 'FAIL' THEN 'PARAGRAPH_MISMATCH'
   WHEN np = 0 THEN 'NEEDS_REVIEW' WHEN proposition_check = 'FAIL' THEN 'WEAK_PROPOSITION_SUPPORT' WHEN proposition_check = 'PARTIAL' THEN 'NEEDS_REVIEW' ELSE 'VERIFIED' END AS status FROM st)
SELECT doc_id, coalesce(ord, -1) AS ord, method, mismatches, paragraph_check, quotation_check, CASE WHEN moved THEN 'FAIL' ELSE 'SKIPPED' END AS location_check, proposition_check, round(CASE WHEN text AND proposition IS NOT NULL THEN sup ELSE 0 END, 6) AS support,
 coalesce(CASE WHEN text THEN coalesce(quoted_pos, cited_pos, shown) END, -1) AS matched_pos, status, near_misses FROM fin"""


@query(_SQL_VERIFIED)
def verify_brief(spark, d):
    """The first citation of every brief, from its text to its status: all checks are made on the texts."""
    found = _detected(spark, d).filter("nth = 1").withColumnRenamed("doc_id", "claim")
    out = verify.verified(found, _records(spark, d), _paragraphs(spark, d))
    return out.select(
        F.col("claim").alias("doc_id"), F.coalesce("ord", F.lit(-1)).alias("ord"), "method", F.array_join("mismatches", ", ").alias("mismatches"), "paragraph_check", "quotation_check", "location_check", "proposition_check",
        F.round("support", 6).alias("support"), F.coalesce("matched_pos", F.lit(-1)).cast("long").alias("matched_pos"), "status", F.array_join(F.transform("near_misses", lambda x: x.cast("string")), ",").alias("near_misses"),
    )


@query(f"WITH b AS MATERIALIZED (SELECT *, {_profile('n')} FROM (SELECT doc_id, {D.norm_title(_SQL_TITLE)} AS n FROM documents)) SELECT claim, ord, sim FROM (SELECT a.doc_id AS claim, b.doc_id AS ord, {_LIKE} AS sim FROM b a JOIN b ON a.doc_id % 10 = 0) WHERE sim >= 0.45")
def title_candidates(spark, d):
    """Records whose title is like that of every tenth one: trigrams and tokens meet only where they are rare."""
    titles = t(spark, d, "documents").select(F.col("doc_id").alias("ord"), _title(F.col("doc_id")).alias("title"))
    return verify.title_candidates(titles.filter("ord % 10 = 0").withColumnRenamed("ord", "claim"), titles)

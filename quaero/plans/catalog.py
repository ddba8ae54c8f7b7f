"""Queries by name over the driver's tables, each with its DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import extract, graph, limits, search, similarity
from ..operators.verify import BASE_SCORES
from ..operators.verify import ladder as status
from ..operators.verify import score as status_score
from . import duck as D

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- text scalars (N*, S9, S13)


@query(f"SELECT doc_id, sha256({D.norm_paragraph('text')}) AS text_hash, CAST(length({D.norm_paragraph('text')}) AS BIGINT) AS n FROM documents")
def norm_paragraph_hash(spark, d):
    norm = T.norm_paragraph(F.col("text"))
    return t(spark, d, "documents").select("doc_id", F.sha2(norm, 256).alias("text_hash"), F.length(norm).cast("long").alias("n"))


@query(f"SELECT sha256({D.norm_paragraph('text')}) AS text_hash, min(doc_id) AS first_doc, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1")
def dup_by_hash(spark, d):
    return t(spark, d, "documents").groupBy(T.paragraph_hash(F.col("text")).alias("text_hash")).agg(
        F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("copies")
    ).filter("copies > 1")


_TITLE = "c_name || ' & Sons Pvt. Ltd. vs. The ' || c_mktsegment || ' Company (India) & Ors.'"


@query(f"SELECT c_custkey, {D.norm_title(_TITLE)} AS title, CAST(len(list_filter(string_split({D.norm_title(_TITLE)}, ' '), lambda t: length(t) > 1)) AS BIGINT) AS n_tokens FROM customer")
def norm_title(spark, d):
    norm = T.norm_title(F.concat("c_name", F.lit(" & Sons Pvt. Ltd. vs. The "), "c_mktsegment", F.lit(" Company (India) & Ors.")))
    return t(spark, d, "customer").select("c_custkey", norm.alias("title"), F.size(T.title_tokens(norm)).cast("long").alias("n_tokens"))


@query("SELECT o_orderkey, substr(regexp_extract(s, '(?i)(?:paragraphs?|paras?\\.?|¶+|pp?\\.)\\s*([0-9]+)', 1), 1) AS para, CAST(regexp_extract(s, '\\b(1[89][0-9][0-9]|20[0-9][0-9])\\b', 1) AS INT) AS year FROM (SELECT o_orderkey, 'held in ' || CAST(year(o_orderdate) AS VARCHAR) || ' at ' || CASE o_orderkey % 4 WHEN 0 THEN 'paragraphs ' WHEN 1 THEN 'para. ' WHEN 2 THEN '¶ ' ELSE 'PP. ' END || CAST(o_custkey AS VARCHAR) || '-' || CAST(o_custkey + 2 AS VARCHAR) AS s FROM orders)")
def paragraph_ref(spark, d):
    lead = F.when(F.col("o_orderkey") % 4 == 0, "paragraphs ").when(F.col("o_orderkey") % 4 == 1, "para. ").when(F.col("o_orderkey") % 4 == 2, "¶ ").otherwise("PP. ")
    s = F.concat(F.lit("held in "), F.year("o_orderdate"), F.lit(" at "), lead, F.col("o_custkey"), F.lit("-"), F.col("o_custkey") + 2)
    return t(spark, d, "orders").select("o_orderkey", T.paragraph_ref(s).alias("para"), T.extract_year(s).alias("year"))


_CITE = "'(' || CAST(year(o_orderdate) AS VARCHAR) || ') ' || CAST(o_orderkey % 20 AS VARCHAR) || ' S.C.C. ' || CAST(o_orderkey AS VARCHAR)"


def _cite() -> F.Column:
    return F.concat(F.lit("("), F.year("o_orderdate"), F.lit(") "), F.col("o_orderkey") % 20, F.lit(" S.C.C. "), F.col("o_orderkey"))


@query(f"SELECT o_orderkey, {D.norm_citation(_CITE)} AS citation_key FROM orders")
def citation_keys(spark, d):
    return t(spark, d, "orders").select("o_orderkey", T.norm_citation(_cite()).alias("citation_key"))


@query(
    f"""WITH k AS (SELECT {D.norm_citation(_CITE)} AS key, max(o_orderkey) AS hit FROM orders GROUP BY 1),
    l AS (SELECT DISTINCT l_orderkey FROM lineitem),
    c AS (SELECT l_orderkey, {D.norm_citation(_CITE.replace('S.C.C.', 'SCC'))} AS key FROM l JOIN orders ON o_orderkey = l_orderkey)
    SELECT l_orderkey, hit FROM c LEFT JOIN k USING (key)"""
)
def citation_lookup(spark, d):
    """Citations written another way find their order; of equal keys the last writer wins."""
    orders = t(spark, d, "orders").select("o_orderkey", "o_orderdate")
    keys = orders.groupBy(T.norm_citation(_cite()).alias("key")).agg(F.max("o_orderkey").alias("hit"))
    asked = orders.join(t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi")
    plain = F.concat(F.year("o_orderdate"), F.lit(" "), F.col("o_orderkey") % 20, F.lit("  SCC "), F.col("o_orderkey"))
    return asked.select(F.col("o_orderkey").alias("l_orderkey"), T.norm_citation(plain).alias("key")).join(keys, "key", "left").select("l_orderkey", "hit")


@query(r"SELECT page_id, left(CASE WHEN b = '' THEN 'document' ELSE b END, 200) AS filename FROM (SELECT page_id, regexp_replace(regexp_extract(url, '[^\\/]*$'), '[^A-Za-z0-9_.\- ]+', '_', 'g') AS b FROM pages)")
def safe_filename(spark, d):
    return t(spark, d, "pages").select("page_id", T.safe_filename(F.col("url")).alias("filename"))


@query("SELECT p_partkey, '§ ' || trim(' ' || CAST(p_size AS VARCHAR) || ' ') || ' ' || upper(trim(p_type)) AS label FROM part")
def provision_label(spark, d):
    return t(spark, d, "part").select("p_partkey", T.provision_label(F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(" ")), F.col("p_type")).alias("label"))


@query("SELECT o_orderkey, CAST(day(o_orderdate) AS VARCHAR) || ' ' || strftime(o_orderdate, '%B %Y') AS day FROM orders")
def format_day(spark, d):
    return t(spark, d, "orders").select("o_orderkey", T.format_day(F.col("o_orderdate")).alias("day"))


@query("SELECT (SELECT count(*) FROM documents) AS n_documents, (SELECT count(*) FROM benchmark) AS n_passages")
def health(spark, d):
    one = t(spark, d, "documents").agg(F.count(F.lit(1)).alias("n_documents"))
    return one.crossJoin(t(spark, d, "benchmark").agg(F.count(F.lit(1)).alias("n_passages")))


# ---------------------------------------------------------------- similarity (V*, K4, K5, A2, R1)

_BT = f"SELECT item_id, unnest({D.words(D.norm_paragraph('text'))}) AS term FROM benchmark"
_DT = f"SELECT doc_id, unnest({D.words(D.norm_paragraph('text'))}) AS term FROM documents"
_CONTAIN = f"""n AS (SELECT item_id, term, count(*) AS n FROM ({_BT}) GROUP BY ALL),
    h AS (SELECT DISTINCT doc_id, term FROM ({_DT})), tot AS (SELECT item_id, sum(n) AS total FROM n GROUP BY 1),
    sc AS (SELECT item_id, doc_id, CAST(sum(n) AS DOUBLE) / CAST(any_value(total) AS DOUBLE) AS score FROM n JOIN h USING (term) JOIN tot USING (item_id) GROUP BY ALL)"""


def _contained(spark, d) -> DataFrame:
    return similarity.containment_join(t(spark, d, "benchmark"), t(spark, d, "documents"), "item_id", "doc_id")


@query(f"WITH {_CONTAIN} SELECT item_id, doc_id, round(score, 6) AS score FROM sc WHERE score >= 0.62")
def quote_containment(spark, d):
    return _contained(spark, d).filter("score >= 0.62").select("item_id", "doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {_CONTAIN} SELECT item_id, doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS r FROM sc) WHERE r = 1")
def quote_best_doc(spark, d):
    best = _contained(spark, d).withColumn("s", F.round("score", 9))
    top = best.groupBy("item_id").agg(F.max_by(F.struct("doc_id", "score"), F.struct("s", -F.col("doc_id"))).alias("m"))
    return top.select("item_id", "m.doc_id", F.round("m.score", 6).alias("score"))


@query(f"WITH b AS (SELECT item_id, {D.norm_paragraph('text')} AS n FROM benchmark), h AS (SELECT doc_id, {D.norm_paragraph('text')} AS n FROM documents) SELECT item_id, min(doc_id) AS first_doc, count(*) AS n_docs FROM b JOIN h ON contains(h.n, b.n) WHERE b.n <> '' GROUP BY 1")
def quote_exact(spark, d):
    """Verbatim passages: only documents that hold every token of a passage are searched for it."""
    full = _contained(spark, d).filter("score > 0.999999")
    b = t(spark, d, "benchmark").select("item_id", T.norm_paragraph(F.col("text")).alias("needle"))
    h = t(spark, d, "documents").select("doc_id", T.norm_paragraph(F.col("text")).alias("hay"))
    found = full.join(b, "item_id").join(h, "doc_id").filter(F.contains("hay", "needle"))
    return found.groupBy("item_id").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n_docs"))


@query(
    f"""WITH {_CONTAIN}, best AS (SELECT item_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS r FROM sc) WHERE r = 1),
    b AS (SELECT item_id, {D.words(D.norm_paragraph('text'))} AS w FROM benchmark), hay AS (SELECT doc_id, {D.words(D.norm_paragraph('text'))} AS w FROM documents),
    bp AS (SELECT item_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM b), hp AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS j FROM hay WHERE doc_id IN (SELECT doc_id FROM best)),
    m AS (SELECT item_id, i, i - j AS diag, i - row_number() OVER (PARTITION BY item_id, i - j ORDER BY i) AS isl FROM best JOIN bp USING (item_id) JOIN hp USING (doc_id, x)),
    runs AS (SELECT item_id, max(c) AS best FROM (SELECT item_id, diag, isl, count(*) AS c FROM m GROUP BY ALL) GROUP BY 1)
    SELECT item_id, doc_id, round(CAST(runs.best AS DOUBLE) / least(len(b.w), len(hay.w)), 6) AS run_ratio FROM runs JOIN best USING (item_id) JOIN b USING (item_id) JOIN hay USING (doc_id)"""
)
def longest_run_winner(spark, d):
    """Run ratio on the best document of each passage only."""
    best = _contained(spark, d).withColumn("s", F.round("score", 9)).groupBy("item_id").agg(F.max_by("doc_id", F.struct("s", -F.col("doc_id"))).alias("doc_id"))
    rows = best.join(t(spark, d, "benchmark").select("item_id", F.col("text").alias("a")), "item_id").join(t(spark, d, "documents").select("doc_id", F.col("text").alias("b")), "doc_id")
    return similarity.longest_run(rows, "a", "b").select("item_id", "doc_id", F.round("run_ratio", 6).alias("run_ratio"))


_IDF = f"""dt AS (SELECT DISTINCT doc_id, term FROM ({_DT})), nd AS (SELECT count(*) AS total FROM documents),
    w AS (SELECT term, count(*) AS df, ln((any_value(total) + 1.0) / (count(*) + 1.0)) + 1 AS weight FROM dt, nd GROUP BY 1)"""


def _idf(spark, d) -> DataFrame:
    docs = t(spark, d, "documents")
    return similarity.idf(similarity.term_counts(docs, "doc_id", "text"), docs)


@query(f"WITH {_IDF} SELECT term, df, round(weight, 6) AS weight FROM w")
def term_idf(spark, d):
    return _idf(spark, d).select("term", "df", F.round("weight", 6).alias("weight"))


_WEIGHTED = f"""{_IDF}, un AS (SELECT ln(count(*) + 1.0) + 1 AS unseen FROM w),
    nt AS (SELECT item_id, term, count(*) * coalesce(any_value(weight), any_value(unseen)) AS nw FROM ({_BT}) LEFT JOIN w USING (term), un GROUP BY ALL),
    ht AS (SELECT doc_id, term, count(*) * any_value(weight) AS hw FROM ({_DT}) JOIN w USING (term) GROUP BY ALL),
    nn AS (SELECT item_id, sum(nw) AS mass, sqrt(sum(nw * nw)) AS nnorm FROM nt GROUP BY 1), hn AS (SELECT doc_id, sqrt(sum(hw * hw)) AS hnorm FROM ht GROUP BY 1),
    ws AS (SELECT item_id, doc_id, sum(nw) / any_value(mass) AS containment, sum(nw * hw) / (any_value(nnorm) * any_value(hnorm)) AS cosine
           FROM nt JOIN ht USING (term) JOIN nn USING (item_id) JOIN hn USING (doc_id) GROUP BY ALL)"""


def _weighted(spark, d) -> DataFrame:
    return similarity.weighted_scores(t(spark, d, "benchmark"), t(spark, d, "documents"), "item_id", "doc_id", _idf(spark, d))


@query(f"WITH {_WEIGHTED} SELECT item_id, doc_id, round(containment, 5) AS containment, round(cosine, 5) AS cosine FROM ws WHERE containment >= 0.28")
def idf_weighted_scores(spark, d):
    return _weighted(spark, d).filter("containment >= 0.28").select("item_id", "doc_id", F.round("containment", 5).alias("containment"), F.round("cosine", 5).alias("cosine"))


@query(f"WITH {_WEIGHTED} SELECT item_id, doc_id, round(score, 5) AS score, CAST(r AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM (SELECT item_id, doc_id, round(greatest(containment, cosine), 9) AS score FROM ws) WHERE score > 0.05) WHERE r <= 12")
def retrieve_topk(spark, d):
    scored = _weighted(spark, d).select("item_id", "doc_id", F.round(F.greatest("containment", "cosine"), 9).alias("score")).filter("score > 0.05")
    return similarity.top_k(scored, "item_id", "score", "doc_id", 12).select("item_id", "doc_id", F.round("score", 5).alias("score"), F.col("rank").cast("long"))


@query(
    f"""WITH n AS (SELECT item_id, term, count(*) AS n FROM ({_BT}) GROUP BY ALL), h AS (SELECT doc_id, term, count(*) AS m FROM ({_DT}) GROUP BY ALL),
    nn AS (SELECT item_id, sqrt(sum(n * n)) AS a FROM n GROUP BY 1), hn AS (SELECT doc_id, sqrt(sum(m * m)) AS b FROM h GROUP BY 1),
    s AS (SELECT item_id, doc_id, round(sum(n * m) / (any_value(a) * any_value(b)), 9) AS score FROM n JOIN h USING (term) JOIN nn USING (item_id) JOIN hn USING (doc_id) GROUP BY ALL)
    SELECT item_id, doc_id, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM s) WHERE r <= 5"""
)
def lexical_cosine_topk(spark, d):
    n = similarity.term_counts(t(spark, d, "benchmark"), "item_id", "text")
    h = similarity.term_counts(t(spark, d, "documents"), "doc_id", "text").withColumnRenamed("n", "m")
    nn, hn = n.groupBy("item_id").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("a")), h.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("b"))
    s = n.join(h, "term").groupBy("item_id", "doc_id").agg(F.sum(F.col("n") * F.col("m")).alias("dot")).join(nn, "item_id").join(hn, "doc_id")
    s = s.select("item_id", "doc_id", F.round(F.col("dot") / (F.col("a") * F.col("b")), 9).alias("score"))
    return similarity.top_k(s, "item_id", "score", "doc_id", 5).select("item_id", "doc_id", F.round("score", 5).alias("score"))


@query(
    f"""WITH p AS (SELECT p_partkey AS k, {D.norm_title('p_name')} AS n FROM part), q AS (SELECT k, n, {D.trigrams('n')} AS tri, list_distinct(list_filter(string_split(n, ' '), lambda t: length(t) > 1)) AS tok FROM p WHERE n <> ''),
    g AS (SELECT k, unnest(tri) AS g FROM q), c AS (SELECT x.k AS a, y.k AS b, count(*) AS common FROM g x JOIN g y ON x.g = y.g AND x.k < y.k GROUP BY ALL),
    s AS (SELECT a, b, CASE WHEN x.n = y.n THEN 1.0 ELSE greatest(common / (len(x.tri) + len(y.tri) - common), (common / (len(x.tri) + len(y.tri) - common) + {D.jaccard('x.tok', 'y.tok')}) / 2) END AS score
          FROM c JOIN q x ON x.k = a JOIN q y ON y.k = b)
    SELECT a, b, round(score, 6) AS score FROM s WHERE score >= 0.72"""
)
def title_trigram_similarity(spark, d):
    return similarity.title_pairs(t(spark, d, "part"), "p_partkey", "p_name", 0.72).select("a", "b", F.round("score", 6).alias("score"))


@query("SELECT x.s_suppkey AS a, y.s_suppkey AS b, CAST(levenshtein(x.s_name, y.s_name) AS BIGINT) AS distance, round(1 - levenshtein(x.s_name, y.s_name) / greatest(length(x.s_name), length(y.s_name)), 6) AS ratio FROM supplier x JOIN supplier y ON x.s_nationkey = y.s_nationkey AND x.s_suppkey < y.s_suppkey")
def levenshtein_ratio(spark, d):
    s = t(spark, d, "supplier")
    l, r = s.alias("l"), s.alias("r")
    pairs = l.join(r, (F.col("l.s_nationkey") == F.col("r.s_nationkey")) & (F.col("l.s_suppkey") < F.col("r.s_suppkey")))
    x, y = F.col("l.s_name"), F.col("r.s_name")
    return pairs.select(F.col("l.s_suppkey").alias("a"), F.col("r.s_suppkey").alias("b"), F.levenshtein(x, y).cast("long").alias("distance"), F.round(T.levenshtein_ratio(x, y), 6).alias("ratio"))


@query("SELECT x.vec_id AS q, y.vec_id AS hit, round(c, 5) AS cosine, CAST(r AS BIGINT) AS rank FROM (SELECT x.vec_id AS q0, y.vec_id AS h0, round(list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])), 9) AS c, row_number() OVER (PARTITION BY x.vec_id ORDER BY round(list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])), 9) DESC, y.vec_id) AS r FROM embeddings x JOIN embeddings y ON x.label = y.label AND x.vec_id <> y.vec_id) z JOIN embeddings x ON x.vec_id = q0 JOIN embeddings y ON y.vec_id = h0 WHERE r <= 5")
def vector_cosine_topk(spark, d):
    """The five nearest of the same label."""
    near = similarity.vector_topk(t(spark, d, "embeddings"), "vec_id", "label", "embedding", 5)
    return near.select("q", "hit", F.round("c", 5).alias("cosine"), F.col("rank").cast("long"))


# ---------------------------------------------------------------- facets, search, paging

_SEL = {"brand": ["Brand#11", "Brand#23"], "type": [], "size": [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12]}
_OKB, _OKS = "p_brand IN ('Brand#11', 'Brand#23')", "p_size <= 12"


@query(f"SELECT 'brand' AS dim, p_brand AS value, count(*) AS n FROM part WHERE {_OKS} GROUP BY ALL UNION ALL SELECT 'type', p_type, count(*) FROM part WHERE {_OKB} AND {_OKS} GROUP BY ALL UNION ALL SELECT 'size', CAST(p_size AS VARCHAR), count(*) FROM part WHERE {_OKB} GROUP BY ALL")
def facets_disjunctive(spark, d):
    values = {"brand": F.array("p_brand"), "type": F.array("p_type"), "size": F.array("p_size")}
    return search.facets(t(spark, d, "part"), values, _SEL)


@query(
    f"""WITH b AS (SELECT item_id, {D.words(D.norm_paragraph('text'))} AS w FROM benchmark), c AS (SELECT doc_id, lang, source FROM documents)
    SELECT 'lang' AS dim, lang AS value, count(*) AS n FROM c WHERE source IN ('src1', 'src2') GROUP BY ALL UNION ALL SELECT 'source', source, count(*) FROM c WHERE lang = 'en' GROUP BY ALL"""
)
def facets_documents(spark, d):
    docs = t(spark, d, "documents").select("lang", "source")
    return search.facets(docs, {"lang": F.array("lang"), "source": F.array("source")}, {"lang": ["en"], "source": ["src1", "src2"]})


_BROWSE = "SELECT o_custkey AS custkey, max(year(o_orderdate)) AS y, count(*) AS n FROM orders GROUP BY 1"


@query(f"WITH s AS (SELECT custkey, round(log10(n + 1) / 3 * 20 + y / 1000, 9) AS score FROM ({_BROWSE})), c AS (SELECT count(*) AS total, max(score) AS top FROM s) SELECT custkey, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY score DESC, custkey) AS BIGINT) AS rank, total, greatest(1, CAST(ceil(total / 10) AS BIGINT)) AS total_pages, round(least(1.0, score / top), 6) AS relevance FROM s, c QUALIFY rank BETWEEN 21 AND 30")
def search_browse(spark, d):
    per = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("custkey")).agg(F.max(F.year("o_orderdate")).alias("y"), F.count(F.lit(1)).alias("n"))
    s = per.select("custkey", F.round(search.browse_score(F.col("n"), F.col("y")), 9).alias("score"))
    return search.page(s, "score", "custkey", 3, 10).select("custkey", F.round("score", 6).alias("score"), F.col("rank").cast("long"), "total", "total_pages", F.round("relevance", 6).alias("relevance"))


# ---------------------------------------------------------------- verification

# The statuses in order of severity.
_STATUS = ("NO_AUTHORITATIVE_MATCH", "METADATA_MISMATCH", "PARAGRAPH_MISMATCH", "WEAK_PROPOSITION_SUPPORT", "NEEDS_REVIEW", "VERIFIED")
_BASE = BASE_SCORES


_LADDER = "CASE WHEN NOT b0 THEN 'NO_AUTHORITATIVE_MATCH' WHEN b1 THEN 'NEEDS_REVIEW' WHEN b2 OR b3 THEN 'METADATA_MISMATCH' WHEN b4 OR b5 THEN 'PARAGRAPH_MISMATCH' WHEN NOT b6 THEN 'NEEDS_REVIEW' WHEN b7 THEN 'WEAK_PROPOSITION_SUPPORT' WHEN NOT b8 THEN 'NEEDS_REVIEW' ELSE 'VERIFIED' END"
_BITS = "SELECT event_id, " + ", ".join(f"((event_id * 37 + user_id) >> {k}) % 2 = 1 AS b{k}" for k in range(9)) + " FROM events"


@query(f"SELECT event_id, {_LADDER} AS status FROM ({_BITS})")
def status_ladder(spark, d):
    """Every combination of findings, dealt over the events."""
    bits = F.col("event_id") * 37 + F.col("user_id")
    return t(spark, d, "events").select("event_id", status(*[(F.shiftright(bits, k) % 2) == 1 for k in range(9)]).alias("status"))


@query("SELECT item, status, round(CASE status " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _BASE.items()) + " END + CASE WHEN status = 'VERIFIED' THEN least(0.06, sim / 10) ELSE 0 END + 1e-12, 3) AS score FROM (SELECT event_id AS item, " + "CASE event_id % 6 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(_STATUS)) + " END AS status, (event_id % 11) / 10.0 AS sim FROM events)")
def status_scores(spark, d):
    name = F.element_at(F.array(*map(F.lit, _STATUS)), (F.col("event_id") % 6 + 1).cast("int"))
    sim = (F.col("event_id") % 11) / 10.0
    return t(spark, d, "events").select(F.col("event_id").alias("item"), name.alias("status"), status_score(name, sim + 1e-11).alias("score"))


@query("SELECT user_id, " + ", ".join(f"count(*) FILTER (WHERE event_id % 6 = {i}) AS {s.lower()}" for i, s in enumerate(_STATUS)) + ", count(*) AS total, count(*) FILTER (WHERE event_id % 6 <> 5) AS issues FROM events GROUP BY 1")
def doc_status_counts(spark, d):
    """Zero-filled counts of the six statuses per owner, in one pass."""
    counts = [F.count_if(F.col("event_id") % 6 == i).alias(s.lower()) for i, s in enumerate(_STATUS)]
    return t(spark, d, "events").groupBy("user_id").agg(*counts, F.count(F.lit(1)).alias("total"), F.count_if(F.col("event_id") % 6 != 5).alias("issues"))


@query("SELECT user_id, event_id, CAST(r AS BIGINT) AS rank FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 6, event_id) AS r FROM events) WHERE r <= 3")
def severity_order(spark, d):
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("event_id") % 6, "event_id"))
    return t(spark, d, "events").withColumn("rank", rank).filter("rank <= 3").select("user_id", "event_id", F.col("rank").cast("long"))


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS decided, (year(o_orderdate) + o_orderkey % 4 - 1) IN (year(o_orderdate), year(o_orderdate) + 1) AS year_agrees FROM orders")
def metadata_year(spark, d):
    """A cited year agrees with the decision year or any year in the record's own citations."""
    y = F.year("o_orderdate")
    forms = F.array(F.concat(F.lit("("), y + 1, F.lit(") 9 SCC "), F.col("o_orderkey")))
    years = F.array_distinct(F.array_compact(F.concat(F.array(y), F.transform(forms, T.extract_year))))
    claimed = (y + F.col("o_orderkey") % 4 - 1).cast("int")
    return t(spark, d, "orders").select("o_orderkey", y.cast("long").alias("decided"), F.array_contains(years, claimed).alias("year_agrees"))


# ---------------------------------------------------------------- graph (J6-J9, A16), dossier (J5), board (A12, B2), limiter

_EDGES = "SELECT DISTINCT 's' || CAST(l_suppkey AS VARCHAR) AS src, 'p' || CAST(l_partkey AS VARCHAR) AS dst, CASE l_linenumber % 3 WHEN 0 THEN 'CITES' WHEN 1 THEN 'FOLLOWS' ELSE 'AFFIRMS' END AS type FROM lineitem"


def _edges(spark, d) -> DataFrame:
    kind = F.when(F.col("l_linenumber") % 3 == 0, "CITES").when(F.col("l_linenumber") % 3 == 1, "FOLLOWS").otherwise("AFFIRMS")
    keys = t(spark, d, "lineitem").select("l_suppkey", "l_partkey", kind.alias("type")).distinct()
    e = keys.select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"), "type", (F.col("l_suppkey") * (1 << 31) + F.col("l_partkey")).alias("edge_ord"))
    return e.withColumn("edge_id", F.concat_ws("-", "src", "dst", "type"))


@query(f"WITH e AS ({_EDGES}) SELECT src AS case_id, dst AS other_id, type FROM e UNION ALL SELECT dst, src, CASE type WHEN 'AFFIRMS' THEN 'RELATED' ELSE 'CITED_BY' END FROM e")
def edges_both_directions(spark, d):
    return graph.both_directions(_edges(spark, d)).select("case_id", "other_id", "type")


@query(f"SELECT dst AS case_id, count(*) AS incoming, count(DISTINCT src) AS citing FROM ({_EDGES}) GROUP BY 1")
def incoming_counts(spark, d):
    return _edges(spark, d).groupBy(F.col("dst").alias("case_id")).agg(F.count(F.lit(1)).alias("incoming"), F.countDistinct("src").alias("citing"))


_BFS = "WITH e AS ({e}), b AS ({b}), h AS (SELECT DISTINCT y AS case_id FROM b WHERE x = 'p1') SELECT 'p1' AS case_id, 0 AS hop UNION ALL SELECT case_id, 1 FROM h UNION ALL SELECT DISTINCT y, 2 FROM b WHERE x IN (SELECT case_id FROM h) AND y <> 'p1' AND y NOT IN (SELECT case_id FROM h)"


@query(_BFS.format(e=_EDGES, b="SELECT src AS x, dst AS y FROM e UNION ALL SELECT dst, src FROM e"))
def bfs_depth2(spark, d):
    """Cases within two hops of part 1."""
    return graph.expand(_edges(spark, d), "p1", 2)[0]


@query(_BFS.format(e=_EDGES, b="SELECT src AS x, dst AS y FROM e WHERE type = 'CITES' UNION ALL SELECT dst, src FROM e WHERE type IN ('CITES', 'FOLLOWS')"))
def bfs_typed(spark, d):
    """Cases within two hops of part 1 by citations: from a part also against those that follow it."""
    return graph.expand(_edges(spark, d), "p1", 2, ("CITES", "CITED_BY"))[0]


@query(f"WITH RECURSIVE e AS ({_EDGES}), b AS (SELECT src AS x, dst AS y FROM e WHERE type = 'AFFIRMS' UNION SELECT dst, src FROM e WHERE type = 'AFFIRMS'), m AS (SELECT 's1' AS case_id UNION SELECT y FROM m JOIN b ON x = case_id), c AS (SELECT 's' || CAST(l_suppkey AS VARCHAR) AS case_id, min(l_shipdate) AS decided FROM lineitem GROUP BY 1 UNION ALL SELECT 'p' || CAST(l_partkey AS VARCHAR), min(l_shipdate) FROM lineitem GROUP BY 1) SELECT case_id, year(decided) AS decided, CASE WHEN case_id IN (SELECT src FROM e WHERE type = 'AFFIRMS') THEN 'AFFIRMATION' ELSE 'DECISION' END AS kind FROM m JOIN c USING (case_id)")
def timeline_kind(spark, d):
    """The chain of supplier 1, each member decided in the year of its first shipment."""
    lines = t(spark, d, "lineitem")
    dated = lambda kind, key: lines.groupBy(F.concat(F.lit(kind), key).alias("case_id")).agg(F.year(F.min("l_shipdate")).alias("decided"))
    return graph.timeline(dated("s", "l_suppkey").unionByName(dated("p", "l_partkey")), _edges(spark, d), "s1")


@query("SELECT l_partkey AS partkey, o_orderkey AS citing, CAST(row_number() OVER (PARTITION BY l_partkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey) AS BIGINT) AS rank FROM (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem) JOIN orders ON o_orderkey = l_orderkey")
def citing_cases(spark, d):
    links = t(spark, d, "lineitem").select(F.col("l_partkey").alias("partkey"), F.col("l_orderkey").alias("o_orderkey")).distinct()
    rows = links.join(t(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderkey")
    rank = F.row_number().over(Window.partitionBy("partkey").orderBy(F.desc_nulls_last("o_orderdate"), "o_orderkey"))
    return rows.select("partkey", F.col("o_orderkey").alias("citing"), rank.cast("long").alias("rank"))


@query("SELECT o_orderkey, CAST(count(l_orderkey) AS BIGINT) AS n_lines, string_agg(CAST(l_linenumber AS VARCHAR) || ':' || CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey) AS lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def dossier_nested(spark, d):
    """Each order with its nested lines; unmatched ones stay."""
    lines = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("ls"))
    out = t(spark, d, "orders").select("o_orderkey").join(lines, "o_orderkey", "left")
    text = F.array_join(F.transform("ls", lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_partkey"].cast("string"))), ",")
    return out.select("o_orderkey", F.coalesce(F.size("ls"), F.lit(0)).cast("long").alias("n_lines"), text.alias("lines"))


@query("SELECT user_id, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{x}') AS n_{x}" for x in ("click", "view", "purchase")) + ", count(DISTINCT props) AS sources FROM events GROUP BY 1")
def board_summary(spark, d):
    kinds = [F.count_if(F.col("event_type") == x).alias(f"n_{x}") for x in ("click", "view", "purchase")]
    return t(spark, d, "events").groupBy("user_id").agg(*kinds, F.countDistinct("props").alias("sources"))


@query("SELECT user_id, event_type, props, min_by(event_id, (ts, event_id)) AS first_event FROM events GROUP BY ALL")
def dedupe_pins(spark, d):
    """One pin per owner, type and entity; the first stays."""
    return t(spark, d, "events").groupBy("user_id", "event_type", "props").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("first_event"))


@query(
    """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    r AS (SELECT user_id, event_id, i, t + 86400000000 AS reset, 1 AS n FROM e WHERE i = 1
      UNION ALL SELECT e.user_id, e.event_id, e.i, CASE WHEN e.t >= r.reset THEN e.t + 86400000000 ELSE r.reset END, CASE WHEN e.t >= r.reset THEN 1 ELSE r.n + 1 END
      FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
    SELECT user_id, event_id, n <= 2 AS admitted FROM r"""
)
def rate_limit_admit(spark, d):
    return limits.admit(t(spark, d, "events"), "user_id", "ts", "event_id", 2, 86_400)


# ---------------------------------------------------------------- provenance (P6-P8), pages and blocks (S6, S7, X9), anchors


@query("SELECT page_id, url SIMILAR TO 'https?://[^/?#]+.*' AS valid, CASE WHEN page_id % 7 = 0 THEN 'PRIMARY' WHEN page_id % 5 = 0 THEN 'SECONDARY' ELSE 'DEMO' END AS strongest FROM pages")
def provenance_valid(spark, d):
    """A source is usable with an http(s) URL; the strongest level by rank, the first on ties."""
    levels = F.array_compact(F.array(F.lit("USER"), F.when(F.col("page_id") % 5 == 0, F.lit("SECONDARY")), F.when(F.col("page_id") % 7 == 0, F.lit("PRIMARY")), F.lit("DEMO")))
    rank = lambda x: F.element_at(F.create_map(*[F.lit(v) for kv in {"PRIMARY": 4, "SECONDARY": 3, "DEMO": 2, "USER": 1}.items() for v in kv]), x)
    best = F.array_max(F.transform(levels, lambda x, i: F.struct(rank(x).alias("r"), (-i).alias("o"), x.alias("level"))))["level"]
    proto = F.try_parse_url("url", F.lit("PROTOCOL"))
    return t(spark, d, "pages").select("page_id", F.coalesce(proto.isin("http", "https") & (F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit("")) != ""), F.lit(False)).alias("valid"), best.alias("strongest"))


@query("SELECT doc_id, CAST(i AS BIGINT) AS line_no, CAST(length(l) AS BIGINT) AS n_chars, CAST(coalesce(sum(length(l) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)")
def blocks_and_pages(spark, d):
    """Lines as pages, with running offsets, inside the row: no shuffle."""
    lines = F.split("text", "\n", -1)
    empty = F.array().cast("array<struct<line_no:bigint,n_chars:bigint,start:bigint>>")
    step = lambda s, l: F.struct(
        (s["at"] + F.length(l) + 1).alias("at"), (s["i"] + 1).alias("i"),
        F.array_append(s["out"], F.struct((s["i"] + 1).alias("line_no"), F.length(l).cast("long").alias("n_chars"), s["at"].alias("start"))).alias("out"),
    )
    zero = F.lit(0).cast("long")
    starts = F.aggregate("ls", F.struct(zero.alias("at"), zero.alias("i"), empty.alias("out")), step, lambda s: s["out"])
    return t(spark, d, "documents").select("doc_id", lines.alias("ls")).select("doc_id", F.explode(starts).alias("p")).select("doc_id", "p.*")


@query("SELECT doc_id, CAST(greatest(1, len(list_filter(o, lambda x: x <= n // 2))) AS BIGINT) AS page FROM (SELECT doc_id, length(text) AS n, list_transform(range(0, length(text) // 500 + 1), lambda i: i * 500) AS o FROM documents)")
def page_for_offset(spark, d):
    """The last page that starts at or before the offset: pages of 500 characters, the middle of the text."""
    starts = F.transform(F.sequence(F.lit(0), F.floor(F.coalesce(F.length("text"), F.lit(0)) / 500)), lambda i: i * 500)
    return t(spark, d, "documents").select("doc_id", F.greatest(F.lit(1), F.size(F.filter(starts, lambda x: x <= F.floor(F.length("text") / 2)))).cast("long").alias("page"))


def _sentences(spark, d) -> DataFrame:
    y = F.year("o_orderdate").cast("string")
    k = F.col("o_orderkey").cast("string")
    text = F.concat(F.lit("As held in "), y, F.lit(" INSC "), k, F.lit(", ("), y, F.lit(") 17 SCC "), (F.col("o_orderkey") % 9999 + 1).cast("string"), F.lit(". See also AIR "), y, F.lit(" SC "), (F.col("o_orderkey") % 999 + 1).cast("string"), F.lit(" and Section "), (F.col("o_orderkey") % 200 + 1).cast("string"), F.lit(" of the Contract Act; Civil Appeal No. "), k, F.lit(" of "), y)
    return t(spark, d, "orders").select("o_orderkey", text.alias("text"))


_SENT = "'As held in ' || y || ' INSC ' || k || ', (' || y || ') 17 SCC ' || CAST(o_orderkey % 9999 + 1 AS VARCHAR) || '. See also AIR ' || y || ' SC ' || CAST(o_orderkey % 999 + 1 AS VARCHAR) || ' and Section ' || CAST(o_orderkey % 200 + 1 AS VARCHAR) || ' of the Contract Act; Civil Appeal No. ' || k || ' of ' || y"
_S = "SELECT o_orderkey, CAST(year(o_orderdate) AS VARCHAR) AS y, CAST(o_orderkey AS VARCHAR) AS k FROM orders"
_RAW = {"NEUTRAL": "y || ' INSC ' || k", "REPORTER": "'(' || y || ') 17 SCC ' || CAST(o_orderkey % 9999 + 1 AS VARCHAR)", "AIR": "'AIR ' || y || ' SC ' || CAST(o_orderkey % 999 + 1 AS VARCHAR)", "CASE_NUMBER": "'Civil Appeal No. ' || k || ' of ' || y"}


@query("WITH s AS (SELECT *, " + _SENT + f" AS text FROM ({_S})) " + " UNION ALL ".join(f"SELECT o_orderkey, '{f}' AS form, {r} AS raw, CAST(strpos(text, {r}) - 1 AS BIGINT) AS start FROM s" for f, r in _RAW.items()))
def detect_anchors(spark, d):
    return extract.anchors(_sentences(spark, d), "o_orderkey").select("o_orderkey", "form", "raw", F.col("start").cast("long"))


@query("WITH s AS (SELECT *, " + _SENT + f" AS text FROM ({_S})) SELECT o_orderkey, {_RAW['NEUTRAL']} || ', ' || {_RAW['REPORTER']} AS raw, 'NEUTRAL+REPORTER' AS forms, CAST(2 AS BIGINT) AS n FROM s UNION ALL SELECT o_orderkey, {_RAW['AIR']}, 'AIR', CAST(1 AS BIGINT) FROM s UNION ALL SELECT o_orderkey, {_RAW['CASE_NUMBER']}, 'CASE_NUMBER', CAST(1 AS BIGINT) FROM s")
def merge_anchors(spark, d):
    s = _sentences(spark, d)
    return extract.merge_adjacent(extract.anchors(s, "o_orderkey"), s, "o_orderkey").select("o_orderkey", "raw", "forms", "n")


@query("SELECT o_orderkey, CAST(o_orderkey % 200 + 1 AS VARCHAR) AS section, 'Contract Act' AS act FROM orders")
def detect_provisions(spark, d):
    return extract.provisions(_sentences(spark, d), "o_orderkey")

"""Golden values of the scalar operators and of graph and timeline on an invented corpus."""

import pytest
from pyspark.sql import functions as F

from quaero.functions import text as T
from quaero.operators import extract, graph, search


def value(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("f", "given", "wanted"),
    [
        (T.norm_citation, "(2018) 17 S.C.C. 394", "2018 17 SCC 394"),
        (T.norm_citation, "[2018] 17  SCC 394", "2018 17 SCC 394"),
        (T.extract_year, "(2021) 9 SCC 321", 2021),
        (T.extract_year, "no year here", None),
        (T.paragraph_ref, "at paragraph 26", "26"),
        (T.paragraph_ref, "paragraphs 26-28", "26"),
        (T.paragraph_ref, "¶ 18", "18"),
        (T.paragraph_ref, "none", None),
        (T.norm_title, "Dr. Arun Rao v. Blue Hills Ltd.", "arun rao blue hills"),
        (T.norm_title, "The State of X & Anr. vs. Y Pvt. Ltd. (India)", "state of x y"),
        (T.norm_paragraph, "Section 14, read with § 60(2), applies.", "section 14 read with section 60 2 applies"),
        (T.squeeze, " a  b\t", "a b"),
        (T.safe_filename, "a/b\\c d?.pdf", "c d_.pdf"),
        (T.safe_filename, "", "document"),
    ],
)
def test_scalars(spark, f, given, wanted):
    assert value(spark, f(F.lit(given))) == wanted


def test_null_text_stays_null(spark):
    assert value(spark, T.norm_paragraph(F.lit(None).cast("string"))) is None


def test_measures(spark):
    empty = F.array().cast("array<string>")
    assert value(spark, T.jaccard(empty, empty)) == 1
    assert value(spark, T.levenshtein_ratio(F.lit(""), F.lit(""))) == 1
    assert value(spark, T.containment(empty, F.array(F.lit("a")))) == 0
    assert value(spark, T.trigrams(F.lit("ab"))) == ["  a", " ab", "ab "]
    assert value(spark, T.vector_cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0


def test_anchor_offsets_slice_the_text(spark):
    text = "In X (2018) 17 SCC 394, 2018 INSC 712 and AIR 2018 SC 3054 😀 then (2021) 9 SCC 321"
    docs = spark.createDataFrame([(1, text)], "id int, text string")
    rows = extract.anchors(docs, "id").collect()
    assert len(rows) == 4
    assert all(text[r["start"] : r["end"]] == r["raw"] for r in rows)
    merged = extract.merge_adjacent(extract.anchors(docs, "id"), docs, "id").orderBy("start").collect()
    assert [r["n"] for r in merged] == [2, 1, 1]


EDGES = [(0, "rel-0", "a", "b", "APPEAL_OF"), (1, "rel-1", "b", "c", "REVERSES"), (2, "rel-2", "a", "b", "RELATED"), (3, "rel-3", "d", "a", "CITES"), (4, "rel-4", "d", "d", "CITES")]


def test_expand(spark):
    edges = spark.createDataFrame(EDGES, "edge_ord int, edge_id string, src string, dst string, type string")
    nodes, links = graph.expand(edges, "a", 1)
    assert {(r["case_id"], r["hop"]) for r in nodes.collect()} == {("a", 0), ("b", 1), ("d", 1)}
    kinds = {(r["a"], r["b"], r["type"]) for r in links.collect()}
    assert kinds == {("a", "b", "APPEAL_OF"), ("a", "d", "CITED_BY")}
    nodes, _ = graph.expand(edges, "a", 2)
    assert nodes.count() == 4


def test_expand_keeps_the_order_of_many_edges(spark):
    # d is met before x, so the link between them is named as d sees it, whatever size the numbers of edges have.
    rows = [(1, "e1", "a", "b", "CITES"), (2, "e2", "a", "c", "CITES"), (5_000_000_000, "e3", "b", "d", "CITES"), (4, "e4", "c", "x", "CITES"), (6, "e6", "x", "d", "RELATED")]
    edges = spark.createDataFrame(rows, "edge_ord long, edge_id string, src string, dst string, type string")
    nodes, links = graph.expand(edges, "a", 4)
    assert {(r["case_id"], r["hop"]) for r in nodes.collect()} == {("a", 0), ("b", 1), ("c", 1), ("d", 2), ("x", 2)}
    assert {r["edge_id"] for r in links.collect() if (r["a"], r["b"]) == ("d", "x")} == {"e6--inverse"}


def test_timeline(spark):
    edges = spark.createDataFrame(EDGES, "edge_ord int, edge_id string, src string, dst string, type string")
    cases = spark.createDataFrame([("a", "2018-01-01"), ("b", "2019-01-01"), ("c", None), ("d", "2020-01-01")], "case_id string, decided string")
    rows = {r["case_id"]: r["kind"] for r in graph.timeline(cases, edges, "a").collect()}
    assert rows == {"a": "APPEAL", "b": "REVERSAL"}


def test_page_is_clamped(spark):
    rows = search.page(spark.range(5).select(F.col("id").cast("double").alias("s"), "id"), "s", "id", 99, 2).collect()
    assert [r["id"] for r in rows] == [0] and rows[0]["total_pages"] == 3

"""Claims, scored search, board rules, files and the streamed limiter on small hard cases."""

import re

import pytest
from pyspark.sql import functions as F

from quaero.functions import text as T
from quaero.operators import claims, evidence, extract, graph, limits
from quaero.sources import texts
from quaero.streaming.limits import admit_stream


@pytest.mark.parametrize(
    ("before", "title"),
    [
        ("As was held in Alpha Traders Ltd.\nv. State Bank & Ors., ", "Alpha Traders Ltd. v. State Bank & Ors."),
        ("The point is settled. See also In A.B. Rao versus Union of India ", "A.B. Rao versus Union of India"),
        ("It was decided by a Bench. v. State Bank ", None),
        ("nothing that looks like one, ", None),
        ("Alpha Beta Gamma ", None),
        ("", None),
        (" , ,", None),
        ("One Ends Here. Dr. Rao v. M/s. Kumar Pvt. Ltd., ", "Dr. Rao v. M/s. Kumar Pvt. Ltd."),
    ],
)
def test_claimed_title(before, title):
    assert claims.claimed_title(before, len(before)) == title


def test_claims_stay_in_their_block(spark):
    long = "words that are quoted here at some length indeed"
    text = f'1. First "{long} one".\n \t\n2. At para 7 the NCLT said “{long} two” of 2018 INSC 712 and "{long} three".\f3. Then "{long} four" at paragraph 9 in the High Court'
    rows = [(1, text), (2, "2018 INSC 712"), (3, "2018 INSC 712, (2018) 17 SCC 394; 2018 INSC 712"), (4, ""), (5, "none at all"), (6, "Ä😀 2018\nINSC\n712")]
    docs = spark.createDataFrame(rows, "id int, text string")
    found = extract.anchors(docs, "id")
    got = found.join(docs, "id")
    for r in got.collect():
        assert r["text"][r["start"] : r["end"]] == r["raw"]
    assert sorted(r["id"] for r in got.collect()) == [1, 2, 3, 3, 3, 6]
    t, s, e = F.col("text"), F.col("start"), F.col("end")
    one = got.filter("id = 1").select(claims.quotation(t, s, e).alias("q"), claims.court_hint(t, s, e).alias("c"), claims.paragraph_ref(t, s, e).alias("p"), claims.block(t, s, e)[0].alias("b")).first()
    assert one["q"] == f"{long} three" and one["c"] == "National Company Law Tribunal" and one["p"] == "7"
    assert one["b"] == re.split(r"\n[ \t]*\n|\f", text)[1]
    two = got.filter("id = 2").select(claims.quotation(t, s, e).alias("q"), claims.court_hint(t, s, e).alias("c")).first()
    assert two["q"] is None and two["c"] is None
    parts = claims.segments(found.select("id", "start", "end"), docs, "id").collect()
    for i, x in rows:
        mine = sorted((r["nth"], r["start"], r["end"]) for r in parts if r["id"] == i)
        assert "".join(x[a:b] for _, a, b in mine) == x


def test_candidates_beyond_the_tie_stay_behind(spark):
    rows = [(1, 1, 0.90, False, False, False, False, False), (1, 2, 0.88, True, True, False, True, True), (1, 3, 0.80, True, True, True, True, True), (2, 9, 0.5, False, False, False, False, False)]
    got = evidence.ranked_candidates(spark.createDataFrame(rows, "claim int, ord int, sim double, reporter_ok boolean, court_ok boolean, year_ok boolean, year_near boolean, paragraph_ok boolean")).collect()
    assert {(r["claim"], r["rank"]): (r["ord"], r["points"]) for r in got} == {(1, 1): (2, 8), (1, 2): (1, 0), (1, 3): (3, -1), (2, 1): (9, 0)}


def test_first_identifier_and_last_record_win(spark):
    forms = spark.createDataFrame([("(2018) 17 SCC 394", 1), ("2018 17 S.C.C. 394", 2), ("2021 INSC 319", 3), ("...", 4)], "form string, ord int")
    rows = [(1, ["[2018] 17 SCC 394", "2021 INSC 319"]), (2, [None, "unknown", "2021 insc 319"]), (3, ["nothing"]), (4, []), (5, ["..."])]
    got = {r["claim"]: r["ord"] for r in evidence.resolved(spark.createDataFrame(rows, "claim int, ids array<string>"), forms).collect()}
    assert got == {1: 2, 2: 3}


def test_squeeze_and_board(spark):
    assert spark.createDataFrame([("  a  \n b﻿ ",)], "x string").select(T.squeeze(F.col("x"))).first()[0] == "a b"
    nodes = spark.createDataFrame([(i,) for i in range(4)], "node int")
    edges = spark.createDataFrame([(0, 1), (1, 1), (1, 2), (2, 3), (3, 9)], "a int, b int")
    assert sorted(map(tuple, evidence.allowed_edges(edges, nodes).select("a", "b").collect())) == [(0, 1), (1, 2), (2, 3)]
    left, links = evidence.without_nodes(nodes, edges, spark.createDataFrame([(1,)], "node int"))
    assert sorted(r["node"] for r in left.collect()) == [0, 2, 3] and sorted(map(tuple, links.select("a", "b").collect())) == [(2, 3), (3, 9)]


def test_graph_of_an_unknown_case_is_empty(spark):
    edges = spark.createDataFrame([("a", "b", "CITES", "e1", 1)], "src string, dst string, type string, edge_id string, edge_ord long")
    cases = spark.createDataFrame([("a",), ("b",), ("lone",)], "case_id string")
    assert graph.expand(edges, "unknown", 2, cases=cases)[0].count() == 0 and graph.expand(edges, "unknown", 2, cases=cases)[1].count() == 0
    assert [r["case_id"] for r in graph.expand(edges, "lone", 2, cases=cases)[0].collect()] == ["lone"]
    assert sorted(r["case_id"] for r in graph.expand(edges, "a", 1, ("CITES",), cases)[0].collect()) == ["a", "b"]
    assert sorted(r["case_id"] for r in graph.expand(edges, "b", 1, ("CITES",), cases)[0].collect()) == ["b"]  # the type seen from b is CITED_BY


def test_texts_from_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("one\r\ntwo\fthree é".encode())
    (tmp_path / "b.txt").write_bytes(b"")
    got = {r["path"][-5:]: r for r in texts.read_texts(spark, f"file://{tmp_path}").select("path", "size", texts.pages(F.col("text")).alias("p")).withColumn("s", texts.page_starts(F.col("p"))).withColumn("j", texts.joined(F.col("p"))).collect()}
    assert got["a.txt"]["p"] == ["one\ntwo", "three é"] and got["a.txt"]["s"] == [0, 10] and got["a.txt"]["j"][10:] == "three é"
    assert set(got) == {"a.txt"}  # an empty file gives no row


def test_streamed_limiter_equals_the_batch_one(spark, tmp_path):
    rows = [(u, i, i * 7 % 50 + u) for u in range(5) for i in range(40)]
    events = spark.createDataFrame(sorted(rows, key=lambda r: r[2]), "user_id long, event_id long, s long").selectExpr("user_id", "event_id", "timestamp_seconds(1700000000 + s) AS ts")
    for k, part in enumerate(("s < 20", "s >= 20")):
        low, high = (0, 20) if k == 0 else (20, 100)
        events.filter((F.unix_timestamp("ts") - 1700000000 >= low) & (F.unix_timestamp("ts") - 1700000000 < high)).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    q = admit_stream(stream, "user_id", "ts", "event_id", 3, 10).writeStream.format("parquet").option("checkpointLocation", f"file://{tmp_path}/state").outputMode("append").trigger(availableNow=True).start(f"file://{tmp_path}/out")
    q.awaitTermination(120)
    assert q.exception() is None
    want = {(r["user_id"], r["event_id"]): r["admitted"] for r in limits.admit(events, "user_id", "ts", "event_id", 3, 10).collect()}
    got = {(r["user_id"], r["event_id"]): r["admitted"] for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    assert got == want and any(want.values()) and not all(want.values())

"""Typed citation graph: both directions, bounded expansion, procedural timeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What an edge is called from its other end.
INVERSE = {
    "CITES": "CITED_BY", "CITED_BY": "CITES", "FOLLOWS": "CITED_BY", "DISTINGUISHES": "CITED_BY", "OVERRULES": "CITED_BY",
    "APPEAL_OF": "RELATED", "AFFIRMS": "RELATED", "REVERSES": "RELATED", "REMANDS": "RELATED", "RELATED": "RELATED",
}
PROCEDURAL = ("APPEAL_OF", "AFFIRMS", "REVERSES", "REMANDS")


def literal_map(values: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def both_directions(edges: DataFrame) -> DataFrame:
    """edges(edge_ord, edge_id, src, dst, type) -> what each case sees: case_id, other_id, type, edge_id, edge_ord, inbound.

    A self-loop is seen once, outbound.
    """
    out = edges.select(F.col("src").alias("case_id"), F.col("dst").alias("other_id"), "type", "edge_id", "edge_ord", F.lit(0).alias("inbound"))
    back = edges.filter("src <> dst").select(
        F.col("dst").alias("case_id"), F.col("src").alias("other_id"), literal_map(INVERSE, F.col("type")).alias("type"),
        F.concat("edge_id", F.lit("--inverse")).alias("edge_id"), "edge_ord", F.lit(1).alias("inbound"),
    )
    return out.unionByName(back)


def expand(edges: DataFrame, start: str, depth: int, types: tuple[str, ...] = (), cases: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Breadth-first from start: nodes(case_id, hop) and edges(a, b, type, edge_id). With cases(case_id), a start that is
    none of them has an empty graph.

    Order is part of the result: cases of a hop in the order they were met,
    their edges by edge_ord; of edges with the same ends and type the first
    stays; RELATED is left out where an earlier edge joins the same ends. A
    hop is one join with the frontier, and depth bounds the hops.
    """
    seen = both_directions(edges)
    if types:
        seen = seen.filter(F.col("type").isin(*types))
    spark = edges.sparkSession
    # A start that no edge touches is still a node.
    frontier = nodes = spark.createDataFrame([(start, 0, [])], "case_id string, hop int, pos array<long>")
    if cases is not None:
        frontier = nodes = frontier.join(cases.select("case_id"), "case_id", "left_semi")
    met = None
    for hop in range(depth):
        step = frontier.select("case_id", "pos").join(seen, "case_id").select(
            "case_id", "other_id", "type", "edge_id", F.lit(hop).alias("hop"), "pos", "edge_ord", "inbound"
        )
        met = step if met is None else met.unionByName(step)
        new = step.groupBy(F.col("other_id").alias("case_id")).agg(F.min(F.struct("pos", "edge_ord", "inbound")).alias("at"))
        new = new.join(nodes.select("case_id"), "case_id", "left_anti")
        # Positions only need to keep the order: those of the parent, then the edge, however many edges there are.
        frontier = new.select("case_id", F.lit(hop + 1).alias("hop"), F.concat("at.pos", F.array(F.col("at.edge_ord").cast("long"), F.col("at.inbound").cast("long"))).alias("pos"))
        nodes = nodes.unionByName(frontier)
    key = F.struct("hop", "pos", "edge_ord", "inbound")
    ends = met.select(F.least("case_id", "other_id").alias("a"), F.greatest("case_id", "other_id").alias("b"), "type", "edge_id", key.alias("at"))
    first = ends.groupBy("a", "b", "type").agg(F.min_by("edge_id", "at").alias("edge_id"), F.min("at").alias("at"))
    specific = first.filter("type <> 'RELATED'").groupBy(F.col("a").alias("sa"), F.col("b").alias("sb")).agg(F.min("at").alias("sat"))
    kept = first.join(specific, (F.col("a") == F.col("sa")) & (F.col("b") == F.col("sb")), "left").filter(
        "type <> 'RELATED' OR sat IS NULL OR at < sat"
    )
    return nodes.select("case_id", "hop"), kept.select("a", "b", "type", "edge_id")


def chain(edges: DataFrame, start: str) -> DataFrame:
    """case_id of all that procedural edges, in either direction, join to start; a round for each hop, until none is new."""
    links = edges.filter(F.col("type").isin(*PROCEDURAL))
    both = links.select(F.col("src").alias("x"), F.col("dst").alias("y")).unionByName(links.select(F.col("dst").alias("x"), F.col("src").alias("y"))).distinct()
    found = frontier = edges.sparkSession.createDataFrame([(start,)], "case_id string")
    while True:
        new = both.join(frontier, F.col("x") == F.col("case_id")).select(F.col("y").alias("case_id")).distinct().join(found, "case_id", "left_anti").checkpoint()
        if not new.limit(1).count():
            return found
        found, frontier = found.unionByName(new), new


def timeline(cases: DataFrame, edges: DataFrame, start: str) -> DataFrame:
    """cases(case_id, decided) -> case_id, decided, kind of the dated members of start's chain.

    Kind by outgoing edges inside the chain: REVERSES, then AFFIRMS, then APPEAL_OF; else DECISION.
    """
    members = chain(edges, start)
    out = edges.join(members.withColumnRenamed("case_id", "src"), "src", "left_semi").join(members.withColumnRenamed("case_id", "dst"), "dst", "left_semi")
    rank = F.when(F.col("type") == "REVERSES", 3).when(F.col("type") == "AFFIRMS", 2).when(F.col("type") == "APPEAL_OF", 1).otherwise(0)
    kinds = out.groupBy(F.col("src").alias("case_id")).agg(F.max(rank).alias("r"))
    kind = F.element_at(F.array(*map(F.lit, ("DECISION", "APPEAL", "AFFIRMATION", "REVERSAL"))), F.coalesce("r", F.lit(0)) + 1)
    return members.join(cases, "case_id").filter("decided IS NOT NULL").join(kinds, "case_id", "left").select("case_id", "decided", kind.alias("kind"))

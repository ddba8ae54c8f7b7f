"""Groups of sets too large to compare in one task, dealt into smaller keys without losing a link.

What most of a group's members share tells nothing about which of them are
linked. A group's consensus is the shingles that more than half of its members
have; D(u) is where u departs from it. Sets u and v differ by
|D(u)| + |D(v)| - 2 |D(u) & D(v)|, so a bound on their difference is a least
number of common departures, and members meet again only under the first
departures of each, rare ones first. At most half of the members share a
departure, so a round at least halves a key. Rows grow with the members.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, shuffle_partitions, small_batches

SKETCH_LOG2, CHUNK = 22, 4096
#: Partners that a centre's set is sent out for at a time.
PAIR_GROUP = 256


def _slots(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a shingle is counted in each of the two tables."""
    mask = np.uint64((1 << SKETCH_LOG2) - 1)
    return (hashes & mask).astype(np.int64), ((hashes >> np.uint64(64 - SKETCH_LOG2)) & mask).astype(np.int64)


def sketch(rows: DataFrame, sets: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]]) -> list[np.ndarray]:
    """The binary logarithm of how many sets fall into each slot, for two tables. sets reads the shingles of each row."""
    cells = 1 << SKETCH_LOG2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = np.zeros((2, cells), np.uint32)
        held, n = [], 0

        def add() -> None:
            if held:
                for table, at in zip(tables, _slots(np.concatenate(held)), strict=True):
                    table += np.bincount(at, minlength=cells).astype(np.uint32)
                held.clear()

        for shingles in sets(batches):
            held.append(shingles)
            n += len(shingles)
            if n > cells:
                add()
                n = 0
        add()
        for t, table in enumerate(tables):
            for chunk in np.flatnonzero(table.reshape(-1, CHUNK).any(1)):
                counts = table[chunk * CHUNK : (chunk + 1) * CHUNK]
                yield pa.RecordBatch.from_arrays([pa.array([t * cells // CHUNK + chunk], pa.int32()), pa.array([zstandard.compress(counts.tobytes(), 1)], pa.binary())], ["chunk", "counts"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column("chunk").to_pylist(), batch.column("counts"), strict=True):
                sums[chunk] = sums.get(chunk, 0) + np.frombuffer(zstandard.decompress(counts.as_buffer()), np.uint32).astype(np.int64)
        levels = [np.frexp(x.astype(np.float64))[1].astype(np.uint8).tobytes() for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(levels, pa.binary())], ["chunk", "levels"])

    with small_batches(rows.sparkSession):
        parts = rows.mapInArrow(run, "chunk int, counts binary").repartition(shuffle_partitions(rows.sparkSession), "chunk")
        found = parts.mapInArrow(added, "chunk int, levels binary").collect()
    out = np.zeros(2 * cells, np.uint8)
    for r in found:
        out[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["levels"], np.uint8)
    return [out[:cells], out[cells:]]


def _levels(hashes: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    a, b = _slots(hashes)
    return np.minimum(tables[0][a], tables[1][b])


def _stored(hashes: Iterable[bytes]) -> Iterator[np.ndarray]:
    return (np.frombuffer(h, np.uint64) for h in hashes)


def _with_centre(pairs: DataFrame, heads: DataFrame | None, sets: DataFrame | Callable[[DataFrame], DataFrame], found, schema: str, read=_stored) -> DataFrame:
    """pairs(a, b), heads(a, hashes), sets(id, hashes) -> the rows that found(a, set of a, b, set of b) gives. A head goes once to each group of its partners.

    Without heads, sets is a function that sends the set of each node to its places(node, x, y, z), in a form that read understands."""
    degree = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PAIR_GROUP).alias("groups"))
    spread = pairs.join(degree, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("groups")).alias("grp"))
    if heads is None:
        places = spread.select(F.col("b").alias("node"), F.col("a").alias("x"), F.col("grp").alias("y"), F.col("b").alias("z"))
        own = degree.select(F.col("a").alias("node"), F.col("a").alias("x"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("y"), F.lit(-1).cast("long").alias("z"))
        return _at_centre(sets(places.unionByName(own)).toDF("a", "grp", "b", "hashes"), found, schema, read)
    first = degree.join(heads, "a").select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("grp"), F.lit(-1).cast("long").alias("b"), "hashes")
    return _at_centre(spread.join(sets.withColumnRenamed("id", "b"), "b").select("a", "grp", "b", "hashes").unionByName(first), found, schema, read)


def _at_centre(rows: DataFrame, found, schema: str, read) -> DataFrame:
    """rows(a, grp, b, hashes): the partners of a in groups, each group with the set of a itself, where b is -1; read: hashes -> sets -> the rows that found gives."""
    parts = rows.repartition(shuffle_partitions(rows.sparkSession), "a", "grp").sortWithinPartitions("a", "grp", "b")  # ids are not negative: heads come first

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head, mine = None, None
        for pdf in batches:
            out: list[tuple] = []
            for a, b, h in zip(pdf["a"], pdf["b"], read(pdf["hashes"]), strict=True):
                if b < 0:
                    head, mine = a, h
                elif a != head:
                    raise ValueError(f"the set of {a} is missing")
                else:
                    out += found(a, mine, b, h)
            yield pd.DataFrame(out, columns=[f.split()[0] for f in schema.split(", ")])

    return parts.mapInPandas(run, schema)


def consensus(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """groups(grp, id), sets(id, hashes) -> grp, hashes: those that more than half of its members have, the most common first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of: dict[int, list[np.ndarray]] = {}
            for grp, hashes in zip(batch.column("grp").to_pylist(), batch.column("hashes"), strict=True):
                of.setdefault(grp, []).append(np.frombuffer(hashes.as_buffer(), np.int64))
            for grp, held in of.items():
                shingles, n = np.unique(np.concatenate(held), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), grp, np.int64)), pa.array(shingles), pa.array(n.astype(np.int64))], ["grp", "shingle", "n"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [np.array(x, np.int64).tobytes() for x in batch.column("shingles").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("grp"), pa.array(hashes, pa.binary())], ["grp", "hashes"])

    sizes = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("m"))
    counted = groups.join(sets, "id").select("grp", "hashes").mapInArrow(run, "grp long, shingle long, n long").groupBy("grp", "shingle").agg(F.sum("n").alias("n"))
    common = counted.join(sizes, "grp").filter("2 * n > m").groupBy("grp").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("less"), "shingle"))).alias("common"))
    # A group with no consensus departs from nothing: its members' whole sets are compared.
    return sizes.join(common, "grp", "left").select("grp", F.coalesce(F.col("common.shingle"), F.array().cast("array<long>")).alias("shingles")).mapInArrow(packed, "grp long, hashes binary")


def _departures(tables):
    """Where a member departs from the consensus, in an order that all members of the group share: what only it and few others have, rare ones first; then what it lacks of the least common part on."""

    def found(grp: int, common: np.ndarray, b: int, h: np.ndarray) -> list[tuple]:
        added = np.setdiff1d(h, common)
        added = added[np.argsort(_levels(added, tables.value), kind="stable")]
        gone = common[::-1][~np.isin(common[::-1], h)]
        return [(grp, b, len(h), [int(x) for x in np.concatenate([added, gone]).view(np.int64)])]

    return found


def dealt_anew(departures: DataFrame, percent: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """departures(grp, id, n, away) -> links (a, b) that are certain, and (key, id): any two members of a group that
    are linked, but not both with the one nearest to the consensus, have a key in common.

    s = |D| - d n with d = (100 - percent) / (100 + percent), here times 100 + percent. Linked sets differ by
    d (n + n') at most, so they have at least (s + s') / 2 departures in common, and with s + s' <= 0 they are linked
    for certain. Let s0 be the smallest. Members with s <= -s0 are linked with its owner; their partners have more.
    """
    up, down = 100 + percent, 100 - percent
    scored = departures.withColumn("s", F.size("away") * F.lit(up).cast("long") - F.col("n") * down)
    first = scratch.written(scored.groupBy("grp").agg(F.min(F.struct("s", "id")).alias("first")).select("grp", F.col("first.s").alias("s0"), F.col("first.id").alias("a")), "nearest")
    scored = scored.join(first, "grp")
    links = scored.filter("s + s0 <= 0 AND id <> a").select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b"))
    common = F.when(F.expr("s + s0 > 0"), F.ceil(F.expr(f"(s + s0) / {2 * up}"))).otherwise(F.floor(F.expr(f"(s - s0) / {2 * up}")) + 1)
    length = F.greatest(F.lit(0), F.size("away") - common + 1).cast("int")
    return links, scored.select(F.explode(F.slice("away", F.lit(1), length)).alias("x"), "grp", "id").select(F.xxhash64("grp", "x").alias("key"), "id")


def _hashes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        for hashes in batch.column("hashes"):
            yield np.frombuffer(hashes.as_buffer(), np.uint64)


def one_of_same(keys: DataFrame) -> DataFrame:
    """keys(key, id) -> its rows, without keys of one member; of keys with the same members (as many, and with the same sums of two hashes) one."""
    same = keys.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y")).filter("m > 1")
    return keys.join(same.groupBy("m", "x", "y").agg(F.min("key").alias("key")).select("key"), "key")


def dealt_by_departures(groups: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """groups(grp, id), sets(id, hashes) -> links (a, b) that are certain, and (key, id): linked members of a group
    have a key in common or are joined by the certain links."""
    sent = groups.sparkSession.sparkContext.broadcast(sketch(sets.select("hashes"), _hashes_of))
    heads = scratch.written(consensus(groups, sets), "consensus").withColumnRenamed("grp", "a")
    members = groups.select(F.col("grp").alias("a"), F.col("id").alias("b"))
    away = scratch.written(_with_centre(members, heads, sets, _departures(sent), "grp long, id long, n long, away array<long>"), "departures")
    certain, keys = dealt_anew(away, percent, scratch)
    return scratch.written(certain, "links"), scratch.written(one_of_same(scratch.written(keys.distinct(), "keys")), "keys")

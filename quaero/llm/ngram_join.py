"""N-gram Jaccard join by prefix filters under several global orders of the shingles.

If two sets have a Jaccard similarity of t or more, then under any order of all
shingles the first |S| - ceil(t |S|) + 1 shingles of one and of the other have
one in common. ORDERS orders are used at once, all of them with frequent
shingles last (by a count sketch of fixed size over the whole table), each with
its own order among equally frequent ones. Documents meet under the shingles of
their first prefix (and the size class, since sizes of linked sets differ by t
at most); of those, only pairs that have something in common under every other
order too are verified, on their full sets. No filter loses a link.

Groups need no table of pairs. Under a key everyone meets only its centre, the
smallest member; links contract into components. Of keys that still hold two
components after that, the members of a small one (MEET members and
MEET_SHINGLES shingles at most; keys with the same members count once) meet in one task,
which puts out fewer links than it has components. A larger key is dealt out anew by
differences from its consensus, the shingles that more than half of its members have: let
D(u) be where u departs from it. Sets u and v differ by
|D(u)| + |D(v)| - 2 |D(u) & D(v)|, so a bound on their difference is a least
number of common departures. Members for which it is none are linked with the
one nearest to the consensus; for all other pairs it is one or more, which is a prefix
filter again, on the small sets D. At most half of the members share a
departure, so a round at least halves a key, and texts of one template that do
not link soon are apart, however many they are.

Nodes are the distinct sets, so copies make no pairs. Rounds send the texts of what
they verify, compressed, once to the tasks that compare them, and the sets are made there: a set
takes several times the room of its compressed text. Everything grows
with the rows, besides two byte tables of 2 ** SKETCH_LOG2 that are sent to the
tasks. Shingles are compared as 64-bit hashes.

Defined results: null and empty texts have 0 shingles and are their own
component; of rows that repeat a doc_id each has its own text's component; a null doc_id
comes after every other, so it is the component's id only where all are null;
ties need no rule, since a component has one smallest doc_id; an empty table
gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .departures import SKETCH_LOG2, _departures, _levels, _with_centre, consensus, dealt_anew, one_of_same, sketch  # noqa: F401  the width is part of its interface
from .near_dedup import LAST_ID, _sign, _utf8
from .shared import Scratch, connected_components, shuffle_partitions, small_side

ORDERS = 3
#: Members and shingles of a key whose members meet in one task.
MEET, MEET_SHINGLES = 64, 1 << 20


#: Bytes of text whose words are hashed at a time.
HELD = 1 << 20


# ---------------------------------------------------------------- sets


def _rolled(w: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Hashes of words -> a hash of each run of size words."""
    n = max(0, len(w) - size + 1)
    h = np.full(n, seed, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            h = (h ^ w[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h


def _distinct(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def _values(strings: pa.Array) -> list[bytes]:
    """The bytes of strings, none null. Many times as fast as to_pylist."""
    _, ends, data = strings.buffers()
    width = np.int64 if strings.type in (pa.large_string(), pa.large_binary()) else np.int32
    at = np.frombuffer(ends, width)[strings.offset : strings.offset + len(strings) + 1].tolist() if len(strings) else [0]
    held = data.to_pybytes() if data else b""
    return [held[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def text_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sets of a text column one after another, each a sorted array. The words of texts of HELD bytes are told apart at once, so each
    spelling among them is hashed once."""
    import xxhash

    ends, at = np.cumsum(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + HELD, "right")))
        lists = pc.ascii_split_whitespace(pc.ascii_lower(column.slice(at, to - at).fill_null("")))  # A-Z, and [\x20\x09-\x0D]
        words = pc.dictionary_encode(lists.flatten())
        spellings, of = _values(words.dictionary), words.indices.to_numpy()
        real = (pc.binary_length(words.dictionary).to_numpy() > 0)[of]  # space at the start or end of a text splits off an empty word
        w = np.fromiter(map(xxhash.xxh3_64_intdigest, spellings), np.uint64, len(spellings))[of[real]]
        h = _rolled(w, size, 0x2545F4914F6CDD1D)
        first = np.concatenate([[0], np.cumsum(real)])[lists.offsets.to_numpy()].tolist()
        for lo, hi in zip(first[:-1], first[1:], strict=True):
            if hi - lo >= size:
                yield _distinct(h[lo : hi - size + 1])
            else:
                yield _rolled(w[lo:hi], hi - lo, 0x9E6C63D0876A9A47) if hi > lo else w[:0]
        at = to


def packed_sets(size: int) -> Callable[[Iterable[bytes]], Iterator[np.ndarray]]:
    """Reads the sets of compressed texts."""

    def read(packed: Iterable[bytes]) -> Iterator[np.ndarray]:
        z, held, n = zstandard.ZstdDecompressor(), [], 0
        for x in packed:
            held.append(z.decompress(x))
            n += len(held[-1])
            if n > HELD:
                yield from text_sets(pa.array(held, pa.binary()).view(pa.string()), size)
                held, n = [], 0
        yield from text_sets(pa.array(held, pa.binary()).view(pa.string()), size)

    return read


# ---------------------------------------------------------------- orders


def _mixed(hashes: np.ndarray, order: int) -> np.ndarray:
    """A bijection of 64-bit numbers for each order."""
    with np.errstate(over="ignore"):
        h = (hashes ^ np.uint64(0xA0761D6478BD642F * (order + 1) & (1 << 64) - 1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
        return h * np.uint64(0xBF58476D1CE4E5B9)


def prefix_length(n: int, percent: int) -> int:
    return n + percent * -n // 100 + 1


def prefixes(hashes: np.ndarray, tables: list[np.ndarray], percent: int) -> list[np.ndarray]:
    """The prefix under each order, as mixed hashes. Shingles that tie with its last one are in it too, so it never lacks one."""
    n = prefix_length(len(hashes), percent)
    levels, out = _levels(hashes, tables).astype(np.uint64) << np.uint64(56), []
    for order in range(ORDERS):
        mixed = _mixed(hashes, order)
        place = levels | mixed >> np.uint64(8)
        out.append(mixed[place <= np.partition(place, n - 1)[n - 1]])
    return out


# ---------------------------------------------------------------- stages


def signed_sets(docs: DataFrame, size: int, percent: int, tables: list[np.ndarray], smallest: int) -> DataFrame:
    """docs(row, id, sign, text) -> row, id, sign, n_shingles, set_id, p0, p1, ...: the prefixes, for sets that another can be linked with."""
    sent = docs.sparkSession.sparkContext.broadcast(tables)
    names = [f"p{k}" for k in range(ORDERS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            n, ids, found = [], [], []
            for h in text_sets(batch.column("text"), size):
                n.append(len(h))
                ids.append(xxhash.xxh3_128_digest(h.tobytes()))
                found.append(prefixes(h, sent.value, percent) if len(h) >= smallest else [None] * ORDERS)
            columns = [*(batch.column(c) for c in ("row", "id", "sign")), pa.array(n, pa.int64()), pa.array(ids, pa.binary())]
            columns.append(pa.array([f[0] if f[0] is None else f[0].view(np.int64) for f in found], pa.list_(pa.int64())))
            # Under the other orders the upper half is enough: what is equal stays equal.
            columns += [pa.array([f[k] if f[k] is None else (f[k] >> np.uint64(32)).astype(np.uint32).view(np.int32) for f in found], pa.list_(pa.int32())) for k in range(1, ORDERS)]
            yield pa.RecordBatch.from_arrays(columns, ["row", "id", "sign", "n_shingles", "set_id", *names])

    schema = "row long, id long, sign binary, n_shingles long, set_id binary, p0 array<long>, " + ", ".join(f"{p} array<int>" for p in names[1:])
    return docs.select("row", "id", "sign", "text").mapInArrow(run, schema)


def _shingles_of(size: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            yield from text_sets(batch.column("text"), size)

    return read


def full_sets(texts: DataFrame, size: int) -> DataFrame:
    """texts(id, text) -> id, hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # sets are several times their texts
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([h.tobytes() for h in text_sets(part.column("text"), size)], pa.binary())], ["id", "hashes"])

    return texts.select("id", "text").mapInArrow(run, "id long, hashes binary")


#: Bytes of compressed texts that are put out at a time.
DEALT = 1 << 22


def dealt_texts(texts: DataFrame) -> DataFrame:
    """texts(text, places) -> x, y, z, packed: each text, compressed, at each of its places (x, y, z)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, held, n = zstandard.ZstdCompressor(level=1), [], 0

        def out() -> pa.RecordBatch:
            at = [pa.array([place[c] for place, _ in held], pa.int64()) for c in "xyz"]
            return pa.RecordBatch.from_arrays([*at, pa.array([packed for _, packed in held], pa.binary())], ["x", "y", "z", "packed"])

        for batch in batches:
            for text, places in zip(_utf8(batch.column("text")), batch.column("places"), strict=True):
                packed = z.compress(text)
                for place in places.as_py():
                    held.append((place, packed))
                    n += len(packed)
                    if n > DEALT:
                        yield out()
                        held, n = [], 0
        yield out()

    return texts.select("text", "places").mapInArrow(run, "x long, y long, z long, packed binary")


def _linked(percent: int):
    def found(a: int, mine: np.ndarray, b: int, other: np.ndarray) -> list[tuple]:
        both = len(np.intersect1d(mine, other, assume_unique=True))
        return [(a, b)] if 100 * both >= percent * (len(mine) + len(other) - both) else []

    return found


def _among(members: DataFrame, percent: int, read: Callable[[Iterable[bytes]], Iterator[np.ndarray]]) -> DataFrame:
    """members(grp, id, component, packed), read: packed -> sets -> (a, b): links that join all components of a group with a link between them."""
    rows = members.repartition(shuffle_partitions(members.sparkSession), "grp").sortWithinPartitions("grp", "id")

    def links(ids: list[int], roots: list[int], sets: list[np.ndarray]) -> list[tuple]:
        out = []
        for j, h in enumerate(sets):
            for i in range(j):
                least = min(len(h), len(sets[i]))
                if roots[i] == roots[j] or 100 * least < percent * max(len(h), len(sets[i])):
                    continue
                both = len(np.intersect1d(h, sets[i], assume_unique=True))
                if 100 * both >= percent * (len(h) + len(sets[i]) - both):
                    out.append((ids[i], ids[j]))
                    gone, stays = roots[j], roots[i]
                    roots[:] = [stays if r == gone else r for r in roots]
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, ([], [], [])
        for pdf in batches:
            out: list[tuple] = []
            for grp, i, component, h in zip(pdf["grp"], pdf["id"], pdf["component"], read(pdf["packed"]), strict=True):
                if grp != now:
                    out += links(*held)
                    now, held = grp, ([], [], [])
                for column, value in zip(held, (i, component, h), strict=True):
                    column.append(value)
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")
        yield pd.DataFrame(links(*held), columns=["a", "b"], dtype="int64")

    return rows.select("grp", "id", "component", "packed").mapInPandas(run, "a long, b long")


def _with_partner(groups: DataFrame, prefixes: DataFrame, percent: int) -> DataFrame:
    """groups(grp, id, component), prefixes(id, n, p1, ..) -> its rows (grp, id) that have someone of another component in their group whose
    size allows a link and whose prefix meets theirs under every further order. Prefixes are a tenth of the sets."""
    names = [f"p{k}" for k in range(1, ORDERS)]
    rows = groups.join(prefixes.select("id", "n", *names), "id").repartition(shuffle_partitions(groups.sparkSession), "grp").sortWithinPartitions("grp", "id")

    def kept(group: list[tuple]) -> list[tuple]:
        use = set()
        for j, (_, b, cb, nb, *pb) in enumerate(group):
            for _, a, ca, na, *pa_ in group[:j]:
                if ca != cb and 100 * min(na, nb) >= percent * max(na, nb) and not any(x.isdisjoint(y) for x, y in zip(pa_, pb, strict=True)):
                    use |= {a, b}
        return [(group[0][0], i) for i in sorted(use)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        for pdf in batches:
            out: list[tuple] = []
            for grp, i, component, n, *ps in pdf.itertuples(index=False):
                if held and held[0][0] != grp:
                    out += kept(held)
                    held = []
                held.append((grp, i, component, n, *(frozenset(p.tolist()) for p in ps)))
            yield pd.DataFrame(out, columns=["grp", "id"], dtype="int64")
        yield pd.DataFrame(kept(held) if held else [], columns=["grp", "id"], dtype="int64")

    return rows.select("grp", "id", "component", "n", *names).mapInPandas(run, "grp long, id long")


def smallest_linked(percent: int) -> int:
    """Smaller sets can only be linked with equal ones: one element more is too much."""
    return next(n for n in range(1, 101) if 100 * n >= percent * (n + 1)) if percent < 100 else 1 << 62


def ngram_components(docs: DataFrame, size: int = 3, percent: int = 90) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, component_id: one row per row of docs.

    Linked are documents with 100 * intersection >= percent * union of their
    sets of size-word shingles (of the whole text where it has fewer words);
    a component is what links reach, named by its smallest doc_id.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    written = scratch.written
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("id"), _sign(F.col("text")).alias("sign"), "text")
    tables = sketch(docs.select("text"), _shingles_of(size))
    sig = written(signed_sets(rows.withColumn("row", F.monotonically_increasing_id()), size, percent, tables, smallest_linked(percent)), "sets")
    grouped = sig.filter("n_shingles > 0").groupBy("set_id").agg(F.min(F.struct("id", "sign", "row")).alias("first"), F.first("n_shingles").alias("n"))
    # Numbered in the order of their first rows, so the smallest node of a component has its smallest doc_id.
    nodes = written(written(grouped, "nodes").orderBy("first.id", "first.sign", "set_id").withColumn("id", F.monotonically_increasing_id()), "nodes")
    others = [f"p{k}" for k in range(ORDERS)]
    n_nodes = nodes.count()
    first = small_side(nodes.select(F.col("first.row").alias("row"), "id", "n"), n_nodes, 32)
    fit = sig.filter("p0 IS NOT NULL").select("row", *others).join(first, "row").drop("row")
    fit = fit if n_nodes * 32 <= 16 << 20 else written(fit, "prefixes")  # beyond a broadcast, joined once

    # Size classes three times as wide as what linked sizes differ by: the own one, and for a third of the sets the one below.
    cls = lambda n: F.floor(F.log(n) / F.lit(-3 * math.log(percent / 100)) if percent < 100 else n)
    sizes = F.explode(F.sequence(cls(F.ceil(F.col("n") * percent / 100)), cls(F.col("n"))))
    keys = fit.select("id", "n", F.explode("p0").alias("p")).select("id", "p", sizes.alias("cls")).select(F.xxhash64("p", "cls").alias("key"), "id")
    sent = spark.sparkContext.broadcast(tables)
    links = nodes.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    now, n_now = nodes.select("id", F.col("id").alias("component")).limit(0), 0

    def placed(df: DataFrame, column: str, name: str) -> DataFrame:
        """df with the component that a column's node is in now."""
        of = small_side(now.select(F.col("id").alias(column), F.col("component").alias(name)), n_now, 40)
        return df.join(of, column, "left").withColumn(name, F.coalesce(name, column))

    def sets_of(ids: DataFrame) -> DataFrame:
        ids = written(ids.distinct(), "needed")
        n = ids.count()
        of = nodes.join(small_side(ids, n, 16), "id").select(F.col("id").alias("node"), F.col("first.id").alias("id"), F.col("first.sign").alias("sign"))
        texts = rows.join(small_side(of, n, 64), ["id", "sign"]).select(F.col("node").alias("id"), "text")
        sets = written(full_sets(texts, size), "full-sets")
        scratch.drop(ids)
        return sets if sets.count() == n else written(sets.dropDuplicates(["id"]), "full-sets")  # rows that repeat doc_id and text

    repeats = sig.filter("n_shingles > 0").groupBy("id", "sign").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").limit(1).count() > 0

    def dealt(places: DataFrame) -> DataFrame:
        """places(node, x, y, z) -> x, y, z, packed. Texts go from where they are read to where their sets are compared: no table of sets, no join with one."""
        of = written(places.groupBy("node").agg(F.collect_list(F.struct("x", "y", "z")).alias("places")), "places")
        n = of.agg(F.coalesce(F.sum(64 + 24 * F.size("places")), F.lit(0))).first()[0]
        of = nodes.select(F.col("id").alias("node"), F.col("first.id").alias("id"), F.col("first.sign").alias("sign")).join(small_side(of, n, 1), "node")
        texts = rows.join(small_side(of, n, 1), ["id", "sign"]).select("node", "text", "places")
        return dealt_texts(texts.dropDuplicates(["node"]) if repeats else texts)

    def contracted(found: DataFrame) -> None:
        nonlocal links, now, n_now
        if found.limit(1).count():
            links = written(links.unionByName(found), "links")
            now = connected_components(links, scratch)
            n_now = now.count()

    side = lambda x: fit.select(F.col("id").alias(x), *[F.col(p).alias(f"{p}{x}") for p in others[1:]])
    of_key = Window.partitionBy("key")  # keys are read and moved once, so no table of them
    members = written(keys.select("key", "id", F.min("id").over(of_key).alias("a"), F.count(F.lit(1)).over(of_key).alias("m")).filter("m > 1"), "members")
    pairs = members.filter("id <> a").select("a", F.col("id").alias("b")).distinct()
    n_of = lambda x: small_side(nodes.select(F.col("id").alias(x), F.col("n").alias(f"n{x}")), n_nodes, 24)
    pairs = pairs.join(n_of("a"), "a").join(n_of("b"), "b").filter(f"100 * least(na, nb) >= {percent} * greatest(na, nb)").select("a", "b")
    pairs = written(pairs, "pairs")
    near = pairs.join(side("a"), "a").join(side("b"), "b")
    for p in others[1:]:
        near = near.filter(F.arrays_overlap(f"{p}a", f"{p}b"))
    near = written(near.select("a", "b"), "candidates")
    if near.limit(1).count():
        contracted(written(_with_centre(near, None, dealt, _linked(percent), "a long, b long", packed_sets(size)), "links"))
    # Centres are done; what is left of the keys of one centre is one group if large.
    done = [members, pairs, near]
    members = members.filter("m > 2 AND id <> a").select("key", "id", F.col("a").alias("grp"))
    while True:
        several = placed(members, "id", "component").groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi")
        apart = written(members.join(several.select("key"), "key", "left_semi").join(nodes.select("id", "n"), "id"), "apart")
        large = apart.groupBy("key").agg(F.sum("n").alias("shingles"), F.count(F.lit(1)).alias("m")).filter((F.col("m") > MEET) | (F.col("shingles") > MEET_SHINGLES))
        large = written(large.select("key"), "large")
        lists = apart.join(large, "key", "left_anti").groupBy("key").agg(F.sort_array(F.collect_list("id")).alias("ids")).select("ids").distinct()
        groups = written(lists.withColumn("grp", F.monotonically_increasing_id()).select("grp", F.explode("ids").alias("id")), "groups")
        scratch.drop(*done)
        if m := groups.count():
            lists, groups = groups, written(_with_partner(small_side(placed(groups, "id", "component"), m, 48), fit, percent), "partners")
            scratch.drop(lists)
            places = placed(groups, "id", "component").select(F.col("id").alias("node"), F.col("grp").alias("x"), F.col("id").alias("y"), F.col("component").alias("z"))
            contracted(written(_among(dealt(places).toDF("grp", "id", "component", "packed"), percent, packed_sets(size)), "links"))
        rest = written(apart.join(large, "key", "left_semi").select("grp", "id").distinct(), "rest")
        scratch.drop(apart, large, groups)
        if not rest.limit(1).count():
            break
        sets = sets_of(rest.select("id"))
        heads = written(consensus(rest, sets), "consensus").withColumnRenamed("grp", "a")
        away = _with_centre(rest.select(F.col("grp").alias("a"), F.col("id").alias("b")), heads, sets, _departures(sent), "grp long, id long, n long, away array<long>")
        away = written(away, "departures")
        certain, keys = dealt_anew(away, percent, scratch)
        contracted(written(certain, "links"))
        keys = written(keys.distinct(), "keys")
        scratch.drop(sets, away)
        members = written(one_of_same(keys).select("key", "id", F.col("key").alias("grp")), "members")
        done = [rest, keys, members]
    where = nodes.select("set_id", F.col("id")).join(now, "id", "left").select("set_id", F.coalesce("component", "id").alias("node"))
    where = written(where.join(nodes.select(F.col("id").alias("node"), F.col("first.id").alias("component")), "node").select("set_id", "component"), "components")
    scratch.keep(sig, where)
    named = lambda c: F.when(F.col(c) != LAST_ID, F.col(c))
    linked = sig.filter("n_shingles > 0").select("id", "n_shingles", "set_id").join(where, "set_id")
    alone = sig.filter("n_shingles = 0").withColumn("component", F.col("id"))
    columns = [named("id").alias("doc_id"), "n_shingles", named("component").alias("component_id")]
    return linked.select(*columns).unionByName(alone.select(*columns))

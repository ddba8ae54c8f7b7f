"""Near-duplicate detection with HyperMinHash signatures.

Signature: a set's 64-bit shingle hashes fall into 128 buckets by their first
bits; a bucket's register holds the leading-zero count and the next ten bits
(mantissa) of its smallest hash, 16 bits in all.

Candidates: registers are banded. Documents meet in size classes (similarity
bounds the ratio of set sizes). In a class of large sets, 25 bands of five
registers each: sets at similarity 0.85 share none with probability
(1 - 0.85 ** 5) ** 25 < 1e-6, at 0.8 below 1e-4. In a class of small sets there
is one band more than elements that linked sets can differ in, so that by the
pigeonhole principle a band always agrees.

Estimates: registers that agree, less the collisions expected of registers of
this precision, over the registers in use; pairs clearly below the threshold
are turned away. What is left is confirmed on the full sets, computed from the
texts. Equal sets are one node from the start, so copies make no pairs.

Buckets need no cap. First everyone in a bucket meets only its smallest member,
and links contract into components. In a bucket that still holds several,
members meet in blocks of bounded size inside a task. A component that fills
blocks has them to itself, and its blocks never meet one another, so n near
copies and the s others of a bucket that fit one block send about 2 * n rows. Larger
buckets, those with more than a block of members outside their largest component, are
dealt anew first: buckets with common members form a group, and its members meet again
only where they depart from what most of the group has in common (departures.py),
exactly, on full sets, until every key is small. Texts of one template that
do not link share hardly any departures, so they are apart after one round.
A meeting puts out a spanning forest: for components that its estimates
connect, one pair less than there are components. Those pairs are confirmed on
full sets and contract. What the estimates still connect across components is
a cluster, dealt anew likewise if it is large, in which every pair that passes the estimate is compared on its full
sets; again a task puts out fewer links than it has components. Nothing is
sampled or cut off, and no table grows with the square of a bucket.

Nodes are the distinct sets, whatever doc_ids their rows have: a doc_id that is
null or repeated joins nothing. It only names the component and orders its rows,
of which the first stays.

Defined results: a document without words has an empty set and is linked with
nothing, not even other empty ones; null text counts as empty; a null doc_id
comes after every other, so a component has a null id only if all its rows do,
and of these the first in order of text is kept; near_components keeps every
row whose doc_id is its component's (so rows that repeat that doc_id all are),
keep_one_of_each exactly one row of each component; an empty table gives an
empty result; extra columns are ignored by near_components and kept, whatever
their names, by keep_one_of_each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .departures import dealt_by_departures
from .shared import Scratch, connected_components, contracted, shuffle_partitions, small_side, unused

BUCKETS_LOG2, MANTISSA = 7, 10
REGISTERS = 1 << BUCKETS_LOG2
BANDS, BAND_ROWS = 25, 5
BLOCK = 512
BLOCK_SHINGLES = 1 << 20
PAIR_GROUP = 256
REMEMBERED_BYTES = 48 << 20
#: Stands for a null doc_id, which comes after every other.
LAST_ID = (1 << 63) - 1

# ---------------------------------------------------------------- sets and registers


class Shingler:
    """Texts (UTF-8) -> sorted arrays of distinct 64-bit shingle hashes. Made anew for each task, so that nothing outlives it."""

    def __init__(self, size: int):
        import xxhash

        self.size, self.hash = size, xxhash.xxh3_64_intdigest
        self.memo: dict[bytes, int] = {}
        self.held = 0

    def words(self, text: bytes | None) -> np.ndarray:
        words = (text or b"").lower().split()  # bytes: lower-cases A-Z and splits at [\x20\x09-\x0D] only
        memo, new = self.memo, self.hash
        if self.held > REMEMBERED_BYTES:
            memo.clear()
            self.held = 0
        found = list(map(memo.get, words))
        if None in found:
            for i, h in enumerate(found):
                if h is None:
                    w = words[i]
                    h = memo.get(w)
                    if h is None:
                        h = new(w)
                        if len(w) <= 256:
                            memo[w] = h
                            self.held += len(w) + 170
                    found[i] = h
        return np.array(found, np.uint64)

    def shingles(self, text: bytes | None) -> np.ndarray:
        w = self.words(text)
        if not len(w):
            return w
        n = max(1, len(w) - self.size + 1)
        h = np.full(n, 0x2545F4914F6CDD1D if len(w) >= self.size else 0x9E6C63D0876A9A47, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(min(self.size, len(w))):
                h = (h ^ w[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
        return np.unique(h)


def _utf8(column: pa.Array) -> Iterator[bytes | None]:
    """The bytes of a text column one after another, so that only one text is copied at a time."""
    for value in column:
        yield value.as_buffer().to_pybytes() if value.is_valid else None


def registers(hashes: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes -> HyperMinHash registers; 0 is an empty bucket."""
    out = np.zeros(REGISTERS, np.uint16)
    if not len(hashes):
        return out
    bucket = (hashes >> np.uint64(64 - BUCKETS_LOG2)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])  # sorted: a bucket's first hash is its smallest
    rest = hashes[first] & np.uint64((1 << (64 - BUCKETS_LOG2)) - 1)
    width = 64 - BUCKETS_LOG2
    top = np.maximum(np.frexp(rest.astype(np.float64))[1], 0)  # bits in use; rounding up to a power of two is as good
    zeros = np.minimum(width - np.minimum(top, width), 62)
    shift = np.maximum(width - zeros - 1 - MANTISSA, 0).astype(np.uint64)
    mantissa = (rest >> shift) & np.uint64((1 << MANTISSA) - 1)
    out[bucket[first]] = ((zeros + 1).astype(np.uint64) << np.uint64(MANTISSA) | mantissa).astype(np.uint16)
    return out


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Register rows of pairs -> collision-corrected Jaccard estimates and registers in use."""
    used = ((a > 0) | (b > 0)).sum(-1)
    same = ((a == b) & (a > 0)).sum(-1)
    ratio = np.maximum(na, nb) / np.maximum(1, np.minimum(na, nb))
    # Expected chance agreements of registers, as published for this sketch: 0.1699 * 2^(p-r) * 4(n/m) / (1+n/m)^2.
    chance = 0.169919487159739 * 2.0 ** (BUCKETS_LOG2 - MANTISSA) * 4 * ratio / (1 + ratio) ** 2 * used / REGISTERS
    return np.clip((same - chance) / np.maximum(used, 1), 0, 1), used


def may_link(est: np.ndarray, used: np.ndarray, t: float) -> np.ndarray:
    """Six standard errors below the threshold are not yet below it."""
    return est >= t - 6 * np.sqrt(t * (1 - t) / np.maximum(used, 1)) - 1e-9


# ---------------------------------------------------------------- size classes and bands


@lru_cache(maxsize=1 << 16)
def classes_of(n: int, t: float) -> tuple[int, ...]:
    """The class of n itself, then those of the smaller sets that n can be linked with."""
    own = class_of(n, t)
    least = max(1, math.ceil(t * n - 1e-9))
    return tuple(range(class_of(least, t), own + 1))


def class_of(n: int, t: float) -> int:
    return int(math.log(n) / -math.log(t) + 1e-9)


@lru_cache(maxsize=4096)
def bands_of(c: int, t: float) -> tuple[tuple[int, int], ...]:
    """(first, end) registers of a class's bands. The smaller set of a pair is in the class."""
    most = math.ceil(t ** -(c + 1))
    differ = math.floor((1 - t) / (1 + t) * (most + math.floor(most / t)) + 1e-9)
    n = differ + 1
    if n > BANDS:
        return tuple((i * BAND_ROWS, (i + 1) * BAND_ROWS) for i in range(BANDS))
    cuts = [round(i * REGISTERS / n) for i in range(n + 1)]
    return tuple(zip(cuts, cuts[1:]))


def band_keys(n: int, regs: np.ndarray, t: float) -> list[int]:
    import xxhash

    out = []
    raw = regs.tobytes()
    for c in classes_of(n, t):
        for i, (a, b) in enumerate(bands_of(c, t)):
            out.append(xxhash.xxh3_64_intdigest(raw[2 * a : 2 * b], seed=c * 1009 + i) - (1 << 63))
    return out


# ---------------------------------------------------------------- stages


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """docs(row, id, sign, text) -> row, id, sign, n_shingles, set_id, regs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        sh = Shingler(size)
        for batch in batches:
            n, ids, regs = [], [], []
            for text in _utf8(batch.column("text")):
                h = sh.shingles(text)
                n.append(len(h))
                ids.append(xxhash.xxh3_128_digest(h.tobytes()))
                regs.append(registers(h).tobytes())
            columns = [*(batch.column(c) for c in ("row", "id", "sign")), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(regs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["row", "id", "sign", "n_shingles", "set_id", "regs"])

    return docs.select("row", "id", "sign", "text").mapInArrow(run, "row long, id long, sign binary, n_shingles long, set_id binary, regs binary")


def banded(nodes: DataFrame, t: float) -> DataFrame:
    """nodes(id, n_shingles, regs) -> (key, id), for sets that another set can be linked with."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys = [band_keys(n, np.frombuffer(r, np.uint16), t) for n, r in zip(pdf["n_shingles"], pdf["regs"], strict=True)]
            yield pd.DataFrame({"key": np.array([k for ks in keys for k in ks], np.int64), "id": np.repeat(pdf["id"].to_numpy(), [len(k) for k in keys])})

    return nodes.select("id", "n_shingles", "regs").mapInPandas(run, "key long, id long")


def _passing(pairs: DataFrame, nodes: DataFrame, t: float) -> DataFrame:
    """(a, b) whose estimate does not rule them out."""

    @F.pandas_udf("boolean")
    def passes(ra: pd.Series, rb: pd.Series, na: pd.Series, nb: pd.Series) -> pd.Series:
        if not len(ra):
            return pd.Series([], dtype=bool)
        a, b = (np.frombuffer(b"".join(x), np.uint16).reshape(-1, REGISTERS) for x in (ra, rb))
        na, nb = na.to_numpy(), nb.to_numpy()
        est, used = estimate(a, b, na, nb)
        return pd.Series(may_link(est, used, t) & (np.minimum(na, nb) >= t * np.maximum(na, nb) - 1e-9))

    side = lambda x: nodes.select(F.col("id").alias(x), F.col("regs").alias(f"r{x}"), F.col("n_shingles").alias(f"n{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").filter(passes("ra", "rb", "na", "nb")).select("a", "b")


def _linked(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b) confirmed on full sets. The text of a goes once to each group of its partners."""
    degree = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PAIR_GROUP).alias("groups"))
    spread = pairs.join(degree, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("groups")).alias("grp"))
    heads = degree.join(texts.withColumnRenamed("id", "a"), "a").select(
        "a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("grp"), F.lit(None).cast("long").alias("b"), "text"
    )
    rows = spread.join(texts.withColumnRenamed("id", "b"), "b").select("a", "grp", "b", "text").unionByName(heads)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sh = Shingler(size)
        head, mine = None, None
        for pdf in batches:
            out = []
            for a, b, text in zip(pdf["a"], pdf["b"], pdf["text"], strict=True):
                h = sh.shingles(text.encode())
                if not isinstance(b, str):
                    head, mine = a, h
                    continue
                if a != head:
                    raise ValueError(f"the text of {a} is missing")
                both = len(np.intersect1d(mine, h, assume_unique=True))
                if 100 * both >= percent * (len(mine) + len(h) - both):
                    out.append((a, int(b)))
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    # The head's row comes first: nulls sort first, and ids are kept whole as decimal text.
    keyed = rows.select("a", "grp", F.col("b").cast("string").alias("b"), "text")
    parts = keyed.repartition(shuffle_partitions(pairs.sparkSession), "a", "grp").sortWithinPartitions("a", "grp", F.col("b").asc_nulls_first())
    found = parts.mapInPandas(run, "a long, b long")
    return found


def _tasks(apart: DataFrame, members: DataFrame, weight: Column | float, scratch: Scratch) -> DataFrame:
    """apart(key, id, component), members(id, ...) -> rows of tasks, in which blocks of a bucket meet.

    A bucket's members are cut into blocks of weight 1 or so. A component that
    weighs more has blocks of its own; the others are dealt to blocks by
    hash. Two blocks meet unless both hold one and the same component. side is
    1 for the second of two different blocks.
    """
    if isinstance(weight, float):
        weighed = apart.withColumn("weight", F.lit(weight))
    else:
        weighed = apart.join(members.select("id", weight.alias("weight")), "id")
    parts = weighed.groupBy("key", "component").agg(F.sum("weight").alias("n"))
    light = parts.filter("n <= 1").groupBy("key").agg(F.ceil(F.sum("n")).alias("blocks"))
    # Ids are not negative, so a negative number can name a component's own blocks.
    own = F.when(F.col("n") > 1, -1 - F.col("component")).otherwise(F.pmod(F.xxhash64("component"), F.col("blocks")))
    placed = scratch.written(
        parts.join(light, "key", "left").select("key", "component", "n", own.alias("blk"), F.when(F.col("n") > 1, F.ceil("n")).otherwise(F.lit(1)).alias("subs")),
        "blocks",
    )
    blocks = placed.groupBy("key", "blk").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("subs").alias("subs"))
    l, r = blocks.alias("l"), blocks.alias("r")
    pure = (F.col("l.lo") == F.col("l.hi")) & (F.col("r.lo") == F.col("r.hi")) & (F.col("l.lo") == F.col("r.lo"))
    subs = lambda x: F.sequence(F.lit(0).cast("long"), F.col(f"{x}.subs").cast("long") - 1)
    meet = (
        l.join(r, (F.col("l.key") == F.col("r.key")) & (F.col("l.blk") <= F.col("r.blk")) & ~pure)
        .select(F.col("l.key").alias("key"), F.col("l.blk").alias("x"), F.col("r.blk").alias("y"), subs("l").alias("xs"), subs("r").alias("ys"))
        .withColumn("xsub", F.explode("xs")).withColumn("ysub", F.explode("ys"))
        .select("key", F.struct(F.col("x").alias("blk"), F.col("xsub").alias("sub")).alias("x"), F.struct(F.col("y").alias("blk"), F.col("ysub").alias("sub")).alias("y"))
    )
    meet = scratch.written(meet.withColumn("task", F.xxhash64("key", "x", "y")), "meetings")
    sub = F.pmod(F.xxhash64("id", F.lit(7)), F.col("subs").cast("long"))
    member = apart.join(placed.select("key", "component", "blk", "subs"), ["key", "component"]).select(
        "key", F.struct("blk", sub.alias("sub")).alias("u"), "id", "component"
    ).join(members, "id")
    sent = meet.select("key", "task", F.col("x").alias("u"), F.lit(0).alias("side")).unionByName(
        meet.filter("x <> y").select("key", "task", F.col("y").alias("u"), F.lit(1).alias("side"))
    ).join(member, ["key", "u"])
    return sent.drop("u").repartition(shuffle_partitions(apart.sparkSession), "task").sortWithinPartitions("task")


class _Task:
    """A task's rows as arrays. The right side is the left one where a block meets itself."""

    def __init__(self, pdf: pd.DataFrame):
        self.pdf, self.ids, self.comp, self.n = pdf, *(pdf[c].to_numpy(np.int64) for c in ("id", "component", "n_shingles"))
        self.regs = np.frombuffer(b"".join(pdf["regs"]), np.uint16).reshape(-1, REGISTERS)
        side = pdf["side"].to_numpy()
        self.left, self.right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        self.own = not len(self.right)
        if self.own:
            self.right = self.left

    def candidates(self, i: int, among: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
        """Which of the rows among may be linked with row i, and their estimates."""
        ni, n = self.n[i], self.n[among]
        among = among[np.minimum(ni, n) >= t * np.maximum(ni, n) - 1e-9]
        est, used = estimate(self.regs[i], self.regs[among], ni, self.n[among])
        ok = may_link(est, used, t)
        return among[ok], est[ok]


def _by_task(sent: DataFrame, compare, schema: str) -> DataFrame:
    """Runs compare(_Task) -> rows of schema on every task of sent."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_: list[pd.DataFrame] = []
        for pdf in batches:
            out: list[tuple] = []
            for task, rows in pdf.groupby("task", sort=False):
                if open_ and open_[0]["task"].iat[0] != task:
                    out += compare(_Task(pd.concat(open_)))
                    open_ = []
                open_.append(rows)
            yield pd.DataFrame(out, columns=names, dtype="int64")
        if open_:
            yield pd.DataFrame(compare(_Task(pd.concat(open_))), columns=names, dtype="int64")

    return sent.mapInPandas(run, schema)


def _spanning(weights: np.ndarray) -> list[tuple[int, int]]:
    """Symmetric weights, -1 for none -> the edges of a heaviest spanning forest."""
    n = len(weights)
    done, best, via, out = np.zeros(n, bool), np.full(n, -1.0, np.float32), np.zeros(n, np.int64), []
    for _ in range(n):
        i = int(np.argmax(np.where(done, -2.0, best)))
        if best[i] >= 0:
            out.append((int(via[i]), i))
        done[i] = True
        better = (weights[i] > best) & ~done
        best[better], via[better] = weights[i][better], i
    return out


def _forest(apart: DataFrame, nodes: DataFrame, t: float, scratch: Scratch) -> DataFrame:
    """apart(key, id, component) -> (a, b, ca, cb): in each meeting of blocks, pairs of members a, b of
    components ca, cb that pass the estimate, those with the highest that span what estimates connect."""

    def compare(task: _Task) -> list[tuple]:
        comps, at = np.unique(task.comp, return_inverse=True)
        if len(comps) < 2:
            return []
        n = len(task.ids)
        weights = np.full((len(comps), len(comps)), -1, np.float32)
        pairs = np.zeros((len(comps), len(comps)), np.int32 if n < 46_000 else np.int64)
        for i in task.left:
            among, est = task.candidates(i, task.right[at[task.right] != at[i]], t)
            if len(among):
                order = np.argsort(est, kind="stable")
                among, est, row = among[order], est[order].astype(np.float32), at[i]
                more = est > weights[row, at[among]]
                col = at[among[more]]
                for cell in ((row, col), (col, row)):  # the last of several is the best
                    weights[cell], pairs[cell] = est[more], i * n + among[more]
        out = []
        for x, y in _spanning(weights):
            i, j = divmod(int(pairs[x, y]), n)
            if task.ids[i] > task.ids[j]:
                i, j = j, i
            out.append((task.ids[i], task.ids[j], task.comp[i], task.comp[j]))
        return out

    members = nodes.select("id", "n_shingles", "regs")
    return _by_task(_tasks(apart, members, 1 / BLOCK, scratch), compare, "a long, b long, ca long, cb long").distinct()


def _open(apart: DataFrame) -> DataFrame:
    """Rows (key, id, component) of keys with more than one component."""
    keys = apart.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("key")
    return apart.join(keys, "key", "left_semi")


def _clusters(maybe: DataFrame, nodes: DataFrame, apart: DataFrame, now: DataFrame, t: float, scratch: Scratch) -> DataFrame:
    """maybe(ca, cb), now(id, component) -> (key, id, component): the members of components that maybe connects, with the
    component that they are in now, once for each size class in which they can be linked."""
    cluster = connected_components(maybe.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct(), scratch)  # many keys hold the same two
    of = apart.select("id", "component").distinct()
    rows = of.join(cluster.select(F.col("id").alias("component"), F.col("component").alias("cluster")), "component").select("id", "cluster")
    rows = rows.join(now, "id", "left").join(nodes.select("id", "n_shingles"), "id").withColumn("component", F.coalesce("component", "id"))
    rank = lambda n: F.floor(F.log(n) / F.lit(-math.log(t)) + 1e-9)
    least = F.greatest(F.lit(1), F.ceil(F.col("n_shingles") * F.lit(t) - 1e-9))
    rows = rows.select("id", "component", "cluster", F.explode(F.sequence(rank(least), rank(F.col("n_shingles")))).alias("cls"))
    return _open(rows.select(F.xxhash64("cluster", "cls").alias("key"), "id", "component"))


def _weight() -> Column:
    """What of a block a full set takes."""
    return F.greatest(F.lit(1 / BLOCK), F.col("n_shingles") / BLOCK_SHINGLES)


def _links_in_blocks(apart: DataFrame, members: DataFrame, t: float, percent: int, scratch: Scratch) -> DataFrame:
    """apart(key, id, component), members(id, n_shingles, regs, hashes) -> (a, b): links that join all
    components with a link between them under a key. Every pair that the estimate lets pass is
    compared on its full sets inside a task; what the task's earlier links already join is not
    compared again, so a task puts out fewer links than it has components, however many pairs there are.
    """

    def compare(task: _Task) -> list[tuple]:
        sets = [np.frombuffer(h, np.uint64) for h in task.pdf["hashes"]]
        # Only hashes that two rows have can be in an intersection.
        names, at, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(sets)), [len(h) for h in sets])
        use = often[at] > 1
        at, owner = at[use], owner[use]
        ends = np.r_[0, np.cumsum(np.bincount(owner, minlength=len(sets)))]
        mark = np.zeros(len(names), np.int64)
        root, out = task.comp.copy(), []
        for i in task.left:
            among = task.right[root[task.right] != root[i]]
            among, _ = task.candidates(i, among[among > i] if task.own else among, t)
            if not len(among):
                continue
            mark[at[ends[i] : ends[i + 1]]] = 1
            for j in among:
                if root[j] == root[i]:
                    continue
                both = int(mark[at[ends[j] : ends[j + 1]]].sum())
                if 100 * both >= percent * (task.n[i] + task.n[j] - both):
                    out.append((min(task.ids[i], task.ids[j]), max(task.ids[i], task.ids[j])))
                    root[root == root[j]] = root[i]
            mark[at[ends[i] : ends[i + 1]]] = 0
        return out

    return _by_task(_tasks(apart, members, _weight(), scratch), compare, "a long, b long").distinct()


def _sets(texts: DataFrame, size: int) -> DataFrame:
    """texts(id, text) -> id, hashes: the full set of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sh = Shingler(size)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # sets are several times their texts
                part = batch.slice(at, 256)
                sets = pa.array([sh.shingles(x).tobytes() for x in _utf8(part.column("text"))], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("id"), sets], ["id", "hashes"])

    return texts.mapInArrow(run, "id long, hashes binary")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out


def _sign(text: Column) -> Column:
    """Tells the texts of a doc_id apart; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def near_components(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, component_id, kept: one row per row of docs.

    Linked are documents with 100 * intersection >= percent * union of their
    sets of size-word shingles; a component is what links reach, named by its
    smallest doc_id. kept: doc_id = component_id.
    """
    named = lambda c: F.when(F.col(c) != LAST_ID, F.col(c))
    is_first = F.when(F.col("id") != LAST_ID, F.col("id") == F.col("component")).otherwise(F.col("stays"))
    return _placed(docs, size, percent).select(named("id").alias("doc_id"), "n_shingles", named("component").alias("component_id"), is_first.alias("kept"))


def _placed(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """docs(doc_id, text) -> id, sign, n_shingles, component, stays: one row per row of docs, LAST_ID for null; one row of a component stays."""
    t = percent / 100
    scratch = Scratch(docs.sparkSession)
    written = scratch.written
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("id"), _sign(F.col("text")).alias("sign"), "text")
    sig = written(signatures(rows.withColumn("row", F.monotonically_increasing_id()), size), "signatures")
    # One node for each distinct set, with the first of its rows. Sets without words link with nothing.
    grouped = sig.filter("n_shingles > 0").groupBy("set_id").agg(F.min(F.struct("id", "sign", "row")).alias("first"), F.first("n_shingles").alias("n_shingles"), F.first("regs").alias("regs"))
    # Numbered in the order of their first rows, so the smallest node of a component has its smallest doc_id.
    ordered = written(grouped, "sets").orderBy("first.id", "first.sign", "set_id")
    nodes = written(ordered.withColumn("id", F.monotonically_increasing_id()), "nodes")
    # Sets so small that one element more is too much can only be linked with equal ones.
    smallest = next((n for n in range(1, 1000) if math.floor(n / t + 1e-9) > n), 1000)
    fit = nodes.filter(F.col("n_shingles") >= smallest)
    keys = written(banded(fit, t), "bands")
    centres = written(keys.groupBy("key").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("m")).filter("m > 1"), "centres")
    members = written(keys.join(centres, "key"), "members")
    pairs = written(_passing(members.filter("id <> a").select("a", F.col("id").alias("b")).distinct(), nodes, t), "pairs")

    def texts_of(ids: DataFrame) -> DataFrame:
        ids = written(ids.distinct(), "needed")
        n = ids.count()
        of = nodes.join(small_side(ids, n, 16), "id").select(F.col("id").alias("node"), F.col("first.id").alias("id"), F.col("first.sign").alias("sign"))
        texts = written(rows.join(small_side(of, n, 64), ["id", "sign"]).select(F.col("node").alias("id"), "text"), "texts")
        return texts if texts.count() == n else texts.dropDuplicates(["id"])  # rows that repeat both doc_id and text

    def confirmed(pairs: DataFrame) -> DataFrame:
        ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))
        return _linked(pairs, texts_of(ids), size, percent)

    several = members.filter("m > 2").select("key", "id")

    def components(links: DataFrame) -> DataFrame:
        return connected_components(links, scratch) if links.limit(1).count() else nodes.select("id", F.col("id").alias("component")).limit(0)

    now = components(written(confirmed(pairs), "links"))

    def contract(found: DataFrame) -> None:
        nonlocal now
        if found.limit(1).count():
            now = contracted(now, found, scratch)

    def open_keys(keys: DataFrame) -> DataFrame:
        """keys(key, id) that hold several components, with these."""
        return written(_open(written(keys.join(now, "id", "left").withColumn("component", F.coalesce("component", "id")), "apart")), "apart")

    def dealt(apart: DataFrame, weight: Column) -> DataFrame:
        """apart(key, id, component), but keys whose members outside their largest component weigh more than a block are dealt anew."""
        small, sets = [], None
        while True:
            parts = apart.join(nodes.select("id", weight.alias("weight")), "id").groupBy("key", "component").agg(F.sum("weight").alias("n"))
            large = written(parts.groupBy("key").agg((F.sum("n") - F.max("n")).alias("others")).filter("others > 1").select("key"), "large")
            if not large.limit(1).count():
                return written(_union([*small, apart]), "apart") if small else apart
            small.append(apart.join(large, "key", "left_anti"))
            rest = apart.join(large, "key", "left_semi").select("key", "id")
            if sets is None:  # a template fills many buckets with nearly the same members: they are one group
                meet = rest.join(rest.groupBy("key").agg(F.min("id").alias("a")), "key").select("a", F.col("id").alias("b")).distinct()
                groups = connected_components(meet, scratch).select(F.col("component").alias("grp"), "id")
                sets = written(_sets(texts_of(groups.select("id")), size), "full-sets")
            else:
                groups = rest.withColumnRenamed("key", "grp")
            certain, keys = dealt_by_departures(written(groups, "groups"), sets, percent, scratch)
            contract(certain)
            apart = open_keys(keys)

    apart = dealt(open_keys(several), F.lit(1 / BLOCK))
    maybe = written(_forest(apart, nodes, t, scratch), "maybe") if apart.limit(1).count() else None
    if maybe and maybe.limit(1).count():
        contract(written(confirmed(maybe.select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti")), "links"))
        apart = dealt(written(_clusters(maybe, nodes, apart, now, t, scratch), "clusters"), _weight())
        if apart.limit(1).count():
            sets = _sets(texts_of(apart.select("id")), size)
            full = written(nodes.select("id", "n_shingles", "regs").join(sets, "id"), "sets")
            contract(written(_links_in_blocks(apart, full, t, percent, scratch), "links"))
    where = nodes.select("set_id", "id").join(now, "id", "left").select("set_id", F.coalesce("component", "id").alias("node"))
    first = nodes.select(F.col("id").alias("node"), F.col("first.id").alias("component"), F.col("first.row").alias("first_row"))
    where = written(where.join(first, "node").select("set_id", "component", "first_row"), "components")
    scratch.keep(sig, where)
    columns = ["id", "sign", "n_shingles", "component", "stays"]
    linked = sig.filter("n_shingles > 0").select("row", "id", "sign", "n_shingles", "set_id").join(where, "set_id").withColumn("stays", F.col("row") == F.col("first_row"))
    alone = sig.filter("n_shingles = 0").withColumn("component", F.col("id")).withColumn("stays", F.lit(True))
    return linked.select(*columns).unionByName(alone.select(*columns))


def keep_one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stay when one row of each component does, with their columns.

    A row is found again by its doc_id and text. The few that go are joined
    against all rows, so as long as they fit a broadcast of checked size no
    text is moved, and beyond it each is moved once.
    """
    scratch = Scratch(docs.sparkSession)
    the_id, the_sign, n_rows = unused(docs, "id", "sign", "n")
    placed = _placed(docs.select("doc_id", "text"), size, percent)
    keys = placed.groupBy(F.col("id").alias(the_id), F.col("sign").alias(the_sign)).agg(F.count(F.lit(1)).alias(n_rows), F.count_if("stays").alias("n_stay"))
    changed = scratch.written(keys.filter(F.col("n_stay") < F.col(n_rows)), "changed")
    n, n_some = changed.count(), changed.filter("n_stay > 0").count()
    signed = docs.withColumns({the_id: F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)), the_sign: _sign(F.col("text"))})
    out = signed.join(small_side(changed.select(the_id, the_sign), n, 72), [the_id, the_sign], "left_anti")
    if n_some:  # rows that repeat both doc_id and text
        some = changed.filter("n_stay > 0").select(the_id, the_sign)
        out = out.unionByName(signed.join(small_side(some, n_some, 72), [the_id, the_sign], "left_semi").dropDuplicates([the_id, the_sign]))
    return out.select(*docs.columns)

"""Vector code compression: codebooks of at most 256 entries for each quarter of a vector.

Components become the integers floor(1024 * x); all sums, distances and means
are integers and exact. The nearest entry of a part is found by annular norm
pruning: a codebook's entries lie in order of their norms, an entry can be
nearer than the best distance d so far only if its norm is within d of the
part's norm, and a binary search gives that interval. Its ends count as inside,
so that an equally near entry of a lower index is never lost. Parts are handled
in order of their norms, some at a time, so neighbours share an annulus: the
entries around their norms are evaluated first, then the ring on both sides of
them, twice as wide each time, until nothing that the best distances allow is
left. Everything evaluated is an exact squared distance.

A round of training is one pass over the vectors: a task puts out for each
entry that it used the number and the sum of its parts, Spark adds them up, and
at most 4 * 256 sums reach the driver, whatever the size of the table. The same
bound holds for the codebooks that go to the tasks. Vectors are written once as
packed integers; the last pass writes codes and errors, and errors are summed
by label before one join brings the sums back, so a hot label is no hot key.

Defined results: rows whose vector is null or holds null or non-finite
components (or such that 1024 * x is none) are dropped, all others give one row
each, repeated rows too. The start is taken in order of vec_id (null last), then
of the components, so rows that repeat a vec_id are each one entry; with fewer
than 256 rows there are fewer entries. Vectors shorter than the longest, rounded
up to a multiple of four, count as filled up with zeros. Equal entries: the
lower index wins. An error that no long holds is null. An empty table gives an
empty result. Columns besides vec_id, embedding and label are ignored.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, small_batches, small_side

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Parts that are handled together, and entries around their norms that are evaluated first.
TOGETHER, FIRST = 128, 8


# ---------------------------------------------------------------- nearest entries


class Codebook:
    """One part's entries, sorted by norm. kind: float64 and int64 hold every 256 * distance + index exactly; object is Python's integers."""

    def __init__(self, entries: list[list[int]], kind: str):
        self.entries, self.kind = entries, kind
        if kind == "object":
            norms = [math.isqrt(sum(x * x for x in e)) for e in entries]
            self.order = sorted(range(len(entries)), key=lambda i: (norms[i], i))
            self.norms = [norms[i] for i in self.order]
        else:
            c = np.array(entries, kind).reshape(len(entries), len(entries[0]) if entries else 0)
            squares = (c * c).sum(1)
            self.order = np.argsort(squares, kind="stable")
            self.sorted, self.squares = c[self.order], squares[self.order]
            self.norms = np.sqrt(self.squares.astype(np.float64))

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of integers -> index of the nearest entry of each, and its squared distance."""
        if self.kind == "object":
            found = [self._nearest_of(list(map(int, p))) for p in parts]
            return np.array([i for i, _ in found], np.int64), np.array([d for _, d in found], object)
        parts = parts.astype(self.kind)
        squares = (parts * parts).sum(1)
        norms = np.sqrt(squares.astype(np.float64))
        by_norm = np.argsort(norms, kind="stable")
        best = np.empty(len(parts), self.kind)
        for at in range(0, len(parts), TOGETHER):
            some = by_norm[at : at + TOGETHER]
            best[some] = self._nearest_together(parts[some], squares[some], norms[some])
        best = best.astype(np.int64)
        return best & (ENTRIES - 1), best >> 8

    def _nearest_together(self, parts: np.ndarray, squares: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """256 * distance + index of the nearest entry; the rows are sorted by norm."""

        def evaluated(lo: int, hi: int) -> np.ndarray:
            far = squares[:, None] + self.squares[None, lo:hi] - 2 * (parts @ self.sorted[lo:hi].T)
            return (far * ENTRIES + self.order[lo:hi].astype(self.kind)).min(1)

        n, step = len(self.norms), FIRST
        lo = min(max(0, int(np.searchsorted(self.norms, norms[0])) - step), n - 1)
        hi = min(n, max(lo + 1, int(np.searchsorted(self.norms, norms[-1], "right")) + step))
        best = evaluated(lo, hi)
        while True:
            reach = np.sqrt((best // ENTRIES).astype(np.float64))
            margin = 1e-9 * (norms + reach + 1)  # what rounding of the roots can lose
            least = int(np.searchsorted(self.norms, (norms - reach - margin).min(), "left"))
            most = int(np.searchsorted(self.norms, (norms + reach + margin).max(), "right"))
            down, up = max(least, lo - step), min(most, hi + step)
            if down >= lo and up <= hi:
                return best
            if down < lo:
                best, lo = np.minimum(best, evaluated(down, lo)), down
            if up > hi:
                best, hi = np.minimum(best, evaluated(hi, up)), up
            step *= 2

    def _nearest_of(self, part: list[int]) -> tuple[int, int]:
        """The same for one part of any size. Whole roots are below the norms by less than one, so the interval is two wider."""
        norm = math.isqrt(sum(x * x for x in part))
        lo = hi = bisect_left(self.norms, norm)
        best, step, n = None, 1, len(self.norms)
        while True:
            reach = None if best is None else math.isqrt(best[0]) + 2
            least, most = (0, n) if reach is None else (bisect_left(self.norms, norm - reach), bisect_right(self.norms, norm + reach))
            down, up = max(least, lo - step), min(most, hi + step)
            if down >= lo and up <= hi:
                return best[1], best[0]
            for at in (*range(down, lo), *range(hi, up)):
                i = self.order[at]
                found = (sum((a - b) ** 2 for a, b in zip(part, self.entries[i], strict=True)), i)
                best = found if best is None or found < best else best
            lo, hi, step = min(lo, down), max(hi, up), step * 2


# ---------------------------------------------------------------- vectors


def integers(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding, label) -> vec_id, label, n components, their largest size, ints: the components, packed in 4 or 8 bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("embedding")
            ends = lists.offsets.to_numpy(zero_copy_only=False)
            flat = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)
            with np.errstate(over="ignore", invalid="ignore"):
                flat = np.floor(SCALE * flat)
            bad = np.r_[0, np.cumsum(~np.isfinite(flat))]
            use = np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False) & (bad[ends[1:]] == bad[ends[:-1]]))
            sizes, packed = [], []
            for i in use:
                v = flat[ends[i] : ends[i + 1]]
                sizes.append(float(np.abs(v).max(initial=0)))
                packed.append((v.astype(np.int32) if sizes[-1] < 1 << 31 else v).tobytes())
            rows = pa.array(use)
            columns = [batch.column("vec_id").take(rows), batch.column("label").take(rows)]
            columns += [pa.array((ends[use + 1] - ends[use]).astype(np.int32), pa.int32()), pa.array(sizes, pa.float64()), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "n", "largest", "ints"])

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    return vectors.select("vec_id", "embedding", "label").mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, n int, largest double, ints binary")


def unpacked(ints: pa.Array, counts: pa.Array, width: int, kind: str) -> np.ndarray:
    """Rows of width integers, filled up with zeros."""
    raw, n = ints.to_pylist(), counts.to_pylist()
    if kind != "object" and all(len(v) == 4 * width for v in raw):
        return np.frombuffer(b"".join(raw), np.int32).reshape(len(raw), width).astype(np.int64)
    out = np.zeros((len(raw), width), object if kind == "object" else np.int64)
    for i, v in enumerate(raw):
        got = np.frombuffer(v, np.float64 if len(v) == 8 * n[i] else np.int32)
        out[i, : n[i]] = [int(x) for x in got] if kind == "object" else got
    return out


def _kind(width: int, largest: float) -> str:
    """What holds 256 * (squared distance of two parts) + index without rounding."""
    worst = (width // PARTS) * (2 * largest + 2) ** 2 * ENTRIES + ENTRIES
    return "float64" if worst < 1 << 52 else "int64" if worst < 1 << 61 else "object"


def _limbs(x: int) -> list[int]:
    """x as signed digits of 48 bits, the lowest first."""
    sign, x, out = (-1 if x < 0 else 1), abs(x), []
    while x:
        out.append(sign * (x & ((1 << 48) - 1)))
        x >>= 48
    return out


def _trained(table: DataFrame, books: list[list[list[int]]], width: int, kind: str) -> list[list[list[int]]]:
    """One round: every part to its nearest entry, then every used entry to the floor of its parts' mean."""
    size = width // PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codebooks = [Codebook(b, kind) for b in books]
        counts = np.zeros((PARTS, ENTRIES), np.int64)
        sums = np.zeros((PARTS, ENTRIES, size), object if kind == "object" else np.int64)
        for batch in batches:
            rows = unpacked(batch.column("ints"), batch.column("n"), width, kind)
            for p, book in enumerate(codebooks):
                part = rows[:, p * size : (p + 1) * size]
                at = book.nearest(part)[0]
                counts[p] += np.bincount(at, minlength=ENTRIES)
                np.add.at(sums[p], at, part)
        out = []
        for p, e in np.argwhere(counts):
            digits = [_limbs(int(x)) for x in sums[p, e]]
            for limb in range(max(1, *map(len, digits), 1)):
                out.append((p, e, limb, counts[p, e], [d[limb] if limb < len(d) else 0 for d in digits]))
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
        columns = [pa.array([row[i] for row in out], k) for i, k in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "limb", "n", "sums"])

    partial = table.select("n", "ints").mapInArrow(run, "part int, entry int, limb int, n long, sums array<long>")
    added = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(size)]
    out = [[list(e) for e in b] for b in books]
    totals: dict[tuple[int, int], list[int]] = {}
    with small_batches(table.sparkSession):
        for r in partial.groupBy("part", "entry", "limb").agg(F.sum("n").alias("n"), *added).collect():
            total = totals.setdefault((r["part"], r["entry"]), [r["n"], *[0] * size])
            for i in range(size):
                total[i + 1] += int(r[f"s{i}"]) << (48 * r["limb"])
    for (p, e), (n, *sums) in totals.items():
        out[p][e] = [s // n for s in sums]
    return out


def vector_codes(vectors: DataFrame) -> DataFrame:
    """vectors(vec_id, embedding, label) -> vec_id, code, error, label_error, codebooks_sha256."""
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    table = scratch.written(integers(vectors), "vectors")
    longest, largest, rows = table.agg(F.max("n"), F.max("largest"), F.count(F.lit(1))).first()
    width = -(-(longest or 0) // PARTS) * PARTS
    kind, size = _kind(width, largest or 0), width // PARTS
    first = _first_rows(table, width, kind)
    books = [[row[p * size : (p + 1) * size] for row in first] for p in range(PARTS)]
    if rows:
        for _ in range(ROUNDS):
            books = _trained(table, books, width, kind)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    coded = scratch.written(_coded(table, books, width, kind), "codes")
    total = F.when(F.count("error") == F.count(F.lit(1)), F.try_sum("error"))
    of_label = scratch.written(coded.groupBy(F.col("label").alias("of")).agg(total.alias("total")), "label-errors")
    joined = coded.join(small_side(of_label, of_label.count(), 64), F.col("label").eqNullSafe(F.col("of")))
    scratch.keep(coded, of_label)
    return joined.select(
        "vec_id", "code", F.expr("try_cast(error AS bigint)").alias("error"), F.expr("try_cast(total AS bigint)").alias("label_error"), F.lit(digest).alias("codebooks_sha256")
    )


def _first_rows(table: DataFrame, width: int, kind: str) -> list[list[int]]:
    """The first ENTRIES rows by vec_id, then by components: a bounded number, whatever the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = unpacked(batch.column("ints"), batch.column("n"), width, kind)
                row = pa.array(list(rows.astype(np.float64)), pa.list_(pa.float64()))  # whole numbers that came from floats: none is rounded
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), row], ["vec_id", "row"])

    id_type = table.schema["vec_id"].dataType.simpleString()
    rows = table.select("vec_id", "n", "ints").mapInArrow(run, f"vec_id {id_type}, row array<double>")
    with small_batches(table.sparkSession):
        first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "row").limit(ENTRIES).collect()
    return [[int(x) for x in r["row"]] for r in first]


def _coded(table: DataFrame, books: list[list[list[int]]], width: int, kind: str) -> DataFrame:
    """table -> vec_id, label, code, error (decimal, null where 38 digits do not hold it)."""
    size = width // PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codebooks = [Codebook(b, kind) for b in books]
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = unpacked(batch.column("ints"), batch.column("n"), width, kind)
            found = [book.nearest(rows[:, p * size : (p + 1) * size]) for p, book in enumerate(codebooks)]
            codes = ["".join(f"{i:02x}" for i in at) for at in zip(*(f[0].tolist() for f in found))]
            errors = [sum(int(x) for x in ds) for ds in zip(*(f[1].tolist() for f in found))]
            errors = pa.array([Decimal(x) if x < 10**38 else None for x in errors], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(codes), errors], ["vec_id", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in table.schema}
    return table.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error decimal(38,0)")


def _sql() -> str:
    """The same in DuckDB: a query for each round. The sum of squares is written out, as integers."""
    near = """SELECT v.rn, v.part, c.entry, list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS far
FROM parts v JOIN book{r} c USING (part)
QUALIFY row_number() OVER (PARTITION BY v.rn, v.part ORDER BY far, c.entry) = 1"""
    rounds = []
    for r in range(ROUNDS):
        rounds.append(f"at{r} AS MATERIALIZED ({near.format(r=r)})")
        rounds.append(f"""means{r} AS (SELECT part, entry, list(m ORDER BY pos) AS x FROM (
  SELECT part, entry, pos, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS m
  FROM (SELECT a.part, a.entry, unnest(v.x) AS x, generate_subscripts(v.x, 1) AS pos FROM at{r} a JOIN parts v ON v.rn = a.rn AND v.part = a.part)
  GROUP BY ALL) GROUP BY ALL)""")
        rounds.append(f"book{r + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM book{r} b LEFT JOIN means{r} m USING (part, entry))")
    steps = ",\n".join(rounds)
    return f"""WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v, row_number() OVER (ORDER BY vec_id) AS rn
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT rn, part, v[part * (len(v) // {PARTS}) + 1 : (part + 1) * (len(v) // {PARTS})] AS x FROM kept, range({PARTS}) AS t(part)
), book0 AS (SELECT part, rn - 1 AS entry, x::HUGEINT[] AS x FROM parts WHERE rn <= {ENTRIES}),
{steps},
coded AS MATERIALIZED ({near.format(r=ROUNDS)}),
of_row AS (SELECT rn, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(far) AS error FROM coded GROUP BY rn),
digest AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book{ROUNDS})
SELECT vec_id, code, error::BIGINT AS error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM kept JOIN of_row USING (rn), digest"""


SQL = _sql()

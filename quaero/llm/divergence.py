"""Source divergence audit: how far the word use of a language's sources lies apart, by systolic rotation.

A group is a (lang, source); its vector has a probability for each kept term of
its language, as a whole number of billionths. A language's terms are dealt to
slices of about SLICE terms and its n blocks hold its groups, both by hash, so
neither a large vocabulary nor a source with a third of all rows makes a large
row: a row is one group's part of one slice, as numbers and probabilities of
the terms that it has, compressed. All its other terms share one probability.

In every slice the blocks of a language play a round-robin tournament: in round
r, block b meets block (r - b) mod n, so each pair meets once in n rounds and
each block meets itself once. One block of a pair, the lower or the higher in
turn, stays resident; the other's vectors travel to it. All rounds are one
shuffle: a task first takes its resident vectors, then the visitors of one
round after another, of which it holds one at a time. n grows as the root of the number
of sources, so that a task meets as many visitors as it has residents.

A meeting of two vectors is evaluated for both directions. The distance over
the terms that the visitor has is summed term by term; over all others the
visitor has one probability, and the resident's sorted probabilities with their
running sums give the distance without a look at the terms. Slices add up by
group pair. Residents hold their terms against the language's own vector, which
is sent ahead, and a heap of fixed size for each of them leaves at most TOP
terms a slice for the final ranks.

Defined results: a null text counts as empty, null lang and source as ''. Rows
count as documents, repeated ones too. A language without kept terms has pairs
of value 0; a single source has no pairs. Equal values are ranked by the UTF-8
bytes of the item. An empty table gives an empty result. Columns other than
text, lang and source are ignored, whatever their names. Texts are taken in
pieces, so a very long one makes no long list. Whole-number arithmetic is exact
while a language has fewer than 9e15 occurrences.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, shuffle_partitions, small_batches, small_side

MIN_DOCS, SMOOTHING, UNIT, TOP = 30, 5, 1_000_000_000, 50
SLICE = 8192
#: More groups than this never share a block, so a resident block's vectors fit a task.
BLOCK = 512
#: Terms that a task holds before it puts out what it has counted, and bytes of a text taken at a time.
HELD_TERMS, PIECE = 1 << 18, 1 << 20

#: Bytes: A-Z lower-cased, other letters and all beyond ASCII as they are, the rest blank.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text, some at a time."""
    text = text.translate(_LETTERS)
    at = 0
    while at < len(text):
        end = text.find(b" ", at + PIECE)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, text) -> lang, source, term, n occurrences, docs with it; a null term with 0 for each group. Partial sums of tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often: dict[tuple[str, str], Counter] = defaultdict(Counter)
        having: dict[tuple[str, str], Counter] = defaultdict(Counter)

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), n in often.items():
                words, docs = list(n), having[lang, source]
                columns = [pa.array([lang] * (len(words) + 1), pa.string()), pa.array([source] * (len(words) + 1), pa.string()), pa.array([*words, None], pa.binary()).cast(pa.string())]
                columns += [pa.array([*n.values(), 0], pa.int64()), pa.array([*(docs[w] for w in words), 0], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])
            often.clear()
            having.clear()

        held = 0
        for batch in batches:
            for lang, source, text in zip(*(batch.column(c) for c in ("lang", "source", "text")), strict=True):
                key = (lang.as_py() or "", source.as_py() or "")
                n, seen = often[key], set()
                before = len(n)
                for some in terms(text.as_buffer().to_pybytes() if text.is_valid else b""):
                    n.update(some)
                    seen.update(some)
                having[key].update(seen)
                held += len(n) - before
                if held > HELD_TERMS:
                    yield from out()
                    held = 0
        yield from out()

    columns = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    return docs.select(*columns, F.col("text").cast("string").alias("text")).mapInArrow(run, "lang string, source string, term string, n long, docs long")


def probability(n: np.ndarray, total: np.ndarray | int, vocabulary: np.ndarray | int) -> np.ndarray:
    """1 + floor(UNIT * (n + 5) / (total + 5 * vocabulary)), three digits at a time so that nothing overflows."""
    rest, whole = np.asarray(n, np.int64) + SMOOTHING, np.asarray(total, np.int64) + SMOOTHING * np.asarray(vocabulary, np.int64)
    digits = np.zeros_like(rest)
    for _ in range(3):
        rest = rest * 1000
        digits = digits * 1000 + rest // whole
        rest = rest % whole
    return 1 + digits


# ---------------------------------------------------------------- vectors


def _packed(at: np.ndarray, p: np.ndarray) -> bytes:
    """Sorted term numbers as steps, then probabilities, compressed."""
    return zstandard.compress(np.diff(at, prepend=0).astype(np.uint32).tobytes() + p.astype(np.uint32).tobytes(), 1)


def _unpacked(vector: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps, p = np.frombuffer(zstandard.decompress(vector), np.uint32).reshape(2, -1)
    return np.cumsum(steps, dtype=np.int64), p.astype(np.int64)


def _vectors(rows: DataFrame) -> DataFrame:
    """rows(..., total, vocabulary, terms array<struct<at, n>>) -> the others, rest: the probability of terms not there, vector."""
    kept = [f for f in rows.schema if f.name not in ("terms", "total", "vocabulary")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest, packed = [], []
            for terms_, total, v in zip(*(batch.column(c) for c in ("terms", "total", "vocabulary")), strict=True):
                pairs = terms_.values.flatten() if terms_.is_valid and len(terms_.values) else [pa.array([], pa.int64())] * 2
                at, n = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in pairs)
                order = np.argsort(at)
                total, v = total.as_py(), v.as_py()
                rest.append(int(probability(np.zeros(1, np.int64), total, v)[0]) if v else 0)
                packed.append(_packed(at[order], probability(n[order], total, v)))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(rest, pa.int64()), pa.array(packed, pa.binary())], [*(f.name for f in kept), "rest", "vector"])

    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", rest long, vector binary")


class _Resident:
    """A block's vectors of one slice, at home in a task."""

    def __init__(self, n_terms: int, language: list[np.ndarray], rows: list[tuple[int, int, bytes]], top: int):
        self.ids = np.array([g for g, _, _ in rows], np.int64)
        self.p = np.empty((len(rows), n_terms), np.int64)
        self.heaps = []
        of_language = np.zeros(n_terms, np.int64)
        of_language[language[0]] = language[1]
        for i, (_, rest, vector) in enumerate(rows):
            at, p = _unpacked(vector)
            self.p[i] = rest
            self.p[i, at] = p
            above = p - of_language[at]
            self.heaps.append(heapq.nlargest(top, zip(above[above > 0].tolist(), (-at[above > 0]).tolist())))
        self.sorted = np.sort(self.p, axis=1)
        self.running = np.concatenate([np.zeros((len(rows), 1), np.int64), np.cumsum(self.sorted, axis=1)], axis=1)

    def distances(self, rest: int, vector: bytes) -> np.ndarray:
        """Of each resident to one visitor, over all terms of the slice."""
        n = self.p.shape[1]
        below = np.array([np.searchsorted(row, rest) for row in self.sorted], np.int64)
        of_below = self.running[np.arange(len(below)), below]
        whole = rest * below - of_below + (self.running[:, -1] - of_below) - rest * (n - below)
        at, p = _unpacked(vector)
        own = self.p[:, at]
        return whole + (np.abs(own - p) - np.abs(own - rest)).sum(1)


class _Meetings:
    """One resident block of one slice, and whom it meets. Takes rows in order of their rounds and gives (part, grp, item, slice, value)."""

    def __init__(self, key: tuple, top: int):
        self.key, self.top, self.language, self.waiting, self.home = key, top, None, [], None

    def take(self, row) -> Iterator[tuple]:
        if row.round == -2:
            self.language = (row.slice, row.n_terms, *_unpacked(row.vector))
        elif row.round == -1:
            self.waiting.append((row.grp, row.rest, row.vector))
        else:
            yield from self.among_residents()
            yield from self._both_ways(row.grp, self.home.ids, self.home.distances(row.rest, row.vector))

    def among_residents(self) -> Iterator[tuple]:
        """Their own meetings and terms, once, when all of them are here."""
        if self.home is not None:
            return
        slice_, n_terms, *language = self.language
        self.home = _Resident(n_terms, language, self.waiting, self.top)
        for i, (grp, rest, vector) in enumerate(self.waiting):
            for value, minus_at in self.home.heaps[i]:
                yield "term", grp, -minus_at, slice_, value
            yield from self._both_ways(grp, self.home.ids[i + 1 :], self.home.distances(rest, vector)[i + 1 :])
        self.waiting = []

    def _both_ways(self, grp: int, others: np.ndarray, values: np.ndarray) -> Iterator[tuple]:
        for other, value in zip(others.tolist(), values.tolist(), strict=True):
            yield "pair", grp, other, self.language[0], value
            yield "pair", other, grp, self.language[0], value


def _met(rows: DataFrame, top: int) -> DataFrame:
    """rows by (lang, slice, home), then round: the language's vector (-2), residents (-1), visitors ->
    part, grp, item (a group, or a term's number in the slice), slice, value."""
    columns = ["part", "grp", "item", "slice", "value"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = None
        for pdf in batches:
            out: list[tuple] = []
            for row in pdf.itertuples(index=False):
                key = (row.lang, row.slice, row.home)
                if now is None or now.key != key:
                    if now:
                        out += now.among_residents()
                    now = _Meetings(key, top)
                out += now.take(row)
            yield pd.DataFrame(out, columns=columns)
        if now:
            yield pd.DataFrame(list(now.among_residents()), columns=columns)

    return rows.mapInPandas(run, "part string, grp long, item long, slice long, value long")


def _rounds(vectors: DataFrame, languages: DataFrame) -> DataFrame:
    """vectors(lang, slice, block, blocks, ...), languages(lang, slice, blocks, ...) -> the rows that a home gets."""
    n, block = F.col("blocks"), F.col("block")
    other = F.pmod(F.col("round") - block, n)
    at_home = F.when((block + other) % 2 == 0, F.least(block, other)).otherwise(F.greatest(block, other))
    travels = vectors.withColumn("round", F.explode(F.sequence(F.lit(0).cast("long"), n - 1))).withColumn("home", at_home).filter((other != block) & (F.col("home") != block))
    stays = vectors.withColumn("round", F.lit(-1).cast("long")).withColumn("home", block)
    ahead = languages.withColumn("round", F.lit(-2).cast("long")).withColumn("home", F.explode(F.sequence(F.lit(0).cast("long"), n - 1))).withColumn("grp", F.lit(-1).cast("long"))
    columns = ["lang", "slice", "home", "round", "grp", "n_terms", "rest", "vector"]
    rows = stays.select(columns).unionByName(travels.select(columns)).unionByName(ahead.select(columns))
    return rows.repartition(shuffle_partitions(vectors.sparkSession), "lang", "slice", "home").sortWithinPartitions("lang", "slice", "home", "round", "grp")


# ---------------------------------------------------------------- the audit


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, slice_terms: int = SLICE) -> DataFrame:
    """docs(text, lang, source) -> lang, source, part, item, value, rank."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    written = scratch.written
    with small_batches(spark):
        partial = counted(docs)
    counts = written(partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
    groups = written(counts.filter("term IS NULL").select("lang", "source").withColumn("grp", F.monotonically_increasing_id()), "groups")
    n_groups = groups.count()
    frequent = counts.filter("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs)
    frequent = written(frequent.drop("docs"), "frequent")
    sizes = frequent.groupBy("lang").agg(F.count(F.lit(1)).alias("vocabulary"), F.sum("n").alias("total"))
    sources = F.count(F.lit(1))
    blocks = F.greatest(F.ceil(F.sqrt(sources)), F.ceil(sources / BLOCK)).cast("long")
    langs = groups.groupBy("lang").agg(blocks.alias("blocks")).join(sizes, "lang", "left").fillna(0, ["vocabulary", "total"])
    langs = written(langs.withColumn("slices", F.greatest(F.lit(1), F.ceil(F.col("vocabulary") / slice_terms)).cast("long")), "languages")
    n_langs = langs.count()
    of_lang = small_side(langs, n_langs, 64)
    number = F.row_number().over(Window.partitionBy("lang", "slice").orderBy("term")) - 1
    kept = frequent.join(of_lang.select("lang", "slices"), "lang").withColumn("slice", F.pmod(F.xxhash64("term"), "slices")).drop("slices")
    kept = written(kept.withColumn("at", number.cast("long")), "terms")
    found = counts.filter("term IS NOT NULL").select("lang", "source", "term", "n").join(kept.select("lang", "term", "slice", "at"), ["lang", "term"])
    found = written(found.join(small_side(groups, n_groups, 64), ["lang", "source"]).select("grp", "slice", "at", "n"), "found")

    listed = F.collect_list(F.struct("at", "n")).alias("terms")
    own = kept.groupBy("lang", "slice").agg(F.count(F.lit(1)).cast("long").alias("n_terms"), listed)
    slices = of_lang.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1))).drop("slices").join(own, ["lang", "slice"], "left").fillna(0, ["n_terms"])
    slices = written(slices, "slices")
    languages = written(_vectors(slices.select("lang", "slice", "blocks", "n_terms", "total", "vocabulary", "terms")), "language-vectors")
    totals = found.groupBy("grp").agg(F.sum("n").alias("total"))
    of_group = groups.join(totals, "grp", "left").fillna(0, ["total"]).join(slices.drop("total", "terms"), "lang")
    of_group = of_group.join(found.groupBy("grp", "slice").agg(listed), ["grp", "slice"], "left").withColumn("block", F.pmod(F.xxhash64("source"), "blocks"))
    vectors = written(_vectors(of_group.select("lang", "slice", "block", "blocks", "grp", "n_terms", "total", "vocabulary", "terms")), "vectors")
    met = written(_met(_rounds(vectors, languages), top), "meetings")
    scratch.keep(groups, kept, met)

    def named(rows: DataFrame, part: str) -> DataFrame:
        order = Window.partitionBy("grp").orderBy(F.col("value").desc(), "item")
        ranked = rows.withColumn("rank", F.row_number().over(order).cast("int"))
        return ranked.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")

    of = small_side(groups, n_groups, 64)
    names = small_side(groups.select(F.col("grp").alias("other"), F.col("source").alias("item")), n_groups, 64)
    pairs = met.filter("part = 'pair'").groupBy("grp", F.col("item").alias("other")).agg(F.sum("value").alias("value")).join(of, "grp").join(names, "other")
    words = kept.select("lang", "slice", "at", F.col("term").alias("item"))
    best = met.filter("part = 'term'").select("grp", "slice", F.col("item").alias("at"), "value").join(of, "grp").join(words, ["lang", "slice", "at"])
    return named(pairs, "pair").unionByName(named(best, "term").filter(F.col("rank") <= top))


def sql(min_docs: int = MIN_DOCS, top: int = TOP) -> str:
    return rf"""WITH words AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), kept AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(w)) AS term FROM words) GROUP BY ALL HAVING count(*) >= {min_docs}),
found AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(w) AS term FROM words) JOIN kept USING (lang, term) GROUP BY ALL),
of_lang AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
groups AS (SELECT lang, source, coalesce(any_value(v), 0) AS v, coalesce(sum(n), 0) AS total
           FROM (SELECT DISTINCT lang, source FROM words) LEFT JOIN of_lang USING (lang) LEFT JOIN found USING (lang, source) GROUP BY ALL),
p AS MATERIALIZED (SELECT g.lang, g.source, term, coalesce(n, 0) AS n, 1 + ({UNIT}::HUGEINT * (coalesce(n, 0) + {SMOOTHING})) // (total + {SMOOTHING} * v) AS p
      FROM groups g JOIN kept USING (lang) LEFT JOIN found USING (lang, source, term)),
q AS (SELECT lang, term, 1 + ({UNIT}::HUGEINT * (sum(n) + {SMOOTHING})) // (sum(sum(n)) OVER (PARTITION BY lang) + {SMOOTHING} * any_value(v)) AS q
      FROM found JOIN of_lang USING (lang) GROUP BY lang, term),
far AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
        FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
rows AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
         FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
         LEFT JOIN far f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
         UNION ALL
         SELECT p.lang, p.source, 'term', p.term, (p - q)::BIGINT FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM rows QUALIFY part = 'pair' OR rank <= {top}"""


SQL = sql()

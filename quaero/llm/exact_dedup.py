"""Exact deduplication with a log-structured merge index.

Map tasks fold their rows into memtables keyed by the digest of the normalised
text. A full memtable is flushed as one sorted run, cut into digest ranges,
each segment with a Bloom filter. Compaction merges the segments of a range:
the filters tell which keys can occur in several segments, only those are
merged, and the entry that stays is the one with the most code points, then
the smallest identifier. Rows whose digest is in the index more than once are
verified byte by byte against the text that stays; should texts differ in
spite of equal digests, their digest's rows are grouped again by whole text.
For the verification a group is cut into pieces of VERIFY_ROWS rows, and the
text that stays goes to each piece, so no group lands in one task.

Defined results: a null text counts as empty; empty and all-blank texts are
equal; of rows repeated with their doc_id one stays; a null doc_id sorts after
every other; an empty table gives an empty result; extra columns are ignored by
exact_dedup and kept, whatever their names, by keep_first_copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WS, Scratch, shuffle_partitions, small_side, unused

#: Null doc_ids sort last while the index is built.
LAST_ID = (1 << 63) - 1
BLOOM_BITS = 10
BLOOM_HASHES = 4
#: The filter over the whole index has BLOOM_BITS a key up to this size; with more keys it lets more rows through, which
#: are joined exactly all the same.
FILTER_BITS = 1 << 27
VERIFY_ROWS = 128


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{WS}]+", "")


def _words(keys: np.ndarray) -> np.ndarray:
    """(n, width) bytes -> (n, 2) 64-bit halves, the source of all filter positions."""
    pad = np.zeros((len(keys), 16), dtype=np.uint8)
    pad[:, : min(16, keys.shape[1])] = keys[:, :16]
    return pad.view(np.uint64).reshape(-1, 2)


def _positions(keys: np.ndarray, bits: int) -> np.ndarray:
    w = _words(keys)
    step = w[:, 1] | np.uint64(1)
    with np.errstate(over="ignore"):
        return np.stack([(w[:, 0] * np.uint64(0x9E3779B97F4A7C15) + step * np.uint64(i)) % np.uint64(bits) for i in range(BLOOM_HASHES)], 1)


def bloom_build(keys: np.ndarray, bits: int) -> np.ndarray:
    on = np.zeros(bits, dtype=bool)
    on[_positions(keys, bits).ravel()] = True
    return np.packbits(on)


def bloom_hits(keys: np.ndarray, packed: np.ndarray, bits: int) -> np.ndarray:
    at = _positions(keys, bits)
    return ((packed[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1).all(1)


def _fold(keys: np.ndarray, chars: np.ndarray, ids: np.ndarray, counts: np.ndarray):
    """Sort by key and keep, per key, the most code points, then the smallest id; add up the counts."""
    if not len(keys):
        return keys, chars, ids, counts
    width = keys.shape[1]
    words = np.zeros((len(keys), (width + 7) // 8 * 8), dtype=np.uint8)
    words[:, :width] = keys
    cols = words.view(">u8").reshape(len(keys), -1)
    order = np.lexsort((ids, -chars, *[cols[:, i] for i in range(cols.shape[1] - 1, -1, -1)]))
    keys, chars, ids, counts, cols = keys[order], chars[order], ids[order], counts[order], cols[order]
    first = np.flatnonzero(np.r_[True, (cols[1:] != cols[:-1]).any(1)])
    return keys[first], chars[first], ids[first], np.add.reduceat(counts, first)


def _key_matrix(blobs, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), dtype=np.uint8).reshape(-1, width)


def build_index(signatures: DataFrame, width: int, ranges: int, memtable_rows: int = 1 << 17) -> DataFrame:
    """(doc_id, key, n_chars) -> index entries (key, keep_id, group_size) of all digests.

    A segment's filter is sized by the keys that a full memtable has in a range,
    so filters take their share of the keys' bytes, however many runs and ranges.
    """
    run_bits = 1 << max(6, (BLOOM_BITS * memtable_rows // ranges).bit_length())

    def flush(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        rows = 0

        def run():
            parts = [np.concatenate(x) for x in zip(*held, strict=True)]
            keys, chars, ids, counts = _fold(*parts)
            head = np.zeros((len(keys), 4), np.uint8)
            head[:, : min(4, width)] = keys[:, :4]
            at = head.view(">u4").ravel().astype(np.int64) % ranges
            out = []
            order = np.argsort(at, kind="stable")
            for r in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
                k = keys[r]
                out.append((int(at[r[0]]), k.tobytes(), chars[r].tobytes(), ids[r].tobytes(), counts[r].tobytes(), bloom_build(k, run_bits).tobytes()))
            held.clear()
            return pd.DataFrame(out, columns=["range_id", "keys", "chars", "ids", "counts", "bloom"])

        for pdf in batches:
            if not len(pdf):
                continue
            held.append((_key_matrix(pdf["key"], width), pdf["n_chars"].to_numpy(np.int64), pdf["id"].to_numpy(np.int64), np.ones(len(pdf), np.int64)))
            rows += len(pdf)
            if rows >= memtable_rows:
                yield run()
                rows = 0
        if held:
            yield run()

    def compact(pdf: pd.DataFrame) -> pd.DataFrame:
        runs = [(_key_matrix([k], width), np.frombuffer(c, np.int64), np.frombuffer(i, np.int64), np.frombuffer(n, np.int64)) for k, c, i, n in zip(pdf["keys"], pdf["chars"], pdf["ids"], pdf["counts"], strict=True)]
        once = np.zeros(run_bits // 8, np.uint8)
        twice = once.copy()
        for b in pdf["bloom"]:  # bits that are set in two filters at least
            b = np.frombuffer(b, np.uint8)
            twice |= once & b
            once |= b
        shared = [bloom_hits(r[0], twice, run_bits) for r in runs]
        alone = [np.concatenate([r[j][~m] for r, m in zip(runs, shared, strict=True)]) for j in range(4)]
        merged = _fold(*[np.concatenate([r[j][m] for r, m in zip(runs, shared, strict=True)]) for j in range(4)])
        keys, _, ids, counts = (np.concatenate(x) for x in zip(alone, merged, strict=True))
        return pd.DataFrame({"key": [k.tobytes() for k in keys], "keep_id": ids, "group_size": counts})

    segments = signatures.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("id"), "key", "n_chars").mapInPandas(
        flush, "range_id int, keys binary, chars binary, ids binary, counts binary, bloom binary"
    )
    return segments.groupBy("range_id").applyInPandas(compact, "key binary, keep_id long, group_size long")


def exact_dedup(docs: DataFrame, digest_bytes: int = 32, range_rows: int = 1 << 18) -> DataFrame:
    """docs(doc_id, text) -> doc_id, keep_id, group_size, kept, text_sha256, n_chars, one row per row of docs.

    digest_bytes: bytes of SHA-256 that key the index. Whatever it is, texts
    are only grouped when they are equal byte by byte.
    """
    return _deduplicated(docs, digest_bytes, range_rows).drop("sign")


def _sign(text: Column) -> Column:
    """Tells the texts of a doc_id apart; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _deduplicated(docs: DataFrame, digest_bytes: int = 32, range_rows: int = 1 << 18) -> DataFrame:
    """What exact_dedup returns, with the sign of each row's text."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select("doc_id", "text")
    keyed = (
        docs.withColumn("norm", normalised(F.col("text")))
        .withColumn("text_sha256", F.sha2("norm", 256))
        .withColumn("key", F.substring(F.unhex("text_sha256"), 1, digest_bytes))
    )
    signatures = scratch.written(
        keyed.select("doc_id", "key", "text_sha256", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), _sign(F.col("text")).alias("sign")), "digests"
    )
    n = signatures.count()
    ranges = int(max(shuffle_partitions(spark), n // range_rows))
    many = scratch.written(build_index(signatures, digest_bytes, ranges).filter("group_size > 1"), "lsm-index")
    n_many = many.count()
    bits = min(FILTER_BITS, max(1 << 13, n_many * BLOOM_BITS))
    packed = spark.sparkContext.broadcast(_index_filter(many, bits))  # of a fixed size at most

    @F.pandas_udf("boolean")
    def may_hit(key: pd.Series) -> pd.Series:
        return pd.Series(bloom_hits(_key_matrix(key, digest_bytes), packed.value, bits) if len(key) else [], dtype=bool)

    # Texts that occur once go no further than the filter.
    hits = scratch.written(keyed.select("doc_id", "key", "norm").filter(may_hit("key")).join(many, "key"), "hits")
    verified = scratch.written(_verify(hits), "verified")
    failed = scratch.written(verified.filter("not same").select("key").distinct(), "failed")
    placed = signatures.join(many, "key", "left").select(
        "doc_id", "key", "text_sha256", "n_chars", "sign",
        F.coalesce("keep_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID))).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
    )
    if failed.limit(1).count():
        again = scratch.written(_regroup(keyed.join(failed, "key", "left_semi")), "regrouped")
        scratch.keep(signatures, many, failed, again)
        placed = placed.join(failed, "key", "left_anti").unionByName(again)
    else:
        scratch.keep(signatures, many)
    return _one_stays(placed)


def _index_filter(many: DataFrame, bits: int) -> np.ndarray:
    """The union of the filters that the partitions of the index build; its size is fixed by bits."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        on = np.zeros((bits + 7) // 8, np.uint8)
        for pdf in batches:
            if len(pdf):
                on |= bloom_build(_key_matrix(pdf["key"], len(pdf["key"].iloc[0])), bits)
        yield pd.DataFrame({"f": [on.tobytes()]})

    total = np.zeros((bits + 7) // 8, np.uint8)
    for row in many.select("key").coalesce(8).mapInPandas(build, "f binary").toLocalIterator():
        total |= np.frombuffer(row["f"], np.uint8)
    return total


def _verify(hits: DataFrame) -> DataFrame:
    """hits(doc_id, key, norm, keep_id, group_size) -> (key, same): each row against the bytes of the row that stays.
    A group's rows are dealt over pieces, each with a copy of the text that stays."""
    pieces = F.ceil(F.col("group_size") / VERIFY_ROWS)
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID))
    stay = hits.filter(own == F.col("keep_id")).groupBy("key", "group_size").agg(F.min("norm").alias("stay_norm"))
    stay = stay.select("key", "stay_norm", F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1)).alias("piece"))
    dealt = hits.withColumn("piece", F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), pieces))
    return dealt.join(stay, ["key", "piece"]).select("key", F.expr("norm = stay_norm").alias("same"))


def _regroup(keyed: DataFrame) -> DataFrame:
    """Rows of digests that more than one text has, by whole text."""
    rows = keyed.select(
        "doc_id", "key", "text_sha256", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), "norm", _sign(F.col("text")).alias("sign"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("id"),
    )
    groups = rows.groupBy("norm").agg(
        F.min(F.struct((-F.col("n_chars")).alias("c"), "id")).alias("best"), F.count(F.lit(1)).alias("group_size")
    )
    return rows.join(groups, "norm").select("doc_id", "key", "text_sha256", "n_chars", "sign", F.col("best.id").alias("keep_id"), "group_size")


def _one_stays(placed: DataFrame) -> DataFrame:
    is_best = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)) == F.col("keep_id")
    # Rows that share their doc_id with the one that stays: almost always just that row.
    ranked = placed.filter(is_best & (F.col("group_size") > 1)).withColumn(
        "kept", F.row_number().over(Window.partitionBy("text_sha256", "keep_id").orderBy(F.desc("n_chars"), "sign")) == 1
    )
    rest = placed.filter(~is_best | (F.col("group_size") == 1)).withColumn("kept", is_best)
    return ranked.unionByName(rest).select(
        "doc_id", F.when(F.col("keep_id") != LAST_ID, F.col("keep_id")).alias("keep_id"), "group_size", "kept", "text_sha256", "n_chars", "sign"
    )


def keep_first_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that exact_dedup keeps, with their columns.

    A row is found again by its doc_id and text. The few that go are joined
    against all rows, so as long as they fit a broadcast of checked size no
    text is moved, and beyond it each is moved once.
    """
    scratch = Scratch(docs.sparkSession)
    the_id, the_sign, n_rows = unused(docs, "id", "sign", "n")
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID))
    rows = _deduplicated(docs).groupBy(own.alias(the_id), F.col("sign").alias(the_sign)).agg(F.count(F.lit(1)).alias(n_rows), F.count_if("kept").alias("n_kept"))
    changed = scratch.written(rows.filter(F.col("n_kept") < F.col(n_rows)), "changed")
    n, n_some = changed.count(), changed.filter("n_kept > 0").count()
    signed = docs.withColumns({the_id: own, the_sign: _sign(F.col("text"))})
    out = signed.join(small_side(changed.select(the_id, the_sign), n, 72), [the_id, the_sign], "left_anti")
    if n_some:  # rows that repeat both doc_id and text
        some = changed.filter("n_kept > 0").select(the_id, the_sign)
        out = out.unionByName(signed.join(small_side(some, n_some, 72), [the_id, the_sign], "left_semi").dropDuplicates([the_id, the_sign]))
    return out.select(*docs.columns)


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER g AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER g = 1 AS kept,
       text_sha256,
       CAST(length(t) AS BIGINT) AS n_chars
FROM d
WINDOW g AS (PARTITION BY text_sha256 ORDER BY length(t) DESC, doc_id NULLS LAST)
"""

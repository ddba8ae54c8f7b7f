"""Token ids in binary shards with a minimal perfect hash index.

Writing: documents are range-partitioned and sorted by doc_id; every partition
encodes its texts and appends the ids, as little-endian unsigned integers of
the smallest width that the vocabulary allows, to one shard file. Shards in
order are the ids of all documents in ascending doc_id order.

Index: keys are hashed into buckets of bounded size. A bucket's file holds a
minimal perfect hash of its keys (levels of bits: a key that is alone at its
place is settled, the others go to the next level; the rank of its bit is a
key's slot) and, per slot, a fingerprint of the key, the shard, the offset and
the number of ids. A lookup is a few bit tests and one row of arrays; the
fingerprint turns away keys that were never stored.

Defined results: a null text counts as empty and has the end id only; a null
doc_id sorts first; rows repeated with their doc_id are numbered (by text) and
have an entry each; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .files import RangeReader, open_fs, whole_file
from .shared import NULL_ID, new_path, node_id, shuffle_partitions, written

BUCKET_KEYS = 50_000
#: Bytes of each of two generations of remembered words.
REMEMBERED_BYTES = 64 << 20
GROUP_BYTES = 1 << 21
#: A word that ends in a letter and these is the letter's pre-token and then theirs.
CLOSING = b".,;:!?|)"
MAGIC = b"QMPH0001"
#: The pre-tokenizer's pattern and the normaliser that the shortcuts below are right for.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]

# ---------------------------------------------------------------- encoding


class WordEncoder:
    """Encodes with the tokenizers library, word by word, remembering words.

    The model's normaliser and pre-tokenizer never look across white space
    (checked here), so a text's ids are those of its words one after another.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        splits = [p for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", []) if p["type"] == "Split"]
        if not splits or splits[0]["behavior"] != "Removed" or not splits[0]["invert"] or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("wants a tokenizer that drops white space between words")
        if splits[0]["pattern"] != {"Regex": SPLIT} or (spec["normalizer"] or {}).get("normalizers") != NORMALIZERS:
            raise ValueError("wants a normaliser to NFC and lower case, and runs of letters as pre-tokens")
        self.special = [t["content"][:2].encode() for t in spec["added_tokens"]]
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.memo: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}  # the generation before; what is used again moves on
        self.held = 0

    def pack(self, ids) -> bytes:
        return np.asarray(ids, dtype=self.dtype).tobytes()

    def lowered(self, text: bytes) -> bytes:
        """text with A-Z in lower case, where that cannot change its ids: not beside combining marks, which
        may compose with a small letter only, nor where special tokens may be spelt."""
        if b"\xcc" in text or b"\xcd" in text or any(x in text for x in self.special):
            return text
        return text.lower()

    def ask(self, words: list[bytes]) -> list[bytes]:
        """The packed ids of each word, from the library. Words of letters alone are one pre-token each, so
        they are sent as one text and told apart by the number of the pre-token."""
        texts = [w.decode() for w in words]
        out: list[bytes | None] = [None] * len(words)
        plain = [i for i, x in enumerate(texts) if x.isalpha()]
        if plain:
            got = self.tokenizer.encode(" ".join([texts[i] for i in plain]), add_special_tokens=False)
            of = np.array(got.word_ids, np.int64)
            ends = np.flatnonzero(np.diff(of, append=-2)) + 1
            if len(ends) == len(plain):  # else a letter's lower case is more than letters
                raw, width = self.pack(got.ids), self.dtype.itemsize
                start = 0
                for i, end in zip(plain, (ends * width).tolist(), strict=True):
                    out[i] = raw[start:end]
                    start = end
        rest = [i for i, x in enumerate(out) if x is None]
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = self.pack(e.ids)
        return out

    def learn(self, words: set[bytes]) -> None:
        """Puts words into the memo. Closing signs are split off first, so that the library sees each stem once."""
        memo, older = self.memo, self.older
        for w in words & older.keys():
            memo[w] = older[w]
        split: list[tuple[bytes, bytes, bytes]] = []
        ask: set[bytes] = set()
        for w in words.difference(memo):
            stem = w.rstrip(CLOSING)
            if len(stem) == len(w) or not stem[-1:].isalpha():
                ask.add(w)
            else:
                split.append((w, stem, w[len(stem) :]))
        ask.update([x[1] for x in split], [x[2] for x in split])
        for x in ask & older.keys():
            memo[x] = older[x]
        new = list(ask.difference(memo))
        memo.update(zip(new, self.ask(new), strict=True))
        for w, stem, tail in split:
            memo[w] = memo[stem] + memo[tail]
        # Two bytes objects of 33 bytes and their contents, and a share of the table.
        self.held += 2 * sum(map(len, words)) + 150 * len(words)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The packed ids of each text (UTF-8): its words are numbered, each number's ids looked up once
        and gathered by number."""
        if self.held > REMEMBERED_BYTES:
            self.older, self.memo, self.held = self.memo, {}, 0
        split = pc.ascii_split_whitespace(pa.array([self.lowered(x) for x in texts], pa.string()))
        numbered = split.flatten().dictionary_encode()
        words = numbered.dictionary.cast(pa.binary()).to_pylist()
        memo = self.memo
        memo[b""] = b""
        new = set(words).difference(memo)
        if new:
            self.learn(new)
        parts = list(map(memo.__getitem__, words))
        for w in [w for w in new if len(w) > 256]:  # not worth remembering
            stem = w.rstrip(CLOSING)
            for x in (w, stem, w[len(stem) :]):
                memo.pop(x, None)
        ids = np.frombuffer(b"".join(parts), self.dtype)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // self.dtype.itemsize
        starts = np.cumsum(sizes) - sizes
        at = numbered.indices.to_numpy()
        n = sizes[at]
        ends = np.cumsum(n)
        place = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n - starts[at], n)
        bounds = np.concatenate([[0], ends])[split.offsets.to_numpy()]
        out = ids[place]
        return [out[i:j].tobytes() for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


_encoders: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


# ---------------------------------------------------------------- minimal perfect hash


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _hash(ids: np.ndarray, nth: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(_mix(ids.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(seed + 1)) ^ _mix(nth.astype(np.uint64) + np.uint64(seed)))


def fingerprint(ids: np.ndarray, nth: np.ndarray) -> np.ndarray:
    return (_hash(ids, nth, 1000) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """Levels of bits over distinct (id, nth) keys."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # boolean arrays
        self.ranks, at = [], 0
        for bits in levels:
            ranks = np.cumsum(bits) - bits + at
            self.ranks.append(ranks)
            at += int(bits.sum())
        self.n = at

    @classmethod
    def build(cls, ids: np.ndarray, nth: np.ndarray) -> PerfectHash:
        levels: list[np.ndarray] = []
        while len(ids):
            if len(levels) > 200:
                raise ValueError("keys are not distinct")
            at = (_hash(ids, nth, len(levels)) % np.uint64(len(ids))).astype(np.int64)
            bits = np.bincount(at, minlength=len(ids)) == 1
            levels.append(bits)
            rest = ~bits[at]
            ids, nth = ids[rest], nth[rest]
        return cls(levels)

    def slots(self, ids: np.ndarray, nth: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 or any slot for a key that is not in the set."""
        out = np.full(len(ids), -1, np.int64)
        left = np.arange(len(ids))
        for level, bits in enumerate(self.levels):
            if not len(left):
                break
            at = (_hash(ids[left], nth[left], level) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[left[hit]] = self.ranks[level][at[hit]]
            left = left[~hit]
        return out

    def tobytes(self) -> bytes:
        head = struct.pack("<I", len(self.levels)) + b"".join(struct.pack("<Q", len(b)) for b in self.levels)
        return head + b"".join(np.packbits(b).tobytes() for b in self.levels)

    @classmethod
    def frombytes(cls, raw: memoryview) -> tuple[PerfectHash, int]:
        (n,) = struct.unpack_from("<I", raw)
        sizes = struct.unpack_from(f"<{n}Q", raw, 4)
        at, levels = 4 + 8 * n, []
        for size in sizes:
            width = (size + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(raw[at : at + width], np.uint8))[:size].astype(bool))
            at += width
        return cls(levels), at


def write_bucket(uri: str, ids: np.ndarray, nth: np.ndarray, shard: np.ndarray, offset: np.ndarray, n_ids: np.ndarray) -> None:
    mph = PerfectHash.build(ids, nth)
    order = np.empty(len(ids), np.int64)
    order[mph.slots(ids, nth)] = np.arange(len(ids))
    with whole_file(uri) as f:
        f.write(MAGIC + struct.pack("<Q", len(ids)) + mph.tobytes())
        for x, kind in ((fingerprint(ids, nth), "<u4"), (shard, "<u4"), (offset, "<u8"), (n_ids, "<u8")):
            f.write(np.ascontiguousarray(x[order], dtype=kind).tobytes())


class Bucket:
    def __init__(self, uri: str):
        fs, path = open_fs(uri)
        with fs.open_input_stream(path, compression=None) as f:
            raw = memoryview(f.read())
        if raw[:8] != MAGIC:
            raise ValueError(f"{uri} is not an index bucket")
        (n,) = struct.unpack_from("<Q", raw, 8)
        self.mph, at = PerfectHash.frombytes(raw[16:])
        at += 16
        self.columns = []
        for kind in ("<u4", "<u4", "<u8", "<u8"):
            size = n * np.dtype(kind).itemsize
            self.columns.append(np.frombuffer(raw[at : at + size], kind))
            at += size

    def lookup(self, ids: np.ndarray, nth: np.ndarray):
        """(found, shard, offset, n_ids) of each key."""
        slots = self.mph.slots(ids, nth)
        mark, shard, offset, n_ids = self.columns
        found = slots >= 0
        if not len(mark):
            return found, slots, slots, slots
        slots = np.maximum(slots, 0)
        found &= mark[slots] == fingerprint(ids, nth)
        return found, shard[slots].astype(np.int64), offset[slots].astype(np.int64), n_ids[slots].astype(np.int64)


# ---------------------------------------------------------------- the store


def encoded(enc: WordEncoder, texts) -> Iterator[bytes]:
    """Packed ids of each text, a bounded number of texts at a time."""
    held: list[bytes] = []
    size = 0
    for text in texts:
        held.append(text.as_buffer().to_pybytes())
        size += len(held[-1])
        if size >= GROUP_BYTES:
            yield from enc.encode(held)
            held, size = [], 0
    if held:
        yield from enc.encode(held)


def write_store(docs: DataFrame, tokenizer_path: str, end_id: int | None = 1, path: str | None = None) -> tuple[str, DataFrame]:
    """Writes shards and index; returns the store's path and a table of its shards (shard, n_ids, start)."""
    spark = docs.sparkSession
    path = path or new_path(spark, "token-store")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = word_encoder(tokenizer_path)
        end = b"" if end_id is None else enc.pack([end_id])
        shard, at = TaskContext.get().partitionId(), 0
        before, nth = None, 0
        with whole_file(f"{path}/shard-{shard:06d}.ids") as f:
            for batch in batches:
                rows = []
                for key, raw in zip(batch.column("id").to_pylist(), encoded(enc, batch.column("text")), strict=True):
                    raw += end
                    f.write(raw)
                    nth = nth + 1 if key == before else 0
                    before = key
                    n = len(raw) // enc.dtype.itemsize
                    rows.append((key, nth, shard, at, n))
                    at += n
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)] if rows else []
                if rows:
                    yield pa.RecordBatch.from_arrays(columns, ["id", "nth", "shard", "offset", "n_ids"])

    rows = docs.select(node_id(F.col("doc_id")).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    placed = written(
        rows.repartitionByRange(shuffle_partitions(spark), "id").sortWithinPartitions("id", "text").mapInArrow(write, "id long, nth long, shard int, offset long, n_ids long"),
        "places",
    )
    buckets = max(1, -(-placed.count() // BUCKET_KEYS))

    def index(pdf: pd.DataFrame) -> pd.DataFrame:
        b = int(pdf["bucket"].iloc[0])
        write_bucket(f"{path}/index-{b:06d}.mph", *(pdf[c].to_numpy() for c in ("id", "nth", "shard", "offset", "n_ids")))
        return pd.DataFrame({"bucket": [b], "n": [len(pdf)]})

    built = placed.withColumn("bucket", F.pmod(F.xxhash64("id", "nth"), F.lit(buckets)))
    written(built.groupBy("bucket").applyInPandas(index, "bucket long, n long"), "buckets")
    with whole_file(f"{path}/meta") as f:
        f.write(f"{buckets} {word_encoder(tokenizer_path).dtype.itemsize}".encode())
    shards = placed.groupBy("shard").agg(F.sum("n_ids").alias("n_ids")).withColumn(
        "start", F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    return path, written(shards, "shards")


def read_meta(path: str) -> tuple[int, int]:
    fs, p = open_fs(f"{path}/meta")
    with fs.open_input_stream(p, compression=None) as f:
        buckets, width = map(int, f.read().split())
    return buckets, width


def look_up(path: str, keys: DataFrame) -> DataFrame:
    """keys(id, nth) -> id, nth, shard, offset, n_ids of those in the store."""
    buckets, _ = read_meta(path)
    schema = "id long, nth long, shard int, offset long, n_ids long"

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, nth = pdf["id"].to_numpy(np.int64), pdf["nth"].to_numpy(np.int64)
        fs, p = open_fs(uri := f"{path}/index-{int(pdf['bucket'].iloc[0]):06d}.mph")
        if fs.get_file_info(p).type.name == "NotFound":
            return pd.DataFrame(columns=["id", "nth", "shard", "offset", "n_ids"]).astype("int64")
        found, *columns = Bucket(uri).lookup(ids, nth)
        return pd.DataFrame({"id": ids, "nth": nth, **dict(zip(("shard", "offset", "n_ids"), columns, strict=True))})[found]

    bucketed = keys.select("id", "nth", F.pmod(F.xxhash64("id", "nth"), F.lit(buckets)).alias("bucket"))
    return bucketed.groupBy("bucket").applyInPandas(find, schema)


def read_documents(path: str, places: DataFrame, with_ids: bool = False) -> DataFrame:
    """places(id, nth, shard, offset, n_ids) -> the same with ids_crc32, and ids if wanted, read from the shards."""
    _, width = read_meta(path)
    spark = places.sparkSession

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, reader = None, None
        for pdf in batches:
            crcs, ids = [], []
            for s, at, n in zip(pdf["shard"], pdf["offset"], pdf["n_ids"], strict=True):
                if s != shard:
                    if reader:
                        reader.close()
                    shard, reader = s, RangeReader(f"{path}/shard-{s:06d}.ids")
                got = np.frombuffer(reader.read(int(at) * width, int(n) * width), f"<u{width}").astype("<u4")
                crcs.append(zlib.crc32(got.tobytes()))
                ids.append(got.astype(np.int64))
            pdf["ids_crc32"] = np.array(crcs, np.int64)
            if with_ids:
                pdf["ids"] = ids
            yield pdf
        if reader:
            reader.close()

    schema = "id long, nth long, shard int, offset long, n_ids long, ids_crc32 long" + ", ids array<long>" * with_ids
    ordered = places.repartitionByRange(shuffle_partitions(spark), "shard", "offset").sortWithinPartitions("shard", "offset")
    return ordered.mapInPandas(read, schema)


def stored_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """Writes docs, then finds each by key and reads it back: doc_id, start, n_tokens, ids_crc32."""
    path, shards = write_store(docs, tokenizer_path, end_id)
    keys = (
        docs.groupBy(node_id(F.col("doc_id")).alias("id")).agg(F.count(F.lit(1)).alias("n"))
        .select("id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("nth"))
    )
    found = read_documents(path, look_up(path, keys))
    return found.join(shards.select("shard", "start"), "shard").select(
        F.when(F.col("id") != NULL_ID, F.col("id")).alias("doc_id"),
        (F.col("start") + F.col("offset")).alias("start"), F.col("n_ids").alias("n_tokens"), "ids_crc32",
    )

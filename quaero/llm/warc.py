"""Dictionary-compressed WARC archives (.warc.zst).

Every partition writes one archive. A Zstandard dictionary is built from the
first records of the archive, up to SAMPLE_BYTES, and put in a skippable frame
at the start (magic number 0x184D2A5D); each record is then a frame of its own
that the dictionary helps to compress, so records can be read singly. Payloads
seen before are written as revisit records that name the response.

Defined results: null html is an empty payload; a null url gives a record
without a target; a null page_id sorts after all others and is written as
"null"; rows repeated with their page_id are records each, and one of them is
the response; an empty table gives no archives and an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .files import open_fs, whole_file
from .shared import new_path, shuffle_partitions, written

DICT_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
SAMPLE_BYTES = 4 << 20
DICT_BYTES = 1 << 16
LEVEL = 6
LAST_ID = (1 << 63) - 1
DATE = "2024-01-01T00:00:00Z"

# ---------------------------------------------------------------- records


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_uri(page_id: int | None) -> str:
    return f"urn:page:{'null' if page_id is None else page_id}"


def page_of(uri: str) -> int | None:
    name = uri.strip("<>").rpartition(":")[2]
    return None if name == "null" else int(name)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str = DATE) -> bytes:
    """One WARC/1.1 record. A revisit keeps the HTTP head, with the payload's length, and leaves out the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{record_uri(page_id)}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.insert(3, f"WARC-Target-URI: {quote(url, safe='%/:=&?~#+!$,;@()*[]|\"<>^`{}\\' + chr(39))}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{record_uri(refers_to)}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers, HTTP head and payload of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    n = int(fields["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    http, _, payload = rest[:n].partition(b"\r\n\r\n")
    return fields, http, payload


def http_length(http: bytes) -> int:
    for line in http.split(b"\r\n"):
        k, _, v = line.partition(b":")
        if k.lower() == b"content-length":
            return int(v)
    raise ValueError("no Content-Length")


# ---------------------------------------------------------------- archives


class ArchiveWriter:
    """Holds back the first records until there are enough to build a dictionary."""

    def __init__(self, out, sample_bytes: int = SAMPLE_BYTES, dict_bytes: int = DICT_BYTES, level: int = LEVEL):
        self.out, self.sample_bytes, self.dict_bytes, self.level = out, sample_bytes, dict_bytes, level
        self.held: list[bytes] = []
        self.held_bytes = 0
        self.compressor = None

    def add(self, raw: bytes) -> None:
        if self.compressor:
            self.out.write(self.compressor.compress(raw))
            return
        self.held.append(raw)
        self.held_bytes += len(raw)
        if self.held_bytes >= self.sample_bytes:
            self.start()

    def start(self) -> None:
        import zstandard as zstd

        trained = self.train(zstd)
        if trained:
            raw = trained.as_bytes()
            self.out.write(struct.pack("<II", DICT_MAGIC, len(raw)) + raw)
        self.compressor = zstd.ZstdCompressor(level=self.level, dict_data=trained, write_content_size=True, write_checksum=True)
        for r in self.held:
            self.out.write(self.compressor.compress(r))
        self.held = []

    def train(self, zstd):
        """A dictionary, or the held records' own bytes where they are too few to train one, or none."""
        if not self.held:
            return None
        samples = [r[: self.dict_bytes] for r in self.held]
        size = min(self.dict_bytes, max(256, self.held_bytes // 8))
        try:
            return zstd.train_dictionary(size, samples)
        except zstd.ZstdError:
            raw = b"".join(samples)[-size:]
            return zstd.ZstdCompressionDict(raw, dict_type=zstd.DICT_TYPE_RAWCONTENT) if len(raw) >= 8 else None

    def close(self) -> None:
        if not self.compressor and self.held:
            self.start()


def read_archive(source, block: int = 1 << 20) -> Iterator[bytes]:
    """The records of an archive, one frame each, read as a stream."""
    import zstandard as zstd

    held = b""
    dictionary = None

    def more() -> bool:
        nonlocal held
        got = source.read(block)
        held += got
        return bool(got)

    decompressor = zstd.ZstdDecompressor()
    while True:
        while len(held) < 8 and more():
            pass
        if not held:
            return
        magic, size = struct.unpack_from("<II", held)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            while len(held) < 8 + size:
                if not more():
                    raise ValueError("the archive ends in a skippable frame")
            if magic == DICT_MAGIC and dictionary is None:
                dictionary = zstd.ZstdCompressionDict(held[8 : 8 + size])
                decompressor = zstd.ZstdDecompressor(dict_data=dictionary)
            held = held[8 + size :]
            continue
        if magic != FRAME_MAGIC:
            raise ValueError("not a Zstandard frame")
        obj, parts = decompressor.decompressobj(), []
        while True:
            parts.append(obj.decompress(held))
            if obj.eof:
                held = obj.unused_data
                break
            held = b""
            if not more():
                raise ValueError("the archive ends in a record")
        yield b"".join(parts)


# ---------------------------------------------------------------- jobs


def write_archives(pages: DataFrame, min_revisit_bytes: int = 0, path: str | None = None) -> DataFrame:
    """pages(page_id, url, html) -> the archives written: (path, n). Equal payloads of at least
    min_revisit_bytes have one response, that with the smallest page_id; the others revisit it."""
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    rows = pages.select(
        F.coalesce(F.col("page_id").cast("long"), F.lit(LAST_ID)).alias("page_id"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")
    ).withColumn("same", F.sha2("payload", 256))
    groups = rows.filter(F.octet_length("payload") >= min_revisit_bytes).groupBy("same").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    groups = written(groups.filter("n > 1").select("same", "first_id"), "equal-payloads")
    plan = rows.join(groups, "same", "left")
    # The response among rows that repeat the smallest page_id: the first by url.
    first = F.col("page_id") == F.col("first_id")
    twice = rows.join(groups, (rows["same"] == groups["same"]) & (rows["page_id"] == groups["first_id"]), "left_semi").groupBy("same").count().filter("count > 1")
    if twice.limit(1).count():
        at = plan.filter(first).withColumn("nth", F.row_number().over(Window.partitionBy("same").orderBy("url")))
        plan = plan.filter(~F.coalesce(first, F.lit(False))).withColumn("nth", F.lit(1)).unionByName(at)
    else:
        plan = plan.withColumn("nth", F.lit(1))
    revisit = F.col("first_id").isNotNull() & (~first | (F.col("nth") > 1))
    plan = plan.select("page_id", "url", "payload", F.when(revisit, F.col("first_id")).alias("refers_to"), F.coalesce(revisit, F.lit(False)).alias("revisit"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        uri, n = f"{path}/part-{TaskContext.get().partitionId():06d}.warc.zst", 0
        with whole_file(uri) as f:
            archive = ArchiveWriter(f)
            for pdf in batches:
                for page_id, url, payload, ref, again in zip(pdf["page_id"], pdf["url"], pdf["payload"], pdf["refers_to"], pdf["revisit"], strict=True):
                    archive.add(record(None if page_id == LAST_ID else int(page_id), url, payload, payload_digest(payload), _id(ref), bool(again)))
                    n += 1
            archive.close()
        yield pd.DataFrame({"path": [uri], "n": [n]})

    plan = plan.withColumn("refers_to", F.col("refers_to").cast("string"))
    return written(plan.mapInPandas(write, "path string, n long"), "archives")


def _id(text) -> int | None:
    return int(text) if isinstance(text, str) and int(text) != LAST_ID else None


def read_archives(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """archives(path) -> one row per record: page_id, url, payload_bytes, payload_digest, record_type, refers_to."""
    spark = archives.sparkSession

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * with_payload
        for pdf in batches:
            for uri in pdf["path"]:
                fs, p = open_fs(uri)
                with fs.open_input_stream(p, compression=None) as f:
                    out, held = [], 0
                    for raw in read_archive(f):
                        fields, http, payload = parse(raw)
                        n, digest, kind = http_length(http), fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
                        if kind == "response" and (len(payload) != n or payload_digest(payload) != digest):
                            raise ValueError(f"the payload of {fields['warc-record-id']} is damaged")
                        ref = fields.get("warc-refers-to")
                        row = (page_of(fields["warc-record-id"]), n, digest, kind, page_of(ref) if ref else None)
                        out.append((*row, payload) if with_payload else row)
                        held += len(payload) if with_payload else 100
                        if held > 8 << 20:
                            yield _frame(out, columns)
                            out, held = [], 0
                    yield _frame(out, columns)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    return archives.filter("n > 0").select("path").repartition(shuffle_partitions(spark)).mapInPandas(read, schema)


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=columns)
    for c in ("page_id", "refers_to"):
        out[c] = pd.array([r[columns.index(c)] for r in rows], dtype="Int64")
    return out


SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h FROM pages),
s AS (
  SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS same, sha1(h) AS hex FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST(((CAST('0x' || substr(hex, CAST((i // 4) * 5 + 1 AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) + 1 AS INT), 1)), '') AS payload_digest,
       CASE WHEN row_number() OVER g = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN row_number() OVER g > 1 THEN first_value(page_id) OVER g END AS refers_to
FROM s WINDOW g AS (PARTITION BY same ORDER BY page_id)
"""

"""Plain-text documents: read from files, cut into pages, addressed by content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

JOINT = "\n\f\n"


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, size, text of every file under path that is not empty; bytes that are no UTF-8 become the replacement character."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("size"), F.decode("content", "UTF-8").alias("text"))


def pages(text: Column) -> Column:
    """The parts between form feeds, each with one kind of line end."""
    return F.transform(F.split(text, "\f", -1), lambda p: F.replace(p, F.lit("\r\n"), F.lit("\n")))


def joined(parts: Column) -> Column:
    return F.array_join(parts, JOINT)


def page_starts(parts: Column) -> Column:
    """Where each page starts in the joined text: one pass with a running offset."""
    step = lambda s, p: F.struct((s["at"] + F.length(p) + len(JOINT)).alias("at"), F.array_append(s["out"], s["at"]).alias("out"))
    return F.aggregate(parts, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out")), step, lambda s: s["out"])


def store_path(sha: Column, mime: Column) -> Column:
    """Where an upload lies in the content-addressed store."""
    return F.concat(F.lit("documents/"), F.left(sha, F.lit(2)), F.lit("/"), sha, F.when(mime == "text/plain", ".txt").otherwise(".pdf"))

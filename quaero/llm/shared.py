"""What several operators of this subpackage need: the shared folder, written
tables, id sentinels and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the contracts, as a Java/RE2 character class body.
WS = r"\x20\x09-\x0D"
#: Stands for a null id while rows are grouped; mapped back at the end.
NULL_ID = -(1 << 63)

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    A local folder is made only where the session names none and all runs in
    one process, as in tests: on a cluster executors would not see it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="quaero-")
    return _own_dirs[app]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage, and a lost
    executor costs nothing that was computed before."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """What is planned inside sends Python at most so many rows at a time: whole texts may be long, and two tasks of an
    executor hold a batch each, in the JVM and in Python."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Scratch:
    """The tables that one operator writes. What its result does not read is
    removed when the operator has planned it, so runs leave nothing behind but
    the few tables that their lazy results still need."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: list[tuple[DataFrame, str]] = []

    def written(self, df: DataFrame, label: str) -> DataFrame:
        path = new_path(self.spark, label)
        with small_batches(self.spark):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((out, path))
        return out

    def drop(self, *done: DataFrame) -> None:
        """Removes tables that nothing reads any more."""
        self.keep(*(df for df, _ in self.tables if not any(df is x for x in done)))

    def keep(self, *needed: DataFrame) -> None:
        """Removes every table but those needed."""
        left = []
        for df, path in self.tables:
            if any(df is x for x in needed):
                left.append((df, path))
            else:
                remove(self.spark, path)
        self.tables = left


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like those given that df does not have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def node_id(col: Column) -> Column:
    """An id that is never null, for grouping."""
    return F.coalesce(col.cast("long"), F.lit(NULL_ID))


def from_node_id(col: Column) -> Column:
    return F.when(col != NULL_ID, col)


def n_words(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+``; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"[^{WS}]+")).cast("long")


def small_side(df: DataFrame, rows: int, row_bytes: int, limit_mb: int = 16) -> DataFrame:
    """Broadcast only below a checked size; Spark picks the join otherwise."""
    return F.broadcast(df) if rows * row_bytes <= limit_mb << 20 else df


def connected_components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(a, b) long links -> (id, component): the smallest id that is reachable.

    Every round takes the smallest label among the neighbours and then jumps
    to that label's own label; both joins are plain equi-joins, broadcast only
    while the labels are few, and split by adaptive execution at a hot id
    beyond; the minimum is combined before it is shuffled. Labels are written to the shared folder each round, and the round
    before is removed. Only whether a label changed reaches the driver. Labels
    never rise and some label falls in every round but the last, so it ends.
    """
    own = Scratch(edges.sparkSession)
    both = own.written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "both-ways")
    labels = own.written(
        both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component")),
        "labels",
    )
    n = labels.count()
    while True:
        near = (
            both.join(small_side(labels.select(F.col("id").alias("b"), "component"), n, 40), "b")
            .groupBy(F.col("a").alias("id"))
            .agg(F.min("component").alias("near"))
        )
        stepped = near.join(small_side(labels, n, 40), "id").select(
            "id", F.col("component").alias("was"), F.least("component", "near").alias("label")
        )
        jump = labels.select(F.col("id").alias("label"), F.col("component").alias("jumped"))
        table = own.written(
            stepped.join(small_side(jump, n, 40), "label").select("id", "was", F.least("label", "jumped").alias("component")), "labels"
        )
        changed = table.filter("component <> was").limit(1).count()
        own.keep(both, table) if changed else own.keep(table)
        labels = table.select("id", "component")
        if not changed:
            if scratch:
                scratch.tables += own.tables
            return labels


def contracted(now: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """now(id, component), more (a, b) links -> (id, component): the components that these links join too.

    Only links between different components count, and of these one for each two components. Ids that now has not are components of their own.
    """
    of = lambda x: now.select(F.col("id").alias(x), F.col("component").alias(f"c{x}"))
    ends = [F.coalesce(f"c{x}", x) for x in "ab"]
    roots = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.least(*ends).alias("a"), F.greatest(*ends).alias("b"))
    roots = scratch.written(roots.filter("a <> b").distinct(), "roots")
    if not roots.limit(1).count():
        scratch.drop(roots)
        return now
    up = connected_components(roots, scratch)
    moved = now.join(up.select(F.col("id").alias("component"), F.col("component").alias("to")), "component", "left").select("id", F.coalesce("to", "component").alias("component"))
    out = scratch.written(moved.unionByName(up.join(now.select("id"), "id", "left_anti")), "labels")
    scratch.drop(roots)
    return out

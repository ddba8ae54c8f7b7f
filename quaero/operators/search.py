"""Faceted search: disjunctive facets, paging and score normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fail_mask(selected: dict[str, list], values: dict[str, Column]) -> Column:
    """Bit i is set if dimension i has a selection that the row's values miss; values may be arrays."""
    mask = F.lit(0)
    for i, (dim, wanted) in enumerate(selected.items()):
        if wanted:
            mask = mask + F.when(F.arrays_overlap(values[dim], F.array(*map(F.lit, wanted))), 0).otherwise(1 << i)
    return mask


def facets(df: DataFrame, values: dict[str, Column], selected: dict[str, list]) -> DataFrame:
    """dim, value, n: rows that pass every other dimension's selection. One pass: each row's failed
    dimensions are a bitmask, and a row counts for a dimension if it fails nothing but that."""
    masked = df.select(fail_mask(selected, values).alias("_m"), *[v.alias(d) for d, v in values.items()])
    each = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(d).alias("dim"), F.transform(d, lambda x: x.cast("string")).alias("vs")) for i, d in enumerate(values)])
    rows = masked.select("_m", F.explode(each).alias("e")).filter(F.expr("(_m & ~shiftleft(1, e.i)) = 0"))
    return rows.select("e.dim", F.explode(F.array_distinct("e.vs")).alias("value")).groupBy("dim", "value").agg(F.count(F.lit(1)).alias("n"))


def page(df: DataFrame, score: str, tie: str, number: int, size: int) -> DataFrame:
    """One page of the rows in order, with rank, relevance = min(1, score / top), total and total_pages.

    The page number is clamped into what there is. Only the rows up to the
    page's end are ever sorted out (a top-k), and only counts are shared.
    """
    stats = df.agg(F.count(F.lit(1)).alias("total"), F.max(score).alias("_top"))
    stats = stats.withColumn("total_pages", F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("long"))
    first = df.orderBy(F.desc(score), tie).limit(number * size)
    ranked = first.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), tie)))
    out = ranked.crossJoin(F.broadcast(stats)).withColumn("page", F.least(F.lit(number), F.col("total_pages")))
    keep = (F.col("rank") > (F.col("page") - 1) * size) & (F.col("rank") <= F.col("page") * size)
    return out.filter(keep).withColumn("relevance", F.least(F.lit(1.0), F.col(score) / F.col("_top"))).drop("_top")


def impact(count: Column) -> Column:
    return F.log10(count + 1) / 3


def browse_score(count: Column, year: Column) -> Column:
    return impact(count) * 20 + year / 1000

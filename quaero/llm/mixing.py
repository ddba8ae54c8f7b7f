"""Mixing sources to target weights by pivotal dependent rounding.

A source's target is its weight's share of all words, at most MAX_REPEATS
times what it has; what is over goes to the others by weight. Each document of
a source should be taken target / source_size times on average: the whole part
is certain, the fractional part is a copy probability. Probabilities are
rounded in pairs: the survivor of the earlier pairs meets the next document,
and words move from one to the other at random (so that nobody's expectation
changes) until one of the two is at 0 or 1. The moved mass is counted in
words, so the sum of words is kept exactly. Groups of bounded size do this by
themselves; the one fractional document that each leaves goes up a reduction
tree, level by level, until a source has one left. That one goes to its nearer
end, and smaller documents of the last group make good what this moved.

Rows stay in DataFrame expressions throughout. Random numbers are hashes of
the seed, the level and the documents met, so reruns agree.

Defined results: a null text has size 0 and is neither taken nor dropped by
weight (it is copied as its source's ratio says, at no words); a null source
is a source, last in order; rows repeated with their doc_id, source and size
are one document with that many rows, rounded together (each row gets an equal
share); an empty table gives an empty result; extra columns are ignored by mix
and kept, whatever their names, by repeat_rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, n_words, unused

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
GROUP = 64


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """sizes(source, size) -> source, source_size, target: one row per source.

    With sources in the order of cap / weight, those that reach their cap come
    first: source k is capped if its cap is no more than its share of what the
    sources before it leave.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_docs"))
    w = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, len(weights)).cast("int") + 1)
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    ranked = per.withColumn("weight", w.cast("double")).withColumn("cap", (max_repeats * F.col("source_size")).cast("double"))
    left_over = F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    return (
        ranked.withColumn("level", left_over / F.sum("weight").over(after))
        .withColumn("place", F.row_number().over(order))
        .withColumn("free", F.min(F.when(F.col("cap") > F.col("level") * F.col("weight"), F.struct("place", "level"))).over(whole))
        .withColumn("target", F.when(F.col("place") >= F.col("free.place"), F.col("free.level") * F.col("weight")).otherwise(F.col("cap")))
        .select("source", "source_size", "source_docs", "target")
    )


def _round_groups(rows: DataFrame, level: int, seed: int) -> DataFrame:
    """rows(source, grp, key, mass, p) -> source, key, mass, p, with all but one p of a group at 0 or 1.

    State of the fold: the survivor s and the settled documents. u decides
    which way words move; a and b are the two amounts that could.
    """
    eps = 1e-9
    step = f"""(st, d) -> CASE
      WHEN st.s IS NULL THEN named_struct('s', d, 'done', st.done)
      WHEN d.p < {eps} OR d.p > 1 - {eps} OR d.mass = 0 THEN named_struct('s', st.s, 'done', array_append(st.done, d))
      ELSE transform(array(named_struct(
          'up', least((1 - st.s.p) * st.s.mass, d.p * d.mass),
          'down', least(st.s.p * st.s.mass, (1 - d.p) * d.mass),
          'u', pmod(xxhash64({seed}, {level}, st.s.key, d.key), 1000003) / 1000003D)), m ->
        transform(array(IF(m.u * (m.up + m.down) < m.down, m.up, -m.down)), move ->
          transform(array(named_struct('s', named_struct('mass', st.s.mass, 'key', st.s.key, 'p', st.s.p + move / st.s.mass),
                                       'd', named_struct('mass', d.mass, 'key', d.key, 'p', d.p - move / d.mass))), x ->
            IF(x.s.p < {eps} OR x.s.p > 1 - {eps},
               named_struct('s', x.d, 'done', array_append(st.done, named_struct('mass', x.s.mass, 'key', x.s.key, 'p', round(x.s.p)))),
               named_struct('s', x.s, 'done', array_append(st.done, named_struct('mass', x.d.mass, 'key', x.d.key, 'p', IF(x.d.p < {eps} OR x.d.p > 1 - {eps}, round(x.d.p), x.d.p)))))
          )[0])[0])[0]
      END"""
    item = "struct<mass: double, key: string, p: double>"
    # Where the group is all that is left of a source: the fractional document goes to the nearer end, and
    # settled ones that are small enough change sides, largest first, until what that moved is made good.
    settle = f"""st -> transform(array(named_struct('f', st.s, 'r', IF(st.s.p < 0.5, st.s.p, st.s.p - 1) * st.s.mass)), g -> array_append(
        aggregate(sort_array(st.done, false), named_struct('r', g.r, 'out', CAST(array() AS array<{item}>)), (b, d) ->
          CASE WHEN d.mass > 0 AND d.mass <= b.r + {eps} AND d.p = 0 THEN named_struct('r', b.r - d.mass, 'out', array_append(b.out, named_struct('mass', d.mass, 'key', d.key, 'p', 1D)))
               WHEN d.mass > 0 AND d.mass <= -b.r + {eps} AND d.p = 1 THEN named_struct('r', b.r + d.mass, 'out', array_append(b.out, named_struct('mass', d.mass, 'key', d.key, 'p', 0D)))
               ELSE named_struct('r', b.r, 'out', array_append(b.out, d)) END, b -> b.out),
        named_struct('mass', g.f.mass, 'key', g.f.key, 'p', IF(g.f.mass > 0, round(g.f.p), g.f.p))))[0]"""
    grouped = rows.groupBy("source", "grp", "groups").agg(F.sort_array(F.collect_list(F.struct("mass", "key", "p")), asc=False).alias("ds"))
    return grouped.select(
        "source",
        F.explode(F.expr(f"aggregate(ds, named_struct('s', CAST(NULL AS {item}), 'done', CAST(array() AS array<{item}>)), {step}, st -> IF(groups > 1, array_append(st.done, st.s), transform(array(st), {settle})[0]))")).alias("d"),
    ).select("source", "d.*")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: int = 20, group: int = GROUP) -> DataFrame:
    """docs(doc_id, text, source) -> doc_id, source, size, source_size, target, copies, taken; one row per row of docs."""
    scratch = Scratch(docs.sparkSession)
    written = scratch.written
    rows = written(
        docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))
        .groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n_rows")),
        "sizes",
    )
    targets = written(
        source_targets(rows.select("source", (F.col("size") * F.col("n_rows")).alias("size")), weights, max_repeats)
        .withColumnRenamed("source", "_source"),
        "targets",
    )
    rated = (
        rows.join(targets, rows["source"].eqNullSafe(targets["_source"])).drop("_source")
        .withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(1.0))
        # Copies over all the rows that a document has; each row gets its share below.
        .withColumn("whole", F.floor(F.col("rate") * F.col("n_rows") + 1e-9))
        .withColumn("p", F.greatest(F.lit(0.0), F.col("rate") * F.col("n_rows") - F.col("whole")))
        .withColumn("key", F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("~")), "size"))
    )
    rated = written(rated, "rated")
    grouping = F.pmod(F.xxhash64(F.lit(seed), F.lit(0), "key"), F.ceil(F.col("source_docs") / group))
    level, settled = 0, []
    left = rated.select("source", grouping.alias("grp"), "key", F.col("size").cast("double").alias("mass"), "p", F.ceil(F.col("source_docs") / group).alias("groups"))
    while True:
        most = left.agg(F.max("groups")).first()[0] or 0
        done = written(_round_groups(left, level, seed), f"level{level}")
        settled.append(done)
        if most <= 1:
            break
        # About one document per group is left over: the next level has that many.
        level += 1
        over = done.filter((F.col("p") > 0) & (F.col("p") < 1) & (F.col("mass") > 0))
        per = over.groupBy(F.col("source").alias("_source")).agg(F.ceil(F.count(F.lit(1)) / group).alias("groups"))
        left = over.join(per, over["source"].eqNullSafe(per["_source"])).select(
            "source", F.pmod(F.xxhash64(F.lit(seed), F.lit(level), "key"), F.col("groups")).alias("grp"), "key", "mass", "p", "groups"
        )
    scratch.keep(rated, *settled)
    fraction = settled[0].select("source", "key", F.col("p").alias("p0"))
    for i, higher in enumerate(settled[1:], 1):
        h = higher.select(F.col("source").alias("_source"), F.col("key").alias("_key"), F.col("p").alias(f"p{i}"))
        fraction = fraction.join(h, fraction["source"].eqNullSafe(h["_source"]) & (fraction["key"] == h["_key"]), "left").drop("_source", "_key")
    coin = F.pmod(F.xxhash64(F.lit(seed), F.lit(-1), "key"), F.lit(1000003)) / 1000003.0
    last = F.coalesce(*[F.col(f"p{i}") for i in range(len(settled) - 1, -1, -1)])
    fraction = fraction.select(F.col("source").alias("_source"), F.col("key").alias("_key"), F.when(coin < last, 1).otherwise(0).alias("extra"))
    total = (
        rated.join(fraction, rated["source"].eqNullSafe(fraction["_source"]) & (rated["key"] == fraction["_key"]))
        .withColumn("total", F.col("whole") + F.col("extra"))
        .withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), "n_rows")))
        .withColumn("copies", (F.floor(F.col("total") / F.col("n_rows")) + (F.col("row") <= F.col("total") % F.col("n_rows")).cast("long")).cast("long"))
    )
    return total.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def repeat_rows(docs: DataFrame, **options) -> DataFrame:
    """docs with each row repeated as often as the mix takes it.

    Nearly every row has a copy number of its own, so texts meet their numbers
    in one shuffle join, whatever the size.
    """
    scratch = Scratch(docs.sparkSession)
    size, copies, the_id, the_source, place, turn = unused(docs, "size", "copies", "the_id", "the_source", "place", "turn")
    mixed = mix(docs.select("doc_id", "text", "source"), **options)
    # A document's rows are alike in all that counts here, so its copies are dealt over them by order.
    per = scratch.written(
        mixed.groupBy(F.col("doc_id").alias(the_id), F.col("source").alias(the_source), F.col("size").alias(size)).agg(
            F.sort_array(F.collect_list("copies"), asc=False).alias(copies)
        ),
        "mix",
    )
    rows = docs.withColumn(size, n_words(F.col("text")))
    joined = rows.join(per.withColumnRenamed(size, f"{size}_").hint("merge"), F.col("doc_id").eqNullSafe(F.col(the_id)) & F.col("source").eqNullSafe(F.col(the_source)) & (F.col(size) == F.col(f"{size}_")))
    one = joined.filter(F.size(copies) == 1).withColumn(turn, F.col(copies)[0])
    out = one
    if per.filter(F.size(copies) > 1).limit(1).count():
        number = F.row_number().over(Window.partitionBy(the_id, the_source, size).orderBy("text"))
        several = joined.filter(F.size(copies) > 1).withColumn(place, number)
        out = one.unionByName(several.withColumn(turn, F.element_at(copies, F.col(place))).drop(place))
    out = out.filter(F.col(turn) > 0)
    return out.withColumn(turn, F.explode(F.sequence(F.lit(1).cast("long"), turn))).select(*docs.columns)

"""Chat formatting by perspective rotation.

A dialogue is rendered once for every participant: that speaker becomes the
assistant, everyone else a user with a name, and the loss mask covers the
assistant's own words. Rows stay in DataFrame expressions throughout.

A rendering can be as long as the dialogue, and one dialogue may hold much of
the table, so renderings are rows of parts: at most PART_TURNS turns each, with
the place (in code points) where the part begins in the whole rendering and
the spans of the mask. Parts in order, joined, are the whole rendering.

Turns are numbered without gathering a dialogue in one task: a range partition
by (dialogue, turn) cuts even a huge one into many; each task numbers its own
turns, and only the numbers of turns per dialogue and partition are added up.

Defined results: a null text is an empty turn; white space of a role is one
space between its words; a null or blank role is "unknown" and takes part like
any other; "<|im_" in a text or role becomes "<| im_", so that no words pass
for a marker of the format; rows without conv_id form one
dialogue; turns that repeat a number keep all rows, ordered by role and text; a
dialogue with one participant is rendered once; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import WS, shuffle_partitions, written

PART_TURNS = 64
HEAD, HEAD_END, TURN_END = "<|im_start|>", "\n", "<|im_end|>\n"
MARKER, PLAIN = "<|im_", "<| im_"


def numbered(turns: DataFrame) -> DataFrame:
    """conv, conv_null, turn, role, text -> the same with place, the turn's number in its dialogue from 0."""
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    cut = turns.repartitionByRange(shuffle_partitions(turns.sparkSession), *order).sortWithinPartitions(*order)
    cut = cut.withColumn("_pid", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    cut = written(cut, "cut-turns")
    per = cut.groupBy("conv_id", "_pid").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("_first"))
    before = Window.partitionBy("conv_id").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    # Rows of a dialogue in one partition are consecutive there, so their numbers are too.
    joined = cut.join(per.select(F.col("conv_id").alias("_c"), F.col("_pid").alias("_p"), "_first", "_before"), F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_pid") == F.col("_p")))
    return joined.withColumn("place", F.col("_before") + F.col("_at") - F.col("_first")).drop("_c", "_p", "_pid", "_at", "_first", "_before")


def rotations(conversations: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """conversations(conv_id, turn, role, text) -> conv_id, assistant, part, n_turns, start, text, mask.

    mask: (start, end) in code points of this part's text that the loss counts,
    the assistant's words and the end of its turn.
    """
    plain = lambda c: F.replace(c, F.lit(MARKER), F.lit(PLAIN))
    role = F.trim(F.regexp_replace("role", f"[{WS}]+", " "))
    turns = conversations.select(
        "conv_id", "turn", plain(F.coalesce(F.when(role != "", role), F.lit("unknown"))).alias("role"), plain(F.coalesce("text", F.lit(""))).alias("text")
    )
    rows = written(numbered(turns), "numbered-turns")
    people = rows.select(F.col("conv_id").alias("_c"), F.col("role").alias("assistant")).distinct()
    seen = rows.withColumn("part", F.floor(F.col("place") / part_turns)).join(people, F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c")
    own = F.col("role") == F.col("assistant")
    head = F.when(own, F.lit(f"{HEAD}assistant{HEAD_END}")).otherwise(F.concat(F.lit(f"{HEAD}user name="), "role", F.lit(HEAD_END)))
    seen = seen.withColumn("head", head).withColumn("own", own)
    packed = seen.groupBy("conv_id", "assistant", "part").agg(
        F.sort_array(F.collect_list(F.struct("place", "head", "text", "own"))).alias("ts"), F.count(F.lit(1)).alias("n_turns")
    )
    tail = len(TURN_END)
    spans = F.expr(
        f"""aggregate(ts, named_struct('at', 0, 'out', CAST(array() AS array<struct<start: int, end: int>>)), (s, t) ->
          named_struct('at', s.at + length(t.head) + length(t.text) + {tail},
            'out', IF(t.own, array_append(s.out, named_struct('start', s.at + length(t.head), 'end', s.at + length(t.head) + length(t.text) + {tail})), s.out)), s -> s.out)"""
    )
    rendered = packed.select(
        "conv_id", "assistant", "part", "n_turns",
        F.array_join(F.transform("ts", lambda t: F.concat(t["head"], t["text"], F.lit(TURN_END))), "").alias("text"), spans.alias("mask"),
    )
    rendered = written(rendered, "parts")
    # Places of parts: lengths only, added up by blocks of parts, so that no task holds all parts of a huge dialogue.
    lengths = rendered.select("conv_id", "assistant", "part", F.floor(F.col("part") / 256).alias("block"), F.length("text").cast("long").alias("chars"))
    keys = ["conv_id", "assistant"]
    blocks = lengths.groupBy(*keys, "block").agg(F.sum("chars").alias("chars"))
    earlier = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("conv_id").alias("_c"), F.col("assistant").alias("_a"), F.col("block").alias("_b"), F.coalesce(F.sum("chars").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy(*keys, "block").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    at = lengths.withColumn("within", F.coalesce(F.sum("chars").over(inside), F.lit(0)))
    at = at.join(blocks, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("assistant") == F.col("_a")) & (F.col("block") == F.col("_b")))
    at = at.select(F.col("conv_id").alias("_c"), F.col("assistant").alias("_a"), F.col("part").alias("_p"), (F.col("base") + F.col("within")).alias("start"))
    return rendered.join(at, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("assistant") == F.col("_a")) & (F.col("part") == F.col("_p"))).select(
        "conv_id", "assistant", "part", "n_turns", "start", "text", "mask"
    )


SQL = f"""
WITH r AS (
  SELECT conv_id, turn, trim(regexp_replace(role, '[{WS}]+', ' ', 'g')) AS role, coalesce(text, '') AS text FROM conversations),
t AS (
  SELECT conv_id, turn, replace(CASE WHEN role <> '' THEN role ELSE 'unknown' END, '{MARKER}', '{PLAIN}') AS role, replace(text, '{MARKER}', '{PLAIN}') AS text
  FROM r),
n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS place FROM t),
p AS (SELECT DISTINCT conv_id, role AS assistant FROM t),
s AS (
  SELECT n.conv_id, p.assistant, n.place, n.place // {PART_TURNS} AS part, n.text, n.role = p.assistant AS own,
         CASE WHEN n.role = p.assistant THEN '{HEAD}assistant' || chr(10) ELSE '{HEAD}user name=' || n.role || chr(10) END AS head
  FROM n JOIN p ON n.conv_id IS NOT DISTINCT FROM p.conv_id),
a AS (
  SELECT *, length(head || text) + {len(TURN_END)} AS chars,
         sum(length(head || text) + {len(TURN_END)}) OVER (PARTITION BY conv_id, assistant, part ORDER BY place) AS until FROM s),
g AS (
  SELECT conv_id, assistant, part, count(*) AS n_turns,
         string_agg(head || text || '<|im_end|>' || chr(10), '' ORDER BY place) AS text,
         sum(CASE WHEN own THEN length(text) + {len(TURN_END)} ELSE 0 END) AS masked_chars,
         string_agg(CAST(CAST(until - chars + length(head) AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(until AS BIGINT) AS VARCHAR), ' ' ORDER BY place) FILTER (WHERE own) AS places,
         count(*) FILTER (WHERE own) AS n_masks
  FROM a GROUP BY ALL)
SELECT conv_id, assistant, CAST(part AS BIGINT) AS part, CAST(n_turns AS BIGINT) AS n_turns,
       CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id, assistant ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
       sha256(text) AS text_sha256, CAST(masked_chars AS BIGINT) AS masked_chars, CAST(n_masks AS BIGINT) AS n_masks,
       sha256(coalesce(places, '')) AS mask_sha256
FROM g
"""

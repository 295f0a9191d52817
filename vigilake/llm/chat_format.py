"""Chat formatting: multi-party perspective rotation.

For every participant of a conversation, the dialogue is rendered with that speaker as the assistant and all others as
named users; the mask covers exactly what the assistant says. System turns belong to nobody and keep their role.

Long conversations are rendered in parts of at most ``TURNS`` turns, so no row grows with the data. A turn's place in
its conversation comes from a range partitioning over (conversation, turn, speaker, text, place in the input), which
splits a hot conversation over many tasks, a row number inside each range, and the row counts of the ranges before it.

Defined results: turns are ordered by number, then speaker, then text; repeated rows are turns of their own. A null
turn comes first, a null speaker is "unknown", a null text is empty. Rows with a null conversation form one
conversation. A conversation of system turns alone has no participant and gives no row. Extra columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vigilake.llm.common import let, stash, table

TURNS = 64
SYSTEM = "system"


def places(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``rows`` with ``_place``: 0, 1, 2 ... within ``key`` by ``order``; no key is sorted in one task."""
    tagged = rows.withColumn("_input", F.monotonically_increasing_id())
    ranged = stash(tagged.repartitionByRange(key, *order, "_input").withColumn("_range", F.spark_partition_id()), "ranges")
    inside = W.partitionBy("_range", key).orderBy(*order, "_input")
    before = W.partitionBy(key).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    counts = ranged.groupBy(key, "_range").agg(F.count("*").alias("_n"))
    starts = counts.select(key, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    same = F.col("a._range") == F.col("b._range")
    return (
        ranged.withColumn("_inside", F.row_number().over(inside)).alias("a")
        .join(starts.alias("b"), same & F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}")))
        .select("a.*", (F.col("_start") + F.col("_inside") - 1).alias("_place")).drop("_inside", "_range", "_input")
    )


def segment(speaker: Column, perspective: Column, body: Column) -> Column:
    """(head, body, tail) of a turn as text."""
    head = (
        F.when(speaker == perspective, F.lit("<|im_start|>assistant\n"))
        .when(speaker == SYSTEM, F.lit("<|im_start|>system\n"))
        .otherwise(F.concat(F.lit("<|im_start|>user name="), F.regexp_replace(speaker, r"[\s<>|]+", "_"), F.lit("\n")))
    )
    return F.struct(head.alias("head"), body.alias("body"), F.lit("<|im_end|>\n").alias("tail"), (speaker == perspective).alias("own"))


def render(turns: Column, perspective: Column) -> Column:
    """(text, masks): masks are [start, end) of the assistant's words, closing mark included, in code points."""

    def put_together(parts: Column) -> Column:
        text = F.array_join(F.transform(parts, lambda p: F.concat(p["head"], p["body"], p["tail"])), "")
        start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("masks"))

        def step(acc: Column, p: Column) -> Column:
            begin = acc["at"] + F.length(p["head"])
            mask = F.struct(begin.alias("start"), (begin + F.length(p["body"]) + F.length(F.lit("<|im_end|>"))).alias("end"))
            return F.struct(
                (begin + F.length(p["body"]) + F.length(p["tail"])).alias("at"),
                F.when(p["own"], F.concat(acc["masks"], F.array(mask))).otherwise(acc["masks"]).alias("masks"),
            )

        return F.struct(text.alias("text"), F.aggregate(parts, start, step, lambda a: a["masks"]).alias("masks"))

    return let(F.transform(turns, lambda t: segment(t["speaker"], perspective, t["text"])), put_together)


def rotate(
    conversations: DataFrame, conversation: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text", turns: int = TURNS
) -> DataFrame:
    """(conversation, part, perspective, n_turns, text, masks): one row per participant and part of a conversation."""
    rows = conversations.select(
        F.col(conversation).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(speaker), F.lit("unknown")).alias("speaker"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    placed = places(rows, "conv", ["turn", "speaker", "text"])
    one = F.struct("_place", "speaker", "text")
    parts = (
        placed.withColumn("part", F.floor(F.col("_place") / turns))
        .groupBy("conv", "part").agg(F.array_sort(F.collect_list(one)).alias("_turns"))
    )
    people = rows.filter(F.col("speaker") != SYSTEM).select(F.col("conv").alias("_conv"), F.col("speaker").alias("perspective")).distinct()
    return (
        parts.join(people, F.col("conv").eqNullSafe(F.col("_conv")))
        .select("conv", "part", "perspective", F.size("_turns").alias("n_turns"), render(F.col("_turns"), F.col("perspective")).alias("_r"))
        .select(F.col("conv").alias(conversation), "part", "perspective", F.col("n_turns").cast("long").alias("n_turns"), "_r.text", "_r.masks")
    )


#: Conversations of up to TURNS turns, as the given ones are, make one part; the SQL takes longer ones apart likewise.
ROTATE_SQL = f"""
WITH placed AS (
  SELECT conv_id, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) - 1 AS place
  FROM conversations
), people AS (
  SELECT DISTINCT conv_id, speaker AS perspective FROM placed WHERE speaker <> '{SYSTEM}'
), segments AS (
  SELECT p.conv_id, p.place, p.place // {TURNS} AS part, q.perspective, p.speaker = q.perspective AS own, p.text,
         CASE WHEN p.speaker = q.perspective THEN '<|im_start|>assistant' || chr(10)
              WHEN p.speaker = '{SYSTEM}' THEN '<|im_start|>system' || chr(10)
              ELSE '<|im_start|>user name=' || regexp_replace(p.speaker, '[\\s<>|]+', '_', 'g') || chr(10) END AS head
  FROM placed p JOIN people q ON p.conv_id IS NOT DISTINCT FROM q.conv_id
), lengths AS (
  SELECT *, sum(length(head) + length(text) + 11) OVER (PARTITION BY conv_id, part, perspective ORDER BY place) - length(text) - 11 AS begin
  FROM segments
)
SELECT conv_id, CAST(part AS BIGINT) AS part, perspective, count(*) AS n_turns,
       sha256(string_agg(head || text || '<|im_end|>' || chr(10), '' ORDER BY place)) AS text_sha256,
       coalesce(string_agg(CASE WHEN own THEN CAST(begin AS BIGINT) || ':' || CAST(begin + length(text) + 10 AS BIGINT) END, ',' ORDER BY place), '') AS masks
FROM lengths GROUP BY 1, 2, 3
"""


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rotate(table(spark, sf_dir, "conversations"))
    spans = F.transform("masks", lambda m: F.concat_ws(":", m["start"].cast("string"), m["end"].cast("string")))
    return out.select("conv_id", "part", "perspective", "n_turns", F.sha2("text", 256).alias("text_sha256"), F.concat_ws(",", spans).alias("masks"))

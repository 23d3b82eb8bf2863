"""Chat formatting with the perspective rotated over the participants.

Every speaker of a conversation but `system` gets a rendering of the whole
dialogue in which that speaker is the assistant and all others are named users;
the loss mask covers what the assistant says and the mark that ends it. A
rendering is stored as rows, one a turn, each with its place in the whole, so
that a conversation of any length needs no task that holds it all.

Defined cases: null role is a speaker `unknown`; speakers of one conversation whose
names are equal once other characters than letters, digits, `_`, `.` and `-` are `_`
have `~` and the bytes of the role in hex after the name, but for the one that is the
name itself; null text is empty, a null turn
comes first; rows without conversation are left out; turns with the same number
follow each other by speaker and text; repeated rows are turns of their own; a
conversation with none but system turns has no rendering; control marks inside a
text are broken up; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Turn numbers that share a partial sum of lengths.
CHUNK = 256
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def rotate(conversations: DataFrame) -> DataFrame:
    """conv_id, perspective, turn, speaker, segment, start, length, mask_start and mask_length (code points; -1 and 0 outside the mask)."""
    name = F.regexp_replace(F.coalesce("role", F.lit("unknown")), "[^A-Za-z0-9_.-]", "_")
    said = F.replace(F.coalesce("text", F.lit("")), F.lit("<|im_"), F.lit("< |im_"))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn", "role", name.alias("name"), said.alias("said"), F.floor(F.coalesce(F.col("turn").cast("long"), F.lit(-1)) / CHUNK).cast("long").alias("chunk")
    )
    # Roles of one conversation that share a name are told apart by their bytes; the one that is the name itself keeps it.
    roles = turns.select("conv_id", "role", "name").distinct()
    shared = roles.groupBy("conv_id", "name").agg(F.count("*").alias("sharing")).where("sharing > 1")
    other = F.col("sharing").isNotNull() & ~F.col("role").eqNullSafe(F.col("name"))
    speaker = F.when(other, F.concat("name", F.lit("~"), F.hex(F.coalesce("role", F.lit(""))))).otherwise(F.col("name"))
    turns = turns.join(shared, ["conv_id", "name"], "left").select("conv_id", "turn", speaker.alias("speaker"), "said", "chunk")
    speakers = turns.where("speaker <> 'system'").select("conv_id", F.col("speaker").alias("perspective")).distinct()
    mine = F.col("speaker") == F.col("perspective")
    head = F.when(F.col("speaker") == "system", F.lit(OPEN + "system\n")).when(mine, F.lit(OPEN + "assistant\n")).otherwise(F.concat(F.lit(OPEN + "user name="), "speaker", F.lit("\n")))
    rows = (
        turns.join(speakers, "conv_id")
        .select("conv_id", "perspective", "turn", "chunk", "speaker", F.length(head).cast("long").alias("head_length"), F.concat(head, "said", F.lit(CLOSE)).alias("segment"), mine.alias("mine"))
        .withColumn("length", F.length("segment").cast("long"))
    )
    # Where a chunk begins: sums of whole chunks, of which a conversation has few.
    sums = rows.groupBy("conv_id", "perspective", "chunk").agg(F.sum("length").alias("n"))
    before = Window.partitionBy("conv_id", "perspective").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    begins = sums.select("conv_id", "perspective", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begins"))
    within = Window.partitionBy("conv_id", "perspective", "chunk").orderBy("turn", "speaker", "segment").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum("length").over(within), F.lit(0))).join(begins, ["conv_id", "perspective", "chunk"])
    start = F.col("begins") + F.col("inside")
    return placed.select(
        "conv_id", "perspective", "turn", "speaker", "segment", start.alias("start"), "length",
        F.when(F.col("mine"), start + F.col("head_length")).otherwise(F.lit(-1)).cast("long").alias("mask_start"),
        F.when(F.col("mine"), F.col("length") - F.col("head_length") - 1).otherwise(F.lit(0)).cast("long").alias("mask_length"),
    )


def op6_chat_format(spark, sf_dir):
    return rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE = r"""
WITH c AS (
  SELECT *, regexp_replace(coalesce(role, 'unknown'), '[^A-Za-z0-9_.-]', '_', 'g') AS name FROM conversations WHERE conv_id IS NOT NULL
), k AS (
  SELECT conv_id, name, count(*) AS sharing FROM (SELECT DISTINCT conv_id, role, name FROM c) GROUP BY conv_id, name
), t AS (
  SELECT c.conv_id, turn, CASE WHEN sharing > 1 AND role IS DISTINCT FROM c.name THEN c.name || '~' || hex(coalesce(role, '')) ELSE c.name END AS speaker,
    replace(coalesce(text, ''), '<|im_', '< |im_') AS said FROM c JOIN k ON c.conv_id = k.conv_id AND c.name = k.name
), p AS (
  SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'
), r AS (
  SELECT t.*, perspective, '<|im_start|>' || CASE WHEN speaker = 'system' THEN 'system'
    WHEN speaker = perspective THEN 'assistant' ELSE 'user name=' || speaker END || chr(10) AS head
  FROM t JOIN p USING (conv_id)
), s AS (
  SELECT *, head || said || '<|im_end|>' || chr(10) AS segment FROM r
), q AS (
  SELECT *, coalesce(sum(length(segment)) OVER (PARTITION BY conv_id, perspective
    ORDER BY turn NULLS FIRST, speaker, segment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM s
)
SELECT conv_id, perspective, turn, speaker, segment, start, length(segment)::BIGINT AS length,
  CASE WHEN speaker = perspective THEN start + length(head) ELSE -1 END::BIGINT AS mask_start,
  CASE WHEN speaker = perspective THEN length(segment) - length(head) - 1 ELSE 0 END::BIGINT AS mask_length
FROM q
"""

"""Chat formatting by perspective rotation.

A dialogue of several parties is rendered once for each participant: that speaker's turns are the
assistant's, all others are users with their names, and the loss mask covers what the assistant
says. The result is a row per dialogue, perspective and turn, with the segment's text and its
character span in the whole rendering, so that a dialogue of any length is never gathered in one
task: offsets come from sums of blocks of turns first, then within blocks. What a speaker says can
forge no border: marks in names and texts are escaped, and names hold no line breaks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.llm.common import materialize, table

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: What marks begin with, and what is written in its place where a name or text has it.
MARK, ESCAPED = "<|im_", "<\\|im_"
#: Turns of a block, by turn number.
BLOCK_TURNS = 256


def rotate(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block_turns: int = BLOCK_TURNS) -> DataFrame:
    """conv_id, perspective, turn, speaker, segment, start, length, mask_start, mask_end.

    start is the segment's first character in the rendering, mask_start to mask_end the part of the
    rendering that the loss counts: the assistant's words and the closing mark; both null on turns of
    others. Participants are the distinct roles that are not null; a turn without a role is an
    unnamed user's, and a dialogue of such turns only has no perspective. Turns follow their number,
    nulls first; of equal numbers, speaker, then text, decide, and rows equal in all count each. Null
    text is empty; texts of any length are rendered whole. Marks in names and texts are escaped by a backslash, line breaks in names become
    spaces. A null conversation key is one dialogue. Other columns are not looked at; an empty
    table gives an empty table.
    """
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("speaker"), F.replace(F.coalesce(F.col(text), F.lit("")), F.lit(MARK), F.lit(ESCAPED)).alias("text"))
    rows = rows.withColumn("block", F.floor(F.coalesce("turn", F.lit(-1)) / block_turns))
    people = rows.where("speaker is not null").select(F.col("conv_id").alias("p_conv"), F.col("speaker").alias("perspective")).distinct()
    mine = F.col("speaker").eqNullSafe(F.col("perspective"))
    name = F.when(mine, "assistant").when(F.col("speaker").isNull(), "user").otherwise(F.concat(F.lit("user name="), F.translate(F.replace(F.col("speaker"), F.lit(MARK), F.lit(ESCAPED)), "\r\n", "  ")))
    head = F.concat(F.lit(OPEN), name, F.lit("\n"))
    cast = rows.join(people, F.col("conv_id").eqNullSafe(F.col("p_conv"))).drop("p_conv")
    said = cast.select("conv_id", "perspective", "turn", "block", "speaker", F.concat(head, F.col("text"), F.lit(CLOSE)).alias("segment"), F.length(head).alias("head"), mine.alias("mine"))
    said = materialize(said.withColumn("length", F.length("segment").cast("long")), "segments")
    blocks = said.groupBy(F.col("conv_id").alias("b_conv"), F.col("perspective").alias("b_view"), F.col("block").alias("b_block")).agg(F.sum("length").alias("b_length"))
    before = F.sum("b_length").over(W.partitionBy("b_conv", "b_view").orderBy("b_block").rowsBetween(W.unboundedPreceding, -1))
    blocks = blocks.select("b_conv", "b_view", "b_block", F.coalesce(before, F.lit(0)).alias("before"))
    at = W.partitionBy("conv_id", "perspective", "block").orderBy("turn", "speaker", "segment").rowsBetween(W.unboundedPreceding, -1)
    inner = said.withColumn("inside", F.coalesce(F.sum("length").over(at), F.lit(0)))
    found = inner.join(blocks, F.col("conv_id").eqNullSafe(F.col("b_conv")) & (F.col("perspective") == F.col("b_view")) & (F.col("block") == F.col("b_block")))
    start = F.col("before") + F.col("inside")
    return found.select(
        "conv_id", "perspective", "turn", "speaker", "segment", start.alias("start"), "length",
        F.when(F.col("mine"), start + F.col("head")).alias("mask_start"), F.when(F.col("mine"), start + F.col("length")).alias("mask_end"),
    )


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(table(spark, sf_dir, "conversations"))


SQL = f"""
WITH p AS (SELECT DISTINCT conv_id, role AS perspective FROM conversations WHERE role IS NOT NULL),
s AS (
  SELECT c.conv_id, p.perspective, c.turn, c.role AS speaker, c.role IS NOT DISTINCT FROM p.perspective AS mine,
         '{OPEN}' || CASE WHEN c.role IS NOT DISTINCT FROM p.perspective THEN 'assistant' WHEN c.role IS NULL THEN 'user' ELSE 'user name=' || translate(replace(c.role, '{MARK}', '{ESCAPED}'), chr(13) || chr(10), '  ') END || chr(10) AS head,
         head || replace(coalesce(c.text, ''), '{MARK}', '{ESCAPED}') || '{CLOSE.strip()}' || chr(10) AS segment
  FROM conversations c JOIN p ON c.conv_id IS NOT DISTINCT FROM p.conv_id
), o AS (
  SELECT *, length(segment) AS length,
         coalesce(sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker NULLS FIRST, segment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM s
)
SELECT conv_id, perspective, turn, speaker, segment, start, length,
       CASE WHEN mine THEN start + length(head) END AS mask_start, CASE WHEN mine THEN start + length END AS mask_end FROM o"""

QUERIES = {"op8_chat_formatting": op8_chat_formatting}
ORACLES = {"op8_chat_formatting": SQL}

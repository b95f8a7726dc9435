"""Chat formatting by perspective rotation.

For every participant of a conversation the dialogue is rendered once with that speaker as assistant
and all others as named users. A row is one rendered message: its text, its place in the rendering and
the characters to train on, so no task ever holds a conversation, and a rendering is the rows' texts in
order of char_start.

Places are running sums in two steps: within blocks of BLOCK turns, then over the blocks' totals; rows
that repeat are counted first and spread again at the end. So a conversation, or one repeated message,
that holds a third of all rows is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 256
SYSTEM = "system"
#: The marks around a message.
START, END = "<|im_start|>", "<|im_end|>\n"


def rotate(turns: DataFrame, system: str = SYSTEM) -> DataFrame:
    """One row for each conversation, perspective and message of (conv_id, turn, role, text).

    conv_id, perspective, turn, copy, speaker, rendered, train, char_start, char_end, mask_start, mask_end.
    A message with role `system` is shown to everyone and is no participant's; a conversation of such
    messages alone has no perspective and no rows. Null roles are the speaker `unknown`, null texts are
    empty. Messages are in order of turn (nulls first), role, text; repeated rows stay, numbered by copy.
    Masks cover what the perspective's own speaker says with its end mark, and are null elsewhere. Other
    columns are left out.
    """
    told = turns.select(
        "conv_id", F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("unknown")).alias("speaker"), F.coalesce("text", F.lit("")).alias("body"),
    ).groupBy("conv_id", "turn", "speaker", "body").agg(F.count("*").alias("copies"))
    people = told.where(F.col("speaker") != system).select(F.col("conv_id").alias("_conv"), F.col("speaker").alias("perspective")).distinct()
    seen = told.join(people, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    train = F.col("speaker") == F.col("perspective")
    head = (
        F.when(train, F.lit(f"{START}assistant\n"))
        .when(F.col("speaker") == system, F.lit(f"{START}system\n"))
        .otherwise(F.concat(F.lit(f"{START}user name="), "speaker", F.lit("\n")))
    )
    shown = (
        seen.withColumn("train", train).withColumn("_head", F.length(head))
        .withColumn("rendered", F.concat(head, "body", F.lit(END))).drop("body")
        .withColumn("_len", F.length("rendered").cast("long"))
        .withColumn("_block", F.floor(F.col("turn") / BLOCK))
    )
    key = ["conv_id", "perspective", "_block"]
    inside = Window.partitionBy(*key).orderBy(F.col("turn").asc_nulls_first(), "speaker", "rendered").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy("conv_id", "perspective").orderBy(F.col("_block").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum(F.col("_len") * F.col("copies"))
    blocks = shown.groupBy(*key).agg(total.alias("_sum")).withColumn("_base", F.coalesce(F.sum("_sum").over(ahead), F.lit(0))).drop("_sum")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key]
    own = shown.withColumn("_before", F.coalesce(F.sum(F.col("_len") * F.col("copies")).over(inside), F.lit(0)))
    placed = own.alias("a").join(blocks.alias("b"), same[0] & same[1] & same[2]).select("a.*", "b._base")
    each = placed.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    start = F.col("_base") + F.col("_before") + (F.col("copy") - 1) * F.col("_len")
    return each.withColumn("char_start", start).select(
        "conv_id", "perspective", "turn", "copy", "speaker", "rendered", "train", "char_start",
        (F.col("char_start") + F.col("_len")).alias("char_end"),
        F.when(F.col("train"), F.col("char_start") + F.col("_head")).alias("mask_start"),
        F.when(F.col("train"), F.col("char_start") + F.col("_len") - 1).alias("mask_end"),
    )


ORACLE = f"""
WITH told AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS body, count(*) AS copies
  FROM conversations GROUP BY ALL
), people AS (SELECT DISTINCT conv_id, speaker AS perspective FROM told WHERE speaker <> '{SYSTEM}'),
shown AS (
  SELECT t.conv_id, perspective, turn, speaker, copies, speaker = perspective AS train,
    CASE WHEN speaker = perspective THEN '{START}assistant' || chr(10)
         WHEN speaker = '{SYSTEM}' THEN '{START}system' || chr(10)
         ELSE '{START}user name=' || speaker || chr(10) END AS head, body
  FROM told t JOIN people p ON t.conv_id IS NOT DISTINCT FROM p.conv_id
), each AS (
  SELECT conv_id, perspective, turn, speaker, train, length(head) AS h, head || body || '<|im_end|>' || chr(10) AS rendered,
    unnest(generate_series(1, copies)) AS copy FROM shown
), placed AS (
  SELECT *, coalesce(sum(length(rendered)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, rendered, copy
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_start FROM each
)
SELECT conv_id, perspective, turn, copy, speaker, rendered, train, char_start, char_start + length(rendered) AS char_end,
  CASE WHEN train THEN char_start + h END AS mask_start, CASE WHEN train THEN char_start + length(rendered) - 1 END AS mask_end
FROM placed
"""

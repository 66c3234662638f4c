"""Perspective rotation of multi-party dialogues, with DataFrame functions only.

For every participant the dialogue is rendered with that speaker as assistant and the
others as named users; masks mark the assistant's texts. Character offsets are prefix
sums: within range partitions first, then over partition totals, so that one very
long conversation spreads over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetskein.session import written

UNNAMED = "unknown"
PART_CHARS = 100_000


def segments(turns: DataFrame) -> DataFrame:
    """One row per (conversation, perspective, turn): rendered segment and its character offsets.

    Columns: conv_id, perspective, speaker, segment, start, end, mask_start, mask_end (null for
    turns of others). Turns are ordered by turn (null first), role, text. A null role
    is the participant ``unknown``, a null text is empty, rows with null conv_id form one
    conversation, equal rows are turns of their own. Other input columns are not read.
    """
    plain = turns.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit(UNNAMED)).alias("speaker"),
        F.coalesce("text", F.lit("")).alias("said"),
    ).withColumn("_tie", F.monotonically_increasing_id())
    order = ["conv_id", "turn", "speaker", "said", "_tie"]
    # Stored with the number of the range partition, so that a repeated task finds the same numbers.
    placed = written(plain.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "turns")
    cast = placed.select(F.col("conv_id").alias("_conv"), F.col("speaker").alias("perspective")).distinct()
    own = F.col("perspective") == F.col("speaker")
    head = F.when(own, F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user:"), "speaker", F.lit("|>\n")))
    rendered = (
        placed.join(cast, F.col("conv_id").eqNullSafe(F.col("_conv")))
        .withColumn("segment", F.concat(head, "said", F.lit("\n")))
        .withColumn("_size", F.length("segment").cast("long"))
    )
    totals = rendered.groupBy(F.col("conv_id").alias("_c"), F.col("perspective").alias("_p"), F.col("_range").alias("_r")).agg(F.sum("_size").alias("_total"))
    before = Window.partitionBy("_c", "_p").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_before", F.coalesce(F.sum("_total").over(before), F.lit(0))).drop("_total")
    within = Window.partitionBy("conv_id", "perspective", "_range").orderBy("turn", "speaker", "said", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    placed_at = (
        rendered.withColumn("_upto", F.sum("_size").over(within))
        .join(totals, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("perspective") == F.col("_p")) & (F.col("_range") == F.col("_r")))
        .withColumn("end", F.col("_before") + F.col("_upto"))
        .withColumn("start", F.col("end") - F.col("_size"))
    )
    return placed_at.select(
        "conv_id",
        "perspective",
        "speaker",
        "segment",
        "start",
        "end",
        F.when(own, F.col("end") - 1 - F.length("said")).alias("mask_start"),
        F.when(own, F.col("end")).alias("mask_end"),
    )


def dialogues(turns: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """Rendered dialogues: one row per (conversation, perspective, part).

    A part holds the segments that start in one stretch of ``part_chars`` characters, so a row is
    bounded whatever the length of the conversation; usual conversations have part 0 alone. ``masks``
    lists the assistant's spans as ``start:end`` within the part's text, end exclusive, in order.
    """
    parts = (
        segments(turns)
        .withColumn("part", F.floor(F.col("start") / part_chars).cast("long"))
        .groupBy("conv_id", "perspective", "part")
        .agg(F.sort_array(F.collect_list(F.struct("start", "segment", "mask_start", "mask_end"))).alias("_s"))
    )
    first = F.col("_s")[0]["start"]
    spans = F.transform(
        F.filter("_s", lambda x: x["mask_start"].isNotNull()),
        lambda x: F.concat_ws(":", (x["mask_start"] - first).cast("string"), (x["mask_end"] - first).cast("string")),
    )
    return parts.select(
        "conv_id",
        "perspective",
        "part",
        F.size("_s").cast("long").alias("n_turns"),
        first.alias("char_start"),
        F.array_join(F.transform("_s", lambda x: x["segment"]), "").alias("text"),
        F.array_join(spans, ",").alias("masks"),
    )


#: The same question for DuckDB; %d is the length of a part.
SQL = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS said,
         row_number() OVER (ORDER BY conv_id) AS tie
  FROM conversations
), casting AS (
  SELECT DISTINCT conv_id AS conv, speaker AS perspective FROM turns
), rendered AS (
  SELECT conv_id, perspective, turn, speaker, said, tie, perspective = speaker AS own,
         CASE WHEN perspective = speaker THEN '<|assistant|>' || chr(10)
              ELSE '<|user:' || speaker || '|>' || chr(10) END || said || chr(10) AS segment
  FROM turns JOIN casting ON conv_id IS NOT DISTINCT FROM conv
), placed AS (
  SELECT *, CAST(sum(length(segment)) OVER (PARTITION BY conv_id, perspective
           ORDER BY turn NULLS FIRST, speaker, said, tie ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto
  FROM rendered
), parts AS (
  SELECT *, upto - length(segment) AS char_at, (upto - length(segment)) // %d AS part FROM placed
), begun AS (
  SELECT *, min(char_at) OVER (PARTITION BY conv_id, perspective, part) AS char_start FROM parts
)
SELECT conv_id, perspective, part, count(*) AS n_turns, char_start,
       string_agg(segment, '' ORDER BY char_at) AS text,
       coalesce(string_agg(CASE WHEN own THEN (upto - 1 - length(said) - char_start) || ':' || (upto - char_start) END, ',' ORDER BY char_at), '') AS masks
FROM begun GROUP BY conv_id, perspective, part, char_start
""" % PART_CHARS

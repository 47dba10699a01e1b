"""Multi-party chat formatting by perspective rotation, in Spark's own functions only.

For every participant of a conversation the dialogue is rendered with that speaker as the assistant and the others as
named users; only what the assistant says is trained on. The result has a row per participant and message, with the
rendered segment, its place in the whole rendering and the span to train on: a conversation of any length stays spread
over many rows and tasks, and its text is the segments in order.

Messages are ordered by turn, speaker and text (nulls first). System messages open no perspective and stay system
messages in all. Nulls: a null speaker is the participant "unknown", a null text is empty, a null conversation is one of
its own. Repeated rows are repeated messages. An empty table gives an empty result. Extra columns are ignored.

Texts and names can't pass for markup: in both a backslash goes before the bar of "<|", in names after a "<" at
the end and before the sign that ends "|>" too, and where backslashes stand between the two already, one more is put in; unescaped() takes them out again. Places and spans
count the rendered characters; the column name holds the speaker as given. A very long message is one row's segment a perspective.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import attach, saved

SYSTEM = ("system",)


def escaped(text: Column, name: bool = False) -> Column:
    """The text without markup of its own; a name neither ends its header nor opens markup with the bar after it."""
    if not name:
        return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")
    return F.regexp_replace(F.regexp_replace(text, r"<(\\*)(\||\z)", r"<\\$1$2"), r"\|(\\*)>", r"|\\$1>")


def unescaped(text: Column, name: bool = False) -> Column:
    if not name:
        return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")
    return F.regexp_replace(F.regexp_replace(text, r"\|\\(\\*)>", "|$1>"), r"<\\(\\*)(\||\z)", "<$1$2")


def rotated(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", system: tuple[str, ...] = SYSTEM) -> DataFrame:
    """conv_id, perspective, position, turn, chat_role, name, segment, start, end, mask_start, mask_end.

    start and end are the segment's characters (end not included) in the whole rendering; mask_start and mask_end those to
    train on, or null. Range partitions keep any conversation, however long, in order over several tasks: places are
    added up per partition first, then over partitions.
    """
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("unknown")).alias("speaker"), F.coalesce(text_col, F.lit("")).alias("said"))
    order = [F.col(c).asc_nulls_first() for c in ("conv", "turn", "speaker", "said", "uid")]
    rows = rows.withColumn("uid", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = saved(rows.withColumn("part", F.spark_partition_id()), "turns")
    speakers = rows.where(~F.col("speaker").isin(*system)).groupBy("conv").agg(F.array_sort(F.collect_set("speaker")).alias("perspectives"))
    rows = attach(rows, "conv", "uid", speakers).withColumn("perspective", F.explode("perspectives")).drop("perspectives")
    rows = rows.withColumn("chat_role", F.when(F.col("speaker").isin(*system), "system").when(F.col("speaker") == F.col("perspective"), "assistant").otherwise("user"))
    head = F.when(F.col("chat_role") == "user", F.concat(F.lit("<|user name="), escaped(F.col("speaker"), name=True), F.lit("|>\n"))).otherwise(F.concat(F.lit("<|"), "chat_role", F.lit("|>\n")))
    rows = rows.withColumn("head", head).withColumn("segment", F.concat("head", escaped(F.col("said")), F.lit("<|end|>\n")))
    rows = rows.withColumn("size", F.length("segment").cast("long"))

    parts = rows.groupBy("conv", "perspective", "part").agg(F.sum("size").alias("chars"), F.count("*").alias("messages"))
    earlier = Window.partitionBy("conv", "perspective").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("conv").alias("_conv"), F.col("perspective").alias("_perspective"), F.col("part").alias("_part"), F.coalesce(F.sum("chars").over(earlier), F.lit(0)).alias("chars"), F.coalesce(F.sum("messages").over(earlier), F.lit(0)).alias("messages"))
    rows = rows.join(parts, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("perspective") == F.col("_perspective")) & (F.col("part") == F.col("_part")))
    here = Window.partitionBy("conv", "perspective", "part").orderBy(*order[1:])
    rows = rows.withColumn("end", F.col("chars") + F.sum("size").over(here.rowsBetween(Window.unboundedPreceding, 0))).withColumn("position", F.col("messages") + F.row_number().over(here))
    ours = F.col("chat_role") == "assistant"
    start = F.col("end") - F.col("size")
    return rows.select(
        F.col("conv").alias(conv_col), "perspective", "position", F.col("turn").alias(turn_col), "chat_role", F.col("speaker").alias("name"), "segment",
        start.alias("start"), "end", F.when(ours, start + F.length("head")).alias("mask_start"), F.when(ours, F.col("end") - 1).alias("mask_end"),
    )

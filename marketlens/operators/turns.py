"""Messages of conversations in pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Turns of one span; a conversation of any length is ordered span by span, in different tasks.
SPAN = 1000


def exchanges(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, question, answer): each user message with the assistant message right after it.

    A user message that something else follows has no answer; an assistant message that follows no user
    message has no question. Neighbours are found within spans of turns; the ends of spans, one row each, meet
    the next span's first message.
    """
    rows = messages.select("conv_id", "turn", "role", "text", F.floor(F.col("turn") / SPAN).alias("_span"))
    here, order = F.struct("role", "text"), Window.partitionBy("conv_id", "_span").orderBy("turn")
    inside = rows.withColumn("_next", F.lead(here).over(order)).withColumn("_before", F.lag("role").over(order))
    ends = rows.groupBy("conv_id", "_span").agg(F.min_by(here, F.col("turn")).alias("_first"), F.max_by("role", "turn").alias("_last"))
    spans = Window.partitionBy("conv_id").orderBy("_span")
    across = ends.select("conv_id", "_span", F.lead("_first").over(spans).alias("_after"), F.lag("_last").over(spans).alias("_prior"))
    known = inside.join(across, ["conv_id", "_span"]).withColumns({"_next": F.coalesce("_next", "_after"), "_before": F.coalesce("_before", "_prior")})
    asked = F.col("role") == "user"
    alone = (F.col("role") == "assistant") & ~F.coalesce(F.col("_before") == "user", F.lit(False))
    answer = F.when(asked & (F.col("_next.role") == "assistant"), F.col("_next.text")).when(alone, F.col("text"))
    return known.filter(asked | alone).select("conv_id", "turn", F.when(asked, F.col("text")).alias("question"), answer.alias("answer"))

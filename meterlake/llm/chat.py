"""Chat formatting: a dialogue rendered from the view of each of its participants."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def perspectives(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    narrators: tuple[str, ...] = ("system",),
    turns_per_part: int = 512,
) -> DataFrame:
    """One row for each part of a conversation and each participant of the conversation: conv_col, part, speaker, text, mask, n_turns, n_masked.

    The speaker's turns are rendered as the assistant's and the others' as named users'; narrators are nobody's view
    and keep their role. A participant gets all parts, also those that they don't speak in. Rendered turns are `<|im_start|>role\\ncontent<|im_end|>\\n`. mask lists the characters
    begin:end of the speaker's contents with their end marks, the ones to learn, counted from the start of the conversation. A part
    holds the turns whose number lies in one span of `turns_per_part`, so that a very long conversation is spread over many rows
    and tasks; a speaker's texts joined in order of part are the whole dialogue, to which the masks apply.

    Turns are ordered by number, then role, then content. Repeated rows count once. NULL text: the empty content. NULL
    role: the participant `unknown`. NULL turn: before the others, in part 0. NULL conversation: one of its own. A conversation
    with narrators only, or an empty table: no rows.
    """
    rows = turns.select(
        F.struct(F.col(conv_col).alias("id")).alias("conv"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), F.lit("unknown")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("content"),
    ).distinct()
    part = F.coalesce(F.floor(F.col("turn") / turns_per_part).cast("long"), F.lit(0).cast("long"))
    told = rows.groupBy("conv", part.alias("part")).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("turn", F.lit(-(1 << 62))).alias("turn"), "role", "content"))).alias("said"))
    # Rows without texts say where each speaker's part begins; a header of their own is 1 + length(speaker) shorter than for the others.
    name = F.when(F.col("role").isin(*narrators), F.col("role")).otherwise(F.concat(F.lit("user name="), F.col("role")))
    line = len(OPEN) + F.length(name) + 1 + F.length("content") + len(CLOSE) + 1
    sizes = rows.groupBy("conv", part.alias("part"), "role").agg(F.sum(line).alias("size"), F.count("*").alias("own"))
    speakers = sizes.where(~F.col("role").isin(*narrators))
    slots = sizes.groupBy("conv", "part").agg(F.sum("size").alias("size")).join(speakers.select("conv", F.col("role").alias("speaker")).distinct(), "conv")
    slots = slots.join(speakers.select("conv", "part", F.col("role").alias("speaker"), "own"), ["conv", "part", "speaker"], "left")
    before = Window.partitionBy("conv", "speaker").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shown = F.sum(F.col("size") - F.coalesce("own", F.lit(0)) * (1 + F.length("speaker"))).over(before)
    slots = slots.select("conv", "part", F.struct("speaker", F.coalesce(shown, F.lit(0)).cast("long").alias("at")).alias("slot"))
    seen = told.join(slots.groupBy("conv", "part").agg(F.collect_list("slot").alias("slots")), ["conv", "part"])
    seen = seen.withColumn("slot", F.explode("slots")).select("conv", "part", "said", "slot.*")

    def header(role):
        shown = F.when(role == F.col("speaker"), F.lit("assistant")).when(role.isin(*narrators), role).otherwise(F.concat(F.lit("user name="), role))
        return F.concat(F.lit(OPEN), shown, F.lit("\n"))

    lines = F.transform("said", lambda s: F.struct(
        F.concat(header(s["role"]), s["content"], F.lit(CLOSE + "\n")).alias("line"),
        F.length(header(s["role"])).alias("head"), (s["role"] == F.col("speaker")).alias("own"),
    ))
    start = F.struct(F.col("at"), F.array().cast("array<string>").alias("spans"), F.lit(0).cast("long").alias("masked"))

    def step(done, x):
        begin, end = done["at"] + x["head"], done["at"] + F.length(x["line"]) - 1
        return F.struct(
            (end + 1).cast("long").alias("at"),
            F.when(x["own"], F.concat(done["spans"], F.array(F.concat_ws(":", begin.cast("string"), end.cast("string"))))).otherwise(done["spans"]).alias("spans"),
            (done["masked"] + F.when(x["own"], end - begin).otherwise(0)).cast("long").alias("masked"),
        )

    drawn = seen.withColumn("lines", lines)
    drawn = drawn.withColumn("done", F.aggregate("lines", start, step))
    return drawn.select(
        F.col("conv.id").alias(conv_col), "part", "speaker", F.array_join(F.transform("lines", lambda x: x["line"]), "").alias("text"),
        F.array_join("done.spans", ",").alias("mask"), F.size("lines").cast("long").alias("n_turns"), F.col("done.masked").alias("n_masked"),
    )

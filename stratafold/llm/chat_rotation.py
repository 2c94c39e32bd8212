"""Chat formatting by multi-party perspective rotation, with DataFrame functions only.

Every participant of a conversation is the assistant once: the dialogue is rendered with that speaker's turns as
assistant turns, which are trained on, and everyone else's as turns of named users, which are not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from stratafold.llm.shared import staged

SYSTEM = "system"
NOBODY = "unknown"  # the name of a speaker whose role is null
PART_TURNS = 256
_OPEN, _CLOSE = "<|im_start|>", "<|im_end|>\n"


def _plain(text: Column) -> Column:
    """The text with the markers of turns made harmless."""
    return F.replace(text, F.lit("<|im_"), F.lit("<| im_"))


def conversation_parts(turns: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """conv_id, part (0, 1, ...) and its turns in order, as (at, turn, role, text).

    Rows that repeat conversation, turn, role and text are one turn. The turns of a conversation are ranked by number (null
    first), role and text, and every ``part_turns`` of them are a part. The ranks come from a sorted table: rows are dealt to ranges of
    (conversation, turn, role, text) and sorted there, so that their positions follow the order, and only the counts of a
    conversation in each range are added up. So no task holds a conversation, however many rows it has.
    """
    role, text = F.coalesce("role", F.lit(NOBODY)), F.coalesce("text", F.lit(""))
    # a null id stands aside, so that joins need no null-safe comparison
    key = {"no_conv": F.col("conv_id").isNull(), "conv_key": F.coalesce(F.col("conv_id").cast("string"), F.lit(""))}
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")).withColumns(key)
    order = [*key, "turn", "role", "text"]
    ranged = rows.repartitionByRange(*order).groupBy(*order).agg(F.first("conv_id").alias("conv_id")).sortWithinPartitions(*order)
    placed = staged(ranged.withColumn("at", F.monotonically_increasing_id()), "turns")
    range_of = F.shiftright("at", 33)  # the partition, and below it the row's position
    counts = placed.groupBy(range_of.alias("range"), *key).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy(*key).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("range", *key, (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    ranked = placed.withColumn("range", range_of).join(starts, ["range", *key])
    part = F.floor((F.col("at") + F.col("shift")) / part_turns).alias("part")
    return ranked.groupBy(*key, part).agg(F.first("conv_id").alias("conv_id"), F.sort_array(F.collect_list(F.struct("at", "turn", "role", "text"))).alias("turns"))


def rotate_perspectives(turns: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """One row for each conversation, part and participant: conv_id, part, speaker, n_turns, text, spans, n_trained.

    Input rows have conv_id, turn, role and text. Participants are the roles of a conversation but ``system``,
    whose turns are rendered as such for all; with no one else there is no row. Turns are ordered by number (null
    first), role and text. Each is ``<|im_start|>assistant`` for the speaker, ``<|im_start|>user name=...`` for others, then the text
    and ``<|im_end|>``; markers inside texts are broken by a space. ``spans`` are the trained characters of
    ``text``, [from, to): the speaker's words with their end marker. A null role speaks as ``unknown``, a null text
    is empty, repeated rows are one turn. Long conversations come in parts of ``part_turns`` turns, each with its own
    offsets, numbered from 0 by ``part``; every participant has all parts. Other columns are not read.
    """
    key = ["no_conv", "conv_key"]
    parts = conversation_parts(turns, part_turns)
    speakers = parts.select(*key, F.explode(F.array_distinct(F.transform("turns", lambda t: t.role))).alias("speaker")).where(F.col("speaker") != SYSTEM).distinct()
    both = parts.join(speakers, key)
    speaker = F.col("speaker")

    def head(t: Column) -> Column:
        name = F.when(t.role == speaker, F.lit("assistant")).when(t.role == SYSTEM, F.lit(SYSTEM)).otherwise(F.concat(F.lit("user name="), _plain(t.role)))
        return F.concat(F.lit(_OPEN), name, F.lit("\n"))

    pieces = F.transform("turns", lambda t: F.struct(head(t).alias("head"), F.concat(_plain(t.text), F.lit(_CLOSE)).alias("body"), (t.role == speaker).alias("own")))
    rendered = both.withColumn("pieces", pieces)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<from:bigint,to:bigint>>").alias("spans"))

    def place(state: Column, p: Column) -> Column:
        begin = state.at + F.length(p.head)
        end = begin + F.length(p.body)
        span = F.array(F.struct(begin.alias("from"), end.alias("to")))
        return F.struct(end.alias("at"), F.when(p.own, F.concat(state.spans, span)).otherwise(state.spans).alias("spans"))

    placed = rendered.withColumn("spans", F.aggregate("pieces", start, place, lambda s: s.spans))
    text = F.array_join(F.transform("pieces", lambda p: F.concat(p.head, p.body)), "")
    n_trained = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s.to - s["from"])
    return placed.select(
        "conv_id", "part", "speaker", F.size("turns").cast("long").alias("n_turns"), text.alias("text"), "spans", n_trained.alias("n_trained")
    )

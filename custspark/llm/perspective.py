"""Multi-party dialogues, rendered once from each participant's perspective.

In a speaker's rendering that speaker is the assistant, everybody else a named user,
and system turns stay system turns. The mask holds what is learned: the speaker's own
turns with their end marks.

A dialogue is rendered in blocks of turns, so that one with very many turns is shared
by many tasks; its speakers meet its blocks in a join that is salted by block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from custspark.llm.common import column

#: Turn numbers of a block, most turns of a part of it (more only where turn numbers repeat), salts of the join.
BLOCK_TURNS, SALTS = 64, 32

# Fixed values of the format.
BEGIN, END, SYSTEM, UNKNOWN = "<|im_start|>", "<|im_end|>\n", "system", "unknown"


def _safe(text: Column) -> Column:
    """Marks inside it lose their meaning by a space."""
    return F.replace(text, F.lit("<|im_"), F.lit("<| im_"))


def _head(role: Column, speaker: Column) -> Column:
    # A name stays in its line, so that no role can close its head and open another turn.
    named = F.concat(F.lit(f"{BEGIN}user name="), _safe(F.translate(role, "\n\r", "  ")), F.lit("\n"))
    return (
        F.when(role == SYSTEM, F.lit(f"{BEGIN}{SYSTEM}\n"))
        .when(role == speaker, F.lit(f"{BEGIN}assistant\n"))
        .otherwise(named)
    )


def rotate(
    turns: DataFrame,
    block_turns: int = BLOCK_TURNS,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """conv_id, speaker, block, part, n_turns, text, mask for each speaker and each block of a dialogue.

    Turns are in order of their number, then role, then text; a null number comes first, in
    block -1. block counts turn numbers by `block_turns`, part splits a block in which
    numbers repeat. mask is an array of (start, end) in characters of the text, end
    exclusive. Dialogues without a speaker (only system turns) have no row; a null role is
    the speaker "unknown", a null text is empty, null conversation ids are one dialogue,
    repeated rows are repeated turns, an empty table gives no row. Marks inside a text or a role lose their
    meaning by a space, and line breaks in a role become spaces where it names a user; speakers are told
    apart by their roles as they are.
    """
    safe = _safe(F.coalesce(column(turns, text_col).cast("string"), F.lit("")))
    rows = turns.select(
        column(turns, conv_col).alias("conv_id"),
        column(turns, turn_col).cast("bigint").alias("turn"),
        F.coalesce(column(turns, role_col).cast("string"), F.lit(UNKNOWN)).alias("role"),
        safe.alias("said"),
    ).withColumn("block", F.coalesce(F.floor(F.col("turn") / block_turns), F.lit(-1)).cast("bigint"))
    order = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "said")
    blocks = (
        rows.withColumn("at", F.row_number().over(order))
        .withColumn("part", F.floor((F.col("at") - 1) / block_turns).cast("bigint"))
        .groupBy("conv_id", "block", "part")
        .agg(F.sort_array(F.collect_list(F.struct("at", "role", "said"))).alias("turns"))
        .withColumn("salt", F.pmod(F.col("block"), F.lit(SALTS)))
    )
    salts = rows.select("conv_id", F.pmod(F.col("block"), F.lit(SALTS)).alias("salt")).distinct()
    speakers = rows.filter(F.col("role") != SYSTEM).select("conv_id", F.col("role").alias("speaker")).distinct()
    a, b = salts.alias("a"), speakers.alias("b")
    salted = a.join(b, F.expr("a.conv_id <=> b.conv_id")).select("a.conv_id", "a.salt", "b.speaker")
    c, d = blocks.alias("c"), salted.alias("d")
    met = c.join(d, F.expr("c.conv_id <=> d.conv_id and c.salt = d.salt")).select("c.*", "d.speaker")
    speaker = F.col("speaker")
    heads = F.transform("turns", lambda t: _head(t["role"], speaker))
    met = met.withColumn("heads", heads)
    sizes = F.zip_with("turns", "heads", lambda t, h: F.length(h) + F.length(t["said"]) + F.lit(len(END)))
    met = met.withColumn("sizes", sizes)
    # Where each turn ends: running sums over at most a part's turns.
    ends = F.aggregate(
        "sizes",
        F.array().cast("array<int>"),
        lambda done, n: F.concat(done, F.array(n + F.coalesce(F.get(done, F.size(done) - 1), F.lit(0)))),
    )
    met = met.withColumn("ends", ends)
    own = F.filter(
        F.arrays_zip("turns", "heads", "sizes", "ends"), lambda t: t["turns"]["role"] == speaker
    )
    mask = F.transform(
        own,
        lambda t: F.struct(
            (t["ends"] - t["sizes"] + F.length(t["heads"])).alias("start"), t["ends"].alias("end")
        ),
    )
    return met.select(
        "conv_id",
        "speaker",
        "block",
        "part",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.array_join(
            F.zip_with("turns", "heads", lambda t, h: F.concat(h, t["said"], F.lit(END))), ""
        ).alias("text"),
        mask.alias("mask"),
    )

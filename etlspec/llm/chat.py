"""Chat formatting in windows of a token budget."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from etlspec.llm.common import column

#: The template's marks.
TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>\n"
#: Control strings of this template and of common others start with one of these, then backslashes of an escape.
CONTROL = r"([<\[])(\\*)(\||/?s>|/?INST\])"
ESCAPED = r"([<\[])\\(\\*)(\||/?s>|/?INST\])"
#: Turns of a conversation whose running sums are made together.
BLOCK_TURNS = 256
#: Tokens counted for a turn besides those of its text.
TURN_TOKENS = 4


def escape(text: Column) -> Column:
    """``text`` with a backslash more inside every control string, so that none is left."""
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def token_count(text: Column) -> Column:
    """Words, digits and runs of signs: a count that needs no tokenizer."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{M}]+|\p{N}|[^\s\p{L}\p{M}\p{N}]+"))


def format_windows(
    turns: DataFrame,
    *,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    budget: int = 2048,
    system_tokens: int = 256,
    history_turns: int = 2,
    history_tokens: int = 256,
    tokens=token_count,
) -> DataFrame:
    """One row per window: a turn-aligned span of a conversation as one training text.

    Columns: ``conv_col``; ``window`` (long, rises through the conversation);
    ``n_turns``; ``n_repeated``, how many turns at the front are repeated;
    ``n_tokens``; ``formatted``; ``loss``, array<struct<start, length>> in
    characters: the texts of the new assistant turns. Every turn is new in one
    window. A window repeats the conversation's system turn, and before its new
    turns the last ``history_turns`` turns if they have ``history_tokens`` at
    most; repeated turns are under no loss.

    Spans come from running sums of turn tokens. The budget less the shares for
    system turn and history is the width of a cell: turns that lie within one
    cell form a window, and a turn that crosses a cell's edge is a window of
    its own. So a window stays within ``budget`` unless a single turn or the
    system turn alone is larger than its share; texts are never cut. Running
    sums are made in blocks of turn numbers and joined by the blocks' sums.

    Turns are ordered by number, role and text; null numbers come first. Null
    roles and texts are empty. A null conversation is one conversation.
    Repeated rows are turns of their own, an empty table gives no rows, and
    other columns are not used.
    """
    width = budget - system_tokens - history_tokens
    if width < 1 or history_turns < 0:
        raise ValueError("the budget must be larger than the shares for system turn and history")
    text = F.coalesce(column(turns, text_col), F.lit(""))
    base = turns.select(
        column(turns, conv_col).alias("conv"),
        column(turns, turn_col).cast("long").alias("turn"),
        F.coalesce(column(turns, role_col), F.lit("")).alias("role"),
        text.alias("text"),
        (tokens(text) + TURN_TOKENS).cast("long").alias("n"),
    ).withColumn("block", F.floor(F.col("turn") / BLOCK_TURNS))
    order = ["turn", "role", "text"]
    inside = Window.partitionBy("conv", "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("c_conv").orderBy("c_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = base.groupBy(F.col("conv").alias("c_conv"), F.col("block").alias("c_block")).agg(F.sum("n").alias("s"), F.count("*").alias("c"))
    sums = sums.select("c_conv", "c_block", *[F.coalesce(F.sum(x).over(before), F.lit(0)).alias(f"{x}_before") for x in ("s", "c")])
    placed = (
        base.withColumns({"end": F.sum("n").over(inside), "pos": F.count("*").over(inside)})
        .join(sums, F.col("conv").eqNullSafe(F.col("c_conv")) & F.col("block").eqNullSafe(F.col("c_block")))
        .select("conv", "role", "text", "n", (F.col("end") + F.col("s_before")).alias("end"), (F.col("pos") + F.col("c_before") - 1).alias("pos"))
    )
    cell = F.expr(f"(end - n) div {width}")
    crosses = cell != F.expr(f"(end - 1) div {width}")
    rows = placed.select("conv", "role", "text", "n", "pos", (F.col("end") - F.col("n")).alias("begin"), (2 * cell + crosses.cast("long")).alias("window"))
    starts = rows.groupBy("conv", "window").agg(F.min("pos").alias("start"), F.min("begin").alias("from"))
    back = F.transform(F.sequence(F.lit(0), F.lit(history_turns)), lambda h: F.when(h > 0, F.col("start") - h).otherwise(F.lit(0).cast("long")))
    wanted = starts.select(F.col("conv").alias("w_conv"), F.col("window").alias("w_window"), "start", "from", F.explode(F.array_distinct(back)).alias("w_pos"))
    wanted = wanted.where("w_pos >= 0 AND w_pos < start")
    near = (F.col("start") - F.col("pos") <= history_turns) & (F.col("from") - F.col("begin") <= history_tokens)
    old = (
        wanted.join(rows.drop("window"), F.col("conv").eqNullSafe(F.col("w_conv")) & (F.col("pos") == F.col("w_pos")))
        .where(near | ((F.col("pos") == 0) & (F.col("role") == "system")))
        .select("conv", F.col("w_window").alias("window"), "pos", "role", "text", "n", F.lit(True).alias("old"))
    )
    new = rows.select("conv", "window", "pos", "role", "text", "n", F.lit(False).alias("old"))
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(SAYS))
    turn = F.struct("pos", "old", (F.col("role") == "assistant").alias("target"), "n", head.alias("head"), escape(F.col("text")).alias("said"))
    windows = old.unionByName(new).groupBy("conv", "window").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    none = F.array().cast("array<struct<start:int,length:int>>")
    loss = F.aggregate(
        "turns",
        F.struct(F.lit(0).alias("at"), none.alias("spans")),
        lambda s, t: F.struct(
            (s["at"] + F.char_length(t["head"]) + F.char_length(t["said"]) + len(END)).alias("at"),
            F.when(
                t["target"] & ~t["old"],
                F.concat(s["spans"], F.array(F.struct((s["at"] + F.char_length(t["head"])).alias("start"), F.char_length(t["said"]).alias("length")))),
            )
            .otherwise(s["spans"])
            .alias("spans"),
        ),
        lambda s: s["spans"],
    )
    return windows.select(
        F.col("conv").alias(conv_col),
        "window",
        F.size("turns").alias("n_turns"),
        F.size(F.filter("turns", lambda t: t["old"])).alias("n_repeated"),
        F.aggregate("turns", F.lit(0).cast("long"), lambda s, t: s + t["n"]).alias("n_tokens"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["said"], F.lit(END))), "").alias("formatted"),
        loss.alias("loss"),
    )


def read_back(windows: DataFrame, *, conv_col: str = "conv_id") -> DataFrame:
    """What formatted windows say, a row each: ``turns`` (array<struct<role, text>>, the new ones) and ``targets``, the texts under loss."""
    marks = reduce(lambda s, c: s.replace(c, f"\\{c}"), "|", END)
    turns = F.slice(F.split("formatted", marks, -1), F.col("n_repeated") + 1, F.col("n_turns") - F.col("n_repeated"))

    def parsed(t: Column) -> Column:
        role = F.substring_index(F.substring(t, len(TURN) + 1, 1 << 30), SAYS, 1)
        said = F.substring(t, F.lit(len(TURN) + len(SAYS) + 1) + F.char_length(role), F.char_length(t))
        return F.struct(unescape(role).alias("role"), unescape(said).alias("text"))

    targets = F.transform("loss", lambda x: unescape(F.substring(F.col("formatted"), x["start"] + 1, x["length"])))
    return windows.select(column(windows, conv_col), "window", F.transform(turns, parsed).alias("turns"), targets.alias("targets"), F.char_length("formatted").alias("n_chars"))

"""Prefix-target expansion of conversations, in DataFrame functions only.

Each assistant turn becomes one example: all turns before it are context, and only its own text
is under the loss mask. Turns after the last assistant turn (or a conversation without one) make
one more example without a target, so that no turn is lost.

A turn is written ``### <role>: <text></turn>`` and a newline. Inside roles and texts a backslash is doubled
and each control string becomes a backslash and one letter, so no control string of the template
can occur there, and ``unescape`` restores the text exactly.

Defined results: a null text or role is empty; turns are ordered by (turn, role, text), nulls
first, so ties and repeated rows have one order and all are kept; a text of any length is kept whole (a conversation is one
row); an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, COLON, CLOSE = "### ", ": ", "</turn>"
#: Control strings and the letters that stand for them after a backslash.
LETTERS = (("h", OPEN), ("c", COLON), ("e", CLOSE))


def escape(c: Column) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for letter, control in LETTERS:
        c = F.replace(c, F.lit(control), F.lit("\\" + letter))
    return c


def unescape(c: Column) -> Column:
    """Backslashes are read in pairs from the left; what stands between pairs holds only single
    ones, each of which opens a control letter."""

    def part(p: Column) -> Column:
        for letter, control in LETTERS:
            p = F.replace(p, F.lit("\\" + letter), F.lit(control))
        return p

    return F.array_join(F.transform(F.split(c, r"\\\\"), part), "\\")


def expand(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, example, formatted, loss_start, loss_chars); loss_start counts code points
    from 0 and is null in an example without a target."""
    turns = conversations.select(
        "conv_id",
        F.struct(
            "turn",
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("t"),
    )
    convs = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    head = lambda t: F.concat(F.lit(OPEN), escape(t["role"]), F.lit(COLON))
    convs = convs.select(
        "conv_id",
        F.transform(
            "ts", lambda t: F.struct(t["role"].alias("role"), head(t).alias("head"), escape(t["text"]).alias("body"))
        ).alias("ts"),
    )
    n = F.size("ts")
    last = F.element_at("ts", -1)["role"]
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: (F.element_at("ts", i)["role"] == "assistant") | (i == n))
    examples = convs.select("conv_id", "ts", last.alias("last"), F.posexplode(ends).alias("example", "upto"))
    whole = F.transform(
        F.slice("ts", 1, F.col("upto")), lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE + "\n"))
    )
    target = F.element_at("ts", F.col("upto"))
    has = target["role"] == "assistant"
    made = examples.select("conv_id", "example", F.array_join(whole, "").alias("formatted"), target.alias("t"), has.alias("has"))
    body = F.when(F.col("has"), F.length(F.col("t")["body"])).cast("long")
    tail = len(CLOSE) + 1
    return made.select(
        "conv_id",
        F.col("example").cast("long").alias("example"),
        "formatted",
        (F.length("formatted") - tail - body).alias("loss_start"),
        body.alias("loss_chars"),
    )


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of one formatted example."""
    parts = F.split(formatted, CLOSE + "\n")
    parts = F.slice(parts, 1, F.size(parts) - 1)

    def turn(p: Column) -> Column:
        at = F.instr(p, COLON)
        return F.struct(
            unescape(F.substring(p, len(OPEN) + 1, at - len(OPEN) - 1)).alias("role"),
            unescape(F.substring(p, at + len(COLON), F.length(p))).alias("text"),
        )

    return F.transform(parts, turn)


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation, from the formatted examples alone: turns of its longest example, and all
    text under the masks in order."""
    masked = F.when(
        F.col("loss_start").isNotNull(),
        unescape(F.substring("formatted", F.col("loss_start") + 1, F.col("loss_chars"))),
    )
    rows = examples.select(
        "conv_id",
        F.struct("example", masked.alias("loss")).alias("e"),
        F.struct("example", "formatted").alias("f"),
        F.length("formatted").cast("long").alias("chars"),
    )
    whole = rows.groupBy("conv_id").agg(
        F.max("f")["formatted"].alias("formatted"),
        F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: F.coalesce(e["loss"], F.lit(""))), "").alias("loss"),
        F.sum("chars").alias("formatted_chars"),
    )
    return whole.select("conv_id", read_turns(F.col("formatted")).alias("turns"), "loss", "formatted_chars")

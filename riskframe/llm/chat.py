"""Chat formatting with prefix-target expansion.

A conversation is one transcript: ``<s>``, then for each turn
``[INST]`` role ``[/INST]`` text ``</s>``. Every assistant turn becomes an example of its
own: the transcript from the start to the end of that turn, with only the reply's text
under the loss mask. Turns after the last reply go into a last example without a mask, so
that no turn is lost. Each example is a prefix of the transcript, so the packed form keeps
the transcript once with the example bounds and ``examples`` writes the texts out.

Control strings inside roles and texts get a backslash after their first character, and
those that have backslashes there get one more, which ``unescape`` takes away again.

Null texts and roles count as empty. Turns are ordered by turn, then role and text; a null
turn comes first and repeated rows stay. A null conv_id is a conversation of its own. An
empty table gives no rows. Other columns are not read. Only built-in expressions are used.
A transcript is one value, so a conversation must fit into one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BEGIN, END, OPEN, CLOSE = "<s>", "</s>", "[INST]", "[/INST]"
_CONTROL = "([<\\[]){}(/?(?:s>|INST\\]))"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL.format("(\\\\*)"), "$1\\\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL.format("\\\\(\\\\*)"), "$1$2$3")


def pack(turns: DataFrame) -> DataFrame:
    """conv_id, transcript, examples: array of (example, formatted_chars, loss_start, loss_chars).

    loss_start counts code points from 0; loss_chars is null in an example without mask.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.select(
        "conv_id",
        F.struct(
            "turn", role.alias("role"), text.alias("text"),
            F.concat(F.lit(OPEN), escape(role), F.lit(CLOSE)).alias("head"), escape(text).alias("body"),
        ).alias("t"),
    )
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    part = F.transform("t", lambda t: F.concat(t.head, t.body, F.lit(END)))
    convs = convs.select("conv_id", "t", F.concat(F.lit(BEGIN), F.array_join(part, "")).alias("transcript"))
    # One pass over the turns; each step adds the end of its turn in the transcript.
    start = F.struct(F.lit(len(BEGIN)).alias("at"), F.array().cast("array<int>").alias("ends"))
    ends = F.aggregate(
        "t", start,
        lambda s, t: F.struct(
            (s.at + F.length(t.head) + F.length(t.body) + F.lit(len(END))).alias("at"),
            F.array_append(s.ends, s.at + F.length(t.head) + F.length(t.body) + F.lit(len(END))).alias("ends"),
        ),
        lambda s: s.ends,
    )
    convs = convs.select("*", ends.alias("ends"))
    is_reply = lambda t: t.role == "assistant"
    example = lambda t, i: F.struct(
        i.alias("turn_no"),
        F.get("ends", i).alias("formatted_chars"),
        F.when(is_reply(t), F.get("ends", i) - F.lit(len(END)) - F.length(t.body)).alias("loss_start"),
        F.when(is_reply(t), F.length(t.body)).alias("loss_chars"),
    )
    last = F.size("t") - 1
    marked = F.transform("t", lambda t, i: F.when(is_reply(t) | (i == last), example(t, i)))
    return convs.select("conv_id", "transcript", F.filter(marked, lambda e: e.isNotNull()).alias("examples"))


def examples(packed: DataFrame) -> DataFrame:
    """One row per example: conv_id, example (from 0), formatted, loss_start, loss_chars."""
    return packed.select("conv_id", "transcript", F.posexplode("examples").alias("example", "e")).select(
        "conv_id", "example",
        F.substring(F.col("transcript"), F.lit(1), F.col("e.formatted_chars")).alias("formatted"),
        F.col("e.loss_start").alias("loss_start"), F.col("e.loss_chars").alias("loss_chars"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text as an array of (role, text)."""
    body = F.substring(formatted, F.lit(len(BEGIN) + 1), F.length(formatted))
    parts = F.split(body, END)
    turns = F.slice(parts, 1, F.size(parts) - 1)

    def turn(p: Column) -> Column:
        cut = F.instr(p, F.lit(CLOSE))
        return F.struct(
            unescape(F.substring(p, F.lit(len(OPEN) + 1), cut - F.lit(len(OPEN) + 1))).alias("role"),
            unescape(F.substring(p, cut + F.lit(len(CLOSE)), F.length(p))).alias("text"),
        )

    return F.transform(turns, turn)


def read_loss(formatted: Column, loss_start: Column, loss_chars: Column) -> Column:
    """The unescaped text under an example's mask; empty without one."""
    return F.coalesce(unescape(F.substring(formatted, loss_start + 1, loss_chars)), F.lit(""))


def digest(rows: DataFrame) -> DataFrame:
    """Facts read back from the examples of each conversation."""
    read = rows.select(
        "conv_id", "example", F.length("formatted").cast("bigint").alias("n"), "formatted",
        read_loss(F.col("formatted"), F.col("loss_start"), F.col("loss_chars")).alias("loss"),
    )
    convs = read.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("whole"),
        F.sum("n").alias("formatted_chars"),
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda x: x.loss), ""
        ).alias("loss"),
    )
    convs = convs.withColumn("turns", read_turns(F.col("whole")))
    lines = F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n")))
    return convs.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )

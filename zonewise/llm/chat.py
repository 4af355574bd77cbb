"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as context, and only that reply under the loss
mask (a span of code points). Turns after the last reply are kept in one example without a trainable part, so the
output holds the whole conversation.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n``. A text cannot imitate a mark: between ``<`` and ``|`` one backslash is
added to those already there, and taken away again on reading. Roles are percent-encoded where they hold ``%``, ``<`` or
a line break.

Defined cases: null role or text: empty; rows of a null conv_id: one conversation; equal turn numbers: by role, then text,
repeated rows are turns of their own; null turns come first; an empty table: no examples. A conversation is the unit of
work and its examples grow with the square of its turns, as the expansion asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The marks of the template.
START, END, TARGET = "<|im_start|>", "<|im_end|>\n", "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def _escape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), F.lit("<"), F.lit("%3C"))


def _unescape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%3C"), F.lit("<")), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def examples(turns: DataFrame) -> DataFrame:
    """conv_id, example (position of its last turn), n_turns, trainable, formatted, loss_start, loss_end (code points), last.

    ``last`` marks the example that holds the whole conversation.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    talks = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    parts = F.transform(
        "turns",
        lambda t: F.struct(
            F.concat(F.lit(START), _escape_role(t["role"]), F.lit("\n")).alias("head"),
            escape(t["text"]).alias("body"),
            (t["role"] == TARGET).alias("target"),
        ),
    )
    last = F.size("parts") - 1
    chosen = F.filter(F.sequence(F.lit(0), last), lambda i: F.get("parts", i)["target"] | (i == last))
    every = talks.select("conv_id", parts.alias("parts")).withColumn("example", F.explode(chosen))
    ends = F.col("example") == last
    own = F.get("parts", F.col("example"))
    context = F.array_join(
        F.transform(F.slice("parts", F.lit(1), F.col("example")), lambda p: F.concat(p["head"], p["body"], F.lit(END))), ""
    )
    every = every.select("conv_id", "example", own.alias("own"), context.alias("context"), ends.alias("last"))
    start = F.length("context") + F.length("own.head")
    whole = F.concat("context", "own.head", "own.body", F.lit(END))
    size = F.length("own.body")
    return every.select(
        "conv_id",
        "example",
        (F.col("example") + 1).alias("n_turns"),
        F.col("own.target").alias("trainable"),
        whole.alias("formatted"),
        start.alias("loss_start"),
        F.when(F.col("own.target"), start + size).otherwise(start).alias("loss_end"),
        "last",
    )


def parse(formatted: Column) -> Column:
    """The turns (role, text) of a formatted string."""
    pieces = F.split(formatted, r"<\|im_end\|>\n")
    return F.transform(
        F.slice(pieces, F.lit(1), F.size(pieces) - 1),
        lambda p: F.struct(
            _unescape_role(F.substring(F.substring_index(p, "\n", 1), len(START) + 1, 1 << 30)).alias("role"),
            unescape(F.substring(p, F.length(F.substring_index(p, "\n", 1)) + 2, F.lit(1 << 30))).alias("text"),
        ),
    )


def loss_text(formatted: Column, start: Column, end: Column) -> Column:
    return unescape(F.substring(formatted, start + 1, end - start))


def digest(written: DataFrame) -> DataFrame:
    """What the written examples say about each conversation.

    The turns are read, and hashed, where the whole conversation was read: of the examples, whose size grows with the square
    of the turns, only the replies under the loss mask are gathered.
    """
    turns = parse(F.col("formatted"))
    text = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    told = written.select(
        "conv_id",
        "example",
        "trainable",
        F.length("formatted").cast("long").alias("chars"),
        F.when(F.col("last"), F.struct(F.size(turns).cast("long").alias("n"), F.sha2(text, 256).alias("sha"))).alias("whole"),
        loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_end")).alias("loss"),
    )
    per_talk = told.groupBy("conv_id").agg(
        F.max("whole").alias("whole"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("trainable"), F.struct("example", "loss")))), lambda x: x["loss"]), "").alias("loss"),
        F.sum("chars").alias("formatted_chars"),
        F.count_if("trainable").alias("n_examples"),
    )
    return per_talk.select(
        "conv_id",
        F.col("whole.n").alias("n_turns"),
        F.col("whole.sha").alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
        "n_examples",
    )

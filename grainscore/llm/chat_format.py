"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are
context, and only its reply lies under the loss mask.  A conversation that
does not end with a reply gets one more example, of all its turns and without
any loss, so that the examples hold the whole conversation.

Template: ``<|role|>\\n`` + text + ``<|end|>\\n`` per turn.  Control strings in
roles and texts are broken by a backslash after their first character, and
backslashes are doubled; ``unescape`` undoes both.

Defined results: a null role or text counts as empty; turns are ordered by
turn number (null first), then role, then text, and repeated rows stay as
turns of their own; rows with a null conversation id form one conversation; an
empty table gives no rows.  A conversation is one row of at most the size its
longest example has anyway; the examples of a conversation are streamed out
one by one and never gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "<|end|>\n"
CONTROL = ["<|", "|>", "<s>", "</s>", "[INST]", "[/INST]"]


def escape(text: Column) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for mark in CONTROL:
        out = F.replace(out, F.lit(mark), F.lit(mark[0] + "\\" + mark[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), escape(role), F.lit("|>\n"), escape(text), F.lit(END))


def turns(formatted: Column) -> Column:
    """Array of (role, text) read back from a formatted example."""
    parts = F.split(formatted, r"<\|end\|>\n")

    def turn(part: Column) -> Column:
        head = F.substring_index(part, "|>", 1)
        return F.struct(
            unescape(head.substr(F.lit(3), F.char_length(head))).alias("role"),
            unescape(part.substr(F.char_length(head) + 4, F.char_length(part))).alias("text"),
        )

    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), turn)


def loss_text(formatted: Column, start: Column, length: Column) -> Column:
    """Text under the loss mask of a formatted example, unescaped."""
    return unescape(formatted.substr(start + 1, length))


def expand(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", reply_role: str = "assistant"
) -> DataFrame:
    """Examples: conv_id, example (its last turn's place), formatted, loss_start, loss_chars, is_last.

    ``loss_start`` and ``loss_chars`` count code points of ``formatted``.
    """
    one = rows.select(
        F.col(conv).alias("conv_id"),
        F.struct(
            F.col(turn).alias("turn"),
            F.coalesce(F.col(role), F.lit("")).alias("role"),
            F.coalesce(F.col(text), F.lit("")).alias("text"),
        ).alias("row"),
    )
    talks = one.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("talk"))
    rendered = talks.select(
        "conv_id",
        F.transform("talk", lambda t: render(t["role"], t["text"])).alias("turns"),
        F.transform("talk", lambda t: t["role"] == reply_role).alias("replies"),
    )
    examples = rendered.select("conv_id", "turns", "replies", F.size("turns").alias("n"), F.posexplode("replies").alias("place", "reply"))
    examples = examples.where(F.col("reply") | (F.col("place") == F.col("n") - 1))
    formatted = F.array_join(F.slice("turns", F.lit(1), F.col("place") + 1), "")
    last = F.get("turns", F.col("place"))
    head = F.char_length(F.substring_index(last, "|>", 1)) + 3
    return examples.select(
        "conv_id",
        (F.col("place") + 1).cast("long").alias("example"),
        formatted.alias("formatted"),
        last.alias("last"),
        head.alias("head"),
        "reply",
        (F.col("place") == F.col("n") - 1).alias("is_last"),
    ).select(
        "conv_id",
        "example",
        "formatted",
        F.when(F.col("reply"), F.char_length("formatted") - F.char_length("last") + F.col("head")).otherwise(0).cast("int").alias("loss_start"),
        F.when(F.col("reply"), F.char_length("last") - F.col("head") - len(END)).otherwise(0).cast("int").alias("loss_chars"),
        "is_last",
    )


def read_back(examples: DataFrame) -> DataFrame:
    """One row per conversation with digests of what its examples hold.

    Turns come from the example that ends the conversation, the loss texts from
    every example in order.
    """
    said = F.array_join(F.transform(turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    parsed = examples.select(
        "conv_id",
        "example",
        F.char_length("formatted").cast("long").alias("chars"),
        loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_chars")).alias("loss"),
        F.when(F.col("is_last"), F.struct(F.size(turns(F.col("formatted"))).cast("long").alias("n"), F.sha2(said, 256).alias("digest"))).alias("whole"),
    )
    loss = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda e: e["loss"]), "")
    return (
        parsed.groupBy("conv_id")
        .agg(F.max("whole").alias("whole"), loss.alias("loss"), F.sum("chars").alias("formatted_chars"), F.count("*").alias("n_examples"))
        .select(
            "conv_id",
            F.col("whole.n").alias("n_turns"),
            F.col("whole.digest").alias("turns_sha256"),
            F.char_length("loss").cast("long").alias("loss_chars"),
            F.sha2("loss", 256).alias("loss_sha256"),
            "formatted_chars",
            "n_examples",
        )
    )

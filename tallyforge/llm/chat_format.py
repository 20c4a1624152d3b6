"""Chat formatting: relational, in Spark expressions only.

A template marks turns with control strings, all of the form ``<...>``::

    <turn:ROLE>text<next>text of the same role<end>

Texts and roles are escaped so that no ``<`` or ``>`` of theirs is left
(``\\`` becomes ``\\b``, ``<`` ``\\l``, ``>`` ``\\g``), which is reversible.
The loss mask is a run-length list over the code points of the output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    text = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\b"))
    return F.replace(F.replace(text, F.lit("<"), F.lit("\\l")), F.lit(">"), F.lit("\\g"))


def unescape(text: Column) -> Column:
    text = F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\g"), F.lit(">"))
    return F.replace(text, F.lit("\\b"), F.lit("\\"))


def format_chats(turns: DataFrame, loss_role: str = LOSS_ROLE) -> DataFrame:
    """(conv_id, formatted, loss_mask) of a table (conv_id, turn, role, text).

    Turns are ordered by turn, then role, then text, so ties and repeated rows
    have one order and every row is kept. Adjacent turns of a role share one
    block. Null text and null role count as empty, a null turn sorts first,
    rows with a null conv_id form one conversation, an empty table gives no
    rows; other columns are ignored. ``loss_mask`` is array<struct<n, loss>>:
    runs of n code points, loss true for the text of ``loss_role`` turns.
    Escaping is done per row before the shuffle; a conversation becomes one
    string, so its length bounds a task's memory.
    """
    rows = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), escape(F.col("text")).alias("text")).alias("t"))
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))

    def pieces(t: Column, i: Column) -> Column:
        same = (i > 0) & (F.get("turns", i - 1)["role"] == t["role"])
        last = (i == F.size("turns") - 1) | (F.get("turns", i + 1)["role"] != t["role"])
        head = F.when(same, F.lit("<next>")).otherwise(F.concat(F.lit("<turn:"), escape(t["role"]), F.lit(">")))
        piece = lambda s, loss: F.struct(s.alias("s"), loss.alias("loss"))
        return F.array(piece(head, F.lit(False)), piece(t["text"], t["role"] == loss_role), piece(F.when(last, F.lit("<end>")).otherwise(F.lit("")), F.lit(False)))

    chats = chats.select("conv_id", F.filter(F.flatten(F.transform("turns", pieces)), lambda p: p["s"] != "").alias("pieces"))
    return chats.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: p["s"]), "").alias("formatted"),
        F.transform("pieces", lambda p: F.struct(F.char_length(p["s"]).alias("n"), p["loss"].alias("loss"))).alias("loss_mask"),
    )


def read_chats(chats: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<role, text>>, loss_texts array<string>) read back from ``format_chats``.

    ``loss_texts`` are the unescaped texts under the mask. A mask whose runs do
    not fit the output's pieces fails the job.
    """
    blocks = F.filter(F.split("formatted", "<end>"), lambda b: b != "")

    def block(b: Column) -> Column:
        role = unescape(F.substring_index(F.substring(b, len("<turn:") + 1, 1 << 30), ">", 1))
        body = F.regexp_replace(b, "^<turn:[^>]*>", "")
        return F.transform(F.split(body, "<next>"), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    split = F.filter(F.split("formatted", "(?<=>)|(?=<)"), lambda s: s != "")
    read = chats.select("conv_id", "formatted", F.flatten(F.transform(blocks, block)).alias("turns"), F.arrays_zip(split.alias("s"), F.col("loss_mask").alias("m")).alias("zipped"))
    fits = F.forall("zipped", lambda z: F.coalesce(F.char_length(z["s"]) == z["m"]["n"], F.lit(False)))
    under = F.transform(F.filter("zipped", lambda z: z["m"]["loss"]), lambda z: unescape(z["s"]))
    return read.select("conv_id", "formatted", "turns", F.when(fits, under).otherwise(F.raise_error(F.lit("loss mask does not fit the text")).cast("array<string>")).alias("loss_texts"))


def chat_digest(chats: DataFrame) -> DataFrame:
    """Counts and digests of the turns and of the text under the loss mask, read back from the output."""
    loss = F.array_join("loss_texts", "")
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read_chats(chats).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(line, ""), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )

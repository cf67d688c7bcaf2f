"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs and sorted; adjacent turns of one role are
merged into one block; the blocks are written as

    <|im_start|>role<|im_body|>text[<|im_next|>text ...]<|im_end|>\\n

``<|im_next|>`` stands between the merged turns of a block, so the turns can be read back.
Control strings inside roles and texts get one backslash after their first character, and
a string that already has backslashes there gets one more, so escaping can be undone.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, BODY, NEXT, END = "<|im_start|>", "<|im_body|>", "<|im_next|>", "<|im_end|>\n"
#: Control strings of this template and of other common ones: none may stay in a text.
CONTROL = ("<|im_start|>", "<|im_body|>", "<|im_next|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>",
           "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
REST = "|".join(re.escape(c[1:]) for c in CONTROL)
ESCAPE = rf"([<\[])(\\*)({REST})"
UNESCAPE = rf"([<\[])\\(\\*)({REST})"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE, r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPE, r"$1$2$3")


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text", loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: ``conv_id``, ``segments`` and ``formatted``.

    ``segments`` is the formatted text in pieces, each with ``loss`` (true: under the loss
    mask, the texts of ``loss_roles``); ``formatted`` is their concatenation. Turns sort by
    turn number (null first), then role and text, so ties and repeated rows have one result;
    null roles and texts count as empty, a null conversation id forms a conversation, an
    empty table gives no rows. Only the four named columns are read.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
                 F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("t"))
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    t = F.col("turns")
    # 1-based positions at which a block starts, and one past the last turn
    starts = F.filter(F.sequence(F.lit(1), F.size(t)),
                      lambda i: (i == 1) | (F.element_at(t, i).role != F.element_at(t, F.greatest(i - 1, F.lit(1))).role))
    convs = convs.withColumn("starts", F.concat(starts, F.array(F.size(t) + 1)))
    s = F.col("starts")
    blocks = F.transform(F.slice(s, 1, F.size(s) - 1), lambda a, k: F.struct(
        F.element_at(t, a).role.alias("role"), F.slice(t, a, F.element_at(s, k + 2) - a).text.alias("texts")))
    convs = convs.select("conv_id", blocks.alias("blocks"))

    def piece(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    no = F.lit(False)
    segments = F.flatten(F.transform("blocks", lambda b: F.concat(
        F.array(piece(F.concat(F.lit(START), escape(b.role), F.lit(BODY)), no)),
        F.flatten(F.transform(b.texts, lambda x, j: F.array(
            piece(F.when(j > 0, F.lit(NEXT)).otherwise(F.lit("")), no),
            piece(escape(x), b.role.isin(*loss_roles))))),
        F.array(piece(F.lit(END), no)))))
    out = convs.select("conv_id", segments.alias("segments"))
    return out.withColumn("formatted", F.array_join(F.col("segments").text, ""))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, as an array of (role, text), unescaped."""
    def turns(block: Column) -> Column:
        role = unescape(F.split(block, re.escape(BODY)).getItem(0))
        body = F.split(F.split(block, re.escape(BODY)).getItem(1), re.escape(END)).getItem(0)
        return F.transform(F.split(body, re.escape(NEXT)), lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    blocks = F.split(formatted, re.escape(START))
    return F.flatten(F.transform(F.slice(blocks, 2, F.size(blocks)), turns))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, in order, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s.loss), lambda s: unescape(s.text)), "")

"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it as context, and only its text
trainable. Turns after the last reply, or a conversation without replies, make one more example with
nothing trainable, so that the examples hold every turn.

Template of a turn: <|im_start|>role<|im_sep|>text<|im_end|>. Inside roles and texts a backslash is
doubled, and every control string gets a backslash after its first character; taking away one of each
two backslashes and every single one gives back what was there.

Defined cases: null role or text is empty; turns are ordered by turn, then role, then text, null turn
first; repeated rows are turns of their own; a null conv_id is a conversation; an empty table gives no
example. Extra columns do not matter. A conversation is gathered as a whole, since it is one string of
the output; one that holds a large share of all rows makes strings of that size.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, STOP = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Strings that a tokenizer may take for control tokens.
CONTROLS = (START, SEP, STOP, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
REPLY = "assistant"


def escaped(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    # After the first character of a control string: found by what stands behind and ahead.
    places = "|".join(f"(?<={re.escape(c[0])})(?={re.escape(c[1:])})" for c in CONTROLS)
    return F.regexp_replace(doubled, places, r"\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id and its turns in order: array of (turn, role, text)."""
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    return conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(
        F.struct("turn", empty("role").alias("role"), empty("text").alias("text")))).alias("turns"))


def examples(conversations: DataFrame) -> DataFrame:
    """conv_id, example (from 1), last (whether it holds all turns), formatted, loss_start, loss_chars
    (code points of formatted under the loss mask; 0 chars: none)."""
    turns = turns_of(conversations).withColumn("turns", F.transform("turns", lambda t: F.struct(
        t["role"].alias("role"), escaped(t["role"]).alias("name"), escaped(t["text"]).alias("text"))))
    n = F.size("turns")
    replies = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at("turns", i)["role"] == REPLY)
    # 0 stands for the example without a reply, which takes what no reply follows.
    ends = F.when(F.element_at("turns", -1)["role"] == REPLY, replies).otherwise(F.concat(replies, F.array(F.lit(0))))
    marked = lambda t: F.concat(F.lit(START), t["name"], F.lit(SEP), t["text"], F.lit(STOP))
    rows = (turns.select("conv_id", "turns", n.alias("n"), F.posexplode(ends).alias("at", "reply"))
            .withColumn("context", F.array_join(F.transform(F.slice("turns", 1, F.when(F.col("reply") == 0, F.col("n"))
                                                                    .otherwise(F.col("reply") - 1)), marked), ""))
            .withColumn("target", F.when(F.col("reply") > 0, F.get("turns", F.col("reply") - 1)["text"])))
    opening = F.when(F.col("reply") > 0, F.lit(START + REPLY + SEP)).otherwise("")
    closing = F.when(F.col("reply") > 0, F.lit(STOP)).otherwise("")
    return rows.select(
        "conv_id", (F.col("at") + 1).alias("example"), ((F.col("reply") == 0) | (F.col("reply") == F.col("n"))).alias("last"),
        F.concat("context", opening, F.coalesce("target", F.lit("")), closing).alias("formatted"),
        (F.length("context") + F.length(opening)).alias("loss_start"), F.coalesce(F.length("target"), F.lit(0)).alias("loss_chars"))


def read_back(formatted: Column) -> Column:
    """The turns that a formatted example holds: array of (role, text)."""
    pieces = F.split(formatted, re.escape(STOP), -1)
    turns = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.split(F.substr(p, F.lit(len(START) + 1)), re.escape(SEP), 2))
    return F.transform(turns, lambda t: F.struct(unescaped(t[0]).alias("role"), unescaped(t[1]).alias("text")))


def masked(formatted: Column, start: Column, chars: Column) -> Column:
    """The text under the loss mask, as it was before escaping."""
    return unescaped(F.substr(formatted, start + 1, chars))

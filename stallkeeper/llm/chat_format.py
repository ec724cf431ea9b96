"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs, sorted, merged where neighbours have one role, and concatenated:

    <|im_start|>ROLE\\nTEXT<|turn|>TEXT<|im_end|>\\n

Texts and roles can't forge control strings: & becomes &amp; and <| becomes &lt;| (and a line end in a role &nl;), in
that order, which read_back() undoes in the opposite order. Only texts of LEARNED roles stand under the loss mask.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, TURN, STOP = "<|im_start|>", "<|turn|>", "<|im_end|>\n"
LEARNED = ("assistant",)


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_col, formatted, loss (array of structs start and length, in characters from 0, of
    the texts under the loss mask).

    Null texts and roles are empty ones. Rows without a turn come first; ties in turn go by role, then text; repeated rows
    are turns each. A null conv_col is a conversation. Other columns are ignored; no rows give no conversations."""
    nothing = F.lit("")
    role = F.replace(escape(F.coalesce(role_col, nothing)), F.lit("\n"), F.lit("&nl;"))
    one = turns.select(F.col(conv_col).alias("conv"), F.struct(F.col(turn_col).alias("turn"), F.coalesce(role_col, nothing).alias("by"), F.coalesce(text_col, nothing).alias("raw"), role.alias("role"), escape(F.coalesce(text_col, nothing)).alias("text")).alias("row"))
    own = one.groupBy("conv").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    same = lambda rows, i: F.when(i > 0, rows[i - 1]["role"] == rows[i]["role"]).otherwise(False)
    parts = F.transform(
        "rows",
        lambda r, i: F.struct(
            F.concat(F.when(same(F.col("rows"), i), F.lit(TURN)).otherwise(F.concat(F.when(i > 0, F.lit(STOP)).otherwise(nothing), F.lit(START), r["role"], F.lit("\n")))).alias("head"),
            r["text"].alias("text"),
            r["role"].isin(*LEARNED).alias("learned"),
        ),
    )
    own = own.select("conv", parts.alias("parts"))
    span = lambda acc, p: F.struct((acc["at"] + F.length(p["head"])).alias("start"), F.length(p["text"]).alias("length"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("loss"))
    walked = F.aggregate("parts", zero, lambda acc, p: F.struct((acc["at"] + F.length(p["head"]) + F.length(p["text"])).alias("at"), F.when(p["learned"], F.array_append(acc["loss"], span(acc, p))).otherwise(acc["loss"]).alias("loss")))
    formatted = F.concat(F.array_join(F.flatten(F.transform("parts", lambda p: F.array(p["head"], p["text"]))), ""), F.lit(STOP))
    return own.select(F.col("conv").alias(conv_col), formatted.alias("formatted"), walked["loss"].alias("loss"))


def read_back(formatted: Column) -> Column:
    """The turns (array of structs role and text) of a formatted conversation."""
    blocks = F.filter(F.split(formatted, r"\Q" + STOP + r"\E"), lambda b: b != "")
    role = lambda b: unescape(F.replace(F.substring_index(F.substr(b, F.lit(len(START) + 1)), "\n", 1), F.lit("&nl;"), F.lit("\n")))
    body = lambda b: F.substr(b, F.locate("\n", b) + 1)
    return F.flatten(F.transform(blocks, lambda b: F.transform(F.split(body(b), r"\Q" + TURN + r"\E"), lambda t: F.struct(role(b).alias("role"), unescape(t).alias("text")))))

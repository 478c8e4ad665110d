"""Conversations as one training text each, with a mask of what is to be learnt.

The turns of a conversation are collected as structs and sorted by turn, then role, then text; neighbours of
one role make one block. A block is ``<|role|>\\n``, its turns with ``<|+|>`` between them, ``</s>\\n``.
Within texts, a control string (``<|``, ``<s>``, ``</s>``, ``[INST]``, ``[/INST]``), with any number of
backslashes after its first character, gets one backslash more there; reading takes one away. In
roles ``%``, ``|``, ``<``, ``>``, ``[`` and line feeds are written as ``%`` and their hexadecimal code.

The mask is a list of spans (start, end in code points, end exclusive) of the assistant's texts.
Spark expressions alone do all of this. A conversation is one value, so it must fit in one row.

Null texts and roles count as empty, null turns come first, a null id is a conversation of its own; repeated rows are
turns of their own; an empty table gives no rows. Only the four named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTROL = r"([<\[])(\\*)(\||/?s>|/?INST\])"
ESCAPED = r"([<\[])\\(\\*)(\||/?s>|/?INST\])"
JOINT = "<|+|>"
END = "</s>\n"
ROLE_CODES = {"%": "%25", "|": "%7C", "<": "%3C", ">": "%3E", "[": "%5B", "\n": "%0A"}


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def escape_role(role: Column) -> Column:
    for plain, code in ROLE_CODES.items():
        role = F.replace(role, F.lit(plain), F.lit(code))
    return role


def unescape_role(role: Column) -> Column:
    for plain, code in reversed(ROLE_CODES.items()):
        role = F.replace(role, F.lit(code), F.lit(plain))
    return role


def format_conversations(turns: DataFrame, id_column="conv_id", turn_column="turn", role_column="role", text_column="text", learnt_role="assistant") -> DataFrame:
    """One row (conv_id, formatted, loss_spans) for each conversation."""
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    turn = F.struct(F.col(turn_column).alias("turn"), escape_role(text(role_column)).alias("role"), escape(text(text_column)).alias("text"))
    rows = turns.select(F.col(id_column).alias("conv_id"), turn.alias("one"))
    sorted_turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("one")).alias("turns"))

    def opening(x, i):
        """What stands before the text of turn ``i``."""
        head = F.concat(F.lit("<|"), x["role"], F.lit("|>\n"))
        same = F.get("turns", i - 1)["role"] == x["role"]
        return F.when(i == 0, head).when(same, F.lit(JOINT)).otherwise(F.concat(F.lit(END), head))

    pieces = sorted_turns.withColumn(
        "pieces", F.transform("turns", lambda x, i: F.struct(opening(x, i).alias("head"), x["text"].alias("text"), x["role"].alias("role")))
    )
    nothing = F.array().cast("array<struct<start:int,end:int>>")

    def reached(state, x):
        start = state["at"] + F.length(x["head"])
        end = start + F.length(x["text"])
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        spans = F.when(x["role"] == learnt_role, F.concat(state["spans"], span)).otherwise(state["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    spans = F.aggregate("pieces", F.struct(F.lit(0).alias("at"), nothing.alias("spans")), reached, lambda state: state["spans"])
    whole = F.concat(F.array_join(F.transform("pieces", lambda x: F.concat(x["head"], x["text"])), ""), F.lit(END))
    return pieces.select("conv_id", whole.alias("formatted"), spans.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation."""
    blocks = F.split(F.regexp_replace(formatted, r"</s>\n\z", ""), "</s>\n", -1)

    def turns(block):
        role = unescape_role(F.regexp_extract(block, r"\A<\|(.*?)\|>\n", 1))
        body = F.regexp_replace(block, r"\A<\|.*?\|>\n", "")
        return F.transform(F.split(body, r"<\|\+\|>", -1), lambda text: F.struct(role.alias("role"), unescape(text).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def read_learnt(formatted: Column, spans: Column) -> Column:
    """The text under the mask, each span without its escapes, with nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))), "")

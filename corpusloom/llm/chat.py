"""Chat formatting with Spark expressions only.

Turns are collected as structs and sorted, adjacent turns of one role are merged, and the
conversation is concatenated; a mask of spans says which characters carry loss. A long
conversation is assembled in two steps: blocks of `block` turn numbers first, then the
blocks' strings, so no single group collects all turns of a large conversation.

Template: `<|turn|>role<|text|>text[<|sep|>text...]<|end|>`. Adjacent turns of one role
share a block; `<|sep|>` keeps them apart for reading back. Inside roles and texts `&`,
`<` and `[` are written as `&amp;`, `&lt;` and `&#91;`, so no control string (those above,
`<s>`, `</s>`, `[INST]`, `[/INST]`) can come from a text, and every text comes back whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, SEP, END = "<|turn|>", "<|text|>", "<|sep|>", "<|end|>"


def escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("["), F.lit("&#91;"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&#91;"), F.lit("[")), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def _spans(turns: Column) -> Column:
    """Sorted turns to (text, pos): the formatted string and the loss spans in it.

    The first turn is opened here as if nothing came before; the joining step drops that
    opening where the block before ends in the same role.
    """

    def step(acc: Column, t: Column) -> Column:
        opening = F.when(F.size(acc["parts"]) == 0, F.concat(F.lit(TURN), t["role"], F.lit(TEXT))).when(t["role"] == acc["role"], F.lit(SEP)).otherwise(F.concat(F.lit(END + TURN), t["role"], F.lit(TEXT)))
        start = acc["at"] + F.length(opening)
        return F.struct(
            F.concat(acc["parts"], F.array(F.concat(opening, t["text"]))).alias("parts"),
            t["role"].alias("role"),
            (start + F.length(t["text"])).cast("long").alias("at"),
            F.when(t["loss"], F.concat(acc["spans"], F.array(F.struct(start.cast("long").alias("start"), F.length(t["text"]).cast("long").alias("len"))))).otherwise(acc["spans"]).alias("spans"),
        )

    zero = F.struct(
        F.array().cast("array<string>").alias("parts"),
        F.lit("").alias("role"),
        F.lit(0).cast("long").alias("at"),
        F.array().cast("array<struct<start:bigint,len:bigint>>").alias("spans"),
    )
    return F.aggregate(turns, zero, step, lambda a: F.struct(F.concat_ws("", a["parts"]).alias("text"), a["role"].alias("last"), a["at"].alias("n"), a["spans"].alias("spans")))


def format_chats(rows: DataFrame, loss_roles: tuple[str, ...] = ("assistant",), block: int = 256, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a conversation: id, `formatted`, and `loss_spans` (start and len in
    characters of `formatted`; one for each turn of a loss role).

    Turns come in order of turn, then role, then text; null turns first. Null roles and
    texts are empty. Repeated rows stay as repeated turns. A null id is a conversation.
    Other columns of `rows` are not read. An empty table gives no rows.
    """
    turns = rows.select(
        F.col(conv).alias("conv"),
        F.struct(
            F.col(turn).alias("turn"),
            escape(F.coalesce(F.col(role), F.lit(""))).alias("role"),
            escape(F.coalesce(F.col(text), F.lit(""))).alias("text"),
            F.coalesce(F.col(role).isin(*loss_roles), F.lit(False)).alias("loss"),
        ).alias("t"),
    )
    part = F.floor(F.coalesce(F.col("t.turn"), F.lit(-1)) / block).cast("long")
    blocks = (
        turns.groupBy("conv", part.alias("part"))
        .agg(F.sort_array(F.collect_list("t")).alias("turns"))
        .select("conv", "part", F.col("turns")[0]["role"].alias("first"), _spans(F.col("turns")).alias("b"))
    )
    whole = blocks.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("part", "first", "b"))).alias("bs"))

    def join(acc: Column, x: Column) -> Column:
        opening = F.length(F.lit(TURN)) + F.length(x["first"]) + F.length(F.lit(TEXT))
        same = (F.size(acc["parts"]) > 0) & (x["first"] == acc["role"])
        cut = F.when(same, opening).otherwise(F.lit(0))
        before = F.when(F.size(acc["parts"]) == 0, F.lit("")).when(same, F.lit(SEP)).otherwise(F.lit(END))
        shift = acc["at"] + F.length(before) - cut
        return F.struct(
            F.concat(acc["parts"], F.array(before, F.when(same, F.substring(x["b"]["text"], opening + F.lit(1), F.length(x["b"]["text"]))).otherwise(x["b"]["text"]))).alias("parts"),
            x["b"]["last"].alias("role"),
            (shift + x["b"]["n"]).cast("long").alias("at"),
            F.concat(acc["spans"], F.array(F.transform(x["b"]["spans"], lambda s: F.struct((s["start"] + shift).cast("long").alias("start"), s["len"].alias("len"))))).alias("spans"),
        )

    zero = F.struct(
        F.array().cast("array<string>").alias("parts"),
        F.lit("").alias("role"),
        F.lit(0).cast("long").alias("at"),
        F.array().cast("array<array<struct<start:bigint,len:bigint>>>").alias("spans"),
    )
    done = F.aggregate(F.col("bs"), zero, join, lambda a: F.struct(F.concat(F.concat_ws("", a["parts"]), F.lit(END)).alias("formatted"), F.flatten(a["spans"]).alias("loss_spans")))
    return whole.select(F.col("conv").alias(conv), done.alias("x")).select(conv, "x.formatted", "x.loss_spans")


def read_turns(formatted: Column) -> Column:
    """The turns in a formatted conversation: array of (role, text), as they were given."""
    blocks = F.slice(F.split(formatted, r"<\|turn\|>"), 2, F.lit(2147483646))
    return F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                F.split(F.substring_index(F.substring_index(b, END, 1), TEXT, -1), r"<\|sep\|>"),
                lambda t: F.struct(unescape(F.substring_index(b, TEXT, 1)).alias("role"), unescape(t).alias("text")),
            ),
        )
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.concat_ws("", F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["len"].cast("int")))))

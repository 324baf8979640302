"""Chat formatting with Spark expressions only.

Turn structs are collected per conversation and sorted; runs of one role are
merged with array functions into one message; messages are concatenated::

    <|im_start|>role\ntext<|turn|>text<|im_end|>\n

``<|turn|>`` stands between the merged turns of one message.  Inside roles and
texts every ``<|`` becomes ``<||`` (and a line end in a role ``<|nl|>``), which
no control string contains, so the format reads back exactly.

Defined cases: a null text or role is empty; a null conversation id is one
conversation; turns are ordered by (turn, role, text) with nulls first, so ties
and repeated rows have one order and all count as turns; an empty table gives
no rows.  A formatted conversation is one value, so it is limited to what one
Spark string holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END, TURN, NEWLINE = "<|im_start|>", "<|im_end|>\n", "<|turn|>", "<|nl|>"


def escape(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("<||"))


def unescape(text: Column) -> Column:
    return F.replace(text, F.lit("<||"), F.lit("<|"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(NEWLINE))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(NEWLINE), F.lit("\n")))


def format_chats(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learned: str = "assistant") -> DataFrame:
    """(key, formatted, loss_spans): spans are [start, length) in code points of the escaped texts of ``learned`` turns."""
    head = lambda role: F.concat(F.lit(START), escape_role(role), F.lit("\n"))
    given = rows.select(F.col(key).alias("key"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    # Where each text begins: running sums over the turns in order, which the collecting below finds dealt by key already.
    order = Window.partitionBy("key").orderBy("turn", "role", "text")
    before = F.lag("role").over(order)
    opens = F.length(head(F.col("role"))) + F.when(before.isNull(), 0).otherwise(len(END))
    gap = F.when(before == F.col("role"), len(TURN)).otherwise(opens)
    sized = given.withColumns({"gap": gap.cast("long"), "size": F.length(escape(F.col("text"))).cast("long")})
    placed = sized.withColumn("start", F.sum(F.col("gap") + F.col("size")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    turns = placed.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "start", "size"))).alias("turns"))
    at = F.sequence(F.lit(0), F.size("turns") - 1)
    first = F.filter(at, lambda i: (i == 0) | (F.get("turns", i).role != F.get("turns", i - 1).role))
    merged = turns.withColumn("opens", first).withColumn(
        "messages",
        F.transform(
            F.col("opens"),
            lambda i, k: F.struct(
                F.get("turns", i).role.alias("role"),
                F.transform(F.slice("turns", i + 1, F.coalesce(F.get("opens", k + 1), F.size("turns")) - i), lambda t: escape(t.text)).alias("texts"),
            ),
        ),
    )
    body = F.transform("messages", lambda m: F.concat(head(m.role), F.array_join(m.texts, TURN), F.lit(END)))
    spans = F.transform(F.filter("turns", lambda t: t.role == learned), lambda t: F.struct(t.start.alias("start"), t["size"].alias("length")))
    return merged.select(F.col("key").alias(key), F.array_join(body, "").alias("formatted"), spans.alias("loss_spans"))


def read_back(chats: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, turns, loss_text, formatted) parsed from the formatted text and its spans alone."""
    blocks = F.filter(F.split("formatted", r"<\|im_end\|>\n"), lambda b: b != "")
    turns = F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                F.split(F.substring(b, F.instr(b, "\n") + 1, F.length(b)), r"<\|turn\|>"),
                lambda t: F.struct(unescape_role(F.substring(b, F.lit(len(START) + 1), F.instr(b, "\n") - len(START) - 1)).alias("role"), unescape(t).alias("text")),
            ),
        )
    )
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring("formatted", (s.start + 1).cast("int"), s.length.cast("int")))), "")
    return chats.select(F.col(key), turns.alias("turns"), loss.alias("loss_text"), F.col("formatted"))

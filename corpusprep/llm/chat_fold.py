"""Chat formatting, relational: the turns of a conversation are collected as
structs, sorted, adjacent turns of a role merged into one message, and the
messages concatenated, in Spark expressions only.

The template: ``<|im_start|>role<|im_msg|>text<|im_sep|>text<|im_end|>\\n``; texts of
merged turns are set apart by ``<|im_sep|>``. In roles and texts a backslash is
doubled and each control string, of this template or a common other one, gets a
backslash after its first character, so no text can end its own message; ``read_turns``
is the exact inverse.

Defined results: turns sort by turn (nulls first), role and text, so ties and
repeated rows are kept in a fixed order; null roles and texts count as empty;
rows without a conversation id form one conversation of a null id; empty in, empty out.
Only the four named columns are read, so extra columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, MSG, SEP, END = "<|im_start|>", "<|im_msg|>", "<|im_sep|>", "<|im_end|>\n"
#: Control strings: what opens a mark of this template, and marks of other common templates.
CONTROL = ("<|", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]")


def escape(c: Column) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for mark in CONTROL:
        c = F.replace(c, F.lit(mark), F.lit(mark[0] + "\\" + mark[1:]))
    return c


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def format_chats(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """One row for each conversation: its id, ``formatted``, ``n_messages`` and
    ``loss_spans``, the (start, length) in code points of every text that is learned."""
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
                    F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = df.groupBy(F.col(conv_col).alias(conv_col)).agg(F.sort_array(F.collect_list(turn)).alias("t"))

    def piece(x, i):
        first = (i == 0) | (x["role"] != F.get("t", i - 1)["role"])
        lead = F.when(~first, F.lit(SEP)).otherwise(
            F.concat(F.when(i == 0, F.lit("")).otherwise(F.lit(END)), F.lit(START), escape(x["role"]), F.lit(MSG)))
        return F.struct(first.alias("first"), lead.alias("lead"), escape(x["text"]).alias("body"), (x["role"] == loss_role).alias("loss"))

    d = d.select(conv_col, F.transform("t", piece).alias("p"))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.expr("cast(array() as array<struct<start:bigint,length:bigint>>)").alias("spans"))

    def add(a, p):
        begin = a["at"] + F.length(p["lead"])
        size = F.length(p["body"]).cast("bigint")
        span = F.struct(begin.alias("start"), size.alias("length"))
        return F.struct((begin + size).alias("at"), F.when(p["loss"], F.concat(a["spans"], F.array(span))).otherwise(a["spans"]).alias("spans"))

    return d.select(
        conv_col, F.concat(F.array_join(F.transform("p", lambda p: F.concat(p["lead"], p["body"])), ""), F.lit(END)).alias("formatted"),
        F.size(F.filter("p", lambda p: p["first"])).cast("bigint").alias("n_messages"),
        F.aggregate("p", start, add, lambda a: a["spans"]).alias("loss_spans"))


def read_turns(formatted: str | Column = "formatted") -> Column:
    """The (role, text) of every turn, read back from the formatted text."""
    quote = lambda s: s.replace("|", "\\|")

    def turns(block):
        head = F.substring_index(block, MSG, 1)
        role = unescape(F.substring(head, F.lit(len(START) + 1), F.length(head)))
        body = F.substring(block, F.length(head) + F.lit(len(MSG) + 1), F.length(block))
        return F.transform(F.split(body, quote(SEP)), lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    blocks = F.split(F.col(formatted) if isinstance(formatted, str) else formatted, quote(END))
    return F.flatten(F.transform(F.filter(blocks, lambda b: b != ""), turns))


def read_loss(formatted: str = "formatted", spans: str = "loss_spans") -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(
        F.substring(F.col(formatted), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")

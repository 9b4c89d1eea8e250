"""Chat formatting in relational form: from turn rows to one training text with a loss mask.

The turns of a conversation are collected as structs and sorted.  Adjacent
turns of one role are merged into a block by slicing the sorted array, and
blocks and texts are concatenated by array functions:

    <|im_start|>role\\ntext<|im_next|>text<|im_end|>\\n<|im_start|>...

Inside texts and roles a backslash is doubled and `<|` becomes `<\\|`, so no
control string can occur there; a new line in a role becomes `\\n`.  `read_turns`
gives the turns back exactly as they were, merged ones apart again.

The loss mask is a list of spans of the formatted text, in code points: one for
each turn of the trained role, without header, separator and end mark.

DataFrame functions only; no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, NEXT, END = "<|im_start|>", "<|im_next|>", "<|im_end|>"
LOSS_ROLE = "assistant"
_END, _NEXT = r"<\|im_end\|>\n", r"<\|im_next\|>"
_TURN = "array<struct<role:string,text:string>>"


def escape(text: Column) -> Column:
    """`text` without control strings; `unescape` undoes it."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(doubled, F.lit("<|"), F.lit("<\\|"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape(text: Column) -> Column:
    """What `escape` or `escape_role` was given: between doubled backslashes each other escape is one mark."""
    parts = F.split(text, r"\\\\", -1)
    plain = F.transform(parts, lambda p: F.replace(
        F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\|"), F.lit("|")))
    return F.when(F.contains(text, F.lit("\\")), F.array_join(plain, "\\")).otherwise(text)


def format_conversations(rows: DataFrame, *, by: tuple[str, ...] = ("conv_id",), turn: str = "turn",
                         role: str = "role", text: str = "text", loss_role: str = LOSS_ROLE) -> DataFrame:
    """One row per conversation: the `by` columns, formatted, loss_spans (start, chars).

    Defined cases: a null text or role counts as empty; null turns come first;
    rows with equal turns follow by role and text, and repeated rows all stay; a
    null conversation id is a conversation of its own; other columns are left
    out, whatever their names; an empty table gives an empty result.  A
    conversation is one value, so its text must stay below 2 GB.
    """
    src = rows.select(*[F.col(c).alias(f"_ch_k{i}") for i, c in enumerate(by)],
                      F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
                               F.coalesce(F.col(text), F.lit("")).alias("text")).alias("_ch_turn"))
    keys = [f"_ch_k{i}" for i in range(len(by))]
    grouped = src.groupBy(*keys).agg(F.sort_array(F.collect_list("_ch_turn")).alias("_ch_turns"))
    e, starts, lens = F.col("_ch_e"), F.col("_ch_starts"), F.col("_ch_lens")
    escaped = grouped.select(*keys, F.transform("_ch_turns", lambda t: F.struct(
        escape_role(t["role"]).alias("role"), escape(t["text"]).alias("text"),
        (t["role"] == loss_role).alias("loss"))).alias("_ch_e"))

    def first(i):          # does a block begin at turn i (from 0)?
        return (i == 0) | (F.get(e, i)["role"] != F.get(e, i - 1)["role"])

    n = F.size(e)
    placed = escaped.select(
        *keys, e,
        F.filter(F.sequence(F.lit(0), n - 1), first).alias("_ch_starts"),
        F.transform(e, lambda t, i: F.struct(
            F.when(first(i), F.length(t["role"]) + len(START) + 1).otherwise(len(NEXT)).alias("open"),
            F.length(t["text"]).alias("chars"),
            F.when((i == n - 1) | first(i + 1), len(END) + 1).otherwise(0).alias("close"),
            t["loss"].alias("loss"))).alias("_ch_lens"))

    def block(s, k):
        turns = F.slice(e, s + 1, F.coalesce(F.get(starts, k + 1), n) - s)
        return F.concat(F.lit(START), F.get(e, s)["role"], F.lit("\n"),
                        F.array_join(F.transform(turns, lambda t: t["text"]), NEXT), F.lit(END + "\n"))

    def advance(acc, x):
        at = acc["at"] + x["open"]
        span = F.array(F.struct(at.alias("start"), x["chars"].cast("long").alias("chars")))
        return F.struct((at + x["chars"] + x["close"]).alias("at"),
                        F.when(x["loss"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    nothing = F.struct(F.lit(0).cast("long").alias("at"),
                       F.array().cast("array<struct<start:bigint,chars:bigint>>").alias("spans"))
    return placed.select(
        *[F.col(k).alias(c) for k, c in zip(keys, by)],
        F.array_join(F.transform(starts, block), "").alias("formatted"),
        F.aggregate(lens, nothing, advance, lambda acc: acc["spans"]).alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """Formatted text -> array of its turns (role, text), as they were before formatting."""
    blocks = F.split(formatted, _END, -1)

    def turns(block):
        header = F.substring_index(block, "\n", 1)
        role = unescape(F.substr(header, F.lit(len(START) + 1)))
        texts = F.split(F.substr(block, F.length(header) + 2), _NEXT, -1)
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(F.slice(blocks, 1, F.size(blocks) - 1), turns)).cast(_TURN)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(
        F.substr(formatted, (s["start"] + 1).cast("int"), s["chars"].cast("int")))), "")

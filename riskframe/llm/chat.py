"""Chat formatting with Spark expressions only.

Turns are collected per conversation as structs, sorted, merged where
neighbours have the same role, and concatenated::

    <|turn|>user<|text|>first<|next|>second<|end|><|turn|>assistant<|text|>...

``<|next|>`` stands between the merged turns of a block, so the single turns
can be read back. A control string inside a text or a role is made harmless by
one backslash after its opening characters (``</s>`` becomes ``<\\/s>``-like
``</\\s>``); one that already has backslashes there gets one more, so removing
one restores every text exactly.

Defined cases: a null text or role is empty; a null conversation id is a
conversation of its own; turns with equal numbers are ordered by role, then
text; repeated rows are turns like any other; an empty table gives an empty
result; other columns are ignored. A formatted conversation is one string, so
a single conversation is limited to the 2 GB of a Spark string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, NEXT, END = "<|turn|>", "<|text|>", "<|next|>", "<|end|>"

# Opening characters and names of the strings that texts must not smuggle in:
# the template's own and common ones of other templates.
_NAMES = r"turn\|>|text\|>|next\|>|end\|>|im_start\|>|im_end\|>|endoftext\|>|s>|INST\]|SYS>>|SYS\]"
_OPEN = r"<\||<</?|</?|\[/?"
CONTROL = rf"({_OPEN})(\\*)({_NAMES})"
_ESCAPED = rf"({_OPEN})\\(\\*)({_NAMES})"

BLOCKS = "array<struct<role:string,texts:array<string>>>"
SPANS = "array<struct<start:bigint,length:bigint>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(CONTROL), F.lit(r"$1\\$2$3"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_ESCAPED), F.lit("$1$2$3"))


def _merge(blocks: Column, turn: Column) -> Column:
    last = F.element_at(blocks, -1)
    joined = F.struct(last["role"].alias("role"), F.concat(last["texts"], F.array(turn["text"])).alias("texts"))
    fresh = F.struct(turn["role"].alias("role"), F.array(turn["text"]).alias("texts"))
    return F.when(
        (F.size(blocks) > 0) & (F.try_element_at(blocks, F.lit(-1))["role"] == turn["role"]),
        F.concat(F.slice(blocks, F.lit(1), F.size(blocks) - 1), F.array(joined)),
    ).otherwise(F.concat(blocks, F.array(fresh)))


def _spans(blocks: Column, trained: str) -> Column:
    """Position and length of every trained text in the formatted string."""

    def text_span(acc: Column, text: Column, on: Column) -> Column:
        span = F.struct(acc["at"].alias("start"), F.length(text).cast("bigint").alias("length"))
        return F.struct(
            (acc["at"] + F.length(text) + len(NEXT)).alias("at"),
            F.when(on, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"),
        )

    def block_span(acc: Column, block: Column) -> Column:
        head = F.struct(
            (acc["at"] + len(TURN) + F.length(block["role"]) + len(TEXT)).alias("at"), acc["spans"].alias("spans")
        )
        body = F.aggregate(block["texts"], head, lambda a, t: text_span(a, t, block["role"] == trained))
        return F.struct((body["at"] - len(NEXT) + len(END)).alias("at"), body["spans"].alias("spans"))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(SPANS).alias("spans"))
    return F.aggregate(blocks, start, block_span, lambda a: a["spans"])


def format_conversations(
    rows: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    trained: str = "assistant",
) -> DataFrame:
    """One row per conversation: ``conv_id``, ``formatted`` and ``loss_spans``.

    ``loss_spans`` holds start and length, in code points, of every text of the
    ``trained`` role in ``formatted``.
    """
    turns = rows.select(
        F.col(conv_id).alias("conv_id"),
        F.struct(
            F.col(turn).alias("turn"),
            escape(F.coalesce(F.col(role).cast("string"), F.lit(""))).alias("role"),
            escape(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("text"),
        ).alias("t"),
    )
    blocks = (
        turns.groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("t")).alias("turns"))
        .select("conv_id", F.aggregate("turns", F.array().cast(BLOCKS), _merge).alias("blocks"))
    )
    return blocks.select(
        "conv_id",
        F.array_join(
            F.transform(
                "blocks",
                lambda b: F.concat(
                    F.lit(TURN), b["role"], F.lit(TEXT), F.array_join(b["texts"], NEXT), F.lit(END)
                ),
            ),
            "",
        ).alias("formatted"),
        _spans(F.col("blocks"), trained).alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """The single turns of a formatted conversation, as (role, text) structs."""
    blocks = F.filter(F.split(formatted, r"<\|end\|>"), lambda b: b != "")
    parts = F.transform(blocks, lambda b: F.split(b, r"<\|turn\|>|<\|text\|>|<\|next\|>"))
    return F.flatten(
        F.transform(
            parts,
            lambda p: F.transform(
                F.slice(p, F.lit(3), F.size(p)),
                lambda t: F.struct(unescape(F.element_at(p, 2)).alias("role"), unescape(t).alias("text")),
            ),
        )
    )


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped and joined."""
    return F.array_join(
        F.transform(
            spans,
            lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))),
        ),
        "",
    )


def digest(formatted: DataFrame) -> DataFrame:
    """Counts and hashes of what can be read back from the formatted output."""
    back = formatted.select(
        "conv_id",
        read_turns(F.col("formatted")).alias("turns"),
        read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
    listing = F.array_join(
        F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(listing, 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )

"""Operator 1: chat formatting of typed content parts, with DataFrame functions only.

A turn is (conversation, turn, role, parts); a part is text, image, audio or
document. A visitor over the parts writes text as it is (control strings
escaped) and every attachment as a placeholder ``<|image|>`` whose reference and
expanded token count are recorded in order. The placeholders are a closed set: an
attachment of any other kind becomes ``<|attachment|>``, and its kind is recorded
only, so no kind can forge a control string. The template is

    <|im_start|>ROLE\\nTEXT<|im_end|>\\n

A control string starts with ``<|``. Inside texts and roles ``<`` + k
backslashes + ``|`` becomes ``<`` + k+1 backslashes + ``|``, so no text can hold
``<|`` and the step is undone exactly; line breaks of a role become ``<|nl|>``.

The output keeps the loss mask as segments: an array of (text, loss) whose
texts, joined, are the formatted string; the segments of assistant texts alone
carry loss, placeholders inside an assistant's turn don't.

Defined cases: null text, role or reference: empty; null turns sort first; rows
with the same turn are ordered by role, then content, and repeated rows all
stay; a null conversation id is a conversation of its own; extra columns are not
read; an empty table gives no rows; texts of any length are formatted whole. All
turns of a conversation meet in one row, as the formatted conversation is one
string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, LINE, OTHER = "<|im_start|>", "<|im_end|>\n", "<|nl|>", "<|attachment|>"
PART = "struct<kind:string,text:string,ref:string,tokens:int>"
#: Tokens that an attachment stands for when its part has no count of its own.
EXPANDED_TOKENS = {"image": 256, "audio": 128, "document": 512}


def escape(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(LINE))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(LINE), F.lit("\n")))


def text_parts(text: Column) -> Column:
    """A turn that is one text part."""
    return F.array(
        F.struct(
            F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("tokens")
        )
    )


def _is_text(part: Column) -> Column:
    return F.coalesce(part["kind"], F.lit("text")) == "text"


def _visit(parts: Column) -> Column:
    """The parts flattened to array<struct<text,said>>: escaped texts (said) and placeholders, in order.

    Texts with nothing between them are joined before they are escaped, so a control string can't be put together from several
    parts (empty ones included); a turn of one part needs no joining.
    """
    placeholder = lambda p: F.when(p["kind"].isin(*EXPANDED_TOKENS), F.concat(F.lit("<|"), p["kind"], F.lit("|>"))).otherwise(OTHER)
    piece = lambda p: F.struct(F.when(_is_text(p), F.coalesce(p["text"], F.lit(""))).otherwise(placeholder(p)).alias("text"), _is_text(p).alias("said"))

    def join(done: Column, p: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        longer = F.struct(F.concat(last["text"], F.coalesce(p["text"], F.lit(""))).alias("text"), F.lit(True).alias("said"))
        return F.when(_is_text(p) & F.coalesce(last["said"], F.lit(False)), F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(piece(p))))

    joined = F.when(F.size(parts) <= 1, F.transform(parts, piece)).otherwise(F.aggregate(parts, F.array().cast("array<struct<text:string,said:boolean>>"), join))
    return F.transform(joined, lambda x: F.struct(F.when(x["said"], escape(x["text"])).otherwise(x["text"]).alias("text"), x["said"].alias("said")))


def _attached(parts: Column) -> Column:
    """The attachments of the parts, in order."""
    count = F.create_map(*[F.lit(x) for kv in EXPANDED_TOKENS.items() for x in kv])
    return F.transform(
        F.filter(parts, lambda p: ~_is_text(p)),
        lambda p: F.struct(
            p["kind"].alias("kind"),
            F.coalesce(p["ref"], F.lit("")).alias("ref"),
            F.coalesce(p["tokens"], F.try_element_at(count, p["kind"]), F.lit(1)).cast("long").alias("tokens"),
        ),
    )


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, parts) to one row per conversation.

    Returns conv_id, n_turns, formatted, segments array<struct<text,loss>>, attachments
    array<struct<kind,ref,tokens>> and expanded_tokens (the attachments' total).
    """
    parts = F.coalesce(F.col("parts"), F.array().cast(f"array<{PART}>"))
    rows = turns.select(
        "conv_id",
        F.struct(
            F.col("turn").alias("turn"),
            F.coalesce("role", F.lit("")).alias("role"),
            _visit(parts).alias("body"),
            _attached(parts).alias("attached"),
        ).alias("row"),
    )
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    segments = F.flatten(
        F.transform(
            "rows",
            lambda r: F.concat(
                F.array(F.struct(F.concat(F.lit(START), escape_role(r["role"]), F.lit("\n")).alias("text"), F.lit(False).alias("loss"))),
                F.transform(r["body"], lambda b: F.struct(b["text"].alias("text"), (b["said"] & (r["role"] == "assistant")).alias("loss"))),
                F.array(F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss"))),
            ),
        )
    )
    chats = chats.select(
        "conv_id",
        F.size("rows").cast("long").alias("n_turns"),
        segments.alias("segments"),
        F.flatten(F.transform("rows", lambda r: r["attached"])).alias("attachments"),
    )
    return chats.select(
        "conv_id",
        "n_turns",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        "segments",
        "attachments",
        F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("expanded_tokens"),
    )


def parse_turns(formatted: Column) -> Column:
    """The formatted string back to array<struct<role,text>>, unescaped (attachments stay placeholders)."""
    pieces = F.split(formatted, r"<\|im_end\|>\n", -1)
    turns = F.slice(pieces, F.lit(1), F.size(pieces) - F.lit(1))
    body = lambda p: F.substr(p, F.lit(len(START) + 1))
    return F.transform(
        turns,
        lambda p: F.struct(
            unescape_role(F.substring_index(body(p), "\n", 1)).alias("role"),
            unescape(F.substr(p, F.lit(len(START) + 2) + F.char_length(F.substring_index(body(p), "\n", 1)))).alias("text"),
        ),
    )


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, in order, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")

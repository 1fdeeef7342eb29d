"""Chat formatting with a grammar round trip, in DataFrame functions only.

A conversation is rendered turn by turn as

    <s>ROLE[INST] TEXT [/INST]</s>

and read back by a deterministic parser: cut at ``</s>``, then at ``[INST]``, then take off the
fixed frame and undo escapes. A conversation is first rendered with its texts as they are. Where
the parser does not give back the very turns (a text holds a control string or a backslash), its
texts and roles are escaped and it is rendered again: a backslash is doubled, and each control
string is broken by a backslash after its first character, so that it occurs nowhere in a text.
Unescaping reads backslashes from left to right, so the second rendering always reads back;
``round_trips`` reports it for every row.

Defined cases: null text and null role are empty; a null turn comes first; equal turns are ordered
by role, then text, and repeated rows stay; empty texts are turns; an empty table gives no rows;
null conversation ids form one conversation; only the four named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Control strings of the template; fixed values.
CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]"]
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in CONTROLS:
        out = F.replace(out, F.lit(control), F.lit(control[0] + "\\" + control[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<s>"), role, F.lit("[INST] "), text, F.lit(" [/INST]</s>"))


def render(turns: Column, escaped: bool) -> Column:
    """The formatted text of an array of (role, text)."""
    form = escape if escaped else (lambda c: c)
    return F.array_join(F.transform(turns, lambda t: _turn(form(t["role"]), form(t["text"]))), "")


def parse(formatted: Column) -> Column:
    """The turns of a formatted text; pieces that break the grammar become turns that differ from any source."""
    pieces = F.split(formatted, "</s>", -1)
    whole = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))

    def turn(piece: Column) -> Column:
        cut = F.instr(piece, "[INST] ")
        framed = piece.startswith("<s>") & (cut > 0) & piece.endswith(" [/INST]")
        role = F.substring(piece, F.lit(4), cut - 4)
        text = F.substring(piece, cut + 7, F.length(piece) - cut - 14)
        fits = framed & (F.length(piece) - cut >= 14)
        return F.struct(
            F.when(fits, unescape(role)).alias("role"),
            F.when(fits, unescape(text)).alias("text"),
        )

    return F.transform(whole, turn)


def _flat(turns: Column) -> Column:
    """Injective text of the turns, to compare two arrays."""
    part = lambda c: F.concat(F.length(c).cast("string"), F.lit(":"), c)
    return F.array_join(
        F.transform(turns, lambda t: F.coalesce(F.concat(part(t["role"]), part(t["text"])), F.lit("?"))), ""
    )


def format_conversations(conversations: DataFrame) -> DataFrame:
    """One row per conversation: ``turns``, ``formatted``, ``escaped``, ``parsed``, ``round_trips``.

    The turns of one conversation are gathered because its formatted text is one value.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turn = F.struct(F.col("turn").cast("long").alias("turn"), empty("role").alias("role"), empty("text").alias("text"))
    gathered = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    plain = gathered.withColumn("formatted", render(F.col("turns"), False))
    same = _flat(parse(F.col("formatted"))) == _flat(F.col("turns"))
    escaped = plain.withColumn("escaped", ~same).withColumn(
        "formatted", F.when(F.col("escaped"), render(F.col("turns"), True)).otherwise(F.col("formatted"))
    )
    return escaped.withColumn("parsed", parse(F.col("formatted"))).withColumn(
        "round_trips", _flat(F.col("parsed")) == _flat(F.col("turns"))
    )


def loss_text(parsed: Column) -> Column:
    """Unescaped text under the loss mask: the assistant's texts, in order."""
    return F.array_join(F.transform(F.filter(parsed, lambda t: t["role"] == ASSISTANT), lambda t: t["text"]), "")


def digests(formatted: DataFrame) -> DataFrame:
    """The contract's columns, taken from what the parser read back."""
    turns = F.array_join(F.transform("parsed", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = loss_text(F.col("parsed"))
    return formatted.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.size("parsed").cast("long").alias("n_turns"),
        F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "escaped",
        "round_trips",
    )

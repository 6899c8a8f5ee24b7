"""Chat formatting with a grammar round trip.

A turn is rendered as ``<|im_start|>role``, a line end, its text, ``<|im_end|>`` and a line
end. The parser is deterministic: it cuts the output at every ``<|im_start|>``, wants one
``<|im_end|>`` and a line end at the very end of each piece, takes the role up to the first
line end, and then undoes escapes. Each turn is first rendered as it is and parsed back; a
turn that does not come back identical is rendered again with its conflicting content
escaped: ``<``, any number of backslashes and ``|`` get one backslash more, and a line end
in a role becomes ``<n|``. No control string is left inside such a turn, and undoing takes
one backslash away, so the second round is identical, which ``identical`` tells by
comparison of the whole output with the source. DataFrame functions only.

Defined cases: null roles and texts are empty; a conversation's turns are ordered by
``turn`` (null first), then role and text, repeated rows being repeated turns; a null
``conv_id`` is one conversation; no rows give no conversations; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
LOSS_ROLE = "assistant"
_START, _END = r"<\|im_start\|>", r"<\|im_end\|>"


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(f"{END}\n"))


def escape_text(x: Column) -> Column:
    return F.regexp_replace(x, r"<(\\*)\|", r"<$1\\|")


def escape_role(x: Column) -> Column:
    return F.replace(F.regexp_replace(x, r"<(\\*)(n?)\|", r"<$1\\$2|"), F.lit("\n"), F.lit("<n|"))


def unescape_text(x: Column) -> Column:
    return F.regexp_replace(x, r"<\\(\\*)\|", r"<$1|")


def unescape_role(x: Column) -> Column:
    return F.regexp_replace(F.replace(x, F.lit("<n|"), F.lit("\n")), r"<\\(\\*)(n?)\|", r"<$1$2|")


def parse(formatted: Column) -> Column:
    """Array of ``(role, text, raw_role, raw)`` read from an output; a null element where it
    breaks the grammar. ``raw`` is the text as it stands there."""

    def turn(piece: Column) -> Column:
        halves = F.split(piece, _END)
        head = F.substring_index(halves[0], "\n", 1)
        raw = F.substr(halves[0], F.char_length(head) + 2)
        fits = (F.size(halves) == 2) & (halves[1] == "\n") & F.contains(halves[0], F.lit("\n"))
        return F.when(fits, F.struct(unescape_role(head).alias("role"), unescape_text(raw).alias("text"), head.alias("raw_role"), raw.alias("raw")))

    pieces = F.split(formatted, _START)
    broken = F.array(F.lit(None).cast("struct<role:string,text:string,raw_role:string,raw:string>"))
    return F.when(pieces[0] == "", F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), turn)).otherwise(broken)


def rendered_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, escaped, out``: each turn at the first round that comes back."""
    source = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # Only a turn with one of these can fail to come back, so only such are parsed.
    suspect = F.col("text").rlike(r"<\\*\|") | F.col("role").rlike(r"<\\*n?\||\n")
    back = parse(render(F.col("role"), F.col("text")))
    same = (F.size(back) == 1) & back[0]["role"].eqNullSafe(F.col("role")) & back[0]["text"].eqNullSafe(F.col("text"))
    first = source.withColumn("escaped", F.when(suspect, ~F.coalesce(same, F.lit(False))).otherwise(F.lit(False)))
    out = F.when(F.col("escaped"), render(escape_role(F.col("role")), escape_text(F.col("text")))).otherwise(render(F.col("role"), F.col("text")))
    return first.withColumn("out", out)


def digest_text(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")


def format_chats(turns: DataFrame) -> DataFrame:
    """``conv_id, formatted, loss, turns, identical``, a row per conversation.

    ``loss`` holds the assistant texts' ``(begin, end)`` in characters of ``formatted``;
    ``turns`` is what the parser reads back, and ``identical`` that it is the source.
    """
    whole = rendered_turns(turns).groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text", "out"))).alias("source")
    )
    formatted = F.array_join(F.transform("source", lambda x: x["out"]), "")
    whole = whole.select("conv_id", formatted.alias("formatted"), F.sha2(digest_text(F.col("source")), 256).alias("wanted"))
    whole = whole.withColumn("turns", parse(F.col("formatted")))
    head, tail = len(START) + 1, len(END) + 1
    width = lambda t: F.char_length(t["raw_role"]) + F.char_length(t["raw"]) + head + tail
    at = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,end:int>>").alias("spans"))

    def step(a: Column, t: Column) -> Column:
        begin = a["at"] + head + F.char_length(t["raw_role"])
        span = F.array(F.struct(begin.alias("begin"), (begin + F.char_length(t["raw"])).alias("end")))
        return F.struct((a["at"] + width(t)).alias("at"), F.when(t["role"] == LOSS_ROLE, F.concat(a["spans"], span)).otherwise(a["spans"]).alias("spans"))

    loss = F.aggregate("turns", at, step, lambda a: a["spans"])
    same = F.sha2(digest_text(F.col("turns")), 256) == F.col("wanted")
    return whole.select("conv_id", "formatted", loss.alias("loss"), "turns", F.coalesce(same, F.lit(False)).alias("identical"))


def loss_text(formatted: Column, loss: Column) -> Column:
    """Text under the mask, read from the output and unescaped span by span."""
    return F.array_join(F.transform(loss, lambda s: unescape_text(F.substr(formatted, s["begin"] + 1, s["end"] - s["begin"]))), "")


def report(turns: DataFrame) -> DataFrame:
    """The digests of each conversation, read back from its output."""
    made = format_chats(turns).withColumn("under", loss_text(F.col("formatted"), F.col("loss")))
    return made.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(digest_text(F.col("turns")), 256).alias("turns_sha256"),
        F.char_length("under").cast("long").alias("loss_chars"),
        F.sha2("under", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "identical",
    )

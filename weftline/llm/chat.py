r"""Chat formatting: event-sourced reconstruction of conversations, then a template with reversible escapes.

Only DataFrame functions. `reconstruct` folds a log of events into final messages; `render` writes each conversation
as one string with the spans under the loss mask; `read_back` parses such strings into turns again.

A log row: conv_id, seq, event, turn, role, text. Events, in the order of seq:
  message     sets the turn's role and text
  delta       appends its text to the turn
  edit        replaces the turn's text
  regenerate  empties the turn and removes every later turn of the conversation
An event with an unknown or null name counts as a message. A turn exists if an event names it and no later
regenerate of an earlier turn removes it; its role is that of its last event that has one.

The template writes a turn as `<s>[INST] role [/INST] text</s>`. Texts and roles are escaped: a backslash becomes two,
and the first character of each control string becomes \l (for <) or \b (for [), so no control string is left inside
and undoing it restores every character.

Defined cases: a null text or role is empty; rows with a null conv_id form one conversation with a null id; events
with a null turn are dropped (they name no message), null seq sorts first; ties in seq are ordered by event, role and
text, so that repeated rows give one result; an empty log gives an empty table; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Control strings (never left unescaped in a text): <s> </s> <<SYS>> <</SYS>> [INST] [/INST]
OPEN, ROLE_END, CLOSE = "<s>[INST] ", " [/INST] ", "</s>"
EVENTS = ["message", "delta", "edit", "regenerate"]


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    angled = F.regexp_replace(doubled, r"<(?=/?s>|</?SYS>>)", r"\\l")
    return F.regexp_replace(angled, r"\[(?=/?INST\])", r"\\b")


def unescape(text: Column) -> Column:
    """Escapes are read from left to right: pieces between doubled backslashes hold only \\l and \\b."""
    pieces = F.split(text, r"\\\\", -1)
    return F.array_join(F.transform(pieces, lambda p: F.replace(F.replace(p, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("["))), "\\")


def reconstruct(log: DataFrame) -> DataFrame:
    """conv_id, turn, role, text: the final messages of each conversation.

    One sort by conversation and sequence finds what later regenerations remove; a second by turn finds each turn's
    last setting event; then a turn's texts are joined. The largest thing gathered is one turn's text.
    """
    known = F.when(F.col("event").isin(EVENTS), F.col("event")).otherwise("message")
    log = log.where("turn is not null").select("conv_id", "seq", known.alias("event"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("seq").asc_nulls_first(), F.col("event"), F.col("role"), F.col("text")]
    back = [F.col("seq").desc_nulls_last(), F.col("event").desc(), F.col("role").desc(), F.col("text").desc()]
    later = Window.partitionBy("conv_id").orderBy(*back).rowsBetween(Window.unboundedPreceding, -1)
    cut = F.min(F.when(F.col("event") == "regenerate", F.col("turn"))).over(later)
    live = log.withColumn("_cut", cut).where("_cut is null or turn <= _cut").drop("_cut")
    turn = Window.partitionBy("conv_id", "turn").orderBy(*order)
    placed = live.withColumn("_at", F.row_number().over(turn))
    return (
        placed.groupBy("conv_id", "turn")
        .agg(
            F.array_sort(F.collect_list(F.struct("_at", "event", "role", "text"))).alias("_events"),
            F.max(F.when(F.col("event") != "delta", F.col("_at"))).alias("_set"),
        )
        .select(
            "conv_id",
            "turn",
            F.coalesce(F.get(F.filter(F.reverse("_events"), lambda e: e["role"] != ""), F.lit(0))["role"], F.lit("")).alias("role"),
            F.array_join(
                F.transform(
                    F.filter("_events", lambda e: (e["_at"] >= F.coalesce(F.col("_set"), F.lit(0))) & (e["event"] != "regenerate")), lambda e: e["text"]
                ),
                "",
            ).alias("text"),
        )
    )


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_spans: array of (start, end) in code points of formatted, the texts of `loss_role`."""
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(ROLE_END))
    turns = messages.select(
        "conv_id", "turn", "role", "text", head.alias("_head"), escape(F.col("text")).alias("_body")
    ).withColumn("_piece", F.concat("_head", "_body", F.lit(CLOSE)))
    row = F.struct(
        "turn",
        (F.col("role") == loss_role).alias("loss"),
        F.length("_head").alias("head"),
        F.length("_body").alias("body"),
        F.col("_piece").alias("piece"),
    )
    gathered = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("_turns"))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("spans"))

    def add(acc, t):
        begin = acc["at"] + t["head"]
        span = F.struct(begin.alias("start"), (begin + t["body"]).alias("end"))
        return F.struct(
            (begin + t["body"] + F.lit(len(CLOSE))).alias("at"),
            F.when(t["loss"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"),
        )

    return gathered.select(
        "conv_id",
        F.array_join(F.transform("_turns", lambda t: t["piece"]), "").alias("formatted"),
        F.aggregate("_turns", start, add)["spans"].alias("loss_spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds turns (array of role, text), parsed from `formatted` alone, and loss_texts, cut at loss_spans."""
    pieces = F.filter(F.split("formatted", CLOSE, -1), lambda p: p != "")
    halves = lambda p: F.split(p, r" \[/INST\] ", -1)
    turn = lambda p: F.struct(
        unescape(F.replace(F.get(halves(p), F.lit(0)), F.lit(OPEN), F.lit(""))).alias("role"),
        unescape(F.get(halves(p), F.lit(1))).alias("text"),
    )
    spans = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    return formatted.withColumns({"turns": F.transform(pieces, turn), "loss_texts": spans})

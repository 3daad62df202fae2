"""Chat formatting with a grammar round trip, in DataFrame functions only.

Grammar of a formatted conversation::

    conversation = "<s>" turn* "</s>"
    turn         = "[INST]" role "\\n" text "[/INST]"

A text that holds one of the four control strings would change the parse. Each conversation is rendered as
it is, parsed again and compared with its source; where the two differ, it is rendered with the conflicting
strings escaped (one backslash after their first character, on top of any that are there already) and compared again.
Reading always takes one backslash away, so the escape is reversible for every text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTROL = r"([<\[])(\\*)(/?(?:s>|INST\]))"
ESCAPED = r"([<\[])\\(\\*)(/?(?:s>|INST\]))"
#: A parser takes what lies between the last opening and the first closing after it, and in it, turn by turn.
WHOLE = r"(?s)^.*<s>(.*?)</s>"
TURN = r"(?s)\[INST\](.*?)\[/INST\]"
#: Turns of one conversation that are gathered together before the conversation is put together.
SPAN = 64


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def _role_out(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def _role_in(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def render(turns: Column, escaped: bool) -> Column:
    """One string from an array of (role, text)."""
    out = escape if escaped else (lambda c: c)
    parts = F.transform(turns, lambda t: F.concat(F.lit("[INST]"), out(_role_out(t["role"])), F.lit("\n"), out(t["text"]), F.lit("[/INST]")))
    return F.concat(F.lit("<s>"), F.array_join(parts, ""), F.lit("</s>"))


def parse(formatted: Column) -> Column:
    """The (role, text) array of a formatted conversation."""
    bodies = F.regexp_extract_all(F.regexp_extract(formatted, WHOLE, 1), F.lit(TURN), F.lit(1))
    return F.transform(
        bodies,
        lambda b: F.struct(
            _role_in(F.substring_index(b, "\n", 1)).alias("role"),
            unescape(F.substr(b, F.length(F.substring_index(b, "\n", 1)) + 2)).alias("text"),
        ),
    )


def format_conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, formatted, escaped, round_trip): one row for each conversation.

    Null roles and texts count as empty. Turns go by turn number (null first), then role, then text, so repeated
    rows stay and ties have a fixed order. A null conversation id is a conversation of its own. No rows: no rows.
    Other columns are ignored. ``round_trip`` says that the parsed turns equal the source; it is always true.

    Turns are first gathered by spans of turn numbers and only then by conversation, so no task sorts a
    conversation's raw turns alone; the finished string of one conversation is one value by nature.
    """
    rows = df.select(
        F.col(conv).alias("conv"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    spans = rows.groupBy("conv", F.expr(f"turn div {SPAN}").alias("span")).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    whole = spans.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("span", F.lit(-(2**62))).alias("span"), "turns"))).alias("spans"))
    source = F.transform(F.flatten(F.col("spans")["turns"]), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    out = whole.select("conv", source.alias("source")).withColumn("plain", render(F.col("source"), False))
    out = out.withColumn("escaped", parse(F.col("plain")) != F.col("source"))
    out = out.withColumn("formatted", F.when(F.col("escaped"), render(F.col("source"), True)).otherwise(F.col("plain")))
    return out.select(F.col("conv").alias(conv), "formatted", "escaped", (parse(F.col("formatted")) == F.col("source")).alias("round_trip"))


def loss_text(turns: Column, role: str = "assistant") -> Column:
    """The text under the loss mask: that of one role's turns, in order."""
    kept = F.filter(turns, lambda t: t["role"] == role)
    return F.array_join(F.transform(kept, lambda t: t["text"]), "")

"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes one example: all preceding turns are context and only that
reply is trainable. Turns after the last assistant turn (or a conversation without one)
come as one more example without a trainable part, so that no text is lost.

Template: `<s>` begins an example; `[INST] text [/INST]` is a user turn, `[SYS] text
[/SYS]` a system turn, `text</s>` an assistant turn and `[ROLE]role[/ROLE]text[/TURN]` any
other role. A control string inside a text gets `\\i` for its `[` or `\\s` for its `<`, and
`\\` itself becomes `\\e`, so the template can be read back without loss.

Turns are ordered by turn (null first), then role, then text, so ties and repeated rows
have one defined order and are all kept. A null text is empty; a null role is the
role "". A null conv_id is a conversation of its own. Extra columns are ignored; an
empty table gives no example. The rows of one conversation meet in one row, since its last
example holds the whole conversation in any case; examples are made row by row from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the control strings of the template
CONTROL = r"(?=/?(?:INST|SYS|ROLE|TURN)\])"
TURN = r"(?s)\[INST\] .*? \[/INST\]|\[SYS\] .*? \[/SYS\]|\[ROLE\].*?\[/ROLE\].*?\[/TURN\]|.*?</s>"


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\e"))
    text = F.regexp_replace(text, r"\[" + CONTROL, r"\\i")
    return F.regexp_replace(text, r"<(?=/?s>)", r"\\s")


def unescape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\s"), F.lit("<"))
    return F.replace(F.replace(text, F.lit("\\i"), F.lit("[")), F.lit("\\e"), F.lit("\\"))


def _marked(role: Column, text: Column) -> Column:
    body = escape(text)
    return (
        F.when(role == "user", F.concat(F.lit("[INST] "), body, F.lit(" [/INST]")))
        .when(role == "system", F.concat(F.lit("[SYS] "), body, F.lit(" [/SYS]")))
        .when(role == "assistant", F.concat(body, F.lit("</s>")))
        .otherwise(F.concat(F.lit("[ROLE]"), escape(role), F.lit("[/ROLE]"), body, F.lit("[/TURN]")))
    )


def examples(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, example, n_turns, formatted, loss_start, loss_stop); offsets in code points, equal where nothing is trained."""
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    talks = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    talks = talks.withColumn("marked", F.transform("turns", lambda t: _marked(t["role"], t["text"])))
    ends = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: F.element_at("turns", i)["role"] == "assistant")
    # a last example without target, unless the conversation ends with a reply
    ends = F.when(F.element_at("turns", -1)["role"] == "assistant", ends).otherwise(F.concat(ends, F.array(F.size("turns"))))
    each = talks.select("conv_id", "turns", "marked", F.posexplode(ends).alias("example", "n_turns"))
    target = F.element_at("turns", F.col("n_turns"))
    each = each.withColumn("context", F.concat(F.lit("<s>"), F.array_join(F.expr("slice(marked, 1, n_turns - 1)"), "")))
    each = each.withColumn("last", F.element_at("marked", F.col("n_turns")))
    stop = F.when(target["role"] == "assistant", F.length("context") + F.length("last") - 4).otherwise(F.length("context"))
    return each.select("conv_id", "example", "n_turns", F.concat("context", "last").alias("formatted"), F.length("context").alias("loss_start"), stop.alias("loss_stop"))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted example."""
    inner = lambda s, head, tail: unescape(F.substring(s, F.lit(head + 1), F.length(s) - (head + tail)))

    def parsed(s: Column) -> Column:
        other = F.substring(s, F.lit(7), F.length(s) - 6 - 7)
        role = F.substring_index(other, "[/ROLE]", 1)
        rest = F.substring(other, F.length(role) + 8, F.length(other))
        as_turn = lambda r, t: F.struct(r.alias("role"), t.alias("text"))
        return (
            F.when(s.startswith("[INST] "), as_turn(F.lit("user"), inner(s, 7, 8)))
            .when(s.startswith("[SYS] "), as_turn(F.lit("system"), inner(s, 6, 7)))
            .when(s.startswith("[ROLE]"), as_turn(unescape(role), unescape(rest)))
            .otherwise(as_turn(F.lit("assistant"), inner(s, 0, 4)))
        )

    return F.transform(F.regexp_extract_all(F.substring(formatted, F.lit(4), F.length(formatted)), F.lit(TURN), F.lit(0)), parsed)


def trained_text(formatted: Column, start: Column, stop: Column) -> Column:
    return unescape(F.substring(formatted, start + 1, stop - start))

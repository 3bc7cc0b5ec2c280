"""Operator 7: chat formatting by event-sourced reconstruction; DataFrame and SQL functions only.

A log has rows (conv_id, seq, turn, kind, role, text). It is partitioned by conversation, sorted by sequence, and folded:

* `delta` appends text to the message of its turn,
* `edit` replaces that message's text,
* `regenerate` empties it and drops all later turns as they stood (the old branch).

Final messages are rendered by the template  <|ROLE|>\\nTEXT<|end|>\\n . Inside roles and texts a backslash is added between
`<` and `|` (and, in roles, between `|` and `>`), however many are there already, so control strings cannot occur in them and
the escape is undone by taking one away. loss_turns flags the turns whose (escaped) text is under the loss mask: assistants'.

Defined results: null text and null role are empty; events of equal seq are folded in the order kind, role, text; rows that
repeat another all count; a null conv_id is a conversation of its own; extra columns are ignored; no rows, no conversations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import pick

END = "<|end|>\n"


def escape(text: Column, role: bool = False) -> Column:
    out = F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")
    return F.regexp_replace(out, r"\|(\\*)>", r"|$1\\>") if role else out


def unescape(text: Column, role: bool = False) -> Column:
    out = F.regexp_replace(text, r"\|(\\*)\\>", r"|$1>") if role else text
    return F.regexp_replace(out, r"<(\\*)\\\|", r"<$1|")


def events_of_turns(conversations: DataFrame) -> DataFrame:
    """A table of whole turns as a streamed log: each row becomes two deltas, the halves of its text. Rows are numbered by turn
    (then role and text), so that rows that repeat a turn stay messages of their own."""
    c = pick(conversations, ("conv_id", "long"), ("turn", "long"), ("role", "string"), ("text", "string"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text"))
    half = F.floor(F.length("text") / 2).cast("int")
    deltas = F.array(F.substring("text", F.lit(1), half), F.substring("text", half + 1, F.length("text")))
    c = c.withColumn("turn", F.row_number().over(order).cast("long")).select("conv_id", "turn", "role", F.posexplode(deltas).alias("at", "text"))
    return c.select("conv_id", (F.col("turn") * 2 + F.col("at")).alias("seq"), "turn", F.lit("delta").alias("kind"), "role", "text")


def reconstruct(events: DataFrame) -> DataFrame:
    """(conv_id, messages array<struct<turn, role, text>>) after folding each conversation's log."""
    e = pick(events, ("conv_id", "long"), ("seq", "long"), ("turn", "long"), ("kind", "string"), ("role", "string"), ("text", "string"))
    e = e.withColumns({"role": F.coalesce("role", F.lit("")), "text": F.coalesce("text", F.lit("")), "kind": F.coalesce("kind", F.lit("delta"))})
    # what comes later in the log: a running minimum over the log read backwards, linear in its length
    later = Window.partitionBy("conv_id").orderBy(F.desc_nulls_last("seq"), F.desc("kind"), F.desc("role"), F.desc("text"), F.desc("turn")).rowsBetween(Window.unboundedPreceding, -1)
    e = e.withColumn("cut", F.min(F.when(F.col("kind") == "regenerate", F.col("turn"))).over(later))
    e = e.filter("cut is null or turn is null or turn <= cut")
    one = F.sort_array(F.collect_list(F.struct("seq", "kind", "role", "text")))
    turns = e.groupBy("conv_id", "turn").agg(one.alias("log"))
    # fold of a turn: what follows its last edit or regeneration, after that edit's text
    resets = F.transform("log", lambda x, i: F.when(x["kind"] != "delta", i + 1))
    turns = turns.withColumn("last", F.coalesce(F.array_max(resets), F.lit(0)).cast("int"))
    tail = F.slice("log", F.col("last") + 1, F.greatest(F.size("log") - F.col("last"), F.lit(0)))
    start = F.when((F.col("last") > 0) & (F.get("log", F.col("last") - 1)["kind"] == "edit"), F.get("log", F.col("last") - 1)["text"]).otherwise("")
    role = F.coalesce(F.get(F.filter(F.transform("log", lambda x: x["role"]), lambda r: r != ""), F.lit(0)), F.lit(""))
    turns = turns.select("conv_id", F.struct("turn", role.alias("role"), F.concat(start, F.array_join(F.transform(tail, lambda x: x["text"]), "")).alias("text")).alias("message"))
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("message")).alias("messages"))


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_turns array<boolean>)."""
    body = F.transform("messages", lambda m: F.concat(F.lit("<|"), escape(m["role"], role=True), F.lit("|>\n"), escape(m["text"]), F.lit(END)))
    return messages.select("conv_id", F.array_join(body, "").alias("formatted"), F.transform("messages", lambda m: m["role"] == "assistant").alias("loss_turns"))


def read_back(rendered: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<role, text, loss>>) from the formatted text and its mask alone."""
    parts = F.filter(F.split("formatted", r"<\|end\|>\n"), lambda p: p != "")
    turn = F.transform(parts, lambda p, i: F.struct(
        unescape(F.regexp_extract(p, r"(?s)\A<\|(.*?)\|>\n", 1), role=True).alias("role"),
        unescape(F.regexp_extract(p, r"(?s)\A<\|.*?\|>\n(.*)\z", 1)).alias("text"),
        F.get("loss_turns", i).alias("loss"),
    ))
    return rendered.select("conv_id", turn.alias("turns"), F.length("formatted").cast("long").alias("formatted_chars"))


def digest(conversations: DataFrame) -> DataFrame:
    """Format all conversations and describe what is read back from the output."""
    read = read_back(render(reconstruct(events_of_turns(conversations))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.encode(said, "UTF-8"), 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(F.encode(loss, "UTF-8"), 256).alias("loss_sha256"), "formatted_chars")

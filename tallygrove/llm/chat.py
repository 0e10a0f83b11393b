"""Chat formatting with a grammar round trip.

A turn is written between the control strings of its role; inside, text is
plain. A deterministic parser reads a rendered turn back. Where the recovered
turn is not the source (the text holds a control string, or what an escaped one
looks like), the text is escaped and read back again. Escaping puts one backslash
behind the first character of each control string, and one more into those that
have some already, so it can be undone and touches nothing else; one application
leaves no control string, so the loop has two rounds and ``identical`` tells that
the second sufficed.

Turns are ordered by turn (nulls last), then role and text, so ties and repeated
rows have one result. Null texts and roles count as empty. Rows without conv_id
form one conversation. A conversation becomes one row, as a training example
must; its length is bounded by what a reader could use, conversations are dealt
over all tasks. An empty table gives no rows; other columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Opening and closing control strings; other roles are named inside the turn.
TEMPLATE = {
    "system": ("[SYS]", "[/SYS]"),
    "user": ("[INST]", "[/INST]"),
    "assistant": ("<s>", "</s>"),
}
OTHER = ("[ROLE]", "[/ROLE]", "[/TURN]")
LOSS_ROLE = "assistant"

# A control string with any number of backslashes put into it.
_NAMED = r"(<|\[)(\\*)(/?s>|/?INST\]|/?SYS\]|/?ROLE\]|/?TURN\])"
_ESCAPED = r"(<|\[)\\(\\*)(/?s>|/?INST\]|/?SYS\]|/?ROLE\]|/?TURN\])"
CONTROL = r"(<|\[)(/?s>|/?INST\]|/?SYS\]|/?ROLE\]|/?TURN\])"
TURN = r"(?s)\[SYS\].*?\[/SYS\]|\[INST\].*?\[/INST\]|<s>.*?</s>|\[ROLE\].*?\[/ROLE\].*?\[/TURN\]"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _NAMED, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def _between(text: Column, opening: str, closing: str) -> Column:
    n = len(opening) + len(closing)
    return F.substring(text, F.lit(len(opening) + 1), F.greatest(F.length(text) - n, F.lit(0)))


def _head(role: Column) -> Column:
    """What stands before the text, given the role as it is to be written."""
    named = F.concat(F.lit(OTHER[0]), role, F.lit(OTHER[1]))
    out = named
    for name, (opening, _) in TEMPLATE.items():
        out = F.when(role == name, F.lit(opening)).otherwise(out)
    return out


def _tail(role: Column) -> Column:
    out = F.lit(OTHER[2])
    for name, (_, closing) in TEMPLATE.items():
        out = F.when(role == name, F.lit(closing)).otherwise(out)
    return out


def parse_turn(turn: Column) -> Column:
    """(role, text) of a rendered turn; null for a turn outside the grammar."""

    def checked(role: Column, inner: Column, *more: Column) -> Column:
        bad = inner.rlike(CONTROL)
        for m in more:
            bad = bad | m.rlike(CONTROL)
        return F.when(
            ~bad, F.struct(unescape(role).alias("role"), unescape(inner).alias("text"))
        )

    opening, middle, closing = OTHER
    inner = _between(turn, opening, closing)
    role = F.substring_index(inner, middle, 1)
    text = F.substring(inner, F.length(role) + len(middle) + 1, F.length(inner))
    out = F.when(
        turn.startswith(opening) & turn.endswith(closing) & inner.contains(middle),
        checked(role, text, role),
    )
    for name, (start, end) in TEMPLATE.items():
        content = _between(turn, start, end)
        out = F.when(
            turn.startswith(start) & turn.endswith(end), checked(F.lit(name), content)
        ).otherwise(out)
    return out


def _turn(role: Column, text: Column) -> Column:
    return F.concat(_head(role), text, _tail(role))


def render(df: DataFrame) -> DataFrame:
    """One row per turn: its source, its rendering (``head``, ``body``, ``tail``), whether the
    text had to be escaped, and whether the parser gives the source back."""
    src = df.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    source = F.struct(F.col("role"), F.col("text"))
    plain = src.withColumn("back", parse_turn(_turn(F.col("role"), F.col("text"))))
    tried = plain.withColumn("escaped", F.coalesce(F.col("back") != source, F.lit(True))).drop("back")
    shown_role = F.when(F.col("escaped"), escape(F.col("role"))).otherwise(F.col("role"))
    body = F.when(F.col("escaped"), escape(F.col("text"))).otherwise(F.col("text"))
    out = tried.withColumns({"head": _head(shown_role), "body": body, "tail": _tail(shown_role)})
    back = parse_turn(F.concat("head", "body", "tail"))
    return out.withColumn("identical", F.coalesce(back == source, F.lit(False)))


def format_conversations(df: DataFrame, loss_role: str = LOSS_ROLE) -> DataFrame:
    """One row per conversation: ``formatted``, the loss mask as spans of code
    points (``start``, ``stop``), source turns, and whether reading the whole
    text back gives them."""
    turns = render(df)
    piece = F.struct(
        F.col("turn").isNull().alias("last"), "turn", "role", "text", "head", "body", "tail", "identical"
    )
    rows = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(piece)).alias("t"))
    rows = rows.select(
        "conv_id",
        F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"),
        F.array_join(F.transform("t", lambda x: F.concat(x["head"], x["body"], x["tail"])), "").alias("formatted"),
        F.transform(
            "t",
            lambda x: F.struct(
                x["role"].alias("role"),
                F.length(x["head"]).alias("head"),
                F.length(x["body"]).alias("body"),
                F.length(x["tail"]).alias("tail"),
            ),
        ).alias("sizes"),
        F.forall("t", lambda x: x["identical"]).alias("turns_identical"),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["head"]
        stop = begin + x["body"]
        span = F.array(F.struct(begin.alias("start"), stop.alias("stop")))
        return F.struct(
            (stop + x["tail"]).alias("at"),
            F.when(x["role"] == loss_role, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"),
        )

    rows = rows.withColumn("loss_spans", F.aggregate("sizes", start, step)["spans"])
    rows = rows.withColumn("back", read_turns(F.col("formatted")))
    same = F.coalesce(F.col("back") == F.col("turns"), F.lit(False)) & F.col("turns_identical")
    return rows.select("conv_id", "formatted", "loss_spans", "turns", same.alias("identical"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation."""
    return F.transform(F.regexp_extract_all(formatted, F.lit(TURN), F.lit(0)), parse_turn)


def read_back(out: DataFrame) -> DataFrame:
    """From the formatted text and the loss spans alone: turns and loss text."""
    loss = F.transform(
        "loss_spans",
        lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["stop"] - s["start"])),
    )
    return out.select(
        "conv_id",
        read_turns(F.col("formatted")).alias("turns"),
        F.array_join(loss, "").alias("loss_text"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
        "identical",
    )

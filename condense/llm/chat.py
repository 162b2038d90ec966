"""Chat formatting with a loss mask, as Spark expressions over rows of turns.

The rows of a conversation are collected as structs and sorted. Adjacent turns of one
role become one block: the array of turns is walked with its neighbours, a turn opens
its block if the one before has another role, closes it if the one after has, and is
parted from a neighbour of its own role by a mark. What is collected is one training
example, so a conversation is the unit that has to fit a task.

Control strings inside texts and roles get a backslash after their first character
(those that have backslashes there get one more), so none is left in a text, and taking
one backslash away gives the text back. ``read_back`` restores the turns from the
formatted string alone, and the loss mask (spans of the assistant's texts in code
points) gives the text that is learned from.

Defined results: a NULL text or role is an empty string; turns are ordered by turn
number, NULL first, then by role and text; repeated rows are turns of their own; rows
without conversation id are one conversation; an empty table gives none. Columns
besides the four are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Opening and closing marks of the roles with a form of their own (fixed values of the instruction format).
MARKS = {"user": ("<s>[INST] ", " [/INST]"), "assistant": (" ", "</s>"), "system": ("<<SYS>>\n", "\n<</SYS>>\n\n")}

#: Any other role is named between marks of its own.
ROLE_OPEN, ROLE_NAMED, ROLE_CLOSE = "[ROLE]", "[/ROLE]", "[/TURN]"

#: Between texts of one block.
NEXT = "[NEXT]"

_CONTROL = r"(<<|<|\[)(\\*)(/?SYS>>|/?s>|/?INST\]|/?ROLE\]|/TURN\]|NEXT\])"
_ESCAPED = r"(<<|<|\[)\\(\\*)(/?SYS>>|/?s>|/?INST\]|/?ROLE\]|/TURN\]|NEXT\])"
_BLOCK = r"(?s).*?(?: \[/INST\]|</s>|\n<</SYS>>\n\n|\[/TURN\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, r"$1$2$3")


def _by_role(role: Column, of: int, other: Column) -> Column:
    chain = None
    for name, marks in MARKS.items():
        mark = F.lit(marks[of])
        chain = F.when(role == name, mark) if chain is None else chain.when(role == name, mark)
    return chain.otherwise(other)


def turns_of(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conversation, ``turns``): the sorted turns of each conversation."""
    one = F.struct(
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    return df.groupBy(F.col(conversation)).agg(F.array_sort(F.collect_list(one), _in_order).alias("turns"))


def _in_order(a: Column, b: Column) -> Column:
    """Turn number with NULL first, then role, then text."""
    none_a, none_b = a["turn"].isNull(), b["turn"].isNull()
    order = F.when(none_a & ~none_b, -1).when(~none_a & none_b, 1)
    for name in ("turn", "role", "text"):
        order = order.when(a[name] < b[name], -1).when(a[name] > b[name], 1)
    return order.otherwise(0)


def format_turns(df: DataFrame) -> DataFrame:
    """Add ``formatted`` and ``loss_spans`` (start, end) for the array ``turns``."""

    def piece(t: Column, i: Column) -> Column:
        before = F.try_element_at("turns", F.when(i > 0, i).otherwise(F.size("turns") + 1))["role"]
        after = F.try_element_at("turns", i + 2)["role"]
        opens = before.isNull() | (before != t["role"])
        closes = after.isNull() | (after != t["role"])
        named = F.concat(F.lit(ROLE_OPEN), escape(t["role"]), F.lit(ROLE_NAMED))
        return F.struct(
            F.when(opens, _by_role(t["role"], 0, named)).otherwise(F.lit(NEXT)).alias("open"),
            escape(t["text"]).alias("text"),
            F.when(closes, _by_role(t["role"], 1, F.lit(ROLE_CLOSE))).otherwise(F.lit("")).alias("close"),
            (t["role"] == "assistant").alias("learned"),
        )

    with_pieces = df.withColumn("_pieces", F.transform("turns", piece))
    empty = F.array().cast("array<struct<start:long,end:long>>")

    def step(state: Column, p: Column) -> Column:
        start = state["at"] + F.length(p["open"])
        end = start + F.length(p["text"])
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(
            (end + F.length(p["close"])).alias("at"),
            F.when(p["learned"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"),
        )

    zero = F.struct(F.lit(0).cast("long").alias("at"), empty.alias("spans"))
    whole = F.array_join(F.transform("_pieces", lambda p: F.concat(p["open"], p["text"], p["close"])), "")
    spans = F.aggregate("_pieces", zero, step, lambda s: s["spans"])
    return with_pieces.withColumns({"formatted": whole, "loss_spans": spans}).drop("_pieces")


def format_chats(df: DataFrame, **columns: str) -> DataFrame:
    """One row per conversation: its id, ``formatted`` and ``loss_spans``."""
    return format_turns(turns_of(df, **columns)).drop("turns")


def read_back(formatted: str | Column = "formatted") -> Column:
    """The turns (``role``, ``text``) of a formatted conversation."""
    value = F.col(formatted) if isinstance(formatted, str) else formatted

    def texts(block: Column) -> Column:
        known = [(name, block.endswith(marks[1]), marks) for name, marks in MARKS.items()]
        length = F.length(block)
        named = F.instr(block, ROLE_NAMED)
        role = F.substring(block, len(ROLE_OPEN) + 1, named - len(ROLE_OPEN) - 1)
        start, end = named + len(ROLE_NAMED), F.lit(len(ROLE_CLOSE))
        chain_role = chain_start = chain_end = None
        for name, test, (left, right) in known:
            if chain_role is None:
                chain_role, chain_start, chain_end = (F.when(test, F.lit(v)) for v in (name, len(left) + 1, len(right)))
            else:
                chain_role, chain_start, chain_end = (
                    c.when(test, F.lit(v)) for c, v in ((chain_role, name), (chain_start, len(left) + 1), (chain_end, len(right)))
                )
        chain_role, chain_start, chain_end = chain_role.otherwise(unescape(role)), chain_start.otherwise(start), chain_end.otherwise(end)
        body = F.substring(block, chain_start, length - chain_end - chain_start + 1)
        parts = F.split(body, r"\[NEXT\]", -1)
        return F.transform(parts, lambda t: F.struct(chain_role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(F.regexp_extract_all(value, F.lit(_BLOCK), 0), texts))


def learned_text(formatted: str = "formatted", spans: str = "loss_spans") -> Column:
    """The unescaped text under the loss mask, in order, nothing between."""
    return F.array_join(
        F.transform(
            spans,
            lambda s: unescape(
                F.substring(F.col(formatted), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))
            ),
        ),
        "",
    )

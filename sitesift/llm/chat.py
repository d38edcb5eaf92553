"""Chat formatting that is checked by a grammar round trip.

Grammar of a formatted conversation, read by a deterministic parser:

    conversation = turn*
    turn         = "### " role ": " body "</turn>" "\\n"
    role         = letters, digits, "_", "-", or "=" and the percent-quoted name
    body         = any characters; "\\" before "\\", "###" or "</turn>" makes these literal;
                   a bare "###" or "</turn>" is not part of a body

Each turn is rendered as it is, reparsed and compared to its source. Only if they differ is its
text escaped, first the control strings, then the backslashes too, until it comes back identical.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "###", "</turn>"
PLAIN_ROLE = re.compile(r"[A-Za-z0-9_-]+")
CONTROL = re.compile(r"###|</turn>")
CONTROL_OR_SLASH = re.compile(r"###|</turn>|\\")
ESCAPED_OR_CONTROL = re.compile(r"\\(\\|###|</turn>)|###|</turn>")
HEAD = re.compile(r"### (=?)([^:\n]*): ")
LOSS_ROLE = "assistant"
FORMAT_SCHEMA = (
    "conv_id long, n_turns long, formatted string, "
    "loss array<struct<start: long, end: long>>, n_escaped long"
)


class GrammarError(ValueError):
    """The text is not a formatted conversation."""


def render_role(role: str) -> str:
    return role if PLAIN_ROLE.fullmatch(role) else "=" + quote(role, safe="")


def escape(text: str, level: int) -> str:
    if level == 0:
        return text
    return (CONTROL if level == 1 else CONTROL_OR_SLASH).sub(lambda m: "\\" + m[0], text)


def unescape(body: str) -> str:
    return ESCAPED_OR_CONTROL.sub(lambda m: m[1] if m[1] is not None else m[0], body)


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn; start and end delimit its body."""
    turns, at = [], 0
    while at < len(formatted):
        head = HEAD.match(formatted, at)
        if not head:
            raise GrammarError(f"no turn begins at {at}")
        start = search = head.end()
        pieces = []
        while True:
            found = ESCAPED_OR_CONTROL.search(formatted, search)
            if found is None or found[0] == OPEN:
                raise GrammarError(f"the turn at {at} is not closed")
            pieces.append(formatted[search: found.start()])
            search = found.end()
            if found[0] == CLOSE:
                break
            pieces.append(found[1])
        if not formatted.startswith("\n", search):
            raise GrammarError(f"no line end after the turn at {at}")
        role = unquote(head[2]) if head[1] else head[2]
        turns.append((role, "".join(pieces), start, found.start()))
        at = search + 1
    return turns


def render_turn(role: str, text: str) -> tuple[str, int]:
    """The turn at the lowest level of escaping from which it is parsed back identically."""
    for level in range(3):
        turn = f"{OPEN} {render_role(role)}: {escape(text, level)}{CLOSE}\n"
        try:
            if [t[:2] for t in parse(turn)] == [(role, text)]:
                return turn, level
        except GrammarError:
            continue
    raise GrammarError("no level of escaping brings the turn back")


def format_turns(turns: list[tuple[str, str]], loss_role: str = LOSS_ROLE):
    """(formatted, loss spans, escaped turns) of one conversation, reparsed as a whole."""
    rendered = [render_turn(role, text) for role, text in turns]
    formatted = "".join(turn for turn, _ in rendered)
    parsed = parse(formatted)
    if [t[:2] for t in parsed] != turns:
        raise GrammarError("the conversation does not come back from its text")
    loss = [{"start": t[2], "end": t[3]} for t in parsed if t[0] == loss_role]
    return formatted, loss, sum(level > 0 for _, level in rendered)


def _conversations(frames) -> Iterator[tuple]:
    """(conv_id, turns) from frames sorted by conversation and turn; one is held at a time."""
    current, turns = None, []
    for frame in frames:
        for number, role, text in zip(frame["conv_id"], frame["role"], frame["text"], strict=True):
            key = (None if pd.isna(number) else int(number),)
            if key != current:
                if current is not None:
                    yield current[0], turns
                current, turns = key, []
            turns.append((role or "", text or ""))
    if current is not None:
        yield current[0], turns


def _format(frames):
    rows, size = [], 0

    def out():
        frame = pd.DataFrame(rows, columns=["conv_id", "n_turns", "formatted", "loss", "n_escaped"])
        return frame.astype({"conv_id": "Int64"})

    for number, turns in _conversations(frames):
        formatted, loss, escaped = format_turns(turns)
        rows.append((number, len(turns), formatted, loss, escaped))
        size += len(formatted)
        if size > 1 << 22 or len(rows) >= 2048:
            yield out()
            rows, size = [], 0
    if rows:
        yield out()


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, formatted, loss, n_escaped) of each conversation.

    ``turns`` has conv_id, turn, role, text; other columns are not read. Rows of a conversation
    stand by turn, then role, then text; repeated rows are turns of their own. A null text or role
    is empty, a null turn comes first, rows with a null conv_id are one conversation. ``loss``
    delimits the assistant's texts in ``formatted``, in code points. An empty table gives no rows.
    Rows are dealt by conversation and sorted on disk where needed; a task holds one conversation.
    """
    rows = turns.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInPandas(
        _format, FORMAT_SCHEMA
    )

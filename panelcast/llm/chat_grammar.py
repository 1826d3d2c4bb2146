"""Chat formatting with a grammar round trip.

Grammar of a formatted conversation (control strings are fixed values)::

    conversation = turn*
    turn  = "<s>[INST] " text " [/INST]"                    user
          | " " text " </s>"                                assistant
          | "<s>[ROLE] " role " [INST] " text " [/INST]"    any other role

The parser is deterministic: at each place the opening string decides the kind
of turn, and the first closing string ends it.  A text in which a control
string stands would be read wrongly; so a conversation is formatted, reparsed
and compared with its source, and each turn that did not come back is escaped,
until source and reading agree.  Escaping puts one backslash behind the first
character of each control string, and one more where backslashes already stand
there; reading takes one away.  A fully escaped conversation always reads back,
so this ends.

The loss mask covers the text of assistant turns, as spans of the formatted
string.

Edge cases: turns are ordered by turn (null first), then role, then text; null
text counts as empty; a null role counts as the empty role; repeated rows are
turns like any other; a null conv_id is one conversation; an empty table gives
no rows; extra columns are not read.  A conversation is one cell of the output,
so one at a time is held in memory; the rows come sorted through a shuffle and
are never grouped in memory beyond it.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

USER, TO, OTHER, MID, END = "<s>[INST] ", " [/INST]", "<s>[ROLE] ", " [INST] ", " </s>"
_CONTROL = re.compile(r"(<|\[)(\\*)(s>|/s>|INST\]|/INST\]|ROLE\])")
_ESCAPED = re.compile(r"(<|\[)\\(\\*)(s>|/s>|INST\]|/INST\]|ROLE\])")

BATCH_CHARS = 8_000_000


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def render(turns, escaped) -> tuple[str, list[tuple[int, int]]]:
    """The formatted string and the spans of the assistant texts in it."""
    out, spans, at = [], [], 0
    for (role, text), esc in zip(turns, escaped):
        body = escape(text) if esc else text
        if role == "user":
            parts = (USER, body, TO)
        elif role == "assistant":
            parts = (" ", body, END)
            spans.append((at + 1, at + 1 + len(body)))
        else:
            parts = (OTHER, escape(role) if esc else role, MID, body, TO)
        out.extend(parts)
        at += sum(map(len, parts))
    return "".join(out), spans


class Unreadable(ValueError):
    pass


def _until(s: str, close: str, at: int) -> int:
    end = s.find(close, at)
    if end < 0:
        raise Unreadable(f"no {close!r} after {at}")
    return end


def parse(s: str):
    """The turns (role, text) of a formatted string, with the span of each text."""
    at = 0
    while at < len(s):
        role = "assistant"
        if s.startswith(USER, at):
            role, at, close = "user", at + len(USER), TO
        elif s.startswith(OTHER, at):
            end = _until(s, MID, at + len(OTHER))
            role, at, close = unescape(s[at + len(OTHER):end]), end + len(MID), TO
        elif s.startswith(" ", at):
            at, close = at + 1, END
        else:
            raise Unreadable(f"no turn begins at {at}")
        end = _until(s, close, at)
        yield role, unescape(s[at:end]), at, end
        at = end + len(close)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """Format, reparse, compare; escape what did not come back; repeat."""
    escaped = [False] * len(turns)
    while True:
        s, spans = render(turns, escaped)
        read = 0
        try:
            for role, text, *_ in parse(s):
                if read >= len(turns) or (role, text) != turns[read]:
                    break
                read += 1
            else:
                if read == len(turns):
                    return s, spans
        except Unreadable:
            pass
        # the turn that was misread, and every other that holds a control string
        # (a role has to be escaped if it merely reads like another kind's turn)
        wrong = [k for k, (role, text) in enumerate(turns) if not escaped[k] and _CONTROL.search(role + "\0" + text)]
        k = min(read, len(turns) - 1)
        todo = wrong or [k]
        if all(escaped[i] for i in todo):
            raise Unreadable("a fully escaped conversation did not read back")
        for i in todo:
            escaped[i] = True


_FORMATTED = "conv_id long, formatted string, loss array<struct<start: int, stop: int>>"


def format_conversations(rows: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss (spans)."""
    src = (rows.select(F.col("conv_id").cast("long").cast("string").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"),
                       F.coalesce("text", F.lit("")).alias("text"))
           .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text"))

    def run(batches):
        none = object()
        now, turns, out, size = none, [], [], 0

        def done():
            s, spans = format_turns(turns)
            out.append((now, s, [{"start": a, "stop": b} for a, b in spans]))
            return len(s)

        for b in batches:
            for i, role, text in zip(b["conv_id"], b["role"], b["text"]):
                if i != now:
                    if now is not none:
                        size += done()
                    now, turns = i, []
                turns.append((role, text))
                if size >= BATCH_CHARS:
                    yield _frame(out)
                    out, size = [], 0
        if now is not none:
            done()
        if out:
            yield _frame(out)

    return src.mapInPandas(run, _FORMATTED)


def _frame(out) -> pd.DataFrame:
    d = pd.DataFrame(out, columns=["conv_id", "formatted", "loss"])
    d["conv_id"] = whole(d["conv_id"])
    return d


def whole(ids: pd.Series) -> pd.Series:
    """Ids given as decimal strings or null, exactly as integers or null."""
    return pd.Series([None if i is None else int(i) for i in ids], dtype="Int64")


_READ = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
         "formatted_chars long")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the parser and the loss mask find in formatted strings."""
    def run(batches):
        for b in batches:
            rows = []
            for i, s, spans in zip(b["conv_id"], b["formatted"], b["loss"]):
                turns, n = hashlib.sha256(), 0
                for role, text, *_ in parse(s):
                    turns.update(f"{role}\n{text}\n".encode())
                    n += 1
                loss, chars = hashlib.sha256(), 0
                for p in spans:
                    text = unescape(s[p["start"]:p["stop"]])
                    loss.update(text.encode())
                    chars += len(text)
                rows.append((i, n, turns.hexdigest(), chars, loss.hexdigest(), len(s)))
            d = pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            d["conv_id"] = whole(d["conv_id"])
            yield d

    return formatted.select(F.col("conv_id").cast("string").alias("conv_id"), "formatted", "loss").mapInPandas(run, _READ)

"""Operator 5: chat formatting in budgeted windows.

A conversation's turns are rendered by a template and counted in tokens. Prefix
sums of the counts choose spans of whole turns that fit the budget together
with the system turn, which windows keep, and with the last few turns before
the span, which are repeated as history. The loss covers assistant texts of the
span only, so each is a target once. The marks at the ends of a window count
too. A turn that is over the budget by itself, or with the system turn,
has a window of its own and is not cut; a system turn that alone is over the
budget is in the first window only. So every window of two turns or more,
besides the system turn, is within the budget.

Every turn ends in a newline, which the tokenizer's pattern joins with nothing
there, so the tokens of a window are the sum of those of its turns, and what
the marks at its ends add, which is always the same.

Control strings inside roles and texts are broken up by a backslash, and
backslashes doubled, which ``unescape`` undoes. Turns are ordered by number
(null last), role and text; rows that repeat a number are turns of their own.
Null roles and texts count as empty. Rows without conv_id form one conversation
with a null id. A first turn of role ``system`` is the system turn; later ones
are ordinary. Empty tables give empty results; extra columns are ignored.

Turns are counted where they are read. Then rows are dealt by conversation and
sorted; a conversation streams through its task in runs of turns, so no
conversation is held whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder
from .common import map_batches, slices

BUDGET = 1024
HISTORY = 256
#: Turns, or characters, looked at together.
RUN_TURNS, RUN_CHARS = 1024, 4_000_000

# Strings that may not stand in a role or text.
CONTROLS = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
BEGIN, TURN, TEXT, END, CLOSE = "<s>", "<|turn|>", "<|text|>", "<|end|>\n", "</s>"

_control = regex.compile("|".join(map(regex.escape, CONTROLS)))
_turns = regex.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>\n", regex.S)


def escape(text: str) -> str:
    text = text.replace("\\", "\\\\")
    if "<" not in text and "[" not in text and "|" not in text:  # every control string has one of these
        return text
    while (broken := _control.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)) != text:
        text = broken
    return text


def unescape(text: str) -> str:
    return regex.sub(r"\\(\\?)", r"\1", text) if "\\" in text else text


def render(role: str, text: str) -> str:
    return f"{TURN}{escape(role)}{TEXT}{escape(text)}{END}"


class _Conversation:
    """What the windows of one conversation still need from the turns before."""

    def __init__(self, conv_id, budget: int, history: int, marks: int):
        self.conv_id, self.budget, self.history, self.marks = conv_id, budget - marks, history, marks
        self.system: tuple[str, int] | None = None
        self.past: list[tuple[str, int]] = []
        self.waiting: list[tuple[str, str, int]] = []
        self.window = 0
        self.started = False

    def take(self, turns: list[tuple[str, str, int]], last: bool) -> Iterator[dict]:
        """turns: role, rendered, tokens. Spans that may still grow wait unless this is the last run."""
        turns = self.waiting + turns
        sums = np.cumsum([0, *(t[2] for t in turns)])
        start = 0
        while start < len(turns):
            first = not self.started
            room = self.budget - turns[start][2]
            kept = [self.system] if self.system and self.system[1] <= self.budget else []
            room -= sum(k[1] for k in kept)
            repeated, held = [], 0
            for turn in reversed(self.past):
                if held + turn[1] > min(self.history, room):
                    break
                repeated.append(turn)
                held += turn[1]
            repeated.reverse()
            room += turns[start][2] - held
            stop = max(start + 1, int(np.searchsorted(sums, sums[start] + room, side="right")) - 1)
            if stop >= len(turns) and not last:
                break
            yield self._window(kept + repeated, turns[start:stop])
            self.started = True
            if first and turns[start][0] == "system":
                self.system = turns[start][1:]
            after = [t[1:] for i, t in enumerate(turns[start:stop]) if not (first and i == 0 and self.system)]
            self._remember(after)
            start = stop
        self.waiting = turns[start:]

    def _remember(self, turns: list[tuple[str, int]]) -> None:
        """Of the turns so far those that history may hold: the last ones, as long as their tokens are within it."""
        self.past += turns
        first, held = len(self.past), 0
        while first and held + self.past[first - 1][1] <= self.history:
            first -= 1
            held += self.past[first][1]
        del self.past[:first]

    def _window(self, repeated: list[tuple[str, int]], turns: list[tuple[str, str, int]]) -> dict:
        parts = [BEGIN, *(r for r, _ in repeated)]
        at = sum(map(len, parts))
        loss = []
        for role, rendered, _ in turns:
            if role == "assistant":
                begin = at + rendered.index(TEXT) + len(TEXT)
                loss.append({"start": begin, "stop": at + len(rendered) - len(END)})
            parts.append(rendered)
            at += len(rendered)
        self.window += 1
        return {"conv_id": self.conv_id, "window": self.window - 1, "text": "".join(parts) + CLOSE, "n_repeated": len(repeated), "loss": loss, "n_tokens": self.marks + sum(n for _, n in repeated) + sum(n for *_, n in turns)}


def _counted(turns: DataFrame, path: str, pattern: str) -> DataFrame:
    """conv_id, turn, role, text and n_tokens of the rendered turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        end = enc.count_all([END[-1:].encode()])[0]
        for batch in batches:
            for start, stop in slices(batch.column(3).cast(pa.binary())):
                part = batch.slice(start, stop - start)
                rendered = [render(role, text)[:-1].encode() for role, text in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                counts = pa.array([n + end for n in enc.count_all(rendered)], pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns, counts], names=[*part.schema.names, "n_tokens"])

    types = dict(turns.dtypes)
    return map_batches(turns, run, f"conv_id {types['conv_id']}, turn {types['turn']}, role string, text string, n_tokens long")


def format_chats(conversations: DataFrame, path: str, pattern: str, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """conv_id, window, text, n_repeated (turns at its front that came before), loss (code point ranges), n_tokens.

    The windows of a conversation come together and in order.
    """
    empty = F.lit("")
    turns = conversations.select("conv_id", F.col("turn").alias("turn"), F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    turns = _counted(turns, path, pattern).repartition("conv_id").sortWithinPartitions(F.col("conv_id"), F.col("turn").asc_nulls_last(), "role", "text")
    kind = dict(turns.dtypes)["conv_id"]
    fields = [("window", pa.int32()), ("text", pa.string()), ("n_repeated", pa.int32()), ("loss", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))), ("n_tokens", pa.int64())]

    opened, turn, close = encoder(path, pattern).count_all([x.encode() for x in (BEGIN + TURN, TURN, CLOSE)])
    marks = opened - turn + close

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: _Conversation | None = None
        schema = None
        for batch in batches:
            out: list[dict] = []
            held = 0
            schema = pa.schema([("conv_id", batch.schema.field(0).type), *fields])
            for rows in _runs(batch):
                start = 0
                while start < len(rows):
                    stop = start
                    while stop < len(rows) and rows[stop][0] == rows[start][0]:
                        stop += 1
                    done = []
                    if current is None or current.conv_id != rows[start][0]:
                        if current is not None:
                            done += current.take([], True)
                        current = _Conversation(rows[start][0], budget, history, marks)
                    done += current.take([(role, render(role, text), n) for _, role, text, n in rows[start:stop]], False)
                    out += done
                    held += sum(len(x["text"]) for x in done)
                    start = stop
                if held > RUN_CHARS:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, held = [], 0
            yield pa.RecordBatch.from_pylist(out, schema)
        if current is not None:
            yield pa.RecordBatch.from_pylist(list(current.take([], True)), schema)

    return map_batches(turns.select("conv_id", "role", "text", "n_tokens"), run, f"conv_id {kind}, window int, text string, n_repeated int, loss array<struct<start:int,stop:int>>, n_tokens long")


def _runs(batch: pa.RecordBatch) -> Iterator[list[tuple]]:
    rows, held = [], 0
    for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        rows.append(row)
        held += len(row[2])
        if len(rows) >= RUN_TURNS or held >= RUN_CHARS:
            yield rows
            rows, held = [], 0
    if rows:
        yield rows


def read_back(windows: DataFrame) -> DataFrame:
    """What the windows say, parsed from their texts and masks; a conversation's windows stand together and in order, as ``format_chats`` leaves them."""
    kind = dict(windows.dtypes)["conv_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: dict | None = None
        schema = None

        def closed() -> dict:
            return {k: current[k].hexdigest() if k.endswith("sha256") else current[k] for k in schema.names}

        for batch in batches:
            schema = pa.schema([("conv_id", batch.schema.field(0).type), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_windows", pa.int64())])
            out = []
            for conv_id, text, repeated, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "n_repeated", "loss")), strict=True):
                if current is None or current["conv_id"] != conv_id:
                    if current is not None:
                        out.append(closed())
                    current = {"conv_id": conv_id, "n_turns": 0, "turns_sha256": hashlib.sha256(), "loss_chars": 0, "loss_sha256": hashlib.sha256(), "formatted_chars": 0, "n_windows": 0}
                for role, said in _turns.findall(text)[repeated:]:
                    current["n_turns"] += 1
                    current["turns_sha256"].update(f"{unescape(role)}\n{unescape(said)}\n".encode())
                for span in loss:
                    target = unescape(text[span["start"] : span["stop"]])
                    current["loss_chars"] += len(target)
                    current["loss_sha256"].update(target.encode())
                current["formatted_chars"] += len(text)
                current["n_windows"] += 1
            yield pa.RecordBatch.from_pylist(out, schema)
        if current is not None:
            yield pa.RecordBatch.from_pylist([closed()], schema)

    return map_batches(windows, run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")

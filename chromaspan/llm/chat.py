"""Budgeted chat windows.

Prefix sums of the turns' token counts choose spans of whole turns; each window keeps the conversation's
system turn, repeats a limited history before its own turns, and masks what it repeats, so every assistant
text is a target in exactly one window.

A window's text is ``<|turn|>role<|says|>text<|end|>`` per turn. Control strings in roles and texts, also
those of other chat templates, are broken by a backslash; backslashes are doubled, so unescape() gives back
what was said.

Conversations of any length stream through: turns come sorted by (turn, role, text) and only the open window,
the system turn and the history are held. Defined cases: null roles and texts are empty, null turns come
first, rows with a null conv_id make one conversation, repeated rows are turns of their own. A turn that
exceeds the budget alone gets a window of its own with over_budget true: nothing is cut or dropped.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, encoders

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
#: This template's marks and those of common chat templates.
CONTROL = [TURN, SAYS, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>", "<|im_start|>", "<|im_end|>"]
_BREAK = re.compile("|".join(map(re.escape, sorted(CONTROL, key=len, reverse=True))))
_UNBREAK = re.compile(r"\\(.)", re.DOTALL)
_READ = re.compile(re.escape(TURN) + "(.*?)" + re.escape(SAYS) + "(.*?)" + re.escape(END), re.DOTALL)
#: Tokens that a turn's marks are counted as.
MARKS = 4
WINDOWS = "conv_id long, window long, formatted string, n_turns int, n_repeated int, n_tokens long, over_budget boolean, loss array<struct<start: int, end: int>>"


def escape(text: str) -> str:
    text = text.replace("\\", "\\\\") if "\\" in text else text
    return _BREAK.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text) if "<" in text or "[" in text else text


def unescape(text: str) -> str:
    return _UNBREAK.sub(r"\1", text) if "\\" in text else text


def format_turn(role: str, text: str) -> tuple[str, int]:
    """The turn and where its text begins in it."""
    head = f"{TURN}{escape(role)}{SAYS}"
    return f"{head}{escape(text)}{END}", len(head)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(r), unescape(t)) for r, t in _READ.findall(formatted)]


def turn_tokens(turns: DataFrame, path: str) -> DataFrame:
    """The turns with the token count of each one's formatted text: done where the rows lie, before any shuffle."""
    common.bound_batches(turns.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        tok = encoders.tokenizer(path)
        for b in batches:
            said = [format_turn(r, t)[0] for r, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            n = [len(e.ids) for e in tok.encode_batch(said, add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64())], names=[*b.schema.names, "tokens"])

    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "conv_id long, turn long, role string, text string, tokens long")


class _Windows:
    """The windows of one conversation, turn by turn."""

    def __init__(self, budget: int, history: int, history_tokens: int):
        self.budget, self.history_tokens = budget, history_tokens
        self.system: tuple | None = None
        self.before: deque = deque(maxlen=history or None)
        self.keeps = history > 0
        self.own: list[tuple] = []
        self.repeated: list[tuple] = []
        self.sum = 0  # of the prefix sums: tokens of all turns so far
        self.start = 0  # prefix sum before the window's own turns
        self.number = self.seen = 0

    def _repeat(self) -> None:
        """What the next window repeats: the system turn, and the latest turns within the history's tokens."""
        self.repeated = [self.system] if self.system else []
        past, room = [], self.history_tokens
        for t in reversed(self.before):
            if t is self.system or t[2] > room:
                break
            past.append(t)
            room -= t[2]
        self.repeated += reversed(past)

    def add(self, role: str, text: str, tokens: int) -> Iterator[tuple]:
        turn = (role, text, tokens)
        if self.own and self._held() + tokens > self.budget:
            yield self.flush()
        if not self.own and self.seen:
            self._repeat()
            while self.repeated and self._held() + tokens > self.budget and self.repeated[-1] is not self.system:
                self.repeated.pop(1 if self.repeated[0] is self.system else 0)
        self.own.append(turn)
        self.sum += tokens
        if not self.seen and role == "system":
            self.system = turn
        if self.keeps:
            self.before.append(turn)
        self.seen += 1

    def _held(self) -> int:
        return sum(t[2] for t in self.repeated) + self.sum - self.start

    def flush(self) -> tuple:
        parts, spans, at = [], [], 0
        for k, (role, text, _) in enumerate([*self.repeated, *self.own]):
            said, head = format_turn(role, text)
            if k >= len(self.repeated) and role == "assistant":
                spans.append({"start": at + head, "end": at + len(said) - len(END)})
            parts.append(said)
            at += len(said)
        held = self._held()
        out = (self.number, "".join(parts), len(parts), len(self.repeated), held, held > self.budget, spans)
        self.own, self.repeated, self.start = [], [], self.sum
        self.number += 1
        return out


def chat_windows(turns: DataFrame, path: str, budget: int = 2048, history: int = 2, history_tokens: int = 512) -> DataFrame:
    """One row per window, in order within its conversation and partition (see WINDOWS for the columns).

    turns: conv_id, turn, role, text. The rows of a conversation meet in one task, as a stream: its windows
    depend on all turns before them, but only the open window is in memory.
    """
    counted = turn_tokens(turns, path)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        fields = pa.schema([("conv_id", pa.int64()), ("window", pa.int64()), ("formatted", pa.string()), ("n_turns", pa.int32()), ("n_repeated", pa.int32()), ("n_tokens", pa.int64()), ("over_budget", pa.bool_()), ("loss", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])
        now, state, rows, size = object(), None, [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(fields.names, r, strict=True)) for r in rows], schema=fields)

        for b in batches:
            for conv, role, text, tokens in zip(*(b.column(k).to_pylist() for k in (0, 2, 3, 4)), strict=True):
                if conv != now or state is None:
                    if state is not None:
                        rows.append((now, *state.flush()))
                    now, state = conv, _Windows(budget, history, history_tokens)
                for w in state.add(role, text, tokens):
                    rows.append((conv, *w))
                size += len(text)
                if size > common.CHUNK_BYTES and rows:
                    yield batch()
                    rows, size = [], 0
        if state is not None:
            rows.append((now, *state.flush()))
        if rows:
            yield batch()

    return counted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, WINDOWS)


def read_back(windows: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows, read from the windows.

    The windows are as chat_windows() gives them: a conversation's in order in one partition. Digests run
    along, so a long conversation is never held.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        now, state = object(), None
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

        def row() -> list:
            return [now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5]]

        def batch(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for b in batches:
            out = []
            for conv, text, repeated, loss in zip(*(b.column(b.schema.names.index(c)).to_pylist() for c in ("conv_id", "formatted", "n_repeated", "loss")), strict=True):
                if conv != now or state is None:
                    if state is not None:
                        out.append(row())
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, said in read_turns(text)[repeated:]:
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                for span in loss:
                    target = unescape(text[span["start"] : span["end"]])
                    state[2] += len(target)
                    state[3].update(target.encode())
                state[4] += len(text)
                state[5] += 1
            if out:
                yield batch(out)
        if state is not None:
            yield batch([row()])

    return windows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")

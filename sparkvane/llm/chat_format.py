r"""Chat formatting in budgeted windows.

A conversation becomes one or more windows of text.  Prefix sums of turn
tokens choose spans of whole turns; each window repeats the system turn and a
limited history before its new turns.  Loss spans cover the text of assistant
turns where they are new, so a repeated target is masked and every assistant
text counts once.

The template is ``<|im_start|>role\ntext<|im_end|>\n``.  Control strings in
texts are escaped reversibly: ``<``, any backslashes, ``|`` gain one backslash.

Defined results: null text or role is empty; turns with the same number are
ordered by role, then text; a null turn comes first; rows with a null conv_id
form one conversation; a turn longer than the budget gets a window of its own,
whole.  One conversation is formatted in order by one task, which holds a
window of it, not all of it.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _runtime as rt

START, END = "<|im_start|>", "<|im_end|>"
BUDGET = 1024  # tokens of one window
HISTORY_TOKENS, HISTORY_TURNS = 256, 2  # of turns that are repeated, at most
TURN_TOKENS = 4  # the template's own for each turn
LEARNED = "assistant"

_ESCAPE = re.compile(r"<(\\*)\|")
_UNESCAPE = re.compile(r"<\\(\\*)\|")
_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + r"\n", re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def words(texts: list[str]) -> list[int]:
    """The plainest token count: words."""
    return [len(t.split()) for t in texts]


def library_tokens(path: str) -> Callable[[list[str]], list[int]]:
    """Counts by a tokenizers file that every executor can open."""
    made: list = []

    def count(texts: list[str]) -> list[int]:
        if not made:
            from tokenizers import Tokenizer

            made.append(Tokenizer.from_file(path))
        return [len(e.ids) for e in made[0].encode_batch(texts, add_special_tokens=False)]

    return count


@dataclass(slots=True)
class Turn:
    role: str
    text: str
    tokens: int


class Windows:
    """Windows of one conversation; turns go in one by one, windows come out as they fill."""

    def __init__(self, budget: int = BUDGET, history_tokens: int = HISTORY_TOKENS, history_turns: int = HISTORY_TURNS):
        self.budget, self.history_tokens, self.history_turns = budget, history_tokens, history_turns
        self.system: Turn | None = None
        self.history: list[Turn] = []
        self.new: list[Turn] = []
        self.sums = [0]  # prefix sums of the new turns' tokens
        self.number = 0
        self.seen = 0

    def _fixed(self) -> int:
        kept = self.system.tokens if self.number and self.system else 0
        return kept + sum(t.tokens for t in self.history)

    def add(self, turn: Turn) -> list[tuple]:
        out = []
        if not self.seen and turn.role == "system":
            self.system = turn
        self.seen += 1
        self.new.append(turn)
        self.sums.append(self.sums[-1] + turn.tokens)
        # The prefix sums say how many of the turns fit beside what is repeated; one always goes in.
        while (fit := max(1, bisect_right(self.sums, self.budget - self._fixed()) - 1)) < len(self.new):
            out.append(self.close(fit))
            # The next turn with its history, or with less of it where that is too much.
            while self.history and self._fixed() + self.new[0].tokens > self.budget:
                self.history.pop(0)
        return out

    def close(self, fit: int | None = None) -> tuple:
        """The window of the first new turns: (window, text, new turns, repeated turns, tokens, loss starts, loss ends)."""
        fit = len(self.new) if fit is None else fit
        new, rest = self.new[:fit], self.new[fit:]
        repeated = ([self.system] if self.number and self.system else []) + self.history
        parts, starts, ends, at = [], [], [], 0
        for i, t in enumerate(repeated + new):
            head, body = f"{START}{escape_role(t.role)}\n", escape(t.text)
            if i >= len(repeated) and t.role == LEARNED:
                starts.append(at + len(head))
                ends.append(at + len(head) + len(body))
            parts += [head, body, f"{END}\n"]
            at += len(head) + len(body) + len(END) + 1
        out = (self.number, "".join(parts), fit, len(repeated), self._fixed() + self.sums[fit], starts, ends)
        kept: list[Turn] = []
        for t in reversed(new[-self.history_turns :] if self.history_turns else []):
            if t is self.system or sum(x.tokens for x in kept) + t.tokens > self.history_tokens:
                break
            kept.insert(0, t)
        self.history, self.new, self.sums, self.number = kept, rest, [x - self.sums[fit] for x in self.sums[fit:]], self.number + 1
        return out


WINDOWS = "conv_id long, window int, formatted string, new_turns int, repeated_turns int, n_tokens long, loss_starts array<int>, loss_ends array<int>"
_TYPES = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
_NAMES = [x.strip().split(" ")[0] for x in WINDOWS.split(",")]
_NONE = object()


def format_windows(
    turns: DataFrame, count: Callable[[list[str]], list[int]] = words, budget: int = BUDGET, history_tokens: int = HISTORY_TOKENS, history_turns: int = HISTORY_TURNS
) -> DataFrame:
    """One row for each window of each conversation."""
    spark = turns.sparkSession
    rt.prepare(spark)
    chosen = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    placed = chosen.repartition(rt.partitions(spark), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = _NONE, None

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)

        for b in rt.small(batches):
            out: list[tuple] = []
            texts = b.column(3).to_pylist()
            for c, role, text, n in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), texts, count(texts), strict=True):
                if c != conv:
                    if state is not None:
                        out.append((conv, *state.close()))
                    conv, state = c, Windows(budget, history_tokens, history_turns)
                out += [(conv, *w) for w in state.add(Turn(role, text, n + TURN_TOKENS))]
            if out:
                yield batch(out)
        if state is not None:
            yield batch([(conv, *state.close())])

    return placed.mapInArrow(run, WINDOWS)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn in a window."""
    out, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError("not a formatted window")
        out.append((unescape_role(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError("not a formatted window")
    return out


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"


def read_back(windows: DataFrame) -> DataFrame:
    """Digests of what the windows hold: all turns once, and all text under the loss mask."""
    spark = windows.sparkSession
    rt.prepare(spark)
    placed = windows.select("conv_id", "window", "formatted", "repeated_turns", "loss_starts", "loss_ends").repartition(rt.partitions(spark), "conv_id").sortWithinPartitions("conv_id", "window")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = _NONE, None

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [x.strip().split(" ")[0] for x in READ.split(",")])

        def row() -> tuple:
            return conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5]

        for b in rt.small(batches):
            out = []
            for c, text, repeated, starts, ends in zip(*(b.column(i).to_pylist() for i in (0, 2, 3, 4, 5)), strict=True):
                if c != conv:
                    if state is not None:
                        out.append(row())
                    conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, body in read_turns(text)[repeated:]:
                    state[0] += 1
                    state[1].update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
                for s, e in zip(starts, ends, strict=True):
                    learned = unescape(text[s:e])
                    state[2] += len(learned)
                    state[3].update(learned.encode("utf-8", "surrogatepass"))
                state[4] += len(text)
                state[5] += 1
            if out:
                yield batch(out)
        if state is not None:
            yield batch([row()])

    return placed.mapInArrow(run, READ)

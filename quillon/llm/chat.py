"""Chat formatting in budgeted windows of whole turns."""

from __future__ import annotations

import hashlib
import re
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.storage import table
from quillon.llm.tokens import broadcast_file, encoder

BUDGET = 2048
HISTORY_TURNS = 4
HISTORY_TOKENS = 512
TARGET_ROLE = "assistant"
SYSTEM_ROLE = "system"

# The template: <|turn:ROLE|>TEXT<|/turn|> and a line end. Heads of control strings, this template's and those of other
# public ones, take one more backslash inside a text; taking one away gives the text back.
_TAIL = r"(?=\||/?s>|/?INST\]|</?SYS>>)"
_HEAD = re.compile(r"([<\[]\\*)" + _TAIL)
_MARKED = re.compile(r"([<\[])\\(\\*)" + _TAIL)
_TURN = re.compile(r"<\|turn:([^|]*)\|>(.*?)<\|/turn\|>\n", re.S)


def escape(text: str) -> str:
    return _HEAD.sub(lambda m: m[1] + "\\", text)


def unescape(text: str) -> str:
    return _MARKED.sub(lambda m: m[1] + m[2], text)


def open_mark(role: str) -> str:
    return f"<|turn:{quote(role, safe='')}|>"


CLOSE_MARK = "<|/turn|>\n"


class Formatter:
    """Turns of one conversation in, windows out; keeps the system turn, a limited history and the open window only.

    The open window spans turns first..last by prefix sums of their tokens: a turn joins while the system turn, the
    history and the turns from `first` on stay within the budget. A turn that is longer on its own gets its own window.
    """

    def __init__(self, budget: int, history_turns: int, history_tokens: int):
        self.budget, self.history_turns, self.history_tokens = budget, history_turns, history_tokens
        self.system: tuple | None = None
        self.past: list[tuple] = []  # the last turns: role, text, prefix sum after it, tokens
        self.fresh: list[tuple] = []
        self.sum = 0  # tokens of all turns so far
        self.base = 0  # prefix sum where the open window's new turns begin
        self.kept: list[tuple] = []  # history of the open window
        self.number = 0

    def _system_tokens(self) -> int:
        return self.system[3] if self.system and self.system not in self.fresh and self.system not in self.kept else 0

    def add(self, role: str, text: str, tokens: int):
        fixed = self._system_tokens() + sum(t[3] for t in self.kept)
        if self.fresh and fixed + (self.sum - self.base) + tokens > self.budget:
            yield self.close()
            self._open(tokens)
        self.sum += tokens
        turn = (role, text, self.sum, tokens)
        if self.system is None and self.sum == tokens and role == SYSTEM_ROLE:
            self.system = turn
        self.fresh.append(turn)

    def _open(self, tokens: int) -> None:
        self.base, self.kept, total = self.sum, [], 0
        left = self.budget - tokens - (self.system[3] if self.system else 0)
        for turn in reversed(self.past):
            total += turn[3]
            if turn is self.system or len(self.kept) == self.history_turns or total > min(self.history_tokens, left):
                break
            self.kept.insert(0, turn)

    def close(self):
        """The open window: number, text, spans of targets (code points), of which turns are new, tokens."""
        parts, at, loss = [], 0, []
        again = [self.system] if self.number and self.system and self.system not in self.fresh else []
        old = [*again, *self.kept]
        for i, (role, text, _, _) in enumerate([*old, *self.fresh]):
            head, body = open_mark(role), escape(text)
            if i >= len(old) and role == TARGET_ROLE:
                loss.append((at + len(head), at + len(head) + len(body)))
            part = head + body + CLOSE_MARK
            parts.append(part)
            at += len(part)
        tokens = sum(t[3] for t in [*old, *self.fresh])
        out = (self.number, "".join(parts), [a for a, _ in loss], [b for _, b in loss], len(old), tokens)
        self.number += 1
        self.past = (self.past + self.fresh)[-self.history_turns :] if self.history_turns else []
        self.fresh = []
        return out


WINDOWS = "window int, text string, loss_starts array<int>, loss_ends array<int>, n_repeated int, n_tokens long"


def format_windows(turns: DataFrame, path: str | None = None, budget: int = BUDGET, history_turns: int = HISTORY_TURNS, history_tokens: int = HISTORY_TOKENS) -> DataFrame:
    """A row for each window: conv_id, window, text, loss_starts, loss_ends (code points), n_repeated (its first
    n_repeated turns repeat earlier ones and are masked) and n_tokens; a conversation's windows come in order, in one
    partition.

    turns needs conv_id, turn, role and text; null roles and texts count as empty, rows without conv_id are one
    conversation, rows without turn come last; equal turns go by role, then text, and repeated rows are turns each.
    The rows of a conversation pass through a task in order and are not gathered; what is kept is a window.
    """
    file = broadcast_file(turns.sparkSession, path)
    ordered = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = ordered.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_last(), "role", "text").select("conv_id", "role", "text")

    def run(batches):
        import pyarrow as pa

        encode, now, formatter = encoder(file.value), None, None
        type_ = None

        def rows_out(rows):
            ids, rest = [r[0] for r in rows], list(zip(*(r[1] for r in rows), strict=True))
            types = [pa.int32(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(ids, type_), *(pa.array(x, t) for x, t in zip(rest, types, strict=True))], names=["conv_id", "window", "text", "loss_starts", "loss_ends", "n_repeated", "n_tokens"])

        for batch in batches:
            type_, rows = batch.schema.field(0).type, []
            for conv_id, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if formatter is None or conv_id != now:
                    if formatter is not None:
                        rows.append((now, formatter.close()))
                    now, formatter = conv_id, Formatter(budget, history_turns, history_tokens)
                rows += [(now, w) for w in formatter.add(role, text, len(encode(text)) + len(encode(open_mark(role) + CLOSE_MARK)))]
                if len(rows) >= 64:
                    yield rows_out(rows)
                    rows = []
            if rows:
                yield rows_out(rows)
        if formatter is not None:
            yield rows_out([(now, formatter.close())])

    id_type = turns.schema["conv_id"].dataType.simpleString()
    return ordered.mapInArrow(run, f"conv_id {id_type}, {WINDOWS}")


def read_back(windows: DataFrame) -> DataFrame:
    """Per conversation, from its windows in order: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""

    def run(batches):
        import pyarrow as pa

        types = [None, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        state, now = None, None

        def result():
            return [now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]]

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

        for batch in batches:
            types[0], rows = batch.schema.field(0).type, []
            for conv_id, text, starts, ends, old in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "text", "loss_starts", "loss_ends", "n_repeated")), strict=True):
                if state is None or conv_id != now:
                    if state is not None:
                        rows.append(result())
                    now, state = conv_id, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, body in _TURN.findall(text)[old:]:
                    state[0] += 1
                    state[1].update(f"{unquote(role)}\n{unescape(body)}\n".encode())
                for a, b in zip(starts, ends, strict=True):
                    target = unescape(text[a:b])
                    state[2] += len(target)
                    state[3].update(target.encode())
                state[4] += len(text)
            if rows:
                yield out(rows)
        if state is not None:
            yield out([result()])

    id_type = windows.schema["conv_id"].dataType.simpleString()
    return windows.mapInArrow(run, f"conv_id {id_type}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return read_back(format_windows(turns.unionByName(extra)))

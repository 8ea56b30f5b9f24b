"""Conversations as training texts, in windows of a token budget.

A window is a run of whole turns. The prefix sums of the turns' tokens choose it: from its first turn, as many turns as
the budget holds. Every window after the first begins with the system turn, if the conversation opens with one, and
with as many of the turns before it as the history budget holds; these repeated turns carry no loss. So the text of
each assistant turn is under the loss exactly once. A turn over the budget has a window of its own, whole.

A turn is written as ``<|turn|>role<|text|>text<|end|>``. Control strings inside roles and texts are escaped with a
backslash, reversibly. Turns are ordered by ``turn``, then role and text; a null turn comes first, null roles and
texts are empty, rows that repeat are turns of their own, and rows without conv_id form one conversation. Other
columns are not read. Turns stream through a task in order: it holds one window of a conversation at a time, whatever
the conversation's length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardlake.llm.byte_bpe import tokenizer
from cardlake.llm.common import NO_ID, id_of, ship, stored, text_of

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
BUDGET, HISTORY = 512, 128
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
# Tokens of a turn besides its role and text: the three control strings.
OVERHEAD = 3
# Strings that a model's template may give a meaning.
CONTROL = (TURN, TEXT, END, "<|endoftext|>", "<|startoftext|>", "<|im_start|>", "<|im_end|>", "<s>", "</s>",
           "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_TURN = re.compile(re.escape(TURN) + "(.*?)" + re.escape(TEXT) + "(.*?)" + re.escape(END), re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
BATCH_CHARS = 4_000_000

SPANS = "array<struct<ordinal:bigint,role:string,start:bigint,end:bigint,loss:boolean,repeated:boolean>>"
WINDOWS = f"conv_id bigint, window bigint, text string, n_tokens bigint, spans {SPANS}"
READ = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_windows bigint, loss_turns bigint"


def escape(text: str) -> str:
    """A backslash doubles; a control string gets one after its first character."""
    return _CONTROL.sub(lambda found: found.group()[0] + "\\" + found.group()[1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class _Turn:
    def __init__(self, ordinal: int, role: str, text: str, tokens: int):
        self.ordinal, self.role, self.tokens = ordinal, role, tokens
        self.head = f"{TURN}{escape(role)}{TEXT}"
        self.body = escape(text)


def _window(conv_id: int, number: int, repeated: list[_Turn], own: list[_Turn]) -> dict:
    parts, spans, at = [], [], 0
    for turns, again in ((repeated, True), (own, False)):
        for turn in turns:
            start = at + len(turn.head)
            end = start + len(turn.body)
            loss = turn.role == "assistant" and not again
            spans.append({"ordinal": turn.ordinal, "role": turn.role, "start": start, "end": end, "loss": loss, "repeated": again})
            parts += [turn.head, turn.body, END]
            at = end + len(END)
    n_tokens = sum(t.tokens for t in repeated) + sum(t.tokens for t in own)
    return {"conv_id": conv_id if conv_id != NO_ID else None, "window": number, "text": "".join(parts), "n_tokens": n_tokens, "spans": spans}


def windows_of(turns: Iterator[tuple[int, str, str]], count: Callable[[str], int], budget: int, history: int) -> Iterator[dict]:
    """Windows of conversations whose turns follow each other in order."""
    conv, number, ordinal, sums = None, 0, 0, [0]
    system: list[_Turn] = []
    repeated: list[_Turn] = []
    own: list[_Turn] = []
    for conv_id, role, text in turns:
        if conv_id != conv:
            if own:
                yield _window(conv, number, repeated, own)
            conv, number, ordinal, system, repeated, own, sums = conv_id, 0, 0, [], [], [], [0]
        turn = _Turn(ordinal, role, text, OVERHEAD + count(escape(role)) + count(escape(text)))
        if own and sums[-1] + turn.tokens > budget:
            yield _window(conv, number, repeated, own)
            number += 1
            # The last turns of the window, as many as the history and the rest of the budget hold.
            fixed = sum(t.tokens for t in system)
            room = min(history, budget - fixed - turn.tokens)
            past: list[_Turn] = []
            before = [t for t in repeated if t not in system] + own
            taken = 0
            for earlier in reversed(before):
                if earlier in system or taken + earlier.tokens > room:
                    break
                taken += earlier.tokens
                past.append(earlier)
            repeated, own = system + past[::-1], []
            sums = [fixed + taken]
        own.append(turn)
        sums.append(sums[-1] + turn.tokens)
        if ordinal == 0 and role == "system":
            system = [turn]
        ordinal += 1
    if own:
        yield _window(conv, number, repeated, own)


def _rows(batches) -> Iterator[tuple[int, str, str]]:
    for batch in batches:
        yield from zip(*(batch.column(name).to_pylist() for name in ("conv_id", "role", "text")))


_SPANS = pa.list_(pa.struct([("ordinal", pa.int64()), ("role", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                             ("loss", pa.bool_()), ("repeated", pa.bool_())]))
_WINDOWS = pa.schema([("conv_id", pa.int64()), ("window", pa.int64()), ("text", pa.string()), ("n_tokens", pa.int64()), ("spans", _SPANS)])


def _in_batches(rows: Iterator[dict], schema: pa.Schema, size_of: Callable[[dict], int]):
    some, size = [], 0
    for row in rows:
        some.append(row)
        size += size_of(row)
        if size > BATCH_CHARS:
            yield pa.RecordBatch.from_pylist(some, schema=schema)
            some, size = [], 0
    if some:
        yield pa.RecordBatch.from_pylist(some, schema=schema)


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, vocabulary: str = VOCABULARY) -> DataFrame:
    """conv_id, window, text, n_tokens and the spans of each turn's text, in code points, with its loss mask."""
    ship(conversations.sparkSession)

    def form(batches):
        count = tokenizer(vocabulary).count
        yield from _in_batches(windows_of(_rows(batches), count, budget, history), _WINDOWS, lambda row: len(row["text"]) + 500)

    turns = conversations.select(id_of("conv_id").alias("conv_id"), F.col("turn").alias("turn"), text_of("role").alias("role"), text_of("text").alias("text"))
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(form, WINDOWS)


class _Reading:
    """What has been read back of one conversation."""

    def __init__(self, conv_id: int):
        self.conv_id, self.turns, self.loss = conv_id, hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = self.n_windows = self.loss_turns = 0

    def add(self, text: str, spans: list[dict]) -> None:
        found = list(_TURN.finditer(text))
        if "".join(f.group() for f in found) != text or len(found) != len(spans):
            raise ValueError(f"a window of conversation {self.conv_id} is not a run of turns")
        self.n_windows += 1
        self.chars += len(text)
        for turn, span in zip(found, spans):
            if (turn.start(2), turn.end(2)) != (span["start"], span["end"]):
                raise ValueError(f"a span of conversation {self.conv_id} is not a turn's text")
            role, body = unescape(turn.group(1)), unescape(turn.group(2))
            if not span["repeated"]:
                self.n_turns += 1
                self.turns.update(f"{role}\n{body}\n".encode())
            if span["loss"]:
                self.loss_turns += 1
                self.loss_chars += len(body)
                self.loss.update(body.encode())

    def row(self) -> dict:
        return {
            "conv_id": self.conv_id if self.conv_id != NO_ID else None, "n_turns": self.n_turns, "turns_sha256": self.turns.hexdigest(),
            "loss_chars": self.loss_chars, "loss_sha256": self.loss.hexdigest(), "formatted_chars": self.chars,
            "n_windows": self.n_windows, "loss_turns": self.loss_turns,
        }


_READ = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                   ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_windows", pa.int64()), ("loss_turns", pa.int64())])


def _read_rows(batches) -> Iterator[dict]:
    reading = None
    for batch in batches:
        for conv_id, text, spans in zip(*(batch.column(name).to_pylist() for name in ("conv_id", "text", "spans"))):
            if reading is None or reading.conv_id != conv_id:
                if reading is not None:
                    yield reading.row()
                reading = _Reading(conv_id)
            reading.add(text, spans)
    if reading is not None:
        yield reading.row()


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation what its windows hold: its turns, each once, and the text under the loss."""
    ship(formatted.sparkSession)

    def read(batches):
        yield from _in_batches(_read_rows(batches), _READ, lambda row: 300)

    rows = formatted.select(id_of("conv_id").alias("conv_id"), "window", "text", "spans")
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return ordered.select("conv_id", "text", "spans").mapInArrow(read, READ)


def formatted_and_read(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Windows written to a shared folder, then read back."""
    return read_back(stored(windows(conversations, budget, history), "chat-windows"))

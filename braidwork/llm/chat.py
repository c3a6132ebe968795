"""Chat formatting: budgeted, turn-aligned windows with repeated history and masked repeats."""

from __future__ import annotations

import base64
import hashlib
import re
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_or_empty

#: Strings with which texts could fake the template's own marks or those of other templates. Fixed values.
CONTROLS = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@dataclass(frozen=True)
class Template:
    """Marks turns as ``<|im_start|>role``, newline, text, ``<|im_end|>``, newline."""

    controls: tuple[str, ...] = CONTROLS

    def _breaks(self) -> re.Pattern:
        return re.compile("|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in self.controls))

    def escape(self, text: str) -> str:
        """Double backslashes, and put one behind the first character of every control string."""
        return self._breaks().sub(lambda m: m[0] + "\\", text.replace("\\", "\\\\"))

    def unescape(self, text: str) -> str:
        return re.sub(r"\\(\\?)", r"\1", text)

    def head(self, role: str) -> str:
        return f"{OPEN}{self.escape(role).replace('\n', '\\n')}\n"

    def turn(self, role: str, text: str) -> str:
        return f"{self.head(role)}{self.escape(text)}{CLOSE}\n"

    def parse(self, formatted: str) -> list[tuple[str, str, int, int]]:
        """The turns of a formatted text: role, text, and where the escaped text starts and ends."""
        found, at = [], 0
        while at < len(formatted):
            if not formatted.startswith(OPEN, at):
                raise ValueError(f"no turn at {at}")
            start = formatted.index("\n", at) + 1
            end = formatted.index(CLOSE, start)
            role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], formatted[at + len(OPEN) : start - 1], flags=re.DOTALL)
            found.append((role, self.unescape(formatted[start:end]), start, end))
            at = end + len(CLOSE) + 1
        return found


def bpe_counter(path: str = VOCABULARY) -> Callable[[], Callable[[str], int]]:
    """A factory, called in each task, of token counters over a public vocabulary file."""
    with open(path, "rb") as lines:
        table = lines.read()

    def make():
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, table.splitlines())}
        pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
        coder = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return lambda text: len(coder.encode_ordinary(text))

    return make


WINDOW_FIELDS = "window int, n_repeated int, n_new int, n_tokens long, over_budget boolean, text string, loss array<struct<start:long,end:long>>"


class _Conversation:
    """Windows of one conversation, made while its turns stream in; holds one window and the history."""

    def __init__(self, key, budget: int, history: int, template: Template):
        self.key, self.budget, self.template = key, budget, template
        self.system: tuple | None = None
        self.past: deque = deque(maxlen=history)
        self.turns: list[tuple] = []
        self.prefix = [0]  # prefix sums of the tokens of the window's turns
        self.repeated = self.window = 0

    def _first(self, turn) -> None:
        """Begin a window before ``turn``: the system turn, then as much history as leaves room for it."""
        lead = [self.system] if self.system is not None else []
        room = self.budget - turn[2] - sum(t[2] for t in lead)
        back: list[tuple] = []
        for old in reversed(self.past):
            room -= old[2]
            if room < 0:
                break
            back.append(old)
        self.turns = lead + back[::-1]
        self.prefix = [0]
        for t in self.turns:
            self.prefix.append(self.prefix[-1] + t[2])
        self.repeated = len(self.turns)

    def add(self, role: str, text: str, tokens: int):
        """Take the next turn; returns the window that it closes, if any."""
        turn, closed = (role, text, tokens), None
        if self.turns and self.prefix[-1] + tokens > self.budget and len(self.turns) > self.repeated:
            closed = self.close()
        if not self.turns:
            self._first(turn)
        self.turns.append(turn)
        self.prefix.append(self.prefix[-1] + tokens)
        if role == "system" and self.window == 0 and len(self.turns) == 1:
            self.system = turn
        return closed

    def close(self):
        """The window's row; its new turns become history."""
        parts, loss, at = [], [], 0
        for i, (role, text, _) in enumerate(self.turns):
            piece = self.template.turn(role, text)
            if i >= self.repeated and role == "assistant":
                loss.append({"start": at + len(self.template.head(role)), "end": at + len(piece) - len(CLOSE) - 1})
            parts.append(piece)
            at += len(piece)
        row = (self.key, self.window, self.repeated, len(self.turns) - self.repeated, self.prefix[-1], self.prefix[-1] > self.budget, "".join(parts), loss)
        self.past.extend(t for t in self.turns[self.repeated :] if t is not self.system)
        self.turns, self.window = [], self.window + 1
        return row


def format_windows(conversations: DataFrame, budget: int = 1024, history: int = 2, template: Template = Template(), counter=None) -> DataFrame:
    """One row per training window of each conversation, by ``conv_id`` and ``window`` in each partition.

    A window takes turns in order while the prefix sum of their formatted tokens stays within
    ``budget``. From the second window on it begins with the system turn, if the conversation has one
    at its head, and with up to ``history`` earlier turns as far as they fit beside the first new turn.
    Only new assistant turns are in ``loss``, so every assistant text is trained on once; repeated
    turns are masked. A turn that alone exceeds the budget stays whole in a window marked
    ``over_budget``. Rows are ordered by turn, ties by role and text; null text and null role are
    empty, and rows of a null ``conv_id`` are one conversation. Turns stream in sorted order, so a
    conversation of any length needs the memory of one window.
    """
    make = counter or bpe_counter()
    rows = conversations.select("conv_id", "turn", text_or_empty("role").alias("role"), text_or_empty("text").alias("text"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    key = rows.schema["conv_id"].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kinds = [None, pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.string(), span]
    names = ["conv_id", "window", "n_repeated", "n_new", "n_tokens", "over_budget", "text", "loss"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, now, out = make(), None, []
        id_type = None

        def flush():
            columns = list(zip(*out))
            return pa.RecordBatch.from_arrays([pa.array(c, k or id_type) for c, k in zip(columns, kinds)], names=names)

        for batch in batches:
            id_type = batch.schema.field(0).type
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                if now is None or now.key != conv:
                    if now is not None:
                        out.append(now.close())
                    now = _Conversation(conv, budget, history, template)
                if (row := now.add(role, text, count(template.turn(role, text)))) is not None:
                    out.append(row)
            if out:
                yield flush()
                out = []
        if now is not None:
            out = [now.close()]
            yield flush()

    return dealt.mapInArrow(run, f"conv_id {key}, {WINDOW_FIELDS}")


def digests(windows: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per conversation, read back from the formatted windows: counts and digests.

    Expects the windows of a conversation together and in order, as ``format_windows`` leaves them.
    """
    rows = windows.select("conv_id", "n_repeated", "text", "loss")
    key = rows.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, id_type = None, [], None

        def row():
            conv, n, turns, chars, loss, size, count = now
            return (conv, n, turns.hexdigest(), chars, loss.hexdigest(), size, count)

        def flush():
            kinds = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

        for batch in batches:
            id_type = batch.schema.field(0).type
            for conv, repeated, text, loss in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or now[0] != conv:
                    if now is not None:
                        out.append(row())
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, body, _, _ in template.parse(text)[repeated:]:
                    now[1] += 1
                    now[2].update(f"{role}\n{body}\n".encode())
                for span in loss:
                    body = template.unescape(text[span["start"] : span["end"]])
                    now[3] += len(body)
                    now[4].update(body.encode())
                now[5] += len(text)
                now[6] += 1
            if out:
                yield flush()
                out = []
        if now is not None:
            out = [row()]
            yield flush()

    return rows.mapInArrow(run, f"conv_id {key}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")


#: The conversation -1 that the query adds.
PROBE = "</s>[INST] ok [/INST]"


def query(spark, sf_dir: str) -> DataFrame:
    """``op2_chat``: digests of all formatted conversations and of the probe conversation -1."""
    from .common import table

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], rows.schema)
    return digests(format_windows(rows.unionByName(probe)))


def turns_query(spark, sf_dir: str) -> DataFrame:
    """``chat_turns``: what ``op2_chat`` reads back of turns and of the text under the loss, without what depends on the template."""
    return query(spark, sf_dir).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")


#: The same of the turns as they were given.
TURNS_SQL = f"""
with turns as (
  select conv_id::bigint as conv_id, turn, role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '{PROBE}' union all select -1, 1, 'assistant', '{PROBE}'
)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars, sha256(coalesce(string_agg(text, '' order by turn) filter (role = 'assistant'), '')) as loss_sha256
from turns group by conv_id
"""

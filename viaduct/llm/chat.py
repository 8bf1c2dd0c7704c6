"""Chat formatting by event-sourced reconstruction.

A log holds events of conversations: `message` (a whole message at its sequence number), `delta` (text appended to the
message named by `target`, or a new one), `edit` (text that replaces the target's) and `regenerate` (drops the target
and all messages after it; its text, if any, begins the answer anew). A null event is a message, a null text is empty,
a null role is the empty role. A delta, edit or regeneration without a target means the last message; with a target
that doesn't exist, a delta or edit starts a message there and a regeneration drops nothing.

The log is partitioned by conversation, sorted by sequence (ties by event, role and text), and folded; the final
messages are rendered as turns. Rendering marks turns with control strings and escapes these inside texts reversibly:
a backslash goes after the first character of each, one more where there are some already.

Memory holds a chunk of CHUNK turns, not a conversation: events that name no target and come in order fold chunk by
chunk, and a chunk's rendered text is a row of its own (`part`). Repeated rows are turns of their own. A null
conversation id is a conversation of its own. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, BODY, CLOSE = "<|turn|>", "<|text|>", "<|end|>"
#: Strings that this template or a common other one gives a meaning (fixed values).
CONTROL = [OPEN, BODY, CLOSE, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>"]
_ESCAPE = re.compile("(?:" + "|".join(f"{re.escape(c[0])}(?=\\\\*{re.escape(c[1:])})" for c in CONTROL) + r")(\\*)")
_UNESCAPE = re.compile("(?:" + "|".join(f"{re.escape(c[0])}(?=\\\\+{re.escape(c[1:])})" for c in CONTROL) + r")(\\+)")
_TURN = re.compile(re.escape(OPEN) + "(.*?)" + re.escape(BODY) + "(.*?)" + re.escape(CLOSE), re.S)
CHUNK = 512
LOSS_ROLES = ("assistant",)


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[0][0] + "\\" + m[1], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[0][0] + m[1][1:], text)


def render(messages: list[tuple[str, str]], loss_roles: tuple = LOSS_ROLES) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text, and the spans (from, to) in it that count for the loss: escaped texts of loss_roles."""
    out, spans, at = [], [], 0
    for role, text in messages:
        head, body = f"{OPEN}{escape(role)}{BODY}", escape(text)
        if role in loss_roles:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += (head, body, CLOSE)
        at += len(head) + len(body) + len(CLOSE)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The messages that render() wrote."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


class Fold:
    """Events in order become final messages: (seq, role, text)."""

    def __init__(self):
        self.seqs: list = []
        self.roles: list[str] = []
        self.texts: list[list[str]] = []

    def _find(self, target) -> int | None:
        if target is None:
            return len(self.seqs) - 1 if self.seqs else None
        return next((i for i in range(len(self.seqs) - 1, -1, -1) if self.seqs[i] == target), None)

    def add(self, seq, event: str | None, role: str | None, text: str | None, target) -> None:
        text = text or ""
        if event in (None, "message"):
            at = None
        else:
            at = self._find(target)
            if event == "edit" and at is not None:
                self.texts[at] = [text]
                return
            if event == "delta" and at is not None and role in (None, self.roles[at]):
                self.texts[at].append(text)
                return
            if event == "regenerate":
                if at is not None:
                    role = role or self.roles[at]
                    del self.seqs[at:], self.roles[at:], self.texts[at:]
                if not text:
                    return
            elif event not in ("edit", "delta"):
                raise ValueError(f"unknown event {event!r}")
        self.seqs.append(seq if target is None or event in (None, "message") else target)
        self.roles.append(role or "")
        self.texts.append([text])

    def take(self) -> list[tuple[str, str]]:
        out = [(r, "".join(t)) for r, t in zip(self.roles, self.texts, strict=True)]
        self.__init__()
        return out


def format_chats(log: DataFrame, conv: str = "conv_id", seq: str = "turn", role: str = "role", text: str = "text", event: str | None = None, target: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """(conv_id, part, formatted, spans): a conversation's formatted text in parts to be joined in order, with the loss spans of each part.

    Where the log has events beside messages, a conversation is folded as a whole before it is cut into parts."""
    kind = log.schema[conv].dataType.simpleString()
    cols = [F.col(conv).alias("conv"), F.col(seq).cast("bigint").alias("seq"), (F.col(event) if event else F.lit(None)).cast("string").alias("event"), F.col(role).cast("string").alias("role"), F.col(text).alias("text"), (F.col(target) if target else F.lit(None)).cast("bigint").alias("target")]
    rows = log.select(*cols).repartition("conv").sortWithinPartitions("conv", "seq", "event", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, now, part, began = Fold(), None, 0, False

        def written() -> Iterator[pa.RecordBatch]:
            nonlocal part
            messages = fold.take()
            for at in range(0, max(len(messages), 1), chunk):
                formatted, spans = render(messages[at : at + chunk])
                yield pa.RecordBatch.from_arrays([pa.array([now], ids), pa.array([part], pa.int32()), pa.array([formatted]), pa.array([[{"from": a, "to": b} for a, b in spans]], pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())])))], ["conv_id", "part", "formatted", "spans"])
                part += 1

        ids = None
        for batch in batches:
            ids = batch.schema.field(0).type
            for at in range(0, batch.num_rows, 1024):
                for c, s, e, r, t, x in zip(*(v.to_pylist() for v in batch.slice(at, 1024).columns), strict=True):
                    if not began or c != now:
                        if began:
                            yield from written()
                        fold, now, part, began = Fold(), c, 0, True
                    elif event is None and len(fold.seqs) >= chunk:
                        yield from written()
                    fold.add(s, e, r, t, x)
        if began:
            yield from written()

    return rows.mapInArrow(run, f"conv_id {kind}, part int, formatted string, spans array<struct<from:bigint,to:bigint>>")


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) from what format_chats wrote, parts in order."""
    kind = formatted.schema["conv_id"].dataType.simpleString()
    rows = formatted.select("conv_id", "part", "formatted", "spans").repartition("conv_id").sortWithinPartitions("conv_id", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, began, ids = None, False, None

        def done() -> pa.RecordBatch:
            cols = [pa.array([now], ids), *(pa.array([x], pa.int64()) for x in (turns,)), pa.array([all_text.hexdigest()]), pa.array([loss], pa.int64()), pa.array([loss_text.hexdigest()]), pa.array([chars], pa.int64())]
            return pa.RecordBatch.from_arrays(cols, ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        turns = loss = chars = 0
        all_text, loss_text = hashlib.sha256(), hashlib.sha256()
        for batch in batches:
            ids = batch.schema.field(0).type
            for i in range(batch.num_rows):
                c, _, text, spans = (v[i].as_py() for v in batch.columns)
                if not began or c != now:
                    if began:
                        yield done()
                    now, began, turns, loss, chars = c, True, 0, 0, 0
                    all_text, loss_text = hashlib.sha256(), hashlib.sha256()
                for role, body in parse(text):
                    turns += 1
                    all_text.update(f"{role}\n{body}\n".encode())
                for span in spans:
                    body = unescape(text[span["from"] : span["to"]])
                    loss += len(body)
                    loss_text.update(body.encode())
                chars += len(text)
        if began:
            yield done()

    return rows.mapInArrow(run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")

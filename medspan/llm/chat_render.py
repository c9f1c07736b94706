"""Chat formatting by incremental rendering of a template that is a black box.

``render(turns)`` is any function from a list of (role, text) to a string. The
prefixes of a conversation are rendered one after another; where each output
begins with the one before, the new part is the turn's span. Where it doesn't,
the template rewrote history: the common prefix shows from where, and the
conversation is located afresh from its whole output, turn by turn from the end.
Inside its span, a turn's text is found by rendering the same turn with two
probe texts: what both outputs begin and end with is the turn's frame.

The default template marks turns and escapes ``\\``, ``<`` and ``[`` in roles and
texts with a backslash, so that no text can hold a control string, and is read
back exactly.

Defined results: a null text is empty, a null role is the empty role; turns of
a conversation are ordered by (turn, role, text), null turns first, and repeated
rows are kept as turns of their own; rows with a null conv_id form one
conversation; an empty table gives no conversations but those added.

``format_conversations`` takes any template, renders whole prefixes, and gives
one row for each conversation, which must fit in a task. ``format_blocks`` takes
templates that look no further back than a stated number of turns. It renders
prefixes without the turns before those and writes a conversation as blocks, so
that memory doesn't grow with the conversation and time grows with its turns.
A turn's text is never cut.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Render = Callable[[list[tuple[str, str]]], str]
_ESCAPE = re.compile(r"([\\<\[])")
_UNESCAPE = re.compile(r"\\(.)", re.S)


def probes(turns: list[tuple[str, str]]) -> tuple[str, str]:
    """Two texts with a mark that stands nowhere in the turns."""
    mark, k = "⁂", 0
    while any(mark in x for turn in turns for x in turn):
        k += 1
        mark = f"⁂{k}⁂"
    return f"{mark}a", f"{mark}{mark}b{mark}"


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\\\1", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def render_instruct(turns: list[tuple[str, str]]) -> str:
    """The default template: instruction tags, append-only."""
    out = []
    for role, text in turns:
        body = escape(text)
        if role == "user":
            out.append(f"<s>[INST] {body} [/INST]")
        elif role == "assistant":
            out.append(f" {body} </s>")
        elif role == "system":
            out.append(f"<<SYS>>\n{body}\n<</SYS>>\n")
        else:
            out.append(f"[ROLE]{escape(role)}[/ROLE]{body}[/TURN]")
    return "".join(out)


_BODY = r"((?:[^\\<\[]|\\.)*)"
_TURN = re.compile(rf"<s>\[INST\] {_BODY} \[/INST\]|<<SYS>>\n{_BODY}\n<</SYS>>\n|\[ROLE\]{_BODY}\[/ROLE\]{_BODY}\[/TURN\]| {_BODY} </s>", re.S)


def parse_instruct(formatted: str) -> list[tuple[str, str]]:
    """The turns of an output of render_instruct; raises ValueError on other strings."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        user, system, role, other, assistant = m.groups()
        if user is not None:
            turns.append(("user", unescape(user)))
        elif system is not None:
            turns.append(("system", unescape(system)))
        elif role is not None:
            turns.append((unescape(role), unescape(other)))
        else:
            turns.append(("assistant", unescape(assistant)))
        at = m.end()
    return turns


@dataclass(frozen=True)
class Span:
    """A turn in the output: [start, end) with its frame, [text_start, text_end) its text as written."""

    start: int
    end: int
    text_start: int
    text_end: int


def _common(a: str, b: str) -> int:
    """Length of the common prefix, by halving."""
    if b.startswith(a):
        return len(a)
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[:mid] == b[:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def _frame(render: Render, before: list[tuple[str, str]], turn: tuple[str, str], base: str) -> tuple[str, str] | None:
    """What stands before and after the text of a turn that follows before; null if the turn shows no text."""
    one, two = probes([*before, turn])
    first, second = render([*before, (turn[0], one)]), render([*before, (turn[0], two)])
    if not (first.startswith(base) and second.startswith(base)):
        return None
    first, second = first[len(base) :], second[len(base) :]
    at, end = first.find(one), second.rfind(two)
    if at < 0 or second.find(two) != at:
        return None
    return second[:at], second[end + len(two) :]


def locate(render: Render, turns: list[tuple[str, str]], frames: dict | None = None) -> tuple[str, list[Span | None], int | None]:
    """(output, span of each turn, first turn whose rendering rewrote history or null).

    frames: keeps frames by (role, previous role) between conversations; a frame is
    used only if it is, with the turn's text as it stands, the turn's whole new output; else
    the turn is probed. For a rewriting template, spans are searched in the whole output.
    """
    frames = {} if frames is None else frames
    out, spans, rewritten = "", [], None
    for i, (role, text) in enumerate(turns):
        new = render(turns[: i + 1])
        if rewritten is None and not new.startswith(out):
            rewritten = i
        if rewritten is None:
            frame = _known_frame(render, turns[:i], (role, text), out, new, i == 0, frames)
            spans.append(Span(len(out), len(new), len(out) + len(frame[0]), len(new) - len(frame[1])) if frame is not None else None)
        out = new
    if rewritten is not None:
        spans = _search(render, turns, out)
    return out, spans, rewritten


def _known_frame(render: Render, before: list[tuple[str, str]], turn: tuple[str, str], base: str, new: str, first: bool, frames: dict) -> tuple[str, str] | None:
    """The frame kept for turns like this if it makes up the new output with the text as it stands, else the one that probes show."""
    key = (turn[0], before[-1][0] if before else None, first)
    frame = frames.get(key)
    if frame is None or frame[0] + turn[1] + frame[1] != new[len(base) :]:
        frame = _frame(render, before, turn, base)
        if frame is not None:
            frames[key] = frame
    return frame


def increments(render: Render, turns: Iterable[tuple[str, str]], reach: int, frames: dict) -> Iterator[tuple[str, Span | None]]:
    """(new output, its span within that) of one turn after the other, for a template whose output for a turn
    depends on that turn, on ``reach`` turns before it and on nothing else. Raises ValueError if an output
    doesn't begin with the one before."""
    window: list[tuple[str, str]] = []
    base, first = "", True
    for turn in turns:
        new = render([*window, turn])
        if not new.startswith(base):
            raise ValueError("the template rewrites history: format_conversations renders it")
        frame = _known_frame(render, window, turn, base, new, first, frames)
        part = new[len(base) :]
        yield part, Span(0, len(part), len(frame[0]), len(part) - len(frame[1])) if frame is not None else None
        kept = [*window, turn][-reach:] if reach else []
        base = new if len(kept) > len(window) else render(kept) if kept else ""
        window, first = kept, False


def _search(render: Render, turns: list[tuple[str, str]], out: str) -> list[Span | None]:
    """Spans in the final output of a template that rewrites history: the part that changes when one turn's text is replaced."""
    spans: list[Span | None] = []
    mark, _ = probes([*turns, (out, "")])
    for i, (role, text) in enumerate(turns):
        other = [*turns[:i], (role, mark + text + mark), *turns[i + 1 :]]
        changed = render(other)
        grown = len(changed) - len(out) - 2 * len(mark)
        at = changed.find(mark)
        end = changed.rfind(mark) - len(mark)
        if at < 0 or end < at or grown < 0 or changed[:at] != out[:at] or changed[end + 2 * len(mark) :] != out[end:]:
            spans.append(None)
        else:
            spans.append(Span(at, end, at, end))
    return spans


def format_conversations(rows: DataFrame, render: Render = render_instruct, learn: tuple = ("assistant",)) -> DataFrame:
    """One row per conversation: conv_id, formatted, spans of turns, loss_spans (the texts of the roles in learn), rewrites_history.

    A turn that a template doesn't show has a span of -1."""
    packed = (
        rows.select("conv_id", F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
        .groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    )
    kind = packed.schema["conv_id"].dataType.simpleString()
    span = "array<struct<start:int,`end`:int>>"

    def run(batches):
        frames: dict = {}
        for batch in batches:
            out = {"conv_id": batch.column(0), "formatted": [], "spans": [], "loss_spans": [], "rewrites_history": []}
            for turns in batch.column(1).to_pylist():
                pairs = [(t["role"], t["text"]) for t in turns]
                text, spans, rewritten = locate(render, pairs, frames)
                out["formatted"].append(text)
                out["spans"].append([{"start": s.start, "end": s.end} if s else {"start": -1, "end": -1} for s in spans])
                out["loss_spans"].append([{"start": s.text_start, "end": s.text_end} for s, (role, _) in zip(spans, pairs, strict=True) if s and role in learn])
                out["rewrites_history"].append(rewritten is not None)
            pair = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([out["conv_id"], pa.array(out["formatted"], pa.string()), pa.array(out["spans"], pair), pa.array(out["loss_spans"], pair), pa.array(out["rewrites_history"], pa.bool_())], list(out))

    return packed.mapInArrow(run, f"conv_id {kind}, formatted string, spans {span}, loss_spans {span}, rewrites_history boolean")


_PAIR = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_BLOCK = pa.schema([("block", pa.int64()), ("last", pa.bool_()), ("formatted", pa.string()), ("spans", pa.list_(_PAIR)), ("loss_spans", pa.list_(_PAIR))])


def format_blocks(rows: DataFrame, render: Render = render_instruct, learn: tuple = ("assistant",), reach: int = 1, size: int = 1 << 20) -> DataFrame:
    """Rows (conv_id, block, last, formatted, spans, loss_spans): a conversation's blocks follow each other within a
    partition, begin with a turn and end with the one that fills ``size`` characters; spans count from the block's start.

    reach: turns before a turn that its output may depend on (``increments``). Sorting spills, and a task
    holds a batch of rows and a block."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    ordered = (
        rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    )

    def run(batches):
        frames: dict = {}
        current: list = []  # the turn that increments takes next
        steps = conv = None
        block, parts, spans, loss, length = 0, [], [], [], 0
        done, weight, kind = [], 0, None

        def turns():
            while True:
                yield current.pop()

        def close(last):
            nonlocal block, parts, spans, loss, length, weight
            done.append((conv, block, last, "".join(parts), spans, loss))
            weight += length
            block, parts, spans, loss, length = block + 1, [], [], [], 0

        def emit():
            nonlocal done, weight
            columns = list(zip(*done, strict=True))
            done, weight = [], 0
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, f.type) for c, f in zip(columns[1:], _BLOCK, strict=True))], ["conv_id", *_BLOCK.names])

        for batch in batches:
            kind = batch.schema.field(0).type
            for of, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if steps is None or of != conv:
                    if steps is not None:
                        close(True)
                    conv, block, steps = of, 0, increments(render, turns(), reach, frames)
                elif length >= size:
                    close(False)
                current.append((role, text))
                part, span = next(steps)
                spans.append((length, length + len(part)) if span else (-1, -1))
                if span and role in learn:
                    loss.append((length + span.text_start, length + span.text_end))
                parts.append(part)
                length += len(part)
                if weight >= size:
                    yield emit()
            if done:
                yield emit()
        if steps is not None:
            close(True)
            yield emit()

    pair = "array<struct<start:bigint,`end`:bigint>>"
    return ordered.mapInArrow(run, f"conv_id {kind}, block bigint, last boolean, formatted string, spans {pair}, loss_spans {pair}")


class Reader:
    """What read_back gives, from an output in blocks that begin with a turn."""

    def __init__(self) -> None:
        self.turns = self.loss_chars = self.chars = 0
        self.whole, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, loss_spans: list[tuple[int, int]]) -> None:
        for role, text in parse_instruct(formatted):
            self.turns += 1
            self.whole.update(f"{role}\n{text}\n".encode("utf-8", "replace"))
        for a, b in loss_spans:
            text = unescape(formatted[a:b])
            self.loss_chars += len(text)
            self.loss.update(text.encode("utf-8", "replace"))
        self.chars += len(formatted)

    def result(self) -> tuple[int, str, int, str]:
        return self.turns, self.whole.hexdigest(), self.loss_chars, self.loss.hexdigest()


def read_back(formatted: str, loss_spans: list[tuple[int, int]]) -> tuple[int, str, int, str]:
    """(turns, digest of the turns, code points under the mask, their digest) from an output of the default template."""
    reader = Reader()
    reader.add(formatted, loss_spans)
    return reader.result()

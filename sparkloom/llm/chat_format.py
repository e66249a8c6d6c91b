"""Chat formatting by incremental black-box rendering.

A template is a function from a list of turns to a string. Nothing is assumed of it: to find where a turn's text lies,
successive prefixes of the conversation are rendered and consecutive outputs compared. An output that doesn't extend the
one before it shows that the template rewrites history; then there are no sound spans, and the conversation is reported
as rewritten. A turn's span is what its prefix adds, and inside it the text lies where a rendering with another text at
that turn first and last differs.

Rows meet by conversation; a partition is sorted by conversation and turn and streamed, so only one conversation is held
at a time.

Defined cases: a null text counts as empty, a null role as the empty role; a repeated turn number keeps all its rows,
ordered by role and text; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

# The control strings of the template.
OPEN, CLOSE, STOP = "[INST]", "[/INST]", "</s>"
_CONTROL = re.compile(r"[\\\[\]<>]")
_ESCAPED = re.compile(r"\\([0-5])")
_SIGNS = "\\[]<>\n"


def escape(text: str) -> str:
    """Puts a code in place of each character that a control string is made of; unescape undoes it."""
    return _CONTROL.sub(lambda m: f"\\{_SIGNS.index(m[0])}", text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", f"\\{_SIGNS.index(chr(10))}")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _SIGNS[int(m[1])], text)


def inst_turn(role: str, text: str) -> str:
    if role == "assistant":
        return f" {escape(text)} {STOP}"
    return f"{OPEN}{escape_role(role)}\n{escape(text)} {CLOSE}"


def inst_template(turns: list[Turn]) -> str:
    """Turns of users and others in [INST] with their role, answers after them up to </s>."""
    return "".join(inst_turn(role, text) for role, text in turns)


_TURN = re.compile(r"\[INST\]([^\[\]<>\n]*)\n([^\[\]<>]*) \[/INST\]| ([^\[\]<>]*) </s>")


def parse(formatted: str) -> list[Turn]:
    """The turns back from what inst_template wrote."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        turns.append(("assistant", unescape(m[3])) if m[1] is None else (unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


@dataclass
class Rendered:
    formatted: str
    spans: list[tuple[int, int]]
    rewritten: bool


def _common(a: str, b: str) -> int:
    """Length of the common prefix."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


PROBES = ("a", "b")


def render(turns: list[Turn], template: Template) -> Rendered:
    """Renders prefix after prefix. spans: for each turn, where its (escaped) text lies in the whole output.

    The last turn of a prefix is rendered with two one-character texts as well; what they share before and after that
    character is the turn's frame, and the text lies between.
    """
    before, spans, rewritten = "", [], False
    for i, (role, _) in enumerate(turns):
        now = template(turns[: i + 1])
        if not now.startswith(before):
            rewritten = True
            before = now
            continue
        one, two = (template([*turns[:i], (role, p)]) for p in PROBES)
        head = _common(one, two)
        tail = len(one) - head - 1
        if one[head : head + 1] != PROBES[0] or two[head : head + 1] != PROBES[1] or one[head + 1 :] != two[head + 1 :] or not now[:head] == one[:head] or (tail and now[-tail:] != one[-tail:]):
            rewritten = True
        else:
            spans.append((head, len(now) - tail))
        before = now
    return Rendered(before, [] if rewritten else spans, rewritten)


FORMATTED = "conv_id bigint, formatted string, loss_spans array<struct<begin:bigint,end:bigint>>, rewritten boolean, n_turns bigint"


def format_conversations(turns: DataFrame, template: Template = inst_template, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """turns(conv_id, turn, role, text) to one row per conversation: the output and the spans that count for the loss."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    nothing = object()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, held, out, size = nothing, [], [], 0

        def close() -> None:
            nonlocal size
            made = render(held, template)
            spans = [{"begin": a, "end": b} for (role, _), (a, b) in zip(held, made.spans, strict=False) if role in loss_roles]
            out.append({"conv_id": conv, "formatted": made.formatted, "loss_spans": spans, "rewritten": made.rewritten, "n_turns": len(held)})
            size += len(made.formatted)

        def flush() -> pa.RecordBatch:
            nonlocal size
            batch = pa.RecordBatch.from_pylist(out, schema=schema)
            out.clear()
            size = 0
            return batch

        for batch in batches:
            for own, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if own != conv:
                    if conv is not nothing:
                        close()
                        if size > 1 << 20:
                            yield flush()
                    conv, held = own, []
                held.append((role, text))
        if conv is not nothing:
            close()
        if out:
            yield flush()

    schema = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("loss_spans", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), ("rewritten", pa.bool_()), ("n_turns", pa.int64())])
    return ordered.mapInArrow(run, FORMATTED)


def read_back(formatted: DataFrame) -> DataFrame:
    """From outputs of inst_template alone: conv_id, turns (role, text), the unescaped text under the loss mask, length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                text = row["formatted"]
                turns = parse(text)
                loss = "".join(unescape(text[s["begin"] : s["end"]]) for s in row["loss_spans"])
                whole = "".join(f"{role}\n{said}\n" for role, said in turns)
                out.append((row["conv_id"], len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text), row["rewritten"]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names) if out else pa.RecordBatch.from_pylist([], pa.schema(list(zip(names, types, strict=True))))

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewritten"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
    return formatted.mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, rewritten boolean")

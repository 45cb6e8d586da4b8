"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) to one string. Nothing is known of it: the prefixes of
a conversation are rendered one after the other, each output is compared with the one before to find what the
new turn added, and a template that does not only append is reported as rewriting history. Where in that
stretch the text itself lies is found by rendering the same prefix with two probe texts and comparing them.

The template given here marks turns and escapes every character that could begin a control string, with a
backslash, so its output can be read back exactly.

Defined results: turns are ordered by turn, then role and text, nulls first; null text and null role are
empty; repeated rows are repeated turns; a null conv_id is a conversation of its own; an empty table gives no
conversations. A conversation is rendered in one piece, as its result is one string.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]
PROBES = ("", "")  # nothing in common, and no control string
_TURN = re.compile(r"\[INST\] (.*?) \[/INST\]|<s> (.*?) </s>|\[ROLE\](.*?)\[/ROLE\] (.*?) \[/TURN\]", re.S)


def escaped(text: str) -> str:
    """No control string is left, as each begins with [ or <."""
    return text.replace("\\", "\\\\").replace("[", "\\[").replace("<", "\\<")


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def instruct(turns: list[Turn]) -> str:
    """[INST] user [/INST], <s> assistant </s>, [ROLE]any other[/ROLE] text [/TURN]."""
    out = []
    for role, text in turns:
        if role == "user":
            out.append(f"[INST] {escaped(text)} [/INST]")
        elif role == "assistant":
            out.append(f"<s> {escaped(text)} </s>")
        else:
            out.append(f"[ROLE]{escaped(role)}[/ROLE] {escaped(text)} [/TURN]")
    return "".join(out)


def read_back(formatted: str) -> list[Turn]:
    """The turns of an output of instruct()."""
    out, end = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != end:
            break
        end = m.end()
        user, assistant, role, text = m.groups()
        kind, body = ("user", user) if user is not None else ("assistant", assistant) if assistant is not None else (unescaped(role), text)
        out.append((kind, unescaped(body)))
    if end != len(formatted):
        raise ValueError("not an output of this template")
    return out


def common_prefix(a: str, b: str) -> int:
    """Length of the longest common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid)
    return low


def text_span(template: Template, turns: list[Turn], t: int, formatted: str) -> tuple[int, int]:
    """Where turn t's text lies in `formatted`, the rendering of turns."""
    role = turns[t][0]
    a, b = (template([*turns[:t], (role, p), *turns[t + 1 :]]) for p in PROBES)
    head, tail = common_prefix(a, b), common_prefix(a[::-1], b[::-1])
    return head, len(formatted) - tail


def located(template: Template, turns: list[Turn]) -> tuple[str, list[tuple[int, int, int, int]], bool]:
    """The whole rendering; per turn its start and end, and its text's; whether the template rewrites history."""
    before, spans, rewrites = "", [], False
    for t in range(len(turns)):
        now = template(turns[: t + 1])
        same = common_prefix(before, now)
        rewrites |= same < len(before)
        spans.append((same, len(now), *text_span(template, turns[: t + 1], t, now)))
        before = now
    if rewrites:  # places found in a prefix don't hold in the whole: probe every turn there
        spans = []
        for t in range(len(turns)):
            s, e = text_span(template, turns, t, before)
            spans.append((s, e, s, e))
    return before, spans, rewrites


def _format(template: Template, trained: frozenset[str]):
    def run(batches):
        for b in batches:
            text, spans, rewrites = [], [], []
            for turns in b.column("turns").to_pylist():
                out, found, odd = located(template, [(x["role"] or "", x["text"] or "") for x in turns])
                text.append(out)
                spans.append([{"start": s, "end": e} for x, (_, _, s, e) in zip(turns, found, strict=True) if x["role"] in trained])
                rewrites.append(odd)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.record_batch([b.column("conv_id"), pa.array(text, pa.string()), pa.array(spans, kind), pa.array(rewrites, pa.bool_())], ["conv_id", "formatted", "loss_spans", "rewrites_history"])

    return run


def formatted_chats(conversations: DataFrame, template: Template = instruct, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, formatted, loss_spans (code points, end exclusive), rewrites_history."""
    turn = F.struct(F.col("turn").cast("long").alias("turn"), "role", "text")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return rows.mapInArrow(_format(template, frozenset(trained)), "conv_id long, formatted string, loss_spans array<struct<start:long,end:long>>, rewrites_history boolean")


def _digest(batches):
    for b in batches:
        cols: list[list] = [[] for _ in range(5)]
        for text, spans in zip(b.column("formatted").to_pylist(), b.column("loss_spans").to_pylist(), strict=True):
            turns = read_back(text)
            loss = "".join(unescaped(text[s["start"] : s["end"]]) for s in spans)
            sha = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
            for c, v in zip(cols, (len(turns), sha, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)), strict=True):
                c.append(v)
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        yield pa.record_batch([b.column("conv_id"), *(pa.array(c, pa.string() if i in (1, 3) else pa.int64()) for i, c in enumerate(cols))], names)


def chat_digest(formatted: DataFrame) -> DataFrame:
    """What the outputs of instruct() hold, read back."""
    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

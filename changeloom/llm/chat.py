"""Chat formatting: a finite-state machine over roles and a declarative template.

Each turn becomes three segments: an opening marker, the escaped text and a closing marker. Only the
text of roles under the loss carries the loss flag. Control strings inside texts are escaped with one
character, so the formatted output can be parsed back to the very same turns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeloom.llm.shared import partitions


@dataclass(frozen=True)
class ChatTemplate:
    """Markers, allowed turn order and loss roles. `order` maps a state to {role: next state}; unlisted roles are violations."""

    open: dict = field(default_factory=lambda: {"system": "### System: ", "user": "### User: ", "assistant": "### Assistant: "})
    other_open: str = "### Role("
    other_close: str = "): "
    close: str = "</turn>"
    escape: str = "\\"
    loss_roles: tuple = ("assistant",)
    order: dict = field(
        default_factory=lambda: {
            "start": {"system": "system", "user": "user"},
            "system": {"user": "user"},
            "user": {"assistant": "assistant"},
            "assistant": {"user": "user"},
        }
    )
    final: tuple = ("assistant",)

    def __post_init__(self):
        c = self.controls()
        for a in c:
            if not a or self.escape in a:
                raise ValueError("a control string is empty or holds the escape character")
            if any(a.endswith(self.close[:k]) for k in range(1, len(self.close))):
                raise ValueError(f"{a!r} ends like the closing marker begins: a text before it could not be told apart")

    def controls(self) -> list[str]:
        return sorted({x.rstrip() for x in (*self.open.values(), self.other_open, self.other_close, self.close)}, key=lambda x: (-len(x), x))

    def _tokens(self) -> str:
        return "|".join(map(re.escape, (self.escape, *self.controls())))

    def escaper(self):
        rx, e = re.compile(self._tokens()), self.escape
        return lambda text: rx.sub(lambda m: e + m[0], text)

    def unescaper(self):
        rx = re.compile(re.escape(self.escape) + f"({self._tokens()})")
        return lambda text: rx.sub(lambda m: m[1], text)

    def opening(self, role: str, escape) -> str:
        return self.open[role] if role in self.open else self.other_open + escape(role) + self.other_close

    def parser(self):
        """From formatted text to [(role, text, loss)]: reads markers only where they are not escaped."""
        un, e = self.unescaper(), re.escape(self.escape)
        body = f"(?:{e}(?:{self._tokens()})|(?!{self._tokens()}).)*+"
        known = "|".join(f"(?P<r{i}>{re.escape(m)})" for i, m in enumerate(self.open.values()))
        rx = re.compile(f"(?:{known}|{re.escape(self.other_open)}(?P<other>{body}){re.escape(self.other_close)})(?P<text>{body}){re.escape(self.close)}", re.S)
        roles = list(self.open)

        def parse(formatted: str) -> list[tuple[str, str, bool]]:
            out, at = [], 0
            while at < len(formatted):
                m = rx.match(formatted, at)
                if not m:
                    raise ValueError(f"no turn at character {at}")
                role = un(m["other"]) if m["other"] is not None else next(r for i, r in enumerate(roles) if m[f"r{i}"] is not None)
                out.append((role, un(m["text"]), role in self.loss_roles))
                at = m.end()
            return out

        return parse


SEGMENTS = pa.schema([("conv_id", pa.int64()), ("turn_no", pa.int64()), ("kind", pa.string()), ("text", pa.string()), ("loss", pa.bool_()), ("violation", pa.string())])
SEGMENTS_DDL = "conv_id long, turn_no long, kind string, text string, loss boolean, violation string"


def format_chat(turns: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """Segments (conv_id, turn_no, kind, text, loss, violation) of conversations (conv_id, turn, role, text).

    Rows come out conversation by conversation in turn order within each partition. A null text or role is
    empty; a null turn sorts first; rows that tie on turn follow role, then text, and none is dropped; an
    unknown role gets the general marker. `violation` names the role that the state machine refuses at that
    turn, and on the last closing segment of a conversation that stops in a state that is not final:
    'unfinished'. Turns that violate the order are formatted all the same. An empty table gives no rows.
    Turns stream through the tasks: no conversation is held whole. Extra columns are ignored.
    """
    t = template or ChatTemplate()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        esc, conv, state, n, held = t.escaper(), object(), "start", 0, None
        for b in batches:
            out = []
            for c, role, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if c != conv or n == 0:
                    if held:
                        out.append((*held[:5], held[5] or (None if state in t.final else "unfinished")))
                    held, conv, state, n = None, c, "start", 0
                if held:
                    out.append(held)
                after = t.order.get(state, {}).get(role)
                bad = None if after else f"{role} after {state}"
                state = after or (role if role in t.order else state)
                out.append((c, n, "open", t.opening(role, esc), False, bad))
                out.append((c, n, "text", esc(text), role in t.loss_roles, None))
                held = (c, n, "close", t.close, False, None)
                n += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), SEGMENTS, strict=True)], schema=SEGMENTS)
        if held:
            last = (*held[:5], None if state in t.final else "unfinished")
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(last, SEGMENTS, strict=True)], schema=SEGMENTS)

    rows = turns.select(F.col("conv_id").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.col("turn").cast("long").alias("turn"))
    dealt = rows.repartition(partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(run, SEGMENTS_DDL)


DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_violations", pa.int64())])


def read_back(segments: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """Parse formatted segments, which arrive grouped and in order as `format_chat` gives them, into one digest row a conversation.

    The text of each turn is joined from its segments and parsed with the template's grammar; the loss mask
    covers the segments flagged so, unescaped. Digests are updated turn by turn.
    """
    t = template or ChatTemplate()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parse, un = t.parser(), t.unescaper()
        conv, at, parts = None, None, []
        n = chars = formatted = bad = 0
        turns = loss = None
        out = []

        def end_turn():
            nonlocal n
            for role, text, _ in parse("".join(parts)):
                turns.update(f"{role}\n{text}\n".encode())
                n += 1
            parts.clear()

        def end_conversation():
            end_turn()
            out.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), formatted, bad))

        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(6)]
            for c, no, _, text, flag, violation in zip(*cols, strict=True):
                if turns is None or c != conv or no < at:
                    if turns is not None:
                        end_conversation()
                    conv, at = c, no
                    n = chars = formatted = bad = 0
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                elif no != at:
                    end_turn()
                    at = no
                parts.append(text)
                formatted += len(text)
                bad += violation is not None
                if flag:
                    plain = un(text)
                    chars += len(plain)
                    loss.update(plain.encode())
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist([dict(zip(DIGESTS.names, r, strict=True)) for r in out], schema=DIGESTS)
                out.clear()
        if turns is not None:
            end_conversation()
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(DIGESTS.names, r, strict=True)) for r in out], schema=DIGESTS)

    return segments.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_violations long")

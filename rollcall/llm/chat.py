"""Chat formatting by a finite-state machine over roles.

A Template declares the marks of each role's turns, which of their texts bear loss, the control strings that no text may
hold, and the machine: its states and, for each state and role, the next state. A turn without a next state breaks the order: it
is formatted all the same, but marked as out of order, and the machine goes on from the state of that turn's name. Every turn
becomes segments of text, each with its loss flag.

Control strings inside texts are escaped by a backslash after their first character, and backslashes are doubled; so
the formatted text holds control strings only where the template put them, and reading it back gives the same turns.

Turns are sorted within conversations and formatted one after the other; a task holds no conversation whole. Conversations of
more than CHUNK turns are cut into chunks of neighbouring turns, which tasks share: one pass finds what state each chunk
leads to from every state, these are put together along the conversation, and a second pass formats each chunk from its
own state. Only a digest of a conversation reads it in one task, from the formatted turns, in constant memory.

Nulls: a null text or role is empty, a null conv_id is a conversation of its own, a null turn comes first. Turns
of the same number are ordered by role and text; rows that repeat each other are turns of their own. An empty table
gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scan import CHUNK, split_busy
from .common import keep, slices, small_batches

START = "start"


@dataclass(frozen=True)
class Template:
    begin: str = "<|begin|>"
    #: role: its mark and whether its text bears loss. Other roles: `other`, the role, `named`.
    roles: dict = field(default_factory=lambda: {"system": ("<|system|>\n", False), "user": ("<|user|>\n", False), "assistant": ("<|assistant|>\n", True)})
    other: str = "<|other|>"
    named: str = "<|named|>\n"
    end: str = "<|end|>\n"
    #: Strings that no text may hold as such, besides the marks.
    foreign: tuple = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
    #: (state, role): next state. States are `start` and names of roles.
    rules: dict = field(default_factory=lambda: {(START, "system"): "system", (START, "user"): "user", ("system", "user"): "user", ("user", "assistant"): "assistant", ("assistant", "user"): "user"})
    #: States in which a conversation is complete.
    ends: tuple = ("assistant",)

    def controls(self) -> list[str]:
        marks = [self.begin, self.other, self.named, self.end, *(m for m, _ in self.roles.values())]
        return sorted({c.rstrip("\n") for c in (*marks, *self.foreign)})

    def check(self) -> None:
        found = self.controls()
        if any(len(c) < 2 or "\\" in c or "\n" in c for c in found):
            raise ValueError("control strings have two characters or more, none of them a backslash or a line's end")
        marks = [m.rstrip("\n") for m in (self.begin, self.other, self.named, self.end, *(m for m, _ in self.roles.values()))]
        if any(a != b and a in b or marks.count(a) > 1 for a in marks for b in marks):
            raise ValueError("no mark may hold another one")


class Machine:
    """A template made ready for a task."""

    def __init__(self, template: Template):
        template.check()
        self.t = t = template
        controls = t.controls()
        self._escape = re.compile("|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in controls))
        self._first = {c[0] for c in controls}
        self.states = [START, *sorted({*t.rules.values(), *t.roles} - {START})]
        self.place = {s: i for i, s in enumerate(self.states)}
        self._next = {(self.place[s], r): self.place[to] for (s, r), to in t.rules.items()}
        marks = {m: r for r, (m, _) in t.roles.items()}
        self._head = re.compile("|".join(map(re.escape, [*marks, t.other])))
        self._marks = marks

    def step(self, state: int, role: str) -> tuple[int, bool]:
        """The next state, and whether the turn is in order."""
        to = self._next.get((state, role))
        return (self.place.get(role, state), False) if to is None else (to, True)

    def escape(self, text: str) -> str:
        if "\\" in text:
            text = text.replace("\\", "\\\\")
        return self._escape.sub(lambda m: m[0] + "\\", text)

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(\\?)", r"\1", text) if "\\" in text else text

    def segments(self, role: str, text: str, opens: bool) -> list[tuple[str, bool]]:
        """A turn's text segments with their loss flags."""
        begin = self.t.begin if opens else ""
        if role in self.t.roles:
            mark, loss = self.t.roles[role]
            head = begin + mark
        else:
            head, loss = begin + self.t.other + self.escape(role) + self.t.named, False
        return [(head, False), (self.escape(text), loss), (self.t.end, False)]

    def read(self, text: str) -> Iterator[tuple[str, str]]:
        """(role, text) of the turns that a formatted text holds."""
        at = len(self.t.begin) if text.startswith(self.t.begin) else 0
        while at < len(text):
            head = self._head.match(text, at)
            if not head:
                raise ValueError("not a formatted text")
            at, role = head.end(), self._marks.get(head[0])
            if role is None:
                close = text.index(self.t.named, at)
                role, at = self.unescape(text[at:close]), close + len(self.t.named)
            close = text.index(self.t.end, at)
            yield role, self.unescape(text[at:close])
            at = close + len(self.t.end)


TURN = "conv_id long, chunk int, place long, turn long, in_order boolean, state string, segments array<struct<text: string, loss: boolean>>"


def _turns(conversations: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return small_batches(conversations).select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), text("role"), text("text"))


def _sorted(rows: DataFrame) -> DataFrame:
    """Turns in order, a conversation (or chunk of one) in one partition."""
    keys = ["conv_id", "_chunk"]
    return rows.repartition(*keys).sortWithinPartitions(*keys, "turn", "role", "text")


def _starts(rows: DataFrame, template: Template) -> DataFrame:
    """conv_id, _chunk, _start of each chunk: the state that the chunks before it lead to."""

    def go(batches):
        import pyarrow as pa

        machine = Machine(template)
        now, states = None, []
        out = lambda: pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*now, states), (pa.int64(), pa.int32(), pa.list_(pa.int32())))], ["conv_id", "_chunk", "ends"])
        for b in slices(batches):
            for key, role in zip(zip(b.column("conv_id").to_pylist(), b.column("_chunk").to_pylist()), b.column("role").to_pylist()):
                if key != now:
                    if now:
                        yield out()
                    now, states = key, list(range(len(machine.states)))
                states = [machine.step(s, role)[0] for s in states]
        if now:
            yield out()

    each = _sorted(rows).select("conv_id", "_chunk", "role").mapInArrow(go, "conv_id long, _chunk int, ends array<int>")
    before = F.collect_list("ends").over(Window.partitionBy("conv_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1))  # a row a chunk
    return each.select("conv_id", "_chunk", F.aggregate(before, F.lit(0), lambda s, ends: ends[s]).alias("_start"), (F.size(before) == 0).alias("_opens"))


def _format(template: Template):
    """Sorted turns (conv_id, _chunk, turn, role, text, _start, _opens) to formatted ones."""

    def go(batches):
        import pyarrow as pa

        machine, now, state, place = Machine(template), None, 0, 0
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))]
        for b in slices(batches):
            out = []
            for conv, chunk, turn, role, text, start, opens in zip(*[b.column(i).to_pylist() for i in range(7)]):
                if (conv, chunk) != now:
                    now, state, place = (conv, chunk), start, 0
                state, fine = machine.step(state, role)
                out.append((conv, chunk, place, turn, fine, machine.states[state], [{"text": s, "loss": loss} for s, loss in machine.segments(role, text, opens and not place)]))
                place += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds], ["conv_id", "chunk", "place", "turn", "in_order", "state", "segments"])

    return go


def _parts(conversations: DataFrame, template: Template, chunk: int) -> tuple[DataFrame, DataFrame | None]:
    """Sorted turns of ordinary conversations, and those of large ones in chunks, ready to be formatted."""
    quiet, busy = split_busy(_turns(conversations), "conv_id", ("turn", "role", "text"), chunk)
    columns = ["conv_id", "_chunk", "turn", "role", "text", "_start", "_opens"]
    quiet = _sorted(quiet.withColumns({"_chunk": F.lit(0), "_start": F.lit(0), "_opens": F.lit(True)})).select(columns)
    if busy is None:
        return quiet, None
    starts = keep(_starts(busy, template), "starts")
    same = busy.conv_id.eqNullSafe(F.col("_conv")) & (busy["_chunk"] == F.col("_of"))
    busy = busy.join(F.broadcast(starts.select(F.col("conv_id").alias("_conv"), F.col("_chunk").alias("_of"), "_start", "_opens")), same)  # a row a chunk
    return quiet, _sorted(busy.select(columns))


def format_turns(conversations: DataFrame, template: Template = Template(), chunk: int = CHUNK) -> DataFrame:
    """One row a turn: conv_id, chunk and place (the order within the conversation), turn, in_order, state, and segments, an array of
    (text, loss). A conversation's text is that of its segments, one after the other."""
    quiet, busy = _parts(conversations, template, chunk)
    out = quiet.mapInArrow(_format(template), TURN)
    return out if busy is None else out.unionByName(busy.mapInArrow(_format(template), TURN))


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean, complete boolean"


def _read_back(template: Template):
    """Formatted turns, in order, to one row a conversation, from nothing but the segments and the machine's marks."""

    def go(batches):
        import pyarrow as pa

        names = [x.split()[0] for x in DIGEST.split(", ")]
        kinds = [{"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[x.split()[1]] for x in DIGEST.split(", ")]
        machine, now, held, out = Machine(template), (), None, []
        done = lambda: (now[0], held[0], held[1].hexdigest(), held[2], held[3].hexdigest(), held[4], held[5], held[6] in template.ends)
        for b in batches:
            for conv, fine, state, segments in zip(*[b.column(x).to_pylist() for x in ("conv_id", "in_order", "state", "segments")]):
                if now != (conv,):
                    if now:
                        out.append(done())
                    now, held = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0, True, START]
                text = "".join(s["text"] for s in segments)
                for role, said in machine.read(text):
                    held[0] += 1
                    held[1].update(f"{role}\n{said}\n".encode())
                loss = machine.unescape("".join(s["text"] for s in segments if s["loss"]))
                held[2] += len(loss)
                held[3].update(loss.encode())
                held[4] += len(text)
                held[5], held[6] = held[5] and fine, state
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
                out = []
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(done(), kinds)], names)

    return go


def digests(conversations: DataFrame, template: Template = Template(), chunk: int = CHUNK) -> DataFrame:
    """One row a conversation, read back from its formatted turns: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid (all
    turns in order) and complete (it ends where one may). Turns are read where they were formatted; those of large
    conversations are formatted in chunks and come together for the digest, which can't be shared."""
    quiet, busy = _parts(conversations, template, chunk)
    write, read = _format(template), _read_back(template)
    out = quiet.mapInArrow(lambda batches: read(write(batches)), DIGEST)
    if busy is None:
        return out
    formatted = busy.mapInArrow(write, TURN).repartition("conv_id").sortWithinPartitions("conv_id", "chunk", "place")
    return out.unionByName(formatted.mapInArrow(read, DIGEST))

"""Chat formatting: a finite-state machine over roles, and text segments with loss flags from a template.

Rows of a conversation are taken by turn, ties by role and text; a null text or role counts as empty,
rows without a conversation id form one conversation of their own. Every turn is formatted, also those
the machine refuses: the flag ``in_order`` says whether all turns up to it were accepted. Control strings
inside texts are broken by an escape sign after their first character, and escape signs are doubled, so
the formatted text reads back exactly. Turns of one conversation stream through one task in order, a
batch at a time; nothing is gathered.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

ESCAPE = "\\"


@dataclass(frozen=True)
class Turn:
    """How a role's text is wrapped; the text, and ``after`` if so asked, is under the loss."""

    before: str
    after: str
    loss: bool = False
    loss_after: bool = False


@dataclass(frozen=True)
class ChatTemplate:
    """Roles, the turns that may follow each state, and the form of roles it does not name.

    ``after_role`` ends the name of a role that the template does not name, ``other`` wraps its turn.
    Each role's ``before`` must start with a control string of its own.
    """

    turns: Mapping[str, Turn]
    follows: Mapping[str, tuple[str, ...]]
    other: Turn = Turn("[ROLE] ", " [END]")
    after_role: str = " [/ROLE] "
    controls: tuple[str, ...] = field(default=())


# State "" is the start of a conversation.
INST = ChatTemplate(
    turns={
        "system": Turn("[SYS] ", " [/SYS]"),
        "user": Turn("[INST] ", " [/INST]"),
        "assistant": Turn("<s> ", "</s>", loss=True),
    },
    follows={"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
    controls=("[SYS]", "[/SYS]", "[INST]", "[/INST]", "<s>", "</s>", "[ROLE]", "[/ROLE]", "[END]"),
)


class Machine:
    """Accepts turns in order; once a turn is refused the conversation stays refused."""

    def __init__(self, template: ChatTemplate):
        self.follows, self.state = template.follows, ""

    def accept(self, role: str) -> bool:
        if self.state is not None:
            self.state = role if role in self.follows.get(self.state, ()) else None
        return self.state is not None


class Writer:
    """Segments of a turn, from the template."""

    def __init__(self, template: ChatTemplate):
        self.template = template
        alternatives = "|".join(map(re.escape, template.controls))
        self.control = re.compile(rf"(?s)(?=(?:{alternatives}))(.)")

    def escape(self, text: str) -> str:
        return self.control.sub(rf"\1{re.escape(ESCAPE)}", text.replace(ESCAPE, ESCAPE * 2))

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        turn = self.template.turns.get(role)
        if turn is None:
            turn = self.template.other
            before = turn.before + self.escape(role) + self.template.after_role
        else:
            before = turn.before
        out = [(before, False), (self.escape(text), turn.loss), (turn.after, turn.loss_after)]
        return [s for s in out if s[0]]


class Reader:
    """Reads formatted text back, piece by piece as it comes, into turns; knows only the template."""

    def __init__(self, template: ChatTemplate):
        self.template = template
        self.starts = [(t.before, t.after, role) for role, t in template.turns.items()]
        self.starts.append((template.other.before, template.other.after, None))
        self.rest = ""

    def feed(self, piece: str) -> Iterator[tuple[str, str]]:
        self.rest += piece
        while True:
            for before, after, role in self.starts:
                if not self.rest.startswith(before):
                    continue
                end = self.rest.find(after, len(before))
                if end < 0:
                    return
                text = self.rest[len(before):end]
                if role is None:
                    role, _, text = text.partition(self.template.after_role)
                    role = undo(role)
                self.rest = self.rest[end + len(after):]
                yield role, undo(text)
                break
            else:
                return


def undo(text: str) -> str:
    """Doubled escape signs become one; single ones, which only break control strings, go."""
    return text if ESCAPE not in text else re.sub(r"\\(\\?)", r"\1", text)


_SEGMENTS = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))


def format_turns(df: DataFrame, template: ChatTemplate = INST, conv: str = "conv_id", turn: str = "turn",
                 role: str = "role", text: str = "text") -> DataFrame:
    """One row per turn: conv_id, turn, segments (text, loss) and in_order, in order within each task.

    All turns of a conversation are in one task, next to each other; other columns are left out.
    """
    narrow = df.select(F.col(f"`{conv}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"),
                       F.coalesce(f"`{role}`", F.lit("")).alias("role"), F.coalesce(f"`{text}`", F.lit("")).alias("text"))
    ordered = narrow.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    kinds = {f.name: f.dataType for f in narrow.schema.fields}
    schema = (T.StructType().add("conv_id", kinds["conv_id"]).add("turn", kinds["turn"])
              .add("segments", T.DataType.fromDDL("array<struct<text:string,loss:boolean>>")).add("in_order", "boolean"))

    def run(batches):
        writer, last, machine = Writer(template), object(), None
        for batch in batches:
            convs, roles, texts = (batch.column(i).to_pylist() for i in (0, 2, 3))
            segments, flags = [], []
            for c, r, t in zip(convs, roles, texts):
                if c != last:
                    last, machine = c, Machine(template)
                flags.append(machine.accept(r))
                segments.append([{"text": s, "loss": under} for s, under in writer.segments(r, t)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(segments, _SEGMENTS), pa.array(flags, pa.bool_())],
                names=["conv_id", "turn", "segments", "in_order"])

    return ordered.mapInArrow(run, schema)


class _Digest:
    """What a formatted conversation says, gathered while it streams by."""

    def __init__(self, template: ChatTemplate):
        self.reader = Reader(template)
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = 0
        self.in_order = True

    def add(self, segments, in_order: bool) -> None:
        for s in segments:
            self.formatted_chars += len(s["text"])
            if s["loss"]:
                plain = undo(s["text"])
                self.loss_chars += len(plain)
                self.loss.update(plain.encode())
            for role, text in self.reader.feed(s["text"]):
                self.n_turns += 1
                self.turns.update(f"{role}\n{text}\n".encode())
        self.in_order &= in_order

    def row(self, conv):
        if self.reader.rest:
            raise ValueError(f"conversation {conv}: the formatted text does not read back")
        return (conv, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(),
                self.formatted_chars, self.in_order)


def read_back(formatted: DataFrame, template: ChatTemplate = INST) -> DataFrame:
    """One row per conversation with what its formatted text holds, from ``format_turns`` output."""
    conv_type = formatted.schema["conv_id"].dataType
    schema = (T.StructType().add("conv_id", conv_type).add("n_turns", "long").add("turns_sha256", "string")
              .add("loss_chars", "long").add("loss_sha256", "string").add("formatted_chars", "long")
              .add("in_order", "boolean"))
    fields = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema.fields])

    def run(batches):
        last, digest, rows = object(), None, []

        def packed(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), fields)], schema=fields)

        for batch in batches:
            convs, segments, flags = (batch.column(i).to_pylist() for i in (0, 2, 3))
            for c, s, flag in zip(convs, segments, flags):
                if c != last:
                    if digest:
                        rows.append(digest.row(last))
                    last, digest = c, _Digest(template)
                digest.add(s, flag)
            if len(rows) >= 2000:
                yield packed(rows)
                rows = []
        if digest:
            rows.append(digest.row(last))
        if rows:
            yield packed(rows)

    return formatted.mapInArrow(run, schema)

"""Chat formatting: a state machine over roles, a declarative template, and a reader for what it wrote.

``format_turns`` turns rows (conversation, turn, role, text) into text segments in order.  Each segment says
whether a model is trained on it.  Control strings inside roles and texts are escaped, so the formatted text
can be read back exactly; ``digests`` does that.

Rows of a conversation are sorted by turn, then role and text (equal turns), nulls first.  A null text or role is
an empty one; a null conversation id is one conversation.  Conversations that break the turn order are formatted
all the same; the segment that breaks it and all later ones carry ``valid = false``.  Other columns are ignored.

A conversation's rows are sorted by Spark and stream through one task in Arrow batches.  What is kept between
batches is the role state and the digests, so memory doesn't depend on the length of a conversation.  A digest over
all turns of one conversation has to see them one after the other.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

START, BROKEN = "start", "broken"


@dataclass(frozen=True)
class Template:
    """Control strings, the roles that a model is trained on, and the moves of the state machine.

    The state after a row is the row's role.  ``moves`` lists which roles may follow a state.
    """

    turn: str = "<|turn|>"
    body: str = "<|body|>"
    close: str = "<|close|>"
    escape: str = "\\"
    trained: tuple[str, ...] = ("assistant",)
    moves: dict[str, tuple[str, ...]] = field(default_factory=lambda: {
        START: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})

    def __post_init__(self):
        heads = {c[:1] for c in self.controls}
        if len(self.escape) != 1 or any(len(c) < 2 or self.escape in c or heads & set(c[1:]) for c in self.controls):
            raise ValueError("a control string needs two characters, no escape, and its first character only in front")

    @property
    def controls(self) -> tuple[str, str, str]:
        return self.turn, self.body, self.close

    def follow(self, state: str, role: str) -> str:
        return role if role in self.moves.get(state, ()) else BROKEN

    def escaped(self, text: str) -> str:
        """Escapes are doubled, and each control string gets one behind its first character."""
        text = text.replace(self.escape, 2 * self.escape)
        for control in self.controls:
            text = text.replace(control, control[0] + self.escape + control[1:])
        return text

    def plain(self, text: str) -> str:
        """Undoes ``escaped``: of two escapes one stays, a single one goes."""
        return re.sub(re.escape(self.escape) + "(" + re.escape(self.escape) + "?)", lambda m: m.group(1), text)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """(text, trained) in order; empty texts keep their segment."""
        return [(self.turn + self.escaped(role) + self.body, False), (self.escaped(text), role in self.trained), (self.close, False)]


class Reader:
    """Reads formatted text that comes in pieces; gives the turns that have ended."""

    def __init__(self, template: Template):
        self.template, self.rest = template, ""
        self._turn = re.compile(
            re.escape(template.turn) + "(.*?)" + re.escape(template.body) + "(.*?)" + re.escape(template.close), re.S)

    def feed(self, piece: str) -> list[tuple[str, str]]:
        self.rest += piece
        if not piece.endswith(self.template.close):
            return []
        turns, at = [], 0
        for m in self._turn.finditer(self.rest):
            turns.append((self.template.plain(m.group(1)), self.template.plain(m.group(2))))
            at = m.end()
        self.rest = self.rest[at:]
        return turns


def format_turns(
    df: DataFrame, template: Template = Template(), *, conversation: str = "conv_id", turn: str = "turn", role: str = "role",
    text: str = "text",
) -> DataFrame:
    """``conversation``, ``segment`` (position), ``role``, ``text``, ``trained`` and ``valid``, one row per segment.

    All segments of a conversation lie one after the other in one partition.
    """
    rows = (
        df.select(F.col(conversation).alias("_conv"), F.col(turn).alias("_turn"), F.coalesce(F.col(role), F.lit("")).alias("_role"),
                  F.coalesce(F.col(text), F.lit("")).alias("_text"))
        .repartition("_conv").sortWithinPartitions("_conv", "_turn", "_role", "_text").select("_conv", "_role", "_text")
    )
    schema = T.StructType([
        T.StructField(conversation, df.schema[conversation].dataType), T.StructField("segment", T.LongType()),
        T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("trained", T.BooleanType()),
        T.StructField("valid", T.BooleanType()),
    ])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, at = object(), START, 0
        for batch in batches:
            out = [[] for _ in arrow]
            for conv, who, what in zip(*[c.to_pylist() for c in batch.columns]):
                if conv != now:
                    now, state, at = conv, START, 0
                state = BROKEN if state == BROKEN else template.follow(state, who)
                for piece, trained in template.segments(who, what):
                    for column, value in zip(out, (conv, at, who, piece, trained, state != BROKEN)):
                        column.append(value)
                    at += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(out, arrow)], schema=arrow)

    return rows.mapInArrow(run, schema)


class _Digest:
    def __init__(self, template: Template):
        self.template, self.reader = template, Reader(template)
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0
        self.valid = True

    def add(self, text: str, trained: bool, valid: bool) -> None:
        self.chars += len(text)
        self.valid = self.valid and valid
        if trained:
            plain = self.template.plain(text)
            self.loss_chars += len(plain)
            self.loss.update(plain.encode("utf-8", "replace"))
        for role, body in self.reader.feed(text):
            self.n_turns += 1
            self.turns.update(f"{role}\n{body}\n".encode("utf-8", "replace"))

    def row(self) -> tuple:
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.valid


def digests(segments: DataFrame, template: Template = Template(), *, conversation: str = "conv_id") -> DataFrame:
    """Per conversation what a reader finds in the output of ``format_turns``, whose order of rows it relies on.

    ``n_turns`` and ``turns_sha256`` (of role, line feed, text, line feed per turn), ``loss_chars`` and
    ``loss_sha256`` (of the trained texts, unescaped), ``formatted_chars`` and ``valid``.
    """
    schema = T.StructType([
        T.StructField(conversation, segments.schema[conversation].dataType), T.StructField("n_turns", T.LongType()),
        T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()),
        T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType()),
        T.StructField("valid", T.BooleanType()),
    ])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None

        def packed(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), arrow)], schema=arrow)

        for batch in batches:
            done = []
            for conv, text, trained, valid in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                if digest is None or conv != now:
                    if digest is not None:
                        done.append((now, *digest.row()))
                    now, digest = conv, _Digest(template)
                digest.add(text, trained, valid)
            if done:
                yield packed(done)
        if digest is not None:
            yield packed([(now, *digest.row())])

    return segments.select(conversation, "text", "trained", "valid").mapInArrow(run, schema)

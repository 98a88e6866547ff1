"""Chat formatting by a finite-state machine over roles and a declarative template.

The template gives each role's text before and after a turn, and whether its turns bear loss; the
machine says which role may follow which.  Control strings inside texts are escaped reversibly.
Turns stream through sorted partitions, one row a segment, so a conversation of any length needs
the memory of one turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import col, sliced, tasks_for


@dataclass(frozen=True)
class Template:
    """``turns``: role -> (text before, text after, bears loss); ``machine``: state -> roles that may follow.

    A state is the role of the last turn ("" at the start); a conversation may end in ``final`` states.
    Roles without an entry of their own use "other", with their name after the mark ``name``.
    """

    turns: dict[str, tuple[str, str, bool]] = field(
        default_factory=lambda: {
            "system": ("<s><<SYS>>", "<</SYS>>", False),
            "user": ("<s>[INST]", "[/INST]", False),
            "assistant": ("<s>[ANS]", "</s>", True),
            "other": ("<s>[ROLE]", "[/ROLE]", False),
        }
    )
    name: str = "[NAME]"
    machine: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    final: tuple[str, ...] = ("assistant",)
    escape: str = "\\"

    def controls(self) -> list[str]:
        return sorted({x for before, after, _ in self.turns.values() for x in (before, after)} | {self.name, "<s>"} - {""}, key=len, reverse=True)

    def _marks(self) -> re.Pattern:
        return re.compile("|".join(map(re.escape, [self.escape, *self.controls()])))

    def escaped(self, text: str) -> str:
        """The escape character goes before each control string's first character, and before itself."""
        return self._marks().sub(lambda m: self.escape + m[0][0] + self.escape + "|" + m[0][1:] if m[0] != self.escape else self.escape * 2, text)

    def plain(self, text: str) -> str:
        e = re.escape(self.escape)
        return re.sub(rf"{e}{e}|{e}(.){e}\|", lambda m: m[1] if m[1] is not None else self.escape, text, flags=re.S)


def _segments(template: Template):
    """Sorted turns to segments (conv, turn number, part, text, loss, valid so far)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, number, valid = object(), "", 0, True
        for batch in batches:
            rows = []
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if conv != last:
                    last, state, number, valid = conv, "", 0, True
                role = role or ""
                valid = valid and role in template.machine.get(state, ())
                known = role in template.turns and role != "other"
                before, after, loss = template.turns[role if known else "other"]
                if not known:
                    before += template.escaped(role) + template.name
                for part, (piece, bears) in enumerate(((before, False), (template.escaped(text or ""), loss), (after, False))):
                    rows.append((conv, number, part, piece, bears, valid and (role in template.final)))
                state, number = role, number + 1
            columns = list(zip(*rows)) if rows else [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["conv_id", "number", "part", "text", "loss", "valid"])

    return run


def format_conversations(turns: DataFrame, template: Template = Template(), conv_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    """(conv_id, number, part, text, loss, valid): the segments whose texts, in this order, are the output.

    Turns go by ``turn``, then role and text (rows with equal turns or repeated rows are each a
    turn).  ``valid`` at a conversation's last turn tells whether the machine accepts it; what it
    does not accept is formatted all the same.  A null text is empty, a null role is the role "", and
    rows with a null conversation are one conversation.  Partitions come sorted; other columns are ignored.
    """
    rows = turns.select(col(conv_column).cast("long").alias("conv"), col(role_column).cast("string").alias("role"), col(text_column).cast("string").alias("text"), col(turn_column).cast("long").alias("turn"))
    ordered = rows.repartition(tasks_for(rows, "text"), "conv").sortWithinPartitions("conv", "turn", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    return ordered.select("conv", "role", "text").mapInArrow(sliced(_segments(template)), "conv_id long, number long, part int, text string, loss boolean, valid boolean")


class Parser:
    """Reads a conversation's formatted text back, piece by piece, by the template alone."""

    def __init__(self, template: Template):
        self.template, self.buffer, self.turn = template, "", None
        self.opening = sorted(((before, role) for role, (before, _, _) in template.turns.items()), key=lambda x: -len(x[0]))

    def feed(self, piece: str) -> Iterator[tuple[str, str, bool]]:
        """(role, text, bears loss) of each turn that the piece completes."""
        self.buffer += piece
        while self.buffer:
            if self.turn is None:
                found = next(((before, role) for before, role in self.opening if self.buffer.startswith(before)), None)
                if found is None:
                    if any(before.startswith(self.buffer) for before, _ in self.opening):
                        return
                    raise ValueError("no turn begins here")
                self.buffer, self.turn = self.buffer[len(found[0]) :], found[1]
            after, loss = self.template.turns[self.turn][1:]
            end = self.buffer.find(after)
            if end < 0:
                return
            inner, self.buffer = self.buffer[:end], self.buffer[end + len(after) :]
            role, self.turn = self.turn, None
            if role == "other":
                role, _, inner = inner.partition(self.template.name)
                role = self.template.plain(role)
            yield role, self.template.plain(inner), loss


def _digests(template: Template):
    """Formatted segments, sorted, to a row a conversation, read back by the parser."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        done: list[tuple] = []

        def finish():
            if state is not None:
                if state["parser"].buffer or state["parser"].turn is not None:
                    raise ValueError(f"conversation {state['conv']} has an unfinished turn")
                done.append((state["conv"], state["n"], state["turns"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["all"], state["valid"]))

        def out():
            columns = list(zip(*done)) if done else [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"])

        for batch in batches:
            for conv, number, part, text, loss, valid in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if number == 0 and part == 0:
                    finish()
                    state = {"conv": conv, "parser": Parser(template), "n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "chars": 0, "all": 0, "valid": False}
                state["all"] += len(text)
                state["valid"] = valid
                if loss:
                    piece = template.plain(text)
                    state["chars"] += len(piece)
                    state["loss"].update(piece.encode())
                for role, inner, _ in state["parser"].feed(text):
                    state["n"] += 1
                    state["turns"].update(f"{role}\n{inner}\n".encode())
            if done:
                yield out()
        finish()
        if done:
            yield out()

    return run


def digests(segments: DataFrame, template: Template = Template()) -> DataFrame:
    """A row per conversation of ``format_conversations``'s output, in its own order, read back from it."""
    return segments.mapInArrow(sliced(_digests(template)), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")

"""Chat formatting: conversations as one marked text with loss flags, in DataFrame functions only.

A template is data: the marks around a turn, which roles are trained on, and the transitions of a
finite-state machine over roles. The machine reads the roles of a conversation in order; a conversation is
valid if every role has a transition and the last state is a final one. Every turn gives three segments (head,
body, tail); a body of a trained role carries the loss flag, marks never do. Nothing is left out: a
conversation the machine rejects is formatted too and says at which turn it failed.

All marks begin with the two characters of ``guard``. Inside bodies and roles a backslash goes between these two,
after any backslashes that stand there already, so a mark never occurs inside a text and taking
one backslash out gives the text back. Line ends in roles become ``%0A``, and their ``%`` becomes ``%25``.

Cases: a null text or role is empty (no machine takes an empty role); rows are ordered by turn, nulls first, then
by role and text; repeated rows are turns of their own; rows without conv_id are one conversation; texts of any
length are formatted whole, and a conversation is one row, at most as long as the longest string; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks, trained roles and the machine: state -> role -> next state."""

    head: str = "<|im_start|>"
    tail: str = "<|im_end|>\n"
    guard: str = "<|"
    trained: tuple[str, ...] = ("assistant",)
    start: str = "start"
    final: tuple[str, ...] = ("assistant",)
    moves: dict[str, dict[str, str]] = field(default_factory=lambda: {
        "start": {"system": "system", "user": "user"},
        "system": {"user": "user"},
        "user": {"assistant": "assistant"},
        "assistant": {"user": "user"},
    })

    def __post_init__(self):
        if len(self.guard) != 2 or self.guard[0] == self.guard[1] or not all(m.startswith(self.guard) and m.count(self.guard) == 1 for m in (self.head, self.tail)):
            raise ValueError("every mark must begin with the two different characters of the guard, and hold them once")
        if "\\" in self.head + self.tail or "\n" in self.head or any(">" in state or not state for state in self.moves):
            raise ValueError("marks have no backslash, heads no line end and states a name without '>'")


CHATML = Template()


def escaped(text: Column, template: Template) -> Column:
    a, b = map(re.escape, template.guard)
    return F.regexp_replace(text, rf"{a}(\\*){b}", rf"{_plain(template.guard[0])}\\$1{_plain(template.guard[1])}")


def unescaped(text: Column, template: Template) -> Column:
    a, b = map(re.escape, template.guard)
    return F.regexp_replace(text, rf"{a}\\(\\*){b}", rf"{_plain(template.guard[0])}$1{_plain(template.guard[1])}")


def _plain(c: str) -> str:
    """A character as it must stand in a replacement."""
    return "\\" + c if c in "\\$" else c


def _role_line(role: Column, template: Template) -> Column:
    return escaped(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), template)


def _role_of(line: Column, template: Template) -> Column:
    return F.replace(F.replace(unescaped(line, template), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def _machine(roles: Column, template: Template) -> Column:
    """(state, at, bad): the last state, turns read, and the first turn that has no transition."""
    table = F.create_map(*[F.lit(x) for state, moves in template.moves.items() for role, to in moves.items() for x in (f"{state}>{role}", to)])
    begin = F.struct(F.lit(template.start).alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("bad"))

    def step(now: Column, role: Column) -> Column:
        to = F.coalesce(F.try_element_at(table, F.concat(now["state"], F.lit(">"), role)), F.lit(""))  # no state has the empty name
        return F.struct(to.alias("state"), (now["at"] + 1).alias("at"), F.coalesce(now["bad"], F.when(to == "", now["at"])).alias("bad"))

    return F.aggregate(roles, begin, step)


def format_chats(turns: DataFrame, template: Template = CHATML) -> DataFrame:
    """conv_id, segments, valid, bad_turn of every conversation of (conv_id, turn, role, text).

    segments: array of (kind, text, loss); the texts one after the other are the formatted conversation.
    bad_turn: place of the first turn the machine does not take, null if it takes all.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.select("conv_id", F.struct(F.col("turn").alias("turn"), role.alias("role"), escaped(text, template).alias("body")).alias("t"))
    ordered = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))

    def segments(t: Column) -> Column:
        head = F.concat(F.lit(template.head), _role_line(t["role"], template), F.lit("\n"))
        kinds = (("head", head, F.lit(False)), ("body", t["body"], t["role"].isin(*template.trained)), ("tail", F.lit(template.tail), F.lit(False)))
        return F.array(*[F.struct(F.lit(kind).alias("kind"), x.alias("text"), loss.alias("loss")) for kind, x, loss in kinds])

    ran = ordered.select(
        "conv_id", F.flatten(F.transform("ts", segments)).alias("segments"), _machine(F.transform("ts", lambda t: t["role"]), template).alias("m"))
    return ran.select(
        "conv_id", "segments", (F.col("m.bad").isNull() & F.col("m.state").isin(*template.final)).alias("valid"), F.col("m.bad").alias("bad_turn"))


def formatted(chats: DataFrame) -> DataFrame:
    """The conversations with their whole text as ``formatted``."""
    return chats.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_back(text: Column, template: Template = CHATML) -> Column:
    """Array of (role, text): the turns of a formatted conversation as they went in."""
    blocks = F.split(text, rf"\Q{template.tail}\E")
    whole = F.slice(blocks, 1, F.greatest(F.size(blocks) - 1, F.lit(0)))

    def turn(block: Column) -> Column:
        line = F.substring_index(block, "\n", 1)
        return F.struct(
            _role_of(F.substr(line, F.lit(len(template.head) + 1)), template).alias("role"),
            unescaped(F.substr(block, F.char_length(line) + 2), template).alias("text"))

    return F.transform(whole, turn)


def loss_text(segments: Column, template: Template = CHATML) -> Column:
    """All text under the loss flag, as it went in."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"], template)), "")


def chat_digests(turns: DataFrame, template: Template = CHATML) -> DataFrame:
    """Digests of every conversation, read back from its formatted text and its segments."""
    rows = formatted(format_chats(turns, template)).select(
        "conv_id", "valid", "bad_turn", F.char_length("formatted").cast("long").alias("formatted_chars"),
        read_back(F.col("formatted"), template).alias("turns"), loss_text(F.col("segments"), template).alias("trained"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return rows.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("trained").cast("long").alias("loss_chars"), F.sha2(F.col("trained").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars", "valid", "bad_turn")

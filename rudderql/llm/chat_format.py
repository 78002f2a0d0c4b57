"""Chat formatting from a declarative template.

A finite-state machine over roles (a transition table folded over the turns)
validates turn order. Each turn gives three segments, header, text and footer,
with a loss flag each. Texts escape the template's control strings: the escape
character is doubled and the first character of every control string becomes
escape + code, so no control string can appear in a text and parsing the
output gives back every turn.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let


@dataclass(frozen=True)
class Template:
    """Header is ``open`` + label + ``colon``, then the escaped text, then ``close``."""

    labels: dict = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    open: str = "### "
    colon: str = ": "
    close: str = "</turn>\n"
    #: Control string -> code of its first character. No code may start with the escape character.
    controls: dict = field(default_factory=lambda: {"###": "h", "</turn>": "l"})
    escape: str = "\\"
    loss_roles: tuple = ("assistant",)
    #: state -> {role: next state}; a conversation must end in one of ``final``.
    transitions: dict = field(default_factory=lambda: {"start": {"system": "system", "user": "user"}, "system": {"user": "user"}, "user": {"assistant": "assistant"}, "assistant": {"user": "user"}})
    final: tuple = ("assistant",)


CHAT = Template()


def escaped(s: Column, t: Template = CHAT) -> Column:
    s = F.replace(s, F.lit(t.escape), F.lit(t.escape * 2))
    for control, code in t.controls.items():
        s = F.regexp_replace(s, f"{re.escape(control[0])}(?={re.escape(control[1:])})", (t.escape + code).replace("\\", "\\\\"))
    return s


def unescaped(s: Column, t: Template = CHAT) -> Column:
    def piece(x: Column) -> Column:
        for control, code in t.controls.items():
            x = F.replace(x, F.lit(t.escape + code), F.lit(control[0]))
        return x

    # Cut at doubled escapes first: what is left of an escape in a piece begins a code.
    return F.array_join(F.transform(F.split(s, re.escape(t.escape * 2), -1), piece), t.escape)


def _label(role: Column, t: Template) -> Column:
    """A known role's label; another role's own name, escaped and without the colon, after an equals sign."""
    known = F.create_map(*[F.lit(x) for pair in t.labels.items() for x in pair])
    other = F.concat(F.lit("="), F.replace(F.replace(escaped(role, t), F.lit(":"), F.lit(t.escape + "c")), F.lit("\n"), F.lit(t.escape + "n")))
    return F.coalesce(F.try_element_at(known, role), other)


def _role(label: Column, t: Template) -> Column:
    known = F.create_map(*[F.lit(x) for role, name in t.labels.items() for x in (name, role)])
    def piece(x: Column) -> Column:
        x = F.replace(F.replace(x, F.lit(t.escape + "c"), F.lit(":")), F.lit(t.escape + "n"), F.lit("\n"))
        for control, code in t.controls.items():
            x = F.replace(x, F.lit(t.escape + code), F.lit(control[0]))
        return x
    own = F.array_join(F.transform(F.split(F.substring(label, 2, 1 << 30), re.escape(t.escape * 2), -1), piece), t.escape)
    return F.when(F.substring(label, 1, 1) == "=", own).otherwise(F.try_element_at(known, label))


def chat_format(conversations: DataFrame, t: Template = CHAT) -> DataFrame:
    """conv_id, n_turns, valid, bad_turn, segments, formatted: one row per conversation.

    Turns are in order of turn (null first), then role, then text; repeated
    rows are turns of their own. A null role is an empty role, a null text an
    empty text, a null conv_id is one conversation of its own. ``valid``: the
    machine accepts the roles; ``bad_turn``: place of the first turn that it
    refuses, n_turns if just the end is wrong, else null. Invalid
    conversations are formatted all the same. segments: array of (text, loss).
    Empty table: empty result. Other columns are ignored.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    conv = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    table = F.create_map(*[F.lit(x) for state, by in t.transitions.items() for role, then in by.items() for x in (f"{state}\n{role}", then)])
    start = F.struct(F.lit("start").alias("state"), F.lit(0).cast("long").alias("i"), F.lit(None).cast("long").alias("bad"))

    def step(s: Column, x: Column) -> Column:
        then = F.try_element_at(table, F.concat(s["state"], F.lit("\n"), x["role"]))
        return F.struct(F.coalesce(then, F.lit("refused")).alias("state"), (s["i"] + 1).alias("i"), F.coalesce(s["bad"], F.when(then.isNull(), s["i"])).alias("bad"))

    def segments(x: Column) -> Column:
        head = F.concat(F.lit(t.open), _label(x["role"], t), F.lit(t.colon))
        parts = [(head, F.lit(False)), (escaped(x["text"], t), x["role"].isin(*t.loss_roles)), (F.lit(t.close), F.lit(False))]
        return F.array(*[F.struct(text.alias("text"), loss.alias("loss")) for text, loss in parts])

    run = conv.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.aggregate("turns", start, step).alias("m"), F.flatten(F.transform("turns", segments)).alias("segments"))
    ended = F.col("m.state").isin(*t.final)
    return run.select("conv_id", "n_turns", ended.alias("valid"), F.when(~ended, F.coalesce("m.bad", "n_turns")).alias("bad_turn"), "segments", F.array_join(F.transform("segments", lambda x: x["text"]), "").alias("formatted"))


def read_back(formatted: Column, t: Template = CHAT) -> Column:
    """The turns (role, text) that a formatted conversation says."""
    turns = F.split(formatted, re.escape(t.close), -1)

    def one(x: Column) -> Column:
        body = F.substring(x, len(t.open) + 1, 1 << 30)
        return let(F.instr(body, t.colon), lambda at: F.struct(_role(F.substring(body, F.lit(1), at - 1), t).alias("role"), unescaped(F.substring(body, at + len(t.colon), F.lit(1 << 30)), t).alias("text")))

    return F.transform(F.filter(turns, lambda x: x != ""), one)

"""Chat formatting: a finite-state machine over roles and a declarative template with loss flags."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Template:
    """Marks around role and text of a turn, control strings to escape, roles under the loss mask.

    ``moves`` are the legal steps of the role machine: state and role to the next state; a conversation
    must end in one of ``final``.  Every control string starts with a character that is no backslash.
    """

    turn: str = "<|turn|>"
    body: str = "<|text|>"
    end: str = "<|end|>"
    control: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    moves: tuple[tuple[str, str, str], ...] = (
        ("start", "system", "primed"), ("start", "user", "asked"), ("primed", "user", "asked"),
        ("asked", "assistant", "answered"), ("answered", "user", "asked"),
    )
    final: tuple[str, ...] = ("answered",)

    def escape(self, text: Column) -> Column:
        """Double each backslash, then put one behind the first character of each control string."""
        text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
        for s in (self.turn, self.body, self.end, *self.control):
            text = F.replace(text, F.lit(s), F.lit(s[0] + "\\" + s[1:]))
        return text

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, r"(?s)\\(.)", "$1")

    def step(self, state: Column, role: Column) -> Column:
        out = F.lit("invalid")
        for now, seen, then in self.moves:
            out = F.when((state == now) & (role == seen), then).otherwise(out)
        return out


def format_chats(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per conversation: ``conv_id, valid, segments, formatted``.

    Turns are put in order of turn, role and text (nulls first; a null role or text counts as empty, a
    null conv_id is one conversation).  The role machine runs over them; a conversation with an illegal
    order is still formatted and has ``valid`` false.  ``segments`` are ``(text, loss)``: the marks, and
    the escaped text, whose loss flag is set for the template's loss roles; ``formatted`` is their
    concatenation.  Repeated rows are turns of their own, extra columns are dropped, no rows give none.
    A conversation is one training text, so its turns meet in one row; rows of many conversations never do.
    """
    row = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("turns"))
    end = F.aggregate("turns", F.lit(template.start), lambda state, t: template.step(state, t["role"]))

    def segments(t: Column) -> Column:
        head = F.concat(F.lit(template.turn), template.escape(t["role"]), F.lit(template.body))
        return F.array(
            F.struct(head.alias("text"), F.lit(False).alias("loss")),
            F.struct(template.escape(t["text"]).alias("text"), t["role"].isin(*template.loss_roles).alias("loss")),
            F.struct(F.lit(template.end).alias("text"), F.lit(False).alias("loss")))

    chats = chats.select("conv_id", end.isin(*template.final).alias("valid"),
                         F.flatten(F.transform("turns", segments)).alias("segments"))
    return chats.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_turns(formatted: Column, template: Template = Template()) -> Column:
    """Turns ``(role, text)`` parsed from formatted text; the marks cannot occur inside escaped texts."""
    parts = F.split(formatted, re.escape(template.end))
    parts = F.filter(parts, lambda p: p.startswith(template.turn))
    n, mark = len(template.turn), template.body

    def turn(p: Column) -> Column:
        at = F.instr(p, mark)
        return F.struct(
            template.unescape(F.substring(p, F.lit(n + 1), at - (n + 1))).alias("role"),
            template.unescape(F.substring(p, at + len(mark), F.length(p))).alias("text"))

    return F.transform(parts, turn)


def loss_text(segments: Column, template: Template = Template()) -> Column:
    """All text under the loss mask, unescaped segment by segment, in order."""
    kept = F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: template.unescape(s["text"]))
    return F.array_join(kept, "")

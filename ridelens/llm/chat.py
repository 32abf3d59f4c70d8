"""Chat formatting with a declarative template; DataFrame functions only.

Texts are escaped row by row before anything is gathered. A conversation is one output row, so its
turns meet in one row by definition; nothing else is gathered.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridelens.llm.base import register, table


@dataclass(frozen=True)
class Template:
    """What stands around each role's text, which roles are learned, and which order of roles is allowed.

    A role without marks of its own is written as `other[0] role other[1] text other[2]`.
    """

    marks: dict[str, tuple[str, str]] = field(default_factory=lambda: {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")})
    other: tuple[str, str, str] = ("[ROLE]", "[/ROLE]", "[/TURN]")
    learned: tuple[str, ...] = ("assistant",)
    moves: dict[str, dict[str, str]] = field(default_factory=lambda: {"start": {"system": "system", "user": "user"}, "system": {"user": "user"}, "user": {"assistant": "assistant"}, "assistant": {"user": "user"}})
    accept: tuple[str, ...] = ("assistant",)

    def __post_init__(self) -> None:
        controls = self.controls()
        if len(set(controls)) < len(controls) or any(len(c) < 2 or "\\" in c for c in controls):
            raise ValueError("control strings must differ, have two characters at least and no backslash")
        firsts = {c[0] for c in controls}
        if any(set(c[1:]) & firsts for c in controls):
            raise ValueError("no control string may contain the first character of one after its start")

    def controls(self) -> list[str]:
        return [m for pair in self.marks.values() for m in pair] + list(self.other)

    def _after_first(self, slashes: str) -> str:
        """Pattern of the first character of a control string, seen with `slashes` and the rest behind it."""
        by: dict[str, list[str]] = {}
        for c in self.controls():
            by.setdefault(c[0], []).append(re.escape(c[1:]))
        return "|".join(f"{re.escape(c)}(?={slashes}(?:{'|'.join(rest)}))" for c, rest in by.items())

    def escape(self, text: Column) -> Column:
        """One backslash after the first character of whatever is, or looks like an escaped, control string."""
        return F.regexp_replace(text, f"(?:{self._after_first(r'\\*')})", r"$0\\")

    def unescape(self, text: Column) -> Column:
        by = "|".join(f"(?<={re.escape(c)})\\\\(?=\\\\*(?:{'|'.join(re.escape(x[1:]) for x in self.controls() if x[0] == c)}))" for c in dict.fromkeys(x[0] for x in self.controls()))
        return F.regexp_replace(text, by, "")

    def turn_pattern(self) -> str:
        pairs = [*self.marks.values(), (self.other[0], self.other[2])]
        return "(?s)" + "|".join(f"{re.escape(a)}.*?{re.escape(b)}" for a, b in pairs)


def _per_role(role: Column, template: Template, value, other: Column) -> Column:
    out = None
    for name in template.marks:
        out = F.when(role == name, value(name)) if out is None else out.when(role == name, value(name))
    return out.otherwise(other) if out is not None else other


def format_chats(turns: DataFrame, template: Template = Template(), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_col, n_turns, segments (array of text, loss, marks first and last), formatted, end_state, valid.

    `segments` joined give `formatted`; `loss` is true exactly on the escaped texts of learned roles. The
    machine walks the roles by `template.moves`; an unknown move leads to `bad` for good, and `valid` says
    whether it ends in an accepted state. Invalid conversations are formatted too. Turns are in the order
    of `turn_col` (nulls first), ties by role and text; null role and text count as empty; rows without a
    conversation id form one of their own. Other columns are ignored.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    opening = _per_role(role, template, lambda r: F.lit(template.marks[r][0]), F.concat(F.lit(template.other[0]), template.escape(role), F.lit(template.other[1])))
    closing = _per_role(role, template, lambda r: F.lit(template.marks[r][1]), F.lit(template.other[2]))
    row = F.struct(F.col(turn_col).alias("turn"), role.alias("role"), text.alias("raw"), opening.alias("opening"), template.escape(text).alias("text"), closing.alias("closing"), role.isin(*template.learned).alias("loss"))
    chats = turns.select(F.col(conv_col).alias("__conv"), row.alias("__row")).groupBy("__conv").agg(F.sort_array(F.collect_list("__row")).alias("__rows"))
    moves = F.create_map(*[F.lit(x) for s, to in template.moves.items() for r, t in to.items() for x in (f"{s}\n{r}", t)])
    plain = lambda c: F.struct(c.alias("text"), F.lit(False).alias("loss"))
    chats = chats.select(
        "__conv", F.size("__rows").cast("long").alias("n_turns"),
        F.flatten(F.transform("__rows", lambda t: F.array(plain(t["opening"]), F.struct(t["text"].alias("text"), t["loss"].alias("loss")), plain(t["closing"])))).alias("segments"),
        F.aggregate("__rows", F.lit("start"), lambda s, t: F.coalesce(F.try_element_at(moves, F.concat_ws("\n", s, t["role"])), F.lit("bad"))).alias("end_state"),
    )
    return chats.select(
        F.col("__conv").alias(conv_col), "n_turns", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        "end_state", F.col("end_state").isin(*template.accept).alias("valid"),
    )


def read_turns(formatted: Column, template: Template = Template()) -> Column:
    """Array of (role, text) read from a formatted conversation."""

    def turn(block: Column) -> Column:
        def inner(a: str, b: str) -> Column:
            return F.substring(block, F.lit(len(a) + 1), F.length(block) - len(a) - len(b))

        head, mid, tail = template.other
        free = inner(head, tail)
        at = F.instr(free, mid)
        role, text = F.substring(free, F.lit(1), at - 1), F.substring(free, at + len(mid), F.length(free))
        for name, (a, b) in template.marks.items():
            mine = F.startswith(block, F.lit(a))
            role, text = F.when(mine, F.lit(name)).otherwise(role), F.when(mine, inner(a, b)).otherwise(text)
        return F.struct(template.unescape(role).alias("role"), template.unescape(text).alias("text"))

    return F.transform(F.regexp_extract_all(formatted, F.lit(template.turn_pattern()), F.lit(0)), turn)


def learned_text(segments: Column, template: Template = Template()) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: template.unescape(s["text"])), "")


def _sql(template: Template) -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    esc = "coalesce({}, '')"
    for c in dict.fromkeys(x[0] for x in template.controls()):
        rest = "|".join(re.escape(x[1:]) for x in template.controls() if x[0] == c)
        esc = f"regexp_replace({esc}, {q(f'({re.escape(c)})([\\\\]*(?:{rest}))')}, {q(r'\1\\\2')}, 'g')"
    marks = " ".join(f"when {q(r)} then {len(a) + len(b)}" for r, (a, b) in template.marks.items())
    other = f"{sum(map(len, template.other))} + length({esc.format('role')})"
    learned = ", ".join(map(q, template.learned))
    return f"""
    with t as (select conv_id, turn, role, text from conversations union all
               select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
    s as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text,
                 length({esc.format('text')}) + case coalesce(role, '') {marks} else {other} end as width from t),
    g as (select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text) as turns,
                 coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role in ({learned})), '') as learned, sum(width)::bigint as formatted_chars
          from s group by conv_id)
    select conv_id, n_turns, sha256(turns) as turns_sha256, length(learned) as loss_chars, sha256(learned) as loss_sha256, formatted_chars from g
    """


@register("op5_chat_format", _sql(Template()))
def op5_chat_format(spark, sf_dir):
    template = Template()
    planted = spark.sql(r"select -7L as conv_id, t.turn, t.role, t.text from values (0L, 'user', '</s>[INST] ok [/INST]'), (1L, 'assistant', '</s>[INST] ok [/INST]') as t(turn, role, text)")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    chats = format_chats(turns, template)
    read = chats.select("conv_id", read_turns(F.col("formatted"), template).alias("turns"), learned_text(F.col("segments"), template).alias("learned"), F.length("formatted").cast("long").alias("formatted_chars"))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), "formatted_chars",
    )

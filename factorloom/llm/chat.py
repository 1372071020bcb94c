"""Chat formatting: a finite-state machine over roles and a declarative template, in DataFrame functions only.

Turns are taken in order of their number (null first; ties by role and text). They are dealt into blocks of
consecutive turn numbers: a block yields its formatted segments and, for the machine, the function from the
state before it to the state after it. Functions compose, so a conversation is put together from one row for
each block, and only a block is sorted turn by turn.

Very long texts are escaped and formatted whole.

Cases: a null role or text counts as empty; an unknown role leads to the error state and is formatted like any
other; repeated rows are turns of their own; rows of a null conv_id form one conversation. An empty table gives
an empty table. Extra columns are left out.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ERROR = "error"


@dataclass(frozen=True)
class Template:
    """How turns are marked, which roles' texts carry loss, and which role may follow which state.

    A state is the last role; "" is the start. A conversation is valid if it ends in an accepting state.
    """

    open: str = "<|im_start|>"
    after_role: str = "\n"
    close: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user", "tool"), "tool": ("assistant", "tool")})
    accepting: tuple[str, ...] = ("assistant",)

    @property
    def states(self) -> list[str]:
        return [*self.follows, ERROR]


CHATML = Template()
#: Turn numbers in a block: consecutive numbers, so a block is a stretch of the conversation.
BLOCK_TURNS = 64


def escape(text: Column, also: str = "") -> Column:
    """A backslash before each backslash, and before a bar that follows "<": no control string can then occur."""
    return F.regexp_replace(text, rf"(\\|(?<=<)\|{also})", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _segments(turn: Column, t: Template) -> Column:
    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    head = F.concat(F.lit(t.open), escape(turn["role"], r"|\n"), F.lit(t.after_role))
    return F.array(segment(head, F.lit(False)), segment(escape(turn["text"]), turn["role"].isin(*t.loss_roles)), segment(F.lit(t.close), F.lit(False)))


def _machine(turns: Column, t: Template) -> Column:
    """For each state before these turns, the state after them (as numbers)."""
    states = t.states
    fail = len(states) - 1
    roles = [s for s in states[:-1] if s]
    to = F.array(*(F.array(*(F.lit(states.index(r) if r in t.follows.get(s, ()) else fail) for r in roles), F.lit(fail)) for s in states))
    seen = F.array(*map(F.lit, roles))

    def step(now: Column, turn: Column) -> Column:
        at = F.array_position(seen, turn["role"]).cast("int")
        column = F.when(at == 0, len(roles)).otherwise(at - 1)
        return F.transform(now, lambda s: F.get(F.get(to, s), column))

    return F.aggregate(turns, F.array(*map(F.lit, range(len(states)))), step)


def format_conversations(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", template: Template = CHATML) -> DataFrame:
    """A row for each conversation: conv_id (by its own name), n_turns, valid, end_state, formatted, segments (array of text, loss)."""
    t = template
    rows = df.select(F.col(conv_col).alias("conv"), F.floor(F.col(turn_col) / BLOCK_TURNS).alias("block"), F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("t"))
    blocks = rows.groupBy("conv", "block").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    blocks = blocks.select("conv", F.struct("block", F.size("turns").alias("n"), _machine(F.col("turns"), t).alias("to"), F.flatten(F.transform("turns", lambda x: _segments(x, t))).alias("segments")).alias("b"))
    whole = blocks.groupBy("conv").agg(F.sort_array(F.collect_list("b")).alias("b"))
    state = F.aggregate("b", F.lit(0), lambda s, b: F.get(b["to"], s))
    n = F.aggregate("b", F.lit(0).cast("bigint"), lambda a, b: a + b["n"])
    segments = F.flatten(F.transform("b", lambda b: b["segments"]))
    out = whole.select("conv", n.alias("n_turns"), F.get(F.array(*map(F.lit, t.states)), state).alias("end_state"), segments.alias("segments"))
    formatted = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    return out.select(F.col("conv").alias(conv_col), "n_turns", F.col("end_state").isin(*t.accepting).alias("valid"), "end_state", formatted.alias("formatted"), "segments")


def _literal(text: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c not in "\n<>_" else c for c in text)


def read_back(formatted: Column, template: Template = CHATML) -> Column:
    """The turns of a formatted conversation: an array of (role, text), unescaped."""
    parts = F.split(formatted, _literal(template.close), -1)
    whole = rf"(?s)^{_literal(template.open)}((?:[^\\\n]++|\\.)*+){_literal(template.after_role)}(.*)$"
    # What follows the last close is empty.
    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: F.struct(unescape(F.regexp_extract(p, whole, 1)).alias("role"), unescape(F.regexp_extract(p, whole, 2)).alias("text")))


def loss_read_back(turns: Column, template: Template = CHATML) -> Column:
    """All text under the loss mask of turns that were read back: the texts of the template's loss roles."""
    return F.array_join(F.transform(F.filter(turns, lambda t: t["role"].isin(*template.loss_roles)), lambda t: t["text"]), "")


def loss_text(segments: Column) -> Column:
    """All text under the loss mask of segments, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")

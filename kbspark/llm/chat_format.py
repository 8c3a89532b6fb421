"""Chat formatting: a declarative template, a finite-state machine over roles, and texts that can be read back."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """What stands before and after a turn of each role, which roles are learned, and which role may follow which.

    controls: strings with a meaning in the output; inside texts their first character is escaped. Every mark begins
    or ends with one of them. Roles without marks get other_open, with the role in hex, and other_close.
    """

    marks: dict[str, tuple[str, str]] = field(default_factory=lambda: {"system": ("<<SYS>>\n", "\n<</SYS>>"), "user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>")})
    other_open: tuple[str, str] = ("<<TURN ", ">>")
    other_close: str = "<</TURN>>"
    controls: tuple[str, ...] = ("<<SYS>>", "<</SYS>>", "<<TURN ", "<</TURN>>", "<s>", "</s>", "[INST]", "[/INST]")
    learned: tuple[str, ...] = ("assistant",)
    #: state -> role -> next state. A role that a state doesn't list is rejected.
    transitions: dict[str, dict[str, str]] = field(
        default_factory=lambda: {"start": {"system": "ready", "user": "asked"}, "ready": {"user": "asked"}, "asked": {"assistant": "answered"}, "answered": {"user": "asked"}}
    )
    final: tuple[str, ...] = ("answered",)


DEFAULT = Template()
#: The escape character, and what stands for it and for the first characters of control strings.
ESCAPE, CODES = "\\", {"\\": "\\e", "<": "\\l", "[": "\\b"}


def escape(c: Column, template: Template = DEFAULT) -> Column:
    """No control string is left in the result; unescape gives back exactly what came in."""
    c = F.replace(c, F.lit(ESCAPE), F.lit(CODES[ESCAPE]))
    for control in template.controls:
        c = F.replace(c, F.lit(control), F.lit(CODES[control[0]] + control[1:]))
    return c


def unescape(c: Column) -> Column:
    for plain, code in reversed(CODES.items()):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def _by_role(role: Column, template: Template, of: int) -> Column:
    out = F.concat(F.lit(template.other_open[0]), F.hex(role), F.lit(template.other_open[1])) if of == 0 else F.lit(template.other_close)
    for name, marks in template.marks.items():
        out = F.when(role == name, F.lit(marks[of])).otherwise(out)
    return out


def format_chats(rows: DataFrame, template: Template = DEFAULT, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", only_valid: bool = False) -> DataFrame:
    """One row per conversation: conv_col, formatted, segments (array of text and loss), state, valid.

    Turns come in the order of turn_col, ties by role and text, null turns first; repeated rows are turns each. A null text or
    role is empty. state is where the machine over the roles ends, or rejected; valid tells whether it ends in a final state.
    only_valid leaves out the others; without it they are formatted too and the caller chooses. Only texts of learned roles
    are under the loss, without their marks. Rows with a null conv_col are one conversation. Texts may have any length that a
    row may. Other columns are ignored. An empty table gives no rows. Texts move once and plain, and are escaped where the
    turns of a conversation are in order; nothing here runs Python.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    turns = rows.select(F.col(conv_col).alias("_conv"), F.struct(F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text")).alias("_turn"))
    chats = turns.groupBy("_conv").agg(F.sort_array(F.collect_list("_turn")).alias("_turns"))
    step = F.create_map(*[F.lit(x) for state, by in template.transitions.items() for role_, to in by.items() for x in (f"{state}>{role_}", to)])
    state = F.aggregate("_turns", F.lit("start"), lambda s, t: F.coalesce(F.try_element_at(step, F.concat(s, F.lit(">"), t["role"])), F.lit("rejected")))
    chats = chats.withColumn("_state", state)
    chats = chats.where(F.col("_state").isin(*template.final)) if only_valid else chats
    segment = lambda text_, loss: F.struct(text_.alias("text"), loss.alias("loss"))
    segments = F.flatten(F.transform("_turns", lambda t: F.array(segment(_by_role(t["role"], template, 0), F.lit(False)), segment(escape(t["text"], template), t["role"].isin(*template.learned)), segment(_by_role(t["role"], template, 1), F.lit(False)))))
    chats = chats.withColumn("segments", segments)
    return chats.select(F.col("_conv").alias(conv_col), F.concat_ws("", F.transform("segments", lambda x: x["text"])).alias("formatted"), "segments", F.col("_state").alias("state"), F.col("_state").isin(*template.final).alias("valid"))


def read_back(formatted: Column, template: Template = DEFAULT) -> Column:
    """The turns of a formatted conversation as an array of role and text, by its marks alone."""

    def quoted(x: str) -> str:
        return "\\Q" + x + "\\E"

    forms = [quoted(a) + ".*?" + quoted(b) for a, b in template.marks.values()]
    forms.append(quoted(template.other_open[0]) + "[0-9A-F]*" + quoted(template.other_open[1]) + ".*?" + quoted(template.other_close))
    blocks = F.regexp_extract_all(formatted, F.lit("(?s)" + "|".join(forms)), F.lit(0))

    def turn(block: Column) -> Column:
        opened = F.regexp_extract(block, quoted(template.other_open[0]) + "([0-9A-F]*)" + quoted(template.other_open[1]), 1)
        skip = F.length(opened) + sum(map(len, template.other_open))
        role = F.decode(F.unhex(opened), "UTF-8")
        text = F.substr(block, skip + 1, F.length(block) - skip - len(template.other_close))
        for name, (a, b) in template.marks.items():
            here = F.startswith(block, F.lit(a))
            role = F.when(here, F.lit(name)).otherwise(role)
            text = F.when(here, F.substr(block, F.lit(len(a) + 1), F.length(block) - len(a) - len(b))).otherwise(text)
        return F.struct(role.alias("role"), unescape(text).alias("text"))

    return F.transform(blocks, turn)

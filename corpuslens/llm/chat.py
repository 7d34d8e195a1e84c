"""Chat formatting: a finite-state machine checks the order of roles, and a
declarative template turns a conversation into text segments with loss flags.

Control strings inside texts are escaped, so the formatted text can be read
back turn by turn."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.shared import text_or_empty
from corpuslens.llm.spans import let


@dataclass(frozen=True)
class Mark:
    """What stands before and after a turn's text, and whether it is learnt."""
    before: str
    after: str
    loss: bool = False


# The template.  Roles that it doesn't name are marked by OTHER_BEFORE, the
# role and OTHER_MID.
TEMPLATE = {
    "system": Mark("<<SYS>>\n", "\n<</SYS>>\n"),
    "user": Mark("[INST] ", " [/INST]"),
    "assistant": Mark("<s>", "</s>", loss=True),
}
OTHER_BEFORE, OTHER_MID, OTHER_AFTER = "<role=", ">", "</role>"
ESCAPE = "\\"

# The machine: state and role give the next state; the states that may end.
TURNS = {
    "start": {"system": "system", "user": "user"},
    "system": {"user": "user"},
    "user": {"assistant": "assistant"},
    "assistant": {"user": "user"},
}
ENDS = ("assistant",)
ERROR = "error"


def controls(template: dict[str, Mark] = TEMPLATE) -> list[str]:
    marks = [m for mark in template.values() for m in (mark.before, mark.after)]
    return sorted({m.strip() for m in marks} | {OTHER_BEFORE, OTHER_AFTER}, key=lambda c: (-len(c), c))


def escape(text: Column, template: dict[str, Mark] = TEMPLATE) -> Column:
    """Doubles the escape character and puts one behind the first character
    of every control string; ``unescape`` is the inverse."""
    out = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2))
    for c in controls(template):
        out = F.replace(out, F.lit(c), F.lit(c[0] + ESCAPE + c[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(OTHER_MID), F.lit(ESCAPE + OTHER_MID))


def _of_role(role: Column, template: dict[str, Mark], pick, other: Column) -> Column:
    out = other
    for name, mark in template.items():
        out = F.when(role == name, F.lit(pick(mark))).otherwise(out)
    return out


def order_state(roles: Column, turns: dict[str, dict[str, str]] = TURNS) -> Column:
    """struct(state, bad): the machine's last state, and the place (from 0) of
    the first turn it has no way for; null if there is none."""
    table = F.create_map(*[F.lit(x) for state, ways in turns.items() for role, to in ways.items()
                           for x in (f"{state} {role}", to)])
    begin = F.struct(F.lit("start").alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("bad"))

    def step(s: Column, role: Column) -> Column:
        to = F.coalesce(F.try_element_at(table, F.concat_ws(" ", s["state"], role)), F.lit(ERROR))
        return let(to, lambda t: F.struct(t.alias("state"), (s["at"] + 1).alias("at"),
                                          F.coalesce(s["bad"], F.when(t == ERROR, s["at"])).alias("bad")))

    return F.aggregate(roles, begin, step, lambda s: F.struct(s["state"].alias("state"), s["bad"].alias("bad")))


def format_conversations(rows: DataFrame, template: dict[str, Mark] = TEMPLATE,
                         turns: dict[str, dict[str, str]] = TURNS, ends: tuple[str, ...] = ENDS) -> DataFrame:
    """``rows`` has conv_id, turn, role, text.  One row per conversation:
    conv_id, segments (array of text and loss flag), formatted (the segments
    joined), valid (the order of turns) and bad_turn.

    Rows stand by turn; equal turns by role, then text, nulls first, and
    repeated rows are repeated turns.  Null text and role are empty; null is a
    conversation of its own; no rows give no rows.  A conversation is one
    output string, so its rows meet in one task; nothing else of it does."""
    role, text = text_or_empty("role"), text_or_empty("text")
    turn = F.struct(
        F.col("turn"), F.col("role"), F.col("text"),
        _of_role(role, template, lambda m: m.before, F.concat(F.lit(OTHER_BEFORE), _role(role), F.lit(OTHER_MID))).alias("before"),
        escape(text, template).alias("body"),
        _of_role(role, template, lambda m: m.after, F.lit(OTHER_AFTER)).alias("after"),
        _of_role(role, template, lambda m: m.loss, F.lit(False)).alias("loss"))
    talks = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    segments = F.flatten(F.transform("turns", lambda t: F.array(
        part(t["before"], F.lit(False)), part(t["body"], t["loss"]), part(t["after"], F.lit(False)))))
    state = order_state(F.transform("turns", lambda t: text_or_empty(t["role"])), turns)
    return talks.select(
        "conv_id", segments.alias("segments"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["before"], t["body"], t["after"])), "").alias("formatted"),
        state.alias("_end")).select(
        "conv_id", "segments", "formatted", F.col("_end.state").isin(*ends).alias("valid"), F.col("_end.bad").alias("bad_turn"))


def read_back(formatted: Column, template: dict[str, Mark] = TEMPLATE) -> Column:
    """Array of (role, text) that a formatted conversation was made of."""
    other = re.escape(OTHER_BEFORE) + r"(?:[^>\\]|\\.)*+" + OTHER_MID
    before = "|".join([*(re.escape(m.before) for m in template.values()), other])
    after = "|".join(re.escape(m) for m in [*(m.after for m in template.values()), OTHER_AFTER])
    pattern = f"(?s)({before})(.*?)(?:{after})"
    texts = F.regexp_extract_all(formatted, F.lit(pattern), F.lit(2))
    marks = F.regexp_extract_all(formatted, F.lit(pattern), F.lit(1))

    def role(mark: Column) -> Column:
        out = unescape(F.regexp_extract(mark, "(?s)^" + re.escape(OTHER_BEFORE) + "(.*)" + OTHER_MID + "$", 1))
        for name, m in template.items():
            out = F.when(mark == m.before, F.lit(name)).otherwise(out)
        return out

    return F.zip_with(marks, texts, lambda m, t: F.struct(role(m).alias("role"), unescape(t).alias("text")))


def digest(formatted: DataFrame) -> DataFrame:
    """Counts and digests read back from segments and formatted text; bad_turn
    is -1 where the order of turns is right."""
    learnt = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    out = formatted.select("conv_id", read_back(F.col("formatted")).alias("turns"), learnt.alias("learnt"),
                           F.length("formatted").cast("long").alias("formatted_chars"), "valid",
                           F.coalesce("bad_turn", F.lit(-1)).alias("bad_turn"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                      F.length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"),
                      "formatted_chars", "valid", "bad_turn")

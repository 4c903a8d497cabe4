"""Chat formatting in DataFrame functions only.

A conversation is its turns in order of (turn, role, text).  A finite-state machine over
the roles validates the order; a declarative template turns every turn into segments,
each with a loss flag, whose texts laid end to end are the formatted conversation.
Control strings inside roles and texts are escaped reversibly: a backslash and the bar
of ``<|`` get a backslash before them, so no text can open or close a turn.

Edge cases: null texts and roles are empty; an unknown role is formatted and makes the
conversation invalid; repeated rows are turns of their own; turns with a null number come
first; a null conv_id is a conversation like any other; an empty table gives no rows;
extra columns are not read.  A conversation is one row of output, so its turns meet in
one task; nothing else does.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks around a turn, which roles' texts are learned, and the machine: state -> role -> state; a conversation is valid if it ends in one of ``final``."""

    open: str = "<|im_start|>"
    close: str = "<|im_end|>\n"
    learned: tuple[str, ...] = ("assistant",)
    start: str = "start"
    moves: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "told", "user": "asked"},
            "told": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )
    final: tuple[str, ...] = ("answered",)


CHATML = Template()


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escape_role(role: Column) -> Column:
    """As a text, and a line feed, which ends a role, gets a backslash too."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\\n"))


def unescape(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\\")), F.regexp_replace(text, r"(?s)\\(.)", "$1")).otherwise(text)


def walk(roles: Column, template: Template) -> Column:
    """The state after the roles, ``invalid`` after a move that the template lacks."""

    def move(state: Column, role: Column) -> Column:
        out = F.lit("invalid")
        for a, ways in template.moves.items():
            for r, b in ways.items():
                out = F.when((state == a) & (role == r), F.lit(b)).otherwise(out)
        return out

    return F.aggregate(roles, F.lit(template.start), move)


def format_conversations(turns: DataFrame, template: Template = CHATML) -> DataFrame:
    """conv_id, state, valid, segments (array of struct(text, loss)) and formatted."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = turns.select("conv_id", F.struct(F.col("turn").alias("turn"), role.alias("role"), text.alias("text")).alias("_t"))
    # the sort key is (turn, role, text), nulls first
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("_t")).alias("_turns"))

    def segments(t: Column) -> Column:
        return F.array(
            F.struct(F.concat(F.lit(template.open), escape_role(t["role"]), F.lit("\n")).alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(t["text"]).alias("text"), t["role"].isin(*template.learned).alias("loss")),
            F.struct(F.lit(template.close).alias("text"), F.lit(False).alias("loss")),
        )

    whole = whole.withColumn("segments", F.flatten(F.transform("_turns", segments)))
    state = walk(F.transform("_turns", lambda t: t["role"]), template)
    return whole.select("conv_id", state.alias("state"), state.isin(*template.final).alias("valid"), "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"))


def read_back(formatted: DataFrame, template: Template = CHATML) -> DataFrame:
    """Adds ``turns`` (array of struct(role, text)), parsed from ``formatted`` alone."""
    opened = r"\Q" + template.open + r"\E"
    # what stands before the first opening mark is empty; every turn ends in the closing mark
    bodies = F.slice(F.split("formatted", opened, -1), 2, 1 << 30)
    bodies = F.transform(bodies, lambda b: F.substring(b, F.lit(1), F.length(b) - len(template.close)))
    head = r"(?s)^((?:[^\\\n]|\\.)*)\n"
    pair = lambda b: F.struct(F.regexp_extract(b, head, 1).alias("role"), b.alias("text"))
    cut = lambda p: F.struct(unescape(p["role"]).alias("role"), unescape(F.substring(p["text"], F.length(p["role"]) + 2, F.length(p["text"]))).alias("text"))
    return formatted.withColumn("turns", F.transform(F.transform(bodies, pair), cut))


def digest(formatted: DataFrame, template: Template = CHATML) -> DataFrame:
    """Digests of what is read back from the formatted text and its loss mask."""
    back = read_back(formatted, template)
    # the mask: offset and length of each learned segment in the formatted text
    place = F.aggregate(
        "segments",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,n:int>>").alias("spans")),
        lambda acc, s: F.struct((acc["at"] + F.length(s["text"])).alias("at"), F.when(s["loss"], F.concat(acc["spans"], F.array(F.struct(acc["at"].alias("at"), F.length(s["text"]).alias("n"))))).otherwise(acc["spans"]).alias("spans")),
    )
    back = back.withColumn("_spans", place["spans"])
    back = back.withColumn("_loss", F.array_join(F.transform("_spans", lambda p: unescape(F.substring(F.col("formatted"), p["at"] + 1, p["n"]))), ""))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "state",
        "valid",
    )

"""Chat formatting by a finite-state machine over roles.

A declarative :class:`Template` holds the control strings, the roles under the loss, the machine's moves and its final
roles. Each turn becomes segments (opening, text, closing), each with its loss flag. Texts and roles are escaped: each
control string has a lead, its first character that is no white space, and inside texts a backslash is put before every
backslash and every lead of an opening or closing. So no control string, the template's own included, is ever without a
backslash before it inside a text, and the text is read back exactly. In roles the lead of the opening's end is escaped too.

The machine follows one conversation through its turns in order and needs only the role before; a turn that has no move,
or ends the conversation in a role that isn't final, is kept, formatted and flagged ``turn_ok = false``, so nothing is lost.

Nulls: a null text or role counts as empty; rows with a null conversation form the conversation null; a null turn sorts
first. Ties and repeated rows: turns of equal number are ordered by role, then text, and all are kept. Empty texts give
an empty segment. Empty table: an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START = ""


@dataclass(frozen=True)
class Template:
    open_before: str = "<turn "
    open_after: str = ">\n"
    close: str = "\n</turn>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    moves: dict = field(default_factory=lambda: {START: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    finals: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        for mark in (self.open_before, self.open_after, self.close):
            if lead(mark) in ("", "\\"):
                raise ValueError("a control string needs a first character that is neither white space nor a backslash")

    def leads(self) -> str:
        """The characters to escape in texts."""
        return "".join(dict.fromkeys(lead(self.open_before) + lead(self.close)))


def lead(mark: str) -> str:
    return mark.strip()[:1]


def escape(c: Column, leads: str) -> Column:
    """Backslash first, then each of ``leads``; each gets a backslash before it."""
    for x in dict.fromkeys("\\" + leads):
        c = F.replace(c, F.lit(x), F.lit("\\" + x))
    return c


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def format_turns(rows: DataFrame, template: Template = Template(), conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Segments, one row per turn: conv, turn, pos (1, 2, ... in the conversation), turn_ok, segments array of (text, loss).

    The machine is a window over the turns of a conversation, sorted and streamed, so that a long conversation needs no
    more memory than a short one.
    """
    slim = rows.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    before = F.lag("role").over(w)
    moves = F.create_map(*[x for k, v in template.moves.items() if k != START for x in (F.lit(k), F.array(*map(F.lit, v)))])
    first = F.array(*map(F.lit, template.moves[START]))
    final = F.lead("role").over(w).isNotNull() | F.col("role").isin(*template.finals)
    ok = F.when(before.isNull(), F.array_contains(first, F.col("role"))).otherwise(F.coalesce(F.array_contains(F.try_element_at(moves, before), F.col("role")), F.lit(False)))
    seg = lambda t, loss: F.struct(t.alias("text"), loss.alias("loss"))
    no = F.lit(False)
    loss = F.col("role").isin(*template.loss_roles)
    return slim.select(
        "conv_id",
        "turn",
        F.row_number().over(w).alias("pos"),
        (ok & final).alias("turn_ok"),
        F.array(
            seg(F.concat(F.lit(template.open_before), escape(F.col("role"), template.leads() + lead(template.open_after)), F.lit(template.open_after)), no),
            seg(escape(F.col("text"), template.leads()), loss),
            seg(F.lit(template.close), no),
        ).alias("segments"),
    )


def formatted(turns: DataFrame) -> DataFrame:
    """One row per turn with its formatted text and the mask as spans: conv_id, pos, turn_ok, text, loss_from, loss_to (code points)."""
    s = F.col("segments")
    a = F.char_length(s[0]["text"])
    return turns.select(
        "conv_id",
        "pos",
        "turn_ok",
        F.concat(s[0]["text"], s[1]["text"], s[2]["text"]).alias("text"),
        a.cast("long").alias("loss_from"),
        (a + F.when(s[1]["loss"], F.char_length(s[1]["text"])).otherwise(0)).cast("long").alias("loss_to"),
    )


def read_back(lines: DataFrame, template: Template = Template()) -> DataFrame:
    """Role, text and text under the loss of each turn, parsed from formatted text and mask alone."""
    t = F.col("text")
    body = F.substring(t, F.lit(len(template.open_before) + 1), F.char_length(t))
    # the opening's end has the first lead of its own that isn't escaped; white space may come before it
    end = re.escape(lead(template.open_after))
    role = F.regexp_extract(body, rf"(?s)^((?:\\.|(?!{end})[^\\])*+){end}", 1)
    at = F.char_length(role) - template.open_after.index(lead(template.open_after))
    role = F.substring(role, F.lit(1), at)
    rest = F.substring(body, at + len(template.open_after) + 1, F.char_length(body))
    text = F.substring(rest, F.lit(1), F.char_length(rest) - len(template.close))
    return lines.select(
        "conv_id",
        "pos",
        "turn_ok",
        unescape(role).alias("role"),
        unescape(text).alias("text"),
        unescape(F.substring(t, F.col("loss_from").cast("int") + 1, (F.col("loss_to") - F.col("loss_from")).cast("int"))).alias("loss_text"),
        F.char_length(t).cast("long").alias("formatted_chars"),
    )


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Streams rows that are grouped by conversation and sorted by pos; holds one conversation's running sums only."""
    own, now = None, object()

    def row() -> tuple:
        return (own["id"], own["n"], own["t"].hexdigest(), own["chars"], own["l"].hexdigest(), own["out"], own["valid"])

    cols = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
    for pdf in batches:
        done = []
        for c, role, text, loss, chars, ok in zip(pdf["conv_id"], pdf["role"], pdf["text"], pdf["loss_text"], pdf["formatted_chars"], pdf["turn_ok"]):
            c = None if pd.isna(c) else c
            if own is None or c != now:
                if own is not None:
                    done.append(row())
                own, now = {"id": c, "n": 0, "t": sha256(), "l": sha256(), "chars": 0, "out": 0, "valid": True}, c
            own["n"] += 1
            own["t"].update(f"{role}\n{text}\n".encode())
            own["l"].update(loss.encode())
            own["chars"] += len(loss)
            own["out"] += chars
            own["valid"] &= bool(ok)
        yield pd.DataFrame(done, columns=cols).astype({"conv_id": "object"})
    if own is not None:
        yield pd.DataFrame([row()], columns=cols).astype({"conv_id": "object"})


def digest(turns: DataFrame) -> DataFrame:
    """Per conversation, in order of pos: turns, digests, characters under the loss and of the whole output.

    The window of :func:`format_turns` left each conversation in one partition; the rows are sorted there and streamed,
    so a conversation of any length is digested in constant memory.
    """
    kind = dict(turns.dtypes)["conv_id"]
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "pos").mapInPandas(_digests, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")

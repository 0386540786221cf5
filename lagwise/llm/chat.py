"""Chat formatting by a declarative template and a finite-state machine over roles. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """A turn is ``open``, its role, ``colon``, its text, ``close``; roles and texts are escaped.

    ``escapes`` are replaced in this order, the escape character first; every escape is that character and a letter, so
    reading back in the opposite order is exact, and no escaped text holds a control string.
    """

    open: str = "### "
    colon: str = ": "
    close: str = " </turn>\n"
    escapes: tuple[tuple[str, str], ...] = (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\e"), (":", "\\c"))
    loss_roles: tuple[str, ...] = ("assistant",)
    #: (state, role) to the next state; anything else is an error and stays one.
    steps: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "briefed", ("start", "user"): "asked", ("briefed", "user"): "asked",
            ("asked", "assistant"): "answered", ("answered", "user"): "asked",
        }
    )
    accepted: tuple[str, ...] = ("answered",)

    def escaped(self, text: Column) -> Column:
        for plain, short in self.escapes:
            text = F.replace(text, F.lit(plain), F.lit(short))
        return text

    def plain(self, text: Column) -> Column:
        for plain, short in reversed(self.escapes):
            text = F.replace(text, F.lit(short), F.lit(plain))
        return text

    def state(self, roles: Column) -> Column:
        """The machine's last state after an array of roles."""
        pairs = [x for (s, r), to in self.steps.items() for x in (F.lit(f"{s}\n{r}"), F.lit(to))]
        table = F.create_map(*pairs)
        step = lambda state, role: F.coalesce(F.try_element_at(table, F.concat(state, F.lit("\n"), role)), F.lit("error"))
        return F.aggregate(roles, F.lit("start"), step)


def conversations(rows: DataFrame) -> DataFrame:
    """``conv_id, turns``: the turns of each conversation in order, in one array."""
    clean = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    turn = F.struct("turn", "role", "text")
    return clean.filter("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def formatted(rows: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """``conv_id, state, valid, segments``: ``segments`` is an array of (text, loss); their texts in a row are the output.

    ``rows(conv_id, turn, role, text)`` are taken in the order of turn (null first), then role, then text; repeated rows
    are turns of their own. Null roles and texts are empty. Rows without a conv_id belong to no conversation and are
    left out. Every conversation is formatted; ``state`` is where the machine over its roles ends and ``valid`` whether
    that is an accepted state. An empty table gives an empty result; other columns are ignored. A conversation is one
    row, as its output is one text, and its turns meet in one task; it is not joined or sorted with others.
    """
    fixed = lambda text: F.struct(text.alias("text"), F.lit(False).alias("loss"))

    def segments(t: Column) -> Column:
        head = F.concat(F.lit(template.open), template.escaped(t["role"]), F.lit(template.colon))
        body = F.struct(template.escaped(t["text"]).alias("text"), t["role"].isin(*template.loss_roles).alias("loss"))
        return F.array(fixed(head), body, fixed(F.lit(template.close)))

    turns = F.col("turns")
    state = template.state(F.transform(turns, lambda t: t["role"]))
    return conversations(rows).select(
        "conv_id", state.alias("state"), F.flatten(F.transform(turns, segments)).alias("segments")
    ).withColumn("valid", F.col("state").isin(*template.accepted))


def read_back(output: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """``output`` with ``formatted`` (the whole text), ``turns`` (role, text) parsed from it, and ``loss_text``."""
    joined = output.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))
    closing = "\\Q" + template.close + "\\E"
    parts = F.split("formatted", closing)

    def turn(part: Column) -> Column:
        inside = F.substr(part, F.lit(len(template.open) + 1))
        at = F.instr(inside, template.colon)
        role, text = F.substr(inside, F.lit(1), at - 1), F.substr(inside, at + len(template.colon))
        return F.struct(template.plain(role).alias("role"), template.plain(text).alias("text"))

    masked = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: template.plain(s["text"]))
    return joined.withColumn("turns", F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), turn)).withColumn("loss_text", F.array_join(masked, ""))


def digests(back: DataFrame) -> DataFrame:
    """The digest columns of what ``read_back`` gives."""
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "valid",
    )

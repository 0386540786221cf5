"""Identifier, status and name cleaning as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _plain_forms() -> tuple[dict[str, str], dict[str, str]]:
    """Characters outside ASCII whose compatibility decomposition has plain letters, digits or blanks: one, or several."""
    one, several = {}, {}
    for code in range(0x80, 0x110000):
        base = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
        base = "".join(c for c in base if c.isalnum() or c == " ")
        if base:
            (one if len(base) == 1 else several)[chr(code)] = base
    return one, several


SINGLE, SEVERAL = _plain_forms()


def short_id(x: Column, keep_zero: bool = False) -> Column:
    """``"0022400061.0"`` -> ``"22400061"``; missing markers become null.

    An id of zeros only becomes ``""``, or ``"0"`` with ``keep_zero``.
    """
    s = F.trim(F.regexp_replace(x.cast("string"), r"\.0$", ""))
    s = F.when(~s.isin("nan", "None", ""), s)
    bare = F.regexp_replace(s, "^0+", "")
    return F.when((bare == "") & s.isNotNull(), F.lit("0")).otherwise(bare) if keep_zero else bare


def padded_id(x: Column, width: int = 10) -> Column:
    """Remove every ``.0`` and left-pad with zeros; longer ids are not cut."""
    s = F.replace(x.cast("string"), F.lit(".0"), F.lit(""))
    return F.when(F.length(s) < width, F.lpad(s, width, "0")).otherwise(s)


def integer_id(x: Column) -> Column:
    return x.cast("string").try_cast("bigint")


def number(x: Column, fill: float | None = None) -> Column:
    """Numeric coercion: bad text and NaN become null, then ``fill``."""
    v = F.nanvl(x.cast("string").try_cast("double"), F.lit(None).cast("double"))
    return v if fill is None else F.coalesce(v, F.lit(float(fill)))


def minutes_strict(x: Column) -> Column:
    """``"MM:SS"`` to minutes; text without a colon is 0."""
    part = F.split(x, ":")
    value = F.element_at(part, 1).try_cast("double") + F.try_element_at(part, F.lit(2)).try_cast("double") / 60
    return F.when(F.contains(x, F.lit(":")), value).otherwise(F.lit(0.0))


def minutes_lenient(x: Column) -> Column:
    """Split on the first colon; each part that is not a number counts 0."""
    part = F.split(F.coalesce(x, F.lit("")), ":", 2)
    first = F.coalesce(F.element_at(part, 1).try_cast("double"), F.lit(0.0))
    second = F.coalesce(F.try_element_at(part, F.lit(2)).try_cast("double"), F.lit(0.0))
    return first + second / 60


def minutes_text(x: Column) -> Column:
    """Minutes to ``"M:SS"``; 60 seconds carry into the next minute."""
    seconds = F.bround(x * 60, 0).cast("bigint")
    return F.when(
        x.isNotNull(),
        F.concat(F.floor(seconds / 60).cast("string"), F.lit(":"), F.lpad((seconds % 60).cast("string"), 2, "0")),
    )


def status_text(x: Column) -> Column:
    return F.coalesce(F.trim(F.translate(F.upper(x), "_-", "  ")), F.lit(""))


def known_absence(minutes: Column, status: Column) -> Column:
    """Did not play, a reason is given, and the reason was not the coach's decision."""
    return (minutes <= 0) & (status != "") & ~F.contains(status, F.lit("COACH"))


def around_rare(x: Column) -> Column:
    """The text in pieces: each character that decomposes into several letters is a piece of its own."""
    rare = "[\u0080-\U0010ffff&&[" + "".join(SEVERAL) + "]]"  # ASCII fails the first test
    return F.split(x, f"(?<={rare})|(?={rare})")


def name_key(x: Column) -> Column:
    """Lower-case ASCII name with single spaces, for matching people across sources.

    Built-in functions only. Texts of ASCII alone skip all but the last steps. Characters that decompose into several
    letters, such as ligatures, are looked up in a map, whose search is linear: the text is cut around them first.
    """
    forms = F.create_map(*[F.lit(v) for pair in SEVERAL.items() for v in pair])
    apart = F.array_join(F.transform(around_rare(x), lambda c: F.when(F.length(c) > 1, c).otherwise(F.coalesce(F.try_element_at(forms, c), c))), "")
    whole = F.when(F.length(F.translate(x, "".join(SEVERAL), "")) < F.length(x), apart).otherwise(x)
    plain = F.when(F.rlike(x, F.lit("[^\\x00-\\x7F]")), F.translate(whole, "".join(SINGLE), "".join(SINGLE.values()))).otherwise(x)
    kept = F.regexp_replace(F.lower(plain), "[^a-z0-9 ]+", "")
    return F.trim(F.regexp_replace(kept, "  +", " "))


def name_key_full(x: Column) -> Column:
    """The same key with full Unicode decomposition, as an Arrow-batched function."""

    @F.pandas_udf("string")
    def key(names: pd.Series) -> pd.Series:
        plain = names.str.normalize("NFKD").str.encode("ascii", "ignore").str.decode("ascii").str.lower()
        return plain.str.replace("[^a-z0-9 ]", "", regex=True).str.replace(" +", " ", regex=True).str.strip()

    return key(x)


def home_from_matchup(matchup: Column) -> Column:
    """Home code of ``"A vs. B"`` (A) and ``"A @ B"`` (B)."""
    return (
        F.when(F.contains(matchup, F.lit(" vs. ")), F.element_at(F.split(matchup, r" vs\. "), 1))
        .when(F.contains(matchup, F.lit(" @ ")), F.try_element_at(F.split(matchup, " @ "), F.lit(2)))
    )


def map_code(x: Column, codes: dict[str, str], strict: bool = False) -> Column:
    """Dictionary lookup; unmatched is null. ``strict`` passes known codes through and fails on others."""
    table = F.create_map(*[F.lit(v) for pair in codes.items() for v in pair])
    found = F.try_element_at(table, x)
    if not strict:
        return found
    known = F.array(*[F.lit(v) for v in sorted(set(codes.values()))])
    return (
        F.when(found.isNotNull(), found)
        .when(F.array_contains(known, x), x)
        .otherwise(F.raise_error(F.concat(F.lit("unknown code "), F.coalesce(x, F.lit("null")))))
    )


def source_label(parts: dict[str, Column]) -> Column:
    """``home:<source>|away:<source>`` style provenance text."""
    return F.concat_ws("|", *[F.concat(F.lit(f"{k}:"), F.coalesce(v, F.lit("none"))) for k, v in parts.items()])

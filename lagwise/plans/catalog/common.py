"""Small helpers shared by the query modules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagwise.operators.timeline import Timeline

TEAM_LINE = Timeline("team", ("d", "game_id"))


def r6(x: Column | str) -> Column:
    return F.round(x, 6)


def text_date(x: Column | str) -> Column:
    return F.date_format(x, "yyyy-MM-dd")


def pick(df: DataFrame, *plain: str, **rounded: str) -> DataFrame:
    """Plain columns as they are, keyword columns rounded to six digits."""
    return df.select(*plain, *[r6(v).alias(k) for k, v in rounded.items()])

"""Pair ratings by pool, one vector step per day."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagwise.operators.timeline import Timeline
from lagwise.operators.windows import lagged_means


@dataclass(frozen=True)
class RatingRule:
    """Fixed values of the rating.

    Start, step size, home bonus, share kept over a season change, points per factor ten of odds, and the two numbers by
    which a margin counts less the larger the favourite's lead.
    """

    start: float = 1500.0
    k: float = 20.0
    home_advantage: float = 65.0
    carry: float = 0.75
    scale: float = 400.0
    damping: float = 2.2
    lead_weight: float = 0.001

    def gain(self, lead: np.ndarray, margin: np.ndarray) -> np.ndarray:
        """Points that move from away to home; a game without a score moves none."""
        surprise = (margin > 0) - 1 / (1 + 10 ** (-lead / self.scale))
        size = np.log1p(np.abs(margin)) * self.damping / (self.damping + lead * self.lead_weight)
        return np.where(np.isnan(margin), 0.0, self.k * size * surprise)


@dataclass
class _Pool:
    """Ratings of one pool's entities: a number and the last season each."""

    rule: RatingRule
    place: dict = field(default_factory=dict)
    rating: np.ndarray = field(default_factory=lambda: np.empty(0))
    season: np.ndarray = field(default_factory=lambda: np.empty(0))

    def _places(self, entities: list, season: np.ndarray) -> np.ndarray:
        at = np.array([self.place.setdefault(e, len(self.place)) for e in entities], dtype=np.int64)
        new = len(self.place) - len(self.rating)
        self.rating = np.append(self.rating, np.full(new, self.rule.start))
        self.season = np.append(self.season, np.full(new, np.nan))
        changed = np.unique(at[~np.isnan(self.season[at]) & (self.season[at] != season)])
        self.rating[changed] = self.rule.start + self.rule.carry * (self.rating[changed] - self.rule.start)
        self.season[at] = season
        return at

    def day(self, home: list, away: list, season: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ratings of both sides before the day's games, which then all count at once."""
        n = len(home)
        at = self._places(home + away, np.concatenate([season, season]))
        before = self.rating[at]
        gain = self.rule.gain(before[:n] - before[n:] + self.rule.home_advantage, margin)
        np.add.at(self.rating, at, np.concatenate([gain, -gain]))
        return before[:n], before[n:]


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """A number per distinct value, null included."""
    return pc.fill_null(column.combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)


def _rated(batches: Iterator[pa.RecordBatch], rule: RatingRule) -> Iterator[pa.RecordBatch]:
    """Ratings for rows sorted by pool and day; a day that may go on in the next batch waits for it."""
    current, state, waiting = None, _Pool(rule), None

    def days(t: pa.Table) -> pa.RecordBatch:
        nonlocal current, state
        pool, day = _codes(t.column(0)), _codes(t.column(2))
        season, margin = (t.column(c).to_numpy().astype(float) for c in (3, 6))
        home, away = t.column(4).to_pylist(), t.column(5).to_pylist()
        cuts = [0, *(np.flatnonzero((np.diff(pool) != 0) | (np.diff(day) != 0)) + 1).tolist(), len(t)]
        out = np.empty((2, len(t)))
        for lo, hi in zip(cuts, cuts[1:]):
            if lo == 0 or pool[lo] != pool[lo - 1]:
                name = (t.column(0)[lo].as_py(),)
                if name != current:
                    current, state = name, _Pool(rule)
            out[:, lo:hi] = state.day(home[lo:hi], away[lo:hi], season[lo:hi], margin[lo:hi])
        return pa.RecordBatch.from_arrays([t.column(1).combine_chunks(), pa.array(out[0]), pa.array(out[1])], ["game_id", "elo_home", "elo_away"])

    for batch in batches:
        t = pa.Table.from_batches([batch] if waiting is None else [*waiting.to_batches(), batch])
        if not len(t):
            continue
        pool, day = _codes(t.column(0)), _codes(t.column(2))
        open_from = int(np.flatnonzero((pool != pool[-1]) | (day != day[-1]))[-1]) + 1 if ((pool != pool[-1]) | (day != day[-1])).any() else 0
        waiting = t.slice(open_from)
        if open_from:
            yield days(t.slice(0, open_from))
    if waiting is not None:
        yield days(waiting)


def pair_ratings(games: DataFrame, rule: RatingRule = RatingRule(), pool: str = "pool_id") -> DataFrame:
    """Rating of both sides before each game, from (pool, game_id, game_date, season, home, away, score_home, score_away).

    A pool's days are a chain, so one pool is processed in order by one task, but
    never held there: rows stream through in Arrow batches and one number per entity
    is kept. Games of one day count together, which for entities that play once a
    day is the same as one after the other. A game without a score, such as one of a
    coming slate, gets ratings and leaves them as they are.
    """
    margin = (F.col("score_home") - F.col("score_away")).cast("double")
    narrow = games.select(pool, F.col("game_id").cast("long").alias("game_id"), "game_date", F.col("season").cast("double").alias("season"), "home", "away", margin.alias("margin"))
    placed = narrow.repartition(pool).sortWithinPartitions(pool, "game_date", "game_id")
    return placed.mapInArrow(lambda batches: _rated(batches, rule), "game_id bigint, elo_home double, elo_away double")


def rating_windows(team_rows: DataFrame, line: Timeline, rating: str = "elo", n: int = 164, min_count: int = 20, name: str = "elo_roll", bounded: bool = False) -> DataFrame:
    """Lagged long-run mean of an entity's own rating."""
    return lagged_means(team_rows, line, {name: F.col(rating)}, n, min_count, bounded=bounded)

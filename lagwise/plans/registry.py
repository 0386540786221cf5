"""Registry of named queries, each with an optional SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from lagwise.plans import adapters


@dataclass(frozen=True)
class Query:
    build: Callable[["Data"], DataFrame]
    sql: str | None
    covers: tuple[str, ...]


REGISTRY: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Register a query; ``covers`` lists the operator ids it exercises."""

    def add(fn):
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Query(fn, sql, tuple(covers.split()))
        return fn

    return add


class Data:
    """The given tables under one directory, and the adapter views built on them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def games(self) -> DataFrame:
        return adapters.games(self.table("orders"))

    @cached_property
    def team_games(self) -> DataFrame:
        return adapters.team_games(self.games)

    @cached_property
    def prices(self) -> DataFrame:
        return adapters.prices(self.games)

    @cached_property
    def player_box(self) -> DataFrame:
        return adapters.player_box(self.table("lineitem"), self.games)

    @cached_property
    def predictions(self) -> DataFrame:
        return adapters.predictions(self.games)

    @cached_property
    def quotes(self) -> DataFrame:
        return adapters.quotes(self.table("events"))

    @cached_property
    def model_bets(self) -> DataFrame:
        return adapters.model_bets(self.predictions, self.prices)

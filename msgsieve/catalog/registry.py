"""Register runnable queries next to the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from msgsieve.catalog import fixtures

Job = Callable[["Inputs"], DataFrame]


@dataclass(frozen=True)
class Inputs:
    """Lazy access to tables and views of one data folder."""

    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return fixtures.table(self.spark, self.sf_dir, name)

    def view(self, name: str) -> DataFrame:
        return fixtures.view(self.spark, self.sf_dir, name)

    @property
    def messages(self) -> DataFrame:
        return self.view("messages")

    @property
    def timeless_messages(self) -> DataFrame:
        """All of ``messages`` but ``ts``."""
        return fixtures.timeless_messages(self.spark, self.sf_dir)


QUERIES: dict[str, Job] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: str = "") -> Callable[[Job], Job]:
    """Register ``job`` as ``name``; ``views`` lists the portable views ``sql`` reads."""

    def keep(job: Job) -> Job:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = job
        if sql is not None:
            ORACLES[name] = fixtures.oracle(sql.strip(), *views.split())
        return job

    return keep

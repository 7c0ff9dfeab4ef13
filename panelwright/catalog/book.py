"""Query book: name -> Spark job, name -> independent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Job = Callable[[SparkSession, str], DataFrame]


def portable(df: DataFrame) -> DataFrame:
    """Dates leave as ISO text, so that any two engines print them alike."""
    return df.select(
        *[
            F.col(f"`{f.name}`").cast("string").alias(f.name) if isinstance(f.dataType, T.DateType) else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


class Book:
    def __init__(self) -> None:
        self.jobs: dict[str, Job] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, job: Job, sql: str | None = None) -> None:
        if name in self.jobs:
            raise ValueError(f"query {name} is registered twice")
        self.jobs[name] = lambda spark, folder: portable(job(spark, folder))
        if sql is not None:
            self.sql[name] = sql


BOOK = Book()

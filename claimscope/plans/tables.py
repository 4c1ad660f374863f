"""The set of tables a report reads."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from claimscope.sources.buckets import is_bucketed, read_bucketed
from claimscope.sources.tables import read_table


@dataclass(frozen=True)
class Tables:
    """Tables given as DataFrames. Reports read only the ones they need."""

    claims: DataFrame
    crosswalk: DataFrame
    land: DataFrame
    index: DataFrame
    counties: DataFrame | None = None


class Warehouse:
    """The same tables as written by the load job, each opened when first asked for."""

    FOLDERS = {
        "claims": "claims",
        "crosswalk": "zip_to_zcta",
        "land": "land_cover",
        "index": "price_index",
        "counties": "counties",
        "rejects": "rejects",
    }

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path
        self.report = None  # what the load job found, right after a load

    def folder(self, name: str) -> str:
        return f"{self.path.rstrip('/')}/{self.FOLDERS[name]}"

    def _open(self, name: str) -> DataFrame:
        path = self.folder(name)
        return read_bucketed(self.spark, path) if is_bucketed(self.spark, path) else read_table(self.spark, path)

    @cached_property
    def claims(self) -> DataFrame:
        return self._open("claims")

    @cached_property
    def crosswalk(self) -> DataFrame:
        return self._open("crosswalk")

    @cached_property
    def land(self) -> DataFrame:
        return self._open("land")

    @cached_property
    def index(self) -> DataFrame:
        return self._open("index")

    @cached_property
    def counties(self) -> DataFrame:
        return self._open("counties")

    @cached_property
    def rejects(self) -> DataFrame:
        """Malformed rows of all feeds: feed, file, split, row, text, reason."""
        return self._open("rejects")

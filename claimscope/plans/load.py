"""The load job: five raw files in, five clean tables out, and the rows that do not fit.

The claims file is read once: cast, counted, checked for impossible dates and written by
year. The keyed tables are typed and stored in one pass over their text, counted on the way;
their repeated keys are then sorted out on the stored rows. Malformed rows of any feed are
read once more, only where the counts say that there are some, and kept with their reason.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from claimscope import schemas
from claimscope.operators import clean, joins, quality
from claimscope.plans.tables import Warehouse
from claimscope.sources import delimited
from claimscope.sources.buckets import UnevenBuckets, write_bucketed
from claimscope.sources.tables import stored, write_by_year


@dataclass(frozen=True)
class RawFiles:
    """Paths of the raw feeds; each may be a file, a folder or a glob."""

    claims: str
    crosswalk: str
    land: str
    index: str
    places: str | None = None


@dataclass(frozen=True)
class FeedCount:
    """Rows of one feed, and how many of them have too few or too many cells."""

    landed: int
    malformed: int


@dataclass(frozen=True)
class LoadReport:
    """Claims landed and stored, claim ids stored more than once, and the counts of every feed."""

    landed: int
    stored: int
    repeated_ids: int
    feeds: dict[str, FeedCount]

    @property
    def malformed(self) -> int:
        """Malformed rows of all feeds."""
        return sum(f.malformed for f in self.feeds.values())

    @property
    def clean(self) -> bool:
        return self.landed == self.stored and not self.malformed and not self.repeated_ids


class LoadRefused(ValueError):
    """The load found rows it was told not to accept; the tables are written all the same."""


@dataclass(frozen=True)
class Feed:
    """A raw file: its name, columns and separator."""

    name: str
    columns: list[str]
    sep: str = ","

    def read(self, spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
        return delimited.read_text_columns(
            spark, path, self.columns, self.sep, multi_line=multi_line, malformed=True, landed=True
        )


CLAIMS = Feed("claims", schemas.CLAIMS_FILE_ORDER)
CROSSWALK = Feed("crosswalk", schemas.CROSSWALK.names)
LAND = Feed("land", schemas.LAND_COVER.names, "\t")
INDEX = Feed("index", schemas.PRICE_INDEX_FILE.names)
PLACES = Feed("places", schemas.PLACE_CODES.names)


def _counts() -> tuple[Column, Column]:
    return F.count(F.lit(1)).alias("landed"), F.count(F.col(delimited.MALFORMED)).alias("malformed")


def load(
    spark: SparkSession,
    raw: RawFiles,
    warehouse: str,
    blank_numeric: str = "null",
    multi_line: bool = False,
    refuse: bool = False,
    buckets: int | None = None,
) -> Warehouse:
    """Write all tables below ``warehouse`` and check them; the result is in ``.report``.

    ``blank_numeric="zero"`` loads numbers as a lenient SQL loader does. ``multi_line``
    takes line ends inside quoted cells for part of the cell, in every feed. Malformed rows
    of any feed are loaded as far as they go, counted, and listed in the table ``rejects``.
    With ``refuse`` a load that is not clean raises ``LoadRefused``.

    With ``buckets`` claims and crosswalk are bucketed by postal code and land by area, so that
    sums by them and joins on them move no rows; claims stay in year folders. Where one bucket
    of a table would be far larger than the others, that table is written as without.

    Rows landed and malformed are counted by the pass that loads them. Only where the count
    differs from the rows stored, as retried tasks may count twice, the text is read again.
    """
    house = Warehouse(spark, warehouse)
    feeds: dict[str, FeedCount] = {}

    def land(feed: Feed, path: str, write: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Store a feed by ``write``, which returns what it stored, and count the rows that go in."""
        text = feed.read(spark, path, multi_line)
        seen = Observation(feed.name)
        stored_rows = write(text.observe(seen, *_counts()))
        counts, stored_count = seen.get, stored_rows.count()
        if counts["landed"] != stored_count:
            counts = text.agg(*_counts()).first().asDict()
        feeds[feed.name] = FeedCount(counts["landed"], counts["malformed"])
        if counts["malformed"]:
            found = delimited.rejected(text, len(feed.columns), feed.sep)
            found.select(F.lit(feed.name).alias("feed"), "*").write.mode("append").parquet(house.folder("rejects"))
        return stored_rows

    def put(rows: DataFrame, name: str, key: str, sort: Sequence[str], folders: str | None, plain: Callable[[DataFrame, str], object]) -> None:
        try:
            if buckets:
                write_bucketed(rows, house.folder(name), key, buckets, sort, folders)
                return
        except UnevenBuckets:
            pass
        plain(rows, house.folder(name))

    def claims(text: DataFrame) -> DataFrame:
        typed = clean.clean_claims(text.drop(delimited.LANDED), blank_numeric)
        # Bucketing reads its rows twice.
        put(stored(typed, "claims") if buckets else typed, "claims", "clean_zip", (), "yearOfLoss", write_by_year)
        return house.claims

    def keyed(feed: Feed, path: str, typed: Callable[[DataFrame], DataFrame], key: Sequence[str]) -> None:
        rows = land(feed, path, lambda text: stored(typed(text), feed.name))
        kept = clean.keep_first(rows, key)
        put(stored(kept, feed.name) if buckets else kept, feed.name, key[0], key[1:], None, lambda df, to: df.write.parquet(to))

    land(CLAIMS, raw.claims, claims)
    keyed(CROSSWALK, raw.crosswalk, clean.typed_crosswalk, clean.CROSSWALK_KEY)
    keyed(LAND, raw.land, lambda text: clean.conform(text, schemas.LAND_COVER, blank_numeric), clean.LAND_KEY)
    keyed(INDEX, raw.index, lambda text: clean.typed_price_index(text, blank_numeric), clean.INDEX_KEY)
    if raw.places:
        rows = land(PLACES, raw.places, lambda text: stored(text.drop(delimited.MALFORMED), PLACES.name))
        joins.county_reference(rows).write.parquet(house.folder("counties"))
    repeated = clean.duplicate_keys(house.claims, ["id"]).count()
    house.report = LoadReport(feeds["claims"].landed, house.claims.count(), repeated, feeds)
    if refuse and not house.report.clean:
        raise LoadRefused(str(house.report))
    return house


def audit(spark: SparkSession, raw: RawFiles, house: Warehouse) -> tuple[DataFrame, DataFrame]:
    """Claims landed against claims stored, and claim ids stored more than once."""
    landing = delimited.read_raw_claims(spark, raw.claims)
    return quality.reconcile(landing, house.claims), clean.duplicate_keys(house.claims, ["id"])

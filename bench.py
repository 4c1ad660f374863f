"""Time the load and every report and summary over it; print one JSON line.

``text_load`` is the load job from raw text files, counts and duplicate audit included; the
files are written beforehand. ``load`` derives claims from the raw test tables and writes
them in the year layout. The reports then read that layout. ``raw_*`` entries run registered
queries straight from the raw tables for comparison.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import functions as F

from claimscope import schemas
from claimscope.checks import load_checks, report_checks, set_checks
from claimscope.checks.standins import Standins
from claimscope.plans.load import RawFiles
from claimscope.plans.load import load as load_text
from claimscope.plans.tables import Warehouse
from claimscope.session import local_session, remove_scratch, scratch_path
from claimscope.sources.delimited import write_csv
from claimscope.sources.tables import write_by_year

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RAW = (
    "report_macro_trend",
    "report_storm_control",
    "agg_two_level",
    "agg_mean_median",
    "semi_join_major_events",
    "scan_csv_typed",
    "dedup_keep_one",
)


class Loaded(Standins):
    """Stand-ins whose tables are read from a warehouse instead of being derived."""

    def __init__(self, spark, sf_dir: str, house: Warehouse):
        super().__init__(spark, sf_dir)
        self.claims, self.crosswalk, self.land, self.index = house.claims, house.crosswalk, house.land, house.index


def timed(build) -> float:
    """Seconds to plan and run; rows go to a sink that drops them."""
    start = time.perf_counter()
    build().write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def raw_files(spark, standins: Standins) -> RawFiles:
    """The stand-in tables as raw text in file order; columns they lack are empty."""

    def put(df, names, sep=",") -> str:
        cells = [F.col(n) if n in df.columns else F.lit(None).cast("string").alias(n) for n in names]
        return write_csv(df.select(*cells), scratch_path(spark, "raw"), sep=sep)

    index = standins.index.select(F.make_date("cpi_year", F.lit(1), F.lit(1)).alias("observation_date"), "cpi_value")
    return RawFiles(
        claims=put(standins.claims, schemas.CLAIMS_FILE_ORDER),
        crosswalk=put(standins.crosswalk, schemas.CROSSWALK.names),
        land=put(standins.land, schemas.LAND_COVER.names, "\t"),
        index=put(index, schemas.PRICE_INDEX_FILE.names),
    )


def load(spark, standins: Standins) -> tuple[Warehouse, float]:
    house = Warehouse(spark, scratch_path(spark, "bench"))
    start = time.perf_counter()
    write_by_year(standins.claims, house.folder("claims"))
    for name in ("crosswalk", "land", "index"):
        getattr(standins, name).write.parquet(house.folder(name))
    return house, round(time.perf_counter() - start, 3)


def main() -> None:
    spark = local_session(cores=CPUS, shuffle_partitions=CPUS, memory=os.environ.get("BENCH_MEMORY", "12g"))
    spark.sparkContext.setLogLevel("ERROR")
    raw = Standins(spark, SF_DIR)
    timed(lambda: report_checks.trend(raw))  # start-up
    seconds: dict[str, float] = {}
    files = raw_files(spark, raw)
    start = time.perf_counter()
    load_text(spark, files, scratch_path(spark, "text-house"))
    seconds["text_load"] = round(time.perf_counter() - start, 3)
    house, seconds["load"] = load(spark, raw)
    stored = Loaded(spark, SF_DIR, house)
    for name, build, _ in report_checks.checks():
        seconds[name] = timed(lambda: build(stored))
    registered = {
        name: build for m in (load_checks, set_checks, report_checks) for name, build, _ in m.checks()
    }
    for name in RAW:
        seconds[f"raw_{name}"] = timed(lambda: registered[name](raw))
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    remove_scratch(spark)
    spark.stop()


if __name__ == "__main__":
    main()

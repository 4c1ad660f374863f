"""``spark-submit`` entry: load raw files, audit a load, or export a report or summary as CSV.

    python -m claimscope load WAREHOUSE --claims F --crosswalk F --land F --index F
    python -m claimscope audit WAREHOUSE --claims F
    python -m claimscope report NAME WAREHOUSE OUT
    python -m claimscope summary NAME WAREHOUSE OUT
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from claimscope.operators.clean import duplicate_keys
from claimscope.operators.quality import reconcile
from claimscope.plans import reports, summaries
from claimscope.plans.load import RawFiles, load
from claimscope.plans.tables import Warehouse
from claimscope.session import remove_scratch
from claimscope.sources.delimited import read_raw_claims, write_csv
from claimscope.sources.tables import stored

REPORTS = {
    f.__name__: f
    for f in (
        reports.macro_trend,
        reports.archetype_cost,
        reports.impervious_buckets,
        reports.flash_vs_river,
        reports.storm_control,
        reports.bucket_frequency_real,
        reports.bucket_nominal,
        reports.flash_vs_river_counts,
        reports.storm_nominal,
        reports.trend_nominal,
        reports.bucket_frequency_nominal,
        reports.damage_severity,
        reports.sprawl_delta,
        reports.trend_real_preaggregated,
    )
}


# Each summary with the report it is made of.
SUMMARIES = {
    "trend_series": (summaries.trend_series, reports.macro_trend),
    "bucket_totals": (summaries.bucket_totals, reports.impervious_buckets),
    "bucket_weighted_average": (summaries.bucket_weighted_average, reports.impervious_buckets),
    "band_trend": (summaries.band_trend, reports.impervious_buckets),
    "heatmap_volume": (summaries.heatmap_volume, reports.impervious_buckets),
    "heatmap_severity": (summaries.heatmap_severity, reports.impervious_buckets),
    "flood_type_mix": (summaries.flood_type_mix, reports.flash_vs_river),
    "storm_environment": (summaries.storm_environment, reports.storm_control),
    "top_storms": (summaries.top_storms, reports.storm_control),
}


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="claimscope")
    commands = parser.add_subparsers(dest="command", required=True)
    loading = commands.add_parser("load")
    loading.add_argument("warehouse")
    for name in ("claims", "crosswalk", "land", "index"):
        loading.add_argument(f"--{name}", required=True)
    loading.add_argument("--places")
    loading.add_argument("--blank-numeric", choices=("null", "zero"), default="null")
    loading.add_argument("--multi-line", action="store_true", help="line ends inside quoted cells, in all feeds")
    loading.add_argument("--refuse", action="store_true", help="fail unless the load is clean")
    loading.add_argument("--buckets", type=int, help="bucket tables by postal code and area")
    auditing = commands.add_parser("audit")
    auditing.add_argument("warehouse")
    auditing.add_argument("--claims", required=True)
    for command, names in (("report", REPORTS), ("summary", SUMMARIES)):
        one = commands.add_parser(command)
        one.add_argument("name", choices=sorted(names))
        one.add_argument("warehouse")
        one.add_argument("out")
    args = parser.parse_args(argv)

    spark = SparkSession.builder.appName("claimscope").getOrCreate()
    if args.command == "load":
        raw = RawFiles(args.claims, args.crosswalk, args.land, args.index, args.places)
        print(load(spark, raw, args.warehouse, args.blank_numeric, args.multi_line, args.refuse, args.buckets).report)
    elif args.command == "audit":
        house = Warehouse(spark, args.warehouse)
        reconcile(read_raw_claims(spark, args.claims), house.claims).show()
        duplicate_keys(house.claims, ["id"]).orderBy("id").show(20, truncate=False)
    elif args.command == "report":
        write_csv(REPORTS[args.name](Warehouse(spark, args.warehouse)), args.out, one_file=True)
    else:
        summary, report = SUMMARIES[args.name]
        # Summaries read their report several times.
        result = summary(stored(report(Warehouse(spark, args.warehouse)), args.name))
        write_csv(result, args.out, one_file=True)
        remove_scratch(spark)


if __name__ == "__main__":
    main()

"""The figures behind each chart, computed from report results.

A summary takes the report as a DataFrame, fresh from its plan or read back from an
export, so no file lies between report and chart.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimscope import constants as K
from claimscope.functions.landcover import FLOOD_TYPE_SCHEME, Scheme, density_band
from claimscope.functions.text import count_label, without_rank_prefix, wrapped_label
from claimscope.operators.aggregates import median_of_counts, value_counts, weighted_average
from claimscope.operators.ordering import in_declared_order, rows_of_top_keys
from claimscope.operators.reshape import only_known, pivot_cells, pivot_mean
from claimscope.plans.reports import BUCKET


def trend_series(trend: DataFrame, base_year: int = K.BASE_YEAR) -> DataFrame:
    """Both trend charts: counts, real total and the three shares in percent."""
    return trend.select(
        "yearOfLoss",
        "total_claims",
        f"real_total_paid_out_{base_year}",
        *[
            (F.col(c) * 100).alias(c)
            for c in ("pct_severe_above_ground_floods", "pct_basement_floods", "pct_primary_residence")
        ],
    ).orderBy("yearOfLoss")


def bucket_totals(buckets: DataFrame) -> DataFrame:
    """Claims per bucket over all years."""
    return buckets.groupBy(BUCKET).agg(F.sum("Total Claims").alias("Total Claims")).orderBy(BUCKET)


def bucket_weighted_average(buckets: DataFrame, base_year: int = K.BASE_YEAR) -> DataFrame:
    """Payment per claim and bucket over all years, weighted by claims."""
    return weighted_average(
        buckets,
        [BUCKET],
        f"Total Payouts ({base_year} Dollars)",
        "Total Claims",
        f"Weighted Avg Payout ({base_year}$)",
        13,
    ).orderBy(BUCKET)


def band_trend(buckets: DataFrame) -> DataFrame:
    """Claims per year and density band."""
    band = density_band(F.col(BUCKET)).alias("Impervious Category")
    return buckets.groupBy("Year", band).agg(F.sum("Total Claims").alias("Total Claims")).orderBy(
        "Year", "Impervious Category"
    )


def heatmap(buckets: DataFrame, cell: str, years: Sequence[int] | None = None) -> DataFrame:
    """Bucket by year matrix, highest bucket first.

    Without ``years`` there is a column for every year of the report, which is then computed,
    once, when the matrix is built. Given years must hold all of the report's.
    """
    typed = buckets.withColumn("Year", F.col("Year").cast("int"))
    return pivot_cells(typed, BUCKET, "Year", years, cell).orderBy(F.desc(BUCKET))


def heatmap_volume(buckets: DataFrame, years: Sequence[int] | None = None) -> DataFrame:
    """Claims by bucket and year."""
    return heatmap(buckets, "Total Claims", years)


def heatmap_severity(
    buckets: DataFrame, years: Sequence[int] | None = None, base_year: int = K.BASE_YEAR
) -> DataFrame:
    """Average payment by bucket and year."""
    return heatmap(buckets, f"Avg Payout per Claim ({base_year} Dollars)", years)


def flood_type_mix(
    mix: DataFrame,
    scheme: Scheme = FLOOD_TYPE_SCHEME,
    flood_types: Sequence[str] = (K.RAIN_LABEL, K.RIVER_LABEL),
) -> DataFrame:
    """Percent, count and bar label per environment (in declared order) and flood type.

    ``scheme`` is the one the report was made with. An environment or flood type that it
    does not declare stops the query. A cell without a positive percentage has no label.
    """
    environments = [rule.label for rule in scheme.rules]
    known = mix.withColumn("environment_type", only_known("environment_type", environments))
    both = pivot_mean(
        known, "environment_type", "flood_type", flood_types, "percent_of_environment", "total_incidents"
    ).withColumnsRenamed(
        {f"{f}_percent_of_environment": f"{f} percent" for f in flood_types}
        | {f"{f}_total_incidents": f"{f} incidents" for f in flood_types}
    )
    labels = {
        f"{f} label": F.when(
            F.col(f"{f} percent") > 0,
            count_label(F.col(f"{f} incidents").cast("bigint"), F.col(f"{f} percent")),
        )
        for f in flood_types
    }
    return in_declared_order(both.withColumns(labels), "environment_type", environments)


def storm_environment(storms: DataFrame, base_year: int = K.BASE_YEAR) -> DataFrame:
    """Incidents per environment with the plain mean and median of its group averages,
    most incidents first.

    The report is computed once, whether it was stored or not: totals and median are taken
    from one count of its rows.
    """
    average = f"avg_building_payout_{base_year}_dollars"
    named = storms.select(
        without_rank_prefix(F.col("environment_type")).alias("env_short"),
        wrapped_label(F.col("environment_type")).alias("env_label"),
        "total_incidents",
        average,
    )
    counted = value_counts(named, "env_short", average, "env_label", "total_incidents")
    # Every row again: a mean keeps more digits than a product of wide decimals has room for.
    each = counted.select("*", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("_copy"))
    totals = each.groupBy("env_short").agg(
        F.max("env_label").alias("env_label"),
        F.sum("total_incidents").alias("total_incidents_sum"),
        F.avg(average).alias("avg_payout_mean"),
    )
    middle = median_of_counts(counted, "env_short", average, "median_payout")
    return totals.join(middle, "env_short", "left").orderBy(F.desc("total_incidents_sum"))


def top_storms(storms: DataFrame, n: int = 5) -> DataFrame:
    """Detail rows of the ``n`` storm names with the most incidents."""
    return rows_of_top_keys(storms, "floodEventName", "total_incidents", n).withColumn(
        "env_short", without_rank_prefix(F.col("environment_type"))
    )

"""The fourteen reports.

All follow one shape. Claims are narrowed and summed per postal code first, inside each
task and then over one shuffle; everything after that works on the summary, whose size
is bounded by postal codes times years (times storms), not by claims. The summary then
meets the crosswalk, the classified land rows and the price index.

The crosswalk is many-to-one and every later measure is a plain sum, so summing again
per area before the land join would only add a shuffle; only the storm reports do it,
because they pick one event name per area.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimscope import constants as K
from claimscope.functions.landcover import (
    COST_SCHEME,
    FLOOD_TYPE_SCHEME,
    Scheme,
    impervious_percent,
    severity_scheme,
    share,
    storm_scheme,
)
from claimscope.functions.money import (
    at_least,
    price_ratio,
    quotient,
    reported_ratio,
    restated,
    total_paid,
)
from claimscope.functions.text import cause_label, first_identity, fold, is_named
from claimscope.operators import aggregates as A
from claimscope.operators.joins import (
    annual_index,
    exact_matches,
    keep_members,
    real_dollar_claims,
    sums_to_area,
    sums_with_land,
    to_area,
    with_baseline,
    with_index,
    with_land,
    with_land_of_year,
    with_latest_land_year,
)
from claimscope.operators.windows import previous_year_value, share_of_total
from claimscope.plans.tables import Tables as FrameTables
from claimscope.plans.tables import Warehouse

Tables = FrameTables | Warehouse

BUCKET = "Percent Impervious Surface"
YEAR = "yearOfLoss"
STORM_TEXT = ("eventDesignationNumber", "floodEvent")


def _since(claims: DataFrame, first_year: int) -> DataFrame:
    return claims.filter(F.col(YEAR) >= first_year)


def macro_trend(t: Tables, first_year: int = K.FIRST_LAND_YEAR, base_year: int = K.BASE_YEAR) -> DataFrame:
    """Claims, real payments and flood character per loss year."""
    yearly = _since(t.claims, first_year).groupBy(YEAR).agg(
        A.claim_count().alias("total_claims"),
        A.nominal_paid().alias("nominal"),
        A.severe_count().alias("severe"),
        A.basement_count().alias("basement"),
        A.primary_count().alias("primary"),
    )
    priced = with_index(yearly, with_baseline(t.index, base_year))
    # an index with several values a year splits the year, one row per value
    per_value = A.roll_up(
        priced, [YEAR, "cpi_value", "baseline"], "total_claims", "nominal", "severe", "basement", "primary"
    )
    return per_value.select(
        YEAR,
        "total_claims",
        restated(F.col("nominal"), price_ratio(F.col("baseline"), F.col("cpi_value"))).alias(
            f"real_total_paid_out_{base_year}"
        ),
        A.rate("severe", "total_claims").alias("pct_severe_above_ground_floods"),
        A.rate("basement", "total_claims").alias("pct_basement_floods"),
        A.rate("primary", "total_claims").alias("pct_primary_residence"),
    ).orderBy(YEAR)


def archetype_cost(t: Tables, scheme: Scheme = COST_SCHEME, base_year: int = K.BASE_YEAR) -> DataFrame:
    """Average building payment per land archetype, nominal and real, over all claims
    and over claims with a building payment."""
    located = t.claims.filter(F.col(YEAR).isNotNull() & F.col("reportedZipCode").isNotNull())
    by_zip = A.by_zip(
        located, [YEAR], claims=A.claim_count(), building_claims=A.building_claim_count(), nominal=A.building_paid()
    )
    priced = with_index(to_area(by_zip, t.crosswalk), with_baseline(annual_index(t.index), base_year))
    real = restated(F.col("nominal"), price_ratio(F.col("baseline"), F.col("cpi_value")), 13)
    classed = with_land(priced.withColumn("real", real), t.land, scheme.label().alias("land_archetype"))
    sums = A.roll_up(classed, ["land_archetype"], "claims", "building_claims", "nominal", "real")
    damaged = F.nullif(F.col("building_claims"), F.lit(0))
    average = f"true_avg_{base_year}_building_payout"
    return sums.select(
        "land_archetype",
        F.col("claims").alias("total_claims_in_archetype"),
        damaged.alias("true_total_claims_in_archetyp"),
        quotient(F.col("nominal"), F.col("claims"), 6, 2).alias("avg_nominal_payout_all_claims"),
        quotient(F.col("real"), F.col("claims"), 17, 13).alias(f"avg_{base_year}_payout_all_claims"),
        quotient(F.col("nominal"), damaged, 6, 2).alias("true_nominal_payout_all_claims"),
        quotient(F.col("real"), damaged, 17, 13).alias(average),
    ).orderBy(F.desc(average))


def impervious_buckets(t: Tables, first_year: int = K.FIRST_LAND_YEAR, base_year: int = K.BASE_YEAR) -> DataFrame:
    """Claims and real payments per loss year and ten-percent band of developed land."""
    by_zip = A.by_zip(_since(t.claims, first_year), [YEAR], claims=A.claim_count(), nominal=A.nominal_paid())
    land = t.land.filter(F.col("YEAR") >= first_year)
    bucketed = with_land(to_area(by_zip, t.crosswalk), land, impervious_percent().alias(BUCKET))
    priced = with_index(bucketed, with_baseline(t.index, base_year))
    sums = A.roll_up(priced, [YEAR, BUCKET, "cpi_value", "baseline"], "claims", "nominal")
    real = restated(F.col("nominal"), reported_ratio(F.col("baseline"), F.col("cpi_value")))
    return (
        sums.withColumn("real", real)
        .select(
            F.col(YEAR).alias("Year"),
            BUCKET,
            F.col("claims").alias("Total Claims"),
            quotient(F.col("real"), F.col("claims"), 13, 9).alias(f"Avg Payout per Claim ({base_year} Dollars)"),
            F.col("real").alias(f"Total Payouts ({base_year} Dollars)"),
        )
        .orderBy(F.desc("Year"), F.asc(BUCKET))
    )


def _flood_type_counts(t: Tables, scheme: Scheme, codes: Sequence[str]) -> DataFrame:
    causes = t.claims.filter(F.col("causeOfDamage").isin(list(codes)))
    by_zip = A.by_zip(causes, [YEAR, "causeOfDamage"], claims=A.claim_count())
    classed = t.land.withColumn("environment_type", scheme.label()).filter(
        F.col("environment_type") != scheme.otherwise
    )
    placed = with_land(to_area(by_zip, t.crosswalk), classed, F.col("environment_type"))
    flood_type = cause_label(F.col("causeOfDamage"), {K.RIVER_CODE: K.RIVER_LABEL}, K.RAIN_LABEL)
    return placed.groupBy("environment_type", flood_type.alias("flood_type")).agg(
        F.sum("claims").alias("total_incidents")
    )


def flash_vs_river(
    t: Tables, scheme: Scheme = FLOOD_TYPE_SCHEME, codes: Sequence[str] = (K.RIVER_CODE, K.RAIN_CODE)
) -> DataFrame:
    """River against rain floods in paved and natural areas, with percentages."""
    counts = _flood_type_counts(t, scheme, codes)
    return share_of_total(counts, "total_incidents", "environment_type", "percent_of_environment").orderBy(
        "environment_type", "flood_type"
    )


def flash_vs_river_counts(
    t: Tables, scheme: Scheme = FLOOD_TYPE_SCHEME, codes: Sequence[str] = (K.RIVER_CODE, K.RAIN_CODE)
) -> DataFrame:
    """The same without percentages."""
    return _flood_type_counts(t, scheme, codes).orderBy("environment_type", "flood_type")


def storm_id() -> Column:
    """Event number, or event name where the number is blank."""
    return first_identity(*[F.col(c) for c in STORM_TEXT])


def major_storms(counted: DataFrame, generic: Sequence[str], min_claims: int, case_sensitive: bool) -> DataFrame:
    """Keys of the storms with more than ``min_claims`` claims, generic names not counted.

    ``counted`` holds claims per storm id, event name and whatever else.
    """
    named = counted.filter(is_named(F.col("floodEvent"), generic, case_sensitive))
    sizes = named.groupBy(fold(F.col("storm_id"), case_sensitive).alias("storm_key")).agg(F.sum("claims").alias("claims"))
    return sizes.filter(F.col("claims") > min_claims).select("storm_key")


def _largest_spelling(column: str, case_sensitive: bool) -> Column:
    """The last spelling in comparison order."""
    return F.max(F.struct(fold(F.col(column), case_sensitive).alias("k"), F.col(column).alias("v")))["v"]


def _storms_by_zip(claims: DataFrame, case_sensitive: bool, /, **measures: Column) -> DataFrame:
    """First level per storm, event name, year and postal code.

    The name is part of the key here although one name per area is wanted later: a
    maximum over text cannot use hash aggregation, so it is left to the small summary.
    """
    known = claims.withColumn("storm_id", storm_id()).filter(F.col("storm_id").isNotNull())
    by_zip = A.by_zip(known, ["storm_id", "floodEvent", YEAR], **measures)
    return by_zip.withColumn("storm_key", fold(F.col("storm_id"), case_sensitive))


def _storms_by_area(by_zip: DataFrame, crosswalk: DataFrame, case_sensitive: bool, *sums: str) -> DataFrame:
    """Second level per storm, year and area, naming the storm by its last event name.

    The rows are dealt by area and year before they are summed: a maximum over text sorts its
    rows, which so happens once, on even partitions, in the order the land join needs.
    """
    dealt = sums_to_area(by_zip, crosswalk, *sums).repartition("zcta", YEAR)
    return dealt.groupBy("zcta", YEAR, "storm_key").agg(
        F.max("storm_id").alias("storm_id"),
        _largest_spelling("floodEvent", case_sensitive).alias("floodEventName"),
        *[F.sum(s).alias(s) for s in sums],
    ).withColumn("name_key", fold(F.col("floodEventName"), case_sensitive))


def _storm_sums(placed: DataFrame, keys: Sequence[str], *sums: str) -> DataFrame:
    """Last level per storm, name and ``keys``, under the last spelling of both.

    Spellings are kept apart at first, so that the rows combine by hash inside each task and
    only their small summary is sorted.
    """
    group, shown = ["storm_key", "name_key", *keys], ["storm_id", "floodEventName"]
    spelled = A.roll_up(placed, [*group, *shown], *sums)
    return spelled.groupBy(*group).agg(*[F.max(c).alias(c) for c in shown], *[F.sum(s).alias(s) for s in sums])


def storm_control(
    t: Tables,
    generic: Sequence[str] = K.GENERIC_EVENT_NAMES,
    min_claims: int = K.MAJOR_STORM_CLAIMS,
    scheme: Scheme | None = None,
    base_year: int = K.BASE_YEAR,
    case_sensitive: bool = False,
    scratch: str | None = None,
) -> DataFrame:
    """Real building payment per major storm and environment.

    Generic names are left out when storms are sized but not from the detail rows. A
    name that varies within a storm yields one row per name.

    Nothing runs until the result is read: storms are sized by a scan of their two name
    columns, besides the one for the detail. With ``scratch``, a new folder that all
    executors reach, the first-level sums are written there at once and serve both, so the
    claims are scanned once.
    """
    scheme = scheme or storm_scheme()
    by_zip = _storms_by_zip(
        t.claims,
        case_sensitive,
        claims=A.claim_count(),
        building_claims=A.building_claim_count(),
        nominal=A.building_paid(),
    )
    if scratch:
        by_zip.write.parquet(scratch)
        by_zip = sizes = by_zip.sparkSession.read.parquet(scratch)
    else:
        known = t.claims.withColumn("storm_id", storm_id()).filter(F.col("storm_id").isNotNull())
        sizes = known.groupBy("storm_id", "floodEvent").agg(A.claim_count().alias("claims"))
    detail = keep_members(by_zip, major_storms(sizes, generic, min_claims, case_sensitive), "storm_key")
    measures = ("claims", "building_claims", "nominal")
    by_area = _storms_by_area(detail, t.crosswalk, case_sensitive, *measures)
    placed = sums_with_land(by_area, t.land, scheme.label().alias("environment_type"), *measures)
    priced = with_index(placed, with_baseline(t.index, base_year))
    sums = _storm_sums(priced, [YEAR, "environment_type", "cpi_value", "baseline"], *measures)
    real = restated(F.col("nominal"), reported_ratio(F.col("baseline"), F.col("cpi_value")))
    return (
        sums.withColumn("real", real)
        .select(
            "storm_id",
            "floodEventName",
            YEAR,
            "environment_type",
            F.col("claims").alias("total_incidents"),
            quotient(F.col("real"), F.col("building_claims"), 13, 9).alias(
                f"avg_building_payout_{base_year}_dollars"
            ),
            F.col("real").alias(f"total_building_payout_{base_year}_dollars"),
        )
        .orderBy("storm_id", "environment_type")
    )


def bucket_frequency_real(t: Tables, year: int = K.BASE_YEAR, base_year: int = K.BASE_YEAR) -> DataFrame:
    """One year by bucket: claims, claims per hundred policies, real payments."""
    view = real_dollar_claims(t.claims.filter(F.col(YEAR) == year), t.index, base_year)
    by_zip = A.by_zip(
        view, claims=A.claim_count(), policies=F.sum("policyCount"), real=F.sum(f"real_total_paid_{base_year}")
    )
    placed = with_land_of_year(to_area(by_zip, t.crosswalk), t.land, year, impervious_percent().alias(BUCKET))
    return (
        A.roll_up(placed, [BUCKET], "claims", "policies", "real")
        .select(
            BUCKET,
            F.col("claims").alias("Total Claims"),
            A.per_hundred("claims", "policies").alias("Claims per 100 Policies"),
            quotient(F.col("real"), F.col("claims"), 13, 9).alias(f"Average Payout ({base_year} Dollars)"),
            F.col("real").alias(f"Total Payouts ({base_year} Dollars)"),
        )
        .orderBy(BUCKET)
    )


def _bucket_nominal(t: Tables, year: int) -> DataFrame:
    one_year = t.claims.filter(F.col(YEAR) == year)
    by_zip = A.by_zip(
        one_year,
        claims=A.claim_count(),
        nominal=A.building_paid(),
        policies=F.sum(at_least(F.col("policyCount"))),
    )
    placed = with_land_of_year(to_area(by_zip, t.crosswalk), t.land, year, impervious_percent().alias(BUCKET))
    return A.roll_up(placed, [BUCKET], "claims", "nominal", "policies").select(
        BUCKET,
        F.col("claims").alias("Total Claims"),
        quotient(F.col("nominal"), F.col("claims"), 6, 2).alias("Average Payout Per Claim ($)"),
        F.col("nominal").alias("Total Payouts"),
        A.per_hundred("claims", "policies").alias("Claims per 100 Policies"),
    )


def bucket_nominal(t: Tables, year: int = K.BASE_YEAR) -> DataFrame:
    """One year by bucket: claims and nominal building payments."""
    return _bucket_nominal(t, year).drop("Claims per 100 Policies").orderBy(BUCKET)


def bucket_frequency_nominal(t: Tables, year: int = K.BASE_YEAR) -> DataFrame:
    """The same with claims per hundred policies, every claim covering at least one."""
    return _bucket_nominal(t, year).orderBy(BUCKET)


def storm_nominal(
    t: Tables,
    generic: Sequence[str] = K.GENERIC_EVENT_NAMES,
    min_claims: int = K.STORM_GROUP_CLAIMS,
    scheme: Scheme | None = None,
    case_sensitive: bool = False,
) -> DataFrame:
    """Nominal building payment per storm and environment, generic names left out."""
    scheme = scheme or storm_scheme()
    named = t.claims.filter(is_named(F.col("floodEvent"), generic, case_sensitive))
    by_zip = _storms_by_zip(named, case_sensitive, claims=A.claim_count(), nominal=A.building_paid())
    by_area = _storms_by_area(by_zip, t.crosswalk, case_sensitive, "claims", "nominal")
    placed = sums_with_land(by_area, t.land, scheme.label().alias("environment_type"), "claims", "nominal")
    sums = _storm_sums(placed, ["environment_type"], "claims", "nominal")
    return (
        sums.withColumnRenamed("claims", "total_claims")
        .filter(F.col("total_claims") > min_claims)
        .select(
            "storm_id",
            "floodEventName",
            "environment_type",
            "total_claims",
            quotient(F.col("nominal"), F.col("total_claims"), 6, 2).alias("avg_payout"),
        )
        .orderBy("floodEventName", "environment_type")
    )


def trend_nominal(t: Tables, first_year: int = K.FIRST_LAND_YEAR) -> DataFrame:
    """Claims, nominal payments, mean water depth and primary residences per year."""
    yearly = _since(t.claims, first_year).groupBy(YEAR).agg(
        A.claim_count().alias("total_claims"),
        A.nominal_paid().alias("total_paid_out"),
        F.sum("waterDepth").alias("depth"),
        F.count("waterDepth").alias("depths"),
        A.primary_count().alias("primary"),
    )
    return yearly.select(
        YEAR,
        "total_claims",
        "total_paid_out",
        A.rate("depth", "depths").alias("average_water_depth_inches"),
        A.rate("primary", "total_claims").alias("pct_primary_residence"),
    ).orderBy(YEAR)


def damage_severity(
    t: Tables,
    first_year: int = K.FIRST_LAND_YEAR,
    min_claims: int = K.SEVERITY_GROUP_CLAIMS,
    scheme: Scheme | None = None,
) -> DataFrame:
    """Percent of building value destroyed per environment, on the latest land year known
    at the time of loss."""
    scheme = scheme or severity_scheme()
    valued = _since(t.claims, first_year).filter(F.col("buildingPropertyValue") > 0)
    payment = total_paid(F.col("amountPaidOnBuildingClaim"), F.col("amountPaidOnContentsClaim"))
    destroyed = quotient(payment * 100, F.col("buildingPropertyValue"), 6, 2)
    by_zip = A.by_zip(
        valued, [YEAR], total_claims=A.claim_count(), payout=F.sum(payment), destroyed=F.sum(destroyed)
    )
    by_area = with_latest_land_year(to_area(by_zip, exact_matches(t.crosswalk)), t.land)
    placed = with_land(by_area, t.land, scheme.label().alias("environment_type"), year="land_year")
    sums = A.roll_up(placed, ["environment_type"], "total_claims", "payout", "destroyed")
    return (
        sums.filter(F.col("total_claims") > min_claims)
        .select(
            "environment_type",
            "total_claims",
            quotient(F.col("payout"), F.col("total_claims"), 6, 2).alias("avg_absolute_payout"),
            quotient(F.col("destroyed"), F.col("total_claims"), 10, 6).alias("avg_percent_value_destroyed"),
        )
        .orderBy(F.desc("avg_percent_value_destroyed"))
    )


def rapid_growth(land: DataFrame, years: tuple[int, int], growth: str) -> DataFrame:
    """Areas whose developed share grew by more than ``growth`` between the two years."""
    pairs = previous_year_value(land, share(K.DEVELOPED), years, "developed", "before")
    rise = F.col("developed") - F.col("before")
    return pairs.filter((F.col("YEAR") == years[1]) & (rise > F.lit(growth).cast("decimal(15,13)"))).select(
        F.col("ZCTA20").alias("zcta"), rise.alias("growth")
    )


def sprawl_delta(
    t: Tables,
    years: tuple[int, int] = K.SPRAWL_YEARS,
    before: tuple[int, int] = K.SPRAWL_BEFORE,
    after: tuple[int, int] = K.SPRAWL_AFTER,
    growth: str = K.SPRAWL_GROWTH,
    min_before: int = K.SPRAWL_BASELINE_CLAIMS,
) -> DataFrame:
    """Claims before and after in areas that were quickly built over."""
    in_before, in_after = F.col(YEAR).between(*before), F.col(YEAR).between(*after)
    by_zip = A.by_zip(
        t.claims.filter(in_before | in_after), before=F.count_if(in_before), after=F.count_if(in_after)
    )
    grown = rapid_growth(t.land, years, growth)
    by_area = A.roll_up(
        to_area(by_zip, exact_matches(t.crosswalk)).join(grown, "zcta"), ["zcta", "growth"], "before", "after"
    )
    multiplier = "Post-Paving Claim Multiplier"
    return (
        by_area.filter(F.col("before") > min_before)
        .select(
            F.col("zcta").alias("ZCTA Code"),
            F.round(F.col("growth") * 100, 2).alias("Impervious Growth (%)"),
            F.col("before").alias(f"Claims ({before[0]}-{before[1]})"),
            F.col("after").alias(f"Claims ({after[0]}-{after[1]})"),
            A.rate("after", "before", 2).alias(multiplier),
        )
        .orderBy(F.desc(multiplier))
    )


def trend_real_preaggregated(
    t: Tables, first_year: int = K.FIRST_LAND_YEAR, base_year: int = K.BASE_YEAR
) -> DataFrame:
    """Nominal and real payments per year, one row per index value of the year."""
    yearly = _since(t.claims, first_year).groupBy(YEAR).agg(
        A.claim_count().alias("total_claims"), A.nominal_paid().alias("nominal_payout")
    )
    priced = with_index(yearly, with_baseline(t.index, base_year))
    return priced.select(
        YEAR,
        "total_claims",
        "nominal_payout",
        restated(F.col("nominal_payout"), price_ratio(F.col("baseline"), F.col("cpi_value"))).alias(
            f"real_payout_{base_year}_dollars"
        ),
    ).orderBy(YEAR)

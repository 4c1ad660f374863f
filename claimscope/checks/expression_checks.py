"""Filters, classifications and scalar functions over the stand-in tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimscope import constants as K
from claimscope.checks.oracle_parts import COST_CASE, DEVELOPED, FLOOD_TYPE_CASE, STORM_CASE, dbl, quo, severity_case, with_views
from claimscope.checks.report_checks import BASE, FIRST, GENERIC, GENERIC_SQL, MIX, MIX_SHARE, TREND, trend
from claimscope.checks.standins import Standins
from claimscope.functions import landcover as L
from claimscope.functions import money as M
from claimscope.functions import text as X
from claimscope.operators import joins
from claimscope.plans import reports as R


def kept(condition):
    """Query keeping the claims that meet a condition."""
    return lambda s: s.claims.filter(condition()).select("id", "yearOfLoss", "clean_zip")


def kept_sql(condition: str) -> str:
    return with_views(f"select id, yearOfLoss, clean_zip from claims where {condition}")


def on_claims(**columns):
    """Query deriving columns for every claim."""
    return lambda s: s.claims.select("id", *[make().alias(name) for name, make in columns.items()])


def on_land(**columns):
    """Query deriving columns for every area and year."""
    return lambda s: s.land.select("ZCTA20", "YEAR", *[make().alias(name) for name, make in columns.items()])


def amounts():
    return F.col("amountPaidOnBuildingClaim"), F.col("amountPaidOnContentsClaim")


def filters():
    yield "filter_eq_year", kept(lambda: F.col("yearOfLoss") == BASE), kept_sql(f"yearOfLoss = {BASE}")
    yield (
        "filter_year_floor",
        kept(lambda: F.col("yearOfLoss").isNotNull() & (F.col("yearOfLoss") >= FIRST)),
        kept_sql(f"yearOfLoss >= {FIRST}"),
    )
    yield (
        "filter_not_null",
        kept(lambda: F.col("amountPaidOnBuildingClaim").isNotNull()),
        kept_sql("amountPaidOnBuildingClaim is not null"),
    )
    yield (
        "filter_in_list",
        kept(lambda: F.col("causeOfDamage").isin(K.RIVER_CODE, K.RAIN_CODE)),
        kept_sql("causeOfDamage in ('2', '4')"),
    )
    yield (
        "filter_not_in_or_null",
        kept(lambda: X.is_named(F.col("floodEvent"), GENERIC)),
        kept_sql(GENERIC_SQL),
    )
    yield (
        "filter_not_equal",
        lambda s: s.land.select("ZCTA20", "YEAR", L.FLOOD_TYPE_SCHEME.label().alias("environment_type")).filter(
            F.col("environment_type") != "Mixed"
        ),
        with_views(
            f"""select * from (select ZCTA20, YEAR, {FLOOD_TYPE_CASE} as environment_type from land)
            where environment_type <> 'Mixed'"""
        ),
    )
    yield (
        "filter_positive_denominator",
        kept(lambda: F.col("buildingPropertyValue") > 0),
        kept_sql("buildingPropertyValue > 0"),
    )
    yield (
        "filter_arith_delta",
        lambda s: R.rapid_growth(s.land, (1997, 1999), K.SPRAWL_GROWTH),
        with_views(
            f"""select a.ZCTA20 as zcta, {dbl("b.d - a.d")} as growth
            from (select ZCTA20, {DEVELOPED} as d from land where YEAR = 1997) a
            join (select ZCTA20, {DEVELOPED} as d from land where YEAR = 1999) b using (ZCTA20)
            where b.d - a.d > 0.05"""
        ),
    )
    yield (
        "filter_match_quality",
        lambda s: joins.to_area(s.claims.select("id", "clean_zip"), joins.exact_matches(s.crosswalk)),
        with_views(
            """select id, zcta from claims join crosswalk on clean_zip = zip_code
            where zip_join_type = 'Zip matches ZCTA' and zcta is not null"""
        ),
    )


def values():
    yield (
        "clamp_paid_amount",
        on_claims(paid=lambda: M.total_paid(*amounts())),
        with_views(f"select id, {dbl('both_paid')} as paid from paid"),
    )
    yield (
        "default_and_floor",
        on_claims(policies=lambda: M.at_least(F.col("policyCount"))),
        with_views("select id, greatest(coalesce(policyCount, 1), 1) as policies from claims"),
    )
    yield (
        "classify_archetype_3way",
        on_land(half=L.COST_SCHEME.label, two_fifths=L.FLOOD_TYPE_SCHEME.label),
        with_views(
            f"""select ZCTA20, YEAR, {COST_CASE} as half,
            {FLOOD_TYPE_CASE} as two_fifths from land"""
        ),
    )
    yield (
        "classify_archetype_6way",
        on_land(label=L.storm_scheme().label),
        with_views(f"select ZCTA20, YEAR, {STORM_CASE} as label from land"),
    )
    yield (
        "classify_archetype_5way",
        on_land(label=L.severity_scheme().label, lower=L.severity_scheme(high="0.3", wet="0.3").label),
        with_views(f"select ZCTA20, YEAR, {severity_case()} as label, {severity_case('0.3', '0.3')} as lower from land"),
    )
    yield (
        "bucket_decile_pct",
        on_land(bucket=L.impervious_percent),
        with_views("select ZCTA20, YEAR, bucket from bucketed"),
    )
    yield (
        "band_low_med_high",
        on_land(band=lambda: L.density_band(L.impervious_percent())),
        with_views(
            """select ZCTA20, YEAR, case when bucket <= 30 then 'Low (0-30%)' when bucket <= 60
            then 'Medium (40-60%)' else 'High (70-100%)' end as band from bucketed"""
        ),
    )
    yield (
        "decode_code_label",
        on_claims(
            flood_type=lambda: X.cause_label(F.col("causeOfDamage"), {K.RIVER_CODE: K.RIVER_LABEL}, K.RAIN_LABEL)
        ),
        with_views(
            """select id, case causeOfDamage when '2' then 'River/Stream Overflow'
            else 'Flash Flood (Rain Accumulation)' end as flood_type from claims"""
        ),
    )
    yield "coalesce_identity", on_claims(storm_id=R.storm_id), with_views("select id, storm_id from paid")
    yield (
        "project_renamed",
        lambda s: s.claims.select(
            F.col("id").alias("Claim Number"), F.col("yearOfLoss").alias("Loss Year (calendar)")
        ),
        with_views('select id as "Claim Number", yearOfLoss as "Loss Year (calendar)" from claims'),
    )


def scalars():
    yield (
        "scalar_trim_left",
        on_claims(zip5=lambda: X.zip5(F.col("reportedZipCode"))),
        with_views("select id, left(trim(reportedZipCode), 5) as zip5 from claims"),
    )
    yield (
        "scalar_nullif_coalesce",
        on_claims(
            contents=lambda: F.coalesce(amounts()[1], F.lit(0).cast("decimal(12,2)")),
            value=lambda: F.nullif(F.col("buildingPropertyValue"), F.lit(0)),
        ),
        with_views(
            f"""select id, {dbl("coalesce(amountPaidOnContentsClaim, 0)")} as contents,
            nullif(buildingPropertyValue, 0) as value from claims"""
        ),
    )
    yield (
        "scalar_greatest",
        on_claims(building=lambda: M.paid(amounts()[0]), depth=lambda: F.greatest(F.col("waterDepth"), F.lit(0))),
        with_views(f"select id, {dbl('building')} as building, greatest(waterDepth, 0) as depth from paid"),
    )
    yield (
        "scalar_round_n",
        on_land(
            whole=lambda: F.round(L.share(K.DEVELOPED) * 10),
            one=lambda: F.round(L.share(K.WETLAND), 1),
            two=lambda: F.round(L.share(K.WETLAND) * F.lit("1.5").cast("decimal(2,1)"), 2),
        ),
        with_views(
            f"""select ZCTA20, YEAR, {dbl(f"({DEVELOPED}) * 10", 0)} as whole,
            {dbl("PROP_WOODYWET + PROP_HERBWET", 1)} as one,
            {dbl("(PROP_WOODYWET + PROP_HERBWET) * cast(1.5 as decimal(2,1))", 2)} as two from land"""
        ),
    )
    yield (
        "scalar_year",
        on_claims(year=lambda: F.year("dateOfLoss")),
        with_views("select id, cast(year(dateOfLoss) as int) as year from claims"),
    )
    yield (
        "scalar_safe_multiplier",
        lambda s: s.claims.groupBy("clean_zip")
        .agg(
            F.count_if(F.col("yearOfLoss") >= 2000).alias("after"),
            F.count_if(F.col("yearOfLoss") < 1997).alias("before"),
        )
        .select("clean_zip", M.quotient(F.col("after"), F.col("before"), 2).alias("multiplier")),
        with_views(
            f"""select clean_zip, {quo("after", "before", 2)} as multiplier
            from (select clean_zip, count(*) filter (yearOfLoss >= 2000) as after,
                    count(*) filter (yearOfLoss < 1997) as before from claims group by clean_zip)"""
        ),
    )
    short, label = "env_short", "env_label"
    yield (
        "scalar_label_cleanup",
        lambda s: s.land.withColumn("label", L.storm_scheme().label()).select(
            "ZCTA20",
            "YEAR",
            X.without_rank_prefix(F.col("label")).alias(short),
            X.wrapped_label(F.col("label")).alias(label),
        ),
        with_views(
            f"""select ZCTA20, YEAR, split_part(label, '. ', 2) as {short},
            replace(split_part(label, '. ', 2), ' (', chr(10) || '(') as {label}
            from (select *, {STORM_CASE} as label from land)"""
        ),
    )
    yield (
        "scalar_to_int",
        on_claims(paid=lambda: M.total_paid(*amounts()).cast("int"), year=lambda: F.substring("dateOfLoss", 1, 4).cast("int")),
        with_views("select id, cast(trunc(both_paid) as int) as paid, yearOfLoss as year from paid"),
    )
    yield (
        "scalar_percent_scale",
        lambda s: trend(s).select("yearOfLoss", (F.col("pct_primary_residence") * 100).alias("percent")),
        with_views(
            f"""select yearOfLoss, {quo("prim", "n").replace("1e4", "1e2")} as percent from trend
            join ratios on yearOfLoss = cpi_year""",
            {"trend": TREND},
        ),
    )
    yield (
        "scalar_format_label",
        lambda s: R.flash_vs_river(s).select(
            "environment_type",
            "flood_type",
            X.count_label(F.col("total_incidents"), F.col("percent_of_environment")).alias("label"),
        ),
        with_views(
            f"""select environment_type, flood_type, concat(format('{{:,}}', n), ' claims', chr(10), '(',
            cast(cast(pct as decimal(6,1)) as varchar), '%)') as label from ({MIX_SHARE})""",
            {"mix": MIX},
        ),
    )


def checks():
    yield from filters()
    yield from values()
    yield from scalars()

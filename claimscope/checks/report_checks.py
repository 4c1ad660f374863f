"""Reports and summaries over the stand-in tables."""

from __future__ import annotations

from claimscope.checks.oracle_parts import COST_CASE, FLOOD_TYPE_CASE, STORM_CASE, dbl, quo, real9, scaled, severity_case, with_views
from claimscope.checks.standins import FIRST_YEAR, LAST_YEAR, Standins
from claimscope.functions.landcover import severity_scheme
from claimscope.plans import reports as R
from claimscope.plans import summaries as S
from claimscope.plans.tables import Tables
from claimscope.session import scratch_path
from claimscope.sources.tables import stored

# Parameters that make the stand-ins exercise every branch.
FIRST = 1996
BASE = 1998
GENERIC = ("PROMO", "SMALL")
STORM_CLAIMS = 1200
GROUP_CLAIMS = 100
YEARS = tuple(range(FIRST_YEAR, LAST_YEAR + 1))
SPRAWL = {"years": (1997, 1999), "before": (1995, 1996), "after": (2000, 2001)}
SEVERITY = severity_scheme(high="0.3", wet="0.3")
AVG_BUCKET = f"Avg Payout per Claim ({BASE} Dollars)"
SUM_BUCKET = f"Total Payouts ({BASE} Dollars)"
AVG_STORM = f"avg_building_payout_{BASE}_dollars"
SUM_STORM = f"total_building_payout_{BASE}_dollars"
STORM_ENV = STORM_CASE
GENERIC_SQL = "(floodEvent is null or lower(floodEvent) not in ('promo', 'small'))"


def trend(s: Standins):
    return R.macro_trend(s, first_year=FIRST, base_year=BASE)


def buckets(s: Standins):
    return R.impervious_buckets(s, first_year=FIRST, base_year=BASE)


def storms(s: Standins):
    folder = scratch_path(s.spark, "storms-by-zip")
    return R.storm_control(s, generic=GENERIC, min_claims=STORM_CLAIMS, base_year=BASE, scratch=folder)


def exported_storms(s: Standins):
    """The storm report as written and read back, anew for each summary that reads it."""
    return stored(storms(s), "storm-report")


# --- oracle pieces shared by a report and its summaries -----------------------

TREND = f"""select yearOfLoss, count(*) as n, sum(both_cents) as cents,
    count(*) filter (waterDepth >= 12) as severe, count(*) filter (waterDepth < 0) as basement,
    count(*) filter (primaryResidenceIndicator) as prim
  from paid where yearOfLoss >= {FIRST} group by yearOfLoss"""

BUCKETS = f"""select m.yearOfLoss as y, b.bucket, count(*) as n, sum(m.both_cents) * any_value(r.r7) as real
  from mapped m join bucketed b on m.zcta = b.ZCTA20 and m.yearOfLoss = b.YEAR
    join ratios r on m.yearOfLoss = r.cpi_year
  where m.yearOfLoss >= {FIRST} group by m.yearOfLoss, b.bucket"""

MIX = f"""select environment_type, case when causeOfDamage = '2' then 'River/Stream Overflow'
      else 'Flash Flood (Rain Accumulation)' end as flood_type, count(*) as n
  from mapped m join (select ZCTA20, YEAR, {FLOOD_TYPE_CASE} as environment_type from land) l
    on m.zcta = l.ZCTA20 and m.yearOfLoss = l.YEAR
  where causeOfDamage in ('2', '4') and environment_type <> 'Mixed' group by 1, 2"""

MIX_SHARE = "select *, {share} as pct from mix".format(
    share=quo("n * 100", "sum(n) over (partition by environment_type)", 1)
)

MAJORS = f"""select storm_id from paid where storm_id is not null and {GENERIC_SQL}
  group by storm_id having count(*) > {STORM_CLAIMS}"""

STORM_AREAS = """select storm_id, yearOfLoss, zcta, max(floodEvent) as floodEventName, count(*) as n,
    count(*) filter (building_cents > 0) as damaged, sum(building_cents) as cents
  from mapped where storm_id in (select storm_id from majors) group by 1, 2, 3"""

STORMS = f"""select storm_id, floodEventName, a.yearOfLoss, environment_type, sum(n) as n, sum(damaged) as damaged,
    sum(cents) * any_value(r7) as real
  from storm_areas a join (select ZCTA20, YEAR, {STORM_ENV} as environment_type from land) l
    on a.zcta = l.ZCTA20 and a.yearOfLoss = l.YEAR join ratios r on a.yearOfLoss = r.cpi_year
  group by 1, 2, 3, 4"""

STORM_VIEWS = {"majors": MAJORS, "storm_areas": STORM_AREAS, "storms": STORMS}
STORM_COLUMNS = f"""storm_id, floodEventName, yearOfLoss, environment_type, cast(n as bigint) as total_incidents,
    {quo("real", "damaged * 1000000000")} as {AVG_STORM}, {scaled("real", 9)} as {SUM_STORM}"""

BUCKET_YEAR = """select bucket, count(*) as n, sum(policyCount) as policies,
    sum(greatest(coalesce(policyCount, 1), 1)) as floored, sum(building_cents) as cents, sum({real}) as real
  from mapped m join bucketed b on m.zcta = b.ZCTA20 and b.YEAR = {year}
    join ratios r on m.yearOfLoss = r.cpi_year
  where m.yearOfLoss = {year} group by bucket""".format(year=BASE, real=real9("both_cents"))


def rate_percent(part: str, whole: str) -> str:
    """A four-digit rate, times one hundred."""
    return quo(part, whole).replace("1e4", "1e2")


def per_hundred(policies: str) -> str:
    return rate_percent("n", policies)


def pivot_sql(cell: str, years=YEARS) -> str:
    cells = ", ".join(f'max(case when y = {y} then {cell} end) as "{y}"' for y in years)
    return f'select bucket as "{R.BUCKET}", {cells} from buckets group by bucket'


def reports():
    yield "report_macro_trend", trend, with_views(
        f"""select yearOfLoss, n as total_claims, {scaled(real9("cents"), 9)} as real_total_paid_out_{BASE},
          {quo("severe", "n")} as pct_severe_above_ground_floods, {quo("basement", "n")} as pct_basement_floods,
          {quo("prim", "n")} as pct_primary_residence
        from trend join ratios on yearOfLoss = cpi_year""",
        {"trend": TREND},
    )

    # real payments carry 13 decimals here: cents (2) times the 14-decimal ratio, rounded
    real13 = "((2 * sum(cents) * r14 + 1000) // 2000)"
    yield "report_archetype_cost", lambda s: R.archetype_cost(s, base_year=BASE), with_views(
        f"""select land_archetype, cast(sum(n) as bigint) as total_claims_in_archetype,
          cast(nullif(sum(damaged), 0) as bigint) as true_total_claims_in_archetyp,
          {quo("sum(cents)", "sum(n) * 100")} as avg_nominal_payout_all_claims,
          {quo("sum(real)", "sum(n) * 10000000000000")} as avg_{BASE}_payout_all_claims,
          {quo("sum(cents)", "sum(damaged) * 100")} as true_nominal_payout_all_claims,
          {quo("sum(real)", "sum(damaged) * 10000000000000")} as true_avg_{BASE}_building_payout
        from by_zip z join (select ZCTA20, YEAR, {COST_CASE} as land_archetype from land) l
          on z.zcta = l.ZCTA20 and z.yearOfLoss = l.YEAR group by land_archetype""",
        {
            "by_zip": f"""select clean_zip, zcta, yearOfLoss, count(*) as n,
              count(*) filter (building_cents > 0) as damaged, sum(building_cents) as cents,
              {real13.replace("sum(cents)", "sum(building_cents)")} as real
            from mapped join ratios on yearOfLoss = cpi_year
            where zcta is not null group by clean_zip, zcta, yearOfLoss, r14"""
        },
    )
    yield "report_impervious_buckets", buckets, with_views(
        f"""select y as "Year", bucket as "{R.BUCKET}", n as "Total Claims",
          {quo("real", "n * 1000000000")} as "{AVG_BUCKET}", {scaled("real", 9)} as "{SUM_BUCKET}" from buckets""",
        {"buckets": BUCKETS},
    )
    yield "report_flash_vs_river", lambda s: R.flash_vs_river(s), with_views(
        f"select environment_type, flood_type, n as total_incidents, pct as percent_of_environment from ({MIX_SHARE})",
        {"mix": MIX},
    )
    yield "report_storm_control", storms, with_views(f"select {STORM_COLUMNS} from storms", STORM_VIEWS)
    yield (
        "report_bucket_frequency_real",
        lambda s: R.bucket_frequency_real(s, year=BASE, base_year=BASE),
        with_views(
            f"""select bucket as "{R.BUCKET}", n as "Total Claims",
              {per_hundred("policies")} as "Claims per 100 Policies",
              {quo("real", "n * 1000000000")} as "Average Payout ({BASE} Dollars)",
              {scaled("real", 9)} as "{SUM_BUCKET}" from one_year""",
            {"one_year": BUCKET_YEAR},
        ),
    )
    nominal = f"""select bucket as "{R.BUCKET}", n as "Total Claims",
      {quo("cents", "n * 100")} as "Average Payout Per Claim ($)", {scaled("cents * 100", 4)} as "Total Payouts"
      %s from one_year"""
    yield "report_bucket_nominal", lambda s: R.bucket_nominal(s, year=BASE), with_views(
        nominal % "", {"one_year": BUCKET_YEAR}
    )
    yield "report_flash_vs_river_counts", lambda s: R.flash_vs_river_counts(s), with_views(
        "select environment_type, flood_type, n as total_incidents from mix", {"mix": MIX}
    )
    yield (
        "report_storm_nominal",
        lambda s: R.storm_nominal(s, generic=GENERIC, min_claims=GROUP_CLAIMS),
        with_views(
            f"""select storm_id, floodEventName, environment_type, cast(sum(n) as bigint) as total_claims,
              {quo("sum(cents)", "sum(n) * 100")} as avg_payout
            from areas a join (select ZCTA20, YEAR, {STORM_ENV} as environment_type from land) l
              on a.zcta = l.ZCTA20 and a.yearOfLoss = l.YEAR
            group by 1, 2, 3 having sum(n) > {GROUP_CLAIMS}""",
            {
                "areas": f"""select storm_id, yearOfLoss, zcta, max(floodEvent) as floodEventName, count(*) as n,
                  sum(building_cents) as cents from mapped where storm_id is not null and {GENERIC_SQL}
                  group by 1, 2, 3"""
            },
        ),
    )
    yield "report_trend_nominal", lambda s: R.trend_nominal(s, first_year=FIRST), with_views(
        f"""select yearOfLoss, count(*) as total_claims, {scaled("sum(both_cents) * 100", 4)} as total_paid_out,
          {quo("sum(waterDepth)", "count(waterDepth)")} as average_water_depth_inches,
          {quo("count(*) filter (primaryResidenceIndicator)", "count(*)")} as pct_primary_residence
        from paid where yearOfLoss >= {FIRST} group by yearOfLoss"""
    )
    yield (
        "report_bucket_frequency_nominal",
        lambda s: R.bucket_frequency_nominal(s, year=BASE),
        with_views(
            nominal % f', {per_hundred("floored")} as "Claims per 100 Policies"',
            {"one_year": BUCKET_YEAR},
        ),
    )
    percent6 = (
        "((2 * both_cents * 1000000 + cast(buildingPropertyValue as hugeint)) "
        "// (2 * cast(buildingPropertyValue as hugeint)))"
    )
    yield (
        "report_damage_severity",
        lambda s: R.damage_severity(
            Tables(s.claims, s.crosswalk, s.sparse_land, s.index),
            first_year=FIRST,
            min_claims=GROUP_CLAIMS,
            scheme=SEVERITY,
        ),
        with_views(
            f"""select environment_type, count(*) as total_claims,
              {quo("sum(both_cents)", "count(*) * 100")} as avg_absolute_payout,
              {quo(f"sum({percent6})", "count(*) * 1000000")} as avg_percent_value_destroyed
            from mapped m
              join (select m2.y as y, max(l2.YEAR) as land_year
                    from (select distinct yearOfLoss as y from claims where yearOfLoss >= {FIRST}) m2
                      join (select distinct YEAR from land where YEAR in (1995, 1998, 2001)) l2 on l2.YEAR <= m2.y
                    group by 1) latest on m.yearOfLoss = latest.y
              join (select ZCTA20, YEAR, {severity_case("0.3", "0.3")} as environment_type from land) l
                on m.zcta = l.ZCTA20 and l.YEAR = latest.land_year
            where zip_join_type = 'Zip matches ZCTA' and buildingPropertyValue > 0 and yearOfLoss >= {FIRST}
            group by 1 having count(*) > {GROUP_CLAIMS}"""
        ),
    )
    yield "report_sprawl_delta", lambda s: R.sprawl_delta(s, **SPRAWL), with_views(
        f"""select zcta as "ZCTA Code", {dbl("growth * 100", 2)} as "Impervious Growth (%)",
          before as "Claims (1995-1996)", after as "Claims (2000-2001)",
          {quo("after", "before", 2)} as "Post-Paving Claim Multiplier"
        from (select m.zcta, g.growth, count(*) filter (yearOfLoss between 1995 and 1996) as before,
                count(*) filter (yearOfLoss between 2000 and 2001) as after
              from mapped m join grown g on m.zcta = g.ZCTA20
              where zip_join_type = 'Zip matches ZCTA' group by 1, 2)
        where before > 10""",
        {
            "developed": "select ZCTA20, YEAR, PROP_DEV_LOWINTENSITY + PROP_DEV_MEDINTENSITY + PROP_DEV_HIINTENSITY as d from land",
            "grown": """select a.ZCTA20, b.d - a.d as growth from developed a join developed b using (ZCTA20)
              where a.YEAR = 1997 and b.YEAR = 1999 and b.d - a.d > 0.05""",
        },
    )
    yield (
        "report_trend_real_preagg",
        lambda s: R.trend_real_preaggregated(s, first_year=FIRST, base_year=BASE),
        with_views(
            f"""select yearOfLoss, n as total_claims, {scaled("cents * 100", 4)} as nominal_payout,
              {scaled(real9("cents"), 9)} as real_payout_{BASE}_dollars
            from trend join ratios on yearOfLoss = cpi_year""",
            {"trend": TREND},
        ),
    )


def summaries():
    percent = {c: rate_percent(c, "n") for c in ("severe", "basement", "prim")}
    yield "summary_trend_series", lambda s: S.trend_series(trend(s), BASE), with_views(
        f"""select yearOfLoss, n as total_claims, {scaled(real9("cents"), 9)} as real_total_paid_out_{BASE},
          {percent["severe"]} as pct_severe_above_ground_floods, {percent["basement"]} as pct_basement_floods,
          {percent["prim"]} as pct_primary_residence
        from trend join ratios on yearOfLoss = cpi_year""",
        {"trend": TREND},
    )
    yield "summary_bucket_totals", lambda s: S.bucket_totals(buckets(s)), with_views(
        f"""select bucket as "{R.BUCKET}", cast(sum(n) as bigint) as "Total Claims" from buckets group by bucket""",
        {"buckets": BUCKETS},
    )
    yield "summary_bucket_weighted", lambda s: S.bucket_weighted_average(buckets(s), BASE), with_views(
        f"""select bucket as "{R.BUCKET}",
          {quo("sum(real)", "sum(n) * 1000000000")} as "Weighted Avg Payout ({BASE}$)"
        from buckets group by bucket""",
        {"buckets": BUCKETS},
    )
    yield "summary_band_trend", lambda s: S.band_trend(buckets(s)), with_views(
        """select y as "Year", case when bucket <= 30 then 'Low (0-30%)' when bucket <= 60 then 'Medium (40-60%)'
            else 'High (70-100%)' end as "Impervious Category", cast(sum(n) as bigint) as "Total Claims"
        from buckets group by 1, 2""",
        {"buckets": BUCKETS},
    )
    yield "summary_heatmap_volume", lambda s: S.heatmap_volume(buckets(s)), with_views(
        pivot_sql("n", range(FIRST, LAST_YEAR + 1)), {"buckets": BUCKETS}
    )
    yield "summary_heatmap_severity", lambda s: S.heatmap_severity(buckets(s), YEARS, BASE), with_views(
        pivot_sql(quo("real", "n * 1000000000")), {"buckets": BUCKETS}
    )
    flood_columns = ", ".join(
        f"""max(case when flood_type = '{f}' then pct end) as "{f} percent",
        max(case when flood_type = '{f}' then cast(n as double) end) as "{f} incidents",
        max(case when flood_type = '{f}' and pct > 0 then concat(format('{{:,}}', n), ' claims', chr(10), '(',
          cast(cast(pct as decimal(6,1)) as varchar), '%)') end) as "{f} label" """
        for f in ("Flash Flood (Rain Accumulation)", "River/Stream Overflow")
    )
    yield "summary_flood_type_mix", lambda s: S.flood_type_mix(R.flash_vs_river(s)), with_views(
        f"select environment_type, {flood_columns} from ({MIX_SHARE}) group by environment_type", {"mix": MIX}
    )
    average13 = "((2 * cast(real as hugeint) * 10000 + damaged) // (2 * damaged))"
    middle = "filter (place in ((m + 1) // 2, m // 2 + 1))"
    yield "summary_storm_environment", lambda s: S.storm_environment(exported_storms(s), BASE), with_views(
        f"""select split_part(environment_type, '. ', 2) as env_short,
          replace(split_part(environment_type, '. ', 2), ' (', chr(10) || '(') as env_label,
          cast(sum(n) as bigint) as total_incidents_sum,
          {quo("sum(a)", "count(a) * 10000000000000")} as avg_payout_mean,
          {quo(f"sum(a) {middle}", f"count(a) {middle} * 10000000000000")}
            as median_payout
        from ranked group by environment_type, m""",
        {
            **STORM_VIEWS,
            "averages": f"select environment_type, n, case when damaged > 0 then {average13} end as a from storms",
            "ranked": """select *, row_number() over (partition by environment_type order by a nulls last) as place,
              count(a) over (partition by environment_type) as m from averages""",
        },
    )
    yield "summary_top_storms", lambda s: S.top_storms(exported_storms(s)), with_views(
        f"""select {STORM_COLUMNS}, split_part(environment_type, '. ', 2) as env_short from storms
        where floodEventName in (select floodEventName from storms where floodEventName is not null
          group by 1 order by sum(n) desc, floodEventName limit 5)""",
        STORM_VIEWS,
    )


def checks():
    yield from reports()
    yield from summaries()

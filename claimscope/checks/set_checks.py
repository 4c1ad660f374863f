"""Joins, aggregations, windows, sorts and pivots over the stand-in tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimscope import constants as K
from claimscope.checks.oracle_parts import DEVELOPED, FLOOD_TYPE_CASE, STORM_CASE, dbl, quo, scaled, with_views
from claimscope.checks.report_checks import (
    AVG_BUCKET,
    BASE,
    BUCKETS,
    FIRST,
    GENERIC,
    MAJORS,
    MIX,
    MIX_SHARE,
    STORM_CLAIMS,
    YEARS,
    buckets,
    pivot_sql,
)
from claimscope.checks.standins import Standins
from claimscope.functions import landcover as L
from claimscope.functions import money as M
from claimscope.functions import text as X
from claimscope.operators import aggregates as A
from claimscope.operators import joins, ordering, reshape, windows
from claimscope.plans import reports as R
from claimscope.sources.tables import stored

ENVIRONMENT = STORM_CASE
SPRAWL_YEARS = (1997, 1999)


def environments(s: Standins):
    """Claims summed by postal code and year, with the environment of their area."""
    by_zip = A.by_zip(s.claims, ["yearOfLoss"], n=A.claim_count(), paid=A.building_paid())
    return joins.with_land(
        joins.to_area(by_zip, s.crosswalk), s.land, L.storm_scheme().label().alias("environment_type")
    )


ENVIRONMENTS = f"""select m.clean_zip, m.yearOfLoss, m.zcta, environment_type, count(*) as n,
    sum(building) as paid, sum(building_cents) as cents
  from mapped m join (select ZCTA20, YEAR, {ENVIRONMENT} as environment_type from land) l
    on m.zcta = l.ZCTA20 and m.yearOfLoss = l.YEAR group by 1, 2, 3, 4"""


def storm_counts(s: Standins):
    """Claims per storm id and event name."""
    known = s.claims.withColumn("storm_id", R.storm_id()).filter(F.col("storm_id").isNotNull())
    return known.groupBy("storm_id", "floodEvent").agg(A.claim_count().alias("claims"))


def join_checks():
    yield (
        "join_crosswalk",
        lambda s: joins.to_area(s.claims.select("id", "yearOfLoss", "clean_zip"), s.crosswalk),
        with_views("select id, yearOfLoss, zcta from claims join crosswalk on clean_zip = zip_code where zcta is not null"),
    )
    yield "join_area_year", environments, with_views(
        f"select zcta, yearOfLoss, environment_type, n, {dbl('paid')} as paid from environments",
        {"environments": ENVIRONMENTS},
    )
    yield (
        "join_area_only",
        lambda s: joins.with_land_of_year(
            joins.to_area(A.by_zip(s.claims.filter(F.col("yearOfLoss") == BASE), n=A.claim_count()), s.crosswalk),
            s.land,
            BASE,
            L.impervious_percent().alias("bucket"),
        ),
        with_views(
            f"""select m.zcta, count(*) as n, bucket from mapped m
            join bucketed b on m.zcta = b.ZCTA20 and b.YEAR = {BASE}
            where yearOfLoss = {BASE} group by m.clean_zip, m.zcta, bucket"""
        ),
    )
    yield (
        "join_price_index",
        lambda s: joins.with_index(
            s.claims.groupBy("yearOfLoss").agg(A.claim_count().alias("n")), s.index
        ),
        with_views(
            f"""select yearOfLoss, n, {dbl("cpi_value", 3)} as cpi_value
            from (select yearOfLoss, count(*) as n from claims group by 1) join price_index on yearOfLoss = cpi_year"""
        ),
    )
    yield (
        "cross_join_baseline",
        lambda s: joins.with_index(
            s.claims.groupBy("yearOfLoss").agg(A.claim_count().alias("n")), joins.with_baseline(s.index, BASE)
        ),
        with_views(
            f"""select yearOfLoss, n, {dbl("cpi_value", 3)} as cpi_value, {dbl("baseline", 3)} as baseline
            from (select yearOfLoss, count(*) as n from claims group by 1) join price_index on yearOfLoss = cpi_year
            cross join (select cpi_value as baseline from price_index where cpi_year = {BASE})"""
        ),
    )
    yield (
        "join_range_asof_year",
        lambda s: joins.with_latest_land_year(
            s.claims.groupBy("yearOfLoss").agg(A.claim_count().alias("n")), s.sparse_land
        ),
        with_views(
            """select c.yearOfLoss, n, max(YEAR) as land_year
            from (select yearOfLoss, count(*) as n from claims group by 1) c
              join (select distinct YEAR from land where YEAR in (1995, 1998, 2001)) l on l.YEAR <= c.yearOfLoss
            group by c.yearOfLoss, n"""
        ),
    )
    yield (
        "semi_join_major_events",
        lambda s: joins.keep_members(
            s.claims.select(
                "id", R.storm_id().alias("storm_id"), X.fold(R.storm_id(), False).alias("storm_key")
            ),
            R.major_storms(storm_counts(s), GENERIC, STORM_CLAIMS, False),
            "storm_key",
        ).drop("storm_key"),
        with_views(
            "select id, storm_id from paid where storm_id in (select storm_id from majors)", {"majors": MAJORS}
        ),
    )
    grown = f"""select a.ZCTA20 from (select ZCTA20, {DEVELOPED} as d from land where YEAR = 1997) a
      join (select ZCTA20, {DEVELOPED} as d from land where YEAR = 1999) b using (ZCTA20) where b.d - a.d > 0.05"""
    yield (
        "join_reducer_inner",
        lambda s: joins.to_area(A.by_zip(s.claims, n=A.claim_count()), s.crosswalk).join(
            R.rapid_growth(s.land, SPRAWL_YEARS, K.SPRAWL_GROWTH).select("zcta"), "zcta"
        ),
        with_views(
            "select zcta, count(*) as n from mapped join grown on zcta = ZCTA20 group by clean_zip, zcta",
            {"grown": grown},
        ),
    )
    yield (
        "join_cte_back",
        lambda s: R.rapid_growth(s.land, SPRAWL_YEARS, K.SPRAWL_GROWTH).join(
            A.roll_up(
                joins.to_area(A.by_zip(s.claims, n=A.claim_count()), s.crosswalk), ["zcta"], "n"
            ),
            "zcta",
        ),
        with_views(
            f"""select zcta, {dbl("growth")} as growth, n
            from (select b.ZCTA20 as zcta, b.d - a.d as growth
                  from (select ZCTA20, {DEVELOPED} as d from land where YEAR = 1997) a
                  join (select ZCTA20, {DEVELOPED} as d from land where YEAR = 1999) b using (ZCTA20)
                  where b.d - a.d > 0.05)
              join (select zcta, count(*) as n from mapped group by zcta) using (zcta)"""
        ),
    )
    yield (
        "lookup_county_name",
        lambda s: joins.with_county_name(
            s.claims.groupBy("countyCode").agg(A.claim_count().alias("n")), s.counties
        ),
        with_views(
            """select countyCode, n, county_name, state_name
            from (select countyCode, count(*) as n from claims group by 1) left join county using (countyCode)"""
        ),
    )
    yield (
        "filter_members_of_top",
        lambda s: ordering.rows_of_top_keys(
            A.by_zip(s.claims, ["floodEvent", "yearOfLoss"], n=A.claim_count()), "clean_zip", "n", 5
        ),
        with_views(
            """select clean_zip, floodEvent, yearOfLoss, count(*) as n from claims
            where clean_zip in (select clean_zip from claims group by 1 order by count(*) desc, clean_zip limit 5)
            group by 1, 2, 3"""
        ),
    )


def grouped(keys, **measures):
    """Query grouping all claims."""
    return lambda s: s.claims.groupBy(*keys).agg(*[make().alias(name) for name, make in measures.items()])


def with_sql(sql: str):
    """Query written in SQL over a view of the claims."""

    def run(s: Standins):
        return s.spark.sql(sql, claims=s.claims)

    return run


def aggregate_checks():
    yield (
        "agg_count",
        grouped(["clean_zip"], n=A.claim_count, paid=lambda: F.count("amountPaidOnBuildingClaim")),
        with_views("select clean_zip, count(id) as n, count(amountPaidOnBuildingClaim) as paid from claims group by 1"),
    )
    yield (
        "agg_sum_money",
        grouped(["clean_zip"], building=A.building_paid, both_paid=A.nominal_paid),
        with_views(f"select clean_zip, {dbl('sum(building)')} as building, {dbl('sum(both_paid)')} as both_paid from paid group by 1"),
    )
    yield (
        "agg_avg",
        lambda s: s.claims.groupBy("clean_zip")
        .agg(F.sum("waterDepth").alias("depth"), F.count("waterDepth").alias("n"))
        .select("clean_zip", A.rate("depth", "n").alias("mean_depth")),
        with_views(f"select clean_zip, {quo('sum(waterDepth)', 'count(waterDepth)')} as mean_depth from claims group by 1"),
    )
    yield (
        "agg_max_text",
        lambda s: A.largest(s.claims, ["clean_zip"], "floodEvent", "name"),
        with_views("select clean_zip, max(floodEvent) as name from claims group by 1"),
    )
    yield (
        "agg_conditional_count",
        grouped(["clean_zip"], severe=A.severe_count, basement=A.basement_count, damaged=A.building_claim_count),
        with_views(
            """select clean_zip, count(*) filter (waterDepth >= 12) as severe,
            count(*) filter (waterDepth < 0) as basement, count(*) filter (building > 0) as damaged
            from paid group by 1"""
        ),
    )
    yield (
        "agg_rate",
        lambda s: s.claims.groupBy("clean_zip")
        .agg(A.claim_count().alias("n"), A.severe_count().alias("severe"), A.primary_count().alias("prim"))
        .select("clean_zip", A.rate("severe", "n").alias("pct_severe"), A.rate("prim", "n").alias("pct_primary")),
        with_views(
            f"""select clean_zip, {quo("count(*) filter (waterDepth >= 12)", "count(*)")} as pct_severe,
            {quo("count(*) filter (primaryResidenceIndicator)", "count(*)")} as pct_primary from claims group by 1"""
        ),
    )
    yield (
        "agg_real_dollar_sum",
        lambda s: joins.with_index(
            A.by_zip(s.claims, ["yearOfLoss"], nominal=A.nominal_paid()), joins.with_baseline(s.index, BASE)
        ).select(
            "clean_zip",
            "yearOfLoss",
            M.restated(
                F.col("nominal"), M.reported_ratio(F.col("baseline"), F.col("cpi_value"))
            ).alias("real"),
        ),
        with_views(
            f"""select clean_zip, yearOfLoss, {scaled("sum(both_cents) * r7", 9)} as real
            from paid join ratios on yearOfLoss = cpi_year group by clean_zip, yearOfLoss, r7"""
        ),
    )
    yield (
        "agg_two_level",
        lambda s: A.roll_up(
            joins.to_area(
                A.by_zip(s.claims, ["yearOfLoss"], n=A.claim_count(), paid=A.nominal_paid()), s.crosswalk
            ),
            ["zcta", "yearOfLoss"],
            "n",
            "paid",
        ),
        with_views(
            f"""select zcta, yearOfLoss, count(*) as n, {dbl("sum(both_paid)")} as paid from mapped
            where zcta is not null group by 1, 2"""
        ),
    )
    yield (
        "agg_safe_ratio",
        lambda s: s.claims.groupBy("clean_zip")
        .agg(A.building_paid().alias("paid"), A.building_claim_count().alias("n"))
        .select("clean_zip", M.quotient(F.col("paid"), F.col("n"), 6, 2).alias("mean_paid")),
        with_views(
            f"""select clean_zip, {quo("sum(building_cents)", "count(*) filter (building > 0) * 100")} as mean_paid
            from paid group by 1"""
        ),
    )
    yield (
        "agg_ratio_per_100",
        lambda s: s.claims.groupBy("clean_zip")
        .agg(A.claim_count().alias("n"), F.sum("policyCount").alias("policies"))
        .select("clean_zip", A.per_hundred("n", "policies").alias("per_100")),
        with_views(
            f"""select clean_zip, {quo("count(*)", "sum(policyCount)").replace("1e4", "1e2")} as per_100
            from claims group by 1"""
        ),
    )
    value = "cast(buildingPropertyValue as hugeint)"
    percent = f"((2 * both_cents * 1000000 + {value}) // (2 * {value}))"
    yield (
        "agg_sum_of_row_ratios",
        lambda s: s.claims.filter(F.col("buildingPropertyValue") > 0)
        .groupBy("clean_zip")
        .agg(
            F.sum(
                M.quotient(
                    M.total_paid(F.col("amountPaidOnBuildingClaim"), F.col("amountPaidOnContentsClaim")) * 100,
                    F.col("buildingPropertyValue"),
                    6,
                    2,
                )
            ).alias("sum_pct"),
            A.claim_count().alias("n"),
        )
        .select("clean_zip", "sum_pct", M.quotient(F.col("sum_pct"), F.col("n"), 10, 6).alias("mean_pct")),
        with_views(
            f"""select clean_zip, {scaled(f"sum({percent})", 6)} as sum_pct,
            {quo(f"sum({percent})", "count(*) * 1000000")} as mean_pct
            from paid where buildingPropertyValue > 0 group by 1"""
        ),
    )
    yield (
        "agg_having_threshold",
        lambda s: s.claims.groupBy("floodEvent", "eventDesignationNumber")
        .agg(A.claim_count().alias("n"))
        .filter(F.col("n") > 100),
        with_views(
            """select floodEvent, eventDesignationNumber, count(*) as n from claims group by 1, 2
            having count(*) > 100"""
        ),
    )
    yield (
        "agg_distinct_values",
        lambda s: s.claims.select("clean_zip", "yearOfLoss").distinct(),
        with_views("select distinct clean_zip, yearOfLoss from claims"),
    )
    yield (
        "group_by_expression",
        lambda s: s.claims.groupBy(R.storm_id().alias("storm_id")).agg(A.claim_count().alias("n")),
        with_views("select storm_id, count(*) as n from paid group by 1"),
    )
    yield (
        "group_by_alias",
        with_sql(
            """select clean_zip, case when waterDepth < 0 then 'below' else 'above' end as level, count(id) as n
            from {claims} group by clean_zip, level"""
        ),
        with_views(
            """select clean_zip, case when waterDepth < 0 then 'below' else 'above' end as level, count(id) as n
            from claims group by clean_zip, level"""
        ),
    )
    # A maximum over text cannot use hash aggregation: the claims are first counted per text.
    summed = """select floodEvent, max(eventDesignationNumber) as last_number, yearOfLoss, clean_zip, sum(n) as n
      from (select floodEvent, eventDesignationNumber, yearOfLoss, clean_zip, count(id) as n
            from {claims} group by 1, 2, 3, 4) group by 1, 3, 4"""
    ordinal = """select floodEvent, max(eventDesignationNumber) as last_number, yearOfLoss, clean_zip, count(id) as n
      from claims group by 1, 3, 4"""
    yield "group_by_ordinal", with_sql(summed), with_views(ordinal)
    yield (
        "group_with_constant_keys",
        lambda s: A.roll_up(
            joins.with_index(
                A.by_zip(s.claims, ["yearOfLoss"], n=A.claim_count()), joins.with_baseline(s.index, BASE)
            ),
            ["yearOfLoss", "cpi_value", "baseline"],
            "n",
        ),
        with_views(
            f"""select yearOfLoss, {dbl("cpi_value", 3)} as cpi_value, {dbl("baseline", 3)} as baseline,
              count(*) as n
            from claims join price_index on yearOfLoss = cpi_year
            cross join (select cpi_value as baseline from price_index where cpi_year = {BASE})
            group by yearOfLoss, cpi_value, baseline"""
        ),
    )
    yield (
        "agg_period_compare",
        grouped(
            ["clean_zip"],
            before=lambda: F.count_if(F.col("yearOfLoss").between(1995, 1996)),
            after=lambda: F.count_if(F.col("yearOfLoss").between(2000, 2001)),
        ),
        with_views(
            """select clean_zip, count(*) filter (yearOfLoss between 1995 and 1996) as before,
            count(*) filter (yearOfLoss between 2000 and 2001) as after from claims group by 1"""
        ),
    )
    yield (
        "agg_weighted_average",
        lambda s: A.weighted_average(
            A.by_zip(s.claims, ["yearOfLoss"], total=A.building_paid(), weight=A.building_claim_count()),
            ["clean_zip"],
            "total",
            "weight",
            "mean_paid",
        ),
        with_views(
            f"""select clean_zip, case when count(*) filter (building > 0) > 0
              then {quo("sum(building_cents)", "count(*) filter (building > 0) * 100")} else 0.0 end as mean_paid
            from paid group by 1"""
        ),
    )
    middle = "filter (place in ((m + 1) // 2, m // 2 + 1))"
    yield "agg_mean_median", mean_median, with_views(
        f"""select causeOfDamage, {scaled("sum(both_cents) * 100", 4)} as total,
          {quo("sum(both_cents)", "count(*) * 100")} as mean,
          {quo(f"sum(both_cents) {middle}", f"count(*) {middle} * 100")} as median
        from (select *, row_number() over (partition by causeOfDamage order by both_cents) as place,
                count(*) over (partition by causeOfDamage) as m from paid) group by 1"""
    )
    yield (
        "agg_group_sum",
        lambda s: A.roll_up(
            A.by_zip(s.claims, ["yearOfLoss", "floodEvent"], n=A.claim_count(), paid=A.building_paid()),
            ["yearOfLoss", "floodEvent"],
            "n",
            "paid",
        ),
        with_views(
            f"select yearOfLoss, floodEvent, count(*) as n, {dbl('sum(building)')} as paid from paid group by 1, 2"
        ),
    )


def mean_median(s: Standins):
    """Sum, mean and exact median of the payment per cause, all from one count of the payments."""
    payments = s.claims.select(
        "causeOfDamage",
        M.total_paid(F.col("amountPaidOnBuildingClaim"), F.col("amountPaidOnContentsClaim")).alias("paid"),
    )
    counted = A.value_counts(payments, "causeOfDamage", "paid")
    totals = (
        counted.groupBy("causeOfDamage")
        .agg(F.sum(F.col("paid") * F.col("rows")).cast("decimal(38,2)").alias("total"), F.sum("rows").alias("n"))
        .select("causeOfDamage", "total", M.quotient(F.col("total"), F.col("n"), 6, 2).alias("mean"))
    )
    return totals.join(A.median_of_counts(counted, "causeOfDamage", "paid", "median"), "causeOfDamage", "left")


def ordering_checks():
    yield (
        "window_lag_year",
        lambda s: windows.previous_year_value(s.land, L.share(K.DEVELOPED), SPRAWL_YEARS, "developed", "before"),
        with_views(
            f"""select ZCTA20, YEAR, {dbl("d")} as developed,
            {dbl("lag(d) over (partition by ZCTA20 order by YEAR)")} as before
            from (select ZCTA20, YEAR, {DEVELOPED} as d from land where YEAR in (1997, 1999))"""
        ),
    )
    yield (
        "window_share_of_total",
        lambda s: windows.share_of_total(
            s.claims.groupBy("floodEvent", "causeOfDamage").agg(A.claim_count().alias("n")), "n", "floodEvent", "pct"
        ),
        with_views(
            f"""select floodEvent, causeOfDamage, n, {quo("n * 100", "sum(n) over (partition by floodEvent)", 1)} as pct
            from (select floodEvent, causeOfDamage, count(*) as n from claims group by 1, 2)"""
        ),
    )
    yearly = "select yearOfLoss, count(*) as n from claims group by 1"
    yield (
        "sort_single",
        lambda s: s.claims.groupBy("clean_zip").agg(A.claim_count().alias("n")).orderBy(F.desc("n"), "clean_zip"),
        with_views("select clean_zip, count(*) as n from claims group by 1 order by n desc, clean_zip"),
    )
    yield (
        "sort_multi_mixed",
        lambda s: s.claims.groupBy("yearOfLoss", "clean_zip")
        .agg(A.claim_count().alias("n"))
        .orderBy(F.desc("yearOfLoss"), F.asc("clean_zip")),
        with_views("select yearOfLoss, clean_zip, count(*) as n from claims group by 1, 2 order by 1 desc, 2"),
    )
    yield (
        "limit_one_row",
        lambda s: joins.with_baseline(s.index, BASE).select("baseline").distinct(),
        with_views(f"select {dbl('cpi_value', 3)} as baseline from price_index where cpi_year = {BASE}"),
    )
    yield (
        "sort_index_desc",
        lambda s: s.claims.groupBy("yearOfLoss").agg(A.claim_count().alias("n")).orderBy(F.desc("yearOfLoss")),
        with_views(f"{yearly} order by 1 desc"),
    )
    yield (
        "topk_keys",
        lambda s: ordering.top_keys(s.claims.withColumn("one", F.lit(1)), "clean_zip", "one", 5),
        with_views(
            """select clean_zip, count(*) as one from claims group by 1 order by 2 desc, 1 limit 5"""
        ),
    )
    order = K.FLOOD_TYPE_LABELS
    yield (
        "sort_by_declared_order",
        lambda s: ordering.in_declared_order(
            s.land.select("ZCTA20", "YEAR", L.FLOOD_TYPE_SCHEME.label().alias("environment_type")),
            "environment_type",
            order[:2],
            "ZCTA20",
            "YEAR",
        ).withColumn("rank", ordering.declared_rank("environment_type", order)),
        with_views(
            f"""select ZCTA20, YEAR, environment_type,
              cast(case environment_type when 'High Concrete' then 1 else 2 end as bigint) as rank
            from (select ZCTA20, YEAR, {FLOOD_TYPE_CASE} as environment_type from land)
            where environment_type <> 'Mixed' order by rank"""
        ),
    )
    yield (
        "sort_by_computed_total",
        lambda s: A.roll_up(environments(s), ["environment_type"], "n").orderBy(F.desc("n")),
        with_views(
            """select environment_type, cast(sum(n) as bigint) as n from environments group by 1 order by 2 desc""",
            {"environments": ENVIRONMENTS},
        ),
    )


def pivot_checks():
    yield (
        "pivot_count",
        lambda s: reshape.pivot_cells(buckets(s), R.BUCKET, "Year", YEARS, "Total Claims"),
        with_views(pivot_sql("n"), {"buckets": BUCKETS}),
    )
    yield (
        "pivot_average",
        lambda s: reshape.pivot_cells(buckets(s), R.BUCKET, "Year", YEARS, AVG_BUCKET),
        with_views(pivot_sql(quo("real", "n * 1000000000")), {"buckets": BUCKETS}),
    )
    yield (
        "pivot_table_mean",
        lambda s: reshape.pivot_mean(
            R.flash_vs_river(s),
            "environment_type",
            "flood_type",
            (K.RAIN_LABEL, K.RIVER_LABEL),
            "percent_of_environment",
        ),
        with_views(
            f"""select environment_type,
              avg(case when flood_type like 'Flash%' then pct end) as "{K.RAIN_LABEL}",
              avg(case when flood_type like 'River%' then pct end) as "{K.RIVER_LABEL}"
            from ({MIX_SHARE}) group by 1""",
            {"mix": MIX},
        ),
    )


def checks():
    yield from join_checks()
    yield from aggregate_checks()
    yield from ordering_checks()
    yield from pivot_checks()

"""Shape of the physical plans over the stored layout, and results without broadcasts."""

import re

import pytest

from claimscope.checks import report_checks as C
from claimscope.checks.standins import Standins
from claimscope.operators import aggregates as A
from claimscope.plans import reports as R
from claimscope.plans import summaries as S
from claimscope.plans.tables import Tables, Warehouse
from claimscope.session import scratch_path
from claimscope.sources.tables import stored, write_by_year

SF = "/root/testdata/sf0.001"

REPORTS = {
    "macro_trend": lambda t: C.trend(t),
    "archetype_cost": lambda t: R.archetype_cost(t, base_year=C.BASE),
    "impervious_buckets": lambda t: C.buckets(t),
    "flash_vs_river": R.flash_vs_river,
    "storm_control": lambda t: R.storm_control(t, generic=C.GENERIC, min_claims=100, base_year=C.BASE),
    "bucket_frequency_real": lambda t: R.bucket_frequency_real(t, year=C.BASE, base_year=C.BASE),
    "bucket_nominal": lambda t: R.bucket_nominal(t, year=C.BASE),
    "storm_nominal": lambda t: R.storm_nominal(t, generic=C.GENERIC, min_claims=10),
    "trend_nominal": lambda t: R.trend_nominal(t, first_year=C.FIRST),
    "damage_severity": lambda t: R.damage_severity(t, first_year=C.FIRST, min_claims=10),
    "sprawl_delta": lambda t: R.sprawl_delta(t, **C.SPRAWL),
}


@pytest.fixture(scope="module")
def house(spark):
    standins = Standins(spark, SF)
    built = Warehouse(spark, scratch_path(spark, "test-plans"))
    write_by_year(standins.claims, built.folder("claims"))
    for name in ("crosswalk", "land", "index"):
        getattr(standins, name).write.parquet(built.folder(name))
    return built


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def above(plan, leaf):
    """The lines of a plan's string over the first line that holds ``leaf``, nearest first."""
    lines = plan.splitlines()
    at = next(i for i, line in enumerate(lines) if leaf in line)
    depth, found = [re.search(r"[A-Za-z*]", line).start() if re.search(r"[A-Za-z*]", line) else 0 for line in lines], []
    for i in range(at - 1, -1, -1):
        if depth[i] < depth[at]:
            at = i
            found.append(lines[i])
    return found


def test_line_items_join_twice_as_orders_meet_customers_first(spark):
    plan = Standins(spark, SF).claims._jdf.queryExecution().optimizedPlan().toString()
    relation = next(line for line in plan.splitlines() if "Relation" in line and "l_orderkey" in line)
    assert sum("Join" in line for line in above(plan, relation)) == 2


@pytest.mark.parametrize("name", ["storm_control", "storm_nominal"])
def test_storm_rows_meet_counted_areas_and_are_sorted_once(house, name):
    plan = physical(REPORTS[name](house))
    # each code and area once, however often the crosswalk lists them
    assert re.search(r"HashAggregate\(keys=\[clean_zip#\d+, zcta#\d+\], functions=\[partial_count", plan)
    # what is joined is dealt by area and year before its texts are sorted
    named = [line for line in plan.splitlines() if "partial_max(struct(k" in line or "partial_max(named_struct(k" in line]
    assert named
    over = above(plan, named[0])
    assert not any("Exchange hashpartitioning(storm_key" in line for line in over[:2])
    below = plan.splitlines()[plan.splitlines().index(named[0]) + 1 :][:3]
    assert any("hashpartitioning(zcta" in line for line in below), below


def scans_of_claims(plan):
    return [line for line in plan.splitlines() if re.search(r"FileScan parquet \[[^\]]*yearOfLoss", line)]


@pytest.mark.parametrize("name", REPORTS)
def test_plan_shape(house, name):
    plan = physical(REPORTS[name](house))
    for unwanted in ("CartesianProduct", "NestedLoop", "Python", "Pandas", "Arrow", "collect_list"):
        assert unwanted not in plan, unwanted
    scans = scans_of_claims(plan)
    assert scans
    for scan in scans:
        columns = re.search(r"FileScan parquet \[([^\]]*)\]", scan).group(1)
        assert "countyCode" not in columns and "dateOfLoss" not in columns
    # claims are counted inside each task before any shuffle
    assert "partial_count" in plan


@pytest.mark.parametrize("name", sorted(set(REPORTS) - {"archetype_cost", "flash_vs_river", "storm_control", "storm_nominal"}))
def test_year_filters_prune_partitions(house, name):
    scans = scans_of_claims(physical(REPORTS[name](house)))
    assert scans
    for scan in scans:
        assert re.search(r"PartitionFilters: \[[^\]]*yearOfLoss", scan)


@pytest.mark.parametrize("name", REPORTS)
def test_same_rows_when_no_table_is_small_enough_to_broadcast(spark, house, name):
    def result():
        return sorted((tuple(r) for r in REPORTS[name](house).collect()), key=repr)

    want = result()
    limits = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    try:
        for limit in limits:
            spark.conf.set(limit, "-1")
        assert "BroadcastHashJoin" not in physical(REPORTS[name](house)) or name == "bucket_frequency_real"
        assert result() == want
    finally:
        for limit in limits:
            spark.conf.unset(limit)
    assert want


def test_storm_report_starts_no_job_until_it_is_read(spark, house):
    group = "storm-report-build"
    spark.sparkContext.setJobGroup(group, group)
    try:
        report = R.storm_control(house, generic=C.GENERIC, min_claims=100, base_year=C.BASE)
        assert spark.sparkContext.statusTracker().getJobIdsForGroup(group) == []
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    # One scan for the detail, one of the two name columns alone.
    scans = scans_of_claims(physical(report)) + [
        x for x in physical(report).splitlines() if re.search(r"FileScan parquet \[[^\]]*floodEvent", x)
    ]
    assert any("amountPaid" not in x for x in scans) and any("amountPaid" in x for x in scans)


def test_storm_report_over_a_scratch_folder_scans_the_claims_once(spark, house):
    first = physical(R._storms_by_zip(house.claims, False, claims=R.A.claim_count()))
    assert len(scans_of_claims(first)) == 1 and "Join" not in first
    assert "partial_count" in first and "SortAggregate" not in first
    stored = R.storm_control(
        house, generic=C.GENERIC, min_claims=100, base_year=C.BASE, scratch=scratch_path(spark, "storms")
    )
    assert "reportedZipCode" not in physical(stored)
    key = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    assert key(stored) == key(REPORTS["storm_control"](house))


def jobs_started(spark, build):
    """What ``build`` returns, and the jobs it ran."""
    group = f"build-{build}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        return build(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext._jsc.clearJobGroup()


def final_plan(df):
    df.collect()
    return physical(df).split("== Initial Plan ==")[0]


def test_median_and_totals_read_their_rows_once_and_start_no_job(spark, house):
    claims = house.claims  # looks into the files once, by a job

    def build():
        counted = A.value_counts(claims, "causeOfDamage", "waterDepth")
        totals = counted.groupBy("causeOfDamage").agg(R.F.sum(R.F.col("waterDepth") * R.F.col("rows")).alias("total"))
        return totals.join(A.median_of_counts(counted, "causeOfDamage", "waterDepth", "median"), "causeOfDamage", "left")

    both, jobs = jobs_started(spark, build)
    assert jobs == 0
    plan = final_plan(both)
    # rows are counted by value before the only exchange that they go through
    assert len(re.findall("FileScan parquet", plan)) == 1 and "ReusedExchange" in plan
    assert "partial_count" in plan


def test_storm_summary_computes_its_report_once(spark, house):
    report = R.storm_control(house, generic=C.GENERIC, min_claims=100, base_year=C.BASE)
    alone = len(scans_of_claims(final_plan(report)))
    summary, jobs = jobs_started(spark, lambda: S.storm_environment(report, C.BASE))
    assert jobs == 0 and summary.count() > 0
    assert len(scans_of_claims(final_plan(summary))) <= alone
    stored_report = stored(report, "test-report")
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(summary) == key(S.storm_environment(stored_report, C.BASE))


def test_heat_map_computes_its_report_once(spark, house):
    report = C.buckets(house)
    matrix, jobs = jobs_started(spark, lambda: S.heatmap_volume(report))
    assert jobs > 0 and not scans_of_claims(final_plan(matrix))
    years = sorted({r["Year"] for r in report.collect()})
    assert matrix.columns[1:] == [str(y) for y in years]
    given, jobs = jobs_started(spark, lambda: S.heatmap_volume(report, years))
    assert jobs == 0
    assert sorted(map(tuple, matrix.collect())) == sorted(map(tuple, given.collect()))


def test_median_of_a_hot_key_spreads_over_tasks(spark):
    """A third of the rows, all of one key: no window holds more than bins or one bin's values."""
    df = spark.range(0, 60000, 1, 6).selectExpr("if(id % 3 = 0, 'hot', concat('k', id % 1000)) as k", "cast(id * 7919 % 60013 as decimal(12,2)) as v")
    got = {r["k"]: r["m"] for r in A.exact_median(df, "k", "v", "m").collect()}
    hot = sorted(i * 7919 % 60013 for i in range(0, 60000, 3))
    assert got["hot"] == (hot[9999] + hot[10000]) / 2
    plan = physical(A.exact_median(df, "k", "v", "m"))
    assert re.search(r"Exchange hashpartitioning\(k#\d+, v#\d+", plan) and not re.search(r"Window .*windowspecdefinition\(k#", plan)


@pytest.mark.parametrize("name", ["agg_max_text", "group_by_ordinal", "dedup_keep_one"])
def test_raw_rows_are_never_sorted_to_be_aggregated(spark, name):
    from claimscope.checks import registry

    parts = physical(registry.queries()[name](spark, SF)).split("SortAggregate")[1:]
    for part in parts:
        if "partial_" in part.split("output=")[0]:
            below = part.split("FileScan")[0]
            assert "HashAggregate" in below or "LeftSemi" in below


def test_a_hot_postal_code_leaves_each_task_as_one_row(spark, house):
    """A third of all claims under one code: the shuffle carries groups, not claims."""
    claims = house.claims.selectExpr("* except (clean_zip)", "if(waterDepth % 3 = 0, '00007', clean_zip) as clean_zip")
    hot = Tables(claims, house.crosswalk, house.land, house.index)
    report = C.buckets(hot)
    assert sum(r["Total Claims"] for r in report.collect()) > 0
    plan = physical(report)
    assert re.search(r"HashAggregate\(keys=\[clean_zip.*partial_count", plan)

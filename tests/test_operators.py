"""Operators on small frames, against plain Python where the answer is not obvious."""

import random
import statistics
from collections import Counter
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from claimscope.operators import aggregates as A
from claimscope.operators import clean, joins, ordering, quality, reshape, windows
from claimscope.sources import tables
from claimscope.session import scratch_path


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_keep_one_takes_the_preferred_then_the_smallest_row(spark):
    df = spark.createDataFrame(
        [("a", 2, "x"), ("a", 1, "z"), ("a", 1, "y"), ("b", None, "q"), ("b", 0, "p")], "k string, n int, t string"
    )
    assert rows(clean.keep_one(df, ["k"])) == [("a", 1, "y"), ("b", None, "q")]
    assert rows(clean.keep_one(df, ["k"], prefer=["t"])) == [("a", 2, "x"), ("b", 0, "p")]


def test_duplicate_keys(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "id string")
    assert rows(clean.duplicate_keys(df, ["id"])) == [("a", 2)]


def test_unmapped_and_unknown_postal_codes_drop_out(spark):
    claims = spark.createDataFrame([("00001", 1), ("00002", 2), ("00003", 3), (None, 4)], "clean_zip string, n int")
    crosswalk = spark.createDataFrame(
        [("00001", "Z1", "Zip matches ZCTA"), ("00002", None, "x")], "zip_code string, zcta string, zip_join_type string"
    )
    assert rows(joins.to_area(claims, crosswalk)) == [(1, "Z1")]


def test_sums_meet_each_different_pair_once(spark):
    sums = spark.createDataFrame([("00001", 2, D("1.50")), ("00002", 1, None)], "clean_zip string, n bigint, paid decimal(22,2)")
    pairs = [("00001", "Z1")] * 50 + [("00001", "Z2"), ("00001", None)] + [("00002", "Z1")] * 3
    crosswalk = spark.createDataFrame(pairs, "zip_code string, zcta string")
    got = joins.sums_to_area(sums, crosswalk, "n", "paid").select("zcta", "n", "paid")
    assert rows(got) == [("Z1", 100, D("75.00")), ("Z1", 3, None), ("Z2", 2, D("1.50"))]
    expanded = joins.to_area(sums, crosswalk).groupBy("zcta").agg(F.sum("n"), F.sum("paid"))
    assert rows(expanded) == rows(got.groupBy("zcta").agg(F.sum("n"), F.sum("paid")))
    land = spark.createDataFrame([("Z1", 2000, c) for c in "aaab"] + [("Z2", 2001, "a")], "ZCTA20 string, YEAR int, c string")
    dated = got.withColumn("yearOfLoss", F.lit(2000))
    placed = joins.sums_with_land(dated, land, F.col("c"), "n").groupBy("zcta", "c").agg(F.sum("n"), F.count("n"))
    assert rows(placed) == [("Z1", "a", 309, 2), ("Z1", "b", 103, 2)]


def test_latest_land_year_without_an_earlier_one(spark):
    land = spark.createDataFrame([(1995,), (2001,), (1998,), (1995,)], "YEAR int")
    losses = spark.createDataFrame([(y,) for y in (1994, 1995, 1997, 1998, 2010)], "yearOfLoss int")
    got = rows(joins.with_latest_land_year(losses, land))
    assert got == [(1995, 1995), (1997, 1995), (1998, 1998), (2010, 2001)]


def test_missing_base_year_leaves_nothing(spark):
    index = spark.createDataFrame([(2019, D("255.657"))], "cpi_year int, cpi_value decimal(10,3)")
    assert rows(joins.with_baseline(index, 2020)) == []
    assert rows(joins.with_baseline(index, 2019))[0][2] == D("255.6570000")


def test_county_names_keep_unknown_codes(spark):
    places = spark.createDataFrame(
        [("MA", "Suffolk", "Boston", "25025"), ("MA", "Suffolk", "Chelsea", "25025")],
        "`State Name` string, `County Name` string, `City Name` string, `StCnty FIPS Code` string",
    )
    claims = spark.createDataFrame([("25025",), ("99999",)], "countyCode string")
    got = rows(joins.with_county_name(claims, joins.county_reference(places)))
    assert got == [("25025", "Suffolk", "MA"), ("99999", None, None)]


@pytest.mark.parametrize("seed", range(3))
def test_exact_median_equals_the_sorted_middle(spark, seed):
    rng = random.Random(seed)
    data = []
    for key, size in (("one", 1), ("two", 2), ("odd", 501), ("even", 640)):
        data += [(key, D(rng.randrange(-500, 500)) / 100) for _ in range(size)]
    # one value holds more than half of a group, another key has only copies
    data += [("hot", D("7.00"))] * 400 + [("hot", D(rng.randrange(1, 300)) / 100) for _ in range(300)]
    data += [("same", D("1.25"))] * 50 + [("gone", None)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "k string, v decimal(12,2)").repartition(5)
    want = {}
    for key in {k for k, v in data if v is not None}:
        want[key] = statistics.median([v for k, v in data if k == key])
    got = {r[0]: r[1] for r in A.exact_median(df, "k", "v", "m").collect()}
    assert got == want


def test_median_of_doubles(spark):
    df = spark.createDataFrame([("a", 1.5), ("a", 2.0), ("b", 4.0)], "k string, v double")
    assert rows(A.exact_median(df, "k", "v", "m")) == [("a", 1.75), ("b", 4.0)]


def test_median_of_doubles_of_every_size(spark):
    """Signs, zeros, magnitudes from the least to the greatest, values that differ in the last bit."""
    rng = random.Random(4)
    kinds = [
        lambda: rng.gauss(0, 1),
        lambda: 10 ** rng.uniform(-310, 300),
        lambda: -(10 ** rng.uniform(-5, 5)),
        lambda: float(rng.randrange(5)),
        lambda: rng.choice([0.0, -0.0, 5e-324, 1e-320, 999.9999999999999, 1000.0, 1000.0000000000001]),
        lambda: 1000 + rng.random() * 1e-9,
    ]
    data = [(k, make()) for k, make in enumerate(kinds * 4) for _ in range(rng.choice([1, 2, 3, 100, 401]))]
    inf, nan = float("inf"), float("nan")
    data += [(90, x) for x in (inf, 1.0, 2.0)] + [(91, x) for x in (-inf, -inf, 3.0)] + [(92, None), (None, 1.0)]
    # NaN comes last.
    odd = [(93, x) for x in (nan, 1.0, 2.0)]
    df = spark.createDataFrame(data + odd, "k int, v double").repartition(5)
    want = {k: statistics.median([v for q, v in data if q == k]) for k in {k for k, v in data if None not in (k, v)}}
    assert {r[0]: r[1] for r in A.exact_median(df, "k", "v", "m").collect()} == want | {93: 2.0}


def test_leading_digits_never_fall(spark):
    rng = random.Random(8)
    values = sorted([rng.choice([-1, 1]) * 10 ** rng.uniform(-305, 305) for _ in range(4000)] + [10.0**k for k in range(-30, 31)] + [0.0, 5e-324, -5e-324])
    df = spark.createDataFrame([(v,) for v in values], "v double").coalesce(1)
    codes = [r[0] for r in df.select(A._leading_digits(F.col("v"))).collect()]
    assert codes == sorted(codes)


def test_weighted_average_is_zero_without_weight(spark):
    df = spark.createDataFrame(
        [("a", D("10.00"), 4), ("a", D("5.00"), 2), ("b", D("3.00"), 0)], "k string, t decimal(12,2), w bigint"
    )
    assert rows(A.weighted_average(df, ["k"], "t", "w", "m")) == [("a", D("2.5000")), ("b", D("0.0000"))]


def test_sample_size_seed_and_membership(spark):
    df = spark.range(0, 20000, 1, 7)
    first = [r[0] for r in quality.random_sample(df, 300, seed=1).collect()]
    again = [r[0] for r in quality.random_sample(df, 300, seed=1).collect()]
    other = [r[0] for r in quality.random_sample(df, 300, seed=2).collect()]
    assert len(set(first)) == 300 and first == again and set(first) != set(other)
    assert max(first) > 15000 and min(first) < 5000
    assert len(quality.random_sample(spark.range(40), 300).collect()) == 40
    assert quality.random_sample(spark.range(0), 300).collect() == []


def test_sample_does_not_depend_on_the_partitioning(spark):
    df = spark.range(0, 5000).selectExpr("id", "id % 7 as k", "cast(null as string) as n")
    pick = lambda d: sorted(r[0] for r in quality.random_sample(d, 300).collect())
    assert pick(df.repartition(3)) == pick(df.repartition(7)) == pick(df.coalesce(1))
    copies = spark.range(0, 5000).selectExpr("cast(id >= 4990 as int) as k")
    assert len(quality.random_sample(copies, 300).collect()) == 300
    assert quality.head(df, 3).count() == 3


def test_sample_reads_its_input_once_in_bounded_groups(spark, tmp_path):
    spark.range(0, 4000, 1, 12).selectExpr("id", "id % 9 as k").write.parquet(f"{tmp_path}/rows")
    df = spark.read.parquet(f"{tmp_path}/rows")
    sample = quality.random_sample(df, 50, tasks=3)
    plan = sample._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "TakeOrderedAndProject" in plan and "Coalesce 3" in plan
    assert sample.collect() == quality.random_sample(df.repartition(5), 50).collect()


def test_median_of_wide_decimals_and_hot_keys_without_broadcasts(spark):
    df = spark.range(0, 20001).selectExpr("if(id % 3 = 0, 'hot', concat('k', id % 5)) as k", "cast(id * 0.0000000000123 + 1e9 as decimal(32,13)) as v")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r[0]: r[1] for r in A.exact_median(df, "k", "v", "m").collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    groups = {}
    for r in df.collect():
        groups.setdefault(r["k"], []).append(r["v"])
    assert got == {k: statistics.median(v) for k, v in groups.items()}


def test_pivot_refuses_an_unlisted_value(spark):
    df = spark.createDataFrame([("a", 2023, 1), ("a", 2024, 2)], "k string, y int, n int")
    assert reshape.pivot_cells(df, "k", "y", None, "n").collect()[0].asDict() == {"k": "a", "2023": 1, "2024": 2}
    with pytest.raises(Exception, match="not listed: 2024"):
        reshape.pivot_cells(df, "k", "y", [2023], "n").collect()


def test_declared_order_spreads_over_tasks(spark):
    df = spark.range(0, 20000).selectExpr("id", "if(id % 3 = 0, 'x', 'y') as label").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sorted_ = ordering.in_declared_order(df, "label", ["y", "x"], "id")
        sizes = [r["count"] for r in sorted_.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) >= 3 and max(sizes) < 10000
    assert [r["label"] for r in sorted_.collect()] == sorted((r["label"] for r in df.collect()), reverse=True)


def test_profile_and_reconcile(spark):
    df = spark.createDataFrame([(1, None), (2, "x"), (3, None)], "a int, `b c` string")
    assert rows(quality.profile(df)) == [(0, "a", "int", 3, 0), (1, "b c", "string", 1, 2)]
    assert rows(quality.reconcile(df, df.filter("a > 1"))) == [(3, 2, 1)]
    assert rows(quality.row_counts({"x": df, "y": df.limit(0)})) == [("x", 3), ("y", 0)]


def test_share_of_total_rounds_each_row(spark):
    df = spark.createDataFrame([("e", "a", 1), ("e", "b", 2), ("f", "a", 5)], "env string, kind string, n bigint")
    got = rows(windows.share_of_total(df, "n", "env", "pct"))
    assert got == [("e", "a", 1, D("33.3")), ("e", "b", 2, D("66.7")), ("f", "a", 5, D("100.0"))]


def test_previous_value_is_that_of_the_other_chosen_year(spark):
    land = spark.createDataFrame(
        [("Z1", 2001, 1), ("Z1", 2005, 9), ("Z1", 2011, 4), ("Z2", 2011, 7)], "ZCTA20 string, YEAR int, v int"
    )
    got = rows(windows.previous_year_value(land, F.col("v"), (2001, 2011), "now", "before"))
    assert got == [("Z1", 2001, 1, None), ("Z1", 2011, 4, 1), ("Z2", 2011, 7, None)]


def test_pivot_keeps_absent_cells_null_and_rejects_two_rows_per_cell(spark):
    df = spark.createDataFrame([(0, 2000, 5), (10, 2001, 6)], "b int, y int, n bigint")
    assert rows(reshape.pivot_cells(df, "b", "y", [2000, 2001, 2002], "n")) == [(0, 5, None, None), (10, None, 6, None)]
    clash = df.union(df.limit(1))
    with pytest.raises(Exception, match="more than one row"):
        reshape.pivot_cells(clash, "b", "y", [2000, 2001], "n").collect()
    assert rows(reshape.pivot_mean(clash, "b", "y", [2000, 2001], "n")) == [(0, 5.0, None), (10, None, 6.0)]


def test_top_keys_break_ties_by_key_and_ignore_null(spark):
    df = spark.createDataFrame([("c", 3), ("b", 3), ("a", 1), (None, 9), ("d", 3)], "k string, n bigint")
    assert [r[0] for r in ordering.top_keys(df, "k", "n", 2).collect()] == ["b", "c"]
    assert rows(ordering.rows_of_top_keys(df, "k", "n", 2)) == [("b", 3), ("c", 3)]


def test_declared_order(spark):
    df = spark.createDataFrame([("x",), ("z",), ("y",)], "k string")
    assert [r[0] for r in ordering.in_declared_order(df, "k", ["z", "x"]).collect()] == ["z", "x"]


def test_sorted_write_spreads_one_hot_key_and_keeps_order(spark):
    """A key with a third of all rows fills several files, in global key order."""
    df = spark.range(0, 3000, 1, 6).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("id"))
    path = tables.write_sorted(df, scratch_path(spark, "test-sorted"), "id", partitions=8)
    back = tables.read_table(spark, path).withColumn("file", F.input_file_name())
    assert rows(back.select("id")) == rows(df)
    spans = back.groupBy("file").agg(F.min("id"), F.max("id"), F.count_if(F.col("id") == "hot").alias("hot")).collect()
    assert sum(1 for s in spans if s["hot"]) > 1
    ordered = sorted((s[1], s[2]) for s in spans)
    assert all(a[1] <= b[0] for a, b in zip(ordered, ordered[1:]))


def test_year_layout_prunes_folders_and_loses_nothing(spark):
    df = spark.range(0, 900).select(
        (F.col("id") % 3 + 2000).cast("int").alias("yearOfLoss"),
        F.lpad((F.col("id") % 50).cast("string"), 5, "0").alias("clean_zip"),
        F.col("id").cast("string").alias("id"),
    )
    path = tables.write_by_year(df, scratch_path(spark, "test-year"))
    one = tables.read_table(spark, path).filter(F.col("yearOfLoss") == 2001)
    assert one.count() == 300
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(yearOfLoss" in plan
    counts = Counter(r[0] for r in tables.read_table(spark, path).select("yearOfLoss").collect())
    assert counts == {2000: 300, 2001: 300, 2002: 300}


def test_matrix_with_every_value_that_occurs(spark):
    df = spark.createDataFrame(
        [("a", 2, 1, 1.0), ("a", 10, 2, None), ("b", 2, None, 4.0), ("c", None, 5, 6.0), (None, 3, 7, 8.0)],
        "r string, c int, `x y` int, z double",
    )
    cells = reshape.pivot_cells(df, "r", "c", None, "x y")
    assert cells.columns == ["r", "2", "3", "10"]
    want = {("a", 1, None, 2), ("b", None, None, None), ("c", None, None, None), (None, None, 7, None)}
    assert {tuple(r) for r in cells.collect()} == want
    assert {tuple(r) for r in reshape.pivot_cells(df, "r", "c", [2, 3, 10], "x y").collect()} == want
    twice = df.union(df)
    means = reshape.pivot_mean(twice, "r", "c", None, "x y", "z")
    assert means.columns == reshape.pivot_mean(twice, "r", "c", [2, 3, 10], "x y", "z").columns
    assert sorted(map(repr, means.collect())) == sorted(map(repr, reshape.pivot_mean(twice, "r", "c", [2, 3, 10], "x y", "z").collect()))
    with pytest.raises(Exception, match="more than one row for a cell"):
        reshape.pivot_cells(twice, "r", "c", None, "x y")
    assert reshape.pivot_cells(df.limit(0), "r", "c", None, "x y").columns == ["r"]


def test_matrix_has_no_more_columns_than_a_pivot(spark):
    df = spark.range(30).selectExpr("id % 3 as r", "id as c", "id as v")
    limit = "spark.sql.pivotMaxValues"
    try:
        spark.conf.set(limit, "29")
        with pytest.raises(ValueError, match="more than 29 values"):
            reshape.pivot_cells(df, "r", "c", None, "v")
        spark.conf.set(limit, "30")
        assert len(reshape.pivot_cells(df, "r", "c", None, "v").columns) == 31
    finally:
        spark.conf.unset(limit)

"""Reports on hand-made tables: the cases that are easy to get wrong."""

from dataclasses import replace
from decimal import Decimal as D

import pytest

from claimscope.plans import reports as R
from claimscope.plans import summaries as S
from claimscope.plans.tables import Tables

CLAIM_COLUMNS = {
    "id": "string",
    "yearOfLoss": "int",
    "clean_zip": "string",
    "reportedZipCode": "string",
    "amountPaidOnBuildingClaim": "decimal(12,2)",
    "amountPaidOnContentsClaim": "decimal(12,2)",
    "waterDepth": "int",
    "primaryResidenceIndicator": "boolean",
    "causeOfDamage": "string",
    "eventDesignationNumber": "string",
    "floodEvent": "string",
    "policyCount": "int",
    "buildingPropertyValue": "int",
}
LAND = (
    "DEV_LOWINTENSITY DEV_MEDINTENSITY DEV_HIINTENSITY WOODYWET HERBWET DECIDUOUSFOREST EVERGREENFOREST "
    "MIXEDFOREST SHRUBSCRUB PASTUREHAY CULTCROPS"
).split()


def frame(spark, columns, rows):
    return spark.createDataFrame([[r.get(c) for c in columns] for r in rows], ", ".join(f"{c} {t}" for c, t in columns.items()))


def claims(spark, *rows):
    numbered = []
    for n, row in enumerate(rows):
        row = {"id": f"c{n}", "yearOfLoss": 2020, "clean_zip": "00001", **row}
        row.setdefault("reportedZipCode", row["clean_zip"])
        for c in ("amountPaidOnBuildingClaim", "amountPaidOnContentsClaim"):
            row[c] = None if row.get(c) is None else D(str(row[c]))
        numbered.append(row)
    return frame(spark, CLAIM_COLUMNS, numbered)


def land(spark, *rows):
    columns = {"ZCTA20": "string", "YEAR": "int", **{f"PROP_{c}": "decimal(15,13)" for c in LAND}}
    filled = [{**{f"PROP_{c}": D(str(r.get(c, 0))) for c in LAND}, "ZCTA20": r["zcta"], "YEAR": r["year"]} for r in rows]
    return frame(spark, columns, filled)


def index(spark, *rows):
    return spark.createDataFrame([(y, None if v is None else D(v)) for y, v in rows], "cpi_year int, cpi_value decimal(10,3)")


@pytest.fixture
def base(spark):
    """Two mapped codes in one city area, one code in a wet area, one unmapped."""
    return Tables(
        claims=claims(spark, {}),
        crosswalk=spark.createDataFrame(
            [
                ("00001", "Z1", "Zip matches ZCTA"),
                ("00002", "Z1", "Spatial join to ZCTA"),
                ("00003", "Z2", "Zip matches ZCTA"),
                ("00004", None, "Zip matches ZCTA"),
            ],
            "zip_code string, zcta string, zip_join_type string",
        ),
        land=land(
            spark,
            {"zcta": "Z1", "year": 2019, "DEV_HIINTENSITY": 0.6},
            {"zcta": "Z1", "year": 2020, "DEV_HIINTENSITY": 0.6},
            {"zcta": "Z2", "year": 2019, "WOODYWET": 0.7},
            {"zcta": "Z2", "year": 2020, "WOODYWET": 0.7},
        ),
        index=index(spark, (2019, "200.000"), (2020, "250.000"), (2026, "0.000")),
    )


def out(df):
    return [tuple(r) for r in df.collect()]


def test_trend_clamps_restates_and_survives_a_zero_index(spark, base):
    t = replace(
        base,
        claims=claims(
            spark,
            {"yearOfLoss": 2019, "amountPaidOnBuildingClaim": 100, "amountPaidOnContentsClaim": -5, "waterDepth": 12},
            {"yearOfLoss": 2019, "amountPaidOnBuildingClaim": None, "waterDepth": -1, "primaryResidenceIndicator": True},
            {"yearOfLoss": 2019, "amountPaidOnBuildingClaim": -9, "waterDepth": 11},
            {"yearOfLoss": 2026, "amountPaidOnBuildingClaim": 7},
            {"yearOfLoss": 2018, "amountPaidOnBuildingClaim": 7},
            {"yearOfLoss": 1984},
            {"yearOfLoss": None},
        ),
    )
    rate = D("0.3333")
    assert out(R.macro_trend(t)) == [
        (2019, 3, D("125.000000000"), rate, rate, rate),
        (2026, 1, None, D("0.0000"), D("0.0000"), D("0.0000")),
    ]
    assert [r[:3] for r in out(R.trend_real_preaggregated(t))] == [(2019, 3, D("100.00")), (2026, 1, D("7.00"))]
    nominal = out(R.trend_nominal(t))
    assert [r[0] for r in nominal] == [2018, 2019, 2026]
    assert nominal[1] == (2019, 3, D("100.00"), D("7.3333"), rate)


def test_monthly_index_splits_a_year(spark, base):
    t = replace(base, index=index(spark, (2020, "250.000"), (2020, "200.000"), (2020, "200.000")))
    got = out(R.macro_trend(t, base_year=2020))
    assert sorted(r[1] for r in got) == [1, 2]


def test_archetype_cost_denominators(spark, base):
    t = replace(
        base,
        claims=claims(
            spark,
            {"amountPaidOnBuildingClaim": 100},
            {"amountPaidOnBuildingClaim": 0, "clean_zip": "00002"},
            {"amountPaidOnBuildingClaim": 50, "yearOfLoss": 2019},
            {"clean_zip": "00003"},
            {"clean_zip": "00004", "amountPaidOnBuildingClaim": 999},
            {"reportedZipCode": None, "amountPaidOnBuildingClaim": 999},
        ),
    )
    city, wet = out(R.archetype_cost(t))
    assert city[:3] == ("Highly Developed (>50%)", 3, 2)
    assert city[3] == D("50.000000") and city[5] == D("75.000000")
    assert city[4].quantize(D("1e-6")) == D("54.166667") and city[6] == D("81.25")
    assert wet == ("Highly Natural/Wetland (>50%)", 1, None, D(0), D(0), None, None)


def test_totals_of_archetypes_and_buckets_agree(spark, base):
    t = replace(
        base,
        claims=claims(spark, *[{"clean_zip": f"0000{1 + n % 4}", "yearOfLoss": 2019 + n % 2} for n in range(40)]),
    )
    buckets = R.impervious_buckets(t)
    assert sum(r[1] for r in out(R.archetype_cost(t))) == sum(r[2] for r in out(buckets)) == 30
    order = [(-r[0], r[1]) for r in out(buckets)]
    assert order == sorted(order)
    assert sum(r[1] for r in out(S.bucket_totals(buckets))) == sum(r[2] for r in out(S.band_trend(buckets))) == 30


def test_flood_types_share_and_counts(spark, base):
    causes = ["2"] + ["4"] * 2 + ["1"]
    t = replace(base, claims=claims(spark, *[{"causeOfDamage": c} for c in causes], {"causeOfDamage": "2", "clean_zip": "00003"}))
    got = out(R.flash_vs_river(t))
    assert got == [
        ("High Concrete", "Flash Flood (Rain Accumulation)", 2, D("66.7")),
        ("High Concrete", "River/Stream Overflow", 1, D("33.3")),
        ("High Natural", "River/Stream Overflow", 1, D("100.0")),
    ]
    assert out(R.flash_vs_river_counts(t)) == [r[:3] for r in got]
    mix = [r.asDict() for r in S.flood_type_mix(R.flash_vs_river(t)).collect()]
    assert [m["environment_type"] for m in mix] == ["High Concrete", "High Natural"]
    assert mix[0]["River/Stream Overflow label"] == "1 claims\n(33.3%)"
    assert mix[1]["Flash Flood (Rain Accumulation) label"] is None


def storm_rows():
    """Storm N1 has exactly four sized claims, N2 three; names vary in case."""
    return [
        {"eventDesignationNumber": " N1 ", "floodEvent": "Alpha", "amountPaidOnBuildingClaim": 10},
        {"eventDesignationNumber": "n1", "floodEvent": "ALPHA", "amountPaidOnBuildingClaim": 30},
        {"eventDesignationNumber": "N1", "floodEvent": "Beta", "clean_zip": "00003"},
        {"eventDesignationNumber": "N1", "floodEvent": None},
        {"eventDesignationNumber": "N1", "floodEvent": "FLOODING", "amountPaidOnBuildingClaim": 5},
        {"eventDesignationNumber": "N2", "floodEvent": "Gamma"},
        {"eventDesignationNumber": "N2", "floodEvent": "Gamma"},
        {"eventDesignationNumber": "N2", "floodEvent": "Gamma"},
        {"eventDesignationNumber": "  ", "floodEvent": "  "},
        {"eventDesignationNumber": "", "floodEvent": "Storm"},
    ]


def test_storms_need_more_claims_than_the_limit_and_keep_generic_detail(spark, base):
    t = replace(base, claims=claims(spark, *storm_rows()))
    assert out(R.storm_control(t, min_claims=4)) == []
    got = out(R.storm_control(t, min_claims=3))
    # one row per environment; the generic claim counts in the detail, and the last name wins
    by_environment = sorted((r[3], r[0].lower(), r[1], r[4]) for r in got)
    assert by_environment == [
        ("1. Wetland Buffer (High Absorption)", "n1", "Beta", 1),
        ("2. Dense Urban (Concrete Shield)", "n1", "FLOODING", 4),
    ]
    wet, dense = sorted(got, key=lambda r: r[3])
    assert dense[5] == D("15") and dense[6] == D("45")
    assert wet[5] is None
    # by case, FLOODING is no generic name, so N1 passes; n1 is another storm and falls short
    exact = out(R.storm_control(t, min_claims=3, case_sensitive=True))
    assert [(r[0], r[1], r[4]) for r in exact] == [("N1", "Beta", 1), ("N1", "FLOODING", 3)]
    assert out(R.storm_control(t, min_claims=4, case_sensitive=True)) == []


def test_a_code_or_area_listed_several_times_counts_as_often(spark, base):
    """A crosswalk that names one code twice under one area, land with one area's year three times over."""
    twice, thrice = base.crosswalk.unionAll(base.crosswalk), base.land.unionAll(base.land).unionAll(base.land)
    t = replace(base, claims=claims(spark, *storm_rows()))
    repeated = replace(t, crosswalk=twice, land=thrice)
    once, often = (sorted(out(R.storm_control(x, min_claims=3)), key=lambda r: r[3]) for x in (t, repeated))
    assert [r[:4] for r in often] == [r[:4] for r in once] and [r[5] for r in often] == [r[5] for r in once]
    assert [(r[4], r[6]) for r in often] == [(6 * r[4], 6 * r[6]) for r in once]
    once, often = (sorted(out(R.storm_nominal(x, min_claims=2))) for x in (t, repeated))
    shown = {r[:3]: r[3:] for r in often}
    assert [shown[r[:3]] for r in once] == [(6 * r[3], r[4]) for r in once]


def test_one_storm_under_two_names_gives_two_rows(spark, base):
    rows = [{"eventDesignationNumber": "N1", "floodEvent": "Alpha", "yearOfLoss": 2020}] * 2 + [
        {"eventDesignationNumber": "N1", "floodEvent": "Beta", "yearOfLoss": 2019}
    ]
    t = replace(base, claims=claims(spark, *rows))
    got = out(R.storm_control(t, min_claims=2))
    assert sorted((r[1], r[2], r[4]) for r in got) == [("Alpha", 2020, 2), ("Beta", 2019, 1)]


def test_nominal_storms_leave_generic_names_out_of_the_detail(spark, base):
    t = replace(base, claims=claims(spark, *storm_rows()))
    got = out(R.storm_nominal(t, min_claims=2))
    assert [(r[0].lower(), r[1], r[3]) for r in got] == [("n1", "Alpha", 3), ("n2", "Gamma", 3)]
    assert got[0][4] == D("13.333333")


def test_bucket_reports_of_one_year(spark, base):
    t = replace(
        base,
        claims=claims(
            spark,
            {"amountPaidOnBuildingClaim": 10, "amountPaidOnContentsClaim": 5, "policyCount": 0},
            {"amountPaidOnBuildingClaim": 20, "policyCount": 3},
            {"clean_zip": "00003", "policyCount": None},
            {"yearOfLoss": 2019, "amountPaidOnBuildingClaim": 99},
        ),
    )
    real = out(R.bucket_frequency_real(t))
    assert real[0][:3] == (0, 1, None)
    assert real[1] == (60, 2, D("66.6700"), D("17.5"), D("35"))
    assert out(R.bucket_nominal(t))[1] == (60, 2, D("15.000000"), D("30.00"))
    assert out(R.bucket_frequency_nominal(t)) == [
        (0, 1, D("0.000000"), D("0.00"), D("100.0000")),
        (60, 2, D("15.000000"), D("30.00"), D("50.0000")),
    ]


def test_severity_uses_exact_matches_valued_buildings_and_the_latest_land_year(spark, base):
    t = replace(
        base,
        claims=claims(
            spark,
            {"amountPaidOnBuildingClaim": 50, "buildingPropertyValue": 200, "yearOfLoss": 2023},
            {"amountPaidOnBuildingClaim": 100, "buildingPropertyValue": 300},
            {"amountPaidOnBuildingClaim": 100, "buildingPropertyValue": 0},
            {"amountPaidOnBuildingClaim": 100, "buildingPropertyValue": 100, "clean_zip": "00002"},
            {"amountPaidOnBuildingClaim": 100, "buildingPropertyValue": 100, "yearOfLoss": 2018},
        ),
    )
    got = out(R.damage_severity(t, min_claims=1))
    assert got == [("1. Concrete Jungle (High Intensity)", 2, D("75.000000"), D("29.1666665000"))]
    assert out(R.damage_severity(t, min_claims=2)) == []


def test_sprawl_compares_the_two_chosen_years(spark, base):
    grown = land(
        spark,
        {"zcta": "Z1", "year": 2001, "DEV_LOWINTENSITY": 0.10},
        {"zcta": "Z1", "year": 2006, "DEV_LOWINTENSITY": 0.90},
        {"zcta": "Z1", "year": 2011, "DEV_LOWINTENSITY": 0.16},
        {"zcta": "Z2", "year": 2001, "DEV_LOWINTENSITY": 0.10},
        {"zcta": "Z2", "year": 2011, "DEV_LOWINTENSITY": 0.15},
    )
    rows = [{"yearOfLoss": 1990 + n} for n in range(11)] + [{"yearOfLoss": 2012 + n % 11} for n in range(17)]
    rows += [{"yearOfLoss": 2005}, {"yearOfLoss": 1995, "clean_zip": "00002"}]
    t = replace(base, claims=claims(spark, *rows), land=grown)
    assert out(R.sprawl_delta(t)) == [("Z1", D("6.00"), 11, 17, D("1.55"))]
    assert out(R.sprawl_delta(t, min_before=11)) == []


def storm_report(spark, *rows):
    return spark.createDataFrame(
        [(n, y, e, i, None if a is None else D(a)) for n, y, e, i, a in rows],
        "floodEventName string, yearOfLoss int, environment_type string, total_incidents bigint, "
        "avg_building_payout_2020_dollars decimal(32,13)",
    )


def test_storm_summaries_are_not_weighted(spark):
    suburb, mixed = "3. Suburban Sprawl", "6. Mixed/Transition Zone"
    report = storm_report(
        spark,
        ("A", 2005, suburb, 900, "10"),
        ("B", 2006, suburb, 1, "30"),
        ("C", 2007, suburb, 1, "80"),
        ("D", 2007, suburb, 5, None),
        ("A", 2005, mixed, 1000, "50"),
        (None, 2005, mixed, 5000, "70"),
    )
    got = out(S.storm_environment(report))
    assert got == [
        ("Mixed/Transition Zone", "Mixed/Transition Zone", 6000, D(60), D(60)),
        ("Suburban Sprawl", "Suburban Sprawl", 907, D(40), D(30)),
    ]
    top = S.top_storms(report, 2).collect()
    assert sorted((r["floodEventName"], r["env_short"]) for r in top) == [
        ("A", "Mixed/Transition Zone"), ("A", "Suburban Sprawl"), ("D", "Suburban Sprawl"),
    ]


def bucket_report(spark):
    avg, total = "Avg Payout per Claim (2020 Dollars)", "Total Payouts (2020 Dollars)"
    rows = [(2023, 0, 2, "15.0", "30.0"), (2023, 10, 4, "2.5", "10.0"), (2022, 10, 1, "90.0", "90.0"), (2022, 100, 0, None, None)]
    return spark.createDataFrame(
        [(y, b, n, a and D(a), t and D(t)) for y, b, n, a, t in rows],
        f"Year int, `{R.BUCKET}` int, `Total Claims` bigint, `{avg}` decimal(32,13), `{total}` decimal(28,9)",
    )


def test_bucket_summaries(spark):
    report = bucket_report(spark)
    assert out(S.bucket_totals(report)) == [(0, 2), (10, 5), (100, 0)]
    assert out(S.bucket_weighted_average(report)) == [(0, D(15)), (10, D(20)), (100, D(0))]
    assert out(S.heatmap_volume(report)) == out(S.heatmap_volume(report, [2022, 2023]))
    with pytest.raises(Exception, match="not listed"):
        S.heatmap_volume(report, [2022]).collect()
    assert out(S.heatmap_volume(report, [2022, 2023])) == [(100, 0, None), (10, 1, 4), (0, None, 2)]
    assert out(S.heatmap_severity(report, [2022, 2023])) == [(100, None, None), (10, D(90), D("2.5")), (0, None, D(15))]


def test_trend_series_scales_to_percent(spark):
    report = spark.createDataFrame(
        [(2026, 221, None, D("0.0226"), D("0.0000"), D("0.5339"))],
        "yearOfLoss int, total_claims bigint, real_total_paid_out_2020 decimal(28,9), "
        "pct_severe_above_ground_floods decimal(23,4), pct_basement_floods decimal(23,4), pct_primary_residence decimal(23,4)",
    )
    assert out(S.trend_series(report)) == [(2026, 221, None, D("2.26"), D("0"), D("53.39"))]

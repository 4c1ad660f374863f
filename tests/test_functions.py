"""Column expressions on hand-made edge rows."""

import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimscope.constants import GENERIC_EVENT_NAMES
from claimscope.functions import landcover as L
from claimscope.functions import money as M
from claimscope.functions import text as X
from claimscope.functions.lenient import lenient


def column(spark, rows, ddl, *exprs):
    return [tuple(r) for r in spark.createDataFrame(rows, ddl).select(*exprs).collect()]


def test_blank_text_and_postal_code(spark):
    rows = [("  ",), ("",), (None,), (" 02134-1234 ",)]
    got = column(spark, rows, "c string", X.blank_to_null(F.col("c")), X.zip5(F.col("c")))
    assert got == [(None, ""), (None, ""), (None, None), ("02134-1234", "02134")]


def test_first_identity_prefers_the_first_non_blank(spark):
    rows = [(" N1 ", "Storm A"), ("  ", " Storm A "), (None, "  "), (None, None)]
    got = column(spark, rows, "a string, b string", X.first_identity(F.col("a"), F.col("b")))
    assert [r[0] for r in got] == ["N1", "Storm A", None, None]


def test_generic_names_ignore_case_but_keep_null(spark):
    rows = [("FLOODING",), ("Flooding",), ("Hurricane A",), (None,)]
    any_case = column(spark, rows, "c string", X.is_named(F.col("c"), GENERIC_EVENT_NAMES))
    exact = column(spark, rows, "c string", X.is_named(F.col("c"), GENERIC_EVENT_NAMES, True))
    assert [r[0] for r in any_case] == [False, False, True, True]
    assert [r[0] for r in exact] == [True, False, True, True]


def test_labels(spark):
    rows = [("1. Wetland Buffer (High Absorption)",), ("Plain (x)",)]
    got = column(spark, rows, "c string", X.without_rank_prefix(F.col("c")), X.wrapped_label(F.col("c")))
    assert got == [
        ("Wetland Buffer (High Absorption)", "Wetland Buffer\n(High Absorption)"),
        ("Plain (x)", "Plain\n(x)"),
    ]
    rows = [(271964, D("75.5"))]
    got = column(spark, rows, "n bigint, p decimal(10,1)", X.count_label(F.col("n"), F.col("p")))
    assert got == [("271,964 claims\n(75.5%)",)]


def test_cause_label_sends_every_other_code_to_the_default(spark):
    got = column(spark, [("2",), ("4",), (None,)], "c string", X.cause_label(F.col("c"), {"2": "River"}, "Rain"))
    assert [r[0] for r in got] == ["River", "Rain", "Rain"]


def test_payments_floor_at_zero_each_on_its_own(spark):
    rows = [(D("-5.00"), D("7.25")), (None, D("1.00")), (None, None), (D("2.50"), D("-1.00"))]
    got = column(spark, rows, "b decimal(12,2), c decimal(12,2)", M.total_paid(F.col("b"), F.col("c")))
    assert [r[0] for r in got] == [D("7.25"), D("1.00"), D("0.00"), D("2.50")]


def test_policy_floor(spark):
    got = column(spark, [(None,), (0,), (-2,), (7,)], "c int", M.at_least(F.col("c")))
    assert [r[0] for r in got] == [1, 1, 1, 7]


def test_quotient_rounds_half_up_and_is_null_over_zero(spark):
    rows = [(1, 8), (1, 3), (2, 3), (-1, 8), (5, 0), (None, 3)]
    got = column(spark, rows, "a bigint, b bigint", M.quotient(F.col("a"), F.col("b"), 2))
    assert [r[0] for r in got] == [D("0.13"), D("0.33"), D("0.67"), D("-0.13"), None, None]


def test_quotient_keeps_seventeen_digits_on_large_totals(spark):
    rows = [(D("15347039999999999.1234567890123"), 370451)]
    got = column(spark, rows, "a decimal(30,13), b bigint", M.quotient(F.col("a"), F.col("b"), 17, 13))
    want = (rows[0][0] / D(370451)).quantize(D("1e-17"))
    assert got[0][0] == want


def test_published_index_arithmetic(spark):
    """Index values 258.856 and 304.703 give the published ratio, total and average."""
    rows = [(D("258.856"), D("304.703"), D("88113035.74"), 2337), (D("258.856"), D("0.000"), D("1.00"), 1)]
    ratio = M.reported_ratio(F.col("b"), F.col("c"))
    real = M.restated(F.col("n"), ratio)
    got = column(
        spark, rows, "b decimal(10,3), c decimal(10,3), n decimal(22,2), k bigint",
        ratio, real, M.quotient(real, F.col("k"), 13, 9),
    )
    total = D("88113035.74") * D("0.8495354")
    assert got[0] == (D("0.8495354"), total, (total / 2337).quantize(D("1e-13")))
    assert got[1] == (None, None, None)


def test_base_year_restates_to_itself(spark):
    rows = [(D("258.856"), D("123456789012.34"))]
    real = M.restated(F.col("n"), M.price_ratio(F.col("b"), F.col("b")))
    assert column(spark, rows, "b decimal(10,3), n decimal(22,2)", real)[0][0] == rows[0][1]


SHARES = (
    "PROP_DEV_LOWINTENSITY PROP_DEV_MEDINTENSITY PROP_DEV_HIINTENSITY PROP_WOODYWET PROP_HERBWET "
    "PROP_DECIDUOUSFOREST PROP_EVERGREENFOREST PROP_MIXEDFOREST PROP_SHRUBSCRUB PROP_PASTUREHAY PROP_CULTCROPS"
).split()
SHORT = "low med hi woody herb decid everg mixed shrub pasture crops".split()


def land(spark, *areas):
    """Rows of land shares; what an area does not name is zero."""
    rows = [[D(str(a.get(s, 0))) if a.get(s, 0) is not None else None for s in SHORT] for a in areas]
    return spark.createDataFrame(rows, ", ".join(f"{c} decimal(15,13)" for c in SHARES))


def labels(frame, scheme):
    return [r[0] for r in frame.select(scheme.label()).collect()]


def test_three_way_is_strict_and_takes_the_first_match(spark):
    frame = land(
        spark,
        {"med": 0.5},
        {"med": 0.25, "hi": 0.2500000000001},
        {"woody": 0.2, "herb": 0.2, "decid": 0.2},
        {"hi": 0.45, "decid": 0.55},
        {"hi": None, "decid": 0.9},
        {"hi": None, "decid": None},
    )
    assert labels(frame, L.COST_SCHEME) == [
        "Mixed/Other",
        "Highly Developed (>50%)",
        "Highly Natural/Wetland (>50%)",
        "Highly Natural/Wetland (>50%)",
        "Highly Natural/Wetland (>50%)",
        "Mixed/Other",
    ]
    assert labels(frame, L.FLOOD_TYPE_SCHEME) == [
        "High Concrete",
        "High Concrete",
        "High Natural",
        "High Concrete",
        "High Natural",
        "Mixed",
    ]


def test_six_way_order_and_inclusive_limits(spark):
    frame = land(
        spark,
        {"woody": 0.25, "hi": 0.75},
        {"med": 0.5},
        {"low": 0.4, "hi": 0.1},
        {"decid": 0.1, "everg": 0.1, "mixed": 0.1, "shrub": 0.2},
        {"pasture": 0.3, "crops": 0.2},
        {"low": 0.49},
    )
    assert [x[0] for x in labels(frame, L.storm_scheme())] == list("123456")


def test_five_way_order(spark):
    frame = land(spark, {"hi": 0.5}, {"low": 0.5}, {"herb": 0.5}, {"shrub": 0.5}, {"crops": 1})
    assert [x[0] for x in labels(frame, L.severity_scheme())] == list("12345")


def test_decile_rounds_half_up_and_bands_include_their_limits(spark):
    frame = land(spark, {"low": 0.05}, {"low": 0.0499}, {"low": 0.35}, {"low": 0.6}, {"low": 0.3, "hi": 0.35}, {})
    got = [tuple(r) for r in frame.select(L.impervious_percent(), L.density_band(L.impervious_percent())).collect()]
    low, medium, high = "Low (0-30%)", "Medium (40-60%)", "High (70-100%)"
    assert got == [(10, low), (0, low), (40, medium), (60, medium), (70, high), (0, low)]


def test_lenient_casts(spark):
    rows = [("0000-00-00",), ("2005-08-29",), ("",), (None,), ("x",)]
    got = column(spark, rows, "c string", lenient(F.col("c"), T.DateType()))
    assert [r[0] for r in got] == [None, dt.date(2005, 8, 29), None, None, None]
    rows = [("",), (" 12 ",), (None,), ("x",)]
    as_null = column(spark, rows, "c string", lenient(F.col("c"), T.IntegerType()))
    as_zero = column(spark, rows, "c string", lenient(F.col("c"), T.IntegerType(), "zero"))
    assert [r[0] for r in as_null] == [None, 12, None, None]
    assert [r[0] for r in as_zero] == [0, 12, 0, 0]
    flags = column(spark, [("1",), ("0",), ("",)], "c string", lenient(F.col("c"), T.BooleanType()))
    assert [r[0] for r in flags] == [True, False, None]
    with pytest.raises(ValueError):
        lenient(F.col("c"), T.IntegerType(), "skip")


def test_lenient_numbers(spark):
    from pyspark.sql import types as T

    from claimscope.functions.lenient import lenient

    cells = ["3.0", "1234.56", "12abc", "40000", "-2.5", "", " 7 ", None, "1e3", "abc", "9" * 40, "-" + "9" * 40, "1e-50"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")

    def cast(kind, policy):
        return [r[0] for r in df.orderBy("i").select(lenient(F.col("c"), kind, policy)).collect()]

    assert cast(T.ShortType(), "null") == [3, 1235, None, None, -3, None, 7, None, 1000, None, None, None, 0]
    assert cast(T.ShortType(), "zero") == [3, 1235, 12, 32767, -3, 0, 7, 0, 1000, 0, 32767, -32768, 0]
    assert cast(T.IntegerType(), "zero")[10:12] == [2147483647, -2147483648]
    assert cast(T.DecimalType(5, 2), "zero")[:5] == [D("3.00"), D("999.99"), D("12.00"), D("999.99"), D("-2.50")]
    dates = spark.createDataFrame([(c,) for c in ("2020-01-05", "40000", "0000-00-00", "2020-02-30")], "c string")
    assert [r[0] is not None for r in dates.select(lenient(F.col("c"), T.DateType())).collect()] == [True, False, False, False]


def test_lenient_matches_a_cell_once(spark):
    from pyspark.sql import types as T

    cells = [("7e-1x",), ("5.",), ("-.5",), ("+",), ("6e-11",), ("1e-999999999",), ("1e29",), ("\t5",)]
    df = spark.createDataFrame(cells, "c string")
    kinds = {"i": T.IntegerType(), "d": T.DecimalType(12, 2)}
    typed = df.select(*[lenient(F.col("c"), t, "zero").alias(n) for n, t in kinds.items()])
    most = 2147483647, D("9999999999.99")
    assert [r["i"] for r in typed.collect()] == [1, 5, -1, 0, 0, 0, most[0], 0]
    assert [r["d"] for r in typed.collect()] == [D("0.70"), D(5), D("-0.50"), 0, 0, 0, most[1], 0]
    plan = df.select(lenient(F.concat(F.col("c"), F.lit("0")), T.DecimalType(12, 2), "zero").alias("x"))
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") == 1


def test_an_index_near_zero_leaves_its_year_without_a_ratio(spark):
    from claimscope.functions.money import price_ratio

    df = spark.createDataFrame([(D("258.8"), D("0.02")), (D("258.8"), D("129.4")), (D("258.8"), D("0"))], "b decimal(14,7), c decimal(14,7)")
    assert [r[0] for r in df.select(price_ratio(F.col("b"), F.col("c"))).collect()] == [None, D("2.00000000000000"), None]

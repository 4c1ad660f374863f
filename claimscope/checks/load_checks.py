"""Sources, sinks, cleaning and quality queries over the stand-in tables.

Round trips write the whole table to the shared folder and read it back.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimscope.checks.oracle_parts import dbl, quo, real9, scaled, with_views
from claimscope.checks.report_checks import AVG_BUCKET, BASE, BUCKETS, FIRST, SUM_BUCKET, TREND, trend
from claimscope.checks.report_checks import buckets as bucket_report
from claimscope.checks.standins import Standins
from claimscope.operators import clean, joins, quality
from claimscope.plans.reports import BUCKET
from claimscope.schemas import columns
from claimscope.session import scratch_path
from claimscope.sources import buckets, catalogue, delimited, tables

CELLS = [
    "id",
    "yearOfLoss",
    "dateOfLoss",
    "amountPaidOnBuildingClaim",
    "amountPaidOnContentsClaim",
    "waterDepth",
    "primaryResidenceIndicator",
    "eventDesignationNumber",
    "reportedZipCode",
]
CELLS_SQL = f"""id, yearOfLoss, dateOfLoss, {dbl("amountPaidOnBuildingClaim")} as amountPaidOnBuildingClaim,
  {dbl("amountPaidOnContentsClaim")} as amountPaidOnContentsClaim, waterDepth, primaryResidenceIndicator,
  eventDesignationNumber, reportedZipCode"""
LAND_SQL = "ZCTA20, YEAR, " + ", ".join(
    f"{dbl(c)} as {c}"
    for c in (
        "PROP_DEV_LOWINTENSITY PROP_DEV_MEDINTENSITY PROP_DEV_HIINTENSITY PROP_WOODYWET PROP_HERBWET "
        "PROP_DECIDUOUSFOREST PROP_EVERGREENFOREST PROP_PASTUREHAY PROP_MIXEDFOREST PROP_SHRUBSCRUB PROP_CULTCROPS"
    ).split()
)
# A depth with .5 after it, rounded half away from zero.
HALF_AWAY = "case when waterDepth < 0 then waterDepth - 1 else waterDepth + 1 end"
DEPTH_OR_NULL = f"""cast(case when causeOfDamage = '1' then {HALF_AWAY} when causeOfDamage in ('2', '3', '4') then null
  else waterDepth end as int) as waterDepth"""
LINE_KEY = ["l_orderkey", "l_linenumber"]
IMPOSSIBLE = "0000-00-00"


def cells(s: Standins):
    return s.claims.select(*CELLS)


def landed(s: Standins, df, label: str, **options) -> str:
    return delimited.write_csv(df, scratch_path(s.spark, label), **options)


def scan_csv(s: Standins):
    return delimited.read_typed(s.spark, landed(s, cells(s), "csv"), cells(s).schema)


def scan_tsv(s: Standins):
    return delimited.read_tab_separated(s.spark, landed(s, s.land, "tsv", sep="\t"), s.land.schema)


def scan_headerless(s: Standins):
    return delimited.read_headerless(s.spark, landed(s, s.crosswalk, "dump", header=False), s.crosswalk.schema)


def scan_inferred(s: Standins):
    """An exported report, types found by reading it."""
    found = delimited.read_inferred(s.spark, landed(s, bucket_report(s), "export", one_file=True))
    return found.select(
        F.col("Year"),
        F.col(BUCKET),
        F.col("`Total Claims`").cast("bigint").alias("Total Claims"),
        *[F.round(F.col(c).cast("decimal(38,13)"), 4).alias(c) for c in (AVG_BUCKET, SUM_BUCKET)],
    )


def scan_records(s: Standins):
    """Whole texts, whose cells hold quotes and line ends, in records that are cut in parallel."""
    docs = s.base("documents").select("doc_id", "lang", "text", "n_chars")
    return delimited.read_typed(s.spark, landed(s, docs, "records"), docs.schema, multi_line=True)


def reject_rows(s: Standins):
    """Claims landed with a cell missing or in excess, each for other causes of damage."""
    cause = F.col("causeOfDamage")
    shown = s.claims.select(cause, F.concat_ws(",", F.col("id"), F.col("yearOfLoss").cast("string")).alias("head"))
    line = F.when(cause == "1", F.col("head")).when(cause == "2", F.concat("head", F.lit(',"a, b",x'))).otherwise(F.concat("head", F.lit(",c")))
    path = scratch_path(s.spark, "odd-rows")
    shown.select(line.alias("value")).write.text(path)
    rows = delimited.read_text_columns(s.spark, path, ["id", "year", "cell"], header=False, malformed=True, landed=True)
    return delimited.rejected(rows, 3).select("text", "reason")


def reordered(s: Standins):
    """File order differs from table order; names bind them."""
    in_file = CELLS[::-1]
    raw = delimited.read_text_columns(s.spark, landed(s, s.claims.select(*in_file), "reordered"), in_file)
    return clean.conform(raw, cells(s).schema)


def zero_dates(s: Standins):
    """Four text date columns, each impossible for other claims."""
    text = F.col("dateOfLoss").cast("string")
    spoiled = {
        name: F.when(F.col("causeOfDamage") == code, IMPOSSIBLE).otherwise(text)
        for code, name in zip("1234", ("originalConstructionDate", "originalNBDate", "dateOfLoss", "asOfDate"))
    }
    raw = s.claims.select("id", *[c.alias(n) for n, c in spoiled.items()])
    return clean.dates_or_null(raw, list(spoiled), T.DateType())


def spoiled_depth():
    """Depths as a careless clerk writes them, in another way for each cause."""
    depth, cause = F.col("waterDepth").cast("string"), F.col("causeOfDamage")
    return (
        F.when(cause == "1", F.concat(depth, F.lit(".5")))
        .when(cause == "2", F.concat(depth, F.lit("abc")))
        .when(cause == "3", F.lit("40000000000"))
        .when(cause == "4", F.lit(""))
        .otherwise(F.concat(F.lit(" "), depth, F.lit(".0 ")))
    )


def blanks_as_zero(s: Standins):
    schema = columns(
        "id string, amountPaidOnContentsClaim decimal(12,2), amountPaidOnBuildingClaim decimal(12,2), waterDepth int"
    )
    raw = s.claims.select(
        "id",
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in schema.names[1:3]],
        spoiled_depth().alias("waterDepth"),
    )
    return clean.conform(raw, schema, blank_numeric="zero")


def sorted_final(s: Standins):
    return tables.read_table(s.spark, tables.write_sorted(cells(s), scratch_path(s.spark, "sorted"), "id"))


def one_year_of_layout(s: Standins):
    path = tables.write_by_year(s.claims, scratch_path(s.spark, "by-year"))
    return (
        tables.read_table(s.spark, path)
        .filter(F.col("yearOfLoss") == BASE)
        .groupBy("clean_zip")
        .agg(F.count("id").alias("claims"), F.sum("amountPaidOnBuildingClaim").alias("paid"))
    )


def exported(s: Standins):
    report = trend(s)
    return delimited.read_typed(s.spark, landed(s, report, "report", one_file=True), report.schema)


CATALOGUE_TYPES = {
    "string": "text",
    "int": "integer",
    "date": "date",
    "boolean": "boolean",
}


def by_catalogue(s: Standins):
    """Claims landed as text, typed by a catalogue that describes them."""
    df = cells(s)
    fields = [(n, CATALOGUE_TYPES.get(t, t), n == "id") for n, t in df.dtypes]
    path = scratch_path(s.spark, "catalogue")
    s.spark.createDataFrame([(fields,)], catalogue.CATALOGUE_SCHEMA).coalesce(1).write.json(path)
    spoiled = s.claims.withColumn("waterDepth", spoiled_depth()).select(*CELLS)
    raw = delimited.read_text_columns(s.spark, landed(s, spoiled, "untyped"), df.columns)
    return catalogue.cast_by_catalogue(raw, catalogue.read_catalogue(s.spark, path))


def _orders_catalogue(s: Standins):
    """Orders landed as text under a key that repeats: customer and status."""
    fields = [("o_custkey", "bigint", True), ("o_orderstatus", "text", True), ("o_orderkey", "bigint", False), ("o_orderdate", "date", False)]
    path = scratch_path(s.spark, "keyed-catalogue")
    s.spark.createDataFrame([(fields,)], catalogue.CATALOGUE_SCHEMA).coalesce(1).write.json(path)
    names = [f[0] for f in fields]
    # In some rows a part of the key is not what it should be.
    custkey = F.when(F.col("o_orderkey") % 97 == 0, F.lit("none")).otherwise(F.col("o_custkey").cast("string"))
    orders = s.base("orders").withColumn("o_orderdate", F.to_date("o_orderdate")).withColumn("o_custkey", custkey)
    raw = delimited.read_text_columns(s.spark, landed(s, orders.select(*names), "keyed"), names)
    return catalogue.keyed_by_catalogue(raw, catalogue.read_catalogue(s.spark, path))


def repeated_keys(s: Standins):
    return _orders_catalogue(s).repeated


def first_of_keys(s: Standins):
    """One row per key, by the other columns as the landing order is not kept here."""
    return _orders_catalogue(s).first()


def bucketed(s: Standins):
    """Claims per area, from tables bucketed by postal code on both sides."""
    paths = scratch_path(s.spark, "claims-bucketed"), scratch_path(s.spark, "crosswalk-bucketed")
    claims = s.claims.select("id", "clean_zip", "yearOfLoss", "amountPaidOnBuildingClaim")
    buckets.write_bucketed(claims, paths[0], "clean_zip", 8, ["yearOfLoss"])
    buckets.write_bucketed(s.crosswalk, paths[1], "zip_code", 8)
    sums = buckets.read_bucketed(s.spark, paths[0]).groupBy("clean_zip", "yearOfLoss").agg(
        F.count("id").alias("claims"), F.sum("amountPaidOnBuildingClaim").alias("paid")
    )
    codes = buckets.read_bucketed(s.spark, paths[1]).select("zip_code", "zcta")
    return sums.join(codes, F.col("clean_zip") == F.col("zip_code")).drop("zip_code")


def counts(s: Standins):
    return quality.row_counts(
        {"claims": s.claims, "crosswalk": s.crosswalk, "land": s.land, "price_index": s.index}
    )


def reconciled(s: Standins):
    path = landed(s, cells(s), "landing")
    landing = delimited.read_text_columns(s.spark, path, CELLS)
    final = tables.stored(clean.conform(landing, cells(s).schema), "final")
    return quality.reconcile(landing, final)


PROFILE_TYPES = {
    "id": "string",
    "yearOfLoss": "int",
    "dateOfLoss": "date",
    "amountPaidOnBuildingClaim": "decimal(12,2)",
    "amountPaidOnContentsClaim": "decimal(12,2)",
    "waterDepth": "int",
    "primaryResidenceIndicator": "boolean",
    "eventDesignationNumber": "string",
    "reportedZipCode": "string",
}
PROFILE_SQL = " union all ".join(
    f"select cast({i} as int) as position, '{c}' as column_name, '{t}' as data_type, count({c}) as non_null, "
    f"count(*) - count({c}) as nulls from claims"
    for i, (c, t) in enumerate(PROFILE_TYPES.items())
)
ZERO_DATE = "case when causeOfDamage = '{}' then null else dateOfLoss end as {}"


def checks():
    yield "scan_csv_typed", scan_csv, with_views(f"select {CELLS_SQL} from claims")
    yield "scan_tsv_positional", scan_tsv, with_views(f"select {LAND_SQL} from land")
    yield "scan_csv_headerless", scan_headerless, with_views("select zip_code, zcta, zip_join_type from crosswalk")
    yield "scan_csv_inferred", scan_inferred, with_views(
        f"""select y as "Year", bucket as "{BUCKET}", n as "Total Claims",
          {quo("real", "n * 1000000000")} as "{AVG_BUCKET}", {scaled("real", 9)} as "{SUM_BUCKET}" from buckets""",
        {"buckets": BUCKETS},
    )
    yield "scan_csv_records", scan_records, "select doc_id, lang, text, n_chars from documents"
    yield "load_reject_rows", reject_rows, with_views(
        """select concat_ws(',', id, yearOfLoss) || case when causeOfDamage = '2' then ',"a, b",x' else '' end as text,
          case when causeOfDamage = '1' then 'too short: 2 of 3 cells' else 'too long: 4 of 3 cells' end as reason
        from claims where causeOfDamage in ('1', '2')"""
    )
    yield (
        "scan_full_table",
        lambda s: tables.read_table(s.spark, f"{s.sf_dir}/lineitem.parquet").withColumn(
            "l_shipdate", F.to_date("l_shipdate")
        ),
        "select * replace (cast(l_shipdate as date) as l_shipdate) from lineitem",
    )
    yield "project_reorder", reordered, with_views(f"select {CELLS_SQL} from claims")
    yield (
        "blank_to_null_text",
        lambda s: s.claims.select(
            "id", "floodEvent", clean.blank_to_null(F.col("eventDesignationNumber")).alias("event_number")
        ),
        with_views("select id, floodEvent, nullif(trim(eventDesignationNumber), '') as event_number from claims"),
    )
    yield "zero_date_to_null", zero_dates, with_views(
        "select id, "
        + ", ".join(
            ZERO_DATE.format(code, name)
            for code, name in zip("1234", ("originalConstructionDate", "originalNBDate", "dateOfLoss", "asOfDate"))
        )
        + " from claims"
    )
    yield "blank_numeric_to_zero", blanks_as_zero, with_views(
        f"""select id, {dbl("coalesce(amountPaidOnContentsClaim, 0)")} as amountPaidOnContentsClaim,
          {dbl("coalesce(amountPaidOnBuildingClaim, 0)")} as amountPaidOnBuildingClaim,
          cast(case causeOfDamage when '1' then {HALF_AWAY} when '2' then waterDepth when '3' then 2147483647
            when '4' then 0 else waterDepth end as int) as waterDepth from claims"""
    )
    yield "load_sorted_final", sorted_final, with_views(f"select {CELLS_SQL} from claims order by id")
    yield (
        "derive_clean_zip",
        lambda s: clean.with_clean_zip(s.claims.select("id", "reportedZipCode")),
        with_views("select id, reportedZipCode, left(trim(reportedZipCode), 5) as clean_zip from claims"),
    )
    yield (
        "derive_cpi_year",
        lambda s: clean.with_index_year(
            s.base("orders").select("o_orderkey", F.to_date("o_orderdate").alias("observation_date"))
        ),
        "select o_orderkey, cast(o_orderdate as date) as observation_date, "
        "cast(year(o_orderdate) as int) as cpi_year from orders",
    )
    yield (
        "dedup_keep_one",
        lambda s: clean.keep_one(s.base("lineitem").withColumn("l_shipdate", F.to_date("l_shipdate")), LINE_KEY),
        """select * exclude (place) from (
          select * replace (cast(l_shipdate as date) as l_shipdate), row_number() over (
            partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_quantity, l_extendedprice,
              l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) as place
          from lineitem) where place = 1""",
    )
    yield (
        "duplicate_key_audit",
        lambda s: clean.duplicate_keys(s.claims, ["id"]),
        with_views("select id, count(*) as rows from claims group by id having count(*) > 1"),
    )
    yield "layout_by_year", one_year_of_layout, with_views(
        f"""select clean_zip, count(*) as claims, {dbl("sum(amountPaidOnBuildingClaim)")} as paid from claims
        where yearOfLoss = {BASE} group by clean_zip"""
    )
    yield "layout_bucketed", bucketed, with_views(
        f"""select clean_zip, yearOfLoss, zcta, count(*) as claims, {dbl("sum(amountPaidOnBuildingClaim)")} as paid
        from claims join crosswalk on clean_zip = zip_code group by all"""
    )
    drawn = ", ".join(f"coalesce(cast({c} as varchar), '~')" for c in CELLS)
    yield "sample_random_n", lambda s: quality.random_sample(cells(s), 1000), with_views(
        f"""select {CELLS_SQL} from (select *, concat_ws('|', {drawn}) as cells from claims)
        order by cast(('0x' || substr(md5('1|' || cells), 1, 13)) as bigint), cells limit 1000"""
    )
    yield "export_result_csv", exported, with_views(
        f"""select yearOfLoss, n as total_claims, {scaled(real9("cents"), 9)} as real_total_paid_out_{BASE},
          {quo("severe", "n")} as pct_severe_above_ground_floods, {quo("basement", "n")} as pct_basement_floods,
          {quo("prim", "n")} as pct_primary_residence
        from trend join ratios on yearOfLoss = cpi_year""",
        {"trend": TREND},
    )
    yield "cast_by_catalogue", by_catalogue, with_views(
        f"""select {CELLS_SQL.replace("waterDepth", DEPTH_OR_NULL)} from claims"""
    )
    yield (
        "catalogue_key_repeats",
        repeated_keys,
        """select o_custkey, o_orderstatus, count(*) as rows from orders where o_orderkey % 97 <> 0
        group by all having count(*) > 1""",
    )
    yield (
        "catalogue_key_first",
        first_of_keys,
        """select o_custkey, o_orderstatus, o_orderkey, cast(o_orderdate as date) as o_orderdate from orders
        where o_orderkey % 97 <> 0
        qualify row_number() over (partition by o_custkey, o_orderstatus order by o_orderkey, o_orderdate) = 1""",
    )
    yield "row_count_by_table", counts, with_views(
        " union all ".join(
            f"select '{t}' as table_name, count(*) as row_count from {t}"
            for t in ("claims", "crosswalk", "land", "price_index")
        )
    )
    yield "load_reconcile", reconciled, with_views(
        "select count(*) as landing_rows, count(*) as final_rows, cast(0 as bigint) as diff from claims"
    )
    yield "profile_columns", lambda s: quality.profile(cells(s)), with_views(PROFILE_SQL)
    yield (
        "view_real_dollar_claims",
        lambda s: joins.real_dollar_claims(s.claims, s.index, BASE),
        with_views(
            f"""select id, policyCount, {scaled(real9("both_cents"), 9)} as real_total_paid_{BASE}, clean_zip, yearOfLoss
            from paid join ratios on yearOfLoss = cpi_year"""
        ),
    )

"""Quoted text files.

A quote inside a quoted cell is written twice, on both sides. Rows seldom span lines in
these feeds, so ``multi_line`` is off unless asked for; with it, records are cut in parallel
too (:mod:`claimscope.sources.records`). A declared schema keeps Spark from reading the file
twice.

A row with too few cells is filled up with NULL and one with too many is cut. Every reader
can keep the text of such rows, and of those whose cells do not fit the declared types, in
the column ``_malformed``; :func:`rejected` turns them into rows of file, text and reason. A
cell of the wrong type shows only where a query asks for its column, as others are not cast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimscope import schemas
from claimscope.sources.records import read_records

LANDED = "_landed"
MALFORMED = "_malformed"


# A date in the feeds: fixed.
DATE_FORMAT = "yyyy-MM-dd"


def _read(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    sep: str,
    header: bool,
    multi_line: bool,
    malformed: bool,
    landed: bool = False,
    **options: str,
) -> DataFrame:
    """Rows of a schema; with ``malformed`` and ``landed`` the columns of that name beside them."""
    options |= {"sep": sep, "quote": '"', "escape": '"', "dateFormat": DATE_FORMAT}
    fields = list(schema)
    if malformed:
        fields.append(T.StructField(MALFORMED, T.StringType()))
        # Cells that are not asked for are not counted either, unless all are parsed.
        options |= {"columnNameOfCorruptRecord": MALFORMED, "columnPruning": "false"}
    if not multi_line:
        rows = spark.read.options(header=header, enforceSchema=True, **options).schema(T.StructType(fields)).csv(path)
        if malformed:
            # Spark refuses to read this column alone; no character of another one goes with it.
            nothing = F.left(F.coalesce(F.col(f"`{fields[0].name}`").cast("string"), F.lit("")), F.lit(0))
            rows = rows.withColumn(MALFORMED, F.concat(MALFORMED, nothing))
        return with_landing_order(rows) if landed else rows
    records = read_records(spark, path).where(F.trim("text") != "")
    if header:
        records = records.where("split > 0 or row > 0")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    cells = F.from_csv("text", ddl, options | {"multiLine": "true", "mode": "PERMISSIVE"})
    place = F.struct("file", "split", "row").alias(LANDED)
    out = records.select(cells.alias("_cells"), place)
    return out.select("_cells.*", *([LANDED] if landed else []))


def read_typed(
    spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = False, malformed: bool = False
) -> DataFrame:
    """Comma-separated file with a header line; columns bind by position."""
    return _read(spark, path, schema, ",", True, multi_line, malformed)


def read_tab_separated(
    spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = False, malformed: bool = False
) -> DataFrame:
    """Tab-separated file with a header line; columns bind by position."""
    return _read(spark, path, schema, "\t", True, multi_line, malformed)


def read_headerless(
    spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = False, malformed: bool = False
) -> DataFrame:
    """Comma-separated dump without a header line."""
    return _read(spark, path, schema, ",", False, multi_line, malformed)


def read_inferred(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """An exported result. Inference reads the file twice, and line ends in cells keep a file
    in one task: for small files only."""
    options = {"sep": ",", "quote": '"', "escape": '"', "dateFormat": DATE_FORMAT}
    return spark.read.options(header=True, inferSchema=True, multiLine=multi_line, **options).csv(path)


def read_text_columns(
    spark: SparkSession,
    path: str,
    names: list[str],
    sep: str = ",",
    header: bool = True,
    multi_line: bool = False,
    malformed: bool = False,
    landed: bool = False,
) -> DataFrame:
    """Every cell as raw text. Empty cells and ``\\N`` are NULL; a quoted empty cell stays ``''``.

    With ``malformed`` the column of that name holds the text of rows with too few or too many
    cells, and NULL for others; ``landed`` adds each row's place in the files.
    """
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return _read(spark, path, schema, sep, header, multi_line, malformed, landed, nullValue=r"\N")


def rejected(rows: DataFrame, cells: int, sep: str = ",") -> DataFrame:
    """file, split, row, text and reason of the malformed rows of a reader's result.

    ``rows`` has ``_malformed`` and the landing order; ``cells`` is how many a row should have.
    """
    text = F.col(MALFORMED)
    # Quoted parts without their content hold no separator that counts.
    bare = F.regexp_replace(text, '"([^"]|"")*"', "")
    found = F.length(bare) - F.length(F.replace(bare, F.lit(sep), F.lit(""))) + 1
    counted = F.concat(found.cast("string"), F.lit(f" of {cells} cells"))
    reason = F.when(found < cells, F.concat(F.lit("too short: "), counted)).when(
        found > cells, F.concat(F.lit("too long: "), counted)
    )
    return rows.where(text.isNotNull()).select(
        f"{LANDED}.*", text.alias("text"), F.coalesce(reason, F.lit("a cell does not fit its type")).alias("reason")
    )


def with_landing_order(raw: DataFrame) -> DataFrame:
    """Add each row's place in its files, for choosing the first of several equal keys.

    File and split offset order the splits; the running id orders rows within a split.
    """
    place = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("row"),
    )
    return raw.select("*", place.alias(LANDED))


def read_raw_claims(
    spark: SparkSession, path: str, multi_line: bool = False, malformed: bool = False, landed: bool = False
) -> DataFrame:
    """The claims feed as text, in file order."""
    names = schemas.CLAIMS_FILE_ORDER
    return read_text_columns(spark, path, names, multi_line=multi_line, malformed=malformed, landed=landed)


def write_csv(df: DataFrame, path: str, one_file: bool = False, sep: str = ",", header: bool = True) -> str:
    """Write text as it is: padding kept, NULL as an empty cell, empty text as ``""``.

    ``one_file`` is for report-sized results only: it runs the last stage as one task.
    """
    out = df.coalesce(1) if one_file else df
    (
        out.write.option("header", header)
        .option("sep", sep)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
    return path

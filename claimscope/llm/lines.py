"""Line deduplication by overlapping windows of three lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimscope.llm.common import ROW, WORDS, let, upto, with_row

WINDOW = 3


def _windows(lines: Column, width: int) -> Column:
    """(position, hash) of each run of ``width`` lines of which at least one has a word."""
    def one(i: Column) -> Column:
        run = F.slice(lines, i + 1, F.lit(width))
        # Two hashes of 64 bits: the corpus has far too many windows for one.
        key = F.struct(F.xxhash64(run).alias("a"), F.xxhash64(F.lit(width), F.reverse(run)).alias("b"))
        return F.struct(i.alias("at"), key.alias("key"), F.exists(run, lambda x: x.rlike(WORDS)).alias("worded"))

    return F.filter(F.transform(upto(F.size(lines) - width + 1), one), lambda w: w["worded"])


def repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WINDOW) -> DataFrame:
    """id, print and spots: the line positions (from 0) to remove, of texts that have any.

    ``print`` is a hash of the text, which tells rows apart that share an id. All windows of
    the corpus take part; the first occurrence of a window, by id (NULL first), print and
    position, stays, and every later one marks its lines.
    """
    found = let(F.split(F.col(f"`{text}`"), "\n"), lambda lines: _windows(lines, width))
    places = docs.where(F.col(f"`{text}`").isNotNull()).select(
        F.col(f"`{doc_id}`").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("print"), F.explode(found).alias("w")
    ).select("id", "print", "w.at", "w.key.a", "w.key.b")
    # Combined in each task before the shuffle, so a window with very many copies is one row per task.
    seen = places.groupBy("a", "b").agg(F.min(F.struct("id", "print", "at")).alias("first"), F.max(F.struct("id", "print", "at")).alias("last"))
    repeated = seen.where("not (first <=> last)").select(F.col("a").alias("ra"), F.col("b").alias("rb"), "first")
    # One more key than the aggregation has, so that adaptive execution may split a hot window.
    same = (F.col("a") == F.col("ra")) & (F.col("b") == F.col("rb")) & (F.hash("a", "b") == F.hash("ra", "rb"))
    later = places.join(repeated, same).where(~F.struct("id", "print", "at").eqNullSafe(F.col("first")))
    lines_hit = later.select("id", "print", F.explode(F.sequence(F.col("at"), F.col("at") + width - 1)).alias("line"))
    # A text's own lines: as many as the text has, whatever its copies.
    return lines_hit.groupBy("id", "print").agg(F.sort_array(F.collect_set("line")).alias("spots"))


def _joined(docs: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    spots = repeated_lines(docs, doc_id, text, width)
    body = F.col(f"`{text}`")
    packed = with_row(docs, id=F.col(f"`{doc_id}`"), print=F.xxhash64(body))
    hits = spots.select(F.col("id").alias("hit_id"), F.col("print").alias("hit_print"), "spots")
    return packed.join(hits, (F.col("print") == F.col("hit_print")) & F.col("id").eqNullSafe(F.col("hit_id")), "left")


def _without(text: Column, spots: Column) -> Column:
    """The text without the lines at ``spots``."""

    def rest_of(lines: Column) -> Column:
        keep = F.array_except(upto(F.size(lines)), spots)
        return F.array_join(F.transform(keep, lambda i: lines[i]), "\n")

    rest = let(F.split(text, "\n"), rest_of)
    return F.when(spots.isNull() | text.isNull(), text).otherwise(rest)


def line_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WINDOW) -> DataFrame:
    """doc_id, text without its repeated lines, n_lines before and n_removed, one row per row.

    Lines end at ``\\n`` and compare exactly. Runs without a word never repeat. Texts of
    fewer lines than a window stay as they are; NULL stays NULL with no lines, and a text all
    of whose lines go becomes empty. Repeated rows (equal id and text) are one document and
    get the same text. An empty table gives an empty result.
    """
    joined = _joined(docs, doc_id, text, width)
    body = F.col(ROW)[text]
    count = F.when(body.isNull(), F.lit(0)).otherwise(F.size(F.split(body, "\n"))).cast("long")
    return joined.select(
        F.col("id").alias("doc_id"),
        _without(body, F.col("spots")).alias("text"),
        count.alias("n_lines"),
        F.when(F.col("spots").isNull(), F.lit(0)).otherwise(F.size("spots")).cast("long").alias("n_removed"),
    )


def drop_repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WINDOW) -> DataFrame:
    """All rows and columns of ``docs`` with repeated lines taken out of ``text``."""
    joined = _joined(docs, doc_id, text, width)
    fresh = _without(F.col(ROW)[text], F.col("spots"))
    return joined.select(*((fresh if c == text else F.col(ROW)[c]).alias(c) for c in docs.columns))

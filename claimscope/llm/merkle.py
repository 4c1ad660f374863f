"""Document fingerprints: Merkle trees over sections, paragraphs and their pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimscope.llm.common import let, upto

PIECE = 32  # code points of a leaf at most
TAG = 8  # hex digits by which the fingerprint names a leaf
SECTION_PARAGRAPHS = 16
BUCKET_ROWS = 500  # documents of a range, where ids are given out in order
MOST_RANGES = 50_000


def _pieces(text: Column) -> Column:
    """Leaves in order: each line (paragraph) in pieces of ``PIECE`` code points, with its line end.

    Joined together they are the text again. The empty text has no leaf.
    """
    return F.regexp_extract_all(text, F.lit(rf"[^\n]{{1,{PIECE}}}\n?|\n"), F.lit(0))


def _paragraphs(text: Column) -> Column:
    """Every line with its line end."""
    return F.regexp_extract_all(text, F.lit(r"[^\n]+\n?|\n"), F.lit(0))


def _sections(paragraphs: Column) -> Column:
    """Runs of ``SECTION_PARAGRAPHS`` paragraphs."""
    count = F.ceil(F.size(paragraphs) / SECTION_PARAGRAPHS).cast("int")
    return F.transform(upto(count), lambda k: F.slice(paragraphs, k * SECTION_PARAGRAPHS + 1, F.lit(SECTION_PARAGRAPHS)))


def fingerprint(text: Column) -> Column:
    """The tree as text: ``root:section:section...``; NULL counts as the empty text.

    A leaf's hash is the MD5 of a piece; a paragraph hashes its leaves, a section its
    paragraphs, the root its sections, all by SHA-256 over their hashes in order. The root
    comes with all its digits. A section is ``hash/paragraph/paragraph...`` and a paragraph
    the first digits of each of its leaves, so trees can be compared branch by branch.
    Equal texts have equal fingerprints, and equal roots mean equal texts.
    """

    def paragraph(line: Column) -> Column:
        leaves = F.transform(_pieces(line), lambda piece: F.md5(piece))
        return let(
            leaves,
            lambda x: F.struct(
                F.sha2(F.array_join(x, ""), 256).alias("hash"),
                F.array_join(F.transform(x, lambda h: F.substring(h, 1, TAG)), "").alias("tags"),
            ),
        )

    def section(lines: Column) -> Column:
        return let(
            F.transform(lines, paragraph),
            lambda x: F.struct(
                F.sha2(F.array_join(F.transform(x, lambda p: p["hash"]), ""), 256).alias("hash"),
                F.array_join(F.transform(x, lambda p: p["tags"]), "/").alias("tags"),
            ),
        )

    def root(sections: Column) -> Column:
        top = F.sha2(F.array_join(F.transform(sections, lambda s: s["hash"]), ""), 256)
        branches = F.transform(sections, lambda s: F.concat(F.substring(s["hash"], 1, 16), F.lit("/"), s["tags"]))
        return F.array_join(F.concat(F.array(top), branches), ":")

    whole = let(_paragraphs(F.coalesce(text, F.lit(""))), _sections)
    return let(F.transform(whole, section), root)


def root_of(print_: Column) -> Column:
    return F.substring_index(print_, ":", 1)


def _leaves(print_: Column) -> Column:
    """Leaf tags of a fingerprint: what follows each section's hash, cut into tags."""
    tags = F.regexp_replace(F.regexp_replace(print_, "^[^:]*", ""), ":[0-9a-f]+/|/", "")
    return F.regexp_extract_all(tags, F.lit(f"[0-9a-f]{{{TAG}}}"), F.lit(0))


def likeness(a: Column, b: Column) -> Column:
    """1 for equal roots, else twice the different leaves in common over those of each, 0 to 1.

    NULL where either fingerprint is NULL.
    """

    def dice(x: Column, y: Column) -> Column:
        both = F.size(x) + F.size(y)
        return F.when(both > 0, 2.0 * F.size(F.array_intersect(x, y)) / both).otherwise(F.lit(0.0))

    shared = let(F.array_distinct(_leaves(a)), lambda x: let(F.array_distinct(_leaves(b)), lambda y: dice(x, y)))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(root_of(a) == root_of(b), F.lit(1.0)).otherwise(shared)


def edits(a: Column, b: Column) -> Column:
    """Where two fingerprints differ: an array of (section, paragraph), both from 0.

    Sections with equal hashes are passed over as wholes; of the others each paragraph whose
    leaves differ or that only one tree has is named.
    """

    def parts(print_: Column) -> Column:
        return let(F.split(print_, ":"), lambda x: F.transform(F.slice(x, F.lit(2), F.size(x)), lambda s: F.split(s, "/")))

    def differing(x: Column, y: Column) -> Column:
        def within(k: Column) -> Column:
            p, q = F.coalesce(F.get(x, k), F.array()), F.coalesce(F.get(y, k), F.array())
            most = F.greatest(F.size(p), F.size(q))
            changed = F.filter(upto(most - 1), lambda i: ~F.get(p, i + 1).eqNullSafe(F.get(q, i + 1)))
            named = F.transform(changed, lambda i: F.struct(k.alias("section"), i.alias("paragraph")))
            return F.when(F.get(p, F.lit(0)).eqNullSafe(F.get(q, F.lit(0))), F.slice(named, 1, 0)).otherwise(named)

        return F.flatten(F.transform(upto(F.greatest(F.size(x), F.size(y))), within))

    found = let(parts(a), lambda x: let(parts(b), lambda y: differing(x, y)))
    return F.coalesce(found, F.array().cast("array<struct<section:int,paragraph:int>>"))


def with_next(docs: DataFrame, order: str, *names: str, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Each row with ``next_<name>``: that column of the following row in ascending ``order``.

    NULL order comes first, and ties are in the order of the columns ``names``; after the last
    row follows the first. Rows are put into ranges of about ``bucket_rows`` by approximate
    quantiles, found from the order column alone. The first row of each range is also sent
    to the range before, so one shuffle by range is enough and no task sees more than a
    range. Rows that share one value of ``order`` lie in one range: it should be an id.
    """
    key = F.col(order).cast("double")
    known = docs.agg(F.count("*").alias("n")).first()["n"]
    ranges = max(1, min(known // bucket_rows, MOST_RANGES))
    if ranges > 1:
        at = [k / ranges for k in range(1, ranges)]
        cuts = docs.agg(F.percentile_approx(key, at, 10 * ranges).alias("c")).first()["c"] or []
        cuts = sorted(set(cuts))
    else:
        cuts = []
    # The range of a row: how many cuts lie at or below it, by the place in a sorted array.
    if cuts:
        bounds = F.lit(cuts)
        place = let(bounds, lambda c: F.size(F.filter(c, lambda x: x <= key))) if len(cuts) <= 64 else _place(key, cuts)
        bucket = F.when(key.isNull(), F.lit(0)).otherwise(place).cast("int")
    else:
        bucket = F.lit(0)
    rows = docs.withColumn("_bucket", bucket)
    ranked = F.struct(F.col(order).isNotNull().alias("known"), F.col(order).alias("key"))
    firsts = rows.groupBy("_bucket").agg(F.min(ranked).alias("_first"))
    line = Window.orderBy("_bucket")
    before = firsts.select(
        F.col("_bucket").alias("_b"),
        "_first",
        F.coalesce(F.lag("_bucket").over(line), F.max("_bucket").over(Window.partitionBy())).alias("_before"),
    )
    # One row per range: at most MOST_RANGES rows of two numbers.
    joined = rows.join(F.broadcast(before), rows["_bucket"] == before["_b"])
    opens = ranked == F.col("_first")
    copies = F.when(opens, F.array(F.struct(F.lit(False).alias("copy"), F.col("_bucket").alias("b")), F.struct(F.lit(True).alias("copy"), F.col("_before").alias("b"))))
    copies = copies.otherwise(F.array(F.struct(F.lit(False).alias("copy"), F.col("_bucket").alias("b"))))
    dealt = joined.select(*docs.columns, F.explode(copies).alias("_x"))
    window = Window.partitionBy("_x.b").orderBy(F.col("_x.copy"), F.col(order).asc_nulls_first(), *names)
    out = dealt.select("*", *(F.lead(n).over(window).alias(f"next_{n}") for n in names))
    return out.where("not _x.copy").drop("_x")


def _place(key: Column, cuts: list[float]) -> Column:
    """How many of many sorted cuts lie at or below ``key``: a search over two levels."""
    step = max(2, int(len(cuts) ** 0.5))
    blocks = [cuts[k : k + step] for k in range(0, len(cuts), step)]
    heads = F.lit([b[0] for b in blocks])
    block = F.size(F.filter(heads, lambda x: x <= key))
    padded = F.array(*(F.lit(b) for b in blocks))
    inner = F.size(F.filter(F.get(padded, F.greatest(block - 1, F.lit(0))), lambda x: x <= key))
    return F.when(block == 0, F.lit(0)).otherwise((block - 1) * step + inner)


def edited(text: Column, following: Column) -> Column:
    """The last quarter of ``text`` (rounded down) replaced by the first code points of ``following``."""
    cut = F.floor(F.length(text) / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - cut), F.substring(following, F.lit(1), cut))


def edit_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, edits.

    Of each document against its text edited with the start of the next document by id, and
    against that document. ``edits`` are the paragraphs in which the two fingerprints differ. NULL texts count as empty; an empty text's tree has no leaf. With
    one document it follows itself. Rows with one id follow each other, by text.
    """
    base = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    base = with_next(base, "doc_id", "text").withColumn("edited", edited(F.col("text"), F.col("next_text")))
    prints = base.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        fingerprint(F.col("text")).alias("fingerprint"),
        fingerprint(F.col("edited")).alias("edited_fingerprint"),
        fingerprint(F.col("next_text")).alias("next_fingerprint"),
    )
    return prints.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
        edits(F.col("fingerprint"), F.col("edited_fingerprint")).alias("edits"),
    )


def edit_places(places: Column) -> Column:
    """An array of (section, paragraph) as text: ``section.paragraph`` with commas between."""
    return F.array_join(F.transform(places, lambda p: F.concat_ws(".", p["section"].cast("string"), p["paragraph"].cast("string"))), ",")

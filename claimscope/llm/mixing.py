"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimscope.llm.common import shared_table, with_row, word_count

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
BINS = 4096
_UNIFORM_BITS = 52


def uniform(seed: str, *keys: Column) -> Column:
    """A number in (0, 1) that follows from the seed and the keys alone."""
    text = F.concat_ws("|", F.lit(seed), *(F.coalesce(k.cast("string"), F.lit("null")) for k in keys))
    head = F.conv(F.substring(F.md5(text), 1, _UNIFORM_BITS // 4), 16, 10).cast("long")
    return (head.cast("double") + 0.5) / F.lit(float(1 << _UNIFORM_BITS))


def _wide(name: str) -> Column:
    """A long as decimal, so that products of two do not overflow."""
    return F.col(name).cast("decimal(19,0)")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """source, source_size, target: all sizes shared out by weight, no target above ``most`` sizes.

    ``sizes`` has source and source_size, one row per source. Sources take the weights in
    turn, in code point order, NULL last. Sources are filled in the order of
    ``most * size / weight``: one whose limit lies below its share of what is left keeps the
    limit, and the rest is shared among those that remain, which is where resharing by
    weight in rounds ends. Two windows over one row per source, no documents.
    """
    named = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(named) - 1) % len(weights)
    weight = F.element_at(F.array(*(F.lit(w).cast("long") for w in weights)), turn + 1)
    base = sizes.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * most).alias("limit"))
    ratio = (F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    upto = Window.orderBy(*ratio).rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy(*ratio).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.orderBy(*ratio).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = base.select(
        "*",
        (F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(upto), F.lit(0))).alias("left"),
        F.sum("weight").over(onward).alias("weights_left"),
    ).withColumn("full", _wide("limit") * _wide("weights_left") <= _wide("weight") * _wide("left"))
    # The first source below its limit fixes what every later one shares by weight.
    share = filled.select(
        "*",
        F.min(F.when(~F.col("full"), F.struct(F.col("limit") / F.col("weight"), F.col("source").isNull(), "source", "left", "weights_left"))).over(whole).alias("level"),
    )
    shared = F.col("weight").cast("double") * F.col("level.left").cast("double") / F.col("level.weights_left").cast("double")
    return share.select("source", "source_size", F.when(F.col("full"), F.col("limit").cast("double")).otherwise(shared).alias("target"))


def _matched(sizes: Column, source: Column) -> Column:
    return sizes.eqNullSafe(source)


def copies(
    docs: DataFrame,
    seed: str = "mix-1",
    weights: Sequence[int] = WEIGHTS,
    most: int = MOST_COPIES,
    text: str = "text",
    source: str = "source",
    doc_id: str = "doc_id",
    importance: str | None = None,
) -> DataFrame:
    """Per document: _row (its columns), size, source_size, target and copies.

    A document of a source is expected target / source_size times, times its importance over
    the source's mean importance (all 1 unless a column is named), at most ``most`` times.
    The whole part are certain copies. The rest is an inclusion probability p, and documents
    are ranked by Pareto order: the odds of a uniform number over the odds of p. From the
    top of that order each source takes documents until its target is met as nearly as whole
    documents allow. The uniform number follows from seed and id, so reruns agree.

    No source is sorted in one task. Ranks are binned, sizes are summed per source and bin,
    and only the documents of the one bin, of ``BINS * BINS``, that holds the cut are ranked
    one by one. NULL texts and empty texts have size zero. A NULL source is a source. Rows
    with equal id and size tie; which of them is taken makes no difference to the result.
    Without documents the result is empty.
    """
    name = F.col(f"`{source}`").cast("string")
    trait = F.coalesce(F.col(f"`{importance}`").cast("double"), F.lit(0.0)) if importance else F.lit(1.0)
    packed = with_row(docs, source=name, size=word_count(F.col(f"`{text}`")), key=F.col(f"`{doc_id}`").cast("string"), trait=trait)
    rows = shared_table(packed, "mix")
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("trait")).alias("trait_size"))
    per = shared_table(per, "mix-sources")
    goal = targets(per.select("source", "source_size"), weights, most).join(
        per.select(F.col("source").alias("s"), "trait_size"), _matched(F.col("s"), F.col("source"))
    ).drop("s")
    goal = shared_table(goal, "mix-targets")

    ratio = F.col("target") / F.col("source_size")
    # Importance is relative: its mean over the source's words is one.
    relative = F.when(F.col("trait_size") > 0, F.col("trait") * F.col("source_size") / F.col("trait_size")).otherwise(F.lit(1.0))
    expected = F.least(F.lit(float(most)), F.coalesce(ratio * relative, F.lit(0.0)))
    joined = rows.join(goal.withColumnRenamed("source", "goal"), _matched(F.col("goal"), F.col("source"))).drop("goal")
    drawn = joined.withColumn("expected", expected).withColumn("certain", F.floor("expected").cast("long"))
    chance = F.col("expected") - F.col("certain")
    u = uniform(seed, F.col("key"))
    # Times the odds of a document of mean importance, one number per source: this keeps the order, and
    # where chances are equal the rank below is the uniform number itself, however near 0 or 1 they are.
    usual = F.least(F.lit(float(most)), F.coalesce(ratio, F.lit(0.0)))
    part = usual - F.floor(usual)
    odds = F.when(part > 0, part / (1 - part)).otherwise(F.lit(1.0)) * (u / (1 - u)) / (chance / (1 - chance))
    # odds / (1 + odds) keeps the order and lies between 0 and 1; without a chance it is 1, the last.
    rank = F.when(chance > 0, odds / (1 + odds)).otherwise(F.lit(1.0))
    may = (F.col("certain") < most) & (chance > 0) & (F.col("size") > 0)
    scaled = F.least(F.col("rank"), F.lit(1.0 - 2.0**-40)) * BINS
    ranked = (
        drawn.withColumn("rank", rank)
        .withColumn("bin", F.when(may, F.floor(scaled).cast("long")))
        .withColumn("fine", F.when(may, F.floor((scaled - F.floor(scaled)) * BINS).cast("long")))
        .drop("trait", "trait_size", "expected")
    )
    return _cut(ranked)


def _cut(ranked: DataFrame) -> DataFrame:
    """Adds ``copies``: the certain ones, and one more up to where the source's rest is met."""
    slim = ranked.select("source", "size", "target", "certain", "bin", "fine")
    certain = slim.groupBy("source").agg((F.first("target") - F.sum(F.col("certain") * F.col("size"))).alias("rest"))
    coarse = slim.where("bin is not null").groupBy("source", "bin").agg(F.sum("size").alias("n"))
    at = _crossing(coarse, certain, "bin")
    # The bin that holds the cut, split once more.
    inside = slim.where("bin is not null").join(at.select(F.col("source").alias("s"), F.col("bin").alias("b"), "left"), _matched(F.col("s"), F.col("source")) & (F.col("b") == F.col("bin")))
    fine = inside.groupBy("source", "fine").agg(F.sum("size").alias("n"))
    finer = _crossing(fine, at.select("source", F.col("left").alias("rest")), "fine").select(F.col("source").alias("s2"), F.col("fine").alias("cut_fine"), F.col("left").alias("cut_left"))
    cuts = at.select("source", F.col("bin").alias("cut_bin")).join(finer, _matched(F.col("s2"), F.col("source"))).drop("s2")
    cuts = shared_table(cuts.withColumnRenamed("source", "cut_source"), "mix-cuts")

    joined = ranked.join(cuts, _matched(F.col("cut_source"), F.col("source")), "left").drop("cut_source")
    place = F.struct("bin", "fine")
    cut = F.struct(F.col("cut_bin").alias("bin"), F.col("cut_fine").alias("fine"))
    # Without a cut the source's rest exceeds what all chances hold, or there is none to take.
    state = F.when(F.col("bin").isNull(), "none").when(F.col("cut_bin").isNull() | (place < cut), "take").when(place > cut, "none").otherwise("rank")
    marked = joined.withColumn("state", state)
    order = Window.partitionBy("source").orderBy("rank", "key", "size").rowsBetween(Window.unboundedPreceding, -1)
    near = marked.where("state = 'rank'").withColumn("before", F.coalesce(F.sum("size").over(order), F.lit(0)))
    near = near.withColumn("more", (F.col("before") + F.col("size") / 2 < F.col("cut_left")).cast("long")).drop("before")
    far = marked.where("state <> 'rank'").withColumn("more", (F.col("state") == "take").cast("long"))
    out = far.unionByName(near)
    return out.select("_row", "size", "source_size", "target", (F.col("certain") + F.col("more")).alias("copies"))


def _crossing(sums: DataFrame, rest: DataFrame, part: str) -> DataFrame:
    """source, the part in which its running sum passes ``rest``, and what is left for that part.

    A source whose sums stay below the rest has no row; windows run over parts, not documents.
    """
    run = Window.partitionBy("source").orderBy(part).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rests = rest.select(F.col("source").alias("rs"), "rest")
    running = sums.join(rests, _matched(F.col("rs"), F.col("source"))).withColumn("upto", F.sum("n").over(run))
    passed = running.where("upto >= rest and upto - n <= greatest(rest, 0)")
    first = passed.groupBy("source").agg(F.min(F.struct(part, (F.col("rest") - (F.col("upto") - F.col("n"))).alias("left"))).alias("x"))
    return first.select("source", f"x.{part}", "x.left")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: every document as often as it was taken, with the columns of ``docs``."""
    taken = copies(docs, **options).where("copies > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_row.*")

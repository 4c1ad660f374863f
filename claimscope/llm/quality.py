"""Quality rules: a ledger of failure bits, policies over it, and what each rule costs.

Every rule is evaluated once per document. The ledger keeps the measurements and one bit
per failed rule; policies are versioned masks over these bits, so changing a policy or
measuring the effect of a rule never reads a text again.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimscope.llm.common import WORDS, kept_columns, let, upto, with_row, word_list

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letters", "n_capitals", "n_exclaims")


@dataclass(frozen=True)
class Rule:
    """``fails`` is a condition over the measurements in whole numbers, as SQL text."""

    bit: int
    name: str
    fails: str


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    def mask(self, rules: Sequence[Rule]) -> int:
        bits = {r.name: r.bit for r in rules}
        return sum(1 << bits[name] for name in set(self.rules))


RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "short_words", "2 * word_chars < 5 * n_words"),
    Rule(3, "long_words", "word_chars > 10 * n_words"),
    Rule(4, "symbols", "10 * n_symbols > n_words"),
    Rule(5, "repeated_lines", "100 * n_dup_lines > 40 * n_lines"),
    Rule(6, "capitals", "100 * n_capitals > 40 * n_letters"),
    Rule(7, "exclaims", "2 * n_exclaims > n_words"),
    Rule(8, "few_letters", "100 * n_letters < 70 * word_chars"),
)
BASE = Policy("base", ("few_words", "repeated_words"))
STANDARD = Policy("standard-1", tuple(r.name for r in RULES))


def _only(text: Column, kept: str) -> Column:
    """Code points of ``text`` that lie in the character class body ``kept``."""
    return F.length(F.regexp_replace(text, f"[^{kept}]+", "")).cast("long")


def _windows(words: Column) -> Column:
    """Hash and position of each run of three words, in hash order."""
    hashed = F.transform(
        upto(F.size(words) - 2), lambda i: F.struct(F.xxhash64(words[i], words[i + 1], words[i + 2]).alias("h"), i.alias("i"))
    )
    return F.sort_array(hashed)


def _covered(windows: Column) -> Column:
    """Words inside windows whose hash occurs twice or more."""

    def repeated(window: Column, k: Column) -> Column:
        before, after = F.get(windows, k - 1)["h"], F.get(windows, k + 1)["h"]
        return F.coalesce(before == window["h"], F.lit(False)) | F.coalesce(after == window["h"], F.lit(False))

    starts = F.sort_array(F.transform(F.filter(windows, repeated), lambda w: w["i"]))
    # Windows start in order: each adds the words that the one before has not covered.
    total = F.aggregate(
        starts,
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"), i.alias("last")),
    )
    return total["n"].cast("long")


def measurements(text: Column) -> dict[str, Column]:
    """One column per measurement. NULL and empty texts measure zero throughout.

    Repeated windows are told apart by 64-bit hashes within one text.
    """
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORDS))
    words = word_list(text)
    in_words = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), let(_windows(w), _covered).alias("repeats")))
    in_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), F.size(F.array_distinct(x)).cast("long").alias("distinct")))
    return {
        "words": in_words,
        "lines": in_lines,
        "word_chars": F.length(text).cast("long") - _only(text, r"\x20\x09-\x0D"),
        "n_symbols": _only(text, r"#*$%&|<>"),
        "n_letters": _only(text, r"\p{L}"),
        "n_capitals": _only(text, r"\p{Lu}"),
        "n_exclaims": _only(text, "!"),
    }


def ledger(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, each measurement as long, and ``failed_bits`` as long.

    One row per row: repeated rows stay, an empty table gives an empty ledger. A kept column
    that bears the name of a measurement is called ``row_<name>`` in the ledger; by default
    the id alone is kept.
    """
    packed = with_row(docs, **measurements(F.col(f"`{text}`")))
    flat = packed.select(
        *kept_columns(keep, (*MEASURES, "failed_bits")),
        F.col("words.n").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.col("lines.n").alias("n_lines"),
        (F.col("lines.n") - F.col("lines.distinct")).alias("n_dup_lines"),
        F.col("words.repeats").alias("n_repeat_words"),
        "n_letters",
        "n_capitals",
        "n_exclaims",
    )
    bits = F.lit(0).cast("long")
    for rule in rules:
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("long"))
    return flat.withColumn("failed_bits", bits)


def apply_policy(entries: DataFrame, policy: Policy, rules: Sequence[Rule] = RULES, into: str = "kept") -> DataFrame:
    """The ledger with a boolean: no rule of the policy failed."""
    return entries.withColumn(into, F.col("failed_bits").bitwiseAND(F.lit(policy.mask(rules))) == 0)


def ablation(entries: DataFrame, policy: Policy, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Per rule of the policy: documents it fails, those only it fails, and what is left.

    First the documents per pattern of bits are counted, at most 2 ** rules rows; the rules
    are then read off those patterns. ``n_kept_without`` is what the policy keeps when the
    rule is dropped. Columns: version, rule, n_failed, n_failed_alone, n_kept_without.
    """
    mask = policy.mask(rules)
    patterns = entries.groupBy(F.col("failed_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    named = [r for r in rules if r.name in policy.rules]
    sums = [
        F.struct(
            F.lit(r.name).alias("rule"),
            F.coalesce(F.sum(F.when(F.col("bits").bitwiseAND(F.lit(1 << r.bit)) != 0, F.col("n"))), F.lit(0)).alias("n_failed"),
            F.coalesce(F.sum(F.when(F.col("bits") == (1 << r.bit), F.col("n"))), F.lit(0)).alias("n_failed_alone"),
            F.coalesce(F.sum(F.when(F.col("bits").bitwiseAND(F.lit(mask & ~(1 << r.bit))) == 0, F.col("n"))), F.lit(0)).alias("n_kept_without"),
        )
        for r in named
    ]
    rows = patterns.agg(F.array(*sums).alias("rows")).select(F.explode("rows").alias("r"))
    return rows.select(F.lit(policy.version).alias("version"), "r.*")

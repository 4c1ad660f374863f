"""The dataset manifest against trees built in memory."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from claimscope.llm import manifest, ranks

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, hash string, tree string, idx long, n long, path string, `_at` string"


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def part(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def grown(leaves, arity):
    levels = [leaves]
    while len(levels[-1]) > 1:
        x = levels[-1]
        levels.append([H("".join(x[i : i + arity])) for i in range(0, len(x), arity)])
    return levels


def siblings(levels, i, arity):
    out = []
    for x in levels[:-1]:
        first = i - i % arity
        out.append(("".join(x[first:i]), "".join(x[i + 1 : first + arity])))
        i //= arity
    return out


def expected(rows, arity=3):
    """Per row, in some order: what the report must say."""
    sources = {}
    leaf = {id(r): H("".join(map(part, r[:5]))) for r in rows}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, leaf[id(r)])):
        sources.setdefault(r[1], []).append(r)
    trees = {s: grown([leaf[id(r)] for r in some], arity) for s, some in sources.items()}
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    top = grown([trees[s][-1][0] for s in names], arity)
    out = []
    for s, some in sources.items():
        above = siblings(top, names.index(s), arity)
        for i, r in enumerate(some):
            path = siblings(trees[s], i, arity) + above
            text = r[4]
            if text is not None and zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 2 == 0:
                text = text.replace("\n", "")
            node = H("".join(map(part, (*r[:4], text))))
            for before, after in path:
                node = H(before + node + after)
            root = top[-1][0]
            out.append((r[0], leaf[id(r)], trees[s][-1][0], root, H("".join(a + b for a, b in path)), node, node == root))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "h", "t", 1, 2, "p", "a") for r in rows], SCHEMA)


AWKWARD = (
    [(i, "a", "en", i, f"line {i}\nend") for i in range(29)]
    + [(100 + i, "é", None, None, "x" * i) for i in range(4)]
    + [(200, None, "de", 0, ""), (201, None, None, None, None), (None, "a", "en", 1, "no id\n"), (None, "Z", None, 3, "\n\n\n")]
    + [(300, "", "en", 1, "an empty source"), (300, "", "en", 1, "an empty source"), (300, "", "en", 1, "its id again\n")]
    + [(400, "long", "en", 9, "long line\n" * 50_000)]
    + [(500, "same", "en", 1, "a row many times\n")] * 10
)


def test_report_equals_trees_in_memory(spark):
    got = [tuple(r) for r in manifest.manifest_report(frame(spark, AWKWARD).repartition(5)).collect()]
    assert sorted(got, key=str) == expected(AWKWARD)


@pytest.mark.parametrize("rows", [AWKWARD[:1], AWKWARD[:3], AWKWARD[28:31]])
def test_small_trees(spark, rows):
    assert sorted((tuple(r) for r in manifest.manifest_report(frame(spark, rows)).collect()), key=str) == expected(rows)


def test_empty_table(spark):
    out = manifest.manifest_report(frame(spark, []))
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert out.collect() == []


@pytest.mark.parametrize("arity", [2, 4])
def test_other_arities(spark, arity):
    leaves = frame(spark, AWKWARD).select("doc_id", "source", manifest.leaf_hash([F.col(c) for c in manifest.COLUMNS]).alias("hash"))
    made = manifest.build(leaves, "doc_id", arity)
    want = expected(AWKWARD, arity)
    assert made.root == want[0][3]
    got = made.proofs().select("hash", "subroot", manifest.proof_hash(F.col("path")).alias("p"), manifest.fold(F.col("hash"), F.col("path")).alias("r")).collect()
    assert sorted((r["hash"], r["subroot"], r["p"]) for r in got) == sorted(w[1:3] + w[4:5] for w in want)
    assert {r["r"] for r in got} == {made.root}
    assert made.subroots().count() == 7


def test_tampering_is_found_only_where_something_changed(spark):
    rows = [(i, "s", "en", 1, "two\nlines" if i % 2 else "one line") for i in range(40)]
    got = {r["doc_id"]: r["verified"] for r in manifest.manifest_report(frame(spark, rows)).collect()}
    assert {i for i, ok in got.items() if not ok} == {i for i in range(40) if i % 2 and zlib.crc32(str(i).encode()) % 2 == 0}


def test_places_without_gathering_a_group(spark):
    rows = spark.range(2000).select(F.when(F.col("id") % 3 == 0, "b").otherwise("a").alias("g"), (F.col("id") % 50).alias("v"), "id")
    got = ranks.ranked(rows.repartition(7), "g", [F.col("v").desc()], "test").collect()
    for g in "ab":
        mine = sorted((r for r in got if r["g"] == g), key=lambda r: r["idx"])
        assert [r["idx"] for r in mine] == list(range(len(mine))) and {r["n"] for r in mine} == {len(mine)}
        assert [r["v"] for r in mine] == sorted((r["v"] for r in mine), reverse=True)

"""Phrases against counts over all runs of words."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from claimscope.llm import collocations

SCHEMA = "lang string, text string, id long, f long, n long, word string, chunk string, `rank` string"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows, least, longest=4, top=2000):
    counts, words = Counter(), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            ws = re.findall(r"[^\x20\x09]+", piece)
            words[lang or "und"] += len(ws)
            for m in range(1, longest + 1):
                for i in range(len(ws) - m + 1):
                    counts[lang or "und", tuple(ws[i : i + m])] += 1
    found = [(lang, ph, a) for (lang, ph), a in counts.items() if len(ph) > 1 and a >= least]
    out = {}
    for lang, ph, a in found:
        inside = [f for other, longer, f in found if other == lang and len(longer) > len(ph) and any(longer[i : i + len(ph)] == ph for i in range(len(longer)))]
        if any(100 * f >= 80 * a for f in inside):
            continue
        cuts = [(2_000_000 * a // (counts[lang, ph[:k]] + counts[lang, ph[k:]]), k) for k in range(1, len(ph))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(ph).encode(), counts[lang, ph[:k]], counts[lang, ph[k:]]))
    rows = []
    for lang, some in out.items():
        for rank, (s, a, phrase, l, r) in enumerate(sorted(some)[:top], 1):
            rows.append((lang, rank, phrase.decode(), -a, l, r, words[lang], -s))
    return sorted(rows)


def texts(seed=3):
    rng = random.Random(seed)
    vocabulary = ["The", "the", "of", "été", "New", "york", "a b", "😀", "x"] + [f"w{k}" for k in range(30)]
    rows = []
    for _ in range(300):
        words = [rng.choice(vocabulary[: rng.choice([5, 12, 39])]) for _ in range(rng.randrange(40))]
        if rng.random() < 0.5:
            words[3:3] = ["as", "far", "as", "I", "know"]
        text = "".join(w + rng.choice([" ", " ", " ", "\t", "  ", ". ", ", ", "\n", "!", " - "]) for w in words)
        rows.append((rng.choice([None, "en", "en", "en", "und", "é"]), text))
    rows += [("en", None), (None, None), ("en", ""), ("none", " . , \n"), ("en", "a a a a a " * 3000), ("fr", "only these"), ("one", "word " * 31)]
    return rows + [("en", "the same text over and over")] * 40


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, "w", "c", "r") for r in rows], SCHEMA)


@pytest.mark.parametrize(("held", "chunk"), [(collocations.HELD_PHRASES, 8_000_000), (0, 2_000)])
def test_phrases_equal_brute_force(spark, monkeypatch, held, chunk):
    """With pairs sent to all tasks, and with pairs joined back to many small chunks."""
    monkeypatch.setattr(collocations, "CHUNK_BYTES", chunk)
    rows = texts()
    got = collocations.collocations(frame(spark, rows).repartition(3), least=8, held_phrases=held).collect()
    assert sorted(map(tuple, got)) == brute(rows, 8)


def test_first_phrases_of_a_language_and_ties(spark):
    rows = [("en", f"b{k} c{k}. " * 30) for k in range(12)]
    got = collocations.collocations(frame(spark, rows), top=5).orderBy("rank").collect()
    assert [r["phrase"] for r in got] == sorted(f"b{k} c{k}" for k in range(12))[:5]
    assert {(r["a"], r["l"], r["r"], r["n"], r["score"]) for r in got} == {(30, 30, 30, 720, 1_000_000)}
    every = collocations.collocations(frame(spark, rows), top=None).orderBy("rank").collect()
    assert [r["rank"] for r in every] == list(range(1, 13))


def test_without_candidates(spark):
    for rows in ([], [(None, None), ("en", "nothing occurs twice")]):
        assert collocations.collocations(frame(spark, rows)).collect() == []


def test_score_is_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    a, l, r = 9_000_000_000_000_001, 9_000_000_000_000_007, 9_100_000_000_000_001
    whole = [F.lit(x).cast("decimal(19,0)") for x in (l, r)]
    got = spark.range(1).select(collocations._score(F.lit(a), whole[0] + whole[1])).first()[0]
    assert got == 2_000_000 * a // (l + r)


@pytest.mark.parametrize(("size", "most"), [(0, 5), (1, 5), (300_000, 300), (20_000, 10**6), (50_000, 90_000), (3_000, 2**40)])
def test_pair_tiles(size, most):
    rng = np.random.default_rng(size)
    left, right = ((most * rng.random(size) ** 3).astype(np.int64) for _ in range(2))
    a, b, n, index = collocations.count_pairs(left, right)
    want = Counter(zip(left.tolist(), right.tolist()))
    assert dict(zip(zip(a.tolist(), b.tolist()), n.tolist())) == want and len(a) == len(want)
    assert (a[index] == left).all() and (b[index] == right).all()


def test_sequences_survive_packing():
    for ids in ([], [-1], [0, 2**40, -1, 7]):
        assert collocations._unpack(collocations._pack(np.array(ids, dtype=np.int64))).tolist() == ids

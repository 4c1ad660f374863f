"""Phrases of two to four words that occur together, per language."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimscope.llm.common import map_arrow, remove_table, shared_table, ship_package
from claimscope.llm.ranks import PLACE_BITS, ranked

LEAST = 30  # occurrences of a candidate
LONGEST = 4  # words of a candidate
TOP = 2000  # phrases per language in the result
SCALE = 2_000_000
COVERED = 80  # percent of a phrase's occurrences inside one longer phrase, from which it goes
CHUNK_BYTES = 8_000_000  # text of a language that is encoded together; a longer document is a chunk of its own
HELD_BYTES = 32_000_000  # text that a task holds, of all languages
TILE_BITS = 8
HEAD_TILES = 256  # tiles per side that may be counted densely: the most frequent 65,536 ids
DENSE_SHARE = 4  # a tile is dense if it holds a pair for every so many cells
HELD_PHRASES = 1_000_000  # pairs that every task may hold at once: 24 bytes each
SPREAD = 64  # parts per language, in which the best phrases are sought first

# The bytes that end a piece, and those that separate words.
ENDS = b".,;:!?\n\x0b\x0c\r"
BLANKS = b" \t"
_MAP = bytes.maketrans(bytes(range(65, 91)) + ENDS + b"\t", bytes(range(97, 123)) + b"." * len(ENDS) + b" ")

BREAK = -1  # in a sequence of ids: no phrase goes across


def words_and_breaks(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text with A-Z in lower case; ``.`` for each end of a piece, and empty ones."""
    return text.translate(_MAP).replace(b".", b" . ").split(b" ")


def count_pairs(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs (left, right), their counts, and for each place the index of its pair.

    Ids are ranks by frequency, so frequent pairs gather in few square tiles. A tile with many
    pairs for its cells is counted by one cell address per pair (bincount); the pairs of all
    other tiles are sorted as coordinates and counted by runs.
    """
    side = 1 << TILE_BITS
    index = np.empty(len(left), dtype=np.int64)
    rows, columns = left >> TILE_BITS, right >> TILE_BITS
    head = (rows < HEAD_TILES) & (columns < HEAD_TILES)
    tile = np.where(head, rows * HEAD_TILES + columns, 0)
    held = np.bincount(tile[head], minlength=HEAD_TILES * HEAD_TILES)
    dense = np.flatnonzero(held * DENSE_SHARE >= side * side)
    slot = np.full(HEAD_TILES * HEAD_TILES, -1, dtype=np.int64)
    slot[dense] = np.arange(len(dense))
    place = np.where(head, slot[tile], -1)

    at = np.flatnonzero(place >= 0)
    cell = (place[at] << 2 * TILE_BITS) | ((left[at] & side - 1) << TILE_BITS) | (right[at] & side - 1)
    cells = np.bincount(cell, minlength=len(dense) * side * side)
    found = np.flatnonzero(cells)
    number = np.cumsum(cells > 0) - 1
    index[at] = number[cell]
    of = dense[found >> 2 * TILE_BITS]
    a = (of // HEAD_TILES << TILE_BITS) | (found >> TILE_BITS & side - 1)
    b = (of % HEAD_TILES << TILE_BITS) | (found & side - 1)

    rest = np.flatnonzero(place < 0)
    order = rest[np.lexsort((right[rest], left[rest]))]
    x, y = left[order], right[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    starts = np.flatnonzero(new)
    index[order] = len(found) + np.cumsum(new) - 1
    counts = np.diff(np.append(starts, len(order)))
    return np.concatenate([a, x[starts]]), np.concatenate([b, y[starts]]), np.concatenate([cells[found], counts]), index


def _pack(ids: np.ndarray) -> bytes:
    """Ids as byte planes of 64 bits each, compressed."""
    planes = np.ascontiguousarray(ids, dtype="<i8").view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view("<i8").ravel()


def _closed_up(line: np.ndarray) -> np.ndarray:
    """A sequence in which breaks that follow each other are one."""
    return line[(line >= 0) | np.append(True, line[:-1] >= 0)]


def _neighbours(line: np.ndarray) -> np.ndarray:
    """Places whose id and the next both are ids, not breaks."""
    return np.flatnonzero((line[:-1] >= 0) & (line[1:] >= 0))


_WORD_ROWS = pa.schema([("chunk", pa.int64()), ("lang", pa.string()), ("pos", pa.int32()), ("word", pa.string()), ("n", pa.int64()), ("ids", pa.binary())])
_LINES = pa.schema([("chunk", pa.int64()), ("lang", pa.string()), ("ids", pa.binary())])
_PAIRS = pa.schema([("chunk", pa.int64()), ("lang", pa.string()), ("pos", pa.int32()), ("left", pa.int64()), ("right", pa.int64()), ("n", pa.int64())])


def _encoded(texts: DataFrame) -> DataFrame:
    """Texts as chunks: distinct words with their counts, and as one more row the sequence of
    their places among these."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << PLACE_BITS
        known: dict[str, defaultdict] = {}
        lines: dict[str, list[np.ndarray]] = defaultdict(list)
        held: Counter[str] = Counter()

        def flush(lang: str) -> Iterator[pa.RecordBatch]:
            nonlocal chunk
            ids = np.concatenate(lines.pop(lang))
            names = pa.array(list(known.pop(lang))[2:], pa.binary()).cast(pa.string())
            size, counts = len(names), np.bincount(ids[ids >= 0], minlength=len(names))
            held.pop(lang)
            chunk += 1
            columns = [np.full(size, chunk), pa.array([lang] * size, pa.string()), np.arange(size, dtype=np.int32), names, counts, pa.nulls(size, pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _WORD_ROWS, strict=True)], schema=_WORD_ROWS)
            yield pa.RecordBatch.from_pylist([{"chunk": chunk, "lang": lang, "ids": _pack(_closed_up(ids))}], schema=_WORD_ROWS)

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                words = known.get(lang)
                if words is None:
                    words = known[lang] = defaultdict()
                    words.default_factory = words.__len__
                    words[b"."], words[b""]  # the ends of pieces are number 0, empty ones 1
                some = words_and_breaks(text or b"")
                ids = np.fromiter(map(words.__getitem__, some), dtype=np.int32, count=len(some))
                ids = ids[ids != 1] - 2
                ids[ids < 0] = BREAK
                lines[lang].append(np.append(ids, np.int32(BREAK)))
                held[lang] += len(text or b"")
                if held[lang] >= CHUNK_BYTES:
                    yield from flush(lang)
                elif held.total() >= HELD_BYTES:
                    for each in list(known):
                        yield from flush(each)
        for each in list(known):
            yield from flush(each)

    return map_arrow(texts, encode, "chunk long, lang string, pos int, word string, n long, ids binary")


def _renamed(lines: DataFrame, names: DataFrame, paired: bool) -> DataFrame:
    """Sequences with ids in the place of each chunk's own numbers (chunk, pos, id); breaks elsewhere.

    A number is a place in the chunk's words or, if ``paired``, in what :func:`count_pairs`
    finds in its sequence.
    """

    def rename(chunk: pa.Table, names: pa.Table) -> pa.Table:
        out = [_LINES.empty_table()]
        for row in chunk.to_pylist():
            line = _unpack(row["ids"])
            if paired:
                at = _neighbours(line)
                index = count_pairs(line[at], line[at + 1])[3]
                line = np.full(len(line), BREAK, dtype=np.int64)
                line[at] = index
            table = np.full(int(line.max(initial=-1)) + 2, BREAK, dtype=np.int64)
            table[names["pos"].to_numpy()] = names["id"].to_numpy()
            # A break is -1 and takes the last entry, a break too.
            out.append(pa.Table.from_pylist([{**row, "ids": _pack(_closed_up(table[line]))}], schema=_LINES))
        return pa.concat_tables(out)

    ship_package(lines.sparkSession)
    given = names.select(F.col("chunk").alias("of"), F.col("pos").alias("pos"), "id")
    return lines.select("chunk", "lang", "ids").groupBy("chunk").cogroup(given.groupBy("of")).applyInArrow(rename, "chunk long, lang string, ids binary")


def _looked_up(lines: DataFrame, phrases: pa.Table) -> DataFrame:
    """Sequences of pairs: the id of each pair of neighbours, from a table that every task holds whole."""
    known = {}
    for lang in pc.unique(phrases["lang"]).to_pylist():
        mine = phrases.filter(pc.equal(phrases["lang"], lang))
        codes = (mine["left"].to_numpy() << 32) | mine["right"].to_numpy()
        order = np.argsort(codes)
        known[lang] = codes[order], mine["id"].to_numpy()[order]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for lang, ids in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                line = _unpack(ids)
                at = _neighbours(line)
                out = np.full(len(line), BREAK, dtype=np.int64)
                if lang in known:
                    codes, names = known[lang]
                    wanted = (line[at] << 32) | line[at + 1]
                    spot = np.minimum(np.searchsorted(codes, wanted), len(codes) - 1)
                    out[at] = np.where(codes[spot] == wanted, names[spot], BREAK)
                packed.append(_pack(_closed_up(out)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], schema=_LINES)

    return map_arrow(lines.select("chunk", "lang", "ids"), look_up, "chunk long, lang string, ids binary")


def _pairs(lines: DataFrame) -> DataFrame:
    """Each chunk's distinct pairs of neighbours, numbered, with their counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, lang, ids in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                line = _unpack(ids)
                at = _neighbours(line)
                left, right, counts, _ = count_pairs(line[at], line[at + 1])
                size = len(left)
                columns = [np.full(size, chunk), pa.array([lang] * size, pa.string()), np.arange(size, dtype=np.int32), left, right, counts]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PAIRS, strict=True)], schema=_PAIRS)

    return map_arrow(lines.select("chunk", "lang", "ids"), count, "chunk long, lang string, pos int, left long, right long, n long")


def frequent_phrases(texts: DataFrame, least: int = LEAST, longest: int = LONGEST, held_phrases: int = HELD_PHRASES) -> tuple[DataFrame, list[DataFrame]]:
    """All words per language (lang, n), and for each length a table of its frequent phrases.

    ``texts`` has lang (not NULL) and text. A table has lang, id (rank by frequency, from 0),
    f (occurrences) and word, or left and right: ids of the phrases one word shorter at its
    start and its end. A phrase of ``least`` occurrences has no rarer part, so each level
    pairs only neighbours that are frequent themselves.

    Texts are encoded chunk by chunk against the chunk's own dictionary, whose entries are
    summed over all chunks, ranked, and joined back to the chunk. So are the pairs of a
    chunk, except that a table of at most ``held_phrases`` pairs is sent to all tasks whole.
    Both ways give the same rows. What a level stored is deleted after the next has read it.
    """

    def ranks(entries: DataFrame, keys: list[str], length: int) -> DataFrame:
        totals = entries.groupBy("lang", *keys).agg(F.sum("n").alias("f")).where(F.col("f") >= least)
        named = ranked(totals, "lang", [F.col("f").desc(), *(F.col(k) for k in keys)], f"phrases-{length}").drop("n")
        return shared_table(named.withColumnRenamed("idx", "id"), f"phrases-{length}-ids")

    coded = shared_table(_encoded(texts), "phrases-words", compression="zstd")
    entries = coded.where("ids is null")
    words = shared_table(entries.groupBy("lang").agg(F.sum("n").alias("n")), "phrases-n")
    levels = [ranks(entries, ["word"], 1)]
    names = entries.join(levels[0].select("lang", "word", "id"), ["lang", "word"])
    lines = shared_table(_renamed(coded.where("ids is not null"), names, paired=False), "phrases-lines")
    remove_table(coded)
    for length in range(2, longest + 1):
        entries = _pairs(lines)
        phrases = ranks(entries, ["left", "right"], length)
        levels.append(phrases)
        if length == longest:
            break
        size, most = phrases.agg(F.count("*"), F.max(F.greatest("left", "right"))).first()
        if size <= held_phrases and (most or 0) < 1 << 31:
            paired = _looked_up(lines, phrases.select("lang", "left", "right", "id").toArrow())
        else:
            names = entries.join(phrases.select("lang", "left", "right", "id"), ["lang", "left", "right"])
            paired = _renamed(lines, names, paired=True)
        done, lines = lines, shared_table(paired, "phrases-lines")
        remove_table(done)
    return words, levels


def _spelled(levels: list[DataFrame]) -> list[DataFrame]:
    """Per length: lang, id, f, left, right, words, and f of every start and of every end of the phrase."""
    one = levels[0].select("lang", "id", "f", F.array("word").alias("words"), F.array("f").alias("starts"), F.array("f").alias("ends"))
    out = [one]
    for level in levels[1:]:
        a = out[-1].select("lang", F.col("id").alias("left"), F.col("words").alias("a_words"), F.col("starts").alias("a_starts"))
        b = out[-1].select("lang", F.col("id").alias("right"), F.col("words").alias("b_words"), F.col("ends").alias("b_ends"))
        both = level.join(a, ["lang", "left"]).join(b, ["lang", "right"])
        spelled = both.select(
            "lang",
            "id",
            "f",
            "left",
            "right",
            F.concat("a_words", F.slice("b_words", -1, 1)).alias("words"),
            F.concat("a_starts", F.array("f")).alias("starts"),
            F.concat("b_ends", F.array("f")).alias("ends"),
        )
        out.append(shared_table(spelled, "phrases-spelled"))
    return out


def _score(a: Column, parts: Column) -> Column:
    """floor(2,000,000 a / parts) in whole numbers that do not overflow."""
    product = F.lit(SCALE).cast("decimal(7,0)") * a.cast("decimal(19,0)")
    return F.floor((product - F.pmod(product, parts)) / parts).cast("long")


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, longest: int = LONGEST, top: int | None = TOP, held_phrases: int = HELD_PHRASES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of each language, or all.

    A candidate has 2 to ``longest`` words and ``least`` occurrences, ``a``, within pieces;
    ``l`` and ``r`` are those of the parts of the cut with the lowest score (the first such
    cut). Candidates go if a longer one holds them and has 80 percent of their occurrences;
    the longest do so through those in between, whose occurrences are no fewer. ``n`` counts
    all words of the language. Order: score, then a, descending, then phrase bytewise.

    A NULL language is ``und``, a NULL text is empty; repeated rows count as often as they
    occur. Without candidates the result is empty.
    """
    texts = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text}`").cast("string").alias("text"))
    words, levels = frequent_phrases(texts, least, longest, held_phrases)
    spelled = _spelled(levels)
    whole = lambda c: c.cast("decimal(19,0)")
    found = None
    for length in range(2, longest + 1):
        a = F.col("f")
        cuts = []
        for k in range(1, length):
            first, rest = F.col("starts")[k - 1], F.col("ends")[length - k - 1]
            cuts.append(F.struct(_score(a, whole(first) + whole(rest)).alias("score"), F.lit(k).alias("k"), first.alias("l"), rest.alias("r")))
        scored = spelled[length - 1].select("lang", "id", F.array_join("words", " ").alias("phrase"), a.alias("a"), F.array_min(F.array(*cuts)).alias("cut"))
        if length < longest:
            inner = spelled[length].select("lang", F.explode(F.array_distinct(F.array("left", "right"))).alias("id"), "f")
            cover = inner.groupBy("lang", "id").agg(F.max("f").alias("cover"))
            scored = scored.join(cover, ["lang", "id"], "left")
            scored = scored.where(F.coalesce(100 * whole(F.col("cover")) < COVERED * whole(F.col("a")), F.lit(True)))
        scored = scored.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
        found = scored if found is None else found.unionByName(scored)
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    if top is not None:
        # The first of each part of a language, then of those.
        part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SPREAD))).orderBy(*best)
        found = found.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top).drop("rank")
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).where(F.col("rank") <= top)
    else:
        found = ranked(found, "lang", best, "phrases-found").drop("n").withColumn("rank", F.col("idx") + 1).drop("idx")
    return found.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")

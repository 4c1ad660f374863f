"""Language identification by a string kernel, Nyström landmarks and kernel ridge regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimscope.llm.common import ROW, id_residue, keep_freed_memory, map_arrow, with_row

UNKNOWN = "und"
FOLDS = 5


@dataclass(frozen=True)
class Settings:
    """Bounds of the training sample and of the model; none of them bounds what is scored.

    ``rows`` and ``landmarks`` are per language, and in all at most ``all_rows`` and
    ``all_landmarks``, but two rows and one landmark for each: every language is learned, and
    more than ``all_rows`` / 2 are an error. ``spare`` rows more of each language tell, outside
    the fit, how much of a text in a learned language is familiar.
    """

    grams: int = 4
    bucket_bits: int = 18
    rows: int = 256
    all_rows: int = 16_384
    landmarks: int = 32
    all_landmarks: int = 2_048
    spare: int = 64
    ridge: float = 1e-4
    batch: int = 64
    seed: int = 7
    low: float = 0.01
    share: float = 0.75
    few_grams: int = 24
    least_rows: int = 20


@dataclass(frozen=True)
class Model:
    """Languages, the grams of the landmarks, landmarks by grams, their norms, and weights.

    ``bar`` is the share of a text's grams that some landmark has, below which the text is
    taken to be in no learned language: ``share`` times what all but ``low`` of the labelled
    rows outside the fit reach; 0 where there are fewer than ``least_rows`` of these.
    """

    settings: Settings
    names: list[str]
    grams: np.ndarray
    landmarks: np.ndarray
    norms: np.ndarray
    weights: np.ndarray
    bar: float = 0.0


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def presence(text: str | None, settings: Settings) -> np.ndarray | None:
    """Which grams of 1 to ``grams`` code points a text has, by hash bucket; None without letters.

    Letters count in lower case, and each run of anything else as one blank.
    """
    if not text:
        return None
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = _letters()[codes]
    if not letter.any():
        return None
    codes = np.where(letter, codes, np.uint32(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    codes = codes[keep]
    found = np.zeros(1 << settings.bucket_bits, dtype=bool)
    rolled = codes
    for n in range(1, settings.grams + 1):
        if n > 1:
            if len(codes) < n:
                break
            rolled = rolled[:-1] * np.uint32(0x01000193) + codes[n - 1 :]
        mixed = (rolled ^ np.uint32(n * 0x51ED27)) * np.uint32(0x9E3779B1)
        found[mixed >> np.uint32(32 - settings.bucket_bits)] = True
    return found


def _sample(labelled: DataFrame, settings: Settings) -> tuple[dict[str, list[np.ndarray]], int]:
    """Buckets of a bounded sample of each language, in drawn order, and how many are for the fit.

    A hash of id and text draws, so rows that share an id are told apart and equal rows are
    one. Each language's bar is set by how many draws it has, such that it passes about twice
    the rows that are wanted; of these the smallest are taken. Only draws reach the driver
    before that, and then the buckets of the rows taken.
    """
    spark, span = labelled.sparkSession, 1 << 30
    draw = F.pmod(F.xxhash64(F.lit(settings.seed), "doc_id", "text"), F.lit(span))
    drawn = labelled.where(F.regexp_like("text", F.lit(r"\p{L}"))).withColumn("draw", draw)
    most = settings.all_rows // 2
    counts = drawn.groupBy("lang").agg(F.approx_count_distinct("draw").alias("n")).limit(most + 1).collect()
    if len(counts) > most:
        raise ValueError(f"more than {most} languages; raise all_rows")
    if not counts:
        return {}, 0
    rows = max(2, min(settings.rows, settings.all_rows // len(counts)))
    wanted = rows + min(settings.spare, rows)
    bars = [(r["lang"], min(span, -(-(2 * wanted + 16) * span // max(1, r["n"])))) for r in counts]
    # One row per language: at most ``most``.
    some = drawn.join(F.broadcast(spark.createDataFrame(bars, "lang string, bar long")), "lang").where("draw < bar").drop("bar")
    passed: dict[str, list[int]] = {}
    for r in some.select("lang", "draw").distinct().collect():
        passed.setdefault(r["lang"], []).append(r["draw"])
    taken = [(lang, d) for lang, draws in passed.items() for d in sorted(draws)[:wanted]]
    if not taken:
        return {}, rows
    one = some.join(F.broadcast(spark.createDataFrame(taken, "lang string, draw long")), ["lang", "draw"]).dropDuplicates(["lang", "draw"]).select("lang", "draw", "text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(lang, draw, np.flatnonzero(p).astype("<i4").tobytes()) for lang, draw, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True) if (p := presence(text, settings)) is not None]
            columns = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.binary()), strict=True)], ["lang", "draw", "buckets"])

    found: dict[str, list[np.ndarray]] = {}
    for lang, _, raw in sorted(map(tuple, map_arrow(one, features, "lang string, draw long, buckets binary").collect())):
        found.setdefault(lang, []).append(np.frombuffer(raw, dtype="<i4"))
    return found, rows


def fit(docs: DataFrame, settings: Settings = Settings(), text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> Model | None:
    """A model from the labelled documents outside the held-out fold; None if there are none.

    Landmarks are the first documents of each language's sample. The kernel of two texts is
    the number of grams both have, over the root of the product of how many each has. Kernel
    ridge regression, one language against the rest, is solved in the span of the landmarks:
    (K_nm' K_nm + ridge n K_mm) w = K_nm' y.
    """
    cols = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang"))
    labelled = cols.where((id_residue(F.col("doc_id"), FOLDS) != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sample, each_rows = _sample(labelled, settings)
    names = sorted(sample)
    if not names:
        return None
    rows = [(n, buckets) for n in names for buckets in sample[n][:each_rows]]
    each = max(1, min(settings.landmarks, settings.all_landmarks // len(names)))
    chosen = [buckets for n in names for buckets in sample[n][:each]]
    grams = np.unique(np.concatenate(chosen))
    place = np.full(1 << settings.bucket_bits, -1, dtype=np.int32)
    place[grams] = np.arange(len(grams))
    marks = np.zeros((len(grams), len(chosen)), dtype=np.float32)
    for j, buckets in enumerate(chosen):
        marks[place[buckets], j] = 1
    norms = np.sqrt(np.array([len(b) for b in chosen], dtype=np.float32))
    kernel = np.zeros((len(rows), len(chosen)))
    for i, (_, buckets) in enumerate(rows):
        at = place[buckets]
        kernel[i] = marks[at[at >= 0]].sum(axis=0) / (norms * np.sqrt(len(buckets)))
    among = (marks.T @ marks) / np.outer(norms, norms)
    truth = np.where(np.array([r[0] for r in rows])[:, None] == np.array(names)[None, :], 1.0, -1.0)
    system = kernel.T @ kernel + settings.ridge * len(rows) * (among + 1e-6 * np.eye(len(chosen)))
    weights = np.linalg.solve(system, kernel.T @ truth).astype(np.float32)
    # Rows outside the fit; where there are too few, rows that are no landmarks.
    outside = [b for n in names for b in sample[n][each_rows:]]
    if len(outside) < settings.least_rows:
        outside = [b for n in names for b in sample[n][each:]]
    shares = [float((place[b] >= 0).mean()) for b in outside if len(b) >= settings.few_grams]
    bar = settings.share * float(np.quantile(shares, settings.low)) if len(shares) >= settings.least_rows else 0.0
    return Model(settings, names, grams, marks, norms, weights, bar)


def score_texts(model: Model | None, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
    """Best language and its score from 0 to 1 for each text, by matrix products over batches,
    and the share of the text's grams that some landmark has (1 for texts of few grams)."""
    names, scores, familiar = [UNKNOWN] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
    if model is None:
        return names, scores, familiar
    step = model.settings.batch
    for k in range(0, len(texts), step):
        some = texts[k : k + step]
        grams = np.zeros((len(some), len(model.grams)), dtype=np.float32)
        sizes = np.zeros(len(some), dtype=np.float32)
        for row, text in enumerate(some):
            found = presence(text, model.settings)
            if found is not None:
                grams[row] = found[model.grams]
                sizes[row] = np.count_nonzero(found)
        kernel = (grams @ model.landmarks) / (np.sqrt(np.maximum(sizes, 1))[:, None] * model.norms)
        values = kernel @ model.weights
        best = values.argmax(axis=1)
        shares = np.where(sizes < model.settings.few_grams, 1, grams.sum(axis=1) / np.maximum(sizes, 1))
        for row in np.flatnonzero(sizes).tolist():
            names[k + row] = model.names[best[row]]
            scores[k + row] = float(np.clip((1 + values[row, best[row]]) / 2, 0, 1))
            familiar[k + row] = float(shares[row])
    return names, scores, familiar


def predict(docs: DataFrame, model: Model | None, text: str = "text", doc_id: str = "doc_id", keep_row: bool = False) -> DataFrame:
    """doc_id, held_out, lang_pred, score and familiar (0 to 1), from the whole texts alone."""
    key, body = F.col(f"`{doc_id}`"), F.col(f"`{text}`").cast("string")
    slim = with_row(docs, body=body) if keep_row else docs.select(key.alias("doc_id"), (id_residue(key, FOLDS) == 0).alias("held_out"), body.alias("body"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("familiar", T.DoubleType())]
    schema = T.StructType([*(f for f in slim.schema if f.name != "body"), *added])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed_memory()
        for batch in batches:
            names, *numbers = score_texts(shared.value, batch.column(batch.num_columns - 1).to_pylist())
            columns = [*batch.columns[:-1], pa.array(names, pa.string()), *(pa.array(n, pa.float64()) for n in numbers)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "lang_pred", "score", "familiar"])

    return map_arrow(slim, step, schema)


def identify(docs: DataFrame, settings: Settings = Settings(), text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """Learns from ``docs`` and predicts every row: doc_id, held_out, lang_pred, score, familiar.

    NULL texts and texts without a letter are ``und`` with score 0, as is everything where no
    row is labelled. Of languages with equal scores the first by name wins. NULL ids are in
    the held-out fold. Repeated rows get equal predictions; an empty table gives none.
    """
    return predict(docs, fit(docs, settings, text, lang, doc_id), text, doc_id)


def keep_identified(docs: DataFrame, settings: Settings = Settings(), text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """Rows and columns of ``docs`` that are in a learned language.

    Texts without a letter go, and those of which a smaller share is familiar than the
    model's bar, see :class:`Model`: other scripts, other languages that share few grams, and
    noise. Texts of fewer than ``few_grams`` grams are not judged by it.
    """
    model = fit(docs, settings, text, lang, doc_id)
    marked = predict(docs, model, text, doc_id, keep_row=True)
    bar = model.bar if model else 0.0
    return marked.where((F.col("lang_pred") != UNKNOWN) & (F.col("familiar") >= bar)).select(f"{ROW}.*")

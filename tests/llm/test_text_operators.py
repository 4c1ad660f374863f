"""Text operators against brute force, and on awkward input."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import zip_longest

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from claimscope.llm import components, language, lines, lm, merkle, mixing, packing, planes, quality, simhash, tokens, urls

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, _row string, spots string, copies string, `odd name.` string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "uno dos tres cuatro cinco seis siete ocho nueve diez " * 3000
TEXTS = [
    "the cat sat on the mat and the dog sat on the rug by the door of the old house",
    "the cat sat on the mat and the dog sat on the rug by the door of the old house",
    "The cat sat on the mat and the dog sat on the rug by the door of the old barn",
    "der Hund und die Katze sind in dem alten Haus bei der grossen Brücke am Fluss",
    "der Mann und die Frau sind nicht in der Stadt, aber bei dem Haus mit dem Garten",
    "line one\nline two\nline three\nline four",
    "other\nline one\nline two\nline three\nend\nline one\nline two\nline three",
    "",
    None,
    "   \n\t\n ",
    "12345 !!! ###",
    "a",
    "tab\tand  two blanks and <|endoftext|> emoji 😀 é 中文字\r\nnext",
    LONG,
    "x y z " * 40,
]


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and very long texts, repeated rows, a NULL id and columns with clashing names."""
    rows = [(i, t, [None, "en", "de"][i % 3], [None, "b", "a", "é", "B"][i % 5], len(t or ""), "s", "r", "p", "c", "o") for i, t in enumerate(TEXTS)]
    rows += [rows[3], rows[6], (None, "text without an id", "en", "b", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


# --- language ----------------------------------------------------------------------------


def test_presence_kernel_counts_distinct_grams():
    s = language.Settings(grams=2)
    assert np.count_nonzero(language.presence("aba", s)) == 4  # a b ab ba
    assert np.count_nonzero(language.presence("A!!b", s)) == 5  # a, blank, b, "a ", " b"
    assert language.presence("12 !", s) is None
    assert language.presence(None, s) is None


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 20
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.95 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_edges(docs, none):
    rows = language.identify(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        text = TEXTS[r["doc_id"]] if r["doc_id"] is not None else "text"
        assert (r["lang_pred"] == "und") == (not text or not any(map(str.isalpha, text)))
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode() if r["doc_id"] is not None else b"") % 5 == 0)
    assert language.identify(none).count() == 0
    unlabelled = language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r["lang_pred"], r["score"]) for r in unlabelled} == {("und", 0.0)}
    kept = language.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 4


def lettered(n):
    """A word of its own for each number."""
    return "".join(chr(97 + int(c)) for c in str(n)) + "qz"


def test_every_label_is_learned(spark):
    """300 labels, the rarest with one document, and one with most documents equal."""
    rows = [(3 * i + k, " ".join([lettered(i)] * 3 + ["common words"]), f"l{i:03}") for i in range(300) for k in range(3 if i % 7 else 1)]
    rows += [(10_000, "the very same text in every row", "hot")] * 1500
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs)
    inside = {r[2] for r in rows if zlib.crc32(str(r[0]).encode()) % 5}
    assert model.names == sorted(inside) and len(inside) > 240
    assert len(model.norms) <= language.Settings().all_landmarks
    with pytest.raises(ValueError, match="more than 100 languages"):
        language.fit(docs, language.Settings(all_rows=200))


def test_rows_of_one_id_are_told_apart_by_their_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one = docs.select(F.lit(1).cast("long").alias("doc_id"), "text", "lang")
    assert language.fit(one.union(one)).names == ["de", "en", "es", "fr"]
    got = language.identify(one).select("lang_pred").distinct().count()
    assert got == 4


def test_kernel_and_ridge_equal_brute_force(spark):
    """Thirty documents, all of them landmarks and rows of the fit, with grams as text."""
    settings = language.Settings(bucket_bits=26, batch=7)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("n_chars between 20 and 400 and lang is not null").orderBy("doc_id").limit(30)
    rows = docs.collect()

    def grams(text):
        plain = re.sub(r"[^\W\d_]+|(.)", lambda m: m[0] if m[1] is None else "\0", text.lower(), flags=re.S)
        plain = re.sub("\0+", " ", plain)
        return {(n, plain[i : i + n]) for n in range(1, 5) for i in range(len(plain) - n + 1)}

    sets = {r["doc_id"]: grams(r["text"]) for r in rows}
    train = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5]
    kernel = lambda a, b: len(a & b) / math.sqrt(len(a) * len(b))
    names = sorted({r["lang"] for r in train})
    k = np.array([[kernel(sets[a["doc_id"]], sets[b["doc_id"]]) for b in train] for a in train])
    truth = np.array([[1.0 if r["lang"] == n else -1.0 for n in names] for r in train])
    # Nyström with every row a landmark: (K'K + ridge n K) w = K'y.
    weights = np.linalg.solve(k.T @ k + settings.ridge * len(train) * (k + 1e-6 * np.eye(len(train))), k.T @ truth)
    got = {r["doc_id"]: r for r in language.identify(docs, settings).collect()}
    for r in rows:
        values = np.array([kernel(sets[r["doc_id"]], sets[b["doc_id"]]) for b in train]) @ weights
        assert got[r["doc_id"]]["lang_pred"] == names[int(values.argmax())]
        assert abs(got[r["doc_id"]]["score"] - min(1, max(0, (1 + values.max()) / 2))) < 2e-3


FOREIGN = {
    "greek": "Η γλώσσα είναι ένα σύστημα επικοινωνίας που χρησιμοποιούν οι άνθρωποι",
    "chinese": "语言是人类用来交流的系统 它有很多种形式 每一种都有自己的规则",
    "russian": "Язык это система общения которую используют люди",
    "consonants": "bcdfg hjklm npqrs tvwxz qwrtp sdfgh jklzx cvbnm zxcvb mnbvc lkjhg fdsqp trwqz",
    "digits in hex": "9f3ac01b 77e0d2c4 b81ffa06 0cd4e9aa 51bb7c3e d00f6a92 e47ac18f 6b9d20fe",
}


def test_foreign_scripts_and_noise_are_not_identified(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = spark.createDataFrame([(10**9 + k, t, None, "odd", len(t)) for k, t in enumerate(FOREIGN.values())], docs.schema)
    kept = language.keep_identified(docs.union(odd))
    assert kept.where("source = 'odd'").count() == 0
    # All documents of the table are in a learned language; only texts without a letter go.
    assert kept.count() == docs.where(r"regexp_like(text, '\\p{L}')").count()


# --- quality -----------------------------------------------------------------------------


def brute_quality(text):
    words = WORDS.findall(text or "")
    seen = defaultdict(list)
    for i in range(len(words) - 2):
        seen[tuple(words[i : i + 3])].append(i)
    covered = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(3)}
    rows = [x for x in (text or "").split("\n") if WORDS.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(rows) - len(set(rows)), len(covered)


def test_quality_measurements(docs, none):
    for r in quality.ledger(docs).collect():
        text = TEXTS[r["doc_id"]] if r["doc_id"] is not None else "text without an id"
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_quality(text), r
    assert quality.ledger(none).count() == 0
    clash = quality.ledger(docs.withColumn("n_words", F.lit(-1)), keep=("doc_id", "n_words"))
    assert {r["row_n_words"] for r in clash.collect()} == {-1} and clash.columns[:3] == ["doc_id", "row_n_words", "n_words"]


def test_policies_and_ablation_follow_from_bits(docs):
    entries = quality.ledger(docs)
    kept = {r["doc_id"]: r["kept"] for r in quality.apply_policy(entries, quality.STANDARD).collect()}
    assert not any(kept.values())  # all are short or repeat themselves
    bits = [r["failed_bits"] for r in entries.collect()]
    policy = quality.Policy("v", ("few_words", "repeated_words", "few_letters"))
    mask = policy.mask(quality.RULES)
    for r in quality.ablation(entries, policy).collect():
        bit = 1 << next(x.bit for x in quality.RULES if x.name == r["rule"])
        assert r["n_failed"] == sum(bool(b & bit) for b in bits)
        assert r["n_failed_alone"] == sum(b & mask == bit for b in bits)
        assert r["n_kept_without"] == sum(b & mask & ~bit == 0 for b in bits)


# --- lines -------------------------------------------------------------------------------


def test_line_dedup_edges(docs, none):
    got = {r["doc_id"]: r for r in lines.line_report(docs).collect() if r["doc_id"] is not None}
    assert got[5]["n_removed"] == 0
    assert got[6]["text"] == "other\nend" and got[6]["n_removed"] == 6
    assert got[8]["text"] is None and got[8]["n_lines"] == 0
    assert got[7]["text"] == "" and got[9]["text"] == TEXTS[9] and got[13]["text"] == TEXTS[13]
    assert lines.line_report(docs).count() == docs.count()
    assert lines.drop_repeated_lines(docs).columns == docs.columns
    assert lines.line_report(none).count() == 0


def test_line_dedup_brute_force(spark):
    rng = np.random.default_rng(3)
    texts = ["\n".join(rng.choice(["a", "b", "c", "d", ""], rng.integers(0, 12)).tolist()) for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    seen, want = set(), {}
    for i, t in enumerate(texts):
        ls, hit = t.split("\n"), set()
        for k in range(len(ls) - 2):
            w = tuple(ls[k : k + 3])
            if "".join(w):
                if w in seen:
                    hit |= {k, k + 1, k + 2}
                seen.add(w)
        want[i] = "\n".join(x for k, x in enumerate(ls) if k not in hit)
    assert {r["doc_id"]: r["text"] for r in lines.line_report(df).collect()} == want


# --- tokens, packing, planes -------------------------------------------------------------


def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(tokens.tokenizer_path())
    mine = tokens.encoder(tokens.tokenizer_path())
    rng = np.random.default_rng(1)
    letters = list("ab A.,!?'s1  \n\n\t\r\x0b\x1c\x85\xa0 é中😀​ǅ") + ["<|endoftext|>"]
    texts = [t for t in TEXTS if t] + ["".join(rng.choice(letters, rng.integers(0, 14))) for _ in range(3000)]
    for t in texts + texts[:50]:
        assert mine.encode(t).tolist() == tool.encode(t, add_special_tokens=False).ids, repr(t)
    assert mine.encode(None).tolist() == []


def test_encoder_asks_once_for_a_word_of_many_texts(monkeypatch):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(tokens.tokenizer_path())
    mine = tokens.Encoder(tokens.tokenizer_path())
    asked = []

    class Model:
        def tokenize(self, letters):
            asked.append(letters)
            return tool.model.tokenize(letters)

    mine.model = Model()
    rng = np.random.default_rng(2)
    words = ["thndering", "ouêoich", "ǅungle", "it's", "x1", "中文"]
    texts = [f"Zq {w}{s} {w}\nZq{s}\n{w}" for w in words for s in ("", ",", "%%%", "')", "'s", "_-", "é", "\u037e")] + [None, "", " ", "a  b", "<|endoftext|>"]
    texts = [texts[k] for k in rng.permutation(len(texts) * 3) % len(texts)]
    monkeypatch.setattr(tokens, "LOT_CHARS", 2000)  # several lots
    got = mine.encode_all(texts)
    assert [x.tolist() for x in got] == [tool.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert list(mine.encode_all([])) == []
    assert max(Counter(asked).values()) <= 2  # once as a word, once as a run of a longer piece


def ids_of(text):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(tokens.tokenizer_path())
    return np.array([*tool.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")


def test_packing(docs, none):
    docs = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = packing.pack(docs.repartition(4), tokens.tokenizer_path(), length=64).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(range(len(TEXTS)))
    for doc, pieces in by_doc.items():
        pieces.sort(key=lambda r: r["start"])
        got = np.concatenate([np.frombuffer(r["ids"], "<u4") for r in pieces])
        assert got.tolist() == ids_of(TEXTS[doc]).tolist()
        assert [r["start"] for r in pieces] == np.cumsum([0, *(r["length"] for r in pieces)])[:-1].tolist()
        assert {r["doc_tokens"] for r in pieces} == {len(got)}
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for number, pieces in by_sequence.items():
        pieces.sort(key=lambda r: r["offset"])
        ends = np.cumsum([r["length"] for r in pieces])
        assert [r["offset"] for r in pieces] == [0, *ends[:-1].tolist()]
        assert ends[-1] == 64 or number == len(by_sequence) - 1
    assert packing.pack(none, tokens.tokenizer_path()).count() == 0
    whole = packing.sequences(packing.pack(docs, tokens.tokenizer_path(), length=64), 64).collect()
    assert {len(r["ids"]) for r in whole} == {256} and sum(r["n_tokens"] for r in whole) == sum(r["length"] for r in rows)


@pytest.mark.parametrize("kind", ["B", "b"])
def test_planes_round_trip(spark, docs, none, kind, tmp_path):
    folder = f"file://{tmp_path}/planes"
    manifest = planes.write(docs, tokens.tokenizer_path(), folder, kind=kind, rows=5)
    got = planes.read(spark, manifest, folder).orderBy("start").collect()
    want = sorted([(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (6, TEXTS[6])])
    assert [r["doc_id"] for r in got] == [None, *(i for i, _ in want)]
    at = 0
    for r, text in zip(got, ["text without an id", *(t for _, t in want)], strict=True):
        ids = ids_of(text)
        assert (r["start"], r["n_tokens"], np.frombuffer(r["ids"], "<u4").tolist()) == (at, len(ids), ids.tolist())
        at += len(ids)
    empty = planes.write(none, tokens.tokenizer_path(), folder)
    assert planes.read(spark, empty, folder).count() == 0


def test_files_of_long_texts_hold_fewer(spark, tmp_path):
    folder = f"file://{tmp_path}/planes"
    texts = ["long words " * 4000 if k < 40 else "short" for k in range(440)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    manifest = planes.write(docs, tokens.tokenizer_path(), folder, rows=40)
    files = manifest.orderBy("file").collect()
    assert sum(r["n_docs"] for r in files) == 440 and max(r["n_tokens"] for r in files) <= 8 * len(ids_of(texts[0]))
    got = planes.read(spark, manifest, folder).orderBy("start").select("doc_id", "n_tokens").collect()
    assert [tuple(r) for r in got] == [(k, len(ids_of(t))) for k, t in enumerate(texts)]


def test_chunk_index_finds_a_block(tmp_path):
    ids = np.random.default_rng(0).integers(0, 1 << 32, 3 * planes.BLOCK + 17, dtype=np.uint32)
    with open(tmp_path / "x", "wb") as sink:
        writer = planes.Writer(sink, "b")
        for k in range(0, len(ids), 50_001):
            writer.add(k, ids[k : k + 50_001])
        writer.close()
    from pyarrow import fs

    with fs.LocalFileSystem().open_input_file(str(tmp_path / "x")) as source:
        reader = planes.Reader(source)
        assert reader.block(2).tolist() == ids[2 * planes.BLOCK : 3 * planes.BLOCK].tolist()
        assert np.concatenate([x for _, _, x in reader.documents()]).tolist() == ids.tolist()


# --- language model ----------------------------------------------------------------------


def test_gradients_match_differences():
    s = lm.Settings(window=6, stride=4, width=4, hidden=5, classes=7)
    net = lm.Network(**{k: v.astype(np.float64) for k, v in vars(lm.Network.start(9, s)).items()})
    rng = np.random.default_rng(0)
    inputs, goal, mask = rng.integers(0, 9, (3, 6)), rng.integers(0, 7, (3, 6)), rng.random((3, 6)) < 0.7
    _, grads = net.gradients(inputs, goal, mask)
    for name in vars(net):
        array = getattr(net, name)
        at = (inputs[0, 1], 0) if name == "embed" else (0,) * array.ndim
        kept = array[at]
        array[at] = kept + 1e-4
        up, _ = net.gradients(inputs, goal, mask)
        array[at] = kept - 1e-4
        down, _ = net.gradients(inputs, goal, mask)
        array[at] = kept
        assert grads[name][at] == pytest.approx((up - down) / 2e-4, rel=1e-3, abs=1e-7), name


@pytest.mark.parametrize("scale", [-400, 400])
def test_attention_weights_are_shares_however_large_the_logits_are(scale):
    s = lm.Settings(window=6, stride=4, width=4, hidden=5, classes=7)
    net = lm.Network.start(9, s)
    net.key = scale * net.query  # a position's own logit, all that the first one sees, then lies far from zero
    rng = np.random.default_rng(5)
    symbols, goal, mask = rng.integers(0, 9, (3, 6)), rng.integers(0, 7, (3, 6)), np.ones((3, 6), dtype=bool)
    x = (net.embed[symbols] + net.place).astype(np.float64)
    logits = (x @ net.query / 2) @ (x @ net.key).transpose(0, 2, 1)
    assert abs(logits[:, 0, 0]).min() > 110
    logits[:, np.tri(6) == 0] = -np.inf
    want = np.exp(logits - logits.max(axis=2, keepdims=True))
    found = net.attend(symbols)
    np.testing.assert_allclose(found["weight"], want / want.sum(axis=2, keepdims=True), atol=1e-3)
    loss, grads = net.gradients(symbols, goal, mask)
    assert math.isfinite(loss) and all(np.isfinite(g).all() for g in grads.values())
    scores = np.take_along_axis(net.log_classes(found["g"]).reshape(3, 6, 7), goal[:, :, None], axis=2)[:, 2:, 0]
    np.testing.assert_allclose(lm.Scorer(net).log10_classes(symbols, 2, goal[:, 2:]), scores / math.log(10), atol=1e-3)
    trainer = lm.Trainer(net, s, 0.01, 1)
    trainer.learn(symbols, goal, mask)
    assert np.isfinite(trainer.flat).all()


def test_windows_score_each_target_once():
    s = lm.Settings(window=8, stride=5)
    lengths = np.array([1, 7, 8, 9, 13, 14, 40])
    text, first, fresh = lm.windows(lengths, s)
    for k, n in enumerate(lengths):
        scored = [f + i for t, f, x in zip(text, first, fresh, strict=True) if t == k for i in range(x, s.window) if f + i < n]
        assert scored == list(range(n))


def odd_texts():
    """Runs of words, signs and white space of every kind, as they come."""
    rng = np.random.default_rng(5)
    parts = ["a", "B", "é", "中", "12", "'s", "!", "_", " the", "Word", "😀", "<|endoftext|>", "\x00", "\x1c", "\u2003", "\xa0", "\t", "\x0b", "\r", " \n", *" \n" * 4]
    return ["".join(rng.choice(parts, rng.integers(0, 14))) for _ in range(4_000)] + [*TEXTS, "\n", "a b\nc d\ne"]


def test_words_of_a_lot():
    texts = odd_texts()
    lot = lm.Lot(pa.array(texts))
    words, ends = lot.distinct.take(pa.array(lot.code)).to_pylist(), np.cumsum(lot.count)
    for k, text in enumerate(texts):
        assert words[ends[k] - lot.count[k] : ends[k]] == WORDS.findall(lower(text or "")), text
    want = Counter(words)
    assert dict(zip(*(c.to_pylist() for c in lot.counts().columns), strict=True)) == {w.encode(): n for w, n in want.items()}


def test_subwords_of_a_lot_ask_once_for_a_word(monkeypatch):
    coder = lm.SubwordEncoder(lm.Settings().vocabulary)
    texts = odd_texts()
    want = [coder.coder.encode_ordinary(lower(t or "")) for t in texts]
    lot = lm.Lot(pa.array(texts))
    assert [x.tolist() for x in coder.encode(lot)] == want
    known = ["a", "b", "the", "not there"]
    place = np.array([known.index(w) if w in known else -1 for w in lot.distinct.to_pylist()])
    assert [x.tolist() for x in coder.encode(lot, coder.pieces(pa.array(known)), place)] == want
    # Words that come again are not encoded again, nor those that are known.
    asked = []

    class Asked:
        def encode_to_numpy(self, text, real=coder.coder):
            asked.append(text)
            return real.encode_to_numpy(text)

    many = lm.Lot(pa.array(["zebra quilt zebra", "quilt zebra\nquilt the"] * 500))
    pieces = coder.pieces(pa.array(["the"]))
    monkeypatch.setattr(coder, "coder", Asked())
    coder.encode(many, pieces, np.array([0 if w == "the" else -1 for w in many.distinct.to_pylist()]))
    assert sum(map(len, asked)) < 40


def test_subwords_beside_long_white_space():
    coder = lm.SubwordEncoder(lm.Settings().vocabulary)
    rng = np.random.default_rng(3)
    for least in (2, 3):
        for _ in range(300):
            text = "".join(rng.choice(["a", "word", ".", "7", "'s", " ", " ", "\n", "\t", "\r\n", "\xa0", "\u3000", "\x85", "\x1c"], rng.integers(0, 14)))
            assert coder._beside_blanks(text, least).tolist() == coder.coder.encode_ordinary(text), repr(text)
    # More than the tokenizer's own splitting takes.
    blanks = " " * 1_200_000
    texts = ["one" + blanks + "two", "\n" + blanks]
    got = coder.encode(lm.Lot(pa.array(texts)))
    assert got[0].tolist() == [*coder.coder.encode_ordinary("one"), *coder.coder._encode_single_piece(blanks[1:]), *coder.coder.encode_ordinary(" two")]
    assert coder.coder.decode(got[1].tolist()) == texts[1]


def small_lm():
    return lm.Settings(steps=150, sample_windows=2_000, head_words=40)


def test_lm_base_score_and_whole_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    counts, ends = Counter(), 0
    for i, r in rows.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(WORDS.findall(lower(r["text"])))
            ends += 1
    total, distinct = counts.total() + ends, len(counts) + 1
    got = lm.score(docs, small_lm()).collect()
    assert len(got) == len(rows)
    for r in got:
        words = WORDS.findall(lower(rows[r["doc_id"]]["text"]))
        base = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in words) + math.log10((ends + 1) / (total + distinct + 1))
        assert r["base_score"] == pytest.approx(base)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words) + 1, sum(w in counts for w in words) + 1, total)
    held = [r for r in got if r["held_out"]]
    # Better by far than drawing subwords at random among those in use, on texts it has not seen.
    coder, _ = lm.subwords(lm.Settings().vocabulary)
    ids = {r["doc_id"]: coder.encode_ordinary(lower(rows[r["doc_id"]]["text"])) for r in got}
    used = len({x for i in ids.values() for x in i})
    assert sum(r["score"] for r in held) > -0.75 * math.log10(used) * sum(len(ids[r["doc_id"]]) + 1 for r in held)


def test_fast_scorer_equals_the_network(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    s = small_lm()
    rows = lm._prepared(docs, {}, 1, 1, s, "text", "doc_id")
    model = lm.fit(rows, s)
    texts = [np.frombuffer(r["ids"], "<u2").astype(np.int32) for r in rows.limit(9).collect()] + [np.zeros(0, np.int32)]
    want = np.zeros(len(texts))
    for k, t in enumerate(texts):
        stream = np.r_[model.end, t, model.end]
        for _, first, fresh in zip(*lm.windows(np.array([len(t) + 1]), s), strict=True):
            part = stream[first : first + s.window + 1]
            logp = model.network.log_classes(model.network.attend(model.symbol[part[None, :-1]])["g"])
            for i in range(fresh, len(part) - 1):
                want[k] += logp[i, model.kind[part[i + 1]]] / math.log(10) + model.within[model.kind[part[i]], part[i + 1]]
    assert model.score(texts) == pytest.approx(want, rel=1e-4)
    # Every id's probabilities sum to one over the vocabulary.
    logp = model.network.log_classes(model.network.attend(model.symbol[np.array([[model.end]])])["g"])[0] / math.log(10)
    assert (10.0 ** (logp[model.kind] + model.within[model.kind[model.end]])).sum() == pytest.approx(1, abs=1e-3)


def test_lm_learns_from_all_of_every_training_text(spark, monkeypatch):
    """Classes, symbols and weights know what stands only at the end of one long text among many."""
    coder, end = lm.subwords(lm.Settings().vocabulary)
    s = lm.Settings(steps=20, sample_windows=64)
    common = " ".join(["the cat sat on the mat"] * 2_000)
    last = next(k for k in range(40, 60) if zlib.crc32(b"%d" % k) % 7 != 2)
    late = [" zebra quilt", " onyx ferry", " violet harbour"]
    whole = common + "".join(late) * 60
    texts = spark.createDataFrame([(k, common if k % 2 else "a short line") for k in range(40)] + [(last, whole)], "doc_id long, text string")
    rows = lm._prepared(texts, {}, 1, 1, s, "text", "doc_id")
    kept = [r["ids"] for r in rows.where("not held_out").select("ids").collect()]
    assert any(len(raw) == 2 * len(coder.encode_ordinary(whole)) for raw in kept)
    counts, n_windows = lm._id_counts(rows.where("not held_out"), end, False, s)
    want = Counter(i for raw in kept for i in np.frombuffer(raw, "<u2").tolist())
    want[end] = len(kept)
    assert {i: int(n) for i, n in enumerate(counts) if n} == want
    assert n_windows == sum(-(-(len(raw) // 2 + 1) // s.window) for raw in kept)
    model = lm.fit(rows, s)
    for i in set(coder.encode_ordinary("".join(late))):
        assert model.kind[i] != s.classes - 1 and model.symbol[i] >= s.classes
    # Every target reaches the weights, once in all rounds together.
    shares = []
    monkeypatch.setattr(lm, "_round", lambda *args, real=lm._round: shares.append(real(*args)) or shares[-1])
    few = lm.Settings(steps=1, rounds=2, batch=16)
    lm._train(rows.where("not held_out"), model.kind, model.symbol, int(counts.sum()), n_windows, end, False, few)
    assert len(shares) == 2 and all(0 < share < 1 for _, share in shares)
    assert sum(share for _, share in shares) == pytest.approx(1, abs=1e-9)


def test_lm_edges(docs, none):
    got = lm.score(docs, small_lm()).collect()
    assert len(got) == docs.count() and all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (7, 8, 9)} == {1}
    assert lm.score(none, small_lm()).count() == 0


# --- near duplicates ---------------------------------------------------------------------


def brute_print(text, width=3):
    words = WORDS.findall(lower(text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + width]).encode(), 42) for i in range(max(1, len(words) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints, radius=3):
    up = list(range(len(prints)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_simhash_on_documents(docs, none):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        if r["doc_id"] is not None:
            assert int(r["fingerprint"], 16) == brute_print(TEXTS[r["doc_id"]])
    by_id = {r["doc_id"]: r["component_id"] for r in got}
    prints = [brute_print(t) for t in TEXTS]
    assert [by_id[i] for i in range(len(TEXTS))] == brute_groups(prints)
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.drop_near_duplicates(docs)
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == docs.columns
    assert sorted(i for i in ids if i is not None) == sorted(set(brute_groups(prints))) and ids.count(None) <= 1


@pytest.mark.parametrize("tree_nodes", [7, 100_000])
def test_links_join_what_brute_force_joins(spark, tree_nodes):
    rng = np.random.default_rng(5)
    seeds = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    prints = {0}
    for s in seeds.tolist():
        for _ in range(40):
            x = s
            for b in rng.integers(0, 64, rng.integers(0, 7)).tolist():
                x ^= 1 << b
            prints.add(x)
    prints = sorted(prints)
    signed = np.array(prints, dtype=np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp long").repartition(6)
    found = simhash.links(df, tree_nodes=tree_nodes).collect()
    assert len(found) < 4 * len(prints) * (1 if tree_nodes > 7 else 60)
    place = {x: i for i, x in enumerate(signed)}
    up = list(range(len(signed)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for r in found:
        assert (prints[place[r["a"]]] ^ prints[place[r["b"]]]).bit_count() <= 64
        a, b = find(place[r["a"]]), find(place[r["b"]])
        up[max(a, b)] = min(a, b)
    assert [find(i) for i in range(len(signed))] == brute_groups(prints)


def test_bk_forest_finds_all_within(spark):
    rng = np.random.default_rng(9)
    fps = rng.integers(0, 1 << 12, 300, dtype=np.uint64)
    group = np.sort(rng.integers(0, 4, 300))
    key = sorted(set(zip(group.tolist(), fps.tolist(), strict=True)))
    group, fps = np.array([k[0] for k in key]), np.array([k[1] for k in key], dtype=np.uint64)
    forest = simhash.BkForest(fps, group)
    got = {(int(q), int(n)) for a, b in forest.within(fps, group, 3) for q, n in zip(a, b, strict=True)}
    want = {(i, j) for i in range(len(fps)) for j in range(len(fps)) if group[i] == group[j] and int(fps[i] ^ fps[j]).bit_count() <= 3}
    assert got == want


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(8, 60)] + [(3, 3), (None, 5), (200, 201), (201, 200)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {k: 100 for k in range(100, 161)} | {k: 7 for k in range(7, 60)} | {200: 200, 201: 200}
    assert components.connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


# --- mixing ------------------------------------------------------------------------------


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    whole, full = sum(sizes.values()), set()
    while True:
        rest = whole - sum(most * sizes[s] for s in full)
        free = sum(w for s, w in weight.items() if s not in full)
        share = {s: most * sizes[s] if s in full else weight[s] * rest / free for s in names}
        over = {s for s in names if s not in full and share[s] > most * sizes[s]}
        if not over:
            return share
        full |= over


def test_mixing_targets_and_limits(spark, docs, none):
    rows = mixing.copies(docs).collect()
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows:
        source = r["_row"]["source"]
        text = TEXTS[r["_row"]["doc_id"]] if r["_row"]["doc_id"] is not None else "text without an id"
        assert r["size"] == len(WORDS.findall(text or "")) and 0 <= r["copies"] <= 3
        sizes[source] += r["size"]
        taken[source] += r["size"] * r["copies"]
        target[source] = r["target"]
    assert len(rows) == docs.count()
    want = brute_targets(sizes)
    assert {s: pytest.approx(t) for s, t in target.items()} == want
    assert mixing.copies(none).count() == 0
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r["copies"] for r in rows)


def test_mixing_comes_near_its_targets_and_repeats_itself(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.copies(docs).collect()
    again = mixing.copies(docs.repartition(7)).collect()
    key = lambda rs: sorted((r["_row"]["doc_id"], r["copies"]) for r in rs)
    assert key(rows) == key(again)
    taken, target, most = Counter(), {}, Counter()
    for r in rows:
        s = r["_row"]["source"]
        taken[s] += r["size"] * r["copies"]
        target[s] = r["target"]
        most[s] = max(most[s], r["size"])
    assert all(abs(taken[s] - target[s]) <= most[s] for s in target)


def test_mixing_spreads_small_chances_over_bins(spark, monkeypatch):
    docs = spark.range(6000).selectExpr("id as doc_id", "repeat('w ', 10) as text", "if(id < 3000, 's', 't') as source")
    monkeypatch.setattr(mixing, "_cut", lambda ranked: ranked)
    ranked = mixing.copies(docs.union(docs.selectExpr("doc_id + 6000", "text", "'t'")), weights=(1, 10**7), most=9).where("source = 's'")
    got = ranked.select("bin", "rank", "certain").collect()
    assert {r["certain"] for r in got} == {0} and len({r["bin"] for r in got}) > 1500
    u = ranked.select(mixing.uniform("mix-1", F.col("key")).alias("u"), "rank").collect()
    assert all(r["rank"] == pytest.approx(r["u"], rel=1e-6) for r in u)


def test_mixing_by_importance(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "s" if i < 400 else "t", float(1 + i % 4)) for i in range(800)], "doc_id long, text string, source string, worth double")
    rows = mixing.copies(docs, importance="worth", weights=(1, 1)).collect()
    mean = defaultdict(list)
    for r in rows:
        mean[r["_row"]["worth"]].append(r["copies"])
    means = [float(np.mean(mean[w])) for w in sorted(mean)]
    assert means == sorted(means) and means[0] == pytest.approx(0.4, abs=0.12) and means[-1] == pytest.approx(1.6, abs=0.12)


# --- URLs --------------------------------------------------------------------------------


def canonical(url):
    return f"<html><head><link href='{url}' rel=\"canonical\"></head></html>"


def test_urls_and_aliases(spark):
    pages = [
        (1, "HTTP://WWW.Example.COM/en/a?x#y", None),
        (2, "https://m.example.com/en/a", "<p>"),
        (3, "http://shop.org/x", canonical("http://cdn.org/x")),  # alias of 4
        (4, "http://cdn.org/x?q", '<meta http-equiv="refresh" content="0; url=http://m.example.com/en/a">'),
        (5, "http://free.com/x", canonical("http://cdn.org/x")),  # its own rule allows it
        (6, "http://other.org/y", canonical("/z")),
        (7, "http://x.net/es/1", ""),
        (8, "no address", canonical("http://cdn.org/x")),
        (9, None, None),
        (10, "http://xexample.com/en/", None),
        (11, "http://a.net/es", None),
        (12, "http://log.org/q", None),
        (2, "https://m.example.com/en/a", "<p>"),
    ]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, host string")
    log = spark.createDataFrame([("http://log.org/q", "https://x.net/es/1#z"), (None, "http://b.org")], "a string, b string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(df, edges=log).collect()}
    assert urls.judge(df).count() == len(pages)
    assert got == {
        1: ("www.example.com", "/en/a", "www.example.com/en/", "allow"),
        2: ("m.example.com", "/en/a", "example.com/en/", "block"),
        3: ("shop.org", "/x", None, "block"),
        4: ("cdn.org", "/x", None, "block"),
        5: ("free.com", "/x", "com/", "allow"),
        6: ("other.org", "/y", None, "allow"),
        7: ("x.net", "/es/1", "net/es/", "block"),
        8: ("", "", None, "allow"),
        9: ("", "", None, "allow"),
        10: ("xexample.com", "/en/", "com/", "allow"),
        11: ("a.net", "/es", None, "allow"),
        12: ("log.org", "/q", None, "block"),
    }
    assert urls.judge(df.limit(0)).count() == 0
    assert urls.judge(df, keep=("page_id", "host")).columns == ["page_id", "row_host", "host", "path", "rule", "verdict"]


LINKS = [
    "page.html", "../x", "./a", "..", ".", "../../../../up", "a/./b/../c", "?q=1", "#part", "/", "/root/../r", "//other.org/z", "//other.org",
    "http://full.org/a/b", "HTTPS://full.org", "/out?u=http://m.example.com/en/a", "out?u=http://m.example.com/en/a", "a/b/", "../", "x#http://y.org/",
]


def test_links_are_resolved_as_the_standard_says(spark):
    from urllib.parse import urljoin, urlsplit

    bases = ["http://a.org/d/e/f.html?q#z", "http://a.org/d/e/", "https://a.org", "http://a.org/?x=/y/z"]
    df = spark.createDataFrame([(b, x) for b in bases for x in LINKS], "base string, link string")
    rows = df.select("base", "link", urls.node_of(urls.absolute(F.col("link"), F.col("base"))).alias("node")).collect()
    for r in rows:
        want = urlsplit(urljoin(r["base"], r["link"]))
        assert r["node"] == want.netloc.lower() + (want.path or "/"), r
    others = [("mailto:a@b.org", bases[0], None), ("a", "no address", None), ("http://full.org/a/../b?c", bases[0], "http://full.org/b?c")]
    got = df.limit(1).select(*(urls.absolute(F.lit(x), F.lit(b)).alias(str(k)) for k, (x, b, _) in enumerate(others))).first()
    assert list(got) == [want for _, _, want in others]


def test_relative_links_and_site_roots_carry_a_block(spark):
    pages = [
        (1, "http://one.org/d/a", canonical("../b")),
        (2, "http://one.org/b", '<meta http-equiv="refresh" content="0; url=http://x.net/es/1">'),
        (3, "http://two.org/c", canonical("/out?u=http://m.example.com/en/a")),
        (4, "http://three.org", canonical("http://x.net/fr/1")),
        (5, "http://four.org/q", canonical("http://three.org/")),
        (6, "http://m.example.com/en/a", ""),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in urls.judge(df).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "block", 5: "block", 6: "block"}


def test_a_query_parts_pages_of_one_path(spark, tmp_path):
    from claimscope.llm import queries

    pages = [
        (1, "http://q.org/index.php?p=1", canonical("http://x.net/es/1?from=q")),
        (2, "https://q.org/index.php?p=1#top", ""),
        (3, "http://q.org/index.php?p=2", ""),
        (4, "http://q.org/index.php", ""),
        (5, "http://r.org/z", canonical("http://q.org/index.php?p=3&amp;s=4")),
        (6, "http://q.org/index.php?p=3&s=4", canonical("http://x.net/fr/")),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    df.write.parquet(str(tmp_path / "pages.parquet"))
    got = {r["page_id"]: r["verdict"] for r in queries.op9_url_filters(spark, str(tmp_path)).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "block", 6: "block"}


# --- fingerprints ------------------------------------------------------------------------


def brute_print_tree(text):
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    sections, pars = [], [[hashlib.md5(p.encode()).hexdigest() for p in re.findall(r"[^\n]{1,32}\n?|\n", par)] for par in re.findall(r"[^\n]+\n?|\n", text)]
    for k in range(0, len(pars), 16):
        some = pars[k : k + 16]
        sections.append((digest("".join(digest("".join(x)) for x in some)), "/".join("".join(h[:8] for h in x) for x in some)))
    return ":".join([digest("".join(h for h, _ in sections)), *(f"{h[:16]}/{t}" for h, t in sections)])


def test_fingerprints(spark, none):
    texts = [t for t in TEXTS if t is not None] + ["\n".join(f"paragraph {k}" for k in range(40))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in merkle.edit_report(df).collect()}
    for i, t in enumerate(texts):
        follower = texts[(i + 1) % len(texts)]
        changed = t[: len(t) - len(t) // 4] + follower[: len(t) // 4]
        r = rows[i]
        assert r["n_chars"] == len(t)
        assert r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert r["fingerprint"] == brute_print_tree(t) and r["edited_fingerprint"] == brute_print_tree(changed)
        assert 0 <= r["near_edited"] <= 1 and (r["near_next"] == 1) == (t == follower)
        lines = [re.findall(r"[^\n]+\n?|\n", x) for x in (t, changed)]
        places = [(k // 16, k % 16) for k, (a, b) in enumerate(zip_longest(*lines)) if a != b]
        assert [tuple(x) for x in r["edits"]] == places
    assert merkle.edit_report(none).count() == 0


def test_next_row_over_many_ranges(spark):
    ids = [None, -5, 0, 3, 3, 10, 11, 500, 501, 502, 10_000, 10**12]
    df = spark.createDataFrame([(i, f"t{k:02d}") for k, i in enumerate(ids)], "doc_id long, text string").repartition(5)
    rows = merkle.with_next(df, "doc_id", "text", bucket_rows=2).collect()
    follows = {r["text"]: r["next_text"] for r in rows}
    assert follows == {f"t{k:02d}": f"t{(k + 1) % len(ids):02d}" for k in range(len(ids))}


def test_edits_are_located(spark):
    old = [f"paragraph {k}" for k in range(40)]
    new = old[:20] + ["changed"] + old[21:] + ["added"]
    df = spark.createDataFrame([("\n".join(old), "\n".join(new))], "a string, b string")
    a, b = merkle.fingerprint(F.col("a")), merkle.fingerprint(F.col("b"))
    row = df.select(merkle.edits(a, b).alias("e"), merkle.edits(a, a).alias("same"), merkle.likeness(a, b).alias("near")).first()
    assert [tuple(x) for x in row["e"]] == [(1, 4), (2, 7), (2, 8)]  # the last old line gained its line end
    assert row["same"] == [] and 0.9 < row["near"] < 1

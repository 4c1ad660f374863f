"""Language-model scores: a causal self-attention model over subword ids, and a word base score.

The model predicts the class of the next subword with one layer of masked self-attention, and
the subword within its class from counts over the whole training corpus:

    P(id | before) = P(class of id | up to ``window`` ids before) * P(id | class, class before)

The attention weights are trained with numpy on every window of every training document: each
task trains on its own, and the weights of all tasks are averaged after each round. Classes,
input symbols, the counts of the output layer and of the base score come from sums over all
training documents.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimscope.llm.common import gathered, id_residue, keep_freed_memory, map_arrow, shared_table
from claimscope.llm.tokens import strings

FOLDS, HELD_OUT = 7, 2
FLUSH_WORDS = 500_000
LOT_BYTES = 1 << 20
LONG_BLANK = 100_000
# Fixed value: what the tokenizer takes as white space, as a regular expression.
BLANK = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
# For tables of values that hardly come again: no dictionary is tried.
PLAIN = {"parquet.enable.dictionary": "false"}
BLOCK_WINDOWS = 128  # what a core's cache holds
LEAST_SUM, MOST_SUM = 1e-34, 1e13  # of attention weights before they are shares: exp takes such logits as they are


@dataclass(frozen=True)
class Settings:
    """``sample_windows`` is how many windows a task holds to shuffle them while it trains,
    ``steps`` of ``batch`` windows the least that training does, however small the corpus is;
    neither bounds what is trained on. ``head_words`` bounds the words whose counts are
    broadcast; the counts of all other words are joined."""

    vocabulary: str = "byte_bpe_multi_50k.tiktoken"
    window: int = 32
    stride: int = 24
    width: int = 16
    hidden: int = 24
    classes: int = 64
    own_classes: int = 24
    symbols: int = 1_024
    heads: int = 256
    sample_windows: int = 8_000
    steps: int = 600
    rounds: int = 4
    batch: int = 64
    rate: float = 0.01
    back_off: float = 20.0
    head_words: int = 200_000
    seed: int = 11


@lru_cache(maxsize=2)
def subwords(name: str):
    """A tiktoken encoding; its first free id ends a text and stands before its first id."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(name), "rb") as lines:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), len(ranks)


# --- words and subword ids ----------------------------------------------------------------


class Lot:
    """Words of some texts, A-Z in lower case: each different one once, and which stand where."""

    def __init__(self, texts: pa.Array):
        self.texts = pc.fill_null(pc.ascii_lower(texts), "")
        split = pc.ascii_split_whitespace(self.texts)
        coded = split.flatten().dictionary_encode()
        code, count = coded.indices.to_numpy(), np.diff(split.offsets.to_numpy())
        self.distinct = coded.dictionary
        none = pc.index(self.distinct, "").as_py()  # what stands before or after a text's outer white space
        if none >= 0:
            kept = code != none
            count = np.bincount(np.repeat(np.arange(len(count)), count)[kept], minlength=len(count))
            code = code[kept]
        self.code, self.count = code, count

    def text_of(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.count)), self.count)

    def counts(self) -> pa.Table:
        n = np.bincount(self.code, minlength=len(self.distinct))
        return pa.table({"word": self.distinct.cast(pa.binary()), "n": n}).filter(pa.array(n > 0))


@dataclass(frozen=True)
class Pieces:
    """Ids of pieces laid end to end, where those of each one end, and how many they are."""

    ids: np.ndarray
    ends: np.ndarray
    size: np.ndarray


class SubwordEncoder:
    """Ids of a lot's texts, each different word encoded once; the same as ``encode_ordinary`` gives.

    The tokenizer's splitting never joins a visible character to white space that follows it. So
    a text whose words are parted by one blank or line end each is a run of pieces, and all
    different pieces are encoded in one call. Other texts are encoded whole.
    """

    def __init__(self, name: str):
        self.coder, self.end = subwords(name)
        self.size = np.array([len(self.coder.decode_single_token_bytes(k)) for k in range(self.end)])

    def encode(self, lot: Lot, known: Pieces | None = None, place: np.ndarray | None = None) -> list[np.ndarray]:
        """Ids of each text; those of different word k after a blank are ``known`` where ``place[k]`` is not -1."""
        texts = strings(lot.texts)
        apart = np.array([self._apart(t) for t in texts], dtype=bool)
        known = known or self.pieces(lot.distinct[:0])
        by_piece = iter(self._by_piece(lot, apart, known, np.full(len(lot.distinct), -1) if place is None else place) if apart.any() else ())
        return [next(by_piece) if ok else self._whole(t) for t, ok in zip(texts, apart, strict=True)]

    def _whole(self, text: str) -> np.ndarray:
        """Ids of a text by the tokenizer itself, whose splitting fails on a million white-space characters in a row."""
        try:
            return self.coder.encode_to_numpy(text)
        except ValueError:
            return self._beside_blanks(text, LONG_BLANK)

    def _beside_blanks(self, text: str, least: int) -> np.ndarray:
        """The same, with runs of ``least`` white-space characters or more taken as the single pieces that they are.

        The last character of a run goes with what follows, unless it ends the text.
        """
        parts, at = [], 0
        for run in re.finditer(f"{BLANK}{{{least},}}", text):
            end = run.end() - (run.end() < len(text))
            parts += [self.coder.encode_to_numpy(text[at : run.start()]), np.array(self.coder._encode_single_piece(text[run.start() : end]), dtype=np.uint32)]
            at = end
        return np.concatenate([*parts, self.coder.encode_to_numpy(text[at:])])

    @staticmethod
    def _apart(text: str) -> bool:
        """Whether its words are parted by one blank or line end each, and nothing else is white space."""
        if not text.replace("\n", "").isprintable() or not text or text[0] in " \n" or text[-1] in " \n":
            return False
        return not ("  " in text or "\n\n" in text or " \n" in text or "\n " in text)

    def _by_piece(self, lot: Lot, apart: np.ndarray, known: Pieces, place: np.ndarray) -> list[np.ndarray]:
        texts, code, count = lot.texts, lot.code, lot.count
        if not apart.all():
            texts, code, count = texts.filter(pa.array(apart)), code[np.repeat(apart, count)], count[apart]
        held = np.frombuffer(texts.buffers()[2], dtype=np.uint8)
        ends = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset :]
        held = held[ends[0] : ends[len(texts)]]
        first = np.cumsum(count) - count
        bare = np.ones(len(code), dtype=bool)  # after a line end, or first in its text
        later = np.ones(len(code), dtype=bool)
        later[first] = False
        bare[later] = held[(held == 0x20) | (held == 0x0A)] == 0x0A
        # Pieces are known ones, then other words after a blank, then words after a line end.
        size = len(lot.distinct)
        used = np.bincount(code + np.where(bare, size, 0), minlength=2 * size).reshape(2, size) > 0
        used[0] &= place < 0
        new, lines = (self.pieces(lot.distinct.filter(pa.array(some)), sign) for some, sign in zip(used, " \n", strict=True))
        flat = np.concatenate([known.ids, new.ids, lines.ids])
        begins = np.concatenate([known.ends - known.size, new.ends - new.size + len(known.ids), lines.ends - lines.size + len(known.ids) + len(new.ids)])
        sizes = np.concatenate([known.size, new.size, lines.size])
        after_blank = np.where(place < 0, np.cumsum(used[0]) - 1 + len(known.size), place)
        after_line = np.cumsum(used[1]) - 1 + len(known.size) + len(new.size)
        piece = np.where(bare, after_line[code], after_blank[code])
        begin, length = begins[piece], sizes[piece]
        begin[first] += 1  # without the line end
        length[first] -= 1
        ends = np.cumsum(length)
        kind = np.int32 if ends[-1] < 1 << 31 else np.int64
        at = np.repeat((begin - ends + length).astype(kind), length)
        at += np.arange(len(at), dtype=kind)
        return np.split(flat[at], ends[first[1:] - 1])

    def pieces(self, words: pa.Array, sign: str = " ") -> Pieces:
        """Ids of each word after ``sign``."""
        if not len(words):
            return Pieces(np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64))
        ids = self._whole(sign + sign.join(strings(words)))
        ends = np.cumsum(pc.binary_length(words).to_numpy().astype(np.int64) + 1)
        ends = np.searchsorted(np.cumsum(self.size[ids]), ends) + 1
        return Pieces(ids, ends, np.diff(ends, prepend=0))


@lru_cache(maxsize=2)
def subword_encoder(name: str) -> SubwordEncoder:
    """One encoder per Python worker and vocabulary."""
    return SubwordEncoder(name)


# --- the attention model ------------------------------------------------------------------


@dataclass
class Network:
    """One layer of causal self-attention over symbol embeddings, then a hidden layer."""

    embed: np.ndarray
    place: np.ndarray
    query: np.ndarray
    key: np.ndarray
    value: np.ndarray
    out: np.ndarray
    inner: np.ndarray
    inner_bias: np.ndarray
    top: np.ndarray
    top_bias: np.ndarray

    @staticmethod
    def start(symbols: int, s: Settings) -> Network:
        rng = np.random.default_rng(s.seed)
        w = lambda *shape: (rng.standard_normal(shape) / math.sqrt(shape[0])).astype(np.float32)
        d, h, c = s.width, s.hidden, s.classes
        small = lambda *shape: (0.5 * rng.standard_normal(shape)).astype(np.float32)
        return Network(small(symbols, d), small(s.window, d), w(d, d), w(d, d), w(d, d), w(d, d), w(d, h), np.zeros(h, np.float32), w(h, c), np.zeros(c, np.float32))

    def flat(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in vars(self).values()])

    def like(self, flat: np.ndarray) -> Network:
        """A network of the same shapes whose arrays lie in ``flat``."""
        ends = np.cumsum([a.size for a in vars(self).values()])
        return Network(**{k: flat[e - a.size : e].reshape(a.shape) for (k, a), e in zip(vars(self).items(), ends, strict=True)})

    def attend(self, symbols: np.ndarray) -> dict[str, np.ndarray]:
        """Forward pass over (batch, time) input symbols; keeps what the gradient needs."""
        n, t = symbols.shape
        d = self.query.shape[1]
        x = self.embed.take(symbols, axis=0)
        x += self.place[:t]
        # One product for queries (scaled), keys and values.
        into = np.concatenate([self.query * np.float32(1 / math.sqrt(d)), self.key, self.value], axis=1)
        joined = (x.reshape(n * t, -1) @ into).reshape(n, t, 3 * d)
        q, k, v = joined[:, :, :d], joined[:, :, d : 2 * d], joined[:, :, 2 * d :]
        weight = np.matmul(q, k.transpose(0, 2, 1))
        np.minimum(weight, 30, out=weight)
        np.exp(weight, out=weight)
        weight *= _causal(t)  # a position sees itself and what is before
        sums = np.matmul(weight, _ones(t))
        off = _off(sums)
        if off is not None:
            weight[off] = _shares(q, k, 0)[off]
            sums[off] = weight[off].sum(axis=1)
        weight /= sums[:, :, None]
        mixed = np.matmul(weight, v)
        h = x + (mixed.reshape(n * t, d) @ self.out).reshape(x.shape)
        z = h.reshape(n * t, -1) @ self.inner
        z += self.inner_bias
        return {"x": x, "into": into, "q": q, "k": k, "v": v, "weight": weight, "mixed": mixed, "h": h, "g": np.tanh(z, out=z)}

    def log_classes(self, g: np.ndarray) -> np.ndarray:
        """Natural log-probabilities of the classes from hidden rows."""
        logits = g @ self.top + self.top_bias
        logits -= logits.max(axis=1, keepdims=True)
        return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))

    def steep(self) -> bool:
        """Whether logits may pass what exp takes: hidden values lie in -1 to 1, which bounds them."""
        return float((np.abs(self.top).sum(axis=0) + np.abs(self.top_bias)).max()) > 60

    def gradients(self, symbols: np.ndarray, goal: np.ndarray, mask: np.ndarray, with_loss: bool = True) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over the masked targets (0 unless asked for) and its gradient for every array."""
        f = self.attend(symbols)
        n, t = symbols.shape
        d = self.query.shape[1]
        at, weight = np.arange(n * t) * len(self.top_bias) + goal.reshape(-1), mask.reshape(-1).astype(np.float32)
        total = max(float(weight.sum()), 1.0)
        dl = f["g"] @ self.top
        dl += self.top_bias
        if self.steep():
            dl -= dl.max(axis=1, keepdims=True)
        np.exp(dl, out=dl)
        sums = dl @ _ones(dl.shape[1])
        loss = 0.0
        if with_loss:
            loss = -float((np.log(np.maximum(dl.ravel()[at] / sums, 1e-30)) * weight).sum()) / total
        share = weight / np.float32(total)
        dl *= (share / sums)[:, None]
        dl.ravel()[at] -= share
        dz = dl @ self.top.T
        top, top_bias = f["g"].T @ dl, _ones(n * t) @ dl
        del dl  # what follows then takes memory that is still in the core's cache
        slope = f["g"] * f.pop("g")
        np.subtract(1, slope, out=slope)
        dz *= slope
        flat = lambda a: a.reshape(n * t, -1)
        dh = dz @ self.inner.T
        inner, inner_bias = flat(f.pop("h")).T @ dz, _ones(n * t) @ dz
        del slope, dz
        dmixed, out = (dh @ self.out.T).reshape(n, t, d), flat(f["mixed"]).T @ dh
        # The gradient through the attention weights: the mean over a row is a product of short rows.
        ds = np.matmul(dmixed, f["v"].transpose(0, 2, 1))
        ds -= ((dmixed * f.pop("mixed")).reshape(n * t, d) @ _ones(d)).reshape(n, t, 1)
        ds *= f["weight"]
        back = np.empty((n, t, 3 * d), dtype=np.float32)
        np.matmul(ds, f["k"], out=back[:, :, :d])
        np.matmul(ds.transpose(0, 2, 1), f["q"], out=back[:, :, d : 2 * d])
        np.matmul(f.pop("weight").transpose(0, 2, 1), dmixed, out=back[:, :, 2 * d :])
        del ds
        back = flat(back)
        dx = back @ f["into"].T
        dx += dh
        x = flat(f["x"])
        into = x.T @ back
        into[:, :d] *= np.float32(1 / math.sqrt(d))
        del back
        cell = _cells(*self.embed.shape).take(symbols, axis=0)
        embed = np.bincount(cell.ravel(), weights=dx.ravel(), minlength=self.embed.size).reshape(self.embed.shape).astype(self.embed.dtype)
        place = np.zeros_like(self.place)
        place[:t] = dx.reshape(n, t, -1).sum(axis=0)
        return loss, {
            "embed": embed, "place": place, "query": into[:, :d], "key": into[:, d : 2 * d], "value": into[:, 2 * d :],
            "out": out, "inner": inner, "inner_bias": inner_bias, "top": top, "top_bias": top_bias,
        }


@lru_cache(maxsize=64)
def _ones(size: int) -> np.ndarray:
    """Sums by a product are far faster over short rows."""
    return np.ones(size, dtype=np.float32)


@lru_cache(maxsize=4)
def _cells(rows: int, width: int) -> np.ndarray:
    """Numbers of the cells of a table, row by row."""
    return np.arange(rows * width).reshape(rows, width)


@lru_cache(maxsize=64)
def _causal(t: int) -> np.ndarray:
    return np.tri(t, dtype=np.float32)


def _off(sums: np.ndarray) -> np.ndarray | None:
    """Which sums of attention weights are out of range, if any: of logits that are cut off or underflow."""
    if sums.min() >= LEAST_SUM and sums.max() <= MOST_SUM:
        return None
    return (sums < LEAST_SUM) | (sums > MOST_SUM)


def _shares(q: np.ndarray, k: np.ndarray, first: int) -> np.ndarray:
    """Attention weights of the positions from ``first`` on, their largest in a row 1: exact for any logits."""
    n, t, _ = k.shape
    logits = np.matmul(q, k.transpose(0, 2, 1))
    logits[:, _causal(t)[first:] == 0] = -np.inf
    logits -= logits.max(axis=2, keepdims=True)
    return np.exp(logits, out=logits)


class Trainer:
    """Adam on a copy of a network: windows of symbols, classes as goals, and where there is a goal."""

    def __init__(self, net: Network, s: Settings, rate: float, seed: int):
        self.settings, self.rate, self.step = s, rate, 0
        self.flat = net.flat()
        self.net = net.like(self.flat)
        self.first, self.second, self.scratch = (np.zeros_like(self.flat) for _ in range(3))
        self.rng = np.random.default_rng(seed)

    def learn(self, inputs: np.ndarray, goals: np.ndarray, mask: np.ndarray) -> None:
        """Every window once, in a random order."""
        order = self.rng.permutation(len(inputs))
        for k in range(0, len(order), self.settings.batch):
            some = order[k : k + self.settings.batch]
            _, grads = self.net.gradients(inputs[some], goals[some], mask[some], with_loss=False)
            g = np.concatenate([grads[name].ravel() for name in vars(self.net)])
            self.step += 1
            # first += 0.1 (g - first), second += 0.02 (g g - second), each in place.
            self.first *= np.float32(0.9)
            self.first += np.multiply(g, np.float32(0.1), out=self.scratch)
            np.multiply(g, g, out=g)
            g *= np.float32(0.02)
            self.second *= np.float32(0.98)
            self.second += g
            rate = self.rate * min(1.0, self.step / 50) / (1 - 0.9**self.step)
            np.sqrt(np.multiply(self.second, np.float32(1 / (1 - 0.98**self.step)), out=self.scratch), out=self.scratch)
            self.scratch += np.float32(1e-8)
            np.divide(self.first, self.scratch, out=self.scratch)
            self.scratch *= np.float32(rate)
            self.flat -= self.scratch


# --- windows ------------------------------------------------------------------------------


def windows(lengths: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts of so many targets: text, first position and first scored place of each window.

    Windows start every ``stride`` positions and are ``window`` long. A later window scores
    only the targets that the one before did not reach, so each target is scored once, with
    at least ``window - stride`` positions before it unless the text starts there.
    """
    more = np.maximum(0, -(-(lengths - s.window) // s.stride))
    count = (more + 1) * (lengths > 0)
    text = np.repeat(np.arange(len(lengths)), count)
    k = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    return text, k * s.stride, np.where(k > 0, s.window - s.stride, 0)


def _laid_out(texts: list[np.ndarray], end: int, s: Settings) -> Iterator[tuple[np.ndarray, ...]]:
    """Blocks of windows over texts: text, inputs, goals, mask, each (windows, window)."""
    lengths = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    stop, after = np.array([end], dtype=np.int32), np.full(s.window, end, dtype=np.int32)
    stream = np.concatenate([*(part for t in texts for part in (stop, t, stop)), after]).astype(np.int32, copy=False)
    # What a window holds beyond its text is masked, and no position looks ahead.
    spans = np.lib.stride_tricks.sliding_window_view(stream, s.window + 1)
    origin = np.cumsum(lengths + 1) - (lengths + 1)
    text, first, fresh = windows(lengths, s)
    # First windows of texts, then later ones, so that those of a block are scored from one place on.
    order = np.argsort(fresh, kind="stable")
    text, first, fresh = text[order], first[order], fresh[order]
    step = np.arange(s.window)
    for k in range(0, len(text), BLOCK_WINDOWS):
        w = slice(k, k + BLOCK_WINDOWS)
        span = spans[origin[text[w]] + first[w]]
        mask = step < (lengths[text[w]] - first[w])[:, None]
        mask &= step >= fresh[w, None]
        yield text[w], span[:, :-1], span[:, 1:], mask


# --- the fitted model ---------------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    """``symbol`` and ``kind`` hold each id's input symbol and class; ``within[p, id]`` is the
    base-10 log-probability of an id in its class after an id of class p."""

    settings: Settings
    end: int
    kind: np.ndarray
    symbol: np.ndarray
    network: Network
    within: np.ndarray

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """log10 probability of each text of ids, its end included."""
        sums = np.zeros(len(texts))
        scorer, size = self.scorer, len(self.kind)
        for text, inputs, goals, mask in _laid_out(texts, self.end, self.settings):
            # Windows of a block ask from one place on, and none of them beyond the longest.
            asked = np.flatnonzero(mask.any(axis=0))
            ask, t = int(asked[0]), int(asked[-1]) + 1
            inputs, goal, mask = inputs[:, :t], goals[:, ask:t], mask[:, ask:t]
            got = scorer.log10_classes(self.symbol.take(inputs), ask, self.kind.take(goal))
            got += self.within.take(self.kind.take(inputs[:, ask:]) * np.int64(size) + goal)
            got *= mask
            sums += np.bincount(text, weights=got.sum(axis=1), minlength=len(texts))
        return sums

    @cached_property
    def scorer(self) -> Scorer:
        return Scorer(self.network)


class Scorer:
    """The network's forward pass with all products of embeddings and weights made beforehand.

    A position's query, key, value and share of the hidden layer are sums of a row that its
    symbol gives and one that its place gives.
    """

    def __init__(self, net: Network):
        d = net.query.shape[1]
        self.by_symbol = [net.embed @ w for w in (net.query / math.sqrt(d), net.key, net.value, net.inner)]
        self.by_place = [net.place @ w for w in (net.query / math.sqrt(d), net.key, net.value, net.inner)]
        self.by_place[3] = self.by_place[3] + net.inner_bias
        self.by_symbol, self.by_place = ([np.ascontiguousarray(t, dtype=np.float32) for t in x] for x in (self.by_symbol, self.by_place))
        # A column of ones sums the attention weights in the product that mixes the values.
        self.by_symbol[2] = np.pad(self.by_symbol[2], ((0, 0), (0, 1)))
        self.by_place[2] = np.pad(self.by_place[2], ((0, 0), (0, 1)), constant_values=1)
        self.mixed_to_hidden = (net.out @ net.inner).astype(np.float32)
        self.top, self.top_bias = net.top, net.top_bias
        self.steep = net.steep()
        self.causal = np.tri(len(net.place), dtype=np.float32)

    def _rows(self, part: int, symbols: np.ndarray, first: int) -> np.ndarray:
        rows = self.by_symbol[part].take(symbols, axis=0)
        rows += self.by_place[part][first : first + symbols.shape[1]]
        return rows

    def log10_classes(self, symbols: np.ndarray, ask: int, goal: np.ndarray) -> np.ndarray:
        """Base-10 log-probability of each window's goal classes, those after the positions from ``ask`` on.

        Positions before are only looked back at.
        """
        n, t = symbols.shape
        q = self._rows(0, symbols[:, ask:], ask)
        k, v = (self._rows(i, symbols, 0) for i in (1, 2))
        weight = np.matmul(q, k.transpose(0, 2, 1))
        np.minimum(weight, 30, out=weight)
        np.exp(weight, out=weight)
        weight *= self.causal[ask:t, :t]
        mixed = np.matmul(weight, v)
        off = _off(mixed[:, :, -1])
        if off is not None:
            weight[off] = _shares(q, k, ask)[off]
            mixed = np.matmul(weight, v)
        mixed = mixed.reshape(n * (t - ask), -1)
        mixed = mixed[:, :-1] / mixed[:, -1:]
        hidden = self._rows(3, symbols[:, ask:], ask).reshape(n * (t - ask), -1)
        hidden += mixed @ self.mixed_to_hidden
        np.tanh(hidden, out=hidden)
        logits = hidden @ self.top
        logits += self.top_bias
        if self.steep:
            logits -= logits.max(axis=1, keepdims=True)
        chosen = logits.ravel().take(np.arange(0, logits.size, logits.shape[1]) + goal.ravel())
        np.exp(logits, out=logits)
        chosen -= np.log(logits @ _ones(logits.shape[1]))
        return chosen.astype(np.float64).reshape(n, t - ask) / math.log(10)


def _by_count(counts: np.ndarray) -> np.ndarray:
    """Ids that occur, the most frequent first."""
    return np.lexsort((np.arange(len(counts)), -counts))[: np.count_nonzero(counts)]


def classify(counts: np.ndarray, pairs: tuple[np.ndarray, np.ndarray, np.ndarray], s: Settings) -> np.ndarray:
    """A class for each id: the most frequent have their own, others are grouped by what precedes them.

    ``counts`` says how often each id occurs, ``pairs`` (place of the id before among the
    ``heads`` most frequent, id, how often) what precedes it. Ids that no training text has
    share the last class.
    """
    size = len(counts)
    kind = np.full(size, s.classes - 1, dtype=np.uint8)
    order = _by_count(counts)
    own = order[: s.own_classes]
    kind[own] = np.arange(len(own))
    rest = order[s.own_classes :]
    groups = s.classes - 1 - s.own_classes
    if not len(rest):
        return kind
    row = np.full(size, -1)
    row[rest] = np.arange(len(rest))
    before, at, n = pairs
    ok = row[at] >= 0
    table = np.zeros((len(rest), s.heads), dtype=np.float32)
    table[row[at[ok]], before[ok]] = n[ok]
    np.sqrt(table, out=table)
    table /= np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-6)
    _, vectors = np.linalg.eigh(table.T @ table)
    points = table @ vectors[:, -12:]
    centres = points[np.linspace(0, len(points) - 1, min(groups, len(points))).astype(int)]
    for _ in range(12):
        near = (points @ centres.T - 0.5 * (centres**2).sum(axis=1)).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        n = np.bincount(near, minlength=len(centres))[:, None]
        centres = np.where(n > 0, sums / np.maximum(n, 1), centres)
    kind[rest] = s.own_classes + near
    return kind


def _symbols(counts: np.ndarray, kind: np.ndarray, s: Settings) -> np.ndarray:
    """Input symbol of each id: the most frequent have their own, all others their class."""
    symbol = kind.astype(np.int32)
    often = _by_count(counts)[: s.symbols]
    symbol[often] = s.classes + np.arange(len(often))
    return symbol


def _within(kind: np.ndarray, pairs: tuple[np.ndarray, np.ndarray, np.ndarray], s: Settings) -> np.ndarray:
    """log10 P(id | its class, class before) from corpus counts of (class before, id).

    Backs off to P(id | class), in which every id counts once more than it was seen.
    """
    size = len(kind)
    table = np.zeros((s.classes, size), dtype=np.float64)
    table[pairs[0], pairs[1]] = pairs[2]
    single = table.sum(axis=0) + 1
    of_class = np.bincount(kind, weights=single, minlength=s.classes)
    base = single / of_class[kind]
    for p in range(s.classes):
        whole = np.bincount(kind, weights=table[p], minlength=s.classes)
        table[p] = np.log10((table[p] + s.back_off * base) / (whole[kind] + s.back_off))
    return table.astype(np.float32)


# --- over Spark ---------------------------------------------------------------------------


def _columns(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    key = F.col(f"`{doc_id}`")
    return docs.select(key.alias("doc_id"), (id_residue(key, FOLDS) == HELD_OUT).alias("held_out"), F.col(f"`{text}`").cast("string").alias("text"))


def word_counts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """word (bytes, A-Z in lower case) and n over all training texts, stored."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in gathered(batches, LOT_BYTES):
            held.append(Lot(batch.column(0)).counts())
            if sum(map(len, held)) > FLUSH_WORDS:
                held = [_summed(held)]
                if len(held[0]) > FLUSH_WORDS // 2:
                    yield from held.pop().to_batches()
        if held:
            yield from _summed(held).to_batches()

    train_texts = _columns(docs, text, doc_id).where("not held_out and text is not null").select("text")
    return shared_table(map_arrow(train_texts, count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "words", **PLAIN)


def _summed(tables: list[pa.Table]) -> pa.Table:
    if len(tables) == 1:
        return tables[0]
    return pa.concat_tables(tables).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"])


def _head(words: DataFrame, most: int) -> tuple[int, dict[bytes, int]]:
    """The least count such that at most ``most`` words have it or more, and those words.

    The count is found from how many words there are per step of a logarithmic scale.
    """
    level = F.floor(F.log2("n") * 4).cast("int")
    steps = words.groupBy(level.alias("level")).agg(F.count("*").alias("k"), F.min("n").alias("least")).orderBy(F.desc("level")).collect()
    least, total = None, 0
    for row in steps:
        total += row["k"]
        if total > most:
            break
        least = row["least"]
    if least is None:
        return 1 << 62, {}
    return least, {bytes(r["word"]): r["n"] for r in words.where(F.col("n") >= least).collect()}


def _prepared(docs: DataFrame, head: dict[bytes, int], total: int, distinct: int, s: Settings, text: str, doc_id: str) -> DataFrame:
    """Per row: rid, doc_id, held_out, n_tokens, head sums, subword ids, and the other words with how often.

    Stored, so that row ids, ids and sums agree in all later steps.
    """
    bottom = total + distinct + 1
    known_words = [w.decode() for w in head]
    pieces = subword_encoder(s.vocabulary).pieces(pa.array(known_words, pa.string()))
    terms_ = np.array([math.log10((c + 1) / bottom) for c in head.values()] + [math.nan])  # the last for all others
    shared = docs.sparkSession.sparkContext.broadcast(({w: k for k, w in enumerate(known_words)}, terms_, pieces))

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (known, terms_of, known_pieces), coder = shared.value, subword_encoder(s.vocabulary)
        bits = "<u2" if coder.end < 65_535 else "<u4"
        for batch in gathered(batches, LOT_BYTES):
            lot = Lot(batch.column(2))
            text, size = lot.text_of(), batch.num_rows
            found = np.array([known.get(w, -1) for w in strings(lot.distinct)], dtype=np.int64)
            terms = terms_of[found][lot.code]
            rare = np.isnan(terms)
            sums = np.bincount(text[~rare], weights=terms[~rare], minlength=size)
            seen = np.bincount(text[~rare], minlength=size)
            # The other words of each text, each once and how often.
            key, times = np.unique(text[rare] * len(found) + lot.code[rare], return_counts=True)
            ends = np.searchsorted(key, np.arange(size + 1) * len(found))
            tail = pa.StructArray.from_arrays([lot.distinct.cast(pa.binary()).take(pa.array(key % max(1, len(found)))), pa.array(times, pa.int64())], ["word", "k"])
            tails = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), tail)
            ids = pa.array([x.astype(bits).tobytes() for x in coder.encode(lot, known_pieces, found)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(lot.count + 1, pa.int64()), pa.array(seen, pa.int64()), pa.array(sums, pa.float64()), ids, tails],
                ["doc_id", "held_out", "n_tokens", "head_known", "head_sum", "ids", "tail"],
            )

    word = T.StructType([T.StructField("word", T.BinaryType()), T.StructField("k", T.LongType())])
    columns = _columns(docs, text, doc_id)
    schema = T.StructType(
        [
            *columns.schema.fields[:2],
            T.StructField("n_tokens", T.LongType()),
            T.StructField("head_known", T.LongType()),
            T.StructField("head_sum", T.DoubleType()),
            T.StructField("ids", T.BinaryType()),
            T.StructField("tail", T.ArrayType(word)),
        ]
    )
    rows = map_arrow(columns, prepare, schema)
    return shared_table(rows.withColumn("rid", F.monotonically_increasing_id()), "lm", **PLAIN)


def _some_at_a_time(texts: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """Texts in order, some together, by tokens: a very long one ends its lot."""
    first = size = 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= 100_000 or k == len(texts) - 1:
            yield texts[first : k + 1]
            first, size = k + 1, 0


def _ids(raw: bytes, wide: bool) -> np.ndarray:
    return np.frombuffer(raw, dtype="<u4" if wide else "<u2").astype(np.int32)


def fit(rows: DataFrame, s: Settings) -> Model:
    """The model from prepared rows: classes, symbols, weights and counts, all from all training rows."""
    _, end = subwords(s.vocabulary)
    wide = end >= 65_535
    training = rows.where("not held_out")
    counts, n_windows = _id_counts(training, end, wide, s)
    heads = _by_count(counts)[: s.heads]
    place = np.full(end + 1, -1, dtype=np.int16)
    place[heads] = np.arange(len(heads))
    kind = classify(counts, _pair_counts(training, place, s.heads, end, wide), s)
    symbol = _symbols(counts, kind, s)
    network = _train(training, kind, symbol, int(counts.sum()), n_windows, end, wide, s)
    return Model(s, end, kind, symbol, network, _within(kind, _pair_counts(training, kind.astype(np.int16), s.classes, end, wide), s))


def _id_counts(training: DataFrame, end: int, wide: bool, s: Settings) -> tuple[np.ndarray, int]:
    """How often each id occurs in all training texts, ends included, and how many windows these have."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, windows_ = np.zeros(end + 1, dtype=np.int64), 0
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                ids = _ids(raw, wide)
                if len(ids) > end:
                    sums += np.bincount(ids, minlength=end + 1)
                else:
                    np.add.at(sums, ids, 1)
                sums[end] += 1
                windows_ += -(-(len(ids) + 1) // s.window)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(sums[some], windows_))], ["id", "n"])

    table = map_arrow(training.select("ids"), count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    found = np.zeros(end + 2, dtype=np.int64)
    found[table.column(0).to_numpy()] = table.column(1).to_numpy()  # the windows at -1, the last place
    return found[:-1], int(found[-1])


def _train(training: DataFrame, kind: np.ndarray, symbol: np.ndarray, n_targets: int, n_windows: int, end: int, wide: bool, s: Settings) -> Network:
    """Weights from every window of all training texts.

    A round goes over its share of the texts, in a small corpus over all of them, often
    enough for ``steps`` in all. In a round each task starts from the same weights and
    trains on its own windows; the weights are then averaged by how many targets a task had.
    The sums are of whole numbers, so that their order does not matter.
    """
    net = Network.start(s.classes + s.symbols, s)
    least = s.steps * s.batch
    if not n_windows or not least:
        return net
    shares = n_windows >= least
    times = 1 if shares else -(-least // (s.rounds * n_windows))
    tasks = max(1, n_windows // least)
    texts = training.select("rid", "ids").coalesce(tasks)  # fewer tasks where each would have few windows
    tables = training.sparkSession.sparkContext.broadcast((kind, symbol))
    for r in range(s.rounds):
        some = texts.where(F.pmod(F.xxhash64(F.lit(s.seed), "rid"), F.lit(s.rounds)) == r) if shares else texts
        net, _ = _round(some, net, tables, s.rate * (1 - 0.9 * r / max(1, s.rounds - 1)), s.seed + r, times, n_targets, end, wide, s)
    return net


def _round(texts: DataFrame, net: Network, tables: Broadcast, rate: float, seed: int, times: int, n_targets: int, end: int, wide: bool, s: Settings) -> tuple[Network, float]:
    """The mean of what all tasks make of the weights, and the share of the targets they trained on."""
    shared = texts.sparkSession.sparkContext.broadcast(net)
    size = net.flat().size
    unit = float(1 << 48)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed_memory()
        kinds, symbols = tables.value
        trainer = Trainer(shared.value, s, rate, seed)
        held, n_held, n_seen = [], 0, 0

        def use() -> None:
            nonlocal held, n_held
            whole = [np.concatenate(x) for x in zip(*held, strict=True)]
            for _ in range(times):
                trainer.learn(*whole)
            held, n_held = [], 0

        for batch in batches:
            for texts in _some_at_a_time([_ids(raw, wide) for raw in batch.column(1).to_pylist()]):
                for _, inputs, goals, mask in _laid_out(texts, end, replace(s, stride=s.window)):
                    held.append((symbols[inputs], kinds[goals].astype(np.int64), mask))
                    n_held += len(inputs)
                    n_seen += int(mask.sum())
                    if times == 1 and n_held >= s.sample_windows:
                        use()
        if held:
            use()
        if n_seen:
            sums = np.rint(np.append(trainer.flat.astype(np.float64), 1.0) * (n_seen / n_targets) * unit).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 1, dtype=np.int32)), pa.array(sums)], ["k", "v"])

    got = map_arrow(texts, learn, "k int, v long").groupBy("k").agg(F.sum("v").alias("v")).toArrow()
    shared.unpersist()
    if not got.num_rows:
        return net, 0.0
    sums = np.zeros(size + 1)
    sums[got.column(0).to_numpy()] = got.column(1).to_numpy()
    return net.like((sums[:-1] / sums[-1]).astype(np.float32)), sums[-1] / unit


def _pair_counts(training: DataFrame, group: np.ndarray, groups: int, end: int, wide: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How often each id follows an id of each group, over all training texts; -1 is no group.

    At most groups times vocabulary rows, summed in each task before the shuffle.
    """
    shared = training.sparkSession.sparkContext.broadcast(group)
    size = len(group)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed_memory()
        group_of = shared.value
        sums = np.zeros(groups * size, dtype=np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                ids = np.concatenate([[end], _ids(raw, wide), [end]])
                before = group_of[ids[:-1]].astype(np.int64)
                key = before * size + ids[1:]
                np.add.at(sums, key[before >= 0], 1)
        some = np.flatnonzero(sums)
        for k in range(0, len(some), 100_000):
            part = some[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(sums[part])], ["pair", "n"])

    summed = map_arrow(training.select("ids"), count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    table = summed.toArrow()
    pair, n = table.column(0).to_numpy(), table.column(1).to_numpy()
    return pair // size, pair % size, n


def _scores(rows: DataFrame, model: Model) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(model)
    wide = model.end >= 65_535
    names = ["rid", "doc_id", "held_out", "n_tokens", "head_known", "head_sum"]
    schema = T.StructType([*(rows.schema[n] for n in names), T.StructField("score", T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed_memory()
        fitted = shared.value
        for batch in batches:
            texts = [_ids(raw, wide) for raw in batch.column(len(names)).to_pylist()]
            out = [fitted.score(some) for some in _some_at_a_time(texts)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(np.concatenate(out) if out else np.zeros(0))], [*names, "score"])

    return map_arrow(rows.select(*names, "ids"), score, schema)


def _log10(count: Column, bottom: int) -> Column:
    return F.log10((count + 1) / F.lit(float(bottom)))


def score(docs: DataFrame, settings: Settings = Settings(), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score, one row per row.

    Learns from the rows outside the held-out fold and scores every whole text. Tokens are
    words with A-Z in lower case, then one end. ``base_score`` sums log10((c + 1) / (N + V +
    1)) over a text's tokens by its counts; ``score`` is the attention model's log10
    probability of the text's subwords (A-Z in lower case) and its end. NULL texts count as
    empty: one end. NULL ids are judged as the empty id is. Repeated rows count as often as
    they occur. Without training rows nothing is known and all scores are those of an
    untrained model; an empty table gives an empty result.
    """
    s = settings
    words = word_counts(docs, text, doc_id)
    sums = words.agg(F.count("*").alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    ends = _columns(docs, text, doc_id).where("not held_out").count()
    total, distinct = sums["n"] + ends, sums["v"] + (1 if ends else 0)
    bottom = total + distinct + 1
    least, head = _head(words, s.head_words)
    rows = _prepared(docs, head, total, distinct, s, text, doc_id)
    scored = _scores(rows, fit(rows, s))

    # Words beyond the head, joined with their counts: no word occurs in the two tables often.
    tail = rows.select("rid", F.explode("tail").alias("t")).select("rid", "t.word", "t.k")
    rare = words.where(F.col("n") < least).select(F.col("word").alias("rare"), "n")
    joined = tail.join(rare, F.col("word") == F.col("rare"), "left")
    count = F.coalesce("n", F.lit(0))
    rest = joined.groupBy("rid").agg(
        F.sum(F.when(count > 0, F.col("k")).otherwise(0)).alias("tail_known"), F.sum(F.col("k") * _log10(count, bottom)).alias("tail_sum")
    )
    end_sum = math.log10((ends + 1) / bottom)
    both = scored.join(rest.withColumnRenamed("rid", "tail_rid"), F.col("rid") == F.col("tail_rid"), "left")
    return both.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("head_known") + F.coalesce("tail_known", F.lit(0)) + F.lit(1 if ends else 0)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("head_sum") + F.coalesce("tail_sum", F.lit(0.0)) + F.lit(end_sum)).alias("base_score"),
        "score",
    )

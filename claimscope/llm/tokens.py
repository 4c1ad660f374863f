"""Token ids of whole texts by a tokenizers file, many times faster on repeated words."""

from __future__ import annotations

import string
from array import array
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHE_PIECES = 600_000
CACHE_RUNS = 250_000
CACHE_FRESH = 400_000
LOT_CHARS = 1 << 22
PLAIN_BELOW = "\u0250"  # letters whose class no version of Unicode will change
# Fixed value: how byte-level tokenizers of this kind split a text into runs.
RUNS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SIGNS = string.punctuation.replace("'", "")  # never letters nor digits, and begin no short form
END = 0


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def some_at_a_time(texts: Sequence[str | None], chars: int) -> Iterator[Sequence[str | None]]:
    """Texts in order, some together, by characters: a very long one ends its lot."""
    first = size = 0
    for k, text in enumerate(texts):
        size += len(text or "")
        if size >= chars or k == len(texts) - 1:
            yield texts[first : k + 1]
            first, size = k + 1, 0


def strings(column: pa.Array) -> list[str]:
    """Values without nulls as Python strings, several times faster than ``to_pylist``."""
    return column.to_numpy(zero_copy_only=False).tolist()


class Known(dict):
    """Ids by piece; a piece that is not there is asked for."""

    def __init__(self, ask: Callable[[str], bytes]):
        self.ask = ask

    def __missing__(self, piece: str) -> bytes:
        return self.ask(piece)


class WordEncoder:
    """Ids of texts by a byte-level tokenizer, each word looked up once for many texts.

    A byte-level tokenizer whose own splitting is that of ``RUNS`` never joins a visible character
    to white space that follows it. So a text may be cut before every blank or line end that
    stands between visible characters, and each piece be encoded once and looked up from then
    on. Texts with any other white space, and texts that spell an added token, are encoded whole.
    The look-up keeps a piece when it comes up a second time, as most never do, and holds at most
    ``CACHE_PIECES`` pieces; at most ``CACHE_FRESH`` new ones wait for their second time.
    """

    by_piece = True
    added: Sequence[str] = ()

    def __init__(self) -> None:
        self.known = Known(self._learn)
        self.fresh: dict[str, bytes] = {}

    def whole(self, text: str) -> np.ndarray:
        """Ids of a text by the tokenizer itself."""
        raise NotImplementedError

    def spelled_ids(self, spelled: str) -> bytes:
        """Ids of a piece, its blank or line end included, as 32-bit numbers."""
        return self.whole(spelled).tobytes()

    def encode(self, text: str | None) -> np.ndarray:
        """Ids as unsigned 32-bit numbers; None counts as the empty text."""
        return next(self.encode_all([text]))

    def encode_all(self, texts: Sequence[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text, as :meth:`encode` gives them; those of one lot are held at a time."""
        for lot in some_at_a_time(texts, LOT_CHARS):
            marked = [self._marked(t) if t else "" for t in lot]
            by_piece = iter(self._by_piece([m for m in marked if m]))
            for text, m in zip(lot, marked, strict=True):
                yield next(by_piece) if m else np.zeros(0, "<u4") if m == "" else self.whole(text)

    def _marked(self, text: str) -> str | None:
        """The text with a blank at each place where it may be cut; None if it has to be encoded whole."""
        if not self.by_piece or not text.replace("\n", "").isprintable():  # blanks and line ends alone
            return None
        if any(content in text for content in self.added):
            return None
        spaced = text.replace("\n", " \n")
        if "  " in spaced or "\n " in spaced or spaced[0] == " " or spaced[-1] in " \n":  # white space beside white space
            return None
        # A bare word stands for a blank and the word; the text's first has no blank.
        return "\0" + spaced

    def _by_piece(self, marked: list[str]) -> list[np.ndarray]:
        if not marked:
            return []
        split = pc.split_pattern(pa.array(marked, pa.large_string()), " ")
        coded = split.flatten().dictionary_encode()
        ids = list(map(self.known.__getitem__, strings(coded.dictionary)))
        size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        flat, code = np.frombuffer(b"".join(ids), dtype="<u4"), coded.indices.to_numpy()
        del ids
        # Where each piece's ids lie in ``flat``, laid end to end.
        count = size[code]
        ends = np.cumsum(count)
        kind = np.int32 if ends[-1] < 1 << 31 else np.int64
        at = np.repeat(((np.cumsum(size) - size)[code] - ends + count).astype(kind), count)
        at += np.arange(len(at), dtype=kind)
        pieces = split.offsets.to_numpy()
        return np.split(flat[at], ends[pieces[1:-1] - 1])

    def _learn(self, piece: str) -> bytes:
        ids = self.fresh.get(piece)
        if ids is None:
            ids = self.spelled_ids(piece[1:] if piece[0] == "\0" else piece if piece[0] == "\n" else " " + piece)
            if len(self.fresh) >= CACHE_FRESH:
                self.fresh.clear()
            self.fresh[piece] = ids
        elif len(self.known) < CACHE_PIECES:
            self.known[piece] = ids
            del self.fresh[piece]
        return ids


class Encoder(WordEncoder):
    """Ids of texts, the same as ``Tokenizer.encode`` gives with ``add_special_tokens=False``.

    A new piece is split into its runs, and the tokenizer's model gives each run's ids. The ids
    of a line end and a word, or of a word and signs after it, are those of the two. At most
    ``CACHE_RUNS`` runs are held. Tokenizers of another kind encode every text whole.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        super().__init__()
        self.tool = Tokenizer.from_file(path)
        self.tool.no_truncation()
        self.tool.no_padding()
        self.model = self.tool.model
        self.split = regex.compile(RUNS).findall
        self.letters = byte_letters()
        self.blank = self.letters[0x20]
        self.runs: dict[str, bytes] = {}
        kind = repr(self.tool.pre_tokenizer)
        plain = all(x in kind for x in ("ByteLevel(", "add_prefix_space=False", "use_regex=True")) and "Sequence" not in kind
        self.added = [t.content for t in self.tool.get_added_tokens_decoder().values() if t.content]
        self.by_piece = plain and self.tool.normalizer is None and self.tool.post_processor is None

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tool.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _learn(self, piece: str) -> bytes:
        if piece[0] == "\n" and len(piece) > 1:
            return self._token_run("\n") + self.known["\0" + piece[1:]]
        word = piece.rstrip(SIGNS)
        if len(word) < len(piece) and self._letters(word.removeprefix("\0")):  # two runs
            return self.known[word] + self._token_run(piece[len(word) :])
        return super()._learn(piece)

    def spelled_ids(self, spelled: str) -> bytes:
        blank = spelled[0] == " "
        word = spelled[1:] if blank else spelled
        if self._letters(word):  # one run
            letters = word if word.isascii() else self._in_letters(word)  # ASCII letters stand for themselves
            return self._model_ids(self.blank + letters if blank else letters)
        if max(spelled) < PLAIN_BELOW:
            return b"".join(map(self._token_run, self.split(spelled)))
        return self.whole(spelled).tobytes()

    @staticmethod
    def _letters(word: str) -> bool:
        """Whether all are letters, of those that each library takes for such."""
        return word.isalpha() and (word.isascii() or max(word) < PLAIN_BELOW)

    def _in_letters(self, run: str) -> str:
        return run.encode().decode("latin-1").translate(self.letters)

    def _model_ids(self, letters: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def _token_run(self, run: str) -> bytes:
        """Ids of one run of letters, digits or signs: what the model alone is asked for."""
        ids = self.runs.get(run)
        if ids is None:
            ids = self._model_ids(self._in_letters(run))
            if len(self.runs) < CACHE_RUNS:
                self.runs[run] = ids
        return ids


def byte_letters() -> dict[int, str]:
    """The letter by which byte-level vocabularies write each byte.

    Visible bytes of Latin-1 stand for themselves, the others for code points from 256 on.
    """
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per Python worker and file."""
    return Encoder(path)

"""Byte-pair encoding with a segment tree over the ranks of adjacent pairs, and decoding.

A word's symbols stand in a row; leaf i of the tree holds the merge rank of symbol i and the next
live one (with i in the low bits), so the root is the leftmost pair of lowest rank. A merge changes
two leaves and kills one, each in logarithmic time, until the root says that no pair can merge. Nodes
have ``FAN`` children, whose minimum is one call.

Defined results: a null text is an empty text (no ids, empty decoded text); repeated rows are
encoded each on its own; texts are encoded whole, also a word of any length; an empty table gives
an empty result; other columns of the input are not looked at.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import arrow_stage

NO_MERGE = 1 << 62
#: Pairs, or nodes, below one node of the tree.
FAN = 32
#: Words kept per worker (in each of two generations), and the longest that is kept. They bound memory only, not what is encoded.
CACHE_WORDS = 200_000
CACHE_CHARS = 48


class PairTree:
    """Minimum over (rank, position) of adjacent pairs with point updates.

    Each node stands for ``FAN`` of the level below, so a word of as many pairs has one level.
    """

    def __init__(self, ranks: list[int]):
        self.levels = levels = [ranks]
        while len(levels[-1]) > FAN:
            below = levels[-1]
            levels.append([min(below[i:i + FAN]) for i in range(0, len(below), FAN)])
        self.top = levels[-1]
        #: One level needs no more than its leaf set.
        self.put = ranks.__setitem__ if len(levels) == 1 else self._put

    def root(self) -> int:
        return min(self.top)

    def _put(self, at: int, rank: int) -> None:
        levels = self.levels
        below = levels[0]
        below[at] = rank
        for level in levels[1:]:
            at //= FAN
            low = min(below[at * FAN:(at + 1) * FAN])
            if level[at] == low:
                break
            level[at] = low
            below = level


def merge(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """Merge the leftmost pair of lowest rank until none is left."""
    n = len(symbols)
    if n < 2:
        return symbols
    symbols, rank = list(symbols), ranks.get
    shift = n.bit_length()
    mask = (1 << shift) - 1
    tree = PairTree([NO_MERGE if (r := rank(pair)) is None else r << shift | i
                     for i, pair in enumerate(zip(symbols, symbols[1:]))])
    top, put = tree.top, tree.put
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while (low := min(top)) < NO_MERGE:
        i = low & mask
        j = after[i]
        joined = symbols[i] = symbols[i] + symbols[j]
        symbols[j] = ""
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            put(j, NO_MERGE)
            r = rank((joined, symbols[k]))
            put(i, NO_MERGE if r is None else r << shift | i)
        else:
            put(i, NO_MERGE)
        if (h := before[i]) >= 0:
            r = rank((symbols[h], joined))
            put(h, NO_MERGE if r is None else r << shift | h)
    return [s for s in symbols if s]


def _byte_symbols() -> list[str]:
    """The printable stand-in of every byte: itself if printable in Latin-1, else the next of U+0100..."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class Known(dict):
    """Ids of words met, worked out on first sight; words in use outlive those that are not.

    A full generation becomes the old one, and words found there move on. Long words stay for one text.
    """

    def __init__(self, word: Callable[[str], tuple[int, ...]]):
        super().__init__()
        self.word, self.old, self.long = word, {}, {}

    def __missing__(self, w: str) -> tuple[int, ...]:
        keep = self if len(w) <= CACHE_CHARS else self.long
        ids = self.old.get(w) or self.long.get(w) or self.word(w)
        keep[w] = ids
        return ids

    def settle(self) -> None:
        """Between texts: bound what is held."""
        self.long.clear()
        if len(self) > CACHE_WORDS:
            self.old = dict(self)
            self.clear()


class Bpe:
    """A vocabulary file: lower-cased words, byte symbols, a mark at word ends, merges by rank."""

    #: How the tokenizer cuts words; a fixed value of its file. Letters come first here: no other form begins with one.
    WORDS = regex.compile(r"\p{L}++|'s|'t|'re|'ve|'m|'ll|'d|\p{N}|[^\s\p{L}\p{N}]++")

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.ranks = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): r
                      for r, m in enumerate(model["merges"])}
        self.end = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")
        self.tokens = {i: t for t, i in (*self.ids.items(), *self.special.items())}
        self.numbers = {i: str(i) for i in self.tokens}
        self.bytes = _byte_symbols()
        self.known = Known(self.word)

    def word(self, word: str) -> tuple[int, ...]:
        symbols = [self.bytes[b] for b in word.encode("utf-8", "replace")]
        symbols[-1] += self.end
        return tuple(self.ids[s] for s in merge(symbols, self.ranks))

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        for piece in self.cut.split(text) if text else ():
            if piece in self.special:
                out.append(self.special[piece])
            elif piece:
                # Lower case is taken character by character: no final sigma.
                words = self.WORDS.findall(unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower())
                out.extend(chain.from_iterable(map(self.known.__getitem__, words)))
        self.known.settle()
        return out

    def decode(self, ids: list[int]) -> str:
        """The vocabulary names no decoder: tokens are joined by one space."""
        return " ".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=4)
def load(path: str) -> Bpe:
    return Bpe(path)


def _digests(columns: list[pa.Array], path: str) -> Iterator[list]:
    model = load(path)
    counts, ids_hash, text_hash = [], [], []
    for text in columns[1]:
        ids = model.encode(text.as_py())
        counts.append(len(ids))
        ids_hash.append(hashlib.sha256(" ".join(map(model.numbers.__getitem__, ids)).encode()).hexdigest())
        text_hash.append(hashlib.sha256(model.decode(ids).encode("utf-8")).hexdigest())
    yield [columns[0], counts, ids_hash, text_hash]


def _encoded(columns: list[pa.Array], path: str) -> Iterator[list]:
    model = load(path)
    ids = [model.encode(text.as_py()) for text in columns[1]]
    yield [columns[0], ids, [model.decode(i) for i in ids]]


def encode(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, decoded: the ids of every whole text and the text they decode to."""
    return arrow_stage(documents.select("doc_id", "text"), _encoded,
                       "doc_id bigint, ids array<int>, decoded string", path)


def digests(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encoding and decoding every whole text."""
    return arrow_stage(documents.select("doc_id", "text"), _digests,
                       "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string", path, rows=2000)

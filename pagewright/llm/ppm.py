"""Prediction by partial matching over texts' bytes, with trained escapes and symbol exclusion.

A text is its words, one space before the first and behind each, and an end symbol. Every byte behind the
first space is coded in a context of the ``ORDER`` bytes before it, as far back as the text goes. With
``across`` (as in the query) contexts reach over spaces into the words before; without it they end at the
space before the word, and a text's code length depends on its words only.

Gathering: bytes of training texts are counted in their contexts (per language, which are the classes below).
Each class gets a byte-context trie of order ``ORDER``; nodes are counts of (context, next byte), summed over the corpus.
Escapes are estimated by leaving one out: how often the last of T occurrences in a context with u
symbols was new, by order, T and u. After an escape, the symbols of the longer context are excluded.

Scoring: a code length depends on the byte and its context only. Texts lie in blocks. A block asks for each of
its distinct coded bytes once, together with the counts it has for it; what is asked meets in buckets by the newest
``NEAR`` bytes of context, where all deeper nodes are sums of the same counts. A bucket builds its part of the tries
and answers each block; the block adds up its texts. Asked keys and answers move compressed, not as rows. A text's
probability is the even mixture of the classes' probabilities of all its coded bytes. For the base score, words
are counted over the training texts; the most frequent words' counts go to the tasks that read texts (a table of
``FREQUENT`` rows of ``FREQUENT_BYTES`` bytes at most); all other words of a document meet theirs in a join, none is left out.

Defined results: a null or empty text is the end symbol alone; rows with equal ids are scored each
on their own; languages beyond the ``CLASSES - 1`` commonest, and missing ones, share a class; with
nothing to learn from every byte has probability 1/257; an empty table gives no rows; other columns
are not looked at. No node is left out. What goes to all tasks are the contexts of one byte and none,
and the escape states: tables whose size bytes bound, not the
input. ``MAX_NODES`` says how many buckets there are, ``BLOCK_BYTES`` how long blocks are; neither bounds the model.
Blocks are cut twice from the same scan; a text that comes in another block the second time ends the query with an error.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import a_to_z_lower, arrow_stage, crc32_mod, parts_for, ship, stored

ORDER = 6
CLASSES = 6
FREQUENT = 200_000
#: Longer words are never among the frequent ones, however often they occur.
FREQUENT_BYTES = 64
#: Distinct coded bytes of blocks to a bucket; most of them are asked for by several blocks.
MAX_NODES = 400_000
#: Bytes of the texts of a block.
BLOCK_BYTES = 32_000_000
#: Bytes of texts whose words are looked at together.
PART_BYTES = 8_000_000
#: Coded bytes looked at together; a place among them takes so many bits.
PIECE_BITS = 21
#: One distinct coded byte in so many is counted to say how many there are.
SHARE = 64
#: Newest context bytes that buckets are made by; shorter contexts are shared out.
NEAR = 3
FOLDS, HELD_OUT = 7, 2
END = b"\n"  # white space, so no word
STATES = 8 * 256 * 64
#: An odd factor mixes the bits of a number, its inverse unmixes them.
MIX = 0x9E3779B97F4A7C15
UNMIX = np.uint64(pow(MIX, -1, 1 << 64))
BUCKET = "bucket int, keys binary, counts binary, ends array<int>, blocks array<bigint>, places array<binary>"
ANSWER = "block bigint, bucket int, logs array<binary>"


# ---- texts

def _stream(text: str | None) -> bytes:
    words = a_to_z_lower(text or "").split()
    return b" %s \n" % b" ".join(words) if words else b" \n"


def _text_blocks(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[tuple[int, pa.Table]]:
    """The texts of a task in blocks of at most so many bytes, with the blocks' numbers. The first column is the text."""
    first, n = TaskContext.get().partitionId() << 33, 0

    def out(held):
        return first + n, pa.Table.from_batches(held).combine_chunks()

    held, size = [], 0
    for batch in batches:
        texts = pa.array([_stream(t.as_py()) for t in batch.column(0)], pa.binary())
        batch = pa.RecordBatch.from_arrays([texts, *batch.columns[1:]], names=batch.schema.names)
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(ends):
            before = int(ends[at - 1]) if at else 0
            cut = max(int(np.searchsorted(ends, before + most - size, "right")), at + (not held))
            if cut > at:
                held.append(batch.slice(at, cut - at))
                size += int(ends[cut - 1]) - before
            if cut < len(ends):
                yield out(held)
                held, size, n = [], 0, n + 1
            at = cut
    if held:
        yield out(held)


def _over_blocks(texts: DataFrame, fn, schema: str, *args) -> DataFrame:
    """``fn(number, block, *args)`` on the blocks of texts; it yields lists of output columns."""
    ship(texts.sparkSession)
    kind = StructType.fromDDL(schema)
    arrow, most = to_arrow_schema(kind), BLOCK_BYTES

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, block in _text_blocks(batches, most):
            for columns in fn(number, block, *args):
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) and c.type == f.type else pa.array(c, f.type)
                     for c, f in zip(columns, arrow)], schema=arrow)

    return texts.mapInArrow(run, kind)


#: Stands where a byte is not coded; it sorts behind all windows.
NO_CODE = np.uint64((1 << 64) - 1)
#: What a window keeps of its context and its coded byte at a depth.
_CUT = np.array([((1 << 8 * d) - 1) << 8 * (ORDER - d) | 0xFF << 8 * ORDER for d in range(ORDER + 1)], np.uint64)


def _windows(texts: pa.Array, across: bool, bits: int | None = None) -> Iterator[tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]]:
    """For every byte its window, in pieces, and the texts of the piece with their bytes in it.

    Window: bytes of context at hand (top byte), the byte, the context from its newest byte on. The first byte
    of a text is not coded.
    """
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    flat = np.concatenate((np.zeros(ORDER, np.uint8), np.frombuffer(texts.buffers()[2], np.uint8)[ends[0]:ends[-1]], np.zeros(8 - ORDER, np.uint8)))
    starts, ends = ends[:-1] - ends[0], ends[1:] - ends[0]
    step, total, space = 1 << (bits or PIECE_BITS), len(flat) - 8, -1
    for low in range(0, total, step):
        high = min(low + step, total)
        a, b = np.searchsorted(ends, low, "right"), np.searchsorted(ends, high, "left") + 1
        first, last = starts[a:b], np.minimum(ends[a:b], high)
        # Eight bytes from the oldest byte of context on, of which the last is not wanted.
        window = np.lib.stride_tricks.as_strided(flat[low:], (high - low, 8), (1, 1))
        window = np.ascontiguousarray(window).view("<u8").ravel()
        window &= np.uint64((1 << 56) - 1)
        window |= np.uint64(ORDER << 56)
        if across:
            for depth in range(ORDER):
                place = first + depth
                place = place[(place >= low) & (place < last)] - low
                window[place] = window[place] & _CUT[depth] | np.uint64(depth << 56) if depth else NO_CODE
        else:
            at = np.arange(low, high)
            spaces = np.maximum.accumulate(np.where(flat[low + ORDER:high + ORDER] == 32, at, space))
            depth = np.minimum(at - np.concatenate(([space], spaces[:-1])), ORDER)
            window = window & _CUT[depth] | depth.astype(np.uint64) << np.uint64(56)
            window[first[first >= low] - low] = NO_CODE
            space = int(spaces[-1])
        yield window, (np.arange(a, b, dtype=np.int32), last - np.maximum(first, low))


def _keys(window: np.ndarray) -> np.ndarray:
    """Key: bytes of context at hand (top byte), the context from its newest byte on, the coded byte."""
    return window & np.uint64(0xFF << 56) | window << np.uint64(8) & np.uint64((1 << 56) - (1 << 8)) | window >> np.uint64(8 * ORDER) & np.uint64(0xFF)


def _unkeyed(key: np.ndarray) -> np.ndarray:
    """The windows of keys."""
    return key & np.uint64(0xFF << 56) | key >> np.uint64(8) & np.uint64((1 << 8 * ORDER) - 1) | (key & np.uint64(0xFF)) << np.uint64(8 * ORDER)


def _positions(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For every coded byte of single words its key and its word. A word is coded with the space after it."""
    pieces = list(_windows(pa.array([b" \n" if w == END else b" " + w + b" " for w in words], pa.binary()), False))
    window, owner = np.concatenate([w for w, _ in pieces]), np.concatenate([np.repeat(*held) for _, held in pieces])
    return _keys(window[window != NO_CODE]), owner[window != NO_CODE]


def _firsts(x: np.ndarray) -> np.ndarray:
    """Where new numbers begin in sorted ones."""
    return np.flatnonzero(np.concatenate((np.ones(min(len(x), 1), bool), x[1:] != x[:-1])))


def _tally(texts: pa.Array, across: bool) -> tuple[np.ndarray, np.ndarray]:
    """The distinct windows of texts, sorted, and how often each is there."""
    windows, counts = [], []
    for window, _ in _windows(texts, across, PIECE_BITS + 2):
        window.sort()
        window = window[:np.searchsorted(window, NO_CODE)]
        first = _firsts(window)
        windows.append(window[first])
        counts.append(np.diff(np.append(first, len(window))))
    return (windows[0], counts[0]) if len(windows) == 1 else _summed(windows, counts)


def _split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """For every word of texts its text and its place among the distinct words, and those."""
    # An empty word stands before the first space.
    words = pc.split_pattern(texts, b" ")
    coded = words.flatten().dictionary_encode()
    text, place = np.repeat(np.arange(len(texts)), pc.list_value_length(words).to_numpy(zero_copy_only=False)), coded.indices.to_numpy()
    empty = pc.index(coded.dictionary, pa.scalar(b"", pa.binary())).as_py()
    return text[place != empty], place[place != empty], coded.dictionary


# ---- gathering

def _count(number: int, block: pa.Table, across: bool) -> Iterator[list]:
    """Word counts of the training texts of a block; without a word, how many coded bytes the block will ask for."""
    texts = block.column("text").combine_chunks()
    _, place, words = _split(texts.filter(pc.invert(block.column("held").combine_chunks())))
    n = np.bincount(place, minlength=len(words))
    yield [words.filter(pa.array(n > 0)), n[n > 0]]
    some = []
    for window, _ in _windows(texts, across):
        window *= np.uint64(MIX)
        some.append(window[window < np.uint64((1 << 64) // SHARE)])
    yield [[None], [SHARE * len(np.unique(np.concatenate(some)))]]


def class_names(documents: DataFrame) -> list[str]:
    """The commonest languages of the training texts; what is not among them is the last class."""
    train = documents.filter(~F.coalesce(crc32_mod("doc_id", FOLDS) == HELD_OUT, F.lit(False)))
    rows = train.groupBy("lang").count().filter("lang is not null").orderBy(F.desc("count"), "lang") \
        .limit(CLASSES - 1).collect()
    return [r["lang"] for r in rows]


def _class_of(lang: Column, names: list[str]) -> Column:
    out = F.lit(len(names))
    for i, name in enumerate(names):
        out = F.when(lang == name, F.lit(i)).otherwise(out)
    return out


def read_texts(documents: DataFrame, names: list[str]) -> DataFrame:
    """text, kind, held, row, doc_id"""
    return documents.select("text", _class_of(F.col("lang").cast("string"), names).alias("kind"),
                            (crc32_mod("doc_id", FOLDS) == HELD_OUT).alias("held"),
                            F.monotonically_increasing_id().alias("row"), "doc_id")


def word_counts(texts: DataFrame, across: bool) -> DataFrame:
    """word, c: training counts of words; without a word, the coded bytes that blocks will ask for."""
    return _over_blocks(texts, _count, "word binary, n bigint", across).groupBy("word").agg(F.sum("n").alias("c"))


def _at_depth(key: np.ndarray, d: int) -> np.ndarray:
    """The node of a position's context cut to ``d`` bytes."""
    kept = ((1 << (8 * d)) - 1) << (56 - 8 * d)
    return (key & np.uint64(kept | 0xFF)) | np.uint64(d << 56)


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key)
    key, count = key[order], count[order]
    first = _firsts(key)
    return key[first], np.add.reduceat(count, first)


def _nodes(key: np.ndarray, count: np.ndarray, least: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of contexts of ``least`` bytes and more, with counts, of coded bytes."""
    key, count = key[count > 0], count[count > 0]
    depth = key >> np.uint64(56)
    held = [depth >= d for d in range(least, ORDER + 1)]
    if not held[0].any():
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return _summed([_at_depth(key[h], d) for d, h in enumerate(held, least)], [count[h] for h in held])


def _squeezed(x: np.ndarray) -> bytes:
    """Numbers of eight bytes, compressed place by place."""
    return zstandard.compress(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T.tobytes())


def _spread(blob: bytes, kind=np.int64) -> np.ndarray:
    flat = np.frombuffer(zstandard.decompress(blob), np.uint8)
    return np.ascontiguousarray(flat.reshape(8, -1).T).view(kind).ravel()


def _steps(x: np.ndarray) -> np.ndarray:
    """Differences of rising numbers; the first is the first number."""
    return np.concatenate((x[:1], x[1:] - x[:-1]))


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    """A number for each newest ``NEAR`` bytes of context."""
    near = key >> np.uint64(56 - 8 * NEAR) & np.uint64((1 << 8 * NEAR) - 1)
    return ((near * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


def _by_bucket(key: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """The buckets of sorted keys and the places of their keys, in rising order."""
    bucket = _bucket(key, buckets)
    # Short numbers are sorted by their digits.
    order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for at in np.split(order, cuts):
        if len(at):
            yield int(bucket[at[0]]), at


def _asked(number: int, block: pa.Table, buckets: int, classes: int, across: bool) -> Iterator[list]:
    """bucket, block, keys, counts: the distinct coded bytes of a block and their classes' counts."""
    texts = block.column("text").combine_chunks()
    kinds = np.where(block.column("held").to_numpy(), -1, block.column("kind").to_numpy())
    # Held-out texts ask as well, but count for no class.
    told = {k: _tally(texts.filter(pa.array(kinds == k)), across) for k in np.unique(kinds)}
    window = np.concatenate([w for w, _ in told.values()])
    window.sort()
    window = window[_firsts(window)]
    sums = np.zeros((classes, len(window)), np.int64)
    for k, (own, n) in told.items():
        if k >= 0:
            sums[k, np.searchsorted(window, own)] = n
    key = _keys(window)
    order = np.argsort(key)
    key = key[order]
    parts = list(_by_bucket(key, buckets))
    yield [[b for b, _ in parts], [number] * len(parts), [_squeezed(_steps(key[at])) for _, at in parts],
           [_squeezed(sums[:, order[at]].ravel()) for _, at in parts]]


def _merged(classes: int):
    """A row for each bucket: its keys, their counts, newest two bytes of context, and which keys each block asks for."""
    arrow = to_arrow_schema(StructType.fromDDL(BUCKET))

    def run(asked: pa.Table) -> pa.Table:
        keys = [np.cumsum(_spread(b, np.uint64), dtype=np.uint64) for b in asked.column("keys").to_pylist()]
        key, at = np.unique(np.concatenate(keys), return_inverse=True)
        places = np.split(at, np.cumsum([len(k) for k in keys])[:-1])
        counts = np.zeros((classes, len(key)), np.int64)
        for place, blob in zip(places, asked.column("counts").to_pylist()):
            counts[:, place] += _spread(blob).reshape(classes, -1)
        ends = np.unique(key[key >> np.uint64(56) >= NEAR - 1] >> np.uint64(56 - 8 * (NEAR - 1)) & np.uint64(0xFFFF))
        row = [[asked.column("bucket")[0].as_py()], [_squeezed(_steps(key))], [_squeezed(counts.ravel())], [ends.astype(np.int32).tolist()],
               [asked.column("block").to_pylist()], [[_squeezed(_steps(p)) for p in places]]]
        return pa.table([pa.array(c, f.type) for c, f in zip(row, arrow)], schema=arrow)

    return run


def contexts_by_bucket(texts: DataFrame, buckets: int, classes: int, across: bool) -> DataFrame:
    """One row for each bucket of contexts: all coded bytes of all texts, with what blocks ask for."""
    asked = _over_blocks(texts, _asked, "bucket int, block bigint, keys binary, counts binary", buckets, classes, across)
    return asked.repartition(parts_for(texts.sparkSession, buckets, 8), "bucket").groupBy("bucket").applyInArrow(_merged(classes), BUCKET)


def _told(columns: list[pa.Array], classes: int) -> Iterator[list]:
    """kind, key, a, b: counts (a) of the nodes that buckets share; escapes' counts (new, old) of others, by the key -1 - state."""
    for blob, count in zip(columns[0], columns[1]):
        key = np.cumsum(_spread(blob.as_py(), np.uint64), dtype=np.uint64)
        counts = _spread(count.as_py()).reshape(classes, -1)
        for k in range(classes):
            node, n = _nodes(key, counts[k])
            if not len(node):
                continue
            low = node >> np.uint64(56) < NEAR
            yield [np.full(low.sum(), k), node[low].view(np.int64), n[low].astype(np.float64), np.zeros(low.sum())]
            if low.all():
                continue
            _, context, total, kinds, once = _contexts(node[~low], n[~low].astype(np.float64))
            fresh, known = Trie.escapes((context >> np.uint64(56)).astype(np.int64), total, kinds, once)
            state = np.flatnonzero(fresh + known)
            yield [np.full(len(state), k), -1 - state, fresh[state], known[state]]


# ---- the model

def _bin(x: np.ndarray, fine: int, steps: int) -> np.ndarray:
    x = np.maximum(x, 0)
    return np.where(x <= fine, x, fine + (steps * np.log2(np.maximum(x, 1) / fine)).astype(np.int64)).astype(np.int64)


def _contexts(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of sorted nodes: where contexts begin, the contexts, their counts, symbols, and symbols seen once."""
    context = key & np.uint64(~0xFF & (1 << 64) - 1)
    first = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1]))) if len(key) else np.array([], int)
    if not len(first):
        return first, context, n, n, n
    return (first, context[first], np.add.reduceat(n, first), np.diff(np.append(first, len(key))),
            np.add.reduceat((n == 1).astype(np.float64), first))


class Trie:
    """Sorted nodes and contexts of one class, with all logarithms worked out.

    ``states`` are the escapes' counts (new, old) where the nodes are a part of the class only.
    """

    def __init__(self, key: np.ndarray, n: np.ndarray, states: tuple[np.ndarray, np.ndarray] | None = None):
        order = np.argsort(key)
        self.key, n = key[order], n[order].astype(np.float64)
        first, self.context, total, kinds, once = _contexts(self.key, n)
        if not len(first):
            self.n, self.base = n, math.log10(1 / 257)
            return
        owner = np.repeat(np.arange(len(first)), kinds)
        depth = (self.context >> np.uint64(56)).astype(np.int64)
        new, old = states or self.escapes(depth, total, kinds, once)
        self.rate, self.sure = (new + 0.5) / (new + old + 1), new + old > 20
        escape = self._escape(depth, total, kinds)
        # The shorter context, without the symbols of this one.
        parent_key = np.zeros_like(self.context)
        for d in range(1, ORDER + 1):
            rows = depth == d
            parent_key[rows] = _at_depth(self.context[rows], d - 1) & np.uint64(~0xFF & (1 << 64) - 1)
        parent = np.searchsorted(self.context, parent_key)
        child = depth[owner] > 0
        same = np.searchsorted(self.key, parent_key[owner[child]] | (self.key[child] & np.uint64(0xFF)))
        shut = np.bincount(owner[child], n[same], len(first))
        left, fresh = total[parent] - shut, kinds[parent] - kinds
        open_ = (left > 0) & (depth > 0)
        after = np.where(open_, self._escape(np.maximum(depth - 1, 0), np.maximum(left, 1), np.maximum(fresh, 1)), 1.0)
        self.n = n
        with np.errstate(divide="ignore"):
            self.hit, self.miss = np.log10((1 - escape) / total), np.log10(escape)
            self.hit_after = np.where(open_, np.log10((1 - after) / np.maximum(left, 1)), 0.0)
            self.miss_after = np.where(open_, np.log10(after), 0.0)
        self.base = -math.log10(257 - kinds[0]) if depth[0] == 0 else math.log10(1 / 257)

    @classmethod
    def escapes(cls, depth, total, kinds, once) -> tuple[np.ndarray, np.ndarray]:
        """By state, how often the last symbol was new and how often not.

        Leave one out: a context seen T + 1 times tells what the last of them was.
        """
        rich = total > 1
        states = cls._state(depth, total - 1, kinds - 1), cls._state(depth, total - 1, kinds)
        return (np.bincount(states[0][rich], once[rich], STATES),
                np.bincount(states[1][rich], (total - once)[rich], STATES))

    @staticmethod
    def _state(depth, total, kinds):
        return (depth * 256 + np.minimum(_bin(total, 16, 4), 255)) * 64 + np.minimum(_bin(kinds, 8, 2), 63)

    def _escape(self, depth, total, kinds):
        """Trained where the state was seen often, else u / (T + u); never 0 or 1."""
        state = self._state(depth, total, kinds)
        out = np.where(self.sure[state], self.rate[state], kinds / (total + kinds))
        return np.clip(out, 1e-9, 1 - 1e-9)

    def score(self, key: np.ndarray) -> np.ndarray:
        """log10 probability of every position, from the longest context at hand down."""
        n, rest = self.parts(key)
        return np.log10(n) + rest

    def parts(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The probability of every position in two parts: a count, and the log10 of what its context gives."""
        n, out = np.ones(len(key), np.int64), np.zeros(len(key))
        if not len(self.context):
            return n, out + self.base
        depth = (key >> np.uint64(56)).astype(np.int64)
        longer = np.full(len(key), -1)
        open_ = np.arange(len(key))
        for d in range(ORDER, -1, -1):
            now = open_[depth[open_] >= d]
            if not len(now):
                continue
            node = _at_depth(key[now], d)
            context = node & np.uint64(~0xFF & (1 << 64) - 1)
            c = np.minimum(np.searchsorted(self.context, context), len(self.context) - 1)
            known = self.context[c] == context
            now, node, c = now[known], node[known], c[known]
            e = np.minimum(np.searchsorted(self.key, node), len(self.key) - 1)
            seen = self.key[e] == node
            before = longer[now]
            fresh = before < 0
            n[now[seen]] = self.n[e[seen]]
            out[now] += np.where(seen, np.where(fresh, self.hit[c], self.hit_after[before]),
                                 np.where(fresh, self.miss[c], self.miss_after[before]))
            longer[now] = c
            done = np.zeros(len(key), bool)
            done[now[seen]] = True
            open_ = open_[~done[open_]]
        out[open_] += self.base
        return n, out


def _context_states(columns: list[pa.Array], classes: int) -> Iterator[list]:
    """kind, state, fresh, known: what contexts tell about escapes."""
    kind, depth, total, kinds, once = (c.to_numpy(zero_copy_only=False) for c in columns)
    for k in range(classes):
        at = kind == k
        fresh, known = Trie.escapes(depth[at], total[at].astype(np.float64), kinds[at], once[at].astype(np.float64))
        state = np.flatnonzero(fresh + known)
        yield [np.full(len(state), k), state, fresh[state], known[state]]


def escape_states(nodes: DataFrame, classes: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The escapes' counts of every class, over all its contexts; a state is one of ``STATES``."""
    contexts = nodes.groupBy("kind", F.shiftright("key", 8).alias("context")).agg(
        F.sum("n").alias("total"), F.count("*").alias("kinds"), F.sum((F.col("n") == 1).cast("bigint")).alias("once"))
    contexts = contexts.select("kind", F.shiftright("context", 48).alias("depth"), "total", "kinds", "once")
    rows = arrow_stage(contexts, _context_states, "kind int, state int, fresh double, known double", classes, rows=100_000) \
        .groupBy("kind", "state").agg(F.sum("fresh").alias("fresh"), F.sum("known").alias("known")).toArrow()
    kind, state, fresh, known = (rows.column(c).to_numpy() for c in ("kind", "state", "fresh", "known"))
    return [(np.bincount(state[kind == k], fresh[kind == k], STATES), np.bincount(state[kind == k], known[kind == k], STATES))
            for k in range(classes)]


def _fewest(values: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values that are used, and their places."""
    held = np.zeros(len(values), bool)
    held[code] = True
    return values[held], (np.cumsum(held) - 1)[code]


def _answers(used: list[int], classes: int, low, states):
    """What each block asked a bucket for: keys, then by class counts, and the distinct rests of log10 probabilities with their places."""
    arrow = to_arrow_schema(StructType.fromDDL(ANSWER))

    def run(bucket: pa.Table, shared: pa.Table) -> pa.Table:
        rows = [[], [], []]
        for own in bucket.to_pylist():
            key = np.cumsum(_spread(own["keys"], np.uint64), dtype=np.uint64)
            counts = _spread(own["counts"]).reshape(classes, -1)
            kind, node, n = (shared.column(c).to_numpy() for c in ("kind", "key", "n"))
            logs = []
            for k in used:
                deep, here = _nodes(key, counts[k], NEAR), kind == k
                trie = Trie(np.concatenate([low.value[k][0], node[here].view(np.uint64), deep[0]]),
                            np.concatenate([low.value[k][1], n[here], deep[1]]), states.value[k])
                seen, rest = trie.parts(key)
                logs.append((seen, *np.unique(rest, return_inverse=True)))
            for block, place in zip(own["blocks"], own["places"]):
                at = np.cumsum(_spread(place))
                rows[0].append(block)
                rows[1].append(own["bucket"])
                rows[2].append([_squeezed(part) for part in (_steps(key[at]), *(
                    x for seen, values, code in logs for x in (seen[at], *_fewest(values, code[at]))))])
        return pa.table([pa.array(c, f.type) for c, f in zip(rows, arrow)], schema=arrow)

    return run


PART = ("row bigint, doc_id bigint, held_out boolean, word binary, n bigint, n_tokens bigint, n_known bigint, "
        "base double, logs array<double>")


def _packed(number: int, block: pa.Table) -> Iterator[list]:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, block.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(block)
    yield [[number], pa.array([sink.getvalue().to_pybytes()], pa.binary())]


def _told_logs(answers: pa.Table, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows a block asked for, mixed and sorted, and their log10 probabilities by class; what is not coded has none."""
    packets = answers.column("logs").to_pylist()
    keys = np.concatenate([np.empty(0, np.uint64), *(np.cumsum(_spread(p[0], np.uint64), dtype=np.uint64) for p in packets)])
    mixed = np.append(_unkeyed(keys), NO_CODE)
    mixed *= np.uint64(MIX)
    order = np.argsort(mixed)
    logs = np.empty((classes, len(mixed)))
    for k in range(classes):
        told = [np.log10(_spread(p[3 * k + 1])) + _spread(p[3 * k + 2], np.float64)[_spread(p[3 * k + 3])] for p in packets]
        logs[k] = np.concatenate([*told, [0.0]])[order]
    return mixed[order], logs


def _text_sums(texts: pa.Array, answers: pa.Table, classes: int, across: bool) -> np.ndarray:
    """log10 probabilities of a block's texts by class, from the answers of all buckets."""
    mixed, logs = _told_logs(answers, classes)
    sums, low = np.zeros((len(texts), classes)), np.uint64((1 << PIECE_BITS) - 1)
    for window, held in _windows(texts, across):
        # Equal windows come together in the order of their mixed bits; each group of them is looked up once.
        window *= np.uint64(MIX)
        at = window & ~low
        at |= np.arange(len(window), dtype=np.uint64)
        at.sort()
        at &= low
        at = at.view(np.int64)
        window, owner = window[at], np.repeat(np.arange(len(held[0])), held[1])[at]
        first = _firsts(window)
        found = np.minimum(np.searchsorted(mixed, window[first]), len(mixed) - 1)
        if (mixed[found] != window[first]).any():
            raise RuntimeError("the texts of a block are not those that asked: their table changed while it was read")
        sizes = np.diff(np.append(first, len(window)))
        own = slice(held[0][0], held[0][-1] + 1)
        for k in range(classes):
            sums[own, k] += np.bincount(owner, np.repeat(logs[k, found], sizes), len(held[0]))
    return sums


def _text_parts(classes: int, across: bool, frequent, norm: float):
    """The parts of a block's documents, from the answers of all buckets."""
    arrow = to_arrow_schema(StructType.fromDDL(PART))

    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        tables = []
        for blob in block.column("texts").to_pylist():
            held = pa.ipc.open_stream(blob).read_all()
            logs = _text_sums(held.column("text").combine_chunks(), answers, classes, across)
            # Words of a few texts at a time.
            step = max(1, len(held) * PART_BYTES // max(held.nbytes, 1))
            for low in range(0, len(held), step):
                tables += [pa.table([c if isinstance(c, pa.Array) else pa.nulls(len(columns[0]), f.type) if c is None else pa.array(c, f.type)
                                     for c, f in zip(columns, arrow)], schema=arrow)
                           for columns in _document_parts(held.slice(low, step), logs[low:low + step], frequent, norm)]
        return pa.concat_tables(tables) if tables else arrow.empty_table()

    return run


def text_scores(texts: DataFrame, classes: int, asked: int, across: bool, frequent, norm: float) -> tuple[DataFrame, int]:
    """Parts of documents with log10 probabilities of every text by the tries of the classes in use, and the number of those."""
    spark = texts.sparkSession
    buckets = -(-max(asked, 1) // MAX_NODES)
    held = stored(contexts_by_bucket(texts, buckets, classes, across), "contexts")
    told = arrow_stage(held.select("keys", "counts"), _told, "kind int, key bigint, a double, b double", classes)
    told = stored(told.groupBy("kind", "key").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), "shared")
    nodes = told.filter("key >= 0").select("kind", "key", F.col("a").cast("bigint").alias("n"))
    depth = F.shiftright("key", 56)
    states = escape_states(nodes, classes)
    rows = told.filter("key < 0").toArrow()
    kind, state, new, old = (rows.column(c).to_numpy() for c in ("kind", "key", "a", "b"))
    states = [tuple(x + np.bincount(-1 - state[kind == k], y[kind == k], STATES) for x, y in zip(states[k], (new, old)))
              for k in range(classes)]
    few = nodes.filter(depth < NEAR - 1).toArrow()
    kind, key, n = (few.column(c).to_numpy() for c in ("kind", "key", "n"))
    low = [(key[kind == k].view(np.uint64), n[kind == k]) for k in range(classes)]
    used = [k for k in range(classes) if (kind == k).any()] or [0]
    # Contexts one byte shorter than groups go to each bucket with groups that end in them: 256 at most.
    end = F.shiftright("key", 56 - 8 * (NEAR - 1)).bitwiseAND(F.lit((1 << 8 * (NEAR - 1)) - 1)).cast("int").alias("end")
    shorter = nodes.filter(depth == NEAR - 1).select(end, "kind", "key", "n")
    shared = held.select(F.col("bucket").alias("owner"), F.explode("ends").alias("end")).join(shorter, "end") \
        .select("owner", "kind", "key", "n")
    context = spark.sparkContext
    # Packed rows are few and small for their work: they are dealt to tasks by number, not by size.
    tasks = parts_for(spark, buckets, 8)
    answers = held.repartition(tasks, "bucket").groupBy("bucket").cogroup(shared.repartition(tasks, "owner").groupBy("owner")).applyInArrow(
        _answers(used, classes, context.broadcast(low), context.broadcast(states)), ANSWER)
    blocks = _over_blocks(texts, _packed, "block bigint, texts binary").repartition(tasks, "block")
    return blocks.groupBy("block").cogroup(answers.repartition(tasks, "block").groupBy("block")).applyInArrow(
        _text_parts(len(used), across, frequent, norm), PART), len(used)


# ---- documents

def _document_parts(block: pa.Table, logs: np.ndarray, frequent, norm: float) -> Iterator[list]:
    """A row for each document with its sums over frequent words, and one for each other word of it."""
    listed, counts = frequent.value
    texts, row = block.column("text").combine_chunks(), block.column("row").to_numpy()
    text, place, words = _split(texts)
    at = pc.fill_null(pc.index_in(words, value_set=pa.array(listed, pa.binary())), -1).to_numpy()
    # Behind all places of frequent words stands what other words add here: nothing.
    base, known = np.append(np.log10(counts + 1.0) - norm, 0.0), np.append(counts > 0, False)
    own = at[place]
    yield [row, block.column("doc_id").combine_chunks(), block.column("held").combine_chunks(), None, np.zeros(len(row), np.int64),
           np.bincount(text, minlength=len(row)), np.bincount(text, known[own], len(row)).astype(np.int64), np.bincount(text, base[own], len(row)),
           pa.ListArray.from_arrays(pa.array(np.arange(0, logs.size + 1, logs.shape[1], dtype=np.int32)), pa.array(logs.ravel()))]
    rare = np.sort(text[own < 0].astype(np.int64) << 32 | place[own < 0])
    first = _firsts(rare)
    n, rare = np.diff(np.append(first, len(rare))), rare[first]
    zero = np.zeros(len(rare), np.int64)
    yield [row[rare >> 32], None, None, words.take(pa.array(rare & (1 << 32) - 1)), n, zero, zero, np.zeros(len(rare)), None]


def scores(documents: DataFrame, across: bool = False) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``across`` lets contexts reach over spaces into the words before.
    """
    spark: SparkSession = documents.sparkSession
    documents = documents.select("doc_id", "text", "lang")
    names = class_names(documents)
    texts = read_texts(documents, names)
    counts = stored(word_counts(texts, across), "words")
    asked = (counts.filter("word is null").first() or {"c": 0})["c"]
    counts = counts.filter("word is not null")
    stats = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    total, vocabulary = stats["n"] or 0, stats["v"]
    top = counts.filter(F.octet_length("word") <= FREQUENT_BYTES).orderBy(F.desc("c"), "word").limit(FREQUENT).toArrow()
    listed = {w: i for i, w in enumerate(top.column("word").to_pylist())}
    frequent = spark.sparkContext.broadcast((listed, top.column("c").to_numpy()))
    del top
    norm = math.log10(total + vocabulary + 1)
    parts, used = text_scores(texts, len(names) + 1, asked, across, frequent, norm)
    parts = stored(parts, "parts")
    logs_at = [F.col("logs")[i].alias(f"l{i}") for i in range(used)]
    whole = parts.filter("word is null").select("row", "doc_id", "held_out", "n_tokens", "n_known", "base", *logs_at)
    # Words of held-out texts alone have no count.
    c = F.coalesce("c", F.lit(0))
    rare = parts.filter("word is not null").select("row", "word", "n").join(counts, "word", "left").select(
        "row", F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("boolean").alias("held_out"), F.lit(0).cast("bigint").alias("n_tokens"),
        F.when(c > 0, F.col("n")).otherwise(0).alias("n_known"), (F.col("n") * (F.log10(c + 1.0) - F.lit(norm))).alias("base"),
        *[F.lit(None).cast("double").alias(f"l{i}") for i in range(used)])
    # A text has one row with its id and its sums.
    summed = whole.unionByName(rare).groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base").alias("base_score"),
        *[F.max(f"l{i}").alias(f"l{i}") for i in range(used)])
    # An even mixture of the classes, added up in logarithms.
    sums = [F.col(f"l{i}") for i in range(used)]
    best = F.greatest(*sums) if len(sums) > 1 else sums[0]
    mixed = best + F.log10(sum((F.pow(F.lit(10.0), s - best) for s in sums), F.lit(0.0))) - F.lit(math.log10(len(sums)))
    return summed.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("bigint").alias("train_tokens"),
                         "base_score", mixed.alias("score"))

"""Ids and decoded texts against the library that the vocabulary file belongs to."""

import hashlib
import random

import pytest
from odd_texts import ODD
from tokenizers import Tokenizer

from pagewright.llm import bpe
from pagewright.llm.queries import tokenizer


@pytest.fixture(scope="module")
def known():
    tok = Tokenizer.from_file(tokenizer())
    tok.no_truncation()
    tok.no_padding()
    return tok


def expected(known, text):
    ids = known.encode(text or "", add_special_tokens=False).ids
    return ids, known.decode(ids, skip_special_tokens=False)


def test_tree_gives_leftmost_lowest():
    tree = bpe.PairTree([5, 3, 3, 9])
    assert tree.root() == 3
    tree.put(1, bpe.NO_MERGE)
    tree.put(2, 7)
    assert tree.root() == 5


def test_merge_against_plain_loop():
    ranks = {("a", "b"): 0, ("ab", "a"): 1, ("b", "a"): 2, ("aba", "b"): 3, ("c", "c"): 4, ("cc", "cc"): 5}

    def plain(s):
        s = list(s)
        while True:
            best = min(((ranks[p], i) for i, p in enumerate(zip(s, s[1:])) if p in ranks), default=None)
            if best is None:
                return s
            s[best[1]:best[1] + 2] = ["".join(s[best[1]:best[1] + 2])]

    rng = random.Random(1)
    for _ in range(300):
        word = [rng.choice("abc") for _ in range(rng.randrange(0, 40))]
        assert bpe.merge(word, ranks) == plain(word)


def test_odd_texts(spark, docs, known):
    got = bpe.digests(docs(ODD), tokenizer()).collect()
    want = []
    for i, text in ODD:
        ids, decoded = expected(known, text)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(decoded.encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_random_unicode(known):
    model, rng = bpe.load(tokenizer()), random.Random(7)
    pools = [range(32, 127), range(0xA0, 0x250), range(0x370, 0x530), range(0x4E00, 0x4F00), range(0x1F600, 0x1F640),
             range(0x300, 0x340), [0x20, 0x0A, 0x2028, 0x85, 0x3000]]
    for _ in range(1500):
        text = "".join(chr(rng.choice(rng.choice(pools))) for _ in range(rng.randrange(1, 40)))
        ids, decoded = expected(known, text)
        assert model.encode(text) == ids, repr(text)
        assert model.decode(ids) == decoded


def test_real_texts(spark, folder, known):
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: (r["ids"], r["decoded"]) for r in bpe.encode(rows, tokenizer()).collect()}
    assert got == {r["doc_id"]: expected(known, r["text"]) for r in rows.collect()}


def test_empty_table(spark, docs):
    assert bpe.digests(docs([]), tokenizer()).collect() == []


def test_tree_of_several_levels_equals_the_plain_minimum():
    rng = random.Random(5)
    for n in (1, 2, bpe.FAN, bpe.FAN + 1, bpe.FAN ** 2 + 3, 3000):
        ranks = [rng.randrange(9999) for _ in range(n)]
        tree, plain = bpe.PairTree(list(ranks)), list(ranks)
        for _ in range(300):
            at, rank = rng.randrange(n), rng.choice((rng.randrange(9999), bpe.NO_MERGE))
            tree.put(at, rank)
            plain[at] = rank
            assert tree.root() == min(plain)


def test_words_in_use_are_not_merged_again(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 10)
    asked = []

    def word(w):
        asked.append(w)
        return (len(w),)

    known = bpe.Known(word)
    for i in range(100):
        for w in ("often", f"once{i}", "x" * (bpe.CACHE_CHARS + 1)):
            assert known[w] == (len(w),)
        known.settle()
    assert asked.count("often") == 1 and len(known) + len(known.old) <= 24 and not known.long

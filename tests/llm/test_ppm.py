"""Scores against a plain dictionary trie, base scores against plain counts."""

import json
import math
import os
import random
import subprocess
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from odd_texts import ODD

from pagewright.llm import ppm
from pagewright.llm.queries import QUERIES

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words(text):
    return (text or "").encode().translate(LOWER).split() + [b"\n"]


def coded(word):
    return b" \n" if word == b"\n" else b" " + word + b" "


class Plain:
    """Prediction by partial matching as the textbook has it: walk down, exclude, escape."""

    def __init__(self, counts, order=ppm.ORDER):
        self.order, self.seen = order, defaultdict(Counter)
        for w, n in counts.items():
            s = coded(w)
            for p in range(1, len(s)):
                for d in range(min(order, p) + 1):
                    self.seen[s[p - d:p]][s[p]] += n
        self.new, self.old = Counter(), Counter()
        for c, m in self.seen.items():
            total, once = sum(m.values()), sum(v == 1 for v in m.values())
            if total > 1:
                self.new[self.state(len(c), total - 1, len(m) - 1)] += once
                self.old[self.state(len(c), total - 1, len(m))] += total - once

    @staticmethod
    def state(order, total, kinds):
        def cut(x, fine, steps):
            return x if x <= fine else fine + int(steps * math.log2(x / fine))
        return order, min(cut(total, 16, 4), 255), min(cut(kinds, 8, 2), 63)

    def escape(self, order, total, kinds):
        new, old = (t[self.state(order, total, kinds)] for t in (self.new, self.old))
        return min(max((new + 0.5) / (new + old + 1) if new + old > 20 else kinds / (total + kinds), 1e-9), 1 - 1e-9)

    def distribution(self, context):
        """Probability of each byte after a context."""
        out, left, shut = {}, 1.0, set()
        for d in range(min(self.order, len(context)), -1, -1):
            m = self.seen.get(context[len(context) - d:])
            if not m:
                continue
            open_ = {s: n for s, n in m.items() if s not in shut}
            if open_:
                total = sum(open_.values())
                e = self.escape(d, total, len(open_))
                out |= {s: left * (1 - e) * n / total for s, n in open_.items()}
                left *= e
            shut |= m.keys()
        rest = 257 - len(shut)
        return out, left / rest

    def log(self, word):
        s, total = coded(word), 0.0
        for p in range(1, len(s)):
            known, other = self.distribution(s[:p])
            total += math.log10(known.get(s[p], other))
        return total


def train(counts):
    key, n = [], []
    pairs = list(counts.items())
    k, owner = ppm._positions([w for w, _ in pairs])
    weight = np.array([c for _, c in pairs])[owner]
    depth = k >> np.uint64(56)
    for d in range(ppm.ORDER + 1):
        key.append(ppm._at_depth(k[depth >= d], d))
        n.append(weight[depth >= d])
    return ppm.Trie(*ppm._summed(key, n))


def test_trie_against_dictionary():
    rng = random.Random(4)
    syllables = [b"th", b"er", b"on", b"an", b"\xc3\xa9", b"s", b"ing", b"x"]
    counts = Counter(b"".join(rng.choice(syllables) for _ in range(rng.randrange(1, 5))) for _ in range(3000))
    counts[b"\n"] = 100
    trie, plain = train(counts), Plain(counts)
    probes = [*list(counts)[:150], b"qqq", b"ther\xff", b"t" * 50, b"\n", b"\x00"]
    key, owner = ppm._positions(probes)
    got = np.bincount(owner, trie.score(key), len(probes))
    assert np.allclose(got, [plain.log(w) for w in probes], atol=1e-9)


def test_distribution_sums_to_one():
    counts = Counter({b"the": 9, b"then": 4, b"than": 2, b"a": 7, b"\n": 3, b"hat": 1})
    plain = Plain(counts)
    for context in (b" ", b" t", b" th", b" xyz", b" the"):
        known, other = plain.distribution(context)
        # Of 257 outcomes (a byte, or none) those without a count share what is left.
        assert abs(sum(known.values()) + other * (257 - len(known)) - 1) < 1e-9


def test_no_counts():
    key, _ = ppm._positions([b"ab"])
    assert np.allclose(ppm.Trie(np.empty(0, np.uint64), np.empty(0, np.int64)).score(key), math.log10(1 / 257))


@pytest.mark.parametrize("frequent", [ppm.FREQUENT, 5])
def test_odd_texts(docs, monkeypatch, frequent):
    monkeypatch.setattr(ppm, "FREQUENT", frequent)
    rows = ODD + [(i, f"some more words {i} to learn from") for i in range(30, 60)]
    got = ppm.scores(docs(rows)).collect()
    held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows}
    counts, by_class = Counter(), [Counter(), Counter()]
    for i, t in rows:
        if not held[i]:
            counts.update(words(t))
            by_class[0 if i is None or i % 2 else 1].update(words(t))
    total, kinds = sum(counts.values()), len(counts)
    tries = [Plain(c) for c in by_class]
    want = []
    for i, t in rows:
        w = Counter(words(t))
        base = sum(n * math.log10((counts[x] + 1) / (total + kinds + 1)) for x, n in w.items())
        sums = [sum(n * trie.log(x) for x, n in w.items()) - math.log10(2) for trie in tries]
        best = max(sums)
        want.append((i, held[i], sum(w.values()), sum(n for x, n in w.items() if counts[x]), total, base,
                     best + math.log10(sum(10 ** (s - best) for s in sums))))
    got, want = sorted(map(tuple, got), key=str), sorted(want, key=str)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], rel=1e-9) and a[6] == pytest.approx(b[6], rel=1e-9)


def test_held_out_rows_teach_nothing(spark):
    """Neither texts nor languages of held-out rows change the score of any other row."""
    rows = [(i, f"some words {i % 9} to learn from", "abcd"[i % 4]) for i in range(120)]
    held = {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 7 == 2}
    other = [(i, t, f"z{i % 3}" if i in held else k) for i, t, k in rows] + [
        (i, "held out", "z0") for i in range(200, 900) if zlib.crc32(str(i).encode()) % 7 == 2]
    one, two = ({r["doc_id"]: r["score"] for r in ppm.scores(spark.createDataFrame(
        x, "doc_id bigint, text string, lang string")).collect()} for x in (rows, other))
    assert held and all(one[i] == pytest.approx(two[i], rel=1e-12) for i in one)


def test_very_long_words_go_to_no_task_whole(docs, monkeypatch):
    rows = [(i, f"{'x' * 500}{i % 3} common word") for i in range(40)]
    want = sorted(tuple(r) for r in ppm.scores(docs(rows)).collect())
    monkeypatch.setattr(ppm, "FREQUENT_BYTES", 10_000)
    got = sorted(tuple(r) for r in ppm.scores(docs(rows)).collect())
    for a, b in zip(got, want):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_better_than_base_on_unseen_texts(spark):
    folder = "/root/testdata/sf0.1"
    rows = ppm.scores(spark.read.parquet(f"{folder}/documents.parquet")).filter("held_out").collect()
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


@pytest.mark.parametrize("bound", [1, 300])
def test_bound_does_not_change_scores(docs, monkeypatch, bound):
    rows = ODD + [(i, f"some more words {i} to learn from, then th{i % 7}ngs and ot{i % 5}er words éé{i}") for i in range(30, 90)]
    table = docs(rows)
    want = sorted((tuple(r) for r in ppm.scores(table).collect()), key=str)
    monkeypatch.setattr(ppm, "MAX_NODES", bound)
    got = sorted((tuple(r) for r in ppm.scores(table).collect()), key=str)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_empty_table(docs):
    assert ppm.scores(docs([])).collect() == []


def test_blocks_do_not_change_scores(docs, monkeypatch):
    rows = ODD + [(i, f"some more words {i} to learn from, then th{i % 7}ngs and {'y' * 90}{i % 5}er éé{i}") for i in range(30, 60)]
    table = docs(rows)
    want = sorted((tuple(r) for r in ppm.scores(table).collect()), key=str)
    monkeypatch.setattr(ppm, "BLOCK_BYTES", 70)
    monkeypatch.setattr(ppm, "MAX_NODES", 200)
    got = sorted((tuple(r) for r in ppm.scores(table).collect()), key=str)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_packed_numbers():
    for x in (np.array([], np.int64), np.array([5, 7, 7, -3, 1 << 62]), np.array([0.5, -1.25e-300])):
        assert np.array_equal(ppm._spread(ppm._squeezed(x), x.dtype), x)


MOVED = """
import sys
from pagewright import session
from pagewright.llm import ppm
folder, events = sys.argv[1:]
spark = session.build("moved", "local[4]", **{
    "spark.sql.shuffle.partitions": "12", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
    "spark.eventLog.enabled": "true", "spark.eventLog.dir": f"file://{events}", "spark.eventLog.compress": "false",
    "spark.eventLog.rolling.enabled": "false", "spark.checkpoint.dir": f"file://{events}-shared"})
ppm.scores(spark.read.parquet(f"{folder}/documents.parquet")).write.format("noop").mode("overwrite").save()
spark.stop()
"""


def test_shuffles_less_than_five_times_the_texts(spark, tmp_path):
    """Rows of one node or one coded byte were 17 times the texts."""
    folder, events = "/root/testdata/sf0.01", tmp_path / "events"
    events.mkdir()
    texts = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("sum(octet_length(text))").first()[0]
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    subprocess.run([sys.executable, "-c", MOVED, folder, str(events)], check=True, timeout=600,
                   env=os.environ | {"PYTHONPATH": f"{repo}:{os.environ.get('PYTHONPATH', '')}"})
    moved = 0
    for log in events.iterdir():
        for line in log.read_text().splitlines():
            if '"SparkListenerTaskEnd"' in line:
                moved += (json.loads(line).get("Task Metrics") or {})["Shuffle Write Metrics"]["Shuffle Bytes Written"]
    assert 0 < moved < 5 * texts


def stream(text):
    return b"".join(b" " + w for w in words(text)[:-1]) + b" \n"


@pytest.mark.parametrize("bounds", [{}, {"BLOCK_BYTES": 90, "MAX_NODES": 200, "FREQUENT": 5}])
def test_contexts_reach_over_words(docs, monkeypatch, bounds):
    """Texts against the dictionary version with contexts as far back as the text goes, in one block and in many."""
    monkeypatch.setattr(sys.modules[__name__], "coded", lambda text: text)
    for name, value in bounds.items():
        monkeypatch.setattr(ppm, name, value)
    rows = ODD + [(i, f"a bc some more words {i} to  learn\n from, to be or th{i % 7}ngs and ot{i % 5}er words éé{i}") for i in range(30, 60)]
    held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows}
    kinds = [0 if i is None or i % 2 else 1 for i, _ in rows]
    tries = [Plain(Counter(stream(t) for (i, t), k in zip(rows, kinds) if k == kind and not held[i])) for kind in (0, 1)]
    want = []
    for i, t in rows:
        sums = [trie.log(stream(t)) - math.log10(2) for trie in tries]
        want.append((str(i), max(sums) + math.log10(sum(10 ** (s - max(sums)) for s in sums))))
    got = sorted((str(r["doc_id"]), r["score"]) for r in ppm.scores(docs(rows), across=True).collect())
    assert [i for i, _ in got] == [i for i, _ in sorted(want)]
    assert [s for _, s in got] == pytest.approx([s for _, s in sorted(want)], rel=1e-9)


def test_the_query_tells_the_order_of_words(docs, spark, tmp_path):
    rows = [(i, "common wa1 qb2 other words in their usual order") for i in range(40)] + [
        (i, "order usual their in words other qb2 wa1 common") for i in range(40, 90) if zlib.crc32(str(i).encode()) % 7 == 2]
    docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in QUERIES["op7_ppm"](spark, str(tmp_path)).collect()}
    usual, turned = [r["score"] for i, r in got.items() if i < 40], [r["score"] for i, r in got.items() if i >= 40]
    assert turned and max(turned) < min(usual) - 1
    assert max(r["base_score"] for r in got.values()) - min(r["base_score"] for r in got.values()) < 1e-9


@pytest.mark.parametrize("across", [False, True])
def test_pieces_of_texts(monkeypatch, across):
    """Keys and sums of texts that pieces cut anywhere."""
    rng = random.Random(5)
    texts = [stream("".join(rng.choice("ab  é\n") for _ in range(rng.randrange(0, 90)))) for _ in range(30)]
    texts = pa.array(texts, pa.binary())
    want = [np.concatenate([w[w != ppm.NO_CODE] for w, _ in ppm._windows(texts[i:i + 1], across)]) for i in range(len(texts))]
    seen = np.unique(np.concatenate(want))
    keys = np.sort(ppm._keys(seen))
    n, rest = np.random.default_rng(1).integers(1, 9, (2, len(keys))), np.random.default_rng(2).integers(-40, 0, (2, len(keys))) / 8
    parts = list(ppm._by_bucket(keys, 3))
    answers = pa.table({"bucket": [b for b, _ in parts], "logs": [
        [ppm._squeezed(x) for x in (ppm._steps(keys[at]), *(x for k in (0, 1) for x in (n[k, at], *np.unique(rest[k, at], return_inverse=True))))]
        for _, at in parts]})
    monkeypatch.setattr(ppm, "PIECE_BITS", 5)
    pieces = list(ppm._windows(texts, across))
    assert len(pieces) > 9
    for i, window in enumerate(want):
        assert np.array_equal(window, np.concatenate([w[(np.repeat(*held) == i) & (w != ppm.NO_CODE)] for w, held in pieces]))
    assert np.array_equal(ppm._tally(texts, across), np.unique(np.concatenate(want), return_counts=True))
    value = np.log10(n) + rest
    sums = ppm._text_sums(texts, answers, 2, across)
    assert np.allclose(sums, [value[:, np.searchsorted(keys, ppm._keys(w))].sum(axis=1) for w in want], rtol=1e-12)


def test_texts_that_did_not_ask_are_an_error():
    answers = pa.table({"bucket": pa.array([], pa.int32()), "logs": pa.array([], pa.list_(pa.binary()))})
    with pytest.raises(RuntimeError, match="not those that asked"):
        ppm._text_sums(pa.array([b" a \n"], pa.binary()), answers, 1, True)

"""Periodic runs against a plain search over all periods, on random words and on the query."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np

from lapse.llm import periodic_runs
from lapse.llm.queries import op11_periodic_runs
from tests.llm.samples import SF, documents, empty, table

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain_runs(words, length=24, exponent=3):
    n, out = len(words), set()
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            size = i - s + q
            if size >= max(length, exponent * q) and not any(
                    words[s:s + size - d] == words[s + d:s + size] for d in range(1, q)):
                out.add((s, size, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256("".join(f"{s},{size},{q}\n" for s, size, q in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest())


COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def rows_of(df):
    return Counter(tuple(r[c] for c in COLUMNS) for r in df.collect())


def test_runs_equal_plain_search_on_random_words():
    rng = random.Random(1)
    for _ in range(150):
        rows = []
        for _ in range(rng.randint(1, 4)):
            words = []
            for _ in range(rng.randint(0, 6)):
                unit = [rng.randint(0, rng.choice([1, 2, 50])) for _ in range(rng.randint(1, 12))]
                words += (unit * rng.randint(1, 40))[:rng.randint(1, 150)]
            rows.append(words)
        sequence = np.array(sum(rows, []), np.int32)
        bounds = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
        assert periodic_runs.find_runs(sequence, bounds) == [plain_runs(r) for r in rows]
        assert periodic_runs.find_runs(sequence, bounds, 6, 2) == [plain_runs(r, 6, 2) for r in rows]


def test_fibonacci_words_hold_nested_runs():
    a, b = "0", "01"
    while len(b) < 600:
        a, b = b, b + a
    words = [int(c) for c in b]
    for length, exponent in ((24, 3), (4, 2), (10, 3)):
        assert periodic_runs.find_runs(np.array(words, np.int32), np.array([0, len(words)]), length, exponent) == [
            plain_runs(words, length, exponent)]


def test_long_texts_of_one_word_and_of_a_long_period():
    for words, run in (([7] * 100_000, (0, 100_000, 1)), (list(range(20_000)) * 4, (0, 80_000, 20_000))):
        assert periodic_runs.find_runs(np.array(words, np.int32), np.array([0, len(words)])) == [[run]]


def test_ordered_positions_against_a_list():
    rng, held, plain = random.Random(2), periodic_runs.Positions([500_000]), [500_000]
    for x in rng.sample(range(1_000_000), 6000):
        before, after = held.around(x)
        assert before == max((p for p in plain if p < x), default=-1) if len(plain) < 300 else True
        assert after == min((p for p in plain if p > x), default=-1) if len(plain) < 300 else True
        held.add(x)
        plain.append(x)
    assert list(held) == sorted(plain) and len(held.blocks) > 2 and held.size == len(plain)


def test_query_on_awkward_rows(spark):
    docs = documents(spark)
    # Ids whose rule makes them periodic, with repeats, a text of one word, and neighbours that break a period.
    cycle = [i for i in range(200, 400) if zlib.crc32(str(i).encode()) % 10 == 0][:6]
    more = [(i, " ".join(f"w{k % 97}é" for k in range(130 + i % 50)), *[None] * 8) for i in cycle]
    more += [(900, "x " * 60, *[None] * 8), (901, "a b " * 12, *[None] * 8), (901, "a b " * 12, *[None] * 8),
             (902, "a b " * 11 + "a", *[None] * 8), (903, "q " + "r s t " * 9 + "r s u " * 9, *[None] * 8)]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema))
    got = rows_of(periodic_runs.run_digests(docs))
    assert got == Counter(plain_row(r.doc_id, r.text) for r in docs.collect())
    assert sum(n for row, n in got.items() if row[1]) >= 6
    assert periodic_runs.run_digests(empty(spark)).collect() == []


def test_query_on_the_test_table(spark):
    docs = table(spark, "documents")
    got = rows_of(op11_periodic_runs(spark, SF))
    assert got == Counter(plain_row(r.doc_id, r.text) for r in docs.collect())


def test_collapsed_texts_without_the_rule(spark):
    docs = spark.createDataFrame([(1, "go " + "a b c " * 10 + "stop"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in periodic_runs.periodic_runs(docs).collect()}
    assert got[1].collapsed == "go a b c stop" and [tuple(x) for x in got[1].runs] == [(1, 30, 3)]
    assert got[2].collapsed == "" and got[2].runs == [] and got[2].n_words == 0

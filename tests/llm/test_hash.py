"""Thue-Morse words, which collide under any polynomial hash modulo a power of two."""

import random

import numpy as np
import pytest

from lapse.llm import common, line_rules, near_dedup, prefix_free, pu_quality
from tests.llm.samples import shingle_set


def pair(n):
    word = "".join("ab"[bin(i).count("1") & 1] for i in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [64, 1024, 2048, 4096, 8192])
def test_words_and_sequences_differ(n):
    a, b = pair(n)
    data = np.frombuffer(f"{a} {b} {a}".encode(), np.uint8)
    start = np.array([0, n + 1, 2 * n + 2])
    x, y, z = common.span_hash(common.prefix_hash(data), start, start + n)
    assert x == z != y
    items = common.mix64(np.frombuffer((a + b + a).encode(), np.uint8).astype(np.uint64))
    x, y, z = common.sequence_hash(items, n * np.arange(3), n * np.arange(1, 4))
    assert x == z != y


def test_prefix_hash_against_big_integers():
    rng = random.Random(1)
    data = np.frombuffer(rng.randbytes(200_000), np.uint8)
    got, prime = common.prefix_hash(data), int(common._PRIME)
    for k, base in enumerate(common._BASES):
        total, power = 0, 1
        for i, c in enumerate(data.tolist()):
            if i % 9973 == 0:
                assert got[k][i] == total
            total, power = (total + (c + 1) * power) % prime, power * base % prime
        assert got[k][-1] == total


def test_operators_tell_them_apart(spark):
    n = 1024
    a, b = pair(n)
    rows = [(1, f"{a}\n{b}\n"), (2, f"{a} x y"), (3, f"{b} x y"), (4, f"{a} x {b} x"), (5, f"{a}\n{a}\n")]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string")
    lines = {r.doc_id: r.n_dup_lines for r in line_rules.line_rules(docs).collect()}
    assert (lines[1], lines[5]) == (0, 1)
    near = {r.doc_id: r for r in near_dedup.near_duplicates(docs).collect()}
    assert all(r.kept for r in near.values())
    assert {i: r.n_shingles for i, r in near.items()} == {i: len(shingle_set(t, 2)) for i, t in rows}
    repeats = pu_quality.measures(np.array([0, 2 * n + 2, 4 * n + 4]), np.frombuffer(f"{a}\n{b}\n{a}\n{a}\n".encode(), np.uint8))
    assert (repeats[0] != repeats[1]).any()
    removed = {r.doc_id: r.n_removed for r in prefix_free.remove_repeats(docs).collect()}
    plain = {}
    texts = {i: t.encode() for i, t in rows}
    seen = {}
    for i, t in texts.items():
        for k in range(len(t) - 199):
            seen[t[k:k + 200]] = seen.get(t[k:k + 200], 0) + 1
    for i, t in texts.items():
        gone = bytearray(len(t))
        for k in range(len(t) - 199):
            if seen[t[k:k + 200]] > 1:
                gone[k:k + 200] = b"\1" * 200
        plain[i] = sum(gone)
    assert removed == plain

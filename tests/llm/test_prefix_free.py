"""Suffix order of phrases, pieces of long texts, many equal rows."""

import hashlib
import random
import time

import numpy as np
import pyarrow as pa

from lapse.llm import prefix_free
from tests.llm.samples import by_id
from tests.llm.test_duplicates import plain_removed


def test_ranks_are_byte_order():
    rng = random.Random(2)
    for window in (1, 3, 8, 20, 200):
        raw = bytes(rng.choice(b"ab\xff\0") for _ in range(700)) + b"a" * 300
        rank = prefix_free.window_ranks(np.frombuffer(raw, np.uint8), window)
        starts = range(len(raw) - window + 1)
        order = sorted(starts, key=lambda i: raw[i:i + window])
        assert all((rank[i] < rank[j]) == (raw[i:i + window] < raw[j:j + window]) for i, j in zip(order, order[1:]))
        assert all((rank[i] == rank[j]) == (raw[i:i + window] == raw[j:j + window]) for i, j in zip(order, order[1:]))


def test_windows_of_one_hash_are_told_apart_by_bytes(spark, monkeypatch):
    """With hashes of two bits nearly all windows look alike; the bytes still decide."""
    real = prefix_free.window_hashes
    monkeypatch.setattr(prefix_free, "window_hashes", lambda b, w: (real(b, w)[0] >> np.uint64(62) << np.uint64(62), *real(b, w)[1:]))
    rng = random.Random(7)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 90))) for _ in range(60)]
    table = pa.table({"key": pa.array([1] * 60, pa.int64()), "phrase": pa.array(range(60), pa.int64()), "n": pa.array([1] * 60, pa.int64()),
                      "bytes": pa.array([t.encode() for t in texts], pa.binary())})
    batch = table.filter(pa.array([len(t) >= 12 for t in texts])).combine_chunks().to_batches()[0]
    got = prefix_free.repeated_windows(batch["bytes"], 12)
    held = [t for t in texts if len(t) >= 12]
    seen = {}
    for t in held:
        for i in range(len(t) - 11):
            seen[t[i:i + 12]] = seen.get(t[i:i + 12], 0) + 1
    want = [seen[t[i:i + 12]] > 1 for t in held for i in range(len(t) - 11)]
    assert got[0].tolist() == want


def test_long_texts_in_pieces(spark):
    rng = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(120))
    texts = [" ".join(f"w{rng.randint(0, 10 ** 6)}" for _ in range(900)) for _ in range(4)]
    texts += [texts[0] + passage + texts[1][:700], passage, "ab" * 3000, texts[2][300:2500], texts[3], texts[3], "é" * 900]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = plain_removed(texts, 200)
    whole = by_id(prefix_free.remove_repeats(docs).collect())
    for i, (size, removed, runs, kept) in enumerate(want):
        r = whole[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (size, removed, runs, hashlib.sha256(kept).hexdigest())
    cut = by_id(prefix_free.remove_repeats(docs, piece=777).collect())
    assert {i: tuple(r) for i, r in cut.items()} == {i: tuple(r) for i, r in whole.items()}


def test_many_equal_rows_take_linear_time(spark):
    rng = random.Random(5)
    text = " ".join(f"w{rng.randint(0, 10 ** 6)}" for _ in range(2500))
    spent = {}
    for n in (100, 800):
        docs = spark.range(n).selectExpr("CAST(NULL AS BIGINT) AS doc_id", f"'{text}' AS text").repartition(4)
        start = time.time()
        rows = prefix_free.remove_repeats(docs).collect()
        spent[n] = time.time() - start
        assert len(rows) == n and all(r.n_removed == len(text) and r.n_spans == 1 for r in rows)
    assert spent[800] < 60

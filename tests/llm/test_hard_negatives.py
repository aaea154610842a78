"""Hard negatives against a plain search, Strassen products against plain ones."""

import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lapse.llm import hard_negatives as hn
from lapse.llm.queries import op13_hard_negatives
from tests.llm.samples import SF, table

SCHEMA = "vec_id long, embedding array<float>, label int, key string, id string, positives int, kind string"


def plain(rows, positives=5, negatives=5):
    """rows: distinct (id, label, vector) that take part, the query's rules applied."""
    out = Counter()

    def dot(a, b):
        return sum(x * y for x, y in zip(a, b))

    for a_id, a_label, a in rows:
        if a_id % 100:
            continue
        scored = sorted((-dot(a, v), i, label) for i, label, v in rows)
        for s, i, _ in [x for x in scored if x[2] == a_label and x[1] != a_id][:positives]:
            fit = [x for x in scored if x[2] != a_label and 80 * -s <= 100 * -x[0] <= 100 * -s][:negatives]
            for rank, (t, j, _) in enumerate(fit, 1):
                out[(a_id, i, rank, j, -s, -t)] += 1
    return out


def prepared(rows):
    found = set()
    for vec_id, vector, label, *_ in rows:
        if vec_id is None or vector is None or label is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        found.add((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, tuple(math.floor(256 * float(np.float32(x))) for x in vector)))
    return sorted(found)


def result(df):
    return Counter((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def test_product_equals_plain_product_exactly():
    rng = np.random.default_rng(1)
    for m, k, n, leaf in ((1, 1, 1, 1), (5, 7, 3, 1), (33, 64, 65, 8), (128, 64, 100, 16), (70, 1, 9, 4), (0, 4, 5, 2), (6, 0, 5, 2)):
        a, b = rng.integers(-(1 << 24), 1 << 24, (m, k)), rng.integers(-(1 << 24), 1 << 24, (k, n))
        got = hn.product(a, b, leaf)
        assert got.dtype == np.int64 and np.array_equal(got, a.astype(object).dot(b.astype(object)) if k else np.zeros((m, n)))


def test_heaps_merge_in_any_order():
    rng = np.random.default_rng(2)
    score, ids = rng.integers(-5, 5, (7, 300)), np.arange(300) // 2
    score[rng.random(score.shape) < 0.3] = hn.NONE
    score[3] = hn.NONE
    want = [sorted(((-s, i) for s, i in zip(row, ids) if s > hn.NONE))[:5] for row in score.tolist()]
    for cuts in ([0, 300], [0, 1, 7, 200, 300], list(range(0, 301, 50))):
        parts = list(zip(cuts, cuts[1:]))[::-1]
        heap = hn.Heaps(7, 5)
        for a, b in parts:
            heap.push(score[:, a:b], ids[a:b])
        assert [[(-s, i) for s, i in zip(x, y) if s > hn.NONE] for x, y in zip(heap.score.tolist(), heap.id.tolist())] == want


def test_awkward_rows(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, 0.5, 0.1]) for _ in range(6)], rng.randint(0, 2) if i % 3 else 1, "k", "i", 1, "x")
            for i in range(420)]
    rows += [rows[100], rows[100], rows[200], rows[5],                               # repeated rows
             (100, [0.5] * 6, 1, None, None, None, None), (6, [0.3] * 4, 2, None, None, None, None),   # one id, other vector; short
             (None, [0.5] * 6, 1, None, None, None, None), (500, None, 1, None, None, None, None),
             (600, [0.5] * 6, None, None, None, None, None), (700, [0.5, None], 1, None, None, None, None),
             (800, [float("nan")] * 6, 1, None, None, None, None), (900, [float("inf")] * 6, 1, None, None, None, None),
             (1000, [], 1, None, None, None, None), (1100, [0.5] * 6, 9, None, None, None, None)]      # no positives
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    want = plain(prepared(rows))
    assert sum(want.values()) > 40
    assert result(hn.mined(df)) == want
    # Many small blocks and lanes give the same rows.
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    small = hn.hard_negatives(hn.integer_rows(df, label=moved), F.col("id") % 100 == 0, block=2, lanes=3)
    assert result(small) == want
    assert hn.mined(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_on_the_test_table(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in table(spark, "embeddings").collect()]
    assert result(op13_hard_negatives(spark, SF)) == plain(prepared(rows))

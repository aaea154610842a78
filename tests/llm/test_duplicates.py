"""Exact, near and substring duplicates and components against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lapse.llm import components, exact_dedup, near_dedup, prefix_free
from lapse.llm.common import sifted
from tests.llm.samples import awkward_texts, by_id, documents, empty, lower, near_groups, shingle_set, table


def plain_exact(rows):
    groups = {}
    for r in rows:
        groups.setdefault(lower(r.text), []).append(r.doc_id)
    return Counter((r.doc_id, max((i for i in groups[lower(r.text)] if i is not None), default=None), len(groups[lower(r.text)]),
                    hashlib.sha256(lower(r.text).encode()).hexdigest()) for r in rows)


@pytest.mark.parametrize("digest_bytes, bytes_per_batch", [(32, 1 << 30), (1, 1 << 30), (32, 1)])
def test_exact(spark, digest_bytes, bytes_per_batch):
    """One digest byte makes collisions, which the full bytes must undo; one byte per batch
    makes many micro-batches."""
    docs = documents(spark)
    got = exact_dedup.exact_dedup(docs, digest_bytes, bytes_per_batch).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == plain_exact(docs.collect())
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter({h: 1 for h in {r.text_sha256 for r in got}})


def test_exact_state_goes_on_with_later_rows(spark, tmpdir_path):
    docs = table(spark, "documents")
    for i, part in enumerate((docs.where("doc_id < 100"), docs.where("doc_id >= 100"))):
        exact_dedup.fingerprints(part).write.mode("append").parquet(f"{tmpdir_path}/prints")
        state = exact_dedup.absorb(spark, f"{tmpdir_path}/prints", tmpdir_path)
    assert state.agg(F.sum("group_size")).first()[0] == docs.count()
    want = plain_exact(docs.collect())
    assert {r["keep"]["doc_id"] for r in state.collect()} == {k[1] for k in want}


def test_exact_edges(spark):
    assert exact_dedup.exact_dedup(empty(spark)).collect() == []
    docs = documents(spark)
    kept = exact_dedup.keep_distinct(docs)
    assert kept.columns == docs.columns
    assert Counter(lower(r.text) for r in kept.collect()) == Counter({lower(r.text): 1 for r in docs.collect()})


def test_near(spark):
    for docs, width in ((documents(spark, repeat=False), 2), (table(spark, "documents"), 2), (table(spark, "documents"), 5)):
        rows = docs.collect()
        want = near_groups([(r.doc_id, r.text) for r in rows], width)
        got = by_id(near_dedup.near_duplicates(docs, width=width).collect())
        for r in rows:
            assert (got[r.doc_id].component_id, got[r.doc_id].n_shingles) == (want[r.doc_id], len(shingle_set(r.text, width)))
            assert got[r.doc_id].kept == (want[r.doc_id] == r.doc_id)


def chain_texts(n: int, words: int = 100):
    """Each text shares 95 % of its words with the next: links between neighbours only."""
    return [" ".join(f"w{j}" for j in range(5 * i, 5 * i + words)) for i in range(n)]


def test_near_chains_blocks_and_repeats(spark):
    texts = chain_texts(40) + [t + " tail" for t in chain_texts(40)[::7]] + [chain_texts(1)[0]] * 5
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want = near_groups(list(enumerate(texts)), 2)
    for block in (2048, 3):               # blocks of three nodes: every bucket is cut up
        got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, block=block, text_block=block).collect()}
        assert got == want


def test_near_edges(spark):
    assert near_dedup.near_duplicates(empty(spark)).collect() == []
    docs = documents(spark)
    got = near_dedup.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len({(r.doc_id, r.text_hash) for r in got if r.kept})


def test_near_groups_of_null_or_shared_ids_keep_one(spark):
    one, other = " ".join(f"a{j}" for j in range(60)), " ".join(f"b{j}" for j in range(60))
    rows = [(None, f"{one} tail{i}") for i in range(4)] + [(5, f"{other} tail{i}") for i in range(3)] + [(None, f"{other} tail9"), (8, "far off")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = sorted((r.doc_id or 0, r.text.split()[0]) for r in near_dedup.keep_one(docs).collect())
    assert kept == [(0, "a0"), (5, "b0"), (8, "far")]


def test_odd_sketch_bound_keeps_pairs_at_the_threshold():
    rng = np.random.default_rng(4)
    most, far = near_dedup.largest_distance(0.8, 128, 1024, 6.0), 0
    for _ in range(200):
        common, own = rng.integers(0, 1 << 60, 800), rng.integers(0, 1 << 60, (2, 100))
        sets = [" ".join(map(str, np.concatenate([common, x]))) for x in own]       # similarity 0.8
        offsets = np.cumsum([0, *(len(s) for s in sets)])
        _, _, _, _, sketch = near_dedup.sketch_batch(offsets, np.frombuffer("".join(sets).encode(), np.uint8), 1, 32, 4, 1024)
        far = max(far, int(np.bitwise_count(sketch[0].view(np.uint64) ^ sketch[1].view(np.uint64)).sum()))
    assert far <= most < 100 + 60         # nothing lost, and unrelated sets (about 230 bits) are far beyond


def test_components(spark):
    rng = random.Random(9)
    for edges in ([(i, i + 1) for i in range(200)], [(0, i) for i in range(1, 50)], [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)], []):
        parent = {}

        def find(x):
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        for a, b in edges:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
        got = components.components(spark.createDataFrame(edges, "u long, v long"))
        assert {r.node: r.root for r in got.collect()} == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def plain_removed(texts, window):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i:i + window] for b in raw for i in range(len(b) - window + 1))
    out = []
    for b in raw:
        covered = np.zeros(len(b), bool)
        for i in range(len(b) - window + 1):
            if seen[b[i:i + window]] > 1:
                covered[i:i + window] = True
        out.append((len(b), *prefix_free.cut_text(b, covered)))
    return out


@pytest.mark.parametrize("window, gram, block", [(200, 32, 4096), (200, 32, 1), (20, 8, 4096), (20, 8, 2)])
def test_repeated_strings(spark, window, gram, block):
    rng = random.Random(window + block)
    texts = awkward_texts()[:27] + ["".join(rng.choice("ab") for _ in range(rng.randint(0, 120))) for _ in range(40)]
    texts += [texts[8], texts[10][50:900], texts[10][:400] + "X" + texts[10][400:]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = by_id(prefix_free.remove_repeats(docs, window, gram, block).collect())
    for i, (size, removed, runs, kept) in enumerate(plain_removed(texts, window)):
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (size, removed, runs, hashlib.sha256(kept).hexdigest()), i
        assert r.kept is None if not removed else bytes(r.kept) == kept


def test_repeated_strings_edges(spark):
    assert prefix_free.remove_repeats(empty(spark)).collect() == []
    docs = documents(spark)
    rows = docs.collect()
    want = Counter((r.doc_id, *w[:3]) for r, w in zip(rows, plain_removed([r.text for r in rows], 200)))
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in prefix_free.remove_repeats(docs).collect())
    assert got == want


def test_bit_filter_loses_no_match(spark):
    rows = spark.range(50_000).select(F.col("id").alias("doc_id")).union(spark.sql("SELECT CAST(NULL AS BIGINT)"))
    wanted = rows.where("doc_id % 500 = 0 OR doc_id IS NULL")
    passed = sifted(rows, "doc_id", wanted)
    assert passed.join(wanted, passed["doc_id"].eqNullSafe(wanted["doc_id"]), "left_semi").count() == 101
    assert passed.count() < 150 and sifted(rows, "doc_id", wanted.limit(0)).count() == 0

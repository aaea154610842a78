"""Fingerprints: contract columns exactly, estimates within their error, band search against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np

from lapse.llm import fingerprints as fp
from lapse.llm.queries import op12_fingerprints
from tests.llm.samples import SF, WORD, documents, empty, table


def plain_set(text, width=5):
    words = WORD.findall(text)
    return {tuple(words[i:i + width]) for i in range(max(len(words) - width + 1, min(len(words), 1)))}


def plain_jaccard(a, b):
    a, b = plain_set(a), plain_set(b)
    return len(a & b) / len(a | b) if a or b else 1.0


def plain_signature(text):
    """The definition, one shingle and one hash function at a time."""
    raw = np.frombuffer(text.encode(), np.uint8)
    x, _ = fp.shingle_hashes(np.array([0, len(raw)]), raw, fp.WIDTH)
    return "".join(f"{min(((int(v) * int(a) + int(b)) % 2**64 >> 32 for v in x), default=2**32 - 1):08x}"
                   for a, b in zip(*fp.coefficients(fp.HASHES)))


def check(got, rows):
    """got: query rows; rows: (doc_id, text)."""
    placed = sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] or ""))
    want, texts = Counter(), {}
    for k, (doc_id, text) in enumerate(placed + [r for r in rows if r[0] is None]):
        text = text or ""
        after = (placed[(k + 1) % len(placed)][1] or "") if k < len(placed) else ""
        edited = text[:len(text) - len(text) // 2] + after[:len(text) // 2]
        digest = hashlib.sha256(edited.encode()).hexdigest()
        want[(doc_id, len(text), digest)] += 1
        texts.setdefault((doc_id, len(text), digest), []).append((text, edited, after))
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    errors, prints = [], {}
    for r in got:
        (text, edited, after), *others = texts[(r.doc_id, r.n_chars, r.edited_sha256)]
        if any(o != (text, edited, after) for o in others):
            continue
        for t, f in ((text, r.fingerprint), (edited, r.edited_fingerprint)):
            assert len(f) == 8 * fp.HASHES and prints.setdefault(t, f) == f
        same = np.mean([r.fingerprint[i:i + 8] == r.edited_fingerprint[i:i + 8] for i in range(0, 8 * fp.HASHES, 8)])
        assert r.near_edited == same
        for near, exact, other in ((r.near_edited, r.edited_jaccard, edited), (r.near_next, r.next_jaccard, after)):
            true = plain_jaccard(text, other)
            errors.append(near - true)
            assert abs(near - true) < 6 * 0.5 / np.sqrt(fp.HASHES)
            assert exact is None and true < 0.95 or exact is not None and abs(exact - true) < 1e-12
    assert abs(np.mean(errors)) < 0.02
    return prints


def test_awkward_rows(spark):
    docs = documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    prints = check(fp.neighbours(docs).collect(), rows)
    for text in ("", "one", "two words", rows[9][1] or ""):
        if text in prints:
            assert prints[text] == plain_signature(text)
    assert prints[""] == "f" * 8 * fp.HASHES
    assert fp.neighbours(empty(spark)).collect() == [] and fp.fingerprints(empty(spark)).collect() == []
    single = spark.createDataFrame([(5, "a b c d e f g h")], "doc_id long, text string")
    check(fp.neighbours(single).collect(), [(5, "a b c d e f g h")])


def test_many_ranges_and_slices(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(rng.randint(-50, 400) * (1 << 40), " ".join(str(rng.randint(0, 30)) for _ in range(rng.randint(0, 60)))) for _ in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    monkeypatch.setattr(fp, "RANGE_BYTES", 300)
    monkeypatch.setattr(fp, "MOST_RANGES", 70)
    check(fp.neighbours(docs).collect(), rows)


def test_query_on_the_test_table(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, "documents").collect()]
    got = op12_fingerprints(spark, SF).collect()
    check(got, rows)
    plain = {r.doc_id: r.fingerprint for r in fp.fingerprints(table(spark, "documents")).collect()}
    assert all(plain[r.doc_id] == r.fingerprint for r in got)


def test_similar_finds_all_links(spark):
    rng = random.Random(6)
    base = [[f"w{rng.randint(0, 2000)}" for _ in range(80)] for _ in range(12)]
    rows = []
    for i in range(240):
        words = list(base[i % 12])
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            words[rng.randrange(len(words))] = "new"
        rows.append((i, " ".join(words)))
    rows += [(500, None), (501, ""), (502, "one two"), (503, "one  two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    queries = docs.where("doc_id % 10 = 0 or doc_id >= 500")
    got = {(r.query_id, r.doc_id): r.jaccard for r in fp.similar(queries, docs).collect()}
    want = {}
    for q, a in rows:
        for d, b in rows:
            if (q % 10 == 0 or q >= 500) and WORD.findall(a or "") and WORD.findall(b or ""):
                if (j := plain_jaccard(a or "", b or "")) >= 0.8:
                    want[(q, d)] = j
    assert got == want and len(want) > 150

"""The classifier recomputed in plain Python: measures, prior, risk and every score of the query."""

import math
import re
import zlib
from collections import Counter

import numpy as np

from lapse.llm import pu_quality as pu
from lapse.llm.queries import op9_pu_quality
from tests.llm.samples import SF, awkward_texts, table

BLANK = re.compile(rb"[^\x20\x09-\x0d]+")
CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n", ".,;:", "!?", "#", "*", "$", "%",
           "&", "|", "<>", "\"'()[]{}", "-_/\\@=+~^`"]
MARKS = set(b"#*$%&|<>!@^~=+_{}[]\\")


def plain_measures(text):
    """One text, one measure at a time."""
    raw = (text or "").encode()
    kinds = [0] * (len(CLASSES) + 2)
    for c in raw:
        at = next((i for i, chars in enumerate(CLASSES, 1) if c < 128 and chr(c) in chars), 0)
        kinds[len(CLASSES) + 1 if c >= 128 else at] += 1
    words = BLANK.findall(raw)
    w = max(len(words), 1)
    sizes = [len(x) for x in words]
    mean = sum(sizes) / w
    spread = math.sqrt(max(sum(s * s for s in sizes) / w - mean * mean, 0))
    upper = sum(1 for x in words if (n := sum(65 <= c <= 90 for c in x)) >= 2 and 2 * n >= len(x))
    marked = sum(x[-1] in MARKS for x in words)
    follows = sum(a == b for a, b in zip(words, words[1:]))
    again = len(words) - len(set(words))
    three = list(zip(words, words[1:], words[2:]))
    many = sum(three.count(t) > 1 for t in three) if len(three) < 400 else sum(
        c for c in Counter(three).values() if c > 1)
    lines = [tuple(BLANK.findall(x)) for x in raw.split(b"\n")]
    lines = [x for x in lines if x]
    n_lines = max(len(lines), 1)
    return [*(math.sqrt(k / max(len(raw), 1)) for k in kinds), math.log1p(len(raw)), math.log1p(len(words)), math.log1p(mean),
            math.log1p(spread), marked / w, upper / w, follows / w, again / w, many / w, (len(lines) - len(set(lines))) / n_lines,
            math.log1p(len(words) / n_lines)]


def plain_risk(positives, web, prior, weights, bias):
    def loss(f):
        return math.log1p(math.exp(-f)) if f > -30 else -f

    margins = [[sum(a * b for a, b in zip(x, weights)) + bias for x in rows] for rows in (positives, web)]
    p, u = margins
    kept = sum(map(loss, p)) / len(p)
    negative = sum(loss(-f) for f in u) / len(u) - prior * sum(loss(-f) for f in p) / len(p)
    return prior * kept, negative


def test_measures_of_awkward_texts():
    import pyarrow as pa
    texts = [t or "" for t in awkward_texts()]
    got = pu.measure_batch(pa.array(texts, pa.large_string()))
    assert got.shape[1] == pu.N_MEASURES
    assert np.allclose(got, [plain_measures(t) for t in texts], atol=1e-9)


def test_every_score_of_the_query(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, "documents").collect()]
    good = {r.doc_id for r in table(spark, "labels").where("quality = 1").collect()}

    def learnt(i):
        return zlib.crc32(str(i).encode()) % 5 != 0

    x = {i: plain_measures(t) for i, t in docs}
    positives = np.array([x[i] for i in sorted(good) if learnt(i) and i in x])
    web = np.array([x[i] for i in sorted(x) if learnt(i)])
    model, prior = pu.fit(positives, web)
    got = {r.doc_id: r for r in op9_pu_quality(spark, SF).collect()}
    assert set(got) == set(x)
    # The score from the parameters, spelled out.
    for i, row in x.items():
        z = [min(max((v - m) / s, -8), 8) for v, m, s in zip(row, model.mean, model.scale)]
        inputs = z + [max(a - k, 0) for knots in model.knots for a, k in zip(z, knots)]
        margin = sum(a * b for a, b in zip(inputs, model.weights)) + model.bias
        score = 1 / (1 + math.exp(-min(max(margin, -30), 30)))
        assert abs(got[i].score - score) < 1e-6
        assert got[i].predicted == (got[i].score >= 0.3) and got[i].held_out == (not learnt(i))
    assert 0.05 <= prior <= 0.99


def test_the_fit_lowers_the_non_negative_risk():
    rng = np.random.default_rng(4)
    positives, web = rng.normal(1, 1, (300, 3)), np.vstack([rng.normal(1, 1, (150, 3)), rng.normal(-1.5, 1, (150, 3))])
    model, prior = pu.fit(positives, web)
    p, u = model.inputs(positives).tolist(), model.inputs(web).tolist()
    kept, negative = plain_risk(p, u, prior, model.weights, model.bias)
    start_kept, start_negative = plain_risk(p, u, prior, np.zeros_like(model.weights), 0.0)
    assert kept + max(0.0, negative) < 0.6 * (start_kept + max(0.0, start_negative))
    # No small step along any weight or the bias lowers it much further: the fit has settled.
    best = kept + max(0.0, negative)
    for k in range(len(model.weights) + 1):
        for d in (-0.05, 0.05):
            moved, bias = model.weights.copy(), model.bias
            if k < len(moved):
                moved[k] += d
            else:
                bias += d
            a, b = plain_risk(p, u, prior, moved, bias)
            assert a + max(0.0, b) > best - 0.01

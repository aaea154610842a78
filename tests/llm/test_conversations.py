"""Reply trees: paths, ranking, escaping and the loss mask."""

import hashlib
import random

from pyspark.sql import functions as F

from lapse.llm import reply_trees
from lapse.llm.queries import PROBE, op4_reply_trees
from tests.llm.samples import SF, table


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(rows, loss_role="assistant"):
    texts = [(r[0] or "", r[1] or "") for r in rows]
    loss = "".join(t for role, t in texts if role == loss_role)
    return (len(rows), digest("".join(f"{r}\n{t}\n" for r, t in texts)), len(loss), digest(loss))


def test_query_reads_all_turns_back(spark):
    got = {r.conv_id: r for r in op4_reply_trees(spark, SF).collect()}
    rows = {}
    for r in sorted(table(spark, "conversations").collect(), key=lambda r: (r.conv_id, r.turn)):
        rows.setdefault(r.conv_id, []).append((r.role, r.text))
    rows[-7] = [("user", PROBE), ("assistant", PROBE)]
    assert {k: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for k, r in got.items()} == {k: plain(v) for k, v in rows.items()}


def test_awkward_conversations(spark):
    texts = ["", None, "</turn>\n", "<turn assistant>", "\\l\\b\\g<>", "é🙂", "line\nbreak", "\\", "a\\", "<", "x" * 5000]
    rows = [(1, i, ["user", "assistant", None, "we<ird>\\"][i % 4], texts[i % len(texts)], "extra") for i in range(300)]
    rows += [(2, 0, "user", "same", None), (2, 0, "user", "same", None), (2, None, "assistant", "first", None)]
    rows += [(None, 1, "user", "no id", None), (3, 5, "assistant", "only", None)]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, node string").repartition(4)
    got = {r.conv_id: r for r in reply_trees.conversation_digests(docs).collect()}
    want = {1: plain([r[2:4] for r in rows[:300]]), 2: plain([("assistant", "first"), ("user", "same"), ("user", "same")]),
            None: plain([("user", "no id")]), 3: plain([("assistant", "only")])}
    assert {k: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for k, r in got.items()} == want
    assert reply_trees.conversation_digests(docs.limit(0)).collect() == []


def test_best_branches_of_random_trees(spark):
    rng = random.Random(8)
    parent = {i: (None if i % 40 == 0 else rng.randrange(i - i % 40, i)) for i in range(160)}
    score = {i: rng.randint(-5, 5) for i in parent}
    rows = [(i, p, float(score[i]), "user" if i % 2 else "assistant", f"m{i}") for i, p in parent.items()]
    rows.append((900, 12345, None, "user", "orphan"))
    frame = spark.createDataFrame(rows, "node long, parent long, score double, role string, text string")

    def path(leaf):
        out = [leaf]
        while parent[out[-1]] is not None:
            out.append(parent[out[-1]])
        return out[::-1]

    leaves = sorted(set(parent) - set(parent.values()))
    want = {900: (1, ["m900"[:0] + "orphan"])}
    for root in range(0, 160, 40):
        own = sorted((x for x in leaves if path(x)[0] == root), key=lambda x: (-sum(score[n] for n in path(x)), x))[:3]
        want |= {x: (k + 1, [f"m{n}" for n in path(x)]) for k, x in enumerate(own)}
    got = reply_trees.format_trees(frame, branches=3)
    turns, loss = reply_trees.read_back()
    got = {r.leaf: (r["rank"], [t["text"] for t in r.turns], r.loss) for r in got.withColumns({"turns": turns, "loss": loss}).collect()}
    assert {k: v[:2] for k, v in got.items()} == want
    for rank, texts, masked in got.values():
        assert masked == "".join(t for t in texts if t[0] == "m" and int(t[1:]) % 2 == 0)


def test_no_python_in_the_plan(spark):
    plan = op4_reply_trees(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_mask_is_spans_of_the_formatted_bytes(spark):
    rows = [(1, 0, "user", "é"), (1, 1, "assistant", "a<b"), (1, 2, "assistant", "ü")]
    out = reply_trees.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    raw = out.formatted.encode()
    assert [raw[s["start"]:s["start"] + s["length"]].decode() for s in out.loss_spans] == ["a\\lb", "ü"]
    assert F.col("x") is not None


def test_circles_are_cut_at_their_least_message(spark):
    rows = [(1, None), (2, 1), (3, 2),                       # a healthy tree
            (10, 11), (11, 10),                              # two that answer each other
            (20, 20), (21, 20),                              # one that answers itself, and a reply to it
            (35, 31), (31, 32), (32, 33), (33, 34), (34, 35), (36, 33), (37, 36),   # a circle of five with a tail
            (40, 999)]                                       # a missing parent
    messages = spark.createDataFrame([(n, p, 0.0, "user", f"m{n}") for n, p in rows],
                                     "node long, parent long, score double, role string, text string")
    got = {r.leaf: [t.split(">", 1)[1] for t in r.formatted.split("</turn>\n") if t]
           for r in reply_trees.format_trees(messages, branches=5).collect()}
    assert got[3] == ["m1", "m2", "m3"] and got[40] == ["m40"]
    assert got[11] == ["m10", "m11"] and got[21] == ["m20", "m21"]
    # 31 is the circle's least: 32, whose reply it was, no longer leads on.
    assert got[37] == ["m31", "m35", "m34", "m33", "m36", "m37"] and got[32] == ["m31", "m35", "m34", "m33", "m32"]
    assert set(got) == {3, 11, 21, 37, 32, 40}


def test_deep_trees_pass_the_counted_rounds(spark):
    n = 300
    messages = spark.createDataFrame([(i, i - 1 if i else None, float(i), "user", str(i)) for i in range(n)],
                                     "node long, parent long, score double, role string, text string")
    row, = reply_trees.format_trees(messages).collect()
    assert [t.split(">", 1)[1] for t in row.formatted.split("</turn>\n") if t] == [str(i) for i in range(n)]

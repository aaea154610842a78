"""Secret scan, line rules and quality classifier against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from lapse.llm import line_rules, pu_quality, queries, secret_scan
from lapse.llm.queries import op6_line_rules
from tests.llm.samples import SF, WORD, documents, empty, lower, table

PLAIN = (("assign", re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A)),
         ("access", re.compile("AKIA[A-Z0-9]+")), ("hex", re.compile("[0-9a-f]+")))


def plain_spans(text):
    out = []
    for k, (kind, rule) in enumerate(PLAIN):
        for m in rule.finditer(text or ""):
            if len(m[2] if kind == "assign" else m[0]) >= {"assign": 12, "access": 18, "hex": 16}[kind]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_spans_equal_plain_rules_on_random_texts():
    rng = random.Random(5)
    parts = ["token", "password", "Passwd", "api_key", "APIKEY", "secret", "=", ":", " ", '"', "'", "AKIA", "abcdef0123", "ABCDEFGH1",
             "xyz_-+/", "é", "\n", "0", "a", "ghp_", "deadbeefdeadbeef", "  ", "==", "日"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["".join(rng.choice(parts) for _ in range(20000))]
    got = list(secret_scan.batch_spans(secret_scan.BASE_RULES, pa.array(texts), block=5000))
    assert got == [plain_spans(t) for t in texts]


def test_secret_query_shape_and_edges(spark):
    docs = documents(spark)
    want = Counter()
    for r in docs.collect():
        spans = plain_spans(r.text)
        joined = ",".join(f"{PLAIN[k][0]}:{s}:{e}" for s, k, e in spans)
        want[(r.doc_id, *(sum(x[1] == k for x in spans) for k in range(3)), hashlib.sha256(joined.encode()).hexdigest())] += 1
    got = secret_scan.find_secrets(docs).collect()
    assert Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == want
    assert secret_scan.find_secrets(empty(spark)).collect() == []


def test_more_rules_and_redaction(spark):
    key = "AIza" + "x" * 35
    texts = [f"é {key}!", "ghp_" + "A1" * 18, "-----BEGIN RSA PRIVATE KEY-----", "xoxb-12345-abcde", "ghp_short", None, "plain",
             "token=ghp_" + "A1" * 18]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    spans = {r.doc_id: r.spans for r in secret_scan.find_secrets(docs).collect()}
    assert spans[0] == "google:2:41" and spans[1] == "github:0:40" and spans[2] == "pem:0:31" and spans[4] == "" and spans[5] == ""
    assert spans[7] == "assign:0:46,github:6:46"
    out = {r.doc_id: r.text for r in secret_scan.redact(docs).collect()}
    assert out[0] == "é [google]!" and out[5] is None and out[6] == "plain" and out[7] == "[assign]"


def test_minimised_automaton_is_smallest_of_equals():
    one = secret_scan.Automaton([secret_scan.parse("(ab|cb)d*")], anywhere=False)
    assert len(one.accepts) == 4          # start, after a or c, accepting, dead


def plain_measures(text):
    words, lines = WORD.findall(text or ""), [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {k + d for k in range(len(words) - 2) if windows[tuple(words[k:k + 3])] > 1 for d in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""),
            len(lines) - len(set(lines)), len(covered))


def test_measures(spark):
    for docs in (documents(spark), table(spark, "documents")):
        got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
                      for r in line_rules.line_rules(docs).collect())
        want = Counter()
        for r in docs.collect():
            m = plain_measures(r.text)
            want[(r.doc_id, *m, m[0] < 50 or 100 * m[4] > 50 * m[0])] += 1
        assert got == want
    assert line_rules.line_rules(empty(spark)).collect() == []
    assert op6_line_rules(spark, SF).where("kept and base_failed").count() == 0


def test_depleted_documents_go_and_copies_are_one_document(spark):
    boiler = "\n".join(" ".join(f"Common{c}{k}" for k in range(7)) + " 2020" for c in "abcdefgh")
    rows = [(i, boiler.replace("2020", str(1000 + i)) + f"\nown{i} " + " ".join(f"u{i}x{j}" for j in range(5)), "h") for i in range(30)]
    rows += [(100 + i, " ".join(f"c{j}" for j in range(60)), "h") for i in range(50)]       # one text 50 times
    rows += [(200, boiler + "\n" + " ".join(f"z{j}" for j in range(200)), "h"), (300, boiler, "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in line_rules.line_rules(docs).collect()}
    assert all(not got[i].kept and not got[i].base_failed and got[i].words_removed == 64 for i in range(30))
    assert all(got[100 + i].kept and got[100 + i].words_removed == 0 for i in range(50))
    assert got[200].kept and got[200].words_removed == 64 and got[300].words_removed == 0


def plain_clean(rows, most=20, share=0.0):
    """Texts without the lines that more than the limit of a host's distinct texts hold."""
    def normal(line):
        return " ".join(re.sub("[0-9]", "0", lower(line)).split())

    held, texts = {}, {}
    for _, t, h in rows:
        texts.setdefault(h, set()).add(t or "")
    for h, distinct in texts.items():
        held[h] = Counter(n for t in distinct for n in {normal(x) for x in t.split("\n")} if n)
    return [None if t is None else "".join(
        x for x in re.findall(r"[^\n]*\n|[^\n]+", t)
        if held[h][normal(x)] <= max(most, share * len(texts[h]))) for _, t, h in rows]


def test_lines_above_the_limit_leave_the_texts(spark):
    menu = "Home | About 1999\r\n"
    rows = [(i, menu.replace("1999", str(1000 + i)) + f"\nown é{i} line\n  HOME |  about 0000", "h") for i in range(30)]
    rows += [(30, menu, "few"), (31, None, "h"), (None, "Home | About 5\nhome | about 1234", "h"), (31, "", None), (33, "home | about 1111\nx", "h")]
    rows += [(40 + i, "the same\ntext", "h") for i in range(30)] + [(80 + i, f"日本{i}\n" + "a b c\n" * 2, None) for i in range(25)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = line_rules.clean_texts(docs).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r[0], t) for r, t in zip(rows, plain_clean(rows)))
    assert any(r.words_removed for r in got)
    assert all(len((r.text or "").split()) == r.n_words - r.words_removed for r in got)

    docs = table(spark, "documents")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    want = dict(zip((r[0] for r in rows), plain_clean(rows)))
    got = {r.doc_id: r for r in line_rules.clean_texts(docs).collect()}
    assert {i: r.text for i, r in got.items()} == want
    assert {r.doc_id: (r.words_removed, r.kept) for r in op6_line_rules(spark, SF).collect()} == {
        i: (r.words_removed, r.kept) for i, r in got.items()}
    assert line_rules.clean_texts(empty(spark)).collect() == []
    shared = {i: r.words_removed for i, r in ((r.doc_id, r) for r in line_rules.line_rules(docs, share=0.05).collect())}
    assert shared == {r.doc_id: r.words_removed for r in line_rules.clean_texts(docs, share=0.05).collect()}


def test_null_host_is_a_host_of_its_own_and_few_left_is_enough(spark):
    line = " ".join(f"common{k}" for k in range(30))
    rows = [(i, f"{line}\n" + " ".join(f"w{i}x{j}" for j in range(60)), "" if i % 2 else None) for i in range(30)]
    rows += [(100 + i, f"{line}\n" + " ".join(f"v{chr(97 + i)}{chr(97 + j)}" for j in range(25)), "h") for i in range(25)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for got in (line_rules.line_rules(docs).collect(), line_rules.clean_texts(docs).collect()):
        by = {r.doc_id: r for r in got}
        assert all(by[i].words_removed == 0 and by[i].kept for i in range(30))             # 15 documents in each host
        assert all(by[100 + i].words_removed == 30 and not by[100 + i].base_failed and not by[100 + i].kept for i in range(25))


def test_clean_texts_of_hot_hosts_and_long_pages(spark, monkeypatch):
    def own(i, n):
        return " ".join(f"d{chr(97 + i // 676)}{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}w{chr(97 + j // 26)}{chr(97 + j % 26)}" for j in range(n))

    banner = "all rights reserved"
    page = [" ".join(f"page{chr(97 + k)}{chr(97 + j // 26)}{chr(97 + j % 26)}" for j in range(100)) for k in range(20)]
    rows = [(i, own(i, 60) + (f"\n{banner}" if i < 40 else ""), "hot") for i in range(1000)]       # under 5 % of the host
    rows += [(2000 + i, "\n".join([*page, own(1000 + i, 60)]), "pages") for i in range(30)]        # 97 % boilerplate
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    monkeypatch.setattr(queries, "read_table", lambda *_: docs)
    got = {r.doc_id: r for r in queries.op6_clean_texts(spark, SF).collect()}
    assert all(banner not in got[i].text and got[i].words_removed == 3 and got[i].kept for i in range(40))
    assert all(got[i].words_removed == 0 and got[i].kept for i in range(40, 1000))
    assert all(got[2000 + i].words_removed == 2000 and not got[2000 + i].kept for i in range(30))


def test_classifier_separates_held_out_rows(spark):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    got = pu_quality.quality(docs, labels)
    rows = {r.doc_id: r for r in got.collect()}
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows.values())
    marked = [(rows[r.doc_id].score, rows[r.doc_id].predicted, r.quality) for r in labels.collect()]
    good = [s for s, _, q in marked if q == 1]
    bad = [s for s, _, q in marked if q == 0]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.95
    assert np.mean([p for _, p, q in marked if q == 1]) > 0.97


def test_classifier_edges(spark):
    labels = table(spark, "labels")
    docs = documents(spark)
    rows = pu_quality.quality(docs, labels.where("doc_id < 10")).collect()
    assert len(rows) == docs.count() and all(r.score is not None for r in rows)
    assert pu_quality.quality(empty(spark), labels).collect() == []
    unlearnt = pu_quality.quality(docs, labels.where("quality = 7")).collect()
    assert all(r.score == 0.5 and r.predicted == 1 for r in unlearnt)
    kept = pu_quality.accepted(docs, None)
    assert kept.columns == docs.columns and kept.count() == docs.count()


def test_fit_takes_one_row_of_a_repeated_id(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text number {i}") for i in range(20)] + [(7, f"again {i}") for i in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(7, 1), (3, 1), (4, 1)], "doc_id long, quality int")
    taken = []
    monkeypatch.setattr(pu_quality, "fit", lambda good, web: taken.append((len(good), len(web))))
    training = [i for i in range(20) if zlib.crc32(str(i).encode()) % 5]
    pu_quality.train(docs, labels)
    assert taken == [(len({3, 4, 7} & set(training)), len(training))] and 7 in training


def test_prior_and_non_negative_fit():
    rng = np.random.default_rng(2)
    positives, negatives = rng.normal(1.5, 1, (3000, 4)), rng.normal(-1.5, 1, (900, 4))
    web = np.vstack([rng.normal(1.5, 1, (2100, 4)), negatives])
    model, prior = pu_quality.fit(positives, rng.permutation(web))
    assert 0.6 < prior < 0.85             # truth 0.7
    assert (model.score(positives) > 0.5).mean() > 0.97 and (model.score(negatives) < 0.5).mean() > 0.95

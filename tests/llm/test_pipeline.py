"""The pipeline's stages, each against plain Python on its own input."""

import importlib

import corpus_pipeline
from tests.llm.samples import SF, documents, lower, near_groups, table
from tests.llm.test_scans import plain_spans


def test_stages(spark, tmpdir_path):
    docs, kept = table(spark, "documents"), {}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "near dedup", "secret scan", "packing"]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        assert i == 4 or out.schema.names == docs.schema.names
        out.write.parquet(f"{tmpdir_path}/{i}")
        docs = spark.read.parquet(f"{tmpdir_path}/{i}")
        kept[name] = docs.collect()
    labels = {r.doc_id: r.quality for r in table(spark, "labels").collect()}
    good = {r.doc_id for r in kept["quality classifier"]}
    assert sum(i in good for i, q in labels.items() if q) >= 0.97 * sum(labels.values())
    assert sum(i in good for i, q in labels.items() if not q) <= 0.2 * sum(not q for q in labels.values())

    groups = {}
    for r in kept["quality classifier"]:
        groups.setdefault(lower(r.text), []).append(r.doc_id)
    assert sorted(r.doc_id for r in kept["exact dedup"]) == sorted(max(g) for g in groups.values())

    near = near_groups([(r.doc_id, r.text) for r in kept["exact dedup"]], 5)
    assert sorted(r.doc_id for r in kept["near dedup"]) == sorted(i for i, least in near.items() if i == least)

    before = {r.doc_id: r.text for r in kept["near dedup"]}
    assert len(kept["secret scan"]) == len(before)
    for r in kept["secret scan"]:
        assert not plain_spans(r.text) and r.n_chars == len(r.text)
        assert plain_spans(before[r.doc_id]) or r.text == before[r.doc_id] or "[" in r.text
    assert {r.doc_id for r in kept["packing"]} == set(before)


def test_stages_take_awkward_tables(spark):
    for docs in (documents(spark), documents(spark).limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            out.collect()
            assert name == "packing" or out.columns == docs.columns


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert corpus_pipeline.ORACLE_SQL is None
    assert importlib.import_module("__spark_entry__").queries()["pipeline"] is corpus_pipeline.run

"""Sketches, id masks, top-k per stratum, the bucketed serving table, the posting table."""

import random
import re
import uuid

import pytest
from pyspark.sql import functions as F

from lapse.config import DiversifyQuotas, RiskThresholds
from lapse.operators import idsearch, profile, rank, serve
from lapse.operators import sketches as sk
from lapse.sources import serving


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_sketches_merge_within_their_bounds(spark):
    df = spark.range(60_000).select((F.col("id") % 5000).cast("string").alias("name"), (F.col("id") * 7 % 60_000).cast("double").alias("x"),
                                    F.when(F.col("id") % 10 == 0, F.lit(None)).otherwise(F.col("id") % 3).alias("code"),
                                    F.lit(None).cast("int").alias("none"),
                                    F.when(F.col("id") % 3 == 0, "big").otherwise(F.concat(F.lit("s"), F.col("id") % 50)).alias("segment"))
    states = sk.sketch_states(df, ["name", "x", "code", "none"], ["segment"])
    assert states.count() == 4 * 51
    whole = sk.merged_states(states)
    counts = {r.column: r for r in sk.distinct_counts(whole).collect()}
    for column, exact, n in (("name", 5000, 60_000), ("x", 60_000, 60_000), ("code", 3, 54_000), ("none", 0, 0)):
        r = counts[column]
        assert r.n == n and r.n + r.n_null == 60_000 and abs(r.n_distinct - exact) <= max(1, exact * sk.DISTINCT_ERROR)
    found = sk.quantiles(whole, [0.01, 0.5, 0.99])
    assert {r.column for r in found.collect()} == {"x", "code"}
    errors = sk.rank_errors(df, found).collect()
    assert len(errors) == 6 and all(r.error <= sk.RANK_ERROR for r in errors)
    big = sk.merged_states(states.where("segment = 'big'"), ["segment"])
    assert abs({r.column: r.n_distinct for r in sk.distinct_counts(big, ["segment"]).collect()}["x"] - 20_000) <= 20_000 * sk.DISTINCT_ERROR


def test_masks_of_any_number_of_tables(spark):
    rng = random.Random(1)
    sets = {f"t{i}": {rng.randint(0, 40) for _ in range(rng.randint(0, 30))} for i in range(70)}
    tables = {n: spark.createDataFrame([(str(x),) for x in s] * 2 + [(None,)], "msno string") for n, s in sets.items()}
    masks = profile.memberships(tables)
    assert [c for c in masks.columns if c.startswith("in_")] == ["in_0", "in_1"]
    for name in ("t0", "t61", "t62", "t69"):
        assert {r.id for r in masks.where(profile.member_of(tables, name)).collect()} == {str(x) for x in sets[name]}
    few = {n: tables[n] for n in ("t0", "t3", "t69")}
    got = {r.tables: r.n for r in profile.set_overlaps(few).collect()}
    want = {}
    for x in set().union(*(sets[n] for n in few)):
        name = "+".join(n for n in few if x in sets[n])
        want[name] = want.get(name, 0) + 1
    assert got == want


def test_coverage_reads_each_table_once(spark, tmpdir_path):
    for n in ("a", "b", "c"):
        spark.range(10).select(F.col("id").cast("string").alias("msno"), "id").write.parquet(f"{tmpdir_path}/{n}")
    a, b, c = (spark.read.parquet(f"{tmpdir_path}/{n}") for n in ("a", "b", "c"))
    out = profile.key_coverage(a.where("id < 8"), {"b": b.where("id < 4"), "c": c.where("id > 100")})
    assert len(re.findall("FileScan parquet", _plan(out))) == 3
    assert {r.table: (r.found, r.coverage_pct) for r in out.collect()} == {"b": (4, 50.0), "c": (0, 0.0)}


def plain_diversified(rows, n, t, q):
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    strata = [[r for r in order if r[2] >= t.high], [r for r in order if t.medium <= r[2] < t.high],
              [r for r in order if r[2] < t.medium and r[3] is not None and r[3] < q.low_new_max_tenure_days]]
    picked = [r for s, k in zip(strata, (q.high, q.medium, q.low_new)) for r in s[:k]]
    rest = [r for r in order if r not in picked]
    return sorted(picked + rest[:max(0, n - len(picked))], key=lambda r: (-r[1], r[0]))


@pytest.mark.parametrize("kind", ["mixed", "all high", "no high", "few"])
def test_diversified_top_k(spark, kind):
    rng, t, q = random.Random(kind), RiskThresholds(0.5, 0.3), DiversifyQuotas()
    p = {"mixed": lambda: rng.random(), "all high": lambda: 0.9, "no high": lambda: rng.random() * 0.4, "few": lambda: rng.random()}[kind]
    rows = [(f"{i:04d}", float(rng.randint(0, 60)), p(), rng.choice([None, 20, 400])) for i in range(6 if kind == "few" else 500)]
    df = spark.createDataFrame(rows, "msno string, expected_value double, churn_probability double, days_since_registration int")
    for n in (1, 8, 10, 40):
        got = [tuple(r) for r in rank.diversified_top_n(df, n, t, q).collect()]
        assert got == plain_diversified(rows, n, t, q)


def test_diversified_exchanges(spark, tmpdir_path):
    spark.range(1000).select(F.col("id").cast("string").alias("msno"), F.rand(1).alias("expected_value"), F.rand(2).alias("churn_probability"),
                             F.lit(5).alias("days_since_registration")).write.parquet(f"{tmpdir_path}/s")
    plan = _plan(rank.diversified_top_n(spark.read.parquet(f"{tmpdir_path}/s"), 10))
    assert plan.count("FileScan parquet") == 1 and len(re.findall(r"\bExchange\b", plan)) <= 3 and plan.count("WindowGroupLimit") >= 1


def test_lookups_do_not_move_the_scored_table(spark, tmpdir_path):
    name = f"scored_{uuid.uuid4().hex}"
    scored = spark.range(5000).select(F.col("id").cast("string").alias("msno"), (F.col("id") / 5000.0).alias("churn_probability"),
                                      F.lit("Low").alias("risk_tier"), F.lit(1.0).alias("estimated_clv"), F.lit(2.0).alias("expected_value"),
                                      F.lit(False).alias("low_confidence"))
    table = serving.write_serving_table(scored, name, f"{tmpdir_path}/t", buckets=4)
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.maxMetadataStringLength": "5000",
                "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false"}
    old = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        asked = spark.createDataFrame([(0, i, m) for i, m in enumerate(["17", "nobody", "17", "4999"])], "request_id long, pos int, msno string")
        out = serve.batch_lookup(asked, table)
        plan = _plan(out)
        assert len(re.findall(r"\bExchange\b", plan)) == 1          # the requests'
        scan = plan[plan.index("FileScan"):] if "FileScan" in plan else ""
        assert "Bucketed: true" in scan
        got = {r.pos: (r.msno, r.success, r.churn_probability) for r in out.collect()}
        assert got == {0: ("17", True, 17 / 5000), 1: ("nobody", False, None), 2: ("17", True, 17 / 5000), 3: ("4999", True, 4999 / 5000)}
        one = serving.point_lookup(table, "42")
        assert "SelectedBucketsCount: 1 out of 4" in _plan(one) and [r.msno for r in one.collect()] == ["42"]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    again = serving.open_serving_table(spark, f"{name}_again", f"{tmpdir_path}/t", 4,
                                       "msno string, churn_probability double, risk_tier string, estimated_clv double, expected_value double, low_confidence boolean")
    assert again.count() == 5000 and [r.msno for r in serving.point_lookup(again, "42").collect()] == ["42"]


def test_indexed_search_equals_the_scan(spark, tmpdir_path):
    rng = random.Random(9)
    ids = sorted({"".join(rng.choice("aAbB1/é+") for _ in range(rng.randint(1, 9))) for _ in range(400)})
    df = spark.createDataFrame([(i,) for i in ids] + [(ids[0],), (None,)], "msno string")
    idsearch.write_postings(df, f"{tmpdir_path}/p")
    table, lengths = (spark.read.parquet(f"{tmpdir_path}/p/{n}") for n in ("postings", "lengths"))
    texts = ["", "a", "A", "é", "ab", "b1/", "AB1", "zzz", "abab", "aaaaa", "1/é+", "a" * 20] + [rng.choice(ids) for _ in range(40)] + [
        "".join(rng.choice("aAbB1/é+") for _ in range(rng.randint(1, 5))) for _ in range(60)]
    got = {}
    rows = idsearch.search(spark.createDataFrame([(t,) for t in texts] + [(None,)], "query string"), table, lengths, 10).collect()
    for r in rows:
        got.setdefault(r.query, []).append((r["rank"], r.msno))
    for t in set(texts):
        want = [i for i in ids if t.lower() in i.lower()][:10]
        assert [m for _, m in sorted(got.get(t, []))] == want
    longer = [r for r in rows if len(r.query) > 3]
    assert longer and max(r.candidates for r in longer) < len(ids) / 2       # not a scan of all ids
    scan = serve.search_ids(df.where("msno is not null").distinct(), "b1/", 10).collect()
    assert [m for _, m in sorted(got.get("b1/", []))] == [r.msno for r in scan]

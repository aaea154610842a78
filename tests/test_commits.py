"""Committed tables: killed, repeated and racing writes leave one readable version."""

import pytest
from pyspark.sql import functions as F

from lapse.sources import commits


def rows(spark, n, tag):
    return spark.range(n).select("id", F.lit(tag).alias("tag"))


def content(spark, path, keys=None):
    return {r.tag: r["count"] for r in commits.read(spark, path, keys).groupBy("tag").count().collect()}


def test_keys_are_replaced_alone(spark, tmpdir_path):
    path = f"{tmpdir_path}/t"
    with pytest.raises(FileNotFoundError):
        commits.read(spark, path)
    for key, n, tag in (("a", 3, "a1"), ("b/1", 4, "b1"), ("a", 5, "a2"), ("a", 6, "a3")):
        commits.publish(rows(spark, n, tag), path, key, {"n": n})
    assert content(spark, path) == {"a3": 6, "b1": 4} and content(spark, path, ["b/1"]) == {"b1": 4}
    assert commits.entries(spark, path)["a"]["meta"] == {"n": 6}
    assert len(commits._names(spark, f"{path}/data")) == 3              # a3, b1 and the last replaced one
    with pytest.raises(FileNotFoundError, match="zz"):
        commits.read(spark, path, ["zz"])
    commits.publish(rows(spark, 2, "all"), path, "c", replace_all=True)
    assert content(spark, path) == {"all": 2}


def test_a_write_killed_before_its_commit_changes_nothing(spark, tmpdir_path, monkeypatch):
    path = f"{tmpdir_path}/t"
    commits.publish(rows(spark, 3, "old"), path, "a")

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(commits, "_commit", killed)
        with pytest.raises(KeyboardInterrupt):
            commits.publish(rows(spark, 9, "new"), path, "a")
    assert content(spark, path) == {"old": 3} and len(commits.orphans(spark, path)) == 1
    commits.publish(rows(spark, 9, "new"), path, "a")                   # the job is repeated
    assert content(spark, path) == {"new": 9}


def test_a_write_that_fails_in_a_task_changes_nothing(spark, tmpdir_path):
    path = f"{tmpdir_path}/t"
    commits.publish(rows(spark, 3, "old"), path, "a")
    bad = spark.range(10).select(F.when(F.col("id") == 9, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("id")).alias("id"),
                                 F.lit("new").alias("tag"))
    with pytest.raises(Exception, match="lost"):
        commits.publish(bad, path, "a")
    assert content(spark, path) == {"old": 3}


def test_a_commit_by_another_writer_in_between_is_kept(spark, tmpdir_path, monkeypatch):
    path = f"{tmpdir_path}/t"
    commits.publish(rows(spark, 1, "a1"), path, "a")
    plain, raced = commits._commit, []

    def race(spark, path, number, found):
        if not raced:
            raced.append(number)
            commits.publish(rows(spark, 2, "b1"), path, "b")            # takes the number first
        return plain(spark, path, number, found)

    monkeypatch.setattr(commits, "_commit", race)
    commits.publish(rows(spark, 3, "a2"), path, "a")
    assert raced == [2] and content(spark, path) == {"a2": 3, "b1": 2}


def test_once_writes_again_what_was_not_finished(spark, tmpdir_path):
    done = []

    def write():
        done.append(1)
        if len(done) == 1:
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        commits.once(spark, f"{tmpdir_path}/m", write)
    for _ in range(3):
        assert commits.once(spark, f"{tmpdir_path}/m", write) == f"{tmpdir_path}/m"
    assert len(done) == 2

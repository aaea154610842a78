"""Tables that change in one step (IO5, IO6, IO12): data first, a one-file manifest last.

A table is a folder with ``data/<version>`` folders of Parquet and ``_manifests/<n>.json``.
A manifest lists, per key (a reference date, a run id), the version that holds its rows and
a metadata record; the one of largest number is the table.  Publishing writes a new
version, then commits manifest n + 1 by renaming a finished temporary file to its name, which
no other writer may have taken.  So readers see a key's old rows or its new ones, never a
part; a job that is killed before the rename leaves the table as it was, and repeating
it replaces its own key only.

Versions that neither the current nor the previous manifest names are dropped on the next
publish (a reader of the previous one may still be at work).  What a killed job wrote is named
by no manifest: ``orphans`` lists it, for a clean-up when no writer is running.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

ATTEMPTS = 20


def _at(spark: SparkSession, path: str):
    """(file system, Hadoop path)."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, place = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []


def _numbers(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(m[1]) for n in _names(spark, f"{path}/_manifests") if (m := re.fullmatch(r"(\d+)\.json", n)))


def _manifest(spark: SparkSession, path: str, number: int) -> dict:
    return json.loads(spark.read.text(f"{path}/_manifests/{number:09d}.json", wholetext=True).first()[0])


def is_committed(spark: SparkSession, path: str) -> bool:
    return bool(_numbers(spark, path))


def entries(spark: SparkSession, path: str) -> dict[str, dict]:
    """The current manifest: key to version, time and metadata; empty for a table never published."""
    numbers = _numbers(spark, path)
    return _manifest(spark, path, numbers[-1])["entries"] if numbers else {}


def _commit(spark: SparkSession, path: str, number: int, found: dict) -> bool:
    """Manifest ``number`` if nobody has taken that number."""
    fs, place = _at(spark, f"{path}/_manifests/{number:09d}.json")
    _, draft = _at(spark, f"{path}/_manifests/.{number:09d}-{uuid.uuid4().hex}")
    stream = fs.create(draft, False)
    stream.write(bytearray(json.dumps({"entries": found}, indent=1), "utf-8"))
    stream.close()
    done = not fs.exists(place) and fs.rename(draft, place)
    if not done:
        fs.delete(draft, False)
    return done


def publish(df: DataFrame, path: str, key: str, meta: dict | None = None, replace_all: bool = False) -> str:
    """Write ``df`` as the rows of ``key`` (``replace_all``: as the whole table); the version written."""
    spark = df.sparkSession
    version = f"{re.sub('[^A-Za-z0-9_.-]', '_', key)}-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/data/{version}")
    record = {"version": version, "committed": datetime.now(timezone.utc).isoformat(), "meta": meta or {}}
    for _ in range(ATTEMPTS):                 # another writer's commit in between keeps its keys
        numbers = _numbers(spark, path)
        before = _manifest(spark, path, numbers[-1])["entries"] if numbers else {}
        number = numbers[-1] + 1 if numbers else 1
        if _commit(spark, path, number, ({} if replace_all else before) | {key: record}):
            _drop_replaced(spark, path, number)
            return version
    raise RuntimeError(f"{path}: no manifest number was free in {ATTEMPTS} attempts")


def _drop_replaced(spark: SparkSession, path: str, number: int) -> None:
    """Versions named by manifest n - 2 but not by the last two; that manifest too."""
    if number < 3 or number - 2 not in _numbers(spark, path):
        return
    old, *recent = ({e["version"] for e in _manifest(spark, path, n)["entries"].values()} for n in (number - 2, number - 1, number))
    for version in old - recent[0] - recent[1]:
        fs, place = _at(spark, f"{path}/data/{version}")
        fs.delete(place, True)
    fs, place = _at(spark, f"{path}/_manifests/{number - 2:09d}.json")
    fs.delete(place, False)


def read(spark: SparkSession, path: str, keys: list[str] | None = None) -> DataFrame:
    """The table, or only the rows of some keys (other versions aren't opened)."""
    found = entries(spark, path)
    missing = [k for k in keys or [] if k not in found]
    if missing or not found:
        raise FileNotFoundError(f"{path} has no {', '.join(missing) or 'published version'}")
    return spark.read.parquet(*(f"{path}/data/{found[k]['version']}" for k in (keys or sorted(found))))


def orphans(spark: SparkSession, path: str) -> list[str]:
    """Versions that the last two manifests don't name."""
    named = {e["version"] for n in _numbers(spark, path)[-2:] for e in _manifest(spark, path, n)["entries"].values()}
    return [v for v in _names(spark, f"{path}/data") if v not in named]


def once(spark: SparkSession, folder: str, write: Callable[[], None]) -> str:
    """``folder``, filled by ``write`` unless that was done before; a marker is written last, so what a
    killed job left is written again."""
    fs, marker = _at(spark, f"{folder}/_complete")
    if not fs.exists(marker):
        write()
        fs.create(marker, True).close()
    return folder

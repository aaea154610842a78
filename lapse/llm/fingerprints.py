"""Document fingerprints by MinHash, compared with an edited text and the next document.

A text's set are its distinct shingles of ``width`` words (with fewer words, the whole
sequence); K universal hash functions (multiply-shift: the upper half of a * x + b modulo
2**64, a odd) each give their least value over the set, all in vectorised numpy.  The K
values in hex are the fingerprint; the share of equal values estimates the Jaccard
similarity of two sets, with a standard error of at most 0.5 / sqrt(K).

``neighbours`` needs, for each document, the next one in the order of ids.  Spark deals the
rows by ranges of the id (bounds from its quantile sketch, at most ``MOST_RANGES`` of them)
with one exchange of the texts; the first row of each range goes to the range before as
well, where it is only looked at, and the first of all to the last.  Each range is sorted
and streamed with one row of lookahead, so memory doesn't depend on a range's size.

``similar`` is the general search: signature bands of queries and documents are joined in
Spark, and pairs that share a band are verified on their full sets.  Equal texts meet once.
``neighbours`` decides its fixed pairs in the same way in place: where a band is shared, the
exact similarity is given.

Null text counts as empty; two empty sets have likeness 1, an empty and another 0.  Rows
without an id have no place in the order: their next text is empty and they are nobody's
next.  Rows of one id are ordered by text; equal rows stand next to each other.  Empty
tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapse.llm.common import column_bytes, drop_dir, map_batches, mix64, prefix_hash, slices, span_hash, texts, words, work_dir, written

WIDTH, HASHES, ROWS, SLICE = 5, 128, 4, 1 << 20
RANGE_BYTES, LEAST_RANGES, MOST_RANGES = 16 << 20, 32, 4096
_EMPTY = np.uint32(0xFFFFFFFF)
NEIGHBOURS = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double, edited_jaccard double, next_jaccard double")


def shingle_hashes(offsets: np.ndarray, data: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(32-bit hashes of all shingles of all texts, first index of each text; n + 1 entries)."""
    start, end, row = words(offsets, data)
    word = span_hash(prefix_hash(data), start, end)
    count = np.bincount(row, minlength=len(offsets) - 1)
    size = np.where(count >= width, count - width + 1, (count > 0).astype(np.int64))
    first, begin = (np.concatenate([[0], np.cumsum(x)]) for x in (count, size))
    place = np.arange(begin[-1]) - np.repeat(begin[:-1] - first[:-1], size)
    span = np.repeat(np.minimum(count, width), size)
    out = mix64(span.astype(np.uint64))
    for k in range(width):
        use = span > k
        out[use] = mix64(out[use] * np.uint64(0x9E3779B97F4A7C55) + word[place[use] + k])
    return out >> np.uint64(32), begin


def coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Fixed multipliers (odd) and summands of n hash functions."""
    i = np.arange(1, n + 1, dtype=np.uint64)
    return mix64(i * np.uint64(3)) | np.uint64(1), mix64(i * np.uint64(3) + np.uint64(1))


def signatures(offsets: np.ndarray, data: np.ndarray, width: int = WIDTH, hashes: int = HASHES) -> np.ndarray:
    """Least values (texts x hashes, uint32); all ones for a text without words."""
    n = len(offsets) - 1
    out = np.full((n, hashes), _EMPTY, np.uint32)
    parts = list(slices(offsets, SLICE))
    for a, b in parts:
        x, begin = shingle_hashes(offsets[a:b + 1] - offsets[a], data[offsets[a]:offsets[b]], width)
        full = np.flatnonzero(np.diff(begin))
        if len(full):
            value = np.empty_like(x)
            for k, (m, s) in enumerate(zip(*coefficients(hashes))):
                np.multiply(x, m, out=value)
                value += s
                out[a + full, k] = np.minimum.reduceat(value, begin[full]) >> np.uint64(32)
    return out


def text_signatures(batch: list[str], width: int, hashes: int) -> np.ndarray:
    return signatures(*column_bytes(pa.array(batch, pa.large_string())), width, hashes)


def hexed(signature: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in signature.astype(">u4")]


def shingle_set(text: str, width: int) -> set[bytes]:
    found = text.encode().split()
    return {b" ".join(found[i:i + width]) for i in range(max(len(found) - width + 1, min(len(found), 1)))}


def jaccard(a: set, b: set) -> float:
    """Similarity of two full sets; two empty sets are alike."""
    common = len(a & b)
    return common / (len(a) + len(b) - common) if a or b else 1.0


def shares_band(a: np.ndarray, b: np.ndarray, rows: int = ROWS) -> np.ndarray:
    return (a == b).reshape(len(a), -1, rows).all(axis=2).any(axis=1)


def fingerprints(docs: DataFrame, width: int = WIDTH, hashes: int = HASHES, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint; one row per input row, nothing shuffled."""
    def run(batch):
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(hexed(signatures(*column_bytes(batch.column(1)), width, hashes)), pa.string())],
            ["doc_id", "fingerprint"])
    return map_batches(texts(docs, id_col, text_col), run, "doc_id long, fingerprint string")


def ranges(rows: DataFrame) -> tuple[list[int], int | None]:
    """(first ids of all ranges but the lowest, the least id); each is an id of the table."""
    size, = rows.agg(F.sum(F.octet_length("text"))).first()
    n = min(max((size or 0) // RANGE_BYTES, LEAST_RANGES), MOST_RANGES)
    found = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20 * n).alias("q"), F.min("doc_id").alias("least")).first()
    return sorted(set(found["q"] or []) - {found["least"]}), found["least"]


def dealt(rows: DataFrame) -> DataFrame:
    """(part, kind, doc_id, text): the rows by ranges, sorted within each.  kind 0: a row; 1: a row
    of the range after, only to be looked at; 2: a row without an id, alone."""
    bounds, least = ranges(rows)
    limits, parts = np.array(bounds, np.int64), len(bounds) + 1

    @F.pandas_udf("int")
    def place(ids: pd.Series) -> pd.Series:
        """Twice the range, plus one for a range's first id."""
        part = np.searchsorted(limits, ids.to_numpy(np.int64), side="right")
        low = np.concatenate([[least if least is not None else 0], limits])[part]
        return pd.Series(2 * part + (ids.to_numpy(np.int64) == low))

    at = F.col("__at")
    part = F.floor(at / 2).cast("int")
    before = F.pmod(part - 1, F.lit(parts)).cast("int")
    own, guest = F.struct(part.alias("part"), F.lit(0).alias("kind")), F.struct(before.alias("part"), F.lit(1).alias("kind"))
    listed = (rows.where("doc_id is not null").withColumn("__at", place("doc_id"))
              .withColumn("__to", F.when(at % 2 == 1, F.array(own, guest)).otherwise(F.array(own))))
    listed = listed.select(F.explode("__to").alias("__to"), "doc_id", "text").select("__to.part", "__to.kind", "doc_id", "text")
    alone = rows.where("doc_id is null").select(F.pmod(F.xxhash64("text"), F.lit(parts)).cast("int").alias("part"),
                                                F.lit(2).alias("kind"), "doc_id", "text")
    return (listed.unionByName(alone).repartitionById(parts, "part")
            .sortWithinPartitions("part", "kind", "doc_id", "text"))


def compared(rows: list[tuple[int | None, str, str]], chain: bool, width: int, hashes: int) -> pa.RecordBatch:
    """Result rows of (doc_id, text, next text).  In a chain each next text is the following
    row's; otherwise all are empty."""
    own = [r[1] for r in rows]
    edited = [t[:len(t) - len(t) // 2] + after[:len(t) // 2] for _, t, after in rows]
    prints, other = text_signatures(own, width, hashes), text_signatures(edited, width, hashes)
    after = np.full_like(prints, _EMPTY)
    if chain:
        after = np.vstack([prints[1:], text_signatures([rows[-1][2]], width, hashes)])
    exact = []
    for versions, signature in ((edited, other), ([r[2] for r in rows], after)):
        exact.append([jaccard(shingle_set(own[i], width), shingle_set(versions[i], width)) if shared else None
                      for i, shared in enumerate(shares_band(prints, signature))])
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([len(t) for t in own], pa.int64()),
         pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]), pa.array(hexed(prints)), pa.array(hexed(other)),
         pa.array((prints == other).mean(axis=1)), pa.array((prints == after).mean(axis=1)),
         pa.array(exact[0], pa.float64()), pa.array(exact[1], pa.float64())],
        [f.split()[0] for f in NEIGHBOURS.split(", ")])


def neighbours(docs: DataFrame, width: int = WIDTH, hashes: int = HASHES, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """Per row: n_chars, the edited text's digest, both fingerprints, their likeness, that to the
    next document's, and the exact similarities where a signature band is shared (else null).

    The edited text's last floor(n_chars / 2) code points are the first as many (or all) of
    the next document, by ascending id; after the last comes the first."""
    def settled(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        """Results of all rows but the last; rows: (part, kind, doc_id, text)."""
        chain, alone = [], []
        for one, after in zip(rows, rows[1:]):
            if one[1] == 0:
                chain.append((one[2], one[3], after[3]))
                if after[1] != 0:         # the next range's first row
                    yield compared(chain, True, width, hashes)
                    chain = []
            elif one[1] == 2:
                alone.append((one[2], one[3], ""))
        for part, linked in ((chain, True), (alone, False)):
            if part:
                yield compared(part, linked, width, hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0                # the first of these waits for its next row
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                held.append(row)
                size += len(row[3])
                if size > SLICE and len(held) > 1:
                    yield from settled(held)
                    held, size = held[-1:], len(row[3])
        yield from settled([*held, (None, 1, None, "")])

    return dealt(texts(docs, id_col, text_col)).mapInArrow(run, NEIGHBOURS)


def similar(queries: DataFrame, docs: DataFrame, threshold: float = 0.8, width: int = WIDTH, hashes: int = HASHES,
            rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(query_id, doc_id, jaccard) of all documents whose full set has at least that similarity to
    a query's.  Equal texts are searched once and expanded at the end; texts without words
    are linked with nothing.

    The result, and so the work, grows with the number of links of the query set, which the
    caller states.  With bands of 4 of 128 values a link at 0.8 is missed with probability 5e-8."""
    spark = docs.sparkSession
    folder = work_dir(spark, "similar")
    sides = []
    for name, side in (("queries", queries), ("docs", docs)):
        members = written(texts(side, id_col, text_col).withColumn("text_id", F.sha2(F.col("text").cast("binary"), 256)),
                          f"{folder}/{name}")
        sides.append((members.select("doc_id", "text_id"), members.groupBy("text_id").agg(F.first("text").alias("text"))))

    def bands(batch):
        signature = signatures(*column_bytes(batch.column(1)), width, hashes)
        some = np.flatnonzero((signature != _EMPTY).any(axis=1))
        number = np.tile(np.arange(hashes // rows), len(some))
        value = [v.tobytes() for v in np.ascontiguousarray(signature[some]).reshape(-1, rows)]
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(np.repeat(some, hashes // rows))), pa.array(number, pa.int64()), pa.array(value, pa.binary())],
            ["text_id", "band", "value"])

    keyed = [map_batches(t, bands, "text_id string, band long, value binary") for _, t in sides]
    pairs = (keyed[0].withColumnRenamed("text_id", "q").join(keyed[1].withColumnRenamed("text_id", "d"), ["band", "value"])
             .select("q", "d").distinct())
    pairs = (written(pairs, f"{folder}/pairs").join(sides[0][1].toDF("q", "query_text"), "q").join(sides[1][1].toDF("d", "text"), "d"))

    def verify(batch):
        exact = np.array([jaccard(shingle_set(a, width), shingle_set(b, width))
                          for a, b in zip(batch["query_text"].to_pylist(), batch["text"].to_pylist())])
        keep = pa.array(exact >= threshold)
        return pa.RecordBatch.from_arrays([batch["q"], batch["d"], pa.array(exact)], ["q", "d", "jaccard"]).filter(keep)

    links = map_batches(pairs, verify, "q string, d string, jaccard double")
    found = (links.join(sides[0][0].toDF("query_id", "q"), "q").join(sides[1][0].toDF("doc_id", "d"), "d")
             .select("query_id", "doc_id", "jaccard"))
    found = written(found, f"{folder}/links")
    for name in ("queries", "docs", "pairs"):
        drop_dir(spark, f"{folder}/{name}")
    return found

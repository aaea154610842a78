"""Hard-negative mining with Strassen products of anchor and candidate tiles.

Scores are integer inner products.  Work is a grid of (group, block of anchors, lane of
candidates) cells: anchors are dealt to blocks of about ``block`` rows by hash, candidates to
a fixed number of lanes.  Each cell is one sorted stream, anchors first and then candidates,
so a task holds one block of anchors, one tile of candidates and the heaps of that block,
whatever the tables' sizes.  A label of a third of all rows has more blocks, not larger
ones; a cell's candidates are streamed.

1. Positives: the groups are the labels, so anchors only meet candidates of their label.
   Each cell keeps the first ``positives`` scores per anchor.
2. Negatives: one group.  Per anchor and positive each cell keeps the first ``negatives``
   scores of other labels within the window of the positive's score.

Tiles are multiplied by Strassen's recursion on int64, odd sides padded with zeros.  Its
additions are exact modulo 2**64, so results are exact while scores stay below 2**56.
Heaps of the cells hold at most ``positives`` or ``negatives`` entries per anchor and lane
and are merged by a window that Spark cuts to that rank before its shuffle; merging in any
order gives the same rows.

Rows with a null id, label or vector, or with a null or non-finite component, take no part.
Rows equal in id, label and vector count once; other rows of one id are rows of their own
(as anchors too), and never each other's positives.  Shorter vectors count as padded with
zeros.  Ties go to the smaller id.  Empty tables and anchors without positives give no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapse.llm.common import drop_dir, work_dir, written

LEAF, BLOCK, LANES, TILE = 32, 1024, 64, 1024
NONE = -(1 << 62)                        # below every score
_CELL = ["group", "block", "lane"]
_STREAM = "group long, block int, lane int, kind int, key long, id long, label long, vector array<long>, positives array<long>"


def product(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """``a @ b`` of int64 matrices by Strassen's seven products."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    if m % 2 or k % 2 or n % 2:
        return product(np.pad(a, ((0, m % 2), (0, k % 2))), np.pad(b, ((0, k % 2), (0, n % 2))), leaf)[:m, :n]
    r, s, t = m // 2, k // 2, n // 2
    a11, a12, a21, a22 = a[:r, :s], a[:r, s:], a[r:, :s], a[r:, s:]
    b11, b12, b21, b22 = b[:s, :t], b[:s, t:], b[s:, :t], b[s:, t:]
    m1 = product(a11 + a22, b11 + b22, leaf)
    m2 = product(a21 + a22, b11, leaf)
    m3 = product(a11, b12 - b22, leaf)
    m4 = product(a22, b21 - b11, leaf)
    m5 = product(a11 + a12, b22, leaf)
    m6 = product(a21 - a11, b11 + b12, leaf)
    m7 = product(a12 - a22, b21 + b22, leaf)
    out = np.empty((m, n), np.int64)
    out[:r, :t] = m1 + m4 - m5 + m7
    out[:r, t:] = m3 + m5
    out[r:, :t] = m2 + m4
    out[r:, t:] = m1 - m2 + m3 + m6
    return out


def matrix(column: pa.Array, dims: int = 0) -> np.ndarray:
    """Rows of an array<long> column, short ones padded with zeros (to ``dims`` at least)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), max(dims, int(sizes.max(initial=0)))), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = column.flatten().to_numpy()
    return out


class Heaps:
    """Per row of a block the first ``n`` (score, id) by score, larger first, then id."""

    def __init__(self, rows: int, n: int):
        self.n = n
        self.score, self.id = np.full((rows, n), NONE, np.int64), np.zeros((rows, n), np.int64)

    def push(self, score: np.ndarray, ids: np.ndarray) -> None:
        """Scores (rows x candidates, NONE where ruled out); ids ascending."""
        rows = np.flatnonzero((score > NONE).any(axis=1) & (score.max(axis=1) >= self.score[:, -1]))
        if len(rows):
            first = np.argsort(-score[rows], axis=1, kind="stable")[:, :self.n]
            scores = np.hstack([self.score[rows], np.take_along_axis(score[rows], first, 1)])
            found = np.hstack([self.id[rows], ids[first]])
            best = np.lexsort((found, -scores), axis=1)[:, :self.n]
            self.score[rows], self.id[rows] = np.take_along_axis(scores, best, 1), np.take_along_axis(found, best, 1)


class Cell:
    """A block of anchors against a stream of candidates."""

    def __init__(self, anchors: pa.Table, n: int, window: tuple[int, int] | None):
        self.key, self.id = anchors["key"].to_numpy(), anchors["id"].to_numpy()
        self.label, self.vectors = anchors["label"].to_numpy(), matrix(anchors["vector"])
        self.window = window
        wanted = [list(dict.fromkeys(p or [])) for p in anchors["positives"].to_pylist()] if window else [[]] * len(self.key)
        self.positives = [np.array([p[k] if len(p) > k else NONE for p in wanted], np.int64)
                          for k in range(max(map(len, wanted), default=0))]
        self.heaps = [Heaps(len(self.key), n) for _ in (self.positives if window else (0,))]

    def meet(self, tile: pa.RecordBatch) -> None:
        order = np.argsort(tile["id"].to_numpy(), kind="stable")
        ids, label = tile["id"].to_numpy()[order], tile["label"].to_numpy()[order]
        vectors = matrix(tile["vector"], self.vectors.shape[1])[order]
        anchors = np.pad(self.vectors, ((0, 0), (0, vectors.shape[1] - self.vectors.shape[1])))
        score = product(anchors, np.ascontiguousarray(vectors.T))
        same = self.label[:, None] == label
        if not self.window:
            self.heaps[0].push(np.where(same & (self.id[:, None] != ids), score, NONE), ids)
            return
        low, high = self.window
        score = np.where(same, NONE, score)
        hundred = np.where(same, 0, score) * 100
        for positive, heap in zip(self.positives, self.heaps):
            p = np.where(positive > NONE, positive, 0)[:, None]
            within = (low * p <= hundred) & (hundred <= high * p) & (positive > NONE)[:, None]
            heap.push(np.where(within, score, NONE), ids)

    def rows(self) -> pa.RecordBatch | None:
        parts = []
        for k, heap in enumerate(self.heaps):
            at, rank = np.nonzero(heap.score > NONE)
            positive = self.positives[k][at] if self.window else np.zeros(len(at), np.int64)
            parts.append((self.key[at], positive, heap.score[at, rank], heap.id[at, rank]))
        if sum(len(p[0]) for p in parts):
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], ["key", "positive", "score", "id"])


def heaps(anchors: DataFrame, candidates: DataFrame, group: Column, n: int, folder: str,
          window: tuple[int, int] | None = None, block: int = BLOCK, lanes: int = LANES) -> DataFrame:
    """(key, positive, score, id): the first ``n`` candidates per anchor (and, with ``window``, per
    distinct score in its ``positives``).  anchors: key, id, label, vector, positives; candidates:
    id, label, vector; only rows of one ``group`` meet.  The number of blocks per group is
    written to ``folder`` first: Spark broadcasts it if its size allows that."""
    anchors, candidates = anchors.withColumn("group", group), candidates.withColumn("group", group)
    blocks = written(anchors.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")), folder)
    numbers = F.sequence(F.lit(0), F.lit(lanes - 1))
    left = (anchors.join(blocks, "group").withColumn("block", F.pmod("key", "blocks").cast("int"))
            .select("group", "block", F.explode(numbers).alias("lane"), F.lit(0).alias("kind"), "key", "id", "label",
                    "vector", "positives"))
    right = (candidates.join(blocks, "group")
             .select("group", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
                     F.pmod(F.xxhash64("id", "label", "vector"), F.lit(lanes)).cast("int").alias("lane"), F.lit(1).alias("kind"),
                     F.lit(0).cast("long").alias("key"), "id", "label", "vector",
                     F.lit(None).cast("array<long>").alias("positives")))
    stream = left.unionByName(right).repartition(*_CELL).sortWithinPartitions(*_CELL, "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, waiting, cell = None, [], None

        for batch in batches:
            marks = np.stack([batch.column(i).to_numpy() for i in range(4)], axis=1)
            cuts = np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
                if a == b:
                    continue
                here = tuple(marks[a][:3])
                if here != name:
                    if cell and (out := cell.rows()):
                        yield out
                    name, waiting, cell = here, [], None
                if marks[a][3] == 0:
                    waiting.append(batch.slice(a, b - a))
                    continue
                if cell is None and waiting:
                    cell, waiting = Cell(pa.Table.from_batches(waiting), n, window), []
                for at in range(a, b, TILE) if cell else ():
                    cell.meet(batch.slice(at, min(TILE, b - at)))
        if cell and (out := cell.rows()):
            yield out

    found = stream.mapInArrow(run, "key long, positive long, score long, id long")
    rank = F.row_number().over(Window.partitionBy("key", "positive").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= n)


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5,
                   window: tuple[int, int] = (80, 100), block: int = BLOCK, lanes: int = LANES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows: id, label, vector (array<long>) as ``integer_rows`` gives them; ``is_anchor`` is a
    condition on them.  A negative's score lies within ``window`` per cent of its positive's."""
    spark = rows.sparkSession
    folder = work_dir(spark, "hard-negatives")
    rows = written(rows.select("id", "label", "vector").distinct(), f"{folder}/rows")
    anchors = written(rows.where(is_anchor).withColumn("key", F.monotonically_increasing_id()), f"{folder}/anchors")
    first = heaps(anchors.withColumn("positives", F.lit(None).cast("array<long>")), rows, F.col("label"), positives,
                  f"{folder}/label-blocks", block=block, lanes=lanes)
    chosen = written(first.select("key", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), f"{folder}/positives")
    wanted = chosen.groupBy("key").agg(F.sort_array(F.collect_list("positive_score")).alias("positives"))
    found = heaps(anchors.join(wanted, "key"), rows, F.lit(0).cast("long"), negatives, f"{folder}/blocks", window, block, lanes)
    found = found.select("key", F.col("positive").alias("positive_score"), "rank", F.col("id").alias("negative_id"),
                         F.col("score").alias("negative_score"))
    out = (anchors.select("key", F.col("id").alias("anchor_id")).join(chosen, "key").join(found, ["key", "positive_score"])
           .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
    out = written(out, f"{folder}/out")
    for part in ("rows", "anchors", "positives", "label-blocks", "blocks"):
        drop_dir(spark, f"{folder}/{part}")
    return out


def integer_rows(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None,
                 scale: int = 256) -> DataFrame:
    """id, label, vector with components floor(scale * x); rows that take no part are left out."""
    x = F.transform(F.col(vector_col), lambda e: e.cast("double"))
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    return (table.select(F.col(id_col).cast("long").alias("id"), (F.col("label") if label is None else label).cast("long").alias("label"),
                         x.alias("x"), finite.alias("finite"))
            .where("id is not null and label is not null and x is not null and coalesce(finite, false)")
            .select("id", "label", F.transform("x", lambda e: F.floor(F.lit(float(scale)) * e).cast("long")).alias("vector")))


def mined(table: DataFrame) -> DataFrame:
    """The registered query's fixed rules: labels of every seventh id moved on by one, anchors of
    ids divisible by 100, five positives, five negatives, window 80 to 100 per cent."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(integer_rows(table, label=moved), F.col("id") % 100 == 0)

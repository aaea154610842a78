"""Runs of periodic word sequences by descending-LCP Kruskal.

A run is a stretch of words with smallest period q (words q apart are equal), at least
``least_length`` words and ``least_exponent`` periods long, that no neighbouring word
extends.  Per text:

1. Words are numbered by a dictionary of their bytes, so equality is exact.  A run holds
   two equal windows of ``least_depth`` words a period apart; texts without a repeated
   window (found by hash, confirmed by the order that follows) hold no run.
2. The suffixes of the other texts are ordered by prefix doubling, and neighbours' longest
   common prefixes (LCP) follow by one scan in text order.
3. Neighbours are united by decreasing LCP: a union-find keeps, per class, the ordered set
   of its positions, and the smaller set goes into the larger.  Two positions i < j that
   become adjacent in a set at depth L have LCP exactly L.  If j - i <= L, words i to j + L
   have smallest period j - i: a smaller one would put a position between them.  They seed
   a run, whose right end is known; it is the run itself if the word before breaks the
   period.  Every run is found once, at its first position and the one a period later.

One text is the work of one task (slices of 1 MB, a longer text alone); nothing is
shuffled.  Memory is about 60 bytes per word of the texts that hold repeated windows.

Null text counts as no words; null and repeated ids keep a row each; texts that are equal
give equal runs; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapse.llm.common import column_bytes, map_batches, mix64, slices, texts, words

LEAST_LENGTH, LEAST_EXPONENT = 24, 3
SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
_RUN = pa.list_(pa.struct([(f, pa.int64()) for f in ("start", "length", "period")]))
_BLOCK, _CHUNK = 1024, 65_536

#: From a row's id and its number of words to the word that stands at each place (None: unchanged).
Edit = Callable[["int | None", int], "np.ndarray | None"]


def least_depth(length: int, exponent: int) -> int:
    """The least LCP of the first two periods of any run of this length and exponent."""
    q = length // exponent
    return min(length - q, (exponent - 1) * (q + 1))


class Positions:
    """An ordered set of positions in blocks of bounded size."""

    __slots__ = ("blocks", "lows", "size")

    def __init__(self, ordered: list[int]):
        self.blocks, self.lows, self.size = [ordered], [ordered[0]], len(ordered)

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block

    def around(self, x: int) -> tuple[int, int]:
        """The positions next to x on both sides, -1 where there is none."""
        b = max(bisect_right(self.lows, x) - 1, 0)
        block = self.blocks[b]
        at = bisect_left(block, x)
        after = block[at] if at < len(block) else self.lows[b + 1] if b + 1 < len(self.lows) else -1
        return block[at - 1] if at else -1, after

    def add(self, x: int) -> None:
        b = max(bisect_right(self.lows, x) - 1, 0)
        block = self.blocks[b]
        insort(block, x)
        self.lows[b] = block[0]
        self.size += 1
        if len(block) > 2 * _BLOCK:
            self.blocks[b:b + 1] = [block[:_BLOCK], block[_BLOCK:]]
            self.lows.insert(b + 1, block[_BLOCK])


def unite(order: list[int], depths: list[int], positions: list[int], seed: Callable[[int, int, int], None]) -> None:
    """Unite the classes of neighbouring suffixes ``t`` and ``t + 1`` for t in ``order`` (by
    decreasing depth); ``seed(i, j, depth)`` gets every newly adjacent pair i < j."""
    parent = array("q", range(len(positions)))
    held: dict[int, Positions] = {}      # classes of one position aren't stored

    def root(t: int) -> int:
        while parent[t] != t:
            parent[t] = parent[parent[t]]
            t = parent[t]
        return t

    for t in order:
        depth, a, b = depths[t], root(t), root(t + 1)
        one, two = held.get(a), held.get(b)
        if (one.size if one else 1) < (two.size if two else 1):
            a, b, one, two = b, a, two, one
        parent[b] = a
        if one is None:
            i, j = positions[a], positions[b]
            i, j = (i, j) if i < j else (j, i)
            seed(i, j, depth)
            held[a] = Positions([i, j])
            continue
        added = [positions[b]] if two is None else list(held.pop(b))
        last = len(added) - 1
        for k, x in enumerate(added):     # adjacent in the union: nothing of the same set between
            before, after = one.around(x)
            if before >= 0 and (not k or added[k - 1] < before):
                seed(before, x, depth)
            if after >= 0 and (k == last or added[k + 1] > after):
                seed(x, after, depth)
        for x in added:
            one.add(x)


def suffix_order(sequence: np.ndarray, row: np.ndarray, ends: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions whose first ``window`` words, a power of two, occur again in their row, in the
    order of their suffixes; the rank of these words)."""
    key = row.astype(np.int64) * (int(sequence.max(initial=0)) + 1) + sequence
    order = np.argsort(key, kind="stable")
    rank = np.empty(len(key), np.int64)
    first = second = key[order]
    again = shared = order[:0]
    width, base = 0, np.zeros(len(order), np.int64)
    while len(order):
        new = np.ones(len(order), bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        group = np.ones(len(order), bool)
        if width:
            group[1:] = first[1:] != first[:-1]
        else:
            group[1:] = False
        at = np.arange(len(order))
        rank[order] = base + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
        single = new & np.append(new[1:], True)
        order = order[~single]
        width = 2 * width or 1
        if width == window:
            again, shared = order, rank[order].copy()
        first = rank[order]
        ahead = order + width
        inside = ahead < ends[order]
        second = np.where(inside, rank[np.where(inside, ahead, 0)] + 1, 0)
        inner = np.lexsort((second, first))
        order, first, second = order[inner], first[inner], second[inner]
        base = first
    inner = np.argsort(rank[again])
    return again[inner], shared[inner]


def common_prefixes(sequence: np.ndarray, ends: np.ndarray, ordered: np.ndarray, shared: np.ndarray, window: int) -> np.ndarray:
    """LCP of each ordered suffix with the next one, 0 where it is below ``window``."""
    n = len(ordered)
    same = shared[1:] == shared[:-1]
    before = np.full(len(sequence), -1, np.int64)
    before[ordered[1:][same]] = ordered[:-1][same]
    lcp = np.zeros(len(sequence), np.int64)
    word, stop, back, out = memoryview(sequence), memoryview(ends), memoryview(before), memoryview(lcp)
    follows, depth = -2, 0
    for i in np.sort(ordered[1:][same]).tolist():
        j = back[i]
        depth = max(depth - 1, window) if i == follows else window
        most = min(stop[i] - i, stop[j] - j)
        while depth < most and word[i + depth] == word[j + depth]:
            depth += 1
        out[i], follows = depth, i + 1
    found = np.zeros(max(n - 1, 0), np.int64)
    found[same] = lcp[ordered[1:][same]]
    return found


def find_runs(sequence: np.ndarray, bounds: np.ndarray, length: int = LEAST_LENGTH,
              exponent: int = LEAST_EXPONENT) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every run of each row ``sequence[bounds[r]:bounds[r + 1]]`` of
    word numbers (int32), by start, then period."""
    runs: list[list[tuple[int, int, int]]] = [[] for _ in range(len(bounds) - 1)]
    depth = least_depth(length, exponent)
    window = 1 << depth.bit_length() - 1
    rows = repeating(sequence, bounds, window)
    if not len(rows):
        return runs
    sizes = np.diff(bounds)[rows]
    limits = np.concatenate([[0], np.cumsum(sizes)])
    row = np.repeat(np.arange(len(rows)), sizes)
    part = sequence[np.arange(len(row)) + (bounds[rows] - limits[:-1])[row]]
    ends = limits[1:][row]
    ordered, shared = suffix_order(part, row, ends, window)
    lcp = common_prefixes(part, ends, ordered, shared, window)
    order = np.argsort(-lcp, kind="stable")
    order = order[lcp[order] >= depth]
    word, heads = memoryview(part), set(limits[:-1].tolist())

    def seed(i: int, j: int, common: int) -> None:
        period = j - i
        if (period <= common and period * (exponent - 1) <= common and period + common >= length
                and (i in heads or word[i - 1] != word[j - 1])):
            runs[rows[row[i]]].append((i - int(limits[row[i]]), period + common, period))

    unite(order.tolist(), lcp.tolist(), ordered.tolist(), seed)
    return [sorted(x, key=lambda run: (run[0], run[2])) for x in runs]


def repeating(sequence: np.ndarray, bounds: np.ndarray, window: int) -> np.ndarray:
    """Rows in which a window of that many words (a power of two) occurs twice, by hash."""
    if len(sequence) < window:
        return np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    hashed, width = mix64(sequence.astype(np.uint64) + np.uint64(1)), 1
    while width < window:                 # each doubling is mixed, so no sum of words cancels out
        hashed = mix64(hashed[:-width] * np.uint64(0x9E3779B97F4A7C55) + hashed[width:])
        width *= 2
    inside = np.flatnonzero(np.arange(len(hashed)) + window <= bounds[1:][row[:len(hashed)]])
    key = mix64(hashed[inside] ^ mix64(row[inside].astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    return np.unique(row[inside[order[1:][key[order[1:]] == key[order[:-1]]]]])


def numbered(raw: bytes, start: np.ndarray, end: np.ndarray, table: defaultdict) -> np.ndarray:
    out = np.empty(len(start), np.int32)
    for a in range(0, len(start), _CHUNK):
        spans = map(slice, start[a:a + _CHUNK].tolist(), end[a:a + _CHUNK].tolist())
        out[a:a + _CHUNK] = np.fromiter(map(table.__getitem__, map(raw.__getitem__, spans)), np.int32, len(out[a:a + _CHUNK]))
    return out


def joined(raw: bytes, start: np.ndarray, end: np.ndarray) -> bytes:
    """The words with one space between."""
    return b" ".join(b" ".join(map(raw.__getitem__, map(slice, start[a:a + _CHUNK].tolist(), end[a:a + _CHUNK].tolist())))
                     for a in range(0, len(start), _CHUNK))


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words no run holds after its first period."""
    step = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    return np.cumsum(step[:n]) == 0


def tiled(doc_id: int | None, n: int) -> np.ndarray | None:
    """Fixed rule of the registered query: a tenth of the documents (by checksum of the id)
    repeats its words from a place on with a period; without an id nothing changes."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    source = np.arange(n)
    source[a:] = a + (source[a:] - a) % p
    return source


def periodic_runs(docs: DataFrame, length: int = LEAST_LENGTH, exponent: int = LEAST_EXPONENT, edit: Edit | None = None,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (by start, then period), collapsed (the words outside of runs and
    those of their first periods, one space between); one row per input row."""
    def run(batch):
        offsets, data = column_bytes(batch.column(1))
        ids, n_words, found, collapsed = batch.column(0).to_pylist(), [], [], []
        for a, b in slices(offsets, 1 << 20):
            start, end, row = words(offsets[a:b + 1] - offsets[a], data[offsets[a]:offsets[b]])
            raw, table = data[offsets[a]:offsets[b]].tobytes(), defaultdict()
            table.default_factory = table.__len__
            bounds = np.searchsorted(row, np.arange(b - a + 1))
            if edit:
                for i in range(a, b):
                    s = slice(bounds[i - a], bounds[i - a + 1])
                    if (source := edit(ids[i], int(s.stop - s.start))) is not None:
                        start[s], end[s] = start[s][source], end[s][source]
            runs = find_runs(numbered(raw, start, end, table), bounds, length, exponent)
            for lo, hi, own in zip(bounds[:-1], bounds[1:], runs):
                keep = slice(lo, hi) if not own else lo + np.flatnonzero(kept_words(hi - lo, own))
                n_words.append(hi - lo)
                collapsed.append(joined(raw, start[keep], end[keep]))
                found.append([dict(zip(("start", "length", "period"), r)) for r in own])
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n_words, pa.int64()), pa.array(found, _RUN),
             pa.array(collapsed, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return map_batches(texts(docs, id_col, text_col), run, SCHEMA)


def greatest(runs: Column) -> Column:
    """The run of greatest exact length/period (ties: smallest start, then period), null if none."""
    def better(a: Column, b: Column) -> Column:
        left, right = a["length"] * b["period"], b["length"] * a["period"]
        return (left > right) | ((left == right) & (F.struct(a["start"], a["period"]) < F.struct(b["start"], b["period"])))
    return F.reduce(runs, F.try_element_at(runs, F.lit(1)), lambda best, r: F.when(better(r, best), r).otherwise(best))


def run_digests(docs: DataFrame, edit: Edit | None = tiled, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_runs, the greatest run, and digests of all runs and of the collapsed text."""
    line = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","),
                                                  r["period"].cast("string"), F.lit("\n")))
    best = F.col("best")
    return (periodic_runs(docs, edit=edit, id_col=id_col, text_col=text_col).withColumn("best", greatest(F.col("runs")))
            .select("doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"),
                    best["length"].alias("length"), best["period"].alias("period"),
                    F.expr("1000 * best.length div best.period").alias("exponent_milli"),
                    F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"),
                    F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"), "n_words"))

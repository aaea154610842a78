"""Removal of repeated 200-byte strings by prefix-free parsing.

*Parse.*  A rolling hash of every ``gram`` bytes is taken over each text.  The trigger of
a ``window``-byte string is its gram of least hash (the leftmost of equals), so equal
strings have their trigger at the same place.  The window starts that share a trigger
are one phrase: the bytes from the first start to the end of the last window.
Consecutive phrases overlap by ``window`` - 1 bytes, so no phrase is a prefix of
another's continuation and every window of the corpus lies in exactly one phrase.  A
phrase is known by its trigger gram's hash and its own.

*Dictionary.*  Phrases that occur again (counted over the parse) are
repeated whole, whatever the number of copies: for highly repetitive text that settles
nearly all.  What is left are distinct phrases of one trigger gram, one representative
text each.  Those that may share a window (equal hashes, a filter) are put in suffix
order: prefix doubling on their bytes ranks the first ``window`` bytes of every suffix,
and neighbours of equal rank, with a common prefix of ``window`` bytes or more, are windows that
occur again.  Bytes decide, not hashes.

The orders are those of the groups that a trigger makes, which hold all equal windows; they
aren't merged to one order of the corpus, and no suffix array of the parse is needed, as
every window lies whole in one phrase.

Only hashes of phrases are shuffled, plus texts of documents that hold representatives
or something to remove.  Trigger grams with over ``block`` distinct phrases aren't
gathered: their windows are counted by gram and hash with partial sums (about 124 bits).
Phrases of one dictionary entry are told apart by the hashes of gram and phrase (the same).
Texts of over ``SLICE`` bytes are parsed in pieces that overlap by ``window`` - 1 bytes, so
memory doesn't grow with a text's length beyond its bytes and one mark per byte.

Null text counts as empty; texts shorter than a window lose nothing; repeated rows
are copies of each other; null ids are kept; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapse.llm.common import column_bytes, drop_dir, map_batches, mix64, prefix_hash, slices, span_hash, texts, work_dir, written

WINDOW, GRAM, BLOCK, SLICE, GROUP = 200, 32, 4096, 1 << 20, 1 << 20
_PLACE = np.uint64((1 << 28) - 1)


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive keys."""
    n = len(keys) - width + 1
    blocks = -(-len(keys) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(keys)] = keys
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1:width - 1 + n])


def gram_hashes(data: np.ndarray, gram: int, part: int = 1 << 16) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes at every place: bytes are read eight at a time and pairs of
    hashes mixed to those of twice the width, so no two contents cancel out by their form."""
    n, first = len(data) - gram + 1, min(gram, 8)
    out = np.empty(max(n, 0), np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    for at in range(0, n, part):
        size = min(part, n - at) + gram - first
        eight = np.ndarray((size,), "<u8", padded, at, (1,))
        h = mix64((eight << np.uint64(64 - 8 * first)) + np.uint64(first))
        width = first
        while width < gram:
            step = min(width, gram - width)
            h = mix64(h[:-step] * np.uint64(0x9E3779B97F4A7C55) + h[step:])
            width += step
        out[at:at + part] = h
    return out


class Parse:
    """Phrases of a slice of texts: ``row``, ``start`` and ``end`` (bytes in the slice), ``key``, ``phrase``."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray, window: int, gram: int):
        self.prefix = prefix_hash(data)
        if len(data) < window:
            self.row = self.start = self.end = np.zeros(0, np.int64)
            self.key = self.phrase = np.zeros(0, np.uint64)
            return
        begin = np.arange(len(data) - gram + 1)
        grams = gram_hashes(data, gram)
        order = (grams & ~_PLACE) | (begin.astype(np.uint64) & _PLACE)      # ties: the leftmost
        trigger = (sliding_least(order, window - gram + 1) & _PLACE).astype(np.int64)
        sizes = np.diff(offsets)
        row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[:len(trigger)]
        inside = begin[:len(trigger)] + window <= np.repeat(offsets[1:], sizes)[:len(trigger)]
        new = inside.copy()
        new[1:] &= (trigger[1:] != trigger[:-1]) | (row[1:] != row[:-1])
        self.start = np.flatnonzero(new)
        last = inside.copy()
        last[:-1] &= ~inside[1:] | new[1:]
        self.end = np.flatnonzero(last) + window
        self.row = row[self.start]
        at = trigger[self.start]
        self.key = grams[at]
        self.phrase = mix64(span_hash(self.prefix, self.start, self.end) ^ (at - self.start).astype(np.uint64))

    def ids(self) -> np.ndarray:
        return mix64(self.key ^ mix64(self.phrase)).view(np.int64)


def _each_slice(column: pa.Array, window: int, piece: int = SLICE):
    """(first row, end row, bytes before, offsets, data): rows of together at most ``piece`` bytes, or
    a piece of a longer row, which holds its window starts and the rest of their windows."""
    offsets, data = column_bytes(column)
    for a, b in slices(offsets, piece):
        own = data[offsets[a]:offsets[b]]
        if len(own) <= piece:
            yield a, b, 0, offsets[a:b + 1] - offsets[a], own
            continue
        for at in range(0, len(own), piece):
            part = own[at:at + piece + window - 1]
            yield a, b, at, np.array([0, len(part)]), part


def parse(keyed: DataFrame, window: int, gram: int, piece: int = SLICE) -> DataFrame:
    """(key, phrase, doc) per phrase occurrence; keyed: (doc, text)."""
    def run(batch):
        parts = []
        for a, _, _, offsets, data in _each_slice(batch.column(1), window, piece):
            p = Parse(offsets, data, window, gram)
            parts.append(pa.RecordBatch.from_arrays(
                [pa.array(p.key.view(np.int64)), pa.array(p.phrase.view(np.int64)),
                 batch.column(0).take(pa.array(p.row + a))], ["key", "phrase", "doc"]))
        return pa.Table.from_batches(parts).combine_chunks().to_batches(max_chunksize=None)[0] if sum(p.num_rows for p in parts) else None
    return map_batches(keyed, run, "key long, phrase long, doc long")


def representatives(keyed: DataFrame, wanted: DataFrame, window: int, gram: int, piece: int = SLICE) -> DataFrame:
    """(key, phrase, n, hot, bytes) of the wanted phrases (doc, key, phrase, n, hot)."""
    lists = wanted.groupBy("doc").agg(F.collect_set(F.struct("key", "phrase", "n", "hot")).alias("want"))
    rows = keyed.join(lists, "doc").select("text", "want")

    def run(batch):
        want = batch.column(1)
        out: list[tuple] = []
        for a, b, _, offsets, data in _each_slice(batch.column(0), window, piece):
            p = Parse(offsets, data, window, gram)
            first = np.searchsorted(p.row, np.arange(b - a + 1))
            raw = data.tobytes()
            for i in range(a, b):
                s = slice(first[i - a], first[i - a + 1])
                places = {k: j for j, k in enumerate(zip(p.key[s].view(np.int64).tolist(), p.phrase[s].view(np.int64).tolist()), int(s.start))}
                for w in want[i].as_py():
                    if (j := places.get((w["key"], w["phrase"]))) is not None:
                        out.append((w["key"], w["phrase"], w["n"], w["hot"], raw[p.start[j]:p.end[j]]))
        if out:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (
                pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()))], ["key", "phrase", "n", "hot", "bytes"])

    return map_batches(rows, run, "key long, phrase long, n long, hot boolean, bytes binary").dropDuplicates(["key", "phrase"])


def window_hashes(bytes_: pa.Array, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, phrase number, start within the phrase) of every window of the phrases."""
    offsets, data = column_bytes(bytes_.cast(pa.large_binary()).view(pa.large_string()))
    sizes = np.diff(offsets) - window + 1
    number = np.repeat(np.arange(len(sizes)), sizes)
    inner = np.arange(len(number)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    begin = offsets[number] + inner
    return span_hash(prefix_hash(data), begin, begin + window), number, inner


def _ordered(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, keys in order) of keys below ``2**bits``; with the place packed behind the key where
    both fit, which sorts much faster."""
    place = max(len(key) - 1, 1).bit_length()
    if bits + place > 64:
        order = np.argsort(key)
        return order, key[order]
    packed = np.sort(key << np.uint64(place) | np.arange(len(key), dtype=np.uint64))
    return (packed & np.uint64((1 << place) - 1)).astype(np.int64), packed >> np.uint64(place)


def window_ranks(data: np.ndarray, window: int) -> np.ndarray:
    """For every position the rank of its next ``window`` bytes in byte order, equal for equal bytes,
    by prefix doubling; positions with fewer bytes left have some rank."""
    n, width = len(data), min(window, 5)
    padded = np.concatenate([data, np.zeros(width, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for j in range(width):
        key = key << np.uint64(8) | padded[j:j + n]
    place = np.uint64(max(n, 1).bit_length())

    def ranked(key: np.ndarray, bits: int) -> np.ndarray:
        order, key = _ordered(key, bits)
        new = np.ones(n, bool)
        new[1:] = key[1:] != key[:-1]
        out = np.empty(n, np.uint64)
        out[order] = (np.cumsum(new) - 1).astype(np.uint64)
        return out

    rank = ranked(key, 8 * width)
    while width < window:
        step = min(width, window - width)         # the last doubling overlaps
        ahead = np.zeros(n, np.uint64)
        ahead[:max(n - step, 0)] = rank[step:]
        rank = ranked(rank << place | ahead, 2 * int(place))
        width += step
    return rank


def repeated_windows(bytes_: pa.Array, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(whether it occurs again, phrase number, start) of every window of the phrases.  Equal hashes
    say which phrases may share a window; the order of their suffixes says which windows do."""
    hashes, number, inner = window_hashes(bytes_, window)
    found = _again(hashes)
    some = np.unique(number[found])
    if len(some):
        offsets, data = column_bytes(bytes_.cast(pa.large_binary()).view(pa.large_string()))
        sizes = np.diff(offsets)[some]
        begin = np.concatenate([[0], np.cumsum(sizes)])
        part = data[np.arange(begin[-1]) + np.repeat(offsets[some] - begin[:-1], sizes)]
        at = np.full(len(bytes_), -1)
        at[some] = begin[:-1]
        held = at[number] >= 0
        rank = window_ranks(part, window)[at[number[held]] + inner[held]]
        found[held] = _again(rank, max(len(part), 1).bit_length())
    return found, number, inner


def _again(key: np.ndarray, bits: int = 64) -> np.ndarray:
    """Whether a key occurs more than once; of wide keys (a filter) only the upper bits count."""
    place = max(len(key) - 1, 1).bit_length()
    if bits + place > 64:
        key, bits = key >> np.uint64(bits + place - 64), 64 - place
    order, key = _ordered(key, bits)
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = key[1:] == key[:-1]
    out = np.empty(len(key), bool)
    out[order] = same[1:] | same[:-1]
    return out


def spans_of(number: np.ndarray, inner: np.ndarray, n: int, window: int) -> list[list[int] | None]:
    """Per phrase the covered byte ranges [start, end, ...] of its repeated windows, merged."""
    out: list[list[int] | None] = [None] * n
    if len(number):
        new = np.ones(len(number), bool)
        new[1:] = (number[1:] != number[:-1]) | (inner[1:] > inner[:-1] + window)
        heads = np.flatnonzero(new)
        tails = np.append(heads[1:], len(number)) - 1
        for h, t in zip(heads, tails):
            i = int(number[h])
            out[i] = (out[i] or []) + [int(inner[h]), int(inner[t]) + window]
    return out


_SPANS = "key long, phrase long, spans array<int>"


def _key_runs(key: np.ndarray, size: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of whole runs of one key, of about ``most`` bytes together; a longer run stands alone."""
    borders = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
    start = 0
    for low, high in zip(borders[:-1], borders[1:]):
        if low > start and size[high] - size[start] > most:
            yield start, int(low)
            start = int(low)
    if len(key):
        yield start, len(key)


def ordered_suffixes(rows: DataFrame, window: int, memory: int = 4 << 20) -> DataFrame:
    """Spans of single phrases that other phrases of their gram repeat; rows: (key, phrase, n,
    bytes) in bounded groups of one key.  Groups are streamed, whole ones at a time."""
    rows = rows.select("key", "phrase", "n", "bytes").repartition("key").sortWithinPartitions("key")

    def settle(batch: pa.RecordBatch | pa.Table) -> pa.RecordBatch | None:
        table = pa.Table.from_batches([batch]) if isinstance(batch, pa.RecordBatch) else batch
        table = table.combine_chunks()
        key, bytes_ = table["key"].to_numpy(), table["bytes"].combine_chunks()
        size = np.concatenate([[0], np.cumsum(pc.binary_length(bytes_).to_numpy())])
        found, number, inner = [], [], []
        for a, b in _key_runs(key, size, GROUP):                      # whole trigger groups, a cache-sized part at a time
            f, of, start = repeated_windows(bytes_[a:b], window)
            found.append(f)
            number.append(of + a)
            inner.append(start)
        found, number, inner = (np.concatenate(x) for x in (found, number, inner))
        found &= (table["n"].to_numpy() == 1)[number]
        spans = spans_of(number[found], inner[found], table.num_rows, window)
        keep = [i for i, s in enumerate(spans) if s]
        if keep:
            taken = table.select(["key", "phrase"]).take(pa.array(keep)).combine_chunks()
            return pa.RecordBatch.from_arrays([taken["key"].combine_chunks(), taken["phrase"].combine_chunks(),
                                               pa.array([spans[i] for i in keep], pa.list_(pa.int32()))], ["key", "phrase", "spans"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            key = batch.column(0).to_numpy()
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0          # the last key may go on
            if held and sum(b.nbytes for b in held) > memory and (cut or key[0] != held[-1].column(0)[-1].as_py()):
                before = cut if cut else 0
                if (out := settle(pa.Table.from_batches([*held, batch.slice(0, before)]))) is not None:
                    yield out
                held = [batch.slice(before)]
            else:
                held.append(batch)
        if held and (out := settle(pa.Table.from_batches(held))) is not None:
            yield out

    return rows.mapInArrow(run, _SPANS)


def counted_suffixes(rows: DataFrame, window: int) -> DataFrame:
    """The same for grams with very many distinct phrases, by counting their windows."""
    def explode(batch):
        hashes, number, inner = window_hashes(batch.column(3), window)
        take = pa.array(number)
        return pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), batch.column(2).take(take),
                                           pa.array(inner.astype(np.int32)), pa.array(hashes.view(np.int64))],
                                          ["key", "phrase", "n", "inner", "hash"])
    windows = map_batches(rows.select("key", "phrase", "n", "bytes"), explode,
                          "key long, phrase long, n long, inner int, hash long")
    again = windows.groupBy("key", "hash").count().where("count > 1").select("key", "hash")
    starts = (windows.where("n = 1").join(again, ["key", "hash"], "left_semi").groupBy("key", "phrase")
              .agg(F.sort_array(F.collect_list("inner")).alias("starts")))

    def merge(batch):
        starts = batch.column(2)
        number = np.repeat(np.arange(batch.num_rows), np.diff(starts.offsets.to_numpy()))
        spans = spans_of(number, starts.flatten().to_numpy(), batch.num_rows, window)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, pa.list_(pa.int32()))],
                                          ["key", "phrase", "spans"])
    return map_batches(starts, merge, _SPANS)


def cut_text(raw: bytes, covered: np.ndarray) -> tuple[int, int, bytes]:
    """(bytes removed, maximal runs, what remains)."""
    edges = np.diff(covered.astype(np.int8), prepend=0)
    return int(covered.sum()), int((edges == 1).sum()), np.frombuffer(raw, np.uint8)[~covered].tobytes()


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, block: int = BLOCK, id_col: str = "doc_id",
                   text_col: str = "text", piece: int = SLICE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes; null where
    nothing was removed), one row per input row."""
    spark = docs.sparkSession
    folder = work_dir(spark, "prefix-free")
    base = texts(docs, id_col, text_col).withColumn("doc", F.xxhash64("doc_id", "text"))
    keyed = base.select("doc", "text").where(F.octet_length("text") >= window)

    occurrences = written(parse(keyed, window, gram, piece), f"{folder}/parse")
    dictionary = written(occurrences.groupBy("key", "phrase").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("doc")),
                         f"{folder}/dictionary")
    shared = dictionary.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    wanted = dictionary.join(shared, "key").withColumn("hot", F.col("m") > block).drop("m")
    found = written(representatives(keyed, wanted, window, gram, piece), f"{folder}/representatives")
    partly = ordered_suffixes(found.where("not hot"), window).unionByName(counted_suffixes(found.where("hot"), window))
    partly = partly.join(dictionary.where("n = 1"), ["key", "phrase"]).select("doc", "key", "phrase", "spans")

    whole = occurrences.join(dictionary.where("n > 1").select("key", "phrase"), ["key", "phrase"], "left_semi")
    marks = (whole.select("doc", "key", "phrase", F.lit(None).cast("array<int>").alias("spans")).unionByName(partly)
             .groupBy("doc").agg(F.collect_set(F.struct("key", "phrase", "spans")).alias("marks")))
    marks = written(marks, f"{folder}/marks")
    for done in ("parse", "dictionary", "representatives"):
        drop_dir(spark, f"{folder}/{done}")

    rows = base.join(marks, "doc", "left").select("doc_id", "text", "marks")

    def run(batch):
        marks = batch.column(2)
        text_offsets, text_bytes = column_bytes(batch.column(1))
        covered: dict[int, np.ndarray] = {}
        for a, b, before, offsets, data in _each_slice(batch.column(1), window, piece):
            if not before:                    # a long row's later pieces have the marks of its first
                some = {i: {(m["key"], m["phrase"]): m["spans"] for m in found} for i in range(a, b) if (found := marks[i].as_py())}
            p = Parse(offsets, data, window, gram) if some else None
            for i, known in some.items():
                low = int(offsets[i - a]) - before
                if i not in covered:
                    covered[i] = np.zeros(text_offsets[i + 1] - text_offsets[i], bool)
                mask = covered[i]
                s = slice(*np.searchsorted(p.row, [i - a, i - a + 1]))
                for k, h, start, end in zip(p.key[s].view(np.int64).tolist(), p.phrase[s].view(np.int64).tolist(),
                                            (p.start[s] - low).tolist(), (p.end[s] - low).tolist()):
                    if (k, h) in known:
                        spans = known[k, h]
                        for x, y in [(0, end - start)] if spans is None else zip(spans[::2], spans[1::2]):
                            mask[start + x:start + y] = True
        out = []
        for i in range(batch.num_rows):
            raw = text_bytes[text_offsets[i]:text_offsets[i + 1]].tobytes()
            if i not in covered:
                out.append((len(raw), 0, 0, hashlib.sha256(raw).hexdigest(), None))
                continue
            removed, runs, kept = cut_text(raw, covered.pop(i))
            out.append((len(raw), removed, runs, hashlib.sha256(kept).hexdigest(), kept if removed else None))
        columns = list(zip(*out))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))],
                                          ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return map_batches(rows, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")

"""Helpers shared by the text operators: table access, work folders, Arrow
batch plumbing and vectorised word splitting."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lapse.session import shared_folder

WHITESPACE = b" \t\n\x0b\x0c\r"          # the blanks between words, as every contract here states them


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession, what: str) -> str:
    """A new folder below the shared checkpoint folder of the session."""
    return f"{shared_folder(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def drop_dir(spark: SparkSession, path: str) -> None:
    """Remove a work folder that nothing reads any more."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def written(df: DataFrame, path: str) -> DataFrame:
    """Cut lineage: write to the shared folder and read back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """``(doc_id, text, ...)``: the two columns every operator needs, null text as the
    empty string.  Other columns of ``docs``, clashing names included, are left behind."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *more)


def release_memory() -> None:
    """Give back what finished work left with Arrow's pool and the C library: workers are reused
    by later stages, whose memory would add to it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``mapInArrow`` of a function from one batch to one batch; memory is released after each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                if out is not None:
                    yield out
                del batch, out
                release_memory()
    return df.mapInArrow(run, schema)


SIFT_BITS, _PAGE = 1 << 25, 32_768       # 4 MB of bits in 4 KB pages: the broadcast's fixed bound


def sifted(rows: DataFrame, key: str, wanted: DataFrame, others: bool = False) -> DataFrame:
    """Rows whose ``key`` (long) may be among those of ``wanted`` (or, with ``others``, the rows
    left over): a bit filter of fixed size, built by partial aggregation and broadcast, ahead of
    the join that decides.

    It keeps the texts of rows that can't match out of the shuffle.  All matches pass; the
    fuller the bits, the more others do too."""
    def place(column: Column) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(SIFT_BITS))

    spots = wanted.select(place(F.col(key)).alias("h"))
    pages = (spots.groupBy(F.floor(F.col("h") / _PAGE).cast("int").alias("__page"))
             .agg(F.bitmap_construct_agg(F.pmod("h", F.lit(_PAGE))).alias("__bits")))
    spot = F.pmod(F.col("__h"), F.lit(_PAGE)).cast("int")
    byte = F.conv(F.hex(F.substring("__bits", F.floor(spot / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    among = F.getbit(byte, F.pmod(spot, F.lit(8))) == 1
    return (rows.withColumn("__h", place(F.col(key))).withColumn("__page", F.floor(F.col("__h") / _PAGE).cast("int"))
            .join(F.broadcast(pages), "__page", "left" if others else "inner")
            .where(~F.coalesce(among, F.lit(False)) if others else among).select(*rows.columns))


def keep_rows(docs: DataFrame, verdict: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``verdict`` (doc_id, text_hash, kept) keeps, with all columns.

    The verdict's exceptions are written first, so that Spark knows their size when it plans
    the join and moves the texts only where they are many.  Rows equal in id and text stay once."""
    folder = work_dir(docs.sparkSession, "keep-rows")
    pairs = verdict.groupBy("doc_id", "text_hash").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    pairs = written(pairs.where("not kept or n > 1"), f"{folder}/pairs")
    gone, twice = (written(pairs.where(c).select("doc_id", "text_hash"), f"{folder}/{n}")
                   for c, n in (("not kept", "gone"), ("kept", "twice")))
    marked = docs.withColumns({"__id": F.col(id_col).cast("long"),
                               "__hash": F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))})

    def match(other: DataFrame) -> Column:
        return marked["__id"].eqNullSafe(other["doc_id"]) & (marked["__hash"] == other["text_hash"])

    kept = marked.join(gone, match(gone), "left_anti")
    if not twice.isEmpty():
        rest = kept.join(twice, match(twice), "left_anti")
        kept = rest.unionByName(kept.join(twice, match(twice), "left_semi").dropDuplicates(["__id", "__hash"]))
    return kept.drop("__id", "__hash")


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column without nulls; no copy for a plain array."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0]:offsets[-1]]


def slices(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes; a longer row stands alone."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(max(end, start + 1), n)
        yield start, end
        start = end


_BLANK = np.zeros(256, bool)
_BLANK[list(WHITESPACE)] = True
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32

# Two independent polynomial hashes modulo the prime 2**31 - 1.  (A power of two as modulus
# would give structured texts such as Thue-Morse words one hash, whatever the base.)
_PRIME = np.uint64((1 << 31) - 1)
_BASES = (0x2545F491, 0x5851F42D)
_POW: list[np.ndarray] = []
_POW_KEPT, _PART = 1 << 21, 1 << 16      # powers kept between calls; elements worked on at once


def powers(n: int) -> list[np.ndarray]:
    """Per base its powers and inverse powers modulo the prime, for exponents below n.
    Grown by need; tables for very long texts aren't kept."""
    if _POW and len(_POW[0]) >= n:
        return _POW
    size = max(1 << 16, 1 << (n - 1).bit_length())
    found = [_powers(b, size) for base in _BASES for b in (base, pow(base, -1, int(_PRIME)))]
    if size <= _POW_KEPT:
        _POW[:] = found
    return found


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint32)
    filled = 1
    while filled < n:                     # doubling: out[filled:] = out[:filled] * base**filled
        take = min(filled, n - filled)
        out[filled:filled + take] = out[:take] * np.uint64(pow(base, filled, int(_PRIME))) % _PRIME
        filled += take
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (xor-shift-multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _reduced(x: np.ndarray) -> np.ndarray:
    """``x`` (below 2**62) modulo the prime, in place."""
    high = x >> np.uint64(31)
    x &= _PRIME
    x += high
    np.subtract(x, _PRIME, out=high)      # wraps round where x is reduced already
    return np.minimum(x, high, out=x)


def _sums(terms: Callable[[slice], np.ndarray], out: np.ndarray) -> None:
    """Running sums of terms (below 2**39) modulo the prime, a cache-sized part at a time."""
    out[0], total = 0, np.uint64(0)
    for at in range(0, len(out) - 1, _PART):
        part = terms(slice(at, min(at + _PART, len(out) - 1)))
        part[0] += total
        np.cumsum(part, out=part)         # below 2**16 * 2**39 and a little
        out[at + 1:at + 1 + len(part)] = _reduced(part)
        total = np.uint64(out[at + len(part)])


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with P[k][i] the k-th polynomial hash of ``data[:i]``, low powers first."""
    out = np.empty((2, len(data) + 1), np.uint32)
    power = powers(len(data) + 1)
    for k in range(2):
        _sums(lambda s, of=power[2 * k]: (data[s].astype(np.uint64) + np.uint64(1)) * of[s], out[k])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """62-bit hashes of the spans (mixed to 64), equal for equal bytes wherever they stand."""
    power, out = powers(prefix.shape[1]), np.empty(len(start), np.uint64)
    for at in range(0, len(start), _PART):
        first, last = start[at:at + _PART], end[at:at + _PART]
        both = []
        for k in range(2):
            x = prefix[k][last].astype(np.uint64)
            x += _PRIME
            x -= prefix[k][first]
            x = np.minimum(x, x - _PRIME)
            x *= power[2 * k + 1][first]
            both.append(_reduced(x))
        out[at:at + _PART] = mix64(both[0] | both[1] << np.uint64(32))
    return out


def words(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every maximal run of non-blank bytes; rows never share a word."""
    inside = ~_BLANK[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    borders = offsets[1:-1]
    borders = borders[(borders > 0) & (borders < len(data))]
    first[borders] |= inside[borders]
    last[borders - 1] |= inside[borders - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def sequence_hash(items: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of ``items[start:end]`` (uint64 hashes), equal for equal sequences."""
    prefix = np.empty((2, len(items) + 1), np.uint32)
    power = powers(len(items) + 1)
    for k in range(2):                    # 30 bits of an item each, so that both hashes see other bits
        _sums(lambda s, k=k: _reduced(((items[s] >> np.uint64(30 * k) & np.uint64((1 << 30) - 1)) + np.uint64(1))
                                      * power[2 * k][s]), prefix[k])
    return span_hash(prefix, start, end)


def per_row(row: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Counts (or exact sums of small integers) per row."""
    if weights is None:
        return np.bincount(row, minlength=n)
    return np.bincount(row, weights=weights, minlength=n).astype(np.int64)


def lines_of_words(offsets: np.ndarray, data: np.ndarray, start: np.ndarray, row: np.ndarray) -> np.ndarray:
    """For each word the running number of its line; a line ends at ``\\n`` or at its text's end."""
    breaks = np.flatnonzero(data == 10)
    number = np.searchsorted(breaks, start)
    return number + row                    # a text's end also starts a new line


def repeated(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(in a group of two or more, not the first of its group) for each key."""
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = ranked[1:] == ranked[:-1]
    many, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    many[order] = same[:-1] | same[1:]
    later[order] = same[:-1]
    return many, later

"""Quality rules with cross-document line frequency.

A line is normalised by lower-casing A-Z, reading every digit as 0 and ignoring blanks
other than between words.  One pass over the texts (vectorised in the worker) gives the
distinct normalised lines of each document as 64-bit hashes.  Spark counts, per host
(``source``), the distinct documents that hold each line (partial sums before the
shuffle, so a line of a third of all documents is no hot spot).  ``line_rules`` joins the
lines above the limit back to the documents' line hashes and word counts and needs the texts
once.  ``clean_texts`` also takes those lines, line end included, out of the texts in a second
pass; only texts that may hold such a line are shuffled.  A document is depleted if too
small a share or too few of its words are left.  Both give the same words and verdicts.

Copies of one text count as one document: a line is boilerplate because different
documents of a host share it, not because one document was stored many times (that
is the duplicate operators' matter).  The limit is the larger of ``min_documents``
and ``share`` of the host's distinct documents, the same rule at every size.  The cleaned
texts of the registered query go by the count alone; the table of op6_line_rules has the
share and rejects by both bounds, as its DuckDB mirror says.

Null text counts as no words and stays null; null host is a host of its own; null or
repeated ids keep a row each; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapse.llm.common import (ASCII_LOWER, column_bytes, drop_dir, lines_of_words, map_batches, mix64, per_row,
                              prefix_hash, repeated, sequence_hash, sifted, slices, span_hash, words, work_dir, written)

MIN_DOCUMENTS, SHARE, MIN_LEFT, MIN_LEFT_WORDS = 20, 0.0, 0.3, 50
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_NORMAL = ASCII_LOWER.copy()
_NORMAL[48:58] = 48
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
LINES = "doc_id long, host string, key long, " + ", ".join(f"{m} long" for m in MEASURES) + ", line array<long>, words array<int>"
CLEANED = "doc_id long, text string, " + ", ".join(f"{m} long" for m in MEASURES) + ", words_removed long"


class Lines:
    """Words, lines with a word, and the lines' normalised hashes of a batch of texts."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray):
        self.start, self.end, self.row = words(offsets, data)
        line = lines_of_words(offsets, data, self.start, self.row)
        self.first = np.flatnonzero(np.diff(line, prepend=-1))
        self.after = np.append(self.first[1:], len(line))
        self.line_row = self.row[self.first]
        # Raw bytes between line ends.
        breaks = np.flatnonzero(data == 10)
        at = np.searchsorted(breaks, self.start[self.first])
        padded = np.concatenate([[-1], breaks, [len(data)]])
        self.raw_start = np.maximum(padded[at] + 1, offsets[self.line_row])
        self.raw_end = np.minimum(padded[at + 1], offsets[self.line_row + 1])
        # Sequences of normalised words.
        normal = span_hash(prefix_hash(_NORMAL[data]), self.start, self.end)
        self.hashed = sequence_hash(normal, self.first, self.after)

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, hash, words on all copies), one entry per text and line."""
        order = np.lexsort((self.hashed, self.line_row))
        r, h = self.line_row[order], self.hashed[order]
        new = np.ones(len(r), bool)
        new[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
        first = np.flatnonzero(new)
        return r[first], h[first], np.add.reduceat((self.after - self.first)[order], first) if len(first) else np.zeros(0, np.int64)

    def held(self, row: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Which lines are among the given (row, hash) pairs."""
        known = np.unique(hashes)
        if not len(known):
            return np.zeros(len(self.hashed), bool)
        at = np.minimum(np.searchsorted(known, self.hashed), len(known) - 1)
        pairs = row * len(known) + np.searchsorted(known, hashes)
        return (known[at] == self.hashed) & np.isin(self.line_row * len(known) + at, pairs)


def measure(offsets: np.ndarray, data: np.ndarray, lines: Lines) -> dict[str, np.ndarray]:
    n, start, end, row = len(offsets) - 1, lines.start, lines.end, lines.row
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
    prefix = prefix_hash(data)
    word = span_hash(prefix, start, end)
    salt = mix64(np.arange(n, dtype=np.uint64) + np.uint64(1))
    _, later = repeated(span_hash(prefix, lines.raw_start, lines.raw_end) ^ salt[lines.line_row])

    # Windows of three words within a text.
    three = np.flatnonzero(row[2:] == row[:-2]) if len(row) > 2 else np.zeros(0, np.int64)
    window = mix64(word[three] + mix64(word[three + 1] + mix64(word[three + 2]))) ^ salt[row[three]]
    many, _ = repeated(window)
    covered = np.zeros(len(row), bool)
    for k in range(3):
        covered[three[many] + k] = True

    return {"n_words": per_row(row, n),
            "word_chars": per_row(row, n, (points[end] - points[start]).astype(float)),
            "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]],
            "n_dup_lines": per_row(lines.line_row[later], n),
            "n_repeat_words": per_row(row[covered], n)}


def without(offsets: np.ndarray, data: np.ndarray, lines: Lines, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of the texts without the lines ``gone``, each with its line end."""
    edge = np.zeros(len(data) + 2, np.int64)
    row_end = offsets[lines.line_row + 1]
    np.add.at(edge, lines.raw_start[gone], 1)
    np.add.at(edge, np.minimum(lines.raw_end + 1, row_end)[gone], -1)
    stays = np.cumsum(edge[:len(data)]) == 0
    return np.concatenate([[0], np.cumsum(stays)])[offsets], data[stays]


def _rows(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """(doc_id, text as it is, host, key); equal texts of one host have one key."""
    text = F.col(text_col).cast("string")
    host = F.coalesce(F.concat(F.lit("="), F.col(host_col).cast("string")), F.lit(""))     # null: a host of its own
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), host.alias("host"),
                       F.xxhash64(host, F.coalesce(text, F.lit(""))).alias("key"))


def document_lines(rows: DataFrame) -> DataFrame:
    """The measures of each row's text, its distinct lines and the words on each (all copies)."""
    def run(batch):
        offsets, data = column_bytes(batch.column(1).fill_null(""))
        parts = []
        for a, b in slices(offsets, 1 << 20):
            o, d = offsets[a:b + 1] - offsets[a], data[offsets[a]:offsets[b]]
            lines = Lines(o, d)
            values, (r, h, n) = measure(o, d, lines), lines.distinct()
            counts = np.concatenate([[0], np.cumsum(np.bincount(r, minlength=b - a))]).astype(np.int32)
            parts.append(pa.RecordBatch.from_arrays(
                [batch.column(0)[a:b], batch.column(2)[a:b], batch.column(3)[a:b], *(pa.array(values[m].astype(np.int64)) for m in MEASURES),
                 pa.ListArray.from_arrays(pa.array(counts), pa.array(h.view(np.int64))),
                 pa.ListArray.from_arrays(pa.array(counts), pa.array(n.astype(np.int32)))], [f.split()[0] for f in LINES.split(", ")]))
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    return map_batches(rows, run, LINES)


def frequent_lines(distinct: DataFrame, min_documents: int = MIN_DOCUMENTS, share: float = SHARE) -> DataFrame:
    """(host, line) of the lines above the host's limit of distinct documents."""
    limits = (distinct.groupBy("host").count()
              .select("host", F.greatest(F.lit(float(min_documents)), F.col("count") * share).alias("limit")))
    return (distinct.select("host", F.explode("line").alias("line")).groupBy("host", "line").count()
            .where(F.col("count") > min_documents)
            .join(limits, "host").where(F.col("count") > F.col("limit")).select("host", "line"))


def _cut(rows: DataFrame) -> DataFrame:
    """The rows' texts without the lines in ``gone``, their measures and the words cut."""
    def run(batch):
        offsets, data = column_bytes(batch.column(1).fill_null(""))
        parts = []
        for a, b in slices(offsets, 1 << 20):
            o, d = offsets[a:b + 1] - offsets[a], data[offsets[a]:offsets[b]]
            lines, gone = Lines(o, d), batch.column(2)[a:b].fill_null([])
            row = np.repeat(np.arange(b - a), gone.value_lengths().to_numpy())
            cut = lines.held(row, gone.flatten().to_numpy().view(np.uint64))
            values = measure(o, d, lines)
            removed = per_row(lines.line_row[cut], b - a, (lines.after - lines.first)[cut].astype(float))
            text = batch.column(1)[a:b]
            if cut.any():
                o, d = without(o, d, lines, cut)
                left = pa.LargeStringArray.from_buffers(b - a, pa.py_buffer(np.ascontiguousarray(o, np.int64)), pa.py_buffer(d))
                text = pc.if_else(pc.is_valid(text), left.cast(text.type), pa.scalar(None, text.type))
            parts.append(pa.RecordBatch.from_arrays(
                [batch.column(0)[a:b], text, *(pa.array(values[m].astype(np.int64)) for m in MEASURES),
                 pa.array(removed.astype(np.int64))], [f.split()[0] for f in CLEANED.split(", ")]))
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    return map_batches(rows.select("doc_id", "text", "gone"), run, CLEANED)


def _verdict(out: DataFrame, min_left: float, min_left_words: int) -> DataFrame:
    left = F.col("n_words") - F.col("words_removed")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    depleted = (left < min_left * F.col("n_words")) | (left < min_left_words)
    return out.withColumns({"base_failed": failed, "kept": ~failed & ~depleted})


def _found(rows: DataFrame, folder: str, min_documents: int, share: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(the documents' measures and lines, one row per distinct text of a host, its lines above the limit)."""
    measured = written(document_lines(rows), f"{folder}/lines")
    distinct = written(measured.groupBy("host", "key").agg(F.first(F.struct("line", "words")).alias("l")).select("host", "key", "l.*"),
                       f"{folder}/distinct")
    frequent = written(frequent_lines(distinct, min_documents, share), f"{folder}/frequent")
    held = (distinct.select("host", "key", F.inline(F.arrays_zip("line", "words"))).join(frequent, ["host", "line"]))
    return measured, distinct, held


def clean_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
                min_documents: int = MIN_DOCUMENTS, share: float = SHARE, min_left: float = MIN_LEFT,
                min_left_words: int = MIN_LEFT_WORDS) -> DataFrame:
    """doc_id, text without the lines above the limit, the measures of the text as it was,
    words_removed, base_failed, kept; one row per input row."""
    spark = docs.sparkSession
    folder = work_dir(spark, "line-rules")
    rows = _rows(docs, id_col, text_col, host_col)
    *_, held = _found(rows, folder, min_documents, share)
    gone = written(held.groupBy("key").agg(F.collect_set("line").alias("gone")), f"{folder}/gone")
    for done in ("lines", "distinct", "frequent"):
        drop_dir(spark, f"{folder}/{done}")
    # Texts that hold no such line by the bit filter stay where they are.
    hold, rest = sifted(rows, "key", gone), sifted(rows, "key", gone, others=True)
    out = _cut(hold.join(gone, "key", "left").unionByName(rest.withColumn("gone", F.lit(None).cast("array<long>"))))
    return _verdict(out, min_left, min_left_words)


def line_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
               min_documents: int = MIN_DOCUMENTS, share: float = SHARE, min_left: float = MIN_LEFT,
               min_left_words: int = MIN_LEFT_WORDS) -> DataFrame:
    """doc_id, the measures, words_removed, base_failed, kept, as :func:`clean_texts` has them."""
    spark = docs.sparkSession
    folder = work_dir(spark, "line-rules")
    measured, _, held = _found(_rows(docs, id_col, text_col, host_col), folder, min_documents, share)
    removed = written(held.groupBy("key").agg(F.sum("words").cast("long").alias("words_removed")), f"{folder}/removed")
    for done in ("distinct", "frequent"):
        drop_dir(spark, f"{folder}/{done}")
    out = measured.select("doc_id", "key", *MEASURES).join(removed, "key", "left")
    out = out.select("doc_id", *MEASURES, F.coalesce("words_removed", F.lit(0)).cast("long").alias("words_removed"))
    return _verdict(out, min_left, min_left_words)

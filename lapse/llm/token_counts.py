"""Token counts by a map-side two-tier lookup.

Tier one is a compact table of frequent pre-token lengths, broadcast once: at
most ``table_size`` entries.  It is counted over all documents, each batch giving out its
``per_batch`` most frequent pre-tokens with their counts; only these are summed up.  The table
only saves time; every count is exact whatever it holds.  Tier two is a bounded cache
in each worker, filled by encoding what tier one misses.  In the counting pass itself
nothing is shuffled.

Null text counts as empty; rows with null or repeated ids each get a row; extra
columns are ignored; an empty table gives an empty result; a very long text is
split lazily pre-token by pre-token.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapse.llm.common import column_bytes, map_batches, texts
from lapse.llm.pretokens import PieceCache, load

PER_BATCH, TABLE_SIZE, LONGEST, LAZY = 8_192, 65_536, 32, 1 << 16


def pieces(kit, part: str) -> Iterable[str]:
    """Pre-tokens of ordinary text; those of a long one are found as they are asked for."""
    return kit.split(part) if len(part) <= LAZY else (m[0] for m in kit.spans(part))


def frequent_lengths(docs: DataFrame, tokenizer: str, table_size: int = TABLE_SIZE, per_batch: int = PER_BATCH) -> dict[str, int]:
    """The first tier: pre-token -> number of tokens, at most ``table_size`` of them."""
    def counted(batch):
        kit, seen = load(tokenizer), Counter()
        for text in batch.column(0):
            text = text.as_py()
            if not kit.needs_library(text):
                for part, special in kit.parts(text):
                    if special is None:
                        seen.update(pieces(kit, part))
            if len(seen) > 64 * per_batch:                           # bounded: what came once or seldom goes
                seen = Counter(dict(seen.most_common(16 * per_batch)))
        top = [(p, n) for p, n in seen.most_common(per_batch) if n > 1 and len(p) <= LONGEST]
        return pa.RecordBatch.from_arrays([pa.array([p for p, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())],
                                          ["piece", "n"])

    top = (map_batches(docs.select("text"), counted, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
           .orderBy(F.desc("n"), "piece").limit(table_size))
    kit = load(tokenizer)
    return {r.piece: len(kit.encode_piece(r.piece)) for r in top.collect()}


class _Tier(dict):
    """The broadcast table in front of the worker's cache."""

    def __init__(self, table: dict[str, int], behind: PieceCache):
        super().__init__(table)
        self.behind = behind

    def __missing__(self, piece: str) -> int:
        return self.behind[piece]


_TIERS: dict[tuple[str, int], _Tier] = {}


def count_text(kit, length_of, text: str) -> int:
    if kit.needs_library(text):
        return len(kit.library_ids(text))
    return sum(1 if special is not None else sum(map(length_of, pieces(kit, part)))
               for part, special in kit.parts(text))


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512,
                 table_size: int = TABLE_SIZE, per_batch: int = PER_BATCH) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens (tokenizers library, no special tokens added),
    over_limit (n_tokens > limit), one row per input row."""
    docs = texts(docs, id_col, text_col)
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, tokenizer, table_size, per_batch))

    def count(batch):
        kit, key = load(tokenizer), (tokenizer, id(table.value))
        if key not in _TIERS:
            _TIERS.clear()
            _TIERS[key] = _Tier(table.value, PieceCache(lambda p: len(kit.encode_piece(p))))
        length_of = _TIERS[key].__getitem__
        column = batch.column(1)
        offsets, _ = column_bytes(column)
        n = [count_text(kit, length_of, t.as_py()) for t in column]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(offsets[1:] - offsets[:-1], pa.int64()), pa.array(n, pa.int64()),
             pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return map_batches(docs, count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")

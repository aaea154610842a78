"""Sum-of-squares online packing of documents into fixed windows.

Each input partition is one packer.  A document's ids (with the end id) are cut into
full windows from its start; the rest is placed online: among the fill levels that
have an open window with room, and a new window, it goes to the one that minimises
the sum of squared counts of open windows per level, kept in a level array.  When
the packer ends, or holds ``max_open`` open windows, open windows are joined by
cutting pieces of the emptiest ones to fill the fullest, so memory is bounded and at
most one window stays open; the last one is cut into sequences whose lengths are
powers of two, which need no padding.

No shuffle: sequence ids are the partition number and a running number, and a task
that is run again gives the same rows.  Null text is a document of the end id alone;
rows with null or repeated ids are packed as documents of their own.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from lapse.llm.common import texts
from lapse.llm.pretokens import ByteLevelTokenizer, PieceCache, load

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
FIELDS = [f.split()[0] for f in SCHEMA.split(", ")]


class Piece:
    """ids[start:start + length] of a document, with the ids' bytes for later cuts."""

    __slots__ = ("doc_id", "start", "data", "doc_tokens")

    def __init__(self, doc_id: int | None, start: int, data: bytes, doc_tokens: int):
        self.doc_id, self.start, self.data, self.doc_tokens = doc_id, start, data, doc_tokens

    def __len__(self) -> int:
        return len(self.data) // 4

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return (Piece(self.doc_id, self.start, self.data[:4 * n], self.doc_tokens),
                Piece(self.doc_id, self.start + n, self.data[4 * n:], self.doc_tokens))


class SquaresPacker:
    """Windows of one partition.  ``rows`` holds finished pieces until they are taken."""

    def __init__(self, window: int, first_id: int, max_open: int):
        self.window, self.next_id, self.max_open = window, first_id, max_open
        self.levels = np.zeros(window + 1, np.int64)                 # open windows per fill level
        self.open: dict[int, list[list[Piece]]] = {}
        self.rows: list[tuple] = []
        self._n_open = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        total, step = len(ids) // 4, self.window
        full = total // step * step
        for at in range(0, full, step):
            self._close([Piece(doc_id, at, ids[4 * at:4 * (at + step)], total)])
        if full < total:
            self._place(Piece(doc_id, full, ids[4 * full:], total))

    def _place(self, piece: Piece) -> None:
        size, n = len(piece), self.levels
        # Level h loses a window and level h + size gains one; a full window counts no more.
        gain = n[size:] * 2 + 1
        gain[-1] = 0
        gain -= n[:self.window + 1 - size] * 2 - 1
        gain[0] = 2 * n[size] + 1                                    # a new window
        usable = n[:self.window + 1 - size] > 0
        usable[0] = True
        gain[~usable] = np.iinfo(np.int64).max
        level = len(gain) - 1 - int(np.argmin(gain[::-1]))           # ties: the fullest
        if level:
            pieces = self.open[level].pop()
            n[level] -= 1
            self._n_open -= 1
        else:
            pieces = []
        pieces.append(piece)
        level += size
        if level == self.window:
            self._close(pieces)
        else:
            self.open.setdefault(level, []).append(pieces)
            n[level] += 1
            self._n_open += 1
            if self._n_open > self.max_open:
                self._join()

    def _close(self, pieces: list[Piece]) -> None:
        offset = 0
        for p in pieces:
            self.rows.append((p.doc_id, p.start, len(p), zlib.crc32(p.data), p.doc_tokens, self.next_id, offset))
            offset += len(p)
        self.next_id += 1

    def _join(self) -> None:
        """Fill the fullest windows from the emptiest ones; at most one stays open."""
        windows = [(level, w) for level in sorted(self.open, reverse=True) for w in self.open[level]]
        self.open, self._n_open = {}, 0
        self.levels[:] = 0
        first, last = 0, len(windows) - 1
        while first < last:
            level, pieces = windows[first]
            left, source = windows[last]
            while level < self.window and source:
                piece = source.pop()
                if level + len(piece) > self.window:
                    piece, rest = piece.cut(self.window - level)
                    source.append(rest)
                pieces.append(piece)
                level += len(piece)
                left -= len(piece)
            windows[first], windows[last] = (level, pieces), (left, source)
            if level == self.window:
                self._close(pieces)
                first += 1
            if not source:
                last -= 1
        if first == last:
            level, pieces = windows[first]
            if pieces:
                self.open[level] = [pieces]
                self.levels[level] = self._n_open = 1

    def finish(self) -> None:
        self._join()
        for windows in self.open.values():
            for pieces in windows:
                level = sum(map(len, pieces))
                while pieces:                                        # largest power of two first
                    size = 1 << (level.bit_length() - 1)
                    taken = []
                    while size:
                        piece = pieces.pop(0)
                        if len(piece) > size:
                            piece, rest = piece.cut(size)
                            pieces.insert(0, rest)
                        taken.append(piece)
                        size -= len(piece)
                        level -= len(piece)
                    self._close(taken)
        self.open, self._n_open = {}, 0

    def take(self) -> pa.RecordBatch | None:
        rows, self.rows = self.rows, []
        if rows:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], FIELDS)


# Fixed value: pre-tokens per generation of a worker's cache; words rarer than that are encoded again.
CACHE_ROOM = 300_000

_CACHES: dict[str, PieceCache] = {}


def piece_cache(kit: ByteLevelTokenizer) -> PieceCache:
    """pre-token -> its ids as bytes."""
    return PieceCache(lambda p: array("I", kit.encode_piece(p)).tobytes(), room=CACHE_ROOM)


def token_bytes(kit: ByteLevelTokenizer, cache: PieceCache, text: str) -> bytes:
    """The ids as unsigned 32-bit little-endian numbers."""
    if kit.needs_library(text):
        return np.array(kit.library_ids(text), "<u4").tobytes()
    return b"".join(special.to_bytes(4, "little") if special is not None else b"".join(map(cache.__getitem__, kit.split(part)))
                    for part, special in kit.parts(text))


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, max_open: int = 4096,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kit = load(tokenizer)
        if tokenizer not in _CACHES:
            _CACHES[tokenizer] = piece_cache(kit)
        packer = SquaresPacker(window, TaskContext.get().partitionId() << 33, max_open)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                packer.add(doc_id, token_bytes(kit, _CACHES[tokenizer], text.as_py()) + end)
            if (out := packer.take()) is not None:
                yield out
        packer.finish()
        if (out := packer.take()) is not None:
            yield out

    return texts(docs, id_col, text_col).mapInArrow(run, SCHEMA)

"""BPE as a streaming transducer with bounded lookahead, and its inverse.

A merge list has a finite *sufficient lookahead* L: whether a token at the front of
the encoding of a prefix is final is settled once L further bytes are known.  The
effect of later bytes travels left only through a chain of merges of falling rank,
each taking a part of what its left neighbour needs, so L is the longest such chain
in bytes.  ``sufficient_lookahead`` finds it with one pass over the merges.

``Transducer`` keeps the bytes after the last stable token only: it encodes its
buffer, emits the tokens that end at least L bytes before the buffer's end and
drops their bytes.  (No merge crosses a token border, so the rest encodes alone.)  Every
pre-token goes through it: the short ones of ordinary text end before the lookahead is
full and are settled by their end, longer ones are emitted as they come.  Distinct short
pre-tokens are remembered with their ids.
Decoding is a byte table followed by an incremental UTF-8 state machine with the
library's replacement rule.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lapse.llm.common import map_batches, texts
from lapse.llm.pretokens import PieceCache, byte_letters, load

SHORT, BLOCK = 48, 4096                   # bytes: plain merging below, buffer growth between two emissions
NO_RULE, ID_MASK = 1 << 63, (1 << 32) - 1


class Merges:
    """The merge list of a byte-level BPE file by token id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, letters = model["vocab"], byte_letters()
        to_byte = {c: b for b, c in enumerate(letters)}
        self.of_byte = [vocab[c] for c in letters]
        self.bytes_of = {i: bytes(to_byte[c] for c in t) for t, i in vocab.items()}
        self.rules: dict[tuple[int, int], tuple[int, int]] = {}     # (left, right) -> (rank, joined)
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.rules.setdefault((vocab[left], vocab[right]), (rank, vocab[left + right]))
        self.coded = {pair: rank << 32 | joined for pair, (rank, joined) in self.rules.items()}
        self.lookahead = sufficient_lookahead(self.rules, {i: len(b) for i, b in self.bytes_of.items()})

    def encode(self, data: bytes) -> list[int]:
        """All merges in rank order, leftmost first."""
        ids = [self.of_byte[b] for b in data]
        return self._few(ids) if len(ids) <= SHORT else self._many(ids)

    def _few(self, ids: list[int]) -> list[int]:
        rules = self.coded
        steps = [rules.get(pair, NO_RULE) for pair in zip(ids, ids[1:])]
        while steps:
            best = min(steps)
            if best == NO_RULE:
                break
            at = steps.index(best)
            joined = best & ID_MASK
            ids[at:at + 2] = [joined]
            del steps[at]                 # the pair itself; its neighbours' pairs have a new part
            if at:
                steps[at - 1] = rules.get((ids[at - 1], joined), NO_RULE)
            if at < len(steps):
                steps[at] = rules.get((joined, ids[at + 1]), NO_RULE)
        return ids

    def _many(self, ids: list[int]) -> list[int]:
        """The same with a heap of possible merges over a linked list."""
        n, rules = len(ids), self.rules
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rule[0], i, ids[i], ids[i + 1], rule[1]) for i in range(n - 1) if (rule := rules.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, left, right, joined = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue                  # a part has gone into another token since
            ids[i], ids[j] = joined, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if rule := rules.get((joined, ids[after[i]])):
                    heapq.heappush(heap, (rule[0], i, joined, ids[after[i]], rule[1]))
            if (h := before[i]) >= 0 and (rule := rules.get((ids[h], joined))):
                heapq.heappush(heap, (rule[0], h, ids[h], joined, rule[1]))
        return [t for t in ids if t >= 0]


def sufficient_lookahead(rules: dict[tuple[int, int], tuple[int, int]], length: dict[int, int]) -> int:
    """Bytes after a token that settle it, whatever follows them.

    ``reach[s]`` lists, by rank, the rules that take token ``s`` as their left part with
    the bytes through which later text can decide whether they apply: the right part's
    length plus what settles the right part.  A right part is unsettled by a rule of
    lower rank that takes it, or by one that takes a token on its right edge before the
    merge that uses this token.
    """
    made: dict[int, list[tuple[int, int, int]]] = {}
    for (left, right), (rank, joined) in rules.items():
        made.setdefault(joined, []).append((left, right, rank))
    reach: dict[int, tuple[list[int], list[int]]] = {}

    def unsettled(token: int, bound: int) -> int:
        far, edge = 0, [(token, bound)]
        while edge:
            t, b = edge.pop()
            if t in reach and (k := bisect_left(reach[t][0], b)):
                far = max(far, reach[t][1][k - 1])
            edge += [(right, rank) for _, right, rank in made.get(t, ()) if rank < b]
        return far

    most = 0
    for (left, right), (rank, _) in sorted(rules.items(), key=lambda r: r[1][0]):
        far = length[right] + unsettled(right, rank)
        ranks, fars = reach.setdefault(left, ([], []))
        ranks.append(rank)
        fars.append(max(far, fars[-1] if fars else 0))
        most = max(most, far)
    return most


class Transducer:
    """bytes in, stable token ids out; ``finish`` ends the pre-token."""

    def __init__(self, merges: Merges, block: int = BLOCK):
        self.merges, self.block, self.buffer = merges, block, bytearray()

    def feed(self, data: bytes) -> list[int]:
        out: list[int] = []
        for i in range(0, len(data), self.block):
            self.buffer += data[i:i + self.block]
            if len(self.buffer) >= self.merges.lookahead + self.block:
                end = 0
                for token in self.merges.encode(bytes(self.buffer)):
                    size = len(self.merges.bytes_of[token])
                    if end + size > len(self.buffer) - self.merges.lookahead:
                        break
                    out.append(token)
                    end += size
                del self.buffer[:end]
        return out

    def finish(self) -> list[int]:
        out = self.merges.encode(bytes(self.buffer))
        self.buffer.clear()
        return out


class Decoder:
    """ids in, text out; an unfinished character waits for its bytes."""

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of, self._utf8 = bytes_of, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int]) -> str:
        return self._utf8.decode(b"".join(map(self.bytes_of.__getitem__, ids)))

    def finish(self) -> str:
        return self._utf8.decode(b"", True)


class Codec:
    """Both directions for one tokenizer file; one per worker process."""

    def __init__(self, path: str):
        self.kit, self.merges = load(path), Merges(path)
        self.bytes_of = self.merges.bytes_of | {i: c.encode() for c, i in self.kit.added.items()}
        self.digits = {i: str(i).encode() for i in self.bytes_of}
        self.cache = PieceCache(self._piece)
        self.run = Transducer(self.merges)      # empty between two pre-tokens

    def _piece(self, piece: str) -> bytes:
        return array("I", [i for ids in self.stream(piece) for i in ids]).tobytes()

    def stream(self, piece: str, step: int = 1 << 16) -> Iterator[list[int]]:
        """Ids of one pre-token as the transducer emits them."""
        data = piece.encode()
        for at in range(0, len(data), step):
            if ids := self.run.feed(data[at:at + step]):
                yield ids
        yield self.run.finish()

    def encode(self, text: str, step: int = 1 << 16):
        """Blocks of ids; a step of pre-tokens at a time for a long text."""
        if self.kit.needs_library(text):
            yield self.kit.library_ids(text)
            return
        for part, special in self.kit.parts(text):
            if special is not None:
                yield [special]
            elif len(part) <= step:
                yield array("I", b"".join(map(self.cache.__getitem__, self.kit.split(part)))).tolist()
            else:
                some: list[bytes] = []
                for m in self.kit.spans(part):
                    if m.end() - m.start() > step:
                        yield array("I", b"".join(some)).tolist()
                        some.clear()
                        yield from self.stream(m[0])
                        continue
                    some.append(self.cache[m[0]])
                    if len(some) >= step // 8:
                        yield array("I", b"".join(some)).tolist()
                        some.clear()
                yield array("I", b"".join(some)).tolist()


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def digests(kit: Codec, text: str) -> tuple[int, str, str]:
    """(tokens, sha256 of the ids joined by commas, sha256 of the decoded text)."""
    ids_sha, text_sha, decoder, n = hashlib.sha256(), hashlib.sha256(), Decoder(kit.bytes_of), 0
    for ids in kit.encode(text):
        if ids:
            ids_sha.update((b"," if n else b"") + b",".join(map(kit.digits.__getitem__, ids)))
            n += len(ids)
            text_sha.update(decoder.feed(ids).encode())
    text_sha.update(decoder.finish().encode())
    return n, ids_sha.hexdigest(), text_sha.hexdigest()


def encode_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array<int>): the general encoder; null text gives an empty array."""
    def run(batch):
        kit = codec(tokenizer)
        ids = [[i for block in kit.encode(t.as_py()) for i in block] for t in batch.column(1)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])
    return map_batches(texts(docs, id_col, text_col), run, "doc_id long, ids array<int>")


def decode_documents(ids: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, text from (doc_id, ids); null ids count as none."""
    def run(batch):
        out = []
        for row in batch.column(1).to_pylist():
            machine = Decoder(codec(tokenizer).bytes_of)
            out.append(machine.feed(row or []) + machine.finish())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])
    return map_batches(ids.select("doc_id", "ids"), run, "doc_id long, text string")


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode and decode every whole text.

    One narrow pass; null text counts as empty (no ids, digest of the empty string);
    rows with null or repeated ids each get a row; extra columns are ignored.
    """
    def run(batch):
        kit = codec(tokenizer)
        rows = [digests(kit, t.as_py()) for t in batch.column(1)]
        n, ids, decoded = zip(*rows)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()),
                                           pa.array(decoded, pa.string())],
                                          ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return map_batches(texts(docs, id_col, text_col), run,
                       "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

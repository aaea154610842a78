"""Token counts, streaming BPE and packing against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lapse.llm import bpe_stream, packing, pretokens, token_counts
from tests.llm.samples import awkward_texts, documents, empty, table

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_counts_equal_library(spark, library):
    for docs in (documents(spark), table(spark, "documents")):
        got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(docs, PATH).collect())
        want = []
        for r in docs.collect():
            n = len(ids_of(library, r.text))
            want.append((r.doc_id or -1, len((r.text or "").encode()), n, n > 512))
        assert got == sorted(want)
    assert token_counts.token_counts(empty(spark), PATH).collect() == []


def test_counts_do_not_depend_on_the_first_tier(spark):
    docs = documents(spark)
    one, two = (sorted((r.doc_id or -1, r.n_tokens) for r in token_counts.token_counts(docs, PATH, table_size=s, per_batch=b).collect())
                for s, b in ((1, 1), (5000, 10_000)))
    assert one == two


def test_split_agrees_with_the_library_for_all_code_points(library):
    kit, split = pretokens.load(PATH), library.pre_tokenizer
    for code in (*range(0x3000), *range(0x1F000, 0x20000), *range(0x3000, 0x110000, 97)):
        if 0xD800 <= code < 0xE000:
            continue
        c = chr(code)
        text = f"a{c}b1{c}2 {c}{c}!{c}?\n{c} {c}"
        if not kit.needs_library(text):
            assert [o for _, o in split.pre_tokenize_str(text)] == [m.span() for m in kit.spans(text)], hex(code)


def test_round_trip(spark, library):
    docs = documents(spark)
    got = sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_stream.round_trip(docs, PATH).collect())
    want = []
    for r in docs.collect():
        ids = ids_of(library, r.text)
        back = library.decode(ids, skip_special_tokens=False)
        want.append((r.doc_id or -1, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(back.encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe_stream.round_trip(empty(spark), PATH).collect() == []
    ids = bpe_stream.encode_documents(docs, PATH)
    back = sorted((r.doc_id or -1, r.text) for r in bpe_stream.decode_documents(ids, PATH).collect())
    assert back == sorted((r.doc_id or -1, r.text or "") for r in docs.collect())


def test_transducer_equals_whole_encoding_and_keeps_little():
    merges, rng = bpe_stream.Merges(PATH), random.Random(7)
    parts = [b"a", b"b", b" ", b"th", b"e", b"tion", b"--", b"==", b"\xc3\xa9", b"er", b"0", b"in"]
    for n in range(120):
        some = parts[:rng.choice([2, 4, 12])]
        data = rng.choice(parts) * rng.randint(1, 2000) if n % 3 == 0 else b"".join(rng.choice(some) for _ in range(rng.randint(1, 2500)))
        run, out = bpe_stream.Transducer(merges, block=rng.choice([1, 9, 64])), []
        for i in range(0, len(data), 50):
            out += run.feed(data[i:i + 50])
            assert len(run.buffer) <= 2 * merges.lookahead + 2 * run.block + 64
        assert out + run.finish() == merges.encode(data)


def test_decoder_waits_for_unfinished_characters(library):
    ids = ids_of(library, "naïve 日本 🙂")
    machine = bpe_stream.Decoder(bpe_stream.codec(PATH).bytes_of)
    assert "".join(machine.feed([i]) for i in ids) + machine.finish() == "naïve 日本 🙂"
    for cut in range(len(ids)):
        machine = bpe_stream.Decoder(bpe_stream.codec(PATH).bytes_of)
        assert machine.feed(ids[:cut]) + machine.finish() == library.decode(ids[:cut], skip_special_tokens=False)


def check_pieces(rows, sizes, window):
    """sizes: document -> ids.  Each id once, sequences gapless; returns the padding."""
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert set(pieces) == set(sizes)
    for doc, own in pieces.items():
        ids, at = np.array(sizes[doc], "<u4"), 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
        padding += window - at if at & (at - 1) else 0
    return padding


def test_packing(spark, library):
    docs = documents(spark, repeat=False)
    sizes = {r.doc_id: ids_of(library, r.text) + [1] for r in docs.collect()}
    for window, most in ((2048, 4096), (64, 4), (2048, 2)):
        rows = packing.pack(docs, PATH, window=window, max_open=most).collect()
        assert check_pieces(rows, sizes, window) == 0
    assert packing.pack(empty(spark), PATH).collect() == []
    repeated = packing.pack(documents(spark), PATH).collect()
    assert sum(r.length for r in repeated) == sum(len(ids_of(library, r.text)) + 1 for r in documents(spark).collect())


def test_packer_takes_the_level_of_least_squares():
    packer = packing.SquaresPacker(10, 0, 100)
    for n in (6, 6, 6):                   # three new windows at level 6
        packer._place(packing.Piece(n, 0, bytes(4 * n), n))
    assert packer.levels[6] == 3
    packer._place(packing.Piece(4, 0, bytes(16), 4))                 # closing one lowers 9 to 4
    assert packer.levels[6] == 2 and len(packer.rows) == 2
    rng, brute = random.Random(1), []
    for _ in range(300):
        size, before = rng.randint(1, 9), packer.levels.copy()
        options = []
        for level in range(0, 11 - size):
            if level == 0 or before[level]:
                after = before.copy()
                after[level] -= level > 0
                after[level + size] += level + size < 10
                options.append((int((after[1:10] ** 2).sum())))
        packer._place(packing.Piece(1, 0, bytes(4 * size), size))
        brute.append(min(options) == int((packer.levels[1:10] ** 2).sum()))
    assert all(brute)


def test_long_pretoken_goes_through_the_transducer(spark, library):
    text = "q" * 9000 + "ab" * 5000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert bpe_stream.round_trip(docs, PATH).first().n_tokens == len(ids_of(library, text))
    assert len(awkward_texts()) == 30


def test_one_long_pre_token_streams_in_bounded_memory():
    """A word of over half a megabyte: the library's ids, from a buffer of a few kilobytes."""
    rng = random.Random(11)
    word = "".join(rng.choice("abcdefghijklmnop") for _ in range(300_000)) + "ab" * 120_000
    kit = bpe_stream.codec(PATH)
    longest, feed = 0, bpe_stream.Transducer.feed

    class Watched(bpe_stream.Transducer):
        def feed(self, data):
            nonlocal longest
            out = []
            for i in range(0, len(data), 1000):
                out += feed(self, data[i:i + 1000])
                longest = max(longest, len(self.buffer))
            return out

    kit.run, before = Watched(kit.merges), kit.run
    try:
        blocks = list(kit.encode(f"see {word} end"))
    finally:
        kit.run = before
    assert [i for b in blocks for i in b] == kit.kit.library_ids(f"see {word} end")
    assert longest < 2 * (kit.merges.lookahead + bpe_stream.BLOCK) and max(map(len, blocks)) <= 1 << 16


def test_packing_keeps_a_quarter_million_words_at_hand():
    class Counting:
        made = 0

        def encode_piece(self, piece):
            self.made += 1
            return [7, 8]

    kit = Counting()
    cache = packing.piece_cache(kit)
    for _ in range(2):
        assert all(cache[f"w{i}"] == b"\7\0\0\0\10\0\0\0" for i in range(250_000))
    assert kit.made == 250_000                       # the second pass encodes nothing again

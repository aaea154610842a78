"""Pre-tokens of a byte-level BPE tokenizer file, split in the worker.

``ByteLevelTokenizer`` reads a tokenizers ``.json`` file.  Texts are split with
the file's byte-level pattern, then each distinct pre-token is encoded once and
remembered.  Added tokens of the file that stand in a text are matched first, as
the library does by default.  Two rules keep the split equal to the library's:
texts of Latin code points use an explicit class pattern (fast), the rest use
Unicode properties, and texts with code points that newer Unicode versions have
assigned since the library's tables go to the library whole.
"""

from __future__ import annotations

import json
import os
import re

import regex
from tokenizers import Tokenizer

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

# The byte-level split pattern, as properties and spelled out for U+0000-U+024F.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_L = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
_N = "0-9\xb2\xb3\xb9\xbc-\xbe"
_S = "\t-\r \x85\xa0"
LATIN_PATTERN = f" ?[{_L}]+|'(?:[stmd]|re|ve|ll)| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
# Code points whose class differs between the library's Unicode tables and newer ones.
NEWER = ("՘֋֌࢏౜೜₏₝-₟ꟍ-ꟿ꭬꭭\U000107bb-\U0001e6ff"
         "\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U0003ffff")

_find_latin = re.compile(LATIN_PATTERN).findall
_find_any = regex.compile(PATTERN).findall
_iter_latin = re.compile(LATIN_PATTERN).finditer
_iter_any = regex.compile(PATTERN).finditer
_not_latin = re.compile("[^\0-ɏ]").search
_newer = re.compile(f"[{NEWER}]").search


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in vocabulary entries."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(kept)]
    letters = {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


class ByteLevelTokenizer:
    """The library's tokenizer with its parts in reach: split, encode one pre-token."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or split["type"] != "ByteLevel" or split["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("a byte-level BPE file without normaliser and prefix space is needed")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that strip or need word borders aren't covered")
        names = sorted(self.added, key=len, reverse=True)
        self._added = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        self._first = names and os.path.commonprefix(names) or ""
        self._letters = dict(enumerate(byte_letters()))
        self._tokenize = self.library.model.tokenize

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one pre-token."""
        return [t.id for t in self._tokenize(piece.encode().decode("latin-1").translate(self._letters))]

    def parts(self, text: str) -> list[tuple[str, int | None]]:
        """The text cut at added tokens: (ordinary text, None) or (content, id)."""
        if self._added is None or self._first not in text:
            return [(text, None)]
        return [(p, self.added.get(p) if i % 2 else None) for i, p in enumerate(self._added.split(text)) if p]

    @staticmethod
    def split(text: str) -> list[str]:
        return (_find_any if _not_latin(text) else _find_latin)(text)

    @staticmethod
    def spans(text: str):
        """Lazy form of ``split``: match objects."""
        return (_iter_any if _not_latin(text) else _iter_latin)(text)

    @staticmethod
    def needs_library(text: str) -> bool:
        return not text.isascii() and _newer(text) is not None

    def library_ids(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids


_LOADED: dict[str, ByteLevelTokenizer] = {}


def load(path: str) -> ByteLevelTokenizer:
    """One tokenizer per worker process and file."""
    if path not in _LOADED:
        _LOADED[path] = ByteLevelTokenizer(path)
    return _LOADED[path]


class PieceCache(dict):
    """pre-token -> value, filled on a miss.  Two generations of at most ``room`` entries
    each: a full young one becomes the old one, whose entries come back when used, so a
    worker's memory stays bounded.  Long pre-tokens are never kept."""

    def __init__(self, make, room: int = 150_000, longest: int = 64):
        super().__init__()
        self.make, self.room, self.longest, self.old = make, room, longest, {}

    def __missing__(self, piece: str):
        value = self.old.get(piece)
        if value is None:
            value = self.make(piece)
        if len(piece) <= self.longest:
            if len(self) >= self.room:
                self.old = dict(self)
                self.clear()
            self[piece] = value
        return value

"""Vocabularies of public tokenizers, and encoders that remember what each chunk of text becomes.

A chunk is what stands between two spaces. Its ids don't depend on its neighbours as long as it
is neither empty nor begins or ends in white space; other texts are encoded in one go.
"""

from __future__ import annotations

import json
import re
import struct
from functools import cache

# How the byte-level vocabulary splits text before merging.
BYTE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# How the word-end vocabulary splits lower-cased text.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""
#: Entries that a chunk cache holds before it starts anew: some 150 MB.
CACHE_ENTRIES = 800_000
#: White space of this length or more goes to the tokenizers library: the faster one gives up on much longer runs.
BLANK_RUN = 10_000


class OddChunk(Exception):
    """A chunk that can't be encoded apart from its neighbours."""


def byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, and the byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Vocabulary:
    """Token bytes, merges and special tokens of a tokenizers file; ``end`` replaces its word-end suffix."""

    def __init__(self, path: str, end: bytes = b"\xff") -> None:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model = data["model"]
        chars, suffix = byte_characters(), model.get("end_of_word_suffix") or ""

        def raw(token: str) -> bytes:
            ended = bool(suffix) and token.endswith(suffix)
            token = token[: -len(suffix)] if ended else token
            return bytes(chars[c] for c in token) + end * ended

        self.ids = {raw(t): i for t, i in model["vocab"].items()}
        self.specials = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.size = 1 + max([*self.ids.values(), *self.specials.values()])
        self.merges = [tuple(raw(p) for p in (m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
        self.has_word_ends = bool(suffix)

    def token_bytes(self) -> list[bytes]:
        out = [b""] * self.size
        for t, i in self.ids.items():
            out[i] = t
        for t, i in self.specials.items():
            out[i] = t.encode()
        return out


def packed(ids) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class ChunkCache(dict):
    """Chunk to little-endian 32-bit ids; what is missing is encoded and kept while there is room."""

    def __init__(self, encode, entries: int = CACHE_ENTRIES) -> None:
        super().__init__()
        self.encode, self.entries = encode, entries

    def __missing__(self, chunk: str) -> bytes:
        value = self.encode(chunk)
        if len(self) >= self.entries:
            self.clear()
        self[chunk] = value
        return value


class SpacedEncoder:
    """For byte-level vocabularies, whose tokens take a space before them along.

    ``encode_text(text)`` gives the ids of any text; chunks are given to it with their space.
    """

    def __init__(self, encode_text, entries: int = CACHE_ENTRIES) -> None:
        self.encode_text = encode_text
        self.rest = ChunkCache(lambda c: self.one(c, " "), entries)
        self.first = ChunkCache(lambda c: self.one(c, ""), 10_000)

    def one(self, chunk: str, before: str) -> bytes:
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            raise OddChunk
        return packed(self.encode_text(before + chunk))

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        head, *rest = text.split(" ")
        try:
            return self.first[head] + b"".join(map(self.rest.__getitem__, rest))
        except OddChunk:
            return packed(self.encode_text(text))


class WordEncoder:
    """For the vocabulary with word ends, in which white space only separates."""

    #: Python takes these for white space, the vocabulary's file doesn't.
    SEPARATORS = "\x1c\x1d\x1e\x1f"

    def __init__(self, path: str) -> None:
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.end = b"\xff"
        vocabulary = Vocabulary(path, self.end)
        ranks = vocabulary.ids | {self.end: vocabulary.size + 1}
        self.merge = tiktoken.Encoding("words", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.pieces = regex.compile(WORD_PATTERN).findall
        self.marks = {c: self.merge(c.encode() + self.end) for c in ".,;:!?"}
        self.chunks = ChunkCache(self.one)

    def one(self, chunk: str) -> bytes:
        if chunk.isascii():
            if chunk.isalpha():  # one piece
                return packed(self.merge(chunk.lower().encode() + self.end))
            if chunk[:-1].isalpha() and chunk[-1] in ".,;:!?":
                return packed(self.merge(chunk[:-1].lower().encode() + self.end) + self.marks[chunk[-1]])
        elif max(chunk) >= "\u0300":  # may compose, or be lowered otherwise
            return packed(self.library.encode(chunk, add_special_tokens=False).ids)
        if "<|" in chunk:
            return packed(self.library.encode(chunk, add_special_tokens=False).ids)
        ids: list[int] = []
        for piece in self.pieces(chunk.lower()):
            ids += self.merge(piece.encode() + self.end)
        return packed(ids)

    def encode(self, text: str) -> bytes:
        if any(c in text for c in self.SEPARATORS):
            return packed(self.library.encode(text, add_special_tokens=False).ids)
        return b"".join(map(self.chunks.__getitem__, text.split()))


@cache
def byte_encoder(path: str) -> SpacedEncoder:
    """The ids that the tokenizers library gives for a byte-level file, from the same ranks; one per worker."""
    import tiktoken
    from tokenizers import Tokenizer

    vocabulary = Vocabulary(path)
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    fast = tiktoken.Encoding("bytes", pat_str=BYTE_PATTERN, mergeable_ranks=vocabulary.ids, special_tokens={}).encode_ordinary
    specials = list(vocabulary.specials)
    long_blank = re.compile(rf"\s{{{BLANK_RUN}}}").search

    def encode_text(text: str):
        if any(s in text for s in specials) or len(text) >= BLANK_RUN and long_blank(text):
            return library.encode(text, add_special_tokens=False).ids
        return fast(text)

    return SpacedEncoder(encode_text, CACHE_ENTRIES // 3)  # what is missing costs little here


@cache
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)

"""Byte-pair encoding by one pass over prefixes.

In a merge vocabulary whose parts always rank below what they form, every prefix of a text has
one last token. An automaton over all tokens tells, at each byte, the tokens that end there,
longest first; the first whose left neighbour (the last token of what is before it) may stand
beside it is the last token of this prefix. Back-pointers from the end give the ids.

Two tokens may stand side by side if merging their bytes in rank order never joins them. That is
decided on the parts at their common border: each token's border part changes as the token is
built, and at no time may the two parts of the moment form a pair that is merged before either
of them is used up. On equal ranks the left one goes first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from briefspark.llm.shared import table
from briefspark.llm.tokens import BYTE_PATTERN, SpacedEncoder, Vocabulary, public_path

NEVER = 1 << 60
PAIRS_KEPT = 500_000
PIECES_KEPT = 300_000


class PrefixBpe:
    def __init__(self, path: str) -> None:
        import ahocorasick
        import regex

        v = Vocabulary(path)
        if v.has_word_ends:
            raise ValueError("only for byte-level vocabularies")
        self.ids, self.bytes, self.specials = v.ids, v.token_bytes(), v.specials
        rank = {t: -1 for t in v.ids if len(t) == 1}
        self.join: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank = [-1] * v.size
        for r, (a, b) in enumerate(v.merges):
            if rank.get(a, NEVER) >= r or rank.get(b, NEVER) >= r or a + b in rank:
                raise ValueError(f"merge {r} isn't of parts that rank below it, or repeats a token")
            rank[a + b] = r
            whole = v.ids[a + b]
            self.join[v.ids[a], v.ids[b]] = r
            self.parts[whole] = v.ids[a], v.ids[b]
            self.rank[whole] = r
        if len(rank) != len(v.ids):
            raise ValueError("some tokens have no merge")
        self.ends = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for t, i in v.ids.items():
            self.ends.add_word(t.decode("latin-1"), (i, len(t)))
        self.ends.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.pieces: dict[str, list[int]] = {}
        self.split = regex.compile(BYTE_PATTERN).findall
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(v.specials, key=len, reverse=True))) + ")") if v.specials else None

    def border(self, token: int, side: int) -> list[int]:
        """The parts at one side of a token (0: left, 1: right), from a single byte up to the token."""
        out = [token]
        while token in self.parts:
            token = self.parts[token][side]
            out.append(token)
        return out[::-1]

    def beside(self, key: int) -> bool:
        """Whether the encoding of two tokens' bytes is these two tokens; ``key`` has the left one above 32 bits."""
        if len(self.pairs) >= PAIRS_KEPT:
            self.pairs.clear()
        known = self.pairs[key] = self._beside(self.border(key >> 32, 1), self.border(key & 0xFFFFFFFF, 0))
        return known

    def _beside(self, lefts: list[int], rights: list[int]) -> bool:
        i = j = 0
        while True:
            left_until = self.rank[lefts[i + 1]] if i + 1 < len(lefts) else NEVER
            right_until = self.rank[rights[j + 1]] if j + 1 < len(rights) else NEVER
            merged = self.join.get((lefts[i], rights[j]), NEVER)
            if merged < left_until and merged <= right_until:
                return False
            if left_until == right_until == NEVER:
                return True
            if left_until <= right_until:
                i += 1
            else:
                j += 1

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of what the pattern has split off."""
        whole = self.ids.get(piece)
        if whole is not None:  # the longest token that ends here, with nothing before it
            return [whole]
        last = [-1] * (len(piece) + 1)
        known, beside, done = self.pairs.get, self.beside, -1
        for end, (token, n) in self.ends.iter(piece.decode("latin-1")):
            if end == done:
                continue
            if n > end:
                last[end + 1], done = token, end
                continue
            key = last[end + 1 - n] << 32 | token
            fits = known(key)
            if fits or fits is None and beside(key):
                last[end + 1], done = token, end
        out, at = [], len(piece)
        while at:
            out.append(last[at])
            at -= len(self.bytes[last[at]])
        return out[::-1]

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text; a special token's string becomes its id."""
        if text[1:].isalpha() and text.isascii() and (text[0] == " " or text[0].isalpha()):  # one piece
            return self.encode_piece(text.encode())
        if not self.special or not self.special.search(text):
            return self.encode_part(text)
        out: list[int] = []
        for k, part in enumerate(self.special.split(text)):
            out += [self.specials[part]] if k % 2 else self.encode_part(part)
        return out

    def encode_part(self, text: str) -> list[int]:
        out: list[int] = []
        for piece in self.split(text):
            ids = self.pieces.get(piece)
            if ids is None:
                if len(self.pieces) >= PIECES_KEPT:
                    self.pieces.clear()
                ids = self.pieces[piece] = self.encode_piece(piece.encode())
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


@cache
def prefix_encoder(path: str) -> tuple[PrefixBpe, SpacedEncoder]:
    bpe = PrefixBpe(path)
    return bpe, SpacedEncoder(bpe.encode)


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encode and decode every text; no shuffle.

    Returns doc_id, n_tokens, ids_sha256 (of the decimal ids, comma-joined) and decoded_sha256,
    with ``keep_ids`` also ids (array) and decoded (text). A null text is empty: no ids.
    Repeated rows get equal results.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        bpe, encoder = prefix_encoder(path)
        decimal = [str(i) for i in range(len(bpe.bytes))]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                counts, id_digests, text_digests, all_ids, texts = [], [], [], [], []
                for text in part.column(1).to_pylist():
                    ids = np.frombuffer(encoder.encode(text or ""), "<u4").tolist()
                    decoded = bpe.decode(ids)
                    counts.append(len(ids))
                    id_digests.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                    text_digests.append(hashlib.sha256(decoded.encode()).hexdigest())
                    if keep_ids:
                        all_ids.append(ids)
                        texts.append(decoded)
                arrays = [part.column(0), pa.array(counts, pa.int64()), pa.array(id_digests, pa.string()), pa.array(text_digests, pa.string())]
                if keep_ids:
                    arrays += [pa.array(all_ids, pa.list_(pa.int64())), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(arrays)])

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<bigint>, decoded string" * keep_ids
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, schema)


def op2_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"), path or public_path("byte_bpe_50k.json"))

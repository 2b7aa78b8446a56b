"""Byte-level BPE by prefix dynamic programming.

For every byte prefix of a piece exactly one vocabulary token can be the last token of the prefix's
encoding. A PrefixTable stores it for each prefix, so the encoding of any prefix is read by walking
back, bytes can be appended exactly, and an edit redoes the table only from the edit until it agrees
with the old table over as many prefixes as the longest token has bytes.

A token may follow another one exactly if encoding both together keeps them apart. That is decided
by taking the two tokens apart along the boundary, latest merge first: if, on the way, a pair across
the boundary would have merged before the parts were built, the boundary doesn't hold.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache
from itertools import chain

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granulon.llm.common import Recent, map_rows, text_of

#: Entries each worker keeps of pieces, of prefixes' last tokens, and of token pairs; bytes of a piece whose prefixes are kept.
MAX_PIECES, MAX_PREFIXES, MAX_PAIRS = 500_000, 600_000, 400_000
LONGEST_PIECE = 64


class ByteBPE:
    """Ranks of a byte-level vocabulary: {bytes: id}, ids in the order of the merges."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.longest = max(map(len, ranks))
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.usable: dict[bytes, int] = {}
        self._pairs: dict[tuple[int, int], bool] = {}
        self._prefixes: dict[bytes, int] = {}
        self._pieces = Recent(self.encode_piece, MAX_PIECES)
        for token, i in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) == 1:
                self.usable[token] = i
                continue
            for k in range(1, len(token)):
                a, b = self.usable.get(token[:k]), self.usable.get(token[k:])
                if a is not None and b is not None and self._apart(a, b):
                    self.parts[i] = (a, b)
                    self.merged[a, b] = i
                    self.usable[token] = i
                    break  # a token without such parts is never made by merges; only a whole piece can be it
        self._pairs.clear()
        # Of the last three bytes of a prefix: how long tokens with that end are, longest first; 2 and 1 always may be.
        ends: dict[bytes, set[int]] = {}
        for token in self.usable:
            if len(token) > 2:
                ends.setdefault(token[-3:], set()).add(len(token))
        self.lengths = {end: (*sorted(found, reverse=True), 2, 1) for end, found in ends.items()}

    @classmethod
    def from_file(cls, path: str, pattern: str) -> ByteBPE:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pattern)

    def _apart(self, a: int, b: int) -> bool:
        """Whether tokens a and b stay side by side when their bytes are encoded together."""
        before = len(self.ranks)
        while True:
            joint = self.merged.get((a, b))
            if joint is not None and joint < before:
                return False
            left, right = self.parts.get(a), self.parts.get(b)
            if left is None and right is None:
                return True
            # What was merged last is undone first. On equal tokens the left one was merged first.
            if right is None or (left is not None and a > b):
                before, a = a, left[1]
            else:
                before, b = b + 1, right[0]

    def may_follow(self, a: int, b: int) -> bool:
        known = self._pairs.get((a, b))
        if known is None:
            if len(self._pairs) >= MAX_PAIRS:
                self._pairs.clear()
            known = self._pairs[a, b] = self._apart(a, b)
        return known

    def table(self, data: bytes = b"") -> PrefixTable:
        return PrefixTable(self, data)

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        """Ids of one match of the pattern; a piece that is a token as a whole is that token.

        What ends a prefix is the same in all pieces, so a piece goes on from the longest prefix known.
        """
        data = piece.encode()
        whole = self.ranks.get(data)
        if whole is not None:
            return (whole,)
        table = PrefixTable(self)
        if len(data) > LONGEST_PIECE:
            table.append(data)
            return tuple(table.ids())
        known, last = self._prefixes, table.last
        if len(known) > MAX_PREFIXES:
            known.clear()
        table.data = data
        for end in range(1, len(data) + 1):
            prefix = data[:end]
            token = known.get(prefix)
            if token is None:
                token = known[prefix] = table.last_token(end)
            last.append(token)
        return tuple(table.ids())

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self._pieces.__getitem__, self.pattern.findall(text))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class PrefixTable:
    """The last token of every prefix of some bytes."""

    def __init__(self, bpe: ByteBPE, data: bytes = b""):
        self.bpe, self.data, self.last = bpe, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        """Add bytes at the end; what is stored of the prefixes so far stays as it is."""
        self.data += more
        for end in range(len(self.last), len(self.data) + 1):
            self.last.append(self.last_token(end))

    def last_token(self, end: int) -> int:
        """The token that ends the encoding of data[:end], given those of all shorter prefixes."""
        data, last, bpe = self.data, self.last, self.bpe
        for n in bpe.lengths.get(data[max(0, end - 3) : end], (2, 1)):
            start = end - n
            if start >= 0:
                token = bpe.usable.get(data[start:end])
                if token is not None:
                    if start == 0:
                        return token
                    follows = bpe._pairs.get((last[start], token))
                    if follows or (follows is None and bpe.may_follow(last[start], token)):
                        return token
        raise ValueError("the vocabulary lacks a byte")

    def edit(self, start: int, stop: int, new: bytes) -> int:
        """Replace data[start:stop]; returns how many prefixes were worked out anew."""
        old, shift = self.last, len(new) - (stop - start)
        self.data = self.data[:start] + new + self.data[stop:]
        self.last = old[: start + 1]
        same = done = 0
        for end in range(start + 1, len(self.data) + 1):
            token = self.last_token(end)
            self.last.append(token)
            done += 1
            # The next entry depends on no more than the last `longest` entries and bytes.
            same = same + 1 if end - shift >= stop + 1 and old[end - shift] == token else 0
            if same >= self.bpe.longest:
                self.last += old[end - shift + 1 :]
                break
        return done

    def ids(self, end: int | None = None) -> list[int]:
        """The encoding of data[:end]."""
        end, out = len(self.data) if end is None else end, []
        while end:
            out.append(self.last[end])
            end -= len(self.bpe.bytes_of[out[-1]])
        return out[::-1]


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> ByteBPE:
    """One encoder for each worker process."""
    return ByteBPE.from_file(path, pattern)


def encode_documents(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every whole text.

    Null text counts as empty and has no ids; repeated rows give repeated results; other columns are
    left out, so their names can't clash; an empty table gives an empty table.
    """

    def make():
        bpe = load(path, pattern)
        return lambda c: [c["id"], list(map(bpe.encode, c["text"]))]

    kind = df.schema[id_col].dataType.simpleString()
    return map_rows(df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")), make, f"{id_col} {kind}, ids array<int>")


def decode_documents(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, bytes binary) of id lists; null counts as an empty list."""

    def make():
        bpe = load(path, pattern)
        return lambda c: [c["id"], [bpe.decode(x or []) for x in c["ids"]]]

    kind = df.schema[id_col].dataType.simpleString()
    return map_rows(df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")), make, f"{id_col} {kind}, bytes binary")


def round_trip(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of each document's ids and of what they decode to, in one pass without a shuffle."""

    def make():
        bpe = load(path, pattern)
        decimal = {i: str(i) for i in bpe.bytes_of}.__getitem__

        def step(c):
            counts, hashes, decoded = [], [], []
            for text in c["text"]:
                ids = bpe.encode(text)
                counts.append(len(ids))
                hashes.append(hashlib.sha256(",".join(map(decimal, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            return [c["id"], counts, hashes, decoded]

        return step

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    return map_rows(rows, make, f"{id_col} {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")

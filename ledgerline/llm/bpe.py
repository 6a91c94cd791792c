"""Byte-level BPE by monoid tree reduction: halves are encoded and joined at their seam, up a tree.

A rank file gives each token's bytes and its rank; lower ranks merge first. Encoded byte strings form a
monoid: two encodings join by encoding a window of tokens around the seam again, and the window doubles on
the side that has not settled. A side has settled when its outermost new token and the old token next to it
encode, together, to exactly those two: a token row is the encoding of its bytes if and only if that holds of
every two neighbours, so nothing further out can change. Decoding concatenates up the same tree.

The pattern splits a text first; no token crosses a match, so matches join by plain concatenation.

Null text is the empty text: no ids, nothing decoded. Rows keep all their columns; a column that has the
name of the new one is replaced. Very long texts and matches need memory in proportion to their own length.
"""

from __future__ import annotations

import base64
from array import array
from functools import lru_cache

import pyarrow as pa
import pyarrow.fs
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

#: Byte strings of up to so many bytes are leaves of the tree.
LEAF_BYTES = 32
#: Encoded matches and checked neighbours that a worker remembers; it forgets all at once when full.
REMEMBERED = 500_000
NO_MERGE = 1 << 62


class Known(dict):
    """Matches and their ids as little-endian unsigned 32-bit integers; a match that is new is encoded."""

    def __init__(self, own: "Codec"):
        self.own = own

    def __missing__(self, match: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        piece = match.encode()
        ids = [whole] if (whole := self.own.rank.get(piece)) is not None else self.own.tree(piece)
        found = array("I", ids).tobytes()
        if len(piece) <= 4 * LEAF_BYTES:
            self[match] = found
        return found


class Codec:
    """The vocabulary of one rank file, with what this worker has encoded before."""

    def __init__(self, rank_path: str, pattern: str):
        if "://" in rank_path:
            filesystem, at = pa.fs.FileSystem.from_uri(rank_path)
            with filesystem.open_input_stream(at) as f:
                lines = f.read().splitlines()
        else:
            with open(rank_path, "rb") as f:
                lines = f.read().splitlines()
        self.rank = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x)}
        self.bytes_of = {r: t for t, r in self.rank.items()}
        self.split = regex.compile(pattern).findall
        #: For two first bytes, the length of the longest token.
        self.longest: dict[bytes, int] = {}
        for token in self.rank:
            self.longest[token[:2]] = max(len(token), self.longest.get(token[:2], 0))
        self.known = Known(self)
        self.neighbours: dict[int, bool] = {}

    def merged(self, piece: bytes) -> list[int]:
        """The encoding by its definition: merge the leftmost pair of the lowest rank until none is left."""
        rank = self.rank.get
        parts = [piece[i : i + 1] for i in range(len(piece))]
        ranks = [rank(a + b, NO_MERGE) for a, b in zip(parts, parts[1:])]
        while (best := min(ranks, default=NO_MERGE)) != NO_MERGE:
            i = ranks.index(best)
            parts[i] += parts.pop(i + 1)
            del ranks[i]
            if i:
                ranks[i - 1] = rank(parts[i - 1] + parts[i], NO_MERGE)
            if i < len(ranks):
                ranks[i] = rank(parts[i] + parts[i + 1], NO_MERGE)
        return [self.rank[x] for x in parts]

    def settled(self, left: int, right: int) -> bool:
        """Whether these two tokens, side by side, are the encoding of their bytes."""
        key = left << 32 | right
        if (found := self.neighbours.get(key)) is None:
            if len(self.neighbours) >= REMEMBERED:
                self.neighbours.clear()
            found = self.neighbours[key] = self.merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return found

    def leaf(self, piece: bytes) -> list[int]:
        """The one row of tokens over a short byte string of which every two neighbours are settled.

        From the left, longest tokens first; a place from which no row goes on is not tried again, as each
        prefix has one encoding only.
        """
        rank, longest, end = self.rank.get, self.longest.get, len(piece)
        ids: list[int] = []
        starts: list[int] = []
        dead: set[int] = set()
        at, before, stop = 0, -1, min(end, longest(piece[:2], 1))
        while at < end:
            while stop > at:
                token = rank(piece[at:stop])
                if token is not None and stop not in dead and (before < 0 or self.settled(before, token)):
                    break
                stop -= 1
            if stop > at:
                ids.append(token)
                starts.append(at)
                at, before = stop, token
                stop = min(end, at + longest(piece[at : at + 2], 1))
            else:
                dead.add(at)
                stop = at - 1
                ids.pop()
                at = starts.pop()
                before = ids[-1] if ids else -1
        return ids

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two byte strings together, from their encodings."""
        if not left or not right:
            return left + right
        i = j = 1
        while True:
            seam = self.leaf(self.decode(left[-i:] + right[:j]))
            left_holds = i == len(left) or self.settled(left[-i - 1], seam[0])
            right_holds = j == len(right) or self.settled(seam[-1], right[j])
            if left_holds and right_holds:
                return left[:-i] + seam + right[j:]
            i = i if left_holds else min(2 * i, len(left))
            j = j if right_holds else min(2 * j, len(right))

    def tree(self, piece: bytes) -> list[int]:
        """The encoding of one match: halves first, then their join."""
        if len(piece) <= LEAF_BYTES:
            return self.leaf(piece)
        middle = len(piece) // 2
        return self.join(self.tree(piece[:middle]), self.tree(piece[middle:]))

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.known.__getitem__, self.split(text)))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=4)
def codec(rank_path: str, pattern: str) -> Codec:
    return Codec(rank_path, pattern)


def encoded(text: Column, rank_path: str, pattern: str) -> Column:
    """The ids of a text as little-endian unsigned 32-bit integers, 4 bytes each."""

    @F.arrow_udf(BinaryType())
    def encode(texts: pa.Array) -> pa.Array:
        own = codec(rank_path, pattern)
        return pa.array((own.encode(x.as_py()) if x.is_valid else b"" for x in texts), pa.binary())

    return encode(text)


def decoded(ids: Column, rank_path: str, pattern: str) -> Column:
    """The bytes that ids stand for."""

    @F.arrow_udf(BinaryType())
    def decode(packed: pa.Array) -> pa.Array:
        own = codec(rank_path, pattern)
        return pa.array((own.decode(memoryview(x.as_py()).cast("I")) if x.is_valid else b"" for x in packed), pa.binary())

    return decode(ids)


def encode_texts(docs: DataFrame, rank_path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with a binary column `ids`: each text's token ids, 4 bytes each."""
    return docs.withColumn(ids, encoded(F.col(text), rank_path, pattern))


def decode_texts(docs: DataFrame, rank_path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """docs with a binary column `decoded`: the bytes of each row's token ids."""
    return docs.withColumn(out, decoded(F.col(ids), rank_path, pattern))

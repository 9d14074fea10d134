"""Byte-level BPE encoding and decoding over DataFrames.

Each piece of a text (a match of the split pattern) is mapped byte by byte to Latin-1, so that one Aho-Corasick pass
lists every vocabulary token that occurs in it.  The merges are then reproduced without merging: from the left, the
longest token that is compatible with its left neighbour is taken; a position from which no token leads on is marked
dead and the search steps back.  Two tokens are compatible if merging their joined bytes would give back those two
tokens, an answer that is kept.  A prefix has one valid encoding only, so a position is left at most once and the work is
linear in the piece.

Defined results: a null text counts as empty (no ids); repeated rows give repeated rows; empty tables give empty
frames; columns other than the keys and the text are not carried, so their names cannot clash.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Callable, Iterator
from functools import cached_property

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm.held import held

#: Pieces and pairs remembered by a Python worker at most; beyond, the memory starts anew.
KEPT = 150_000
#: Texts a step, so that little is held at once.
STEP = 1_000
#: Above every rank.
NEVER = 1 << 60


class ByteBpe:
    """A rank file (base64 token, rank) with its split pattern."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.pieces = regex.compile(pattern).findall
        self.pairs: dict[int, bool] = {}
        self.joined: dict[int, tuple[int, int]] = {}
        self.packed = _Packed(self)

    @cached_property
    def tokens(self) -> ahocorasick.Automaton:
        """Finds every token in a piece."""
        tokens = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            tokens.add_word(token.decode("latin-1"), (len(token), rank))
        tokens.make_automaton()
        return tokens

    @cached_property
    def length_of(self) -> dict[int, int]:
        """Bytes of each token."""
        return {rank: len(token) for token, rank in self.ranks.items()}

    @cached_property
    def shorter(self) -> dict[int, int]:
        """The longest token that begins a token, -1 if none does."""
        return {r: next((self.ranks[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.ranks), -1) for t, r in self.ranks.items()}

    def merged(self, piece: bytes, parts_left: int = 1) -> list[int]:
        """The merges by definition: time and again join the leftmost adjacent pair of lowest rank."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > parts_left:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1))
            if rank == NEVER:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def halves(self, token: int) -> tuple[int, int]:
        """What the last merge of a token joins; (-1, -1) for a byte, (-1, 0) for a token that merging never makes."""
        known = self.joined.get(token)
        if known is None:
            own = self.bytes_of[token]
            if len(own) == 1:
                known = (-1, -1)
            else:
                parts = self.merged(own, 2)
                known = (parts[0], parts[1]) if len(parts) == 2 and self.merged(own) == [token] else (-1, 0)
            self.joined[token] = known
        return known

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging keeps these two tokens apart and whole; left is -1 at the start of a piece.

        Both are taken apart again along their common border, the part that was made last first.  Merging keeps them
        apart if no two parts that met there could be joined sooner than what was made instead.
        """
        key = left << 20 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= KEPT:
                self.pairs.clear()
            self.pairs[key] = known = self.halves(right) != (-1, 0) and (left < 0 or self._apart(left, right))
        return known

    def _apart(self, left: int, right: int) -> bool:
        sooner = NEVER
        while True:
            if self.ranks.get(self.bytes_of[left] + self.bytes_of[right], NEVER) < sooner:
                return False
            (_, inner_left), (inner_right, _) = self.halves(left), self.halves(right)
            made_left, made_right = left if inner_left >= 0 else -1, right if inner_right >= 0 else -1
            if made_left < 0 and made_right < 0:
                return True
            if made_left > made_right:
                sooner, left = made_left, inner_left
            else:  # of equal merges the left one comes first
                sooner, right = made_right + 1, inner_right

    def piece_ids(self, piece: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        size = len(piece)
        longest = [-1] * size
        for last, (length, token) in self.tokens.iter(piece.decode("latin-1")):
            longest[last - length + 1] = token  # longer tokens come later
        dead = bytearray(size + 1)
        ids: list[int] = []
        length_of, pairs = self.length_of, self.pairs
        at, left, token = 0, -1, longest[0] if size else -1
        while at < size:
            while token >= 0:
                if not dead[at + length_of[token]]:
                    fits = pairs.get(left << 20 | token)
                    if fits or fits is None and self.compatible(left, token):
                        break
                token = self.shorter[token]
            if token >= 0:
                ids.append(token)
                at += length_of[token]
                left, token = token, longest[at] if at < size else -1
            elif not ids:
                raise ValueError("the vocabulary lacks a byte of the text")
            else:
                dead[at] = 1
                token = self.shorter[last_id := ids.pop()]
                at -= length_of[last_id]
                left = ids[-1] if ids else -1
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if len(self.packed) > KEPT:
            self.packed.clear()
        return b"".join(map(self.packed.__getitem__, self.pieces(text)))

    def decode(self, packed: bytes) -> bytes:
        """The bytes that packed ids stand for."""
        return b"".join(map(self.bytes_of.__getitem__, memoryview(packed).cast("I") if _LITTLE else struct.unpack(f"<{len(packed) // 4}I", packed)))


_LITTLE = struct.pack("=I", 1) == struct.pack("<I", 1)


class _Packed(dict):
    """Piece to packed ids, filled on demand."""

    def __init__(self, bpe: ByteBpe) -> None:
        super().__init__()
        self.bpe = bpe

    def __missing__(self, piece: str) -> bytes:
        ids = self.bpe.piece_ids(piece.encode())
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= 64:
            self[piece] = out
        return out


def load(path: str, pattern: str) -> ByteBpe:
    """One vocabulary a Python worker, until another operator's tables take its place."""
    return held(("bpe", path, pattern), lambda: ByteBpe(path, pattern))


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from (batch.slice(i, STEP) for i in range(0, batch.num_rows, STEP))


Path = str | Callable[[], str]


def _load(path: Path, pattern: str) -> ByteBpe:
    return load(path if isinstance(path, str) else path(), pattern)


def encode(docs: DataFrame, path: Path, pattern: str, key: str = "doc_id", text: str = "text", decoded: str | None = None) -> DataFrame:
    """Key, ``n_tokens`` and ``ids`` (packed little-endian unsigned 32-bit) of every whole text.

    ``path`` may be a function, which each worker asks on its own machine. With ``decoded``, a column of that name gets the bytes that the ids decode to, for a check of the round trip.
    """
    names = [key, "n_tokens", "ids", *([decoded] if decoded else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _load(path, pattern)
        for batch in _steps(batches):
            ids = [bpe.encode(x) if x else b"" for x in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
            if decoded:
                columns.append(pa.array([bpe.decode(x) for x in ids], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = T.StructType([docs.schema[key], T.StructField("n_tokens", T.LongType()), *(T.StructField(n, T.BinaryType()) for n in names[2:])])
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: Path, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns of ``encoded`` and the bytes that its ids stand for; a column of that name is replaced, null ids count as none."""
    kept = [c for c in encoded.columns if c != out]
    at = kept.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _load(path, pattern)
        for batch in _steps(batches):
            texts = [bpe.decode(x) if x else b"" for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], [*kept, out])

    schema = T.StructType([*(encoded.schema[c] for c in kept), T.StructField(out, T.BinaryType())])
    return encoded.select(*kept).mapInArrow(run, schema)


def unpack(ids: str = "ids") -> F.Column:
    """Packed ids as an array of integers."""
    word = F.hex(F.col(ids))
    at = F.sequence(F.lit(0), F.floor(F.length(F.col(ids)) / 4).cast("int") - 1)
    one = lambda i: F.conv(F.concat(*[F.substring(word, i * 8 + j, F.lit(2)) for j in (7, 5, 3, 1)]), 16, 10).cast("int")
    return F.when(F.length(F.col(ids)) >= 4, F.transform(at, one)).otherwise(F.array().cast("array<int>"))

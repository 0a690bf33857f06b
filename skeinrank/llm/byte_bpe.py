"""Byte-level BPE: encode by backtracking over longest matches, and decode.

A piece's bytes are read as Latin-1 characters, so that one Aho-Corasick pass finds, for
each position, the longest vocabulary entry that begins there. Encoding walks from the
left, taking the longest entry that is compatible with its left neighbour; a pair of
entries is compatible when merging the two entries' bytes by rank gives the same pair
back, which is found by undoing merges along the border and is memoised. A position from
which no entry fits is marked and never tried again, so the walk is linear. Entries that
no sequence of merges can make are kept out of the walk (a whole piece may still be one,
as in the rank file's own semantics).

Edge cases: a null or empty text has no ids and decodes to nothing; text of any length is
encoded whole (very long ones in parts cut where a piece must end); repeated rows give
equal results; extra input columns are carried only if asked for by `keep`; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import kept, sliced

#: White space as the Unicode property has it, for engines whose \s has more.
WHITE = r"\t-\r \x85\xa0  -     　"
#: Entries of the piece memo and of the pair memo before they start anew; characters of a piece that is kept.
PIECE_MEMO, PAIR_MEMO, PIECE_SIZE = 600_000, 500_000, 48
#: Characters that are split into pieces at a time.
PART = 1 << 19


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class _Memo(dict):
    """With `size`, longer keys aren't kept, so that the entries bound the bytes."""

    def __init__(self, make, limit, size=None):
        super().__init__()
        self.make, self.limit, self.size = make, limit, size

    def __missing__(self, key):
        value = self.make(key)
        if self.size is None or len(key) <= self.size:
            if len(self) >= self.limit:
                self.clear()
            self[key] = value
        return value


class BpeCodec:
    """Encoder and decoder of one rank file (lines of base64 token and rank) and one piece pattern."""

    def __init__(self, ranks: bytes, pattern: str):
        self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.bytes_of = {v: k for k, v in self.rank.items()}
        self.halves = _Memo(self._halves, 1 << 62)
        self.shorter = _Memo(self._shorter, 1 << 62)
        self.fits = _Memo(lambda pair: self._fits(*pair), PAIR_MEMO)
        self.pieces = _Memo(self._encode_piece, PIECE_MEMO, PIECE_SIZE)
        self.split = regex.compile(pattern.replace(r"[^\s", "[^" + WHITE).replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]"))
        self.cut = regex.compile(r"\p{L}(?= \p{L})")
        self.find = ahocorasick.Automaton()
        for token, rank in self.rank.items():
            if len(token) == 1 or self.halves[rank]:
                self.find.add_word(token.decode("latin-1"), (rank, len(token)))
        self.find.make_automaton()
        self.size = {rank: len(token) for token, rank in self.rank.items()}
        self.packed = {rank: rank.to_bytes(4, "little") for rank in self.bytes_of}

    def _merge(self, token: bytes, below: int) -> list[bytes]:
        """Merge `token`'s bytes in rank order, by ranks under `below` only."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 1:
            least, at = min((self.rank.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
            if least >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _halves(self, rank: int):
        """The two entries whose merge makes this one; None for a byte or an entry no merge makes."""
        token = self.bytes_of[rank]
        parts = self._merge(token, rank) if len(token) > 1 else []
        return (self.rank[parts[0]], self.rank[parts[1]]) if len(parts) == 2 else None

    def _shorter(self, rank: int):
        """The longest entry that is a proper prefix of this one and that merges can make."""
        token = self.bytes_of[rank]
        for n in range(len(token) - 1, 0, -1):
            if (r := self.rank.get(token[:n])) is not None and (n == 1 or self.halves[r]):
                return r
        return None

    def _fits(self, left: int, right: int) -> bool:
        """Would merging keep the border between these neighbours? Undo the later merge at the border, again and again."""
        bound = 1 << 62
        while True:
            joined = self.rank.get(self.bytes_of[left] + self.bytes_of[right])
            if joined is not None and joined < bound:
                return False
            in_left, in_right = self.halves[left], self.halves[right]
            # the entry made last is undone first; of equal ones the right, as merging goes from the left
            undo_left = in_left is not None and (left > right or in_right is None)
            if undo_left:
                bound, left = left, in_left[1]
            elif in_right is not None:
                bound, right = right + 1, in_right[0]
            else:
                return True

    def _encode_piece(self, piece: str) -> bytes:
        data = piece.encode("utf-8")
        whole = self.rank.get(data)
        if whole is not None:
            return whole.to_bytes(4, "little")
        chars, fits, packed = data.decode("latin-1"), self.fits, self.packed
        # most often the longest entries, taken from the left, fit as they are
        at, last, out = 0, -1, []
        for end, (token, size) in self.find.iter_long(chars):
            if end - size + 1 != at or last >= 0 and not fits[last, token]:
                break
            out.append(token)
            at, last = end + 1, token
        else:
            if at == len(data):
                return b"".join([packed[t] for t in out])
        return b"".join([packed[t] for t in self._backtrack(chars)])

    def _backtrack(self, chars: str) -> list[int]:
        n, fits, size_of = len(chars), self.fits, self.size
        longest = [0] * n
        for end, (rank, size) in self.find.iter(chars):
            longest[end - size + 1] = rank
        dead = bytearray(n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            end = at + size_of[token]
            if not dead[end] and (not out or fits[out[-1], token]):
                out.append(token)
                at = end
                if at < n:
                    token = longest[at]
            elif (less := self.shorter[token]) is not None:
                token = less
            else:
                dead[at] = 1
                token = out.pop()
                at -= size_of[token]
        return out

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        ids, lo = [], 0
        while lo < len(text):
            hi = len(text)
            if hi - lo > PART and (m := self.cut.search(text, lo + PART)):
                hi = m.end()
            part = text if (lo, hi) == (0, len(text)) else text[lo:hi]
            ids.append(b"".join(map(self.pieces.__getitem__, self.split.findall(part))))
            lo = hi
        return b"".join(ids)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def codec(ranks: bytes, pattern: str) -> BpeCodec:
    """One codec for each Python worker, kept for as long as its tasks ask for the same vocabulary."""
    return kept(hashlib.sha256(ranks + pattern.encode()).hexdigest(), lambda: BpeCodec(ranks, pattern))


def bpe_encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: the id, `keep`, n_tokens, ids (binary, little-endian uint32) and decoded (the bytes the ids stand for).

    The rank file (under a megabyte, fixed) is read on the driver and broadcast; nothing is shuffled.
    """
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast((read_ranks(ranks_path), pattern))
    carried = [f for f in docs.schema.fields if f.name in (id_col, *keep)]
    schema = T.StructType([*carried, T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())])

    def run(batches):
        own = codec(*shared.value)
        for batch in sliced(batches, "__text"):
            ids = [own.encode(t.as_py()) for t in batch["__text"]]
            yield pa.RecordBatch.from_arrays(
                [*(batch[f.name] for f in carried), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([own.decode(x) for x in ids], pa.binary())],
                [f.name for f in schema.fields],
            )

    return docs.select(*(F.col(f"`{f.name}`") for f in carried), F.col(f"`{text_col}`").alias("__text")).mapInArrow(run, schema)

"""Byte-level BPE encoding and decoding by the ranks of a public vocabulary.

``encode`` splits each text by a pattern and merges each piece on its own.
Pieces of a batch are put into padded numpy matrices by length; in every
round each row merges its leftmost pair of minimum rank (looked up in a hash
table over id pairs), finished rows are taken out, and the matrix loses one
column.  Pieces over ``LONG_PIECE`` bytes are merged one by one: there a round
merges all occurrences of the minimum-rank pair from the left, and stops
early where a merge makes a pair of lower rank, so the order of merges is
the same.  Pieces already met are kept in a table of bounded size.

Results: null and empty texts have no ids and decode to no bytes; ids that
the vocabulary lacks decode to null.
"""

from __future__ import annotations

import base64
import re
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from factlens.llm.common import Shared, struct_udf, without

LONG_PIECE = 256
MATRIX_CELLS = 1 << 19
KNOWN_CHUNKS = 150_000
CHUNK_CHARS = 64
NO_RANK = np.int32(2**31 - 1)
_FREE = np.uint64(2**64 - 1)
# fixed values: the code points with the Unicode property White_Space
WHITE_SPACE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


#: fixed value: the pattern whose matches never cross the ends of ``_CUT``'s pieces
CUT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_CUT = re.compile(f" ?[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+(?![^{WHITE_SPACE}])|[{WHITE_SPACE}]+")


def parse_ranks(lines: bytes) -> dict[bytes, int]:
    """Token bytes -> rank of a rank file (one base64 token and rank a line)."""
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines.splitlines() if x.strip())}


class PairTable:
    """Hash table (open addressing, linear probing) from id pairs to ranks."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        keys = self._key(left, right)
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, _FREE, np.uint64)
        self.ranks = np.full(1 << bits, NO_RANK, np.int32)
        todo, at = np.arange(len(keys)), self._home(keys)
        while todo.size:
            free = self.keys[at] == _FREE
            self.keys[at[free]] = keys[todo[free]]
            placed = self.keys[at] == keys[todo]
            self.ranks[at[placed]] = rank[todo[placed]]
            todo, at = todo[~placed], (at[~placed] + 1) & self.mask

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = self._key(left, right)
        out = np.full(keys.shape, NO_RANK, np.int32)
        flat, keys = out.reshape(-1), keys.reshape(-1)
        at, todo = self._home(keys), np.arange(keys.size)
        while todo.size:
            there = self.keys[at]
            hit = there == keys[todo]
            flat[todo[hit]] = self.ranks[at[hit]]
            on = ~hit & (there != _FREE)
            todo, at = todo[on], (at[on] + 1) & self.mask
        return out


class ByteBPE:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        # texts are cut before the pattern sees them only where it is known not to cross the cuts
        self.chunk = _CUT if pattern == CUT_PATTERN else self.pattern
        self.of_byte = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        if (self.of_byte < 0).any():
            raise ValueError("a byte-level vocabulary has a token for each of the 256 bytes")
        pairs = array("l")
        for t, i in ranks.items():
            for k in range(1, len(t)):
                if (a := ranks.get(t[:k])) is not None and (b := ranks.get(t[k:])) is not None:
                    pairs.extend((a, b, i))
        self.pairs = PairTable(*np.array(pairs, np.int64).reshape(-1, 3).T)
        self.known: dict[str, bytes] = {}

    def merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Token ids of each piece (not empty)."""
        out: list = [None] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for k, piece in enumerate(pieces):
            if (whole := self.ranks.get(piece)) is not None:
                out[k] = np.array([whole], np.int32)
            elif len(piece) > LONG_PIECE:
                out[k] = self._merge_long(piece)
            else:
                by_width.setdefault((len(piece) + 3) & -4, []).append(k)
        for width, rows in by_width.items():
            step = max(1, MATRIX_CELLS // width)
            for start in range(0, len(rows), step):
                part = rows[start:start + step]
                self._merge_rows([pieces[k] for k in part], width, part, out)
        return out

    def _merge_rows(self, pieces: list[bytes], width: int, put: list[int], out: list) -> None:
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
        length = np.array([len(p) for p in pieces])
        ids = np.where(np.arange(width) < length[:, None], self.of_byte[raw], np.int32(-1))
        rank = np.full((len(pieces), width - 1), NO_RANK, np.int32)
        both = ids[:, 1:] >= 0
        rank[both] = self.pairs.get(ids[:, :-1][both], ids[:, 1:][both])
        put_at = np.array(put)
        while put_at.size:
            at = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(ids), np.int64)
            row = np.arange(len(ids))
            best = rank[row, at] if rank.shape[1] else np.full(len(ids), NO_RANK)
            done = best == NO_RANK
            if done.any():
                for k, n, r in zip(put_at[done], length[done], ids[done], strict=True):
                    out[k] = r[:n]
                live = ~done
                put_at, length, ids, rank, at, best = (x[live] for x in (put_at, length, ids, rank, at, best))
                row = np.arange(len(ids))
                if not put_at.size:
                    break
            # each row loses the element right of its merge, so all move to one column less
            width = ids.shape[1] - 1
            cols = np.arange(width)
            ids = np.take_along_axis(ids, cols + (cols > at[:, None]), 1)
            ids[row, at] = best
            cols = np.arange(width - 1)
            rank = np.take_along_axis(rank, cols + (cols >= at[:, None]), 1)
            length = length - 1
            for left in (at - 1, at):
                sure = np.flatnonzero((left >= 0) & (left < length - 1))
                if sure.size:
                    c = left[sure]
                    rank[sure, c] = self.pairs.get(ids[sure, c], ids[sure, c + 1])
                past = np.flatnonzero((left >= 0) & (left < width - 1) & (left >= length - 1))
                rank[past, left[past]] = NO_RANK

    def _merge_long(self, piece: bytes) -> np.ndarray:
        ids = self.of_byte[np.frombuffer(piece, np.uint8)]
        rank = self.pairs.get(ids[:-1], ids[1:])
        while rank.size and (best := rank.min()) != NO_RANK:
            at = np.flatnonzero(rank == best)
            # of neighbouring occurrences every second one, from the left
            head = np.concatenate([[True], np.diff(at) > 1])
            nth = np.arange(len(at)) - np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
            at = at[nth % 2 == 0]
            before = np.where(at > 0, ids[at - 1], -1)
            before[1:][at[1:] == at[:-1] + 2] = best
            after = np.where(at + 2 < len(ids), ids[np.minimum(at + 2, len(ids) - 1)], -1)
            made = np.full(len(at), NO_RANK)
            for left, right, ok in ((before, np.full(len(at), best), before >= 0), (np.full(len(at), best), after, after >= 0)):
                made[ok] = np.minimum(made[ok], self.pairs.get(left[ok], right[ok]))
            if (lower := np.flatnonzero(made < best)).size:
                at = at[:lower[0] + 1]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids = ids.copy()
            ids[at] = best
            ids = ids[keep]
            rank = self.pairs.get(ids[:-1], ids[1:])
        return ids

    def _chunk_ids(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks as little-endian 32-bit words.  A chunk is white space
        or a run of other characters with the blank before it, whose ends
        ``CUT_PATTERN`` never crosses; with another pattern, one of its matches."""
        split = [self.pattern.findall(c) for c in chunks] if self.chunk is _CUT else [[c] for c in chunks]
        pieces = list({p for s in split for p in s})
        words = {p: x.astype("<u4").tobytes() for p, x in zip(pieces, self.merge([p.encode() for p in pieces]), strict=True)}
        return [b"".join([words[p] for p in s]) for s in split]

    def _chunks(self, text: str) -> list[str]:
        if self.chunk is _CUT:
            return _CUT.findall(text)
        return [m.group() for m in self.pattern.finditer(text) if m.group()]

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit words."""
        split = [self._chunks(t) if t else [] for t in texts]
        wanted = set().union(*split)
        new = list(wanted.difference(self.known))
        if len(self.known) + len(new) > KNOWN_CHUNKS:
            self.known = {c: self.known[c] for c in wanted if c in self.known}
        got = dict(zip(new, self._chunk_ids(new), strict=True))
        self.known.update(got)
        out = [b"".join(map(self.known.__getitem__, s)) for s in split]
        for c in new:
            if len(c) > CHUNK_CHARS:
                del self.known[c]
        return out


class Decoder:
    """Token ids -> bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.tokens = {i: t for t, i in ranks.items()}

    def decode(self, ids: bytes | None) -> bytes | None:
        if ids is None:
            return None
        try:
            return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        except (KeyError, ValueError):
            return None


def _decoder(sent: tuple[bytes, str]) -> Decoder:
    return Decoder(parse_ranks(sent[0]))


def _model(sent: tuple[bytes, str]) -> ByteBPE:
    lines, pattern = sent
    return ByteBPE(parse_ranks(lines), pattern)


def _shared(spark: SparkSession, path: str, pattern: str) -> Shared:
    """The vocabulary file for the executors (a fixed file of a few MB)."""
    with open(path, "rb") as f:
        return Shared(spark, (f.read(), pattern))


def encode(df: DataFrame, vocabulary: str, pattern: str, text: str = "text") -> DataFrame:
    """``df`` with ``token_ids`` (binary: ids as little-endian unsigned 32-bit
    words, see ``id_array``) and ``n_tokens``."""
    shared = _shared(df.sparkSession, vocabulary, pattern)

    def make():
        model = shared.build(_model)

        def run(texts):
            ids = model.encode_batch(texts)
            return [pa.array(ids, pa.binary()), [len(x) // 4 for x in ids]]
        return run

    schema = StructType([StructField("token_ids", BinaryType()), StructField("n_tokens", LongType())])
    done = df.withColumn("_bpe", struct_udf(schema, make)(F.col(text)))
    return without(done, "token_ids", "n_tokens").select("*", "_bpe.token_ids", "_bpe.n_tokens").drop("_bpe")


def decode(df: DataFrame, vocabulary: str, ids: str = "token_ids") -> DataFrame:
    """``df`` with ``decoded`` (binary: the tokens' bytes in order)."""
    shared = _shared(df.sparkSession, vocabulary, "")
    schema = StructType([StructField("decoded", BinaryType())])

    def make():
        model = shared.build(_decoder)
        return lambda rows: [pa.array([model.decode(x) for x in rows], pa.binary())]

    done = df.withColumn("_bpe", struct_udf(schema, make)(F.col(ids)))
    return without(done, "decoded").select("*", "_bpe.decoded").drop("_bpe")


def round_trip(df: DataFrame, vocabulary: str, pattern: str, text: str = "text") -> DataFrame:
    """``encode`` and ``decode`` by one Python worker a task: ``df`` with
    ``token_ids``, ``n_tokens`` and ``decoded``, which is made from the ids."""
    shared = _shared(df.sparkSession, vocabulary, pattern)
    names = ["token_ids", "n_tokens", "decoded"]
    schema = StructType([StructField(n, t) for n, t in zip(names, (BinaryType(), LongType(), BinaryType()), strict=True)])

    def make():
        model, back = shared.build(_model), shared.build(_decoder)

        def run(texts):
            ids = model.encode_batch(texts)
            return [pa.array(ids, pa.binary()), [len(x) // 4 for x in ids], pa.array([back.decode(x) for x in ids], pa.binary())]
        return run

    done = df.withColumn("_bpe", struct_udf(schema, make)(F.col(text)))
    return without(done, *names).select("*", *[f"_bpe.{n}" for n in names]).drop("_bpe")


def id_array(ids: Column) -> Column:
    """Packed ids as array<bigint> (null: empty)."""
    def unpack(batch: pa.Array) -> pa.Array:
        packed = batch.fill_null(b"").to_pylist()
        ends = np.cumsum([0, *(len(x) // 4 for x in packed)])
        flat = np.frombuffer(b"".join(x[:len(x) & -4] for x in packed), "<u4").astype(np.int64)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))

    return F.arrow_udf(unpack, ArrayType(LongType()), F.ArrowUDFType.SCALAR)(ids)

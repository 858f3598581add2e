"""Byte-level BPE encoding and decoding (operator 4).

A text is cut into pieces by a pattern and every piece is merged on its own. The distinct pieces of a batch that are
not yet known are laid out, by length, as rows of padded numpy matrices of token ids. Each round finds for all rows
the leftmost pair of least rank, looked up by hash, merges it and closes the gap; finished rows leave the matrix.
Pieces are kept in a bounded cache of each Python worker. Texts are only cut by the pattern, never by length, and a
row of the table is encoded where it lies: no shuffle.

A piece longer than LONG bytes (rare: long runs without a space) is a row of a matrix of its own, since its rounds are
many. Its round merges every place of its least pair that the leftmost-first order would merge next, one after the
other; where such a merge would bring up a pair of still lower rank, only the leftmost place is merged.

Null or empty text: no ids, empty decoded bytes. Ties: of equal ranks the leftmost pair. Repeated rows: each is encoded.
Empty table: no rows. Columns of the input stay, whatever their names, but for those that this operator adds.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import aside, back

LONG = 512
CACHED_PIECES = 200_000
NONE = np.int64(2**62)


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file: lines of a base64 token and its rank. It is read on the driver only."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class PairTable:
    """(left id, right id) -> id of the merged token, by open addressing in numpy arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        keys = np.fromiter(pairs.keys(), np.uint64, len(pairs))
        values = np.fromiter(pairs.values(), np.int64, len(pairs))
        self.bits = max(4, int(len(pairs) * 3).bit_length())
        self.mask = np.int64((1 << self.bits) - 1)
        self.keys = np.full(1 << self.bits, np.iinfo(np.uint64).max, np.uint64)
        self.values = np.full(1 << self.bits, NONE, np.int64)
        slot, waiting = self._slot(keys), np.arange(len(keys))
        while len(waiting):  # one new key for each free slot and round
            at = slot[waiting]
            free = self.keys[at] == np.iinfo(np.uint64).max
            _, first = np.unique(at[free], return_index=True)
            put = waiting[free][first]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            waiting = np.setdiff1d(waiting, put, assume_unique=True)
            taken = self.keys[slot[waiting]] != keys[waiting]
            slot[waiting[taken]] = (slot[waiting[taken]] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of the merged tokens; NONE where there is none or an id is negative (padding)."""
        keys = left.astype(np.uint64) << np.uint64(32) | (right.astype(np.uint64) & np.uint64(0xFFFFFFFF))
        keys[(left < 0) | (right < 0)] = np.iinfo(np.uint64).max - np.uint64(1)
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], NONE)
        again = np.nonzero((there != keys) & (there != np.iinfo(np.uint64).max))
        while len(again[0]):
            slot[again] = (slot[again] + 1) & self.mask
            there = self.keys[slot[again]]
            wanted = keys[again]
            hit = there == wanted
            out[tuple(x[hit] for x in again)] = self.values[slot[tuple(x[hit] for x in again)]]
            go = ~hit & (there != np.iinfo(np.uint64).max)
            again = tuple(x[go] for x in again)
        return out


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.find_pieces = ranks, regex.compile(pattern).findall
        self.pairs = PairTable(ranks)
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.of_byte = np.full(256, -1, np.int64)
        for b in range(256):
            self.of_byte[b] = ranks.get(bytes([b]), -1)
        if (self.of_byte < 0).any():
            raise ValueError("the vocabulary must hold every single byte")
        self.cache: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, packed as little-endian unsigned 32-bit integers."""
        cut = [self.find_pieces(t) if t else [] for t in texts]
        if len(self.cache) > CACHED_PIECES:
            self.cache = {}
        new = set().union(*cut) - self.cache.keys() if cut else set()
        self._learn(list(new))
        get = self.cache.__getitem__
        return [b"".join(map(get, pieces)) for pieces in cut]

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(packed, "<u4").tolist()))

    def _learn(self, pieces: list[str]) -> None:
        open_: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            raw = piece.encode()
            rank = self.ranks.get(raw)
            if rank is not None:
                self.cache[piece] = np.uint32(rank).astype("<u4").tobytes()
            elif len(raw) > LONG:
                self.cache[piece] = self._merge_long(raw)
            else:
                open_.setdefault(max(4, 1 << (len(raw) - 1).bit_length()), []).append((piece, raw))
        for width, rows in open_.items():
            step = max(1, (1 << 20) // width)
            for at in range(0, len(rows), step):
                some = rows[at : at + step]
                for (piece, _), ids in zip(some, self._merge_rows([raw for _, raw in some], width), strict=True):
                    self.cache[piece] = ids

    def _merge_rows(self, raws: list[bytes], width: int) -> list[bytes]:
        sizes = np.fromiter(map(len, raws), np.int64, len(raws))
        flat = np.frombuffer(b"".join(raw.ljust(width, b"\0") for raw in raws), np.uint8).reshape(-1, width)
        ids = np.where(np.arange(width) < sizes[:, None], self.of_byte[flat], -1)
        rank = self.pairs.find(ids[:, :-1], ids[:, 1:])
        rows, done = np.arange(len(raws)), [b""] * len(raws)
        while len(rows):
            at = rank.argmin(1)
            best = rank[np.arange(len(rows)), at]
            over = best == NONE
            if over.any():
                for r, line in zip(rows[over], ids[over], strict=True):
                    done[r] = line[line >= 0].astype("<u4").tobytes()
                ids, rank, rows, at, best = (x[~over] for x in (ids, rank, rows, at, best))
                if not len(rows):
                    break
            each, columns = np.arange(len(rows)), np.arange(ids.shape[1] - 1)
            # close the gap: what stands right of the merged pair moves one place left
            shift = columns + (columns > at[:, None])
            ids = np.take_along_axis(ids, shift, 1)
            ids[each, at] = best
            keep = columns[:-1]
            rank = np.take_along_axis(rank, keep + (keep > at[:, None]), 1) if len(keep) else rank[:, :0]
            if not rank.shape[1]:
                for r, line in zip(rows, ids, strict=True):
                    done[r] = line[line >= 0].astype("<u4").tobytes()
                break
            for side in (at - 1, at):
                ok = (side >= 0) & (side < rank.shape[1])
                e, c = each[ok], side[ok]
                rank[e, c] = self.pairs.find(ids[e, c], ids[e, c + 1])
        return done

    def _merge_long(self, raw: bytes) -> bytes:
        ids = self.of_byte[np.frombuffer(raw, np.uint8)]
        rank = self.pairs.find(ids[:-1], ids[1:])
        while len(rank) and (least := rank.min()) != NONE:
            hit = np.nonzero(rank == least)[0]
            # of neighbouring places that share a token the first, third, ... merge
            first = np.ones(len(hit), bool)
            first[1:] = np.diff(hit) > 1
            run = np.maximum.accumulate(np.where(first, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
            done = self._merged(ids, rank, hit, least)
            if done is None:
                done = self._merged(ids, rank, hit[:1], least, whatever=True)
            ids, rank = done
        return ids.astype("<u4").tobytes()

    def _merged(self, ids: np.ndarray, rank: np.ndarray, hit: np.ndarray, least: np.int64, whatever: bool = False):
        """ids and ranks after the pairs at `hit` merged to `least`; None if that brings up a lower rank."""
        ids = ids.copy()
        ids[hit] = least
        ids = np.delete(ids, hit + 1)
        rank = np.delete(rank, hit)
        place = hit - np.arange(len(hit))
        for side in (place - 1, place):
            at = side[(side >= 0) & (side < len(rank))]
            new = self.pairs.find(ids[at], ids[at + 1])
            if not whatever and (new < least).any():
                return None
            rank[at] = new
        return ids, rank


@lru_cache(maxsize=2)
def _codec_of(key: int, shared, pattern: str) -> Codec:
    return Codec(shared.value, pattern)


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text") -> DataFrame:
    """docs with n_tokens, ids (little-endian unsigned 32-bit integers) and decoded, the bytes that they stand for.

    `ranks` goes to the executors once as a broadcast; its size is that of the vocabulary and not of the data.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    @F.pandas_udf("n_tokens long, ids binary, decoded binary")
    def coded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = _codec_of(id(shared), shared, pattern)
        for batch in batches:
            ids = codec.encode(batch.fillna("").tolist())
            yield pd.DataFrame(
                {"n_tokens": [len(x) // 4 for x in ids], "ids": ids, "decoded": [codec.decode(x) for x in ids]}
            )

    found = aside(docs, F.col(f"`{text}`").alias("_text")).select("_doc", coded("_text").alias("_coded"))
    return back(found, docs, **{c: F.col(f"_coded.{c}") for c in ("n_tokens", "ids", "decoded")})


def id_array(packed):
    """Packed ids as an array of longs, in DataFrame functions."""
    word = lambda i, b: F.conv(F.hex(F.substring(packed, i * 4 + b + 1, 1)), 16, 10).cast("long")
    whole = lambda i: word(i, 0) + word(i, 1) * 256 + word(i, 2) * 65536 + word(i, 3) * 16777216
    n = (F.octet_length(packed) / 4).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), whole)).otherwise(F.array().cast("array<bigint>"))

"""Repeated windows of a fixed number of symbols, found over a whole corpus; shared by operators 2 and 6.

A window is `length` consecutive symbols (words or bytes) of one document. Levels go up by doubling:

1. Every window names an anchor, the stretch of `anchor` symbols in it with the least hash. Equal windows name equal
   anchors at equal places, so only anchors that repeat can stand in windows that repeat. Neighbouring windows share
   anchors, which leaves about 2 / (length - anchor + 2) of the positions.
2. The windows that share an anchor are one segment. Anchors that repeat alone are compared as whole segments: where
   two are equal, all their windows repeat, and one of them stands for the rest from here on.
3. Anchors with different segments are extended to twice their length, to the left and to the right, and drop out if
   neither repeats.
4. What survives is compared window by window, on 128 bits.

Counts are summed before they move, in every step, and come back by joins that Spark splits where a key is hot; no
step gathers the rows of a key. Hashes of levels 1 and 3 only choose what is looked at again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import Powers, mixed
from .shared import cut, empty

#: Symbols hashed at once; starts of one text that meet in one row; segments of a text that are spelled out at once.
CHUNK, PIECE, AT_ONCE = 1 << 20, 1 << 20, 4096
_FIRST, _SECOND, _THIRD = Powers(0x9E3779B97F4A7C15), Powers(0xD6E8FEB86659FD93), Powers(0xA0761D6478BD642F)
_INDEX = np.uint64(0xFFFFFFFF)

#: bytes of a text -> one 64-bit value for each symbol
Symbols = Callable[[bytes], np.ndarray]


def numbered(docs: DataFrame) -> DataFrame:
    """docs with `at`, a number of its own for each row in the order of doc_id.

    Where every doc_id is there once, that is doc_id itself. Otherwise rows are put in order of doc_id (null first)
    and text and written with their places.
    """
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n"))
    if ids.where("n > 1 or doc_id is null").isEmpty():
        return docs.withColumn("at", F.col("doc_id").cast("long"))
    return cut(docs.orderBy("doc_id", "text").withColumn("at", F.monotonically_increasing_id()), "numbered")


def _pieces(ats, texts, symbols: Symbols, length: int) -> Iterator[list[tuple[int, int, np.ndarray]]]:
    """Lists of (at, first symbol, symbols) of about CHUNK symbols each; long texts in pieces that share length - 1."""
    held, size = [], 0
    for at, text in zip(ats, texts, strict=True):
        s = symbols(text or b"")
        if len(s) < length:
            continue
        for start in range(0, len(s) - length + 1, CHUNK):
            piece = s[start : start + CHUNK + length - 1]
            held.append((at, start, piece))
            size += len(piece)
            if size >= CHUNK:
                yield held
                held, size = [], 0
    if held:
        yield held


def _anchored(held: list[tuple[int, int, np.ndarray]], length: int, anchor: int, extend: bool) -> pd.DataFrame:
    """The segments of some pieces: where their anchors lie and the hashes of anchor, segment and extensions."""
    sym = np.concatenate([s for _, _, s in held])
    sizes = np.array([len(s) for _, _, s in held])
    base = np.cumsum(sizes) - sizes
    wide = length - anchor + 1
    one, two = _FIRST.sums(sym), _SECOND.sums(sym)
    key = mixed(_FIRST.many(one, anchor))
    least = (key & ~_INDEX) | np.arange(len(key), dtype=np.uint64)
    span = 1
    while span * 2 <= wide:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < wide:
        least = np.minimum(least[: -(wide - span)], least[wide - span :])
    # windows that lie in one piece, and the runs of them that name the same anchor
    piece = np.repeat(np.arange(len(held)), sizes - length + 1)
    start = np.arange(len(piece)) + (base - (np.cumsum(sizes - length + 1) - (sizes - length + 1)))[piece]
    place = (least[start] & _INDEX).astype(np.int64)
    new = np.ones(len(piece), bool)
    new[1:] = (place[1:] != place[:-1]) | (piece[1:] != piece[:-1])
    first = np.nonzero(new)[0]
    last = np.append(first[1:], len(piece)) - 1
    low, high, p, of = start[first], start[last], place[first], piece[first]
    back, near = p - low, p - high
    out = {
        "at": np.array([a for a, _, _ in held], np.int64)[of],
        "place": (p - base[of] + np.array([b for _, b, _ in held], np.int64)[of]) << 16 | back << 8 | near,
        "anchor": key[p].astype(np.int64),
        "segment": mixed(
            _SECOND.some(two, low, high + length) + (back << 8 | near).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D)
        ).astype(np.int64),
    }
    if extend:
        left, right = low <= p - anchor, high + length >= p + 2 * anchor
        l_hash = mixed(_SECOND.some(two, np.where(left, p - anchor, p), p + anchor)) >> np.uint64(33)
        r_hash = mixed(_SECOND.some(two, p, np.where(right, p + 2 * anchor, p + anchor))) >> np.uint64(33)
        out["left"] = np.where(left, l_hash.astype(np.int64), -1).astype(np.int32)
        out["right"] = np.where(right, r_hash.astype(np.int64), -1).astype(np.int32)
    return pd.DataFrame(out)


def _segments(docs: DataFrame, symbols: Symbols, length: int, anchor: int, extend: bool) -> DataFrame:
    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for held in _pieces(x["at"], x["text"], symbols, length):
                yield _anchored(held, length, anchor, extend)

    kind = "at long, place long, anchor long, segment long" + ", left int, right int" * extend
    return docs.select("at", F.col("text").cast("binary").alias("text")).mapInPandas(found, kind)


def _spelled_out(batches: Iterator[pa.RecordBatch], symbols: Symbols, length: int) -> Iterator[pa.RecordBatch]:
    """Of rows (at, text, probes) the windows of their segments, those of many texts in one batch of about CHUNK."""
    held, size = [], 0
    for x in batches:
        texts, probes = x.column("text"), x.column("probes")
        bounds, each_probe = probes.offsets.to_numpy(), probes.values
        low, high, weight = (each_probe.field(c).to_numpy().astype(np.int64) for c in ("low", "high", "weight"))
        for i, at in enumerate(x.column("at").to_numpy().tolist()):
            s = symbols(texts[i].as_py())
            two, three = _SECOND.sums(s), _THIRD.sums(s)
            for k in range(bounds[i], bounds[i + 1], AT_ONCE):
                part = slice(k, min(k + AT_ONCE, bounds[i + 1]))
                n = high[part] - low[part] + 1
                start = np.arange(n.sum()) + np.repeat(low[part] - (np.cumsum(n) - n), n)
                end = start + length
                w1, w2 = mixed(_SECOND.some(two, start, end)), mixed(_THIRD.some(three, start, end))
                held.append((np.full(len(start), at), start.astype(np.int32), w1.astype(np.int64), w2.astype(np.int64), np.repeat(weight[part], n).astype(np.int32)))
                size += len(start)
                if size >= CHUNK:
                    yield _together(held)
                    held, size = [], 0
    if held:
        yield _together(held)


def _together(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], ["at", "start", "w1", "w2", "weight"])


def _windows(docs: DataFrame, probes: DataFrame, symbols: Symbols, length: int) -> DataFrame:
    """at, start, w1, w2, weight: the windows of the segments that are to be compared one by one."""
    by_doc = probes.groupBy("at").agg(F.collect_list(F.struct("low", "high", "weight")).alias("probes"))
    texts = docs.select("at", F.col("text").cast("binary").alias("text"))
    kind = "at long, start int, w1 long, w2 long, weight int"
    return texts.join(by_doc, "at").mapInArrow(lambda batches: _spelled_out(batches, symbols, length), kind)


def _bounds(place: str = "place") -> list:
    """First window and last window of a segment from its packed place."""
    p = F.shiftright(place, 16)
    return [
        (p - F.shiftright(place, 8).bitwiseAND(F.lit(255))).cast("int").alias("low"),
        (p - F.col(place).bitwiseAND(F.lit(255))).cast("int").alias("high"),
    ]


def spans(
    docs: DataFrame, symbols: Symbols, length: int, anchor: int, extend: bool = False, later_only: bool = False
) -> DataFrame:
    """at -> spans, an array of (low, high): windows low to high, both included, repeat. docs: at, text.

    later_only: of equal windows all but the first, by at and start; otherwise all of them.
    Documents without such windows have no row.
    """
    if length - anchor + 1 > 256 or not 0 < anchor <= length:
        raise ValueError("an anchor lies in its window and is at most 255 symbols shorter")
    keys = ["anchor", "segment", *["left", "right"] * extend]
    every = cut(_segments(docs, symbols, length, anchor, extend), "repeat-anchors")
    # a table of its own: so both sides of the join are plain shuffles, and Spark splits hot anchors
    again = cut(every.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "repeat-again")
    alive = cut(every.join(again, "anchor"), "repeat-alive")
    empty(every)
    empty(again)

    # one row for each different segment, with the first place where it stands
    kinds = cut(
        alive.groupBy(*keys).agg(F.count("*").alias("n"), F.min(F.struct("at", "place")).alias("first")), "repeat-kinds"
    )
    several = kinds.groupBy("anchor").agg(F.count("*").alias("_k")).where("_k > 1").select("anchor")
    open_ = kinds.join(several, "anchor")
    if extend:
        sides = F.array(*[F.struct(F.lit(i).alias("side"), F.col(c).alias("x")) for i, c in enumerate(("left", "right"))])
        open_ = cut(open_, "repeat-open")
        twice = (
            open_.select("anchor", F.explode(sides).alias("e"))
            .where("e.x >= 0")
            .groupBy("anchor", "e.side", "e.x")
            .agg(F.count("*").alias("_n"))
            .where("_n > 1")
        )
        side = lambda i, c, flag: twice.where(F.col("side") == i).select(
            "anchor", F.col("x").alias(c), F.lit(True).alias(flag)
        )
        open_ = (
            open_.join(side(0, "left", "_l"), ["anchor", "left"], "left")
            .join(side(1, "right", "_r"), ["anchor", "right"], "left")
            .where("_l or _r")
        )
    weight = F.when(F.col("n") > 1, 2).otherwise(1).cast("int").alias("weight")
    probes = open_.select("first.at", "first.place", weight).select("at", *_bounds(), "weight")
    copies = kinds.where("n > 1")
    if later_only:
        others = F.struct("at", "place") != F.col("first")
        whole = alive.join(copies.select("anchor", "segment", "first"), ["anchor", "segment"]).where(others)
        whole = cut(whole.select("at", *_bounds()), "repeat-whole")
        empty(alive)
        # the first place of each window; the windows of a probe that are not among them stood earlier
        probes = cut(probes, "repeat-probes")
        windows = _windows(docs, probes, symbols, length)
        firsts = windows.groupBy("w1", "w2").agg(F.min(F.struct("at", "start")).alias("first"))
        firsts = cut(firsts.select("first.at", F.col("first.start").alias("start")), "repeat-firsts")
        none = F.array().cast("array<int>")
        piece = lambda c: F.floor(F.col(c) / PIECE).cast("int")
        first_of = firsts.groupBy("at", piece("start").alias("piece")).agg(F.sort_array(F.collect_list("start")).alias("firsts"))
        # a segment that reaches into the next piece of its text is there too
        halves = F.explode(F.array_distinct(F.array(piece("low"), piece("high")))).alias("piece")
        within = F.sequence(F.greatest("low", F.col("piece") * PIECE), F.least("high", F.col("piece") * PIECE + PIECE - 1))
        probed = probes.select("at", "low", "high", halves).groupBy("at", "piece").agg(F.flatten(F.collect_list(within)).alias("starts"))
        hit = probed.join(first_of, ["at", "piece"], "left").select(
            "at", F.explode(F.array_except("starts", F.coalesce("firsts", none))).alias("start")
        )
    else:
        windows = cut(_windows(docs, probes, symbols, length), "repeat-windows")
        often = windows.groupBy("w1", "w2").agg(F.sum("weight").alias("_n")).where("_n > 1")
        hit = windows.join(often, ["w1", "w2"])
        whole = alive.join(copies.select("anchor", "segment"), ["anchor", "segment"]).select("at", *_bounds())
    hit = hit.select("at", F.col("start").alias("low"), F.col("start").alias("high"))
    all_spans = whole.union(hit)
    return cut(all_spans.groupBy("at").agg(F.collect_list(F.struct("low", "high")).alias("spans")), "repeat-spans")


def covered(n: int, spans, length: int) -> np.ndarray:
    """For each of n symbols whether a window of one of the spans covers it."""
    edge = np.zeros(n + 1, np.int64)
    if spans is not None and len(spans):
        low = np.fromiter((x["low"] for x in spans), np.int64, len(spans))
        high = np.fromiter((x["high"] for x in spans), np.int64, len(spans))
        np.add.at(edge, low, 1)
        np.add.at(edge, high + length, -1)
    return np.cumsum(edge)[:n] > 0

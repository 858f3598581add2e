"""Token counts without token ids (operator 11).

Texts are cut into pre-tokens by the tokenizer's own normalizer and pre-tokenizer. Documents are taken together in
blocks of bounded size; a block holds its distinct pre-tokens once and for each document the frequency of each of them,
as numbers into that list. The lists of all blocks are dealt out by pre-token and sorted, so that every distinct
pre-token of the corpus meets the tokenizer's model once, which says into how many pieces it falls; these numbers go
back to the blocks, packed by block, and a document's count is the sum of frequency times pieces. Ids are never made,
and what is shuffled is the lists of the blocks, not the words of the documents. A very common pre-token has one row for
each block, however many texts it fills, so no key holds more than one row in as many as a block has pre-tokens.

Strings of special tokens inside a text count one token each, as the tokenizers library takes them by default. Blocks
are written to the shared folder before they are joined, so a lost executor never sends texts through the cut again.

Null or empty text: no tokens, no bytes. Repeated rows: each is counted. Empty table: no rows. A very long text is a
block of its own. Columns of the input but the text stay, whatever their names, but for those that this operator adds.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .shared import back, cut

#: A block ends with the document that reaches either.
BLOCK_BYTES, BLOCK_DOCS = 12 << 20, 1 << 16
#: So many stretches between white space are cut by one call, and so many counts go back to the blocks together.
TOGETHER, SENT = 256, 1 << 20
#: A place is one number: a task, a block of it, and a pre-token of that.
BLOCK_BITS, AT_BITS = 12, 27
#: Documents of more tokens are marked as over the limit.
LIMIT = 2048


class PreTokens:
    """The pre-tokens and special tokens of stretches of text, as a tokenizer's own parts give them."""

    def __init__(self, tokenizer: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer)
        added = self.tokenizer.get_added_tokens_decoder().values()
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added):
            raise ValueError("special tokens that depend on what stands beside them are not supported")
        names = sorted((re.escape(t.content) for t in added), key=len, reverse=True)
        self.special = re.compile("|".join(names)) if names else None
        self.other_space = re.compile(r"[^\S ]")

    def of(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens in order, and the number of special tokens."""
        parts = self.special.split(text) if self.special else [text]
        return [p for part in parts if part for p in self._cut(part)], len(parts) - 1

    def of_each(self, stretches: list[str]) -> Iterator[tuple[list[str], int]]:
        """The same for stretches without ASCII white space, cut many at a time with a space between them."""
        for at in range(0, len(stretches), TOGETHER):
            some = stretches[at : at + TOGETHER]
            text = " ".join(some)
            plain = not self.other_space.search(text) and not (self.special and self.special.search(text))
            if plain:
                before, by = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
                text = before.normalize_str(text) if before else text
                spaces = [k for k, c in enumerate(text) if c == " "]
                plain = len(spaces) == len(some) - 1 and by is not None
            if not plain:
                yield from map(self.of, some)
                continue
            found: list[list[str]] = [[] for _ in some]
            for piece, (start, _) in by.pre_tokenize_str(text):
                found[bisect(spaces, start)].append(piece)
            for pieces in found:
                yield pieces, 0

    def _cut(self, text: str) -> list[str]:
        before, by = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        text = before.normalize_str(text) if before else text
        return [piece for piece, _ in by.pre_tokenize_str(text)] if by else [text]

    def pieces(self, pre_token: str) -> int:
        return len(self.tokenizer.model.tokenize(pre_token))


@lru_cache(maxsize=4)
def _pre_tokens(key: int, shared) -> PreTokens:
    return PreTokens(shared.value)


def packed(numbers: np.ndarray) -> bytes:
    """Small whole numbers so that they compress well: their lowest bytes first, then the next ones."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpacked(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def frequencies(raws: list[bytes], cutter: PreTokens, spaced: bool) -> dict:
    """A block: distinct pre-tokens, and for each text its special tokens and the frequencies of its pre-tokens."""
    number: dict[bytes, int] = {}
    stretches, times, per = [], [], np.zeros(len(raws), np.int64)
    for k, raw in enumerate(raws):
        seen = Counter(raw.split()) if spaced else {raw: 1} if raw else {}
        per[k] = len(seen)
        stretches += [number.setdefault(s, len(number)) for s in seen]
        times += seen.values()
    of, places, special, each = {}, [], np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
    texts = [s.decode() for s in number]
    for k, (pre, n) in enumerate(cutter.of_each(texts) if spaced else map(cutter.of, texts)):
        special[k], each[k] = n, len(pre)
        places += [of.setdefault(p, len(of)) for p in pre]
    stretch, time = np.array(stretches, np.int64), np.array(times, np.int64)
    doc = np.repeat(np.arange(len(raws)), per)
    n_special = np.bincount(doc, special[stretch] * time, len(raws)).astype(np.int64) if len(doc) else np.zeros(len(raws), np.int64)
    # every stretch of a document stands for its pre-tokens; the same ones of several stretches are added
    many = each[stretch]
    ends = np.cumsum(many)
    inside = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - many, many)
    start = np.cumsum(each) - each
    word = np.array(places, np.int64)[np.repeat(start[stretch], many) + inside]
    key = np.repeat(doc, many) * max(1, len(of)) + word
    pairs, at = np.unique(key, return_inverse=True)
    sums = np.bincount(at, np.repeat(time, many), len(pairs)).astype(np.int64)
    docs, words = pairs // max(1, len(of)), pairs % max(1, len(of))
    return {"words": list(of), "special": n_special, "per": np.bincount(docs, minlength=len(raws)), "places": words, "times": sums}


def _gaps(places: np.ndarray, per: np.ndarray) -> np.ndarray:
    """Places that rise within each document, as the first of each and what each adds to the one before."""
    gaps = np.diff(places, prepend=0)
    first = (np.cumsum(per) - per)[per > 0]
    gaps[first] = places[first]
    return gaps


def _places(gaps: np.ndarray, per: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(gaps)])
    return sums[1:] - np.repeat(sums[np.cumsum(per) - per], per)


def count(
    docs: DataFrame, tokenizer: str, text: str = "text", *, spaced: bool = False, limit: int = LIMIT,
    block_bytes: int = BLOCK_BYTES, block_docs: int = BLOCK_DOCS,
) -> DataFrame:
    """docs without the text, with n_bytes (UTF-8), n_tokens and over_limit (more than `limit` tokens).

    `tokenizer` is the content of a JSON file of the tokenizers library; it is broadcast, and its size is that of the
    vocabulary. With `spaced`, ASCII white space must divide pre-tokens and belong to none: then each distinct stretch
    between white space is normalized and cut once in a block, which is much less work than whole texts.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text]
    raw = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary")
    given = docs.select(F.struct(*rest, F.lit(0).alias("_")).alias("_doc"), raw.alias("_raw"))
    kind = given.schema["_doc"].dataType
    schema = StructType([StructField("block", LongType()), StructField("docs", ArrayType(kind))])
    for field in StructType.fromDDL("n_bytes array<long>, special array<long>, per array<int>, places binary, times binary, words array<string>"):
        schema.add(field)
    summed_schema = StructType([StructField("_doc", kind), StructField("n_bytes", LongType()), StructField("n_tokens", LongType())])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, task, k = _pre_tokens(id(shared), shared), TaskContext.get().partitionId(), 0
        rows, raws, size = [], [], 0

        def block() -> pa.RecordBatch:
            if k >= 1 << BLOCK_BITS:
                raise ValueError("a partition holds too much text: read it in more partitions")
            found = frequencies(raws, cutter, spaced)
            kept = pa.concat_arrays(rows)
            one = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([task << BLOCK_BITS | k], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(kept)], pa.int32()), kept),
                    one(list(map(len, raws)), pa.int64()), one(found["special"], pa.int64()), one(found["per"].astype(np.int32), pa.int32()),
                    *[pa.array([packed(x)], pa.binary()) for x in (_gaps(found["places"], found["per"]), found["times"])], one(found["words"], pa.string()),
                ],
                ["block", "docs", "n_bytes", "special", "per", "places", "times", "words"],
            )

        for batch in batches:
            texts, at = batch.column(1).to_pylist(), 0
            for end, t in enumerate(texts, 1):
                raws.append(t)
                size += len(t)
                if size >= block_bytes or len(raws) >= block_docs:
                    rows.append(batch.column(0).slice(at, end - at))
                    yield block()
                    rows, raws, size, at, k = [], [], 0, end, k + 1
            if at < len(texts):
                rows.append(batch.column(0).slice(at))
        if raws:
            yield block()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """word (sorted), place -> block, and packed for each block numbers of its pre-tokens and their pieces."""
        cutter, word, n, places, counts = _pre_tokens(id(shared), shared), None, 0, [], []

        def sent() -> Iterator[pa.RecordBatch]:
            place, count = np.array(places, np.int64), np.array(counts, np.int64)
            order = np.argsort(place)
            place, count = place[order], count[order]
            block, at = place >> AT_BITS, place & ((1 << AT_BITS) - 1)
            ids, first = np.unique(block, return_index=True)
            for k in range(0, len(ids), 1024):
                ends = [*first[k + 1 : k + 1025], len(block)][: len(ids[k : k + 1024])]
                spans = list(zip(first[k : k + 1024].tolist(), ends, strict=True))
                held = [pa.array([packed(x[a:b]) for a, b in spans], pa.binary()) for x in (at, count)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[k : k + 1024], pa.int64()), *held], ["block", "at", "n"])

        for batch in batches:
            for w, place in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if w != word:
                    word, n = w, cutter.pieces(w)
                places.append(place)
                counts.append(n)
            if len(places) >= SENT:
                yield from sent()
                places, counts = [], []
        if places:
            yield from sent()

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c).slice(k, 1) for c in batch.schema.names}
                size = row["n_bytes"].flatten()
                per = row["per"].flatten().to_numpy()
                weight = np.zeros(row["n_words"][0].as_py(), np.int64)
                for some in row["found"][0].as_py() or ():
                    weight[unpacked(some["at"])] = unpacked(some["n"])
                places, times = (unpacked(row[c][0].as_py()) for c in ("places", "times"))
                sums = np.concatenate([[0], np.cumsum(weight[_places(places, per)] * times)])
                end = np.cumsum(per, dtype=np.int64)
                tokens = sums[end] - sums[end - per] + row["special"].flatten().to_numpy()
                yield pa.RecordBatch.from_arrays([row["docs"].flatten(), size, pa.array(tokens, pa.int64())], ["_doc", "n_bytes", "n_tokens"])

    cut_blocks = cut(given.mapInArrow(blocks, schema), "token-blocks")
    lists = cut_blocks.select("block", F.posexplode("words").alias("at", "word"))
    placed = lists.select("word", (F.shiftleft("block", AT_BITS) + F.col("at")).alias("place"))
    weights = placed.repartition("word").sortWithinPartitions("word").mapInArrow(pieces, "block long, at binary, n binary")
    found = weights.groupBy("block").agg(F.collect_list(F.struct("at", "n")).alias("found"))
    joined = cut_blocks.withColumn("n_words", F.size("words")).drop("words").join(found, "block", "left")
    counted = joined.mapInArrow(summed, summed_schema)
    left = docs.select(*rest)
    return back(counted, left, n_bytes=F.col("n_bytes"), n_tokens=F.col("n_tokens"), over_limit=F.col("n_tokens") > limit)

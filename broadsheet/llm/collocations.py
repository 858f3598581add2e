"""Phrase collocation mining with vertical positional inverted lists (operator 12).

Texts are taken together in blocks of bounded size. A block holds, for each of its words, the list of positions at
which it stands; a list's length is the exact frequency of the word in the block, and the sums over blocks are those in
the corpus. The lists of frequent phrases of k words are extended to k + 1 by merging, in order of position, each
occurrence with the posting of the adjacent word behind it, as far as that word ends a frequent phrase of k words
itself; occurrences of the same two phrases form the list of the longer one. Positions between pieces are left out, so
no phrase crosses them. Only the lengths of lists travel between tasks: a phrase has one row for each block in which it
stands, however often it stands there, so no key holds more than one row in as many as a block has phrases.

The id of a phrase is its first place: the block and the number in it where it is met first. A longer phrase is named
by the ids of its first and its last k words, which also lead to the frequencies of all of its parts. Lists, lengths and
phrases are written to the shared folder level by level, so a lost executor repeats part of one level.

Null or empty text: no words. Null language: `und`. Ties: by frequency, then by phrase in byte order. Repeated rows:
each counts. Empty table: no rows. Very long texts are divided between pieces. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, empty

#: What ends a piece, upper case and lower case, and what stands between words.
ENDS = b".,;:!?\n\x0b\x0c\r"
UPPER, LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
PLAIN = bytes.maketrans(ENDS + UPPER + b"\t", b"\n" * len(ENDS) + LOWER + b" ")

LEAST, LONGEST, KEEP, INSIDE_PERCENT = 30, 4, 2000, 80
BLOCK_BYTES = 16 << 20
ROWS = 100_000
#: A place is one number: a task, a block of it, and a word or phrase of that.
BLOCK_BITS, AT_BITS = 12, 27
LISTS = "block long, ids binary, sizes binary, gaps binary"


class Numbers(dict):
    """word -> number, in the order in which words are met."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


def parts(text: bytes, size: int) -> Iterator[bytes]:
    """text in plain form, lower case with \\n between pieces, divided between pieces where it is longer than size."""
    text, at = text.translate(PLAIN), 0
    while len(text) - at > size:
        end = text.find(b"\n", at + size)
        if end < 0:
            break
        yield text[at:end]
        at = end + 1
    yield text[at:]


def lists(keys: np.ndarray, places: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of each key one after the other, as gaps, and the length of each list; places rise within a key."""
    order = np.argsort(keys, kind="stable")
    return np.diff(places[order], prepend=0).astype("<i4"), np.bincount(keys, minlength=n).astype("<i4")


def ordered(sizes: bytes, gaps: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places in rising order, and the number of the list that each comes from."""
    sizes = np.frombuffer(sizes, "<i4")
    places = np.cumsum(np.frombuffer(gaps, "<i4"), dtype=np.int64)
    key = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(places, kind="stable")
    return places[order], key[order]


def extended(sizes: bytes, gaps: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lists of phrases one word longer: first part, last part and length of each, places, and the number of each place."""
    places, key = ordered(sizes, gaps)
    # an occurrence is extended where the next place holds one too: the last word of that is the adjacent word
    on = np.nonzero(np.diff(places) == 1)[0]
    n = len(sizes) // 4
    pairs, number, size = np.unique(key[on] * n + key[on + 1], return_inverse=True, return_counts=True)
    return pairs // max(1, n), pairs % max(1, n), size, places[on], number


def _row(block: int, ids: np.ndarray, sizes: np.ndarray, gaps: np.ndarray) -> list:
    held = [pa.array([x.tobytes()], pa.binary()) for x in (ids.astype("<i8"), sizes, gaps)]
    return [pa.array([block], pa.int64()), *held]


def _blocks(size: int):
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, k = TaskContext.get().partitionId(), 0
        numbers: dict[str, Numbers] = {}
        found, lang_of, total, at = [], [], 0, 0

        def block() -> pa.RecordBatch:
            if k >= 1 << BLOCK_BITS:
                raise ValueError("a partition holds too much text: read it in more partitions")
            words = [(lang, word.decode()) for lang, w in numbers.items() for word in w]
            start = dict(zip(numbers, np.cumsum([0, *map(len, numbers.values())]).tolist(), strict=False))
            ids = np.concatenate([x + start[lang] if len(x) else x for x, lang in zip(found, lang_of, strict=True)])
            places = np.concatenate(where)
            gaps, sizes = lists(ids, places, len(words))
            one = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))
            return pa.RecordBatch.from_arrays(
                [
                    *_row(task << BLOCK_BITS | k, np.arange(0), sizes, gaps),
                    one([lang for lang, _ in words], pa.string()), one([w for _, w in words], pa.string()), one(sizes.astype(np.int64), pa.int64()),
                ],
                ["block", "ids", "sizes", "gaps", "langs", "words", "counts"],
            )

        where: list[np.ndarray] = []
        for batch in batches:
            for lang, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for part in parts(raw, size):
                    words = part.replace(b"\n", b" . ").split()  # no word is a full stop
                    number = numbers.setdefault(lang, Numbers())
                    each = np.fromiter((-1 if w == b"." else number[w] for w in words), np.int64, len(words))
                    held = np.nonzero(each >= 0)[0]
                    found.append(each[held])
                    where.append(held + at)
                    lang_of.append(lang)
                    at += len(words) + 1  # a place between texts stays free
                    total += len(part)
                    if total >= size:
                        yield block()
                        numbers, found, lang_of, where, total, at, k = {}, [], [], [], 0, 0, k + 1
        if any(map(len, found)):
            yield block()

    return made


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """head, tail, place, n of the phrases one word longer in each block."""
    for batch in batches:
        for row in batch.to_pylist():
            first, last, n, _, _ = extended(row["sizes"], row["gaps"])
            ids = np.frombuffer(row["ids"], "<i8")
            if len(n) >= 1 << AT_BITS:
                raise ValueError("a block holds too many phrases: take smaller blocks")
            for at in range(0, len(n), ROWS):
                some = slice(at, at + ROWS)
                place = (row["block"] << AT_BITS) + np.arange(at, min(at + ROWS, len(n)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, pa.int64()) for x in (ids[first[some]], ids[last[some]], place, n[some])], ["head", "tail", "place", "n"]
                )


def _kept(extend: bool):
    """Lists of a block (those extended by a word, or as they are) of which those stay that are frequent in the corpus."""

    def of_block(held: pa.Table, frequent: pa.Table) -> pa.Table:
        names = ["block", "ids", "sizes", "gaps"]
        if not held.num_rows or not frequent.num_rows:
            return pa.table({"block": pa.array([], pa.int64()), **{c: pa.array([], pa.binary()) for c in names[1:]}})
        row = held.select(names).to_pylist()[0]
        if extend:
            _, _, n, places, number = extended(row["sizes"], row["gaps"])
        else:
            places, number = ordered(row["sizes"], row["gaps"])
            n = np.frombuffer(row["sizes"], "<i4")
        at = frequent["place"].to_numpy() & ((1 << AT_BITS) - 1)
        ids = frequent["id"].to_numpy()
        order = np.argsort(ids)  # in order of ids, so that what is sent later compresses well
        new = np.full(len(n), -1, np.int64)
        new[at[order]] = np.arange(len(ids))
        stay = new[number] >= 0
        gaps, sizes = lists(new[number[stay]], places[stay], len(ids))
        return pa.table(dict(zip(names, _row(row["block"], ids[order], sizes, gaps), strict=True)))

    return of_block


def _frequent(rows: DataFrame, keys: list[str], least: int) -> DataFrame:
    """The rows (place, n) of keys that count `least` or more over all blocks, with f and id."""
    same = Window.partitionBy(*keys)
    summed = rows.withColumns({"f": F.sum("n").over(same), "id": F.min("place").over(same)})
    return summed.where(F.col("f") >= least).drop("n")


def _block_of(place: Column) -> Column:
    return F.shiftright(place, AT_BITS)


def _narrowed(held: DataFrame, frequent: DataFrame, extend: bool, name: str) -> DataFrame:
    places = frequent.select(_block_of(F.col("place")).alias("block"), "place", "id")
    return cut(held.groupBy("block").cogroup(places.groupBy("block")).applyInArrow(_kept(extend), LISTS), name)


def phrases(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, block_bytes: int = BLOCK_BYTES) -> list[DataFrame]:
    """For k = 1 to longest the frequent phrases of k words, and last the number of all words of each language.

    Each has k, id (unique for its k), lang, phrase, last (word), f, heads and tails (frequencies of its first and last 1
    to k - 1 words) and inside (k and id of the shorter phrases of two words or more that it holds).
    """
    given = docs.select(
        F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("_lang"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary").alias("_raw"),
    )
    schema = f"{LISTS}, langs array<string>, words array<string>, counts array<long>"
    held = cut(given.mapInArrow(_blocks(block_bytes), schema), "postings")
    listed = held.select("block", F.posexplode(F.arrays_zip("langs", "words", "counts")).alias("at", "w"))
    words = listed.select(
        F.col("w.langs").alias("lang"), F.col("w.words").alias("word"), (F.shiftleft("block", AT_BITS) + F.col("at")).alias("place"), F.col("w.counts").alias("n")
    )
    all_words = cut(words.groupBy("lang").agg(F.sum("n").alias("n")), "words")
    hits = cut(_frequent(words, ["lang", "word"], least), "phrases-1")
    none, nothing = F.array().cast("array<long>"), F.array().cast("array<struct<k:int,id:long>>")
    one = [F.lit(1).alias("k"), "id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f"]
    found = [hits.where("place = id").select(*one, none.alias("heads"), none.alias("tails"), nothing.alias("inside"))]
    for k in range(2, longest + 1):
        before, held = held, _narrowed(held.select(*LISTS.replace(" long", "").replace(" binary", "").split(", ")), hits, k > 2, f"lists-{k - 1}")
        empty(before)
        if k > 2:
            empty(hits)
        hits = cut(_frequent(held.mapInArrow(_candidates, "head long, tail long, place long, n long"), ["head", "tail"], least), f"hits-{k}")
        made = _joined(hits.where("place = id"), found[-1], k)
        found.append(cut(made, f"phrases-{k}"))
    empty(held)
    empty(hits)
    return [*found, all_words]


def _joined(longer: DataFrame, shorter: DataFrame, k: int) -> DataFrame:
    """Phrases of k words (id, head, tail, f) with what their first and last k - 1 words tell."""
    first = shorter.select(F.col("id").alias("head"), F.struct("lang", "phrase", "f", "heads", "inside").alias("h"))
    second = shorter.select(F.col("id").alias("tail"), F.struct("last", "f", "tails", "inside").alias("t"))
    inside = F.array_union("h.inside", "t.inside")
    own = F.array(*[F.struct(F.lit(k - 1).alias("k"), F.col(c).alias("id")) for c in ("head", "tail")])
    return longer.join(first, "head").join(second, "tail").select(
        F.lit(k).alias("k"), "id", "h.lang", F.concat_ws(" ", "h.phrase", "t.last").alias("phrase"), "t.last", "f",
        F.concat("h.heads", F.array("h.f")).alias("heads"), F.concat("t.tails", F.array("t.f")).alias("tails"),
        (F.array_union(inside, own) if k > 2 else inside).alias("inside"),
    )


def mine(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, keep: int = KEEP,
    inside_percent: int = INSIDE_PERCENT, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `keep` collocations of each language that hold together best.

    a counts the phrase, l and r the parts of its weakest cut, n all words; score is 2000000 a / (l + r), rounded down.
    A phrase that a longer one holds goes if that counts inside_percent of it or more.
    """
    *found, all_words = phrases(docs, text, lang, least, longest, block_bytes)
    whole = lambda c: c.cast("decimal(19,0)")
    every = reduce(DataFrame.unionByName, found[1:])
    cuts = F.transform(F.sequence(F.lit(1), F.size("heads")), lambda k: F.struct(k.alias("k"), F.element_at("heads", k).alias("l"), F.element_at("tails", -k).alias("r")))
    scored = F.array_min(F.transform(cuts, lambda c: F.struct(_exact_score(F.col("f"), c["l"], c["r"]).alias("score"), c["k"].alias("k"), c["l"].alias("l"), c["r"].alias("r"))))
    held = every.select(F.explode("inside").alias("_in"), F.col("f").alias("most"))
    most = held.groupBy("_in.k", "_in.id").agg(F.max("most").alias("most"))
    left = every.join(most, ["k", "id"], "left").where(F.col("most").isNull() | (whole(F.col("most")) * 100 < whole(F.col("f")) * inside_percent))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = left.select("lang", "phrase", F.col("f").alias("a"), scored.alias("_s")).select("lang", "phrase", "a", "_s.l", "_s.r", "_s.score")
    ranked = ranked.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= keep)
    return ranked.join(all_words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _exact_score(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """2000000 a / (l + r), rounded down, in decimals of 38 digits: products may pass 64 bits."""
    over = a.cast("decimal(19,0)") * F.lit(2_000_000).cast("decimal(7,0)")
    under = l.cast("decimal(19,0)") + r.cast("decimal(19,0)")
    return F.call_function("div", over, under).cast("long")

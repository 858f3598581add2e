"""Fill-in-middle transformation (operator 13).

A table-driven automaton over bytes scans every text once. Its state holds how many UTF-8 continuation bytes are still
due and how much of a sentinel has been read; each transition emits counts: one for the first byte of a code point, one
for the last byte of a sentinel. Texts are laid out as lanes of LANE bytes and all lanes of a batch take their steps
together in numpy. The state depends on the last few bytes only, so a lane starts from those before it and no step
waits for the lane before. The sums of the lanes give the code points of a text, whether it holds a sentinel, and the
lane in which a cut lies; a second pass over those lanes alone locates the byte of the cut. Whole texts are scanned,
also those of many megabytes. The JVM then cuts the bytes and joins them in their new order: no shuffle, and a lost
task scans its rows again with the same result.

A document keeps its order (form plain) by a share of its key's hash, or if its text is null or empty or holds a
sentinel. Null text: as an empty one. Null key: as an empty one. Repeated rows: each by itself, alike. Empty table: no
rows. Columns of the input stay, whatever their names, but for those that this operator adds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import aside, back, bind

#: Marks before the prefix, the suffix and the middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Percent of documents that are cut, and percent of those whose suffix comes first.
CUT_PERCENT, SUFFIX_FIRST_PERCENT = 90, 20
LANE = 256
OUTSIDE = 0xFF
ADDED = ("n", "form", "prefix_chars", "middle_chars", "output")


def check_sentinels(sentinels: tuple[str, ...]) -> None:
    """Sentinels must not overlap each other, or a sentinel could appear across the border of a text and a mark."""
    if len(sentinels) != 3 or len(set(sentinels)) != 3 or not all(sentinels):
        raise ValueError("three different sentinels are needed: prefix, suffix, middle")
    for a in sentinels:
        for b in sentinels:
            if a != b and b in a or any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b)) + (a != b)) if b[:k] != a):
                raise ValueError(f"{a!r} ends with what {b!r} begins with, or holds it")


class Scanner:
    """The automaton: next state and emitted counts by state and class of byte."""

    HIT = 1 << 16

    def __init__(self, sentinels: tuple[str, ...] = SENTINELS):
        marks = [s.encode() for s in sentinels]
        parts = {m[:k] for m in marks for k in range(len(m) + 1)}
        number, waiting, rows, counts = {(0, b""): 0}, [(0, b"")], [], []
        while waiting:
            due, read = waiting.pop(0)
            row, count = [], []
            for b in range(256):
                if b == OUTSIDE:  # never a byte of UTF-8: stands for what lies before and behind a text
                    to, emitted = (0, b""), 0
                else:
                    inside = due > 0 and 0x80 <= b < 0xC0
                    left = due - 1 if inside else (b >= 0xC0) + (b >= 0xE0) + (b >= 0xF0)
                    tail = read + bytes([b])
                    while tail not in parts:
                        tail = tail[1:]
                    to, emitted = (left, tail), (not inside) + self.HIT * (tail in marks)
                if to not in number:
                    number[to] = len(number)
                    waiting.append(to)
                row.append(number[to])
                count.append(int(emitted))
            rows.append(row)
            counts.append(count)
        both = np.concatenate([np.array(rows, np.int32), np.array(counts, np.int32)])
        kinds, of_byte = np.unique(both, axis=1, return_inverse=True)
        self.classes = kinds.shape[1]
        self.of_byte = of_byte.ravel().astype(np.uint8)
        self.next = (kinds[: len(rows)] * self.classes).ravel().astype(np.int32)
        self.emit = kinds[len(rows) :].ravel().astype(np.int32)
        #: So many bytes decide the state, whatever it was before them.
        self.memory = max(3, *map(len, marks))

    def lanes(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Classes of bytes, a column for each lane, `memory` rows of what stands before it first; lanes of each text."""
        per = np.fromiter((-(-len(t) // LANE) for t in texts), np.int64, len(texts))
        flat = b"".join(t.ljust(k * LANE, bytes([OUTSIDE])) for t, k in zip(texts, per.tolist(), strict=True))
        body = self.of_byte[np.frombuffer(flat, np.uint8)].reshape(-1, LANE)
        before = np.full((len(body), self.memory), self.of_byte[OUTSIDE], np.uint8)
        before[1:] = body[:-1, LANE - self.memory :]
        before[(np.cumsum(per) - per)[per > 0]] = self.of_byte[OUTSIDE]
        return np.ascontiguousarray(np.concatenate([before, body], 1).T), per

    def run(self, lanes: np.ndarray, each: bool = False) -> np.ndarray:
        """Counts that each lane emits, or, with `each`, those of all its steps."""
        state = np.zeros(lanes.shape[1], np.int32)
        for row in lanes[: self.memory]:
            state = self.next[state + row]
        total = np.zeros(lanes.shape[1], np.int32)
        steps = np.zeros((LANE if each else 0, lanes.shape[1]), np.int32)
        for k, row in enumerate(lanes[self.memory :]):
            at = state + row
            emitted, state = self.emit[at], self.next[at]
            total += emitted
            if each:
                steps[k] = emitted
        return steps if each else total

    def scan(self, texts: list[bytes], first: np.ndarray, second: np.ndarray) -> dict[str, np.ndarray]:
        """Code points, sentinels and both cuts (code points and bytes) of each text; cuts lie at first, second % (n + 1)."""
        lanes, per = self.lanes(texts)
        counts = self.run(lanes)
        units = np.concatenate([[0], np.cumsum(counts % self.HIT, dtype=np.int64)])
        hits = np.concatenate([[0], np.cumsum(counts // self.HIT, dtype=np.int64)])
        end = np.cumsum(per)
        start = end - per
        n = units[end] - units[start]
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        cuts = np.sort(np.stack([first % (n + 1), second % (n + 1)]), 0)
        places = []
        for cut in cuts:
            place = size.copy()  # a cut behind the last code point
            some = np.nonzero(cut < n)[0]
            lane = np.searchsorted(units, units[start[some]] + cut[some], "right") - 1
            left = units[start[some]] + cut[some] - units[lane]
            seen = np.cumsum(self.run(lanes[:, lane], each=True) % self.HIT, 0)
            place[some] = (lane - start[some]) * LANE + (seen <= left).sum(0)
            places.append(place)
        return {"n": n, "marks": hits[end] - hits[start], "first": cuts[0], "second": cuts[1], "at": places[0], "to": places[1]}


@lru_cache(maxsize=4)
def _scanner(sentinels: tuple[str, ...]) -> Scanner:
    return Scanner(sentinels)


def draws(key: Column, salt: str = "1:") -> list[Column]:
    """Four numbers from the key: the first groups of eight hexadecimal digits of the SHA-256 of salt and key."""
    hashed = F.sha2(F.concat(F.lit(salt), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(hashed, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def transform(
    docs: DataFrame, key: str = "doc_id", text: str = "text", sentinels: tuple[str, ...] = SENTINELS,
    cut_percent: int = CUT_PERCENT, suffix_first_percent: int = SUFFIX_FIRST_PERCENT,
) -> DataFrame:
    """docs with n (code points), form (plain, psm, spm), prefix_chars, middle_chars (null if plain) and output."""
    check_sentinels(sentinels)

    @F.pandas_udf("n long, marks long, first long, second long, at long, to long")
    def scanned(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        scanner = _scanner(sentinels)
        for raw, first, second in batches:
            yield pd.DataFrame(scanner.scan(raw.tolist(), first.to_numpy(np.int64), second.to_numpy(np.int64)))

    name = lambda c: F.col(f"`{c}`")
    raw = F.coalesce(name(text).cast("string"), F.lit("")).cast("binary")
    given = aside(docs, raw.alias("_raw"), F.array(*draws(name(key))).alias("_h"))
    found = given.withColumn("_at", scanned("_raw", F.col("_h")[0], F.col("_h")[1]))
    plain = (F.col("_at.n") == 0) | (F.col("_at.marks") > 0) | (F.col("_h")[2] % 100 >= cut_percent)
    form = F.when(plain, "plain").when(F.col("_h")[3] % 100 < suffix_first_percent, "spm").otherwise("psm")
    found = found.withColumn("_form", form)
    before, behind, between = (F.lit(s.encode()) for s in sentinels)
    part = lambda a, b: F.substring(F.col("_raw"), a.cast("int") + 1, (b - a).cast("int"))
    at, to = F.col("_at.at"), F.col("_at.to")
    prefix, middle, suffix = part(F.lit(0), at), part(at, to), part(to, F.octet_length("_raw"))
    made = (
        F.when(F.col("_form") == "plain", F.col("_raw"))
        .when(F.col("_form") == "psm", F.concat(before, prefix, behind, suffix, between, middle))
        .otherwise(F.concat(behind, suffix, before, prefix, between, middle))
    )
    cut = F.col("_form") != "plain"
    return back(
        found, docs,
        n=F.col("_at.n"), form=F.col("_form"),
        prefix_chars=F.when(cut, F.col("_at.first")), middle_chars=F.when(cut, F.col("_at.second") - F.col("_at.first")),
        output=made.cast("string"),
    )


def restore(output: Column, form: Column, sentinels: tuple[str, ...] = SENTINELS) -> Column:
    """The text again, from output and form alone."""
    parts = F.split(output, "|".join(re.escape(s) for s in sentinels), -1)
    whole = lambda p: F.when(form == "psm", F.concat(p[1], p[3], p[2])).otherwise(F.concat(p[2], p[3], p[1]))
    return F.when(form == "plain", output).otherwise(bind(parts, whole))

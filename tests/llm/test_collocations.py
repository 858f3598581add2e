"""Collocations against counts of every phrase in plain dictionaries, with blocks of every size."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from broadsheet.llm import collocations, queries

from .corpus import SCHEMA, table, texts

COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def mined(rows, least=30, longest=4, keep=2000, percent=80):
    """rows: (text, lang)."""
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(ASCII)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, count in f.items():
        good = {p: a for p, a in count.items() if a >= least and len(p) > 1}
        most = Counter()
        for p, a in good.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    most[p[i : i + m]] = max(most[p[i : i + m]], a)
        found = []
        for p, a in good.items():
            cuts = [(2_000_000 * a // (count[p[:k]] + count[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            if not most[p] or 100 * most[p] < percent * a:
                found.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:keep], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def given():
    rng = random.Random(4)
    words = [f"w{k}" for k in range(12)] + ["Über", "ÉTÉ", "日本", "a-b", "ﬁ", "\x1f", "É"]
    some = ["".join(rng.choice(words) + rng.choice([" "] * 9 + ["  ", "\t", ", ", ".", "\n", "\r\n", " ! "]) for _ in range(rng.randrange(150))) for _ in range(40)]
    return [*texts(8), *some, "x X x x X x x x x", "aa bb " * 300, "p q r s t " * 40, "\n".join(["one two three"] * 50), ". , ;", "😀 😀 😀"]


def rows(some):
    return [(i, t, [None, "en", "de"][i % 3], "s", None, "clash") for i, t in enumerate(some)]


@pytest.mark.parametrize(
    ("size", "least", "longest", "keep", "percent"),
    [(1 << 24, 2, 4, 10**6, 80), (2000, 5, 4, 20, 60), (2000, 3, 2, 50, 80), (2000, 2, 5, 10**6, 100), (1, 2, 3, 10**6, 80)],
)
def test_against_dictionaries(spark, size, least, longest, keep, percent):
    some = rows(given() if size > 1 else given()[60:])
    docs = spark.createDataFrame(some, SCHEMA).repartition(3)
    got = collocations.mine(docs, least=least, longest=longest, keep=keep, inside_percent=percent, block_bytes=size)
    want = mined([(r[1], r[2]) for r in some], least, longest, keep, percent)
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got.collect()) == want
    assert len(want) > 20


def test_long_texts_are_divided_between_pieces_only():
    text = b"Aa bb, cc" * 200 + b"x" * 500 + b". end"
    for size in (1, 7, 100, 10**6):
        parts = list(collocations.parts(text, size))
        assert b"\n".join(parts) == text.translate(collocations.PLAIN)
        assert size > 7 or len(parts) > 100


def test_lists_hold_the_places_of_each_phrase():
    import numpy as np

    gaps, sizes = collocations.lists(np.array([0, 1, 0, 2, 0, 1]), np.array([0, 1, 3, 4, 6, 7]), 3)
    first, last, n, places, number = collocations.extended(sizes.tobytes(), gaps.tobytes())
    # 0 1 . 0 2 . 0 1
    assert list(zip(first.tolist(), last.tolist(), n.tolist(), strict=True)) == [(0, 1, 2), (0, 2, 1)]
    assert sorted(zip(number.tolist(), places.tolist(), strict=True)) == [(0, 0), (0, 6), (1, 3)]


def test_scores_are_exact_beyond_64_bits(spark):
    numbers = [(10**15, 10**15, 10**15 + 1), (7, 11, 13), (9 * 10**17, 9 * 10**17, 9 * 10**17), (10**18, 10**18 + 1, 10**18 + 3)]
    got = spark.createDataFrame(numbers, "a long, l long, r long").select(collocations._exact_score(F.col("a"), F.col("l"), F.col("r"))).collect()
    assert [r[0] for r in got] == [2_000_000 * a // (left + right) for a, left, right in numbers]


def test_nothing_to_find(spark):
    docs = table(spark, ["one two three", None, ""]).withColumns({"a.b": F.lit(1), "rank": F.lit(2), "ids": F.lit(3)})
    assert collocations.mine(docs).count() == 0
    assert collocations.mine(docs.limit(0)).count() == 0
    got = collocations.mine(docs, least=1)
    assert got.columns == [*COLUMNS] and {r.phrase for r in got.collect()} == {"one two three"}


def test_query(spark, tmp_path):
    some = rows(given())
    spark.createDataFrame(some, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op12_collocations"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got) == mined([(r[1], r[2]) for r in some])

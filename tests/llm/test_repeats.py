from collections import Counter, defaultdict

import pytest

from broadsheet.llm import repeats, substring, suffixes
from broadsheet.llm.hashing import Powers

from .corpus import SCHEMA, table, texts


def without_words(all_texts, length):
    words = [(t or "").encode().split() for t in all_texts]
    count = Counter(tuple(w[i : i + length]) for w in words for i in range(len(w) - length + 1))
    for w in words:
        gone = set()
        for i in range(len(w) - length + 1):
            if count[tuple(w[i : i + length])] > 1:
                gone.update(range(i, i + length))
        yield len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone)


def without_bytes(all_texts, length):
    seen = set()
    for t in all_texts:
        b = (t or "").encode()
        gone = set()
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            if s in seen:
                gone.update(range(i, i + length))
            seen.add(s)
        yield len(b), len(gone), sum(1 for i in gone if i - 1 not in gone), bytes(
            x for i, x in enumerate(b) if i not in gone
        )


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("length", [35, 12])
def test_words_against_brute_force(spark, seed, length):
    given = texts(seed)
    got = {r.doc_id: (r.n_words, r.n_removed, bytes(r.kept)) for r in substring.remove(table(spark, given), length).collect()}
    assert got == dict(enumerate(without_words(given, length)))


@pytest.mark.parametrize("seed", [3, 4])
def test_bytes_against_brute_force(spark, seed):
    given = texts(seed, vocabulary=60)
    got = {
        r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept))
        for r in suffixes.remove(table(spark, given)).collect()
    }
    assert got == dict(enumerate(without_bytes(given, 100)))


def test_long_texts_go_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 50)
    given = texts(5)
    held = [p for piece in repeats._pieces(range(len(given)), [(t or "").encode() for t in given], substring.word_symbols, 35) for p in piece]
    starts = defaultdict(int)
    for at, _, s in held:
        starts[at] += len(s) - 34
    assert starts == {i: n - 34 for i, t in enumerate(given) if (n := len((t or "").split())) >= 35}


def test_repeated_and_null_ids(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(None, passage), (None, None), (7, passage), (7, passage), (8, "alone"), (8, "")]
    docs = spark.createDataFrame([(a, b, None, None, None, None) for a, b in rows], SCHEMA)
    words = sorted(((r.doc_id, r.n_words, r.n_removed) for r in substring.remove(docs).collect()), key=str)
    assert words == sorted([(None, 40, 40), (None, 0, 0), (7, 40, 40), (7, 40, 40), (8, 1, 0), (8, 0, 0)], key=str)
    left = sorted(((r.doc_id, r.n_bytes, r.n_removed) for r in suffixes.remove(docs).collect()), key=str)
    n = len(passage)
    assert left == sorted([(None, n, 0), (None, 0, 0), (7, n, n), (7, n, n), (8, 5, 0), (8, 0, 0)], key=str)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert substring.remove(docs).count() == 0
    assert suffixes.remove(docs).count() == 0


def test_hashes_of_equal_stretches_agree():
    symbols = substring.word_symbols(b"a b c d a b c d")
    p = Powers(0x9E3779B97F4A7C15)
    four = p.many(p.sums(symbols), 4)
    assert four[0] == four[4] and len(set(four.tolist())) == 4

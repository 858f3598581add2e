"""Fill-in-middle against plain string slices, on texts around every border of the scan."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from broadsheet.llm import infilling, queries

from .corpus import table, texts


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain(key, text, marks=infilling.SENTINELS, cut=90, first=20):
    """n, form, prefix, middle, output of one text."""
    text, hashed = text or "", sha(f"1:{key}")
    h = [int(hashed[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in marks) or h[2] % 100 >= cut:
        return n, "plain", None, None, text
    p, s, m = marks
    if h[3] % 100 < first:
        return n, "spm", a, b - a, s + text[b:] + p + text[:a] + m + text[a:b]
    return n, "psm", a, b - a, p + text[:a] + s + text[b:] + m + text[a:b]


def given(marks=infilling.SENTINELS):
    rng = random.Random(9)
    pool = ["a", "é", "日", "😀", "\n", "<", "P", "S", "M", ">", "\x00", "߿", "ࠀ", "￿"]
    some = ["".join(rng.choice(pool) for _ in range(rng.choice([1, 2, 85, 86, 127, 128, 255, 256, 257, 511, 1500]))) for _ in range(300)]
    ends = [f"{'x' * k}{m}{'y' * j}" for k in (0, 253, 254, 255, 256, 300) for m in (*marks, *[m[:-1] for m in marks], marks[0][:-1] + marks[1]) for j in (0, 3)]
    return [*texts(11), *some, *ends, "<" * 700, "😀" * 4000, "word " * 60_000]


@pytest.mark.parametrize(("marks", "cut", "first"), [(infilling.SENTINELS, 90, 20), (("<fim→>", "<|suf|>", "⟦mid⟧"), 100, 50)])
def test_against_slices(spark, marks, cut, first):
    some = given(marks)
    made = infilling.transform(table(spark, some), sentinels=marks, cut_percent=cut, suffix_first_percent=first)
    made = made.withColumn("again", infilling.restore(F.col("output"), F.col("form"), marks))
    forms = set()
    for r in made.collect():
        want = plain(r.doc_id, some[r.doc_id], marks, cut, first)
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == want
        assert r.again == (some[r.doc_id] or "") and r.kept == "clash" and r.text == some[r.doc_id]
        forms.add(r.form)
    assert forms == {"plain", "psm", "spm"}


def test_the_automaton_forgets_what_lies_further_back_than_its_memory():
    for marks in (infilling.SENTINELS, ("<fim→>", "<|suf|>", "⟦mid⟧")):
        scanner = infilling.Scanner(marks)
        states = range(len(scanner.next) // scanner.classes)
        rng = random.Random(1)
        for _ in range(3000):
            seen = set()
            word = [rng.randrange(scanner.classes) for _ in range(scanner.memory)]
            for state in states:
                at = state * scanner.classes
                for c in word:
                    at = scanner.next[at + c]
                seen.add(int(at))
            assert len(seen) == 1


def test_counts_and_places_of_a_batch():
    scanner, some = infilling.Scanner(), given()
    raws = [(t or "").encode() for t in some]
    n = len(raws)
    first, second = np.arange(n) * 7919, np.arange(n) * 104729 + 3
    found = scanner.scan(raws, first, second)
    for k, t in enumerate(some):
        t = t or ""
        a, b = sorted((int(first[k]) % (len(t) + 1), int(second[k]) % (len(t) + 1)))
        assert (found["at"][k], found["to"][k]) == (len(t[:a].encode()), len(t[:b].encode()))
        assert found["marks"][k] == sum(t.count(m) for m in infilling.SENTINELS)
    assert all(len(v) == 0 for v in scanner.scan([], np.zeros(0, np.int64), np.zeros(0, np.int64)).values())


@pytest.mark.parametrize("marks", [("ab", "bc", "cd"), ("aa", "b", "c"), ("abc", "b", "d"), ("a", "a", "b"), ("a", "", "b"), ("a", "b")])
def test_sentinels_that_overlap_are_refused(marks):
    with pytest.raises(ValueError):
        infilling.check_sentinels(marks)


def test_clashing_columns_null_keys_and_empty_tables(spark):
    docs = table(spark, ["some text here", None, ""]).withColumns({"a.b": F.lit(1), "form": F.lit("x"), "_raw": F.lit(2), "at": F.lit(3)})
    docs = docs.union(docs.withColumn("doc_id", F.lit(None).cast("long")))
    got = infilling.transform(docs)
    assert set(got.columns) == {*docs.columns, *infilling.ADDED}
    rows = got.collect()
    assert len(rows) == 6 and {r["a.b"] for r in rows} == {1}
    for r in rows:
        assert r.output == plain("" if r.doc_id is None else r.doc_id, r.text)[4]
    assert infilling.transform(docs.limit(0)).count() == 0


def test_query(spark, tmp_path):
    some = given()
    table(spark, some).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op13_infilling"](spark, str(tmp_path)).collect()
    assert len(got) == len(some)
    for r in got:
        n, form, prefix, middle, output = plain(r.doc_id, some[r.doc_id])
        assert r.asDict() == {"doc_id": r.doc_id, "n": n, "form": form, "prefix_chars": prefix, "middle_chars": middle, "output_sha256": sha(output), "restored_sha256": sha(some[r.doc_id] or "")}

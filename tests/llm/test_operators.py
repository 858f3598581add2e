import base64

import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from broadsheet.llm import bpe, mixing, near_dedup, quality, queries, secrets
from pyspark.sql import functions as F

from .corpus import SCHEMA, table, texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(text or "")]
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} - {()}


def grouped(given, percent=85):
    sets = [shingles(t) for t in given]
    root = list(range(len(given)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(s), find(i), find(i) == i) for i, s in enumerate(sets)}


def near_texts(seed):
    rng = random.Random(seed)
    out = texts(seed)
    base = [f"n{rng.randrange(500)}" for _ in range(120)]
    for _ in range(60):  # a chain of copies, each a little further from the first
        base = base[:]
        for _ in range(rng.randrange(1, 4)):
            base[rng.randrange(len(base))] = f"n{rng.randrange(500)}"
        out.append(" ".join(base))
    return out


def test_near_dedup_against_all_pairs(spark):
    given = near_texts(11)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.label(table(spark, given), percent=85, shingle=3).collect()}
    assert got == grouped(given)
    kept = near_dedup.keep_one(table(spark, given), percent=85, shingle=3)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "kept"]
    assert {r.doc_id for r in kept.collect()} == {i for i, x in got.items() if x[2]}


def test_sketches_merge():
    a, b = near_dedup.shingle_set("a b c d e f g", 3), near_dedup.shingle_set("x y z f g h", 3)
    both = np.maximum(near_dedup.registers(a), near_dedup.registers(b))
    assert (both == near_dedup.registers(np.union1d(a, b))).all()


BASE = {
    "assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": "AKIA[A-Z0-9]+",
    "hex": "[0-9a-f]+",
}


def secret_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            if {"assign": kind == "assign" and len(m[2]) >= 6, "access": len(m[0]) >= 20, "hex": len(m[0]) >= 24}[kind]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_secret_base_spans(spark):
    rng = random.Random(5)
    bits = ["password", "=", " : ", "'", "Token", "apikey", "API_KEY", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "f00", "x-y", " ", "\n", "é😀", "secret", '"', "user=bob", "https://h.example/a "]
    given = ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(300)] + [None, "", "a" * 5000, "AKIA" * 900]
    got = {r.doc_id: [(x["s"], x["k"], x["e"]) for x in r.b] for r in secrets.scan(table(spark, given)).select("doc_id", secrets.base(F.col("secrets")).alias("b")).collect()}
    assert got == {i: secret_spans(t) for i, t in enumerate(given)}


def test_linked_parts_need_each_other(spark):
    opaque = "Ab3dEf6hIj9lMn2pQr5tUv8x"
    given = [f"user=robert key {opaque}", f"key {opaque}", "user=robert", f"user=robert {'w ' * 600} {opaque}"]
    got = {r.doc_id: [x["kind"] for x in r.secrets] for r in secrets.scan(table(spark, given)).collect()}
    assert got == {0: ["login", "opaque"], 1: [], 2: [], 3: []}
    clean = {r.doc_id: r for r in secrets.redact(table(spark, [*given, "a password=hunter22 b", None])).collect()}
    assert clean[4].text == "a [SECRET] b" and clean[5].text is None and clean[1].text == given[1] and clean[1].kept == "clash"


def test_bpe_as_tiktoken(spark):
    ranks, pattern = queries.vocabulary()
    encoding = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    given = [*texts(6), "x" * 3000, "äöü ß " * 50, "<|endoftext|> 123456 'll  \n\n  ok", "日本語テキスト" * 30, "😀👍🏽" * 9, "ab" * 900]
    got = {r.doc_id: (r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in bpe.encode(table(spark, given), ranks, pattern).collect()}
    for i, t in enumerate(given):
        ids = encoding.encode_ordinary(t or "")
        assert got[i] == (len(ids), np.array(ids, "<u4").tobytes(), (t or "").encode()), t


def quality_base(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    inside = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines, dup = Counter(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += lines[line] > 0
            lines[line] += 1
    failed = len(w) < 50 or 100 * len(inside) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(inside), failed


def test_quality_base_and_kept(spark):
    given = [*texts(8), "x y z\nx y z\n \nx y z", "#*$ " * 60, "\x85 word s " * 30]
    measured = quality.measure(table(spark, given))
    rows = quality.judge(measured, quality.sketches(measured)).collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert {r.doc_id: tuple(r[n] for n in names) for r in rows} == {i: quality_base(t) for i, t in enumerate(given)}
    assert all(r.kept is not None and not (r.kept and r.base_failed) for r in rows)
    kept = quality.keep_good(table(spark, given))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "kept"]


def test_quality_outlier_goes_and_neighbours_stay(spark):
    rng = random.Random(2)
    plain = [" ".join(f"w{rng.randrange(900)}" for _ in range(80)) for _ in range(300)]
    odd = " ".join(f"w{rng.randrange(900)}#$%&" for _ in range(80))
    kept = {r.doc_id for r in quality.keep_good(table(spark, [*plain, odd])).collect()}
    assert kept == set(range(300))


def test_mixing_targets_and_totals(spark):
    rng = random.Random(3)
    rows = [(i, " ".join("w" for _ in range(rng.randrange(1, 60))), "en", rng.choice(["a", "b", "b", "b", "c", "d", None]), None, "k") for i in range(900)]
    rows.append((900, None, None, "e", None, None))
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.take(mixing.sized(docs).drop("text")).collect()
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken % max(1, r.size) == 0 and r.taken <= 3 * r.size
    left, weights = sum(sizes.values()), dict(zip(["a", "b", "c", "d", "e", None], [1, 2, 3, 1, 2, 3], strict=True))
    want, free = {}, dict(weights)
    while True:  # fill to the limits, then share what is above
        share = {s: left * w / sum(free.values()) for s, w in free.items()}
        over = [s for s in free if share[s] > 3 * sizes[s] or sizes[s] == 0]
        if not over:
            want |= share
            break
        for s in over:
            want[s] = 3 * sizes[s]
            left -= want[s]
            del free[s]
    for s in sizes:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= 60, s
    assert sum(len(r.text.split()) for r in mixing.mix(docs).collect()) == sum(taken.values())


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(21)
    word = lambda: f"w{rng.randrange(3000)}"
    good = [" ".join(word() for _ in range(rng.randrange(60, 120))) for _ in range(240)]
    given = [*good, *good[:20], "short", None, "", good[3] + " password=abcdefgh12"]
    rows = [(i, t, "en", f"src{i % 3}", None if t is None else len(t)) for i, t in enumerate(given)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    keep = [i for i, t in enumerate(given) if not quality_base(t)[-1]]
    label = grouped([given[i] for i in keep])
    alive = [keep[i] for i, x in label.items() if x[2]]
    ranks, pattern = queries.vocabulary()
    encoding = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    assert {r.doc_id for r in out} <= set(alive) and all(r.round_trip for r in out)
    for r in out:
        assert bytes(r.ids) == np.array(encoding.encode_ordinary(given[r.doc_id]), "<u4").tobytes()
    docs = spark.createDataFrame([(i, given[i], "en", f"src{i % 3}", None) for i in alive], schema)
    taken = {r.doc_id: r.times for r in mixing.take(mixing.sized(docs).drop("text")).collect()}
    assert Counter(r.doc_id for r in out) == Counter({i: n for i, n in taken.items() if n})


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for f in (near_dedup.label, near_dedup.keep_one, quality.keep_good, secrets.redact, mixing.mix):
        assert f(docs).count() == 0
    assert bpe.encode(docs, *queries.vocabulary()).count() == 0


def test_vocabulary_file_is_read_as_ranks():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    first = open(path, "rb").readline().split()
    assert queries.vocabulary()[0][base64.b64decode(first[0])] == int(first[1])

"""The column kept of the quality rules, computed again from the measures in plain Python."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from broadsheet.llm import quality
from broadsheet.llm.shared import cut

SCHEMA = "doc_id long, text string, lang string, source string"
#: Ranks in thousandths, reach and size, written out here so that a loosened fence shows.
RANKS = dict.fromkeys(("symbols", "capitals", "stress"), (250, 750, 6, "word_chars")) | {"same_lines": (500, 980, 3, "n_lines"), "repeated": (500, 980, 3, "n_words")}


def edges(v):
    """The counter of a value: its first seven binary digits, and the largest value that shares them."""
    drop = max(v.bit_length() - 7, 0)
    return v >> drop << drop, (v >> drop << drop) + (1 << drop) - 1


def fence(rows, m, low, high, reach, size):
    at = lambda column, q: sorted(r[column] for r in rows)[max(1, -(-len(rows) * q // 1000)) - 1]
    top = edges(at(f"m_{m}", high))[1]
    return top + reach * max(top - edges(at(f"m_{m}", low))[0], 1_000_000 // max(1, edges(at(size, 250))[0]))


def judged(rows):
    """doc_id -> kept."""
    groups = defaultdict(list)
    for r in rows:
        if not r.base_failed:
            for g in ((), (r.lang,), (r.lang, r.source)):
                groups[g].append(r)
    out = {}
    for r in rows:
        out[r.doc_id] = not r.base_failed and all(r[f"m_{m}"] <= limit(groups, r, m) for m in RANKS)
    return out


def limit(groups, r, m, prior=200):
    """The fences of the corpus, of the language drawn to it, of the source drawn to that; the least counts."""
    at, fences = None, []
    for g in ((), (r.lang,), (r.lang, r.source)):
        n, own = len(groups[g]), fence(groups[g], m, *RANKS[m])
        at = own if at is None else (n * own + prior * at) / (n + prior)
        fences.append(at)
    return min(fences)


def text(rng, repeats=0, lines=0, symbols=0, words=100):
    out = [f"w{rng.randrange(5000)}" for _ in range(words)]
    for _ in range(repeats):
        i, j = rng.randrange(words - 3), rng.randrange(words - 3)
        out[i : i + 3] = out[j : j + 3]
    for i in rng.sample(range(words), symbols):
        out[i] += "#$"
    cut = [" ".join(out[i : i + 10]) for i in range(0, words, 10)]
    return "\n".join([*cut, *[cut[0]] * lines])


def corpus():
    rng = random.Random(17)
    rows = []

    def add(n, lang, source, **kind):
        rows.extend((len(rows) + i, text(rng, **{k: v(rng) for k, v in kind.items()}), lang, source) for i in range(n))

    some = lambda most, share: lambda r: r.randrange(1, most) if r.random() < share else 0
    add(400, "en", "a", repeats=some(3, 0.2))
    add(250, "en", "b", repeats=some(3, 0.2), lines=some(2, 0.1), symbols=some(4, 0.3))
    add(220, "en", "bad", symbols=lambda r: 60)
    add(30, "en", "small", lines=some(3, 0.5))
    add(240, "fr", None, repeats=some(2, 0.1))
    add(20, "de", "a", symbols=some(9, 0.5))
    add(20, None, "b", repeats=some(9, 0.5))
    add(6, "en", "a", repeats=lambda r: 7)
    add(3, "en", "a", lines=lambda r: 4)
    rows.append((len(rows), None, "en", "a"))
    return rows


def test_kept_against_plain_fences(spark):
    measured = quality.measure(spark.createDataFrame(corpus(), SCHEMA).repartition(4))
    rows = quality.judge(measured, quality.sketches(measured)).collect()
    want = judged(rows)
    assert {r.doc_id: r.kept for r in rows} == want
    gone = [r for r in rows if not r.kept and not r.base_failed]
    floors = {"symbols": 60_000, "capitals": 300_000, "stress": 60_000, "same_lines": 400_000, "repeated": 300_000}
    assert any(all(r[f"m_{m}"] <= top for m, top in floors.items()) for r in gone)  # fixed floors let it pass
    assert not any(r.kept for r in rows if r.source == "bad")  # a bad source has no fence above that of the corpus
    assert sum(r.kept for r in rows if r.source == "a" and r.lang == "en") > 390


def test_no_fixed_distance_decides(spark):
    """Shrunk or grown, a group's fences move with it: one sign in short texts weighs more than one in long texts."""
    rng = random.Random(2)
    rows = []
    for source, words in (("short", 60), ("long", 1500)):
        rows += [(len(rows) + i, text(rng, words=words), source, source) for i in range(40)]
    marked = {}
    for source, words in (("short", 60), ("long", 1500)):
        for signs in (1, 2, words // 4):
            marked[len(rows)] = (source, signs)
            rows.append((len(rows), text(rng, words=words) + "#" * signs, source, source))
    measured = cut(quality.measure(spark.createDataFrame(rows, SCHEMA)), "measured")  # as the query does, before a filter
    counters = quality.sketches(measured)
    limits = {r._s: r._fence.asDict() for r in quality.fences(counters).collect()}
    assert limits["short"]["stress"] > limits["long"]["stress"] > 0
    kept = {r.doc_id: r.kept for r in quality.judge(measured, counters).collect()}
    assert all(kept[i] == (signs <= 2) for i, (_, signs) in marked.items())


def test_long_texts_overflow_nothing(spark):
    docs = spark.createDataFrame([(0, "ABC!? " * 500_000, "en", "a"), (1, "ABC!?#\n" * 500_000, "en", "a")], SCHEMA)
    rows = cut(quality.measure(docs).drop("text"), "measured").orderBy("doc_id").collect()
    assert [(r.n_words, r.m_capitals, r.m_stress, r.m_symbols, r.m_repeated) for r in rows] == [(500_000, 600_000, 400_000, 0, 10**6), (500_000, 500_000, 333_333, 166_666, 10**6)]


def test_sketches_keep_seven_digits(spark):
    numbers = [0, 1, 63, 127, 128, 129, 255, 256, 1000, 65_535, 10**6, 2**40 + 12345]
    got = spark.createDataFrame([(n,) for n in numbers], "n long").select("n", quality.bucket(F.col("n")), quality._upper(quality.bucket(F.col("n")))).collect()
    assert [tuple(r) for r in got] == [(n, *edges(n)) for n in numbers]
    assert all(low <= n <= top and (top - low) * 64 <= n for n, low, top in got)

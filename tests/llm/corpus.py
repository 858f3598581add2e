"""Small corpora with copies, shared passages, odd rows, for the tests of the corpus operators."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string"


def rows(texts, lang="en", source="s"):
    return [(i, t, lang, source, None, "clash") for i, t in enumerate(texts)]


def table(spark, texts, **kind):
    return spark.createDataFrame(rows(texts, **kind), SCHEMA).repartition(3)


def texts(seed: int, n: int = 60, vocabulary: int = 400) -> list[str | None]:
    rng = random.Random(seed)
    word = lambda: "w" + str(rng.randrange(vocabulary))
    passages = [[word() for _ in range(rng.choice([30, 34, 35, 36, 50, 90]))] for _ in range(6)]
    out: list[str | None] = []
    for _ in range(n):
        words = [word() for _ in range(rng.randrange(1, 200))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(words) + 1)
            words[at:at] = rng.choice(passages)
        if out and rng.random() < 0.3:
            words = (rng.choice([t for t in out if t]) or "").split()
            if rng.random() < 0.6 and words:
                words[rng.randrange(len(words))] = word()
        out.append(rng.choice([" ", "\n", "  "]).join(words))
    return [*out, None, "", " \t\n", "a", "a " * 300, "é " * 120 + "z", "x" * 700, "ab" * 400, out[0], out[0]]

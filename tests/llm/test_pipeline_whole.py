"""The pipeline against plain versions of all its stages, and its stages on odd columns and long texts."""

import hashlib
import random
import time
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import tiktoken
from pyspark.sql import functions as F

from broadsheet.llm import mixing, near_dedup, quality, queries, secrets
from broadsheet.llm.shared import cut

from .corpus import table
from .test_operators import secret_spans
from .test_pipeline_near import firsts
from .test_quality_fences import judged
from .test_queries import WORD, budget, linked

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def redacted(text, mark="[SECRET]"):
    base = secret_spans(text)
    spans = sorted((s, e) for s, _, e in base + linked(text or "", base))
    out, at = [], 0
    for s, e in spans:
        if e <= at:
            continue
        if s >= at:
            out += [text[at:s], mark]
        at = e
    return "".join([*out, text[at:]])


def taken(rows):
    """doc_id -> how often, from (doc_id, text, source)."""
    sizes, by_source, out = Counter(), defaultdict(list), {}
    for i, text, source in rows:
        n = len(WORD.findall(text))
        sizes[source] += n
        by_source[source].append((int(hashlib.md5(f"{i}:{text}".encode()).hexdigest()[:15], 16), i, n))
    want = budget(sizes, sorted(sizes))
    for source, listed in by_source.items():
        whole, rest = divmod(want[source], sizes[source])
        at, taking = 0, True
        for _, i, n in sorted(listed):
            if taking and n:
                taking = at + n <= rest or at + n - rest < rest - at
                at += n
            out[i] = whole + (taking if n else 0)
    return out


def given():
    rng = random.Random(41)
    word = lambda: f"{rng.choice('wwwW')}{rng.randrange(6000)}"
    some = lambda n: [word() for _ in range(n)]
    good = [some(rng.randrange(60, 140)) for _ in range(90)]
    longer = [w + some(max(1, len(w) // 6)) for w in good[:12]]  # near copies at five words and 80 percent, not at 85
    edited = [[word() if i % 9 == 4 else x for i, x in enumerate(w)] for w in good[12:20]]  # no copies
    secret = [[*some(40), f"password={'x' * 5}{i:03d}", *some(30), "AKIA" + "A1B2C3D4" * 2, *some(20), "login:", f"bob{i}", *some(4), "Ab3dEf6hIj9lMn2pQr5tUv8x", *some(30)] for i in range(9)]
    junk = [[w + "#$%" for w in some(80)] for _ in range(4)]
    texts = [" ".join(w) for w in (*good, *longer, *edited, *secret, *junk)]
    return [*texts, "short", None, "", texts[3]]


def test_every_stage_takes_effect(spark, tmp_path):
    texts = given()
    rows = [(i, t, "en", f"src{i % 4}", None) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    good = {i for i, kept in judged(cut(quality.measure(docs), "test").collect()).items() if kept}
    assert 0 < len([t for t in texts if t and "#$%" in t and texts.index(t) not in good])
    order = sorted(good)
    alive = [order[k] for k in sorted(firsts([texts[i] for i in order]))]
    assert len(alive) <= len(order) - 12
    clean = {i: redacted(texts[i]) for i in alive}
    assert sum("[SECRET]" in t for t in clean.values()) >= 9
    times = taken([(i, clean[i], f"src{i % 4}") for i in alive])
    ranks, pattern = queries.vocabulary()
    encoding = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in out) == Counter({i: n for i, n in times.items() if n})
    for r in out:
        assert r.round_trip and bytes(r.ids) == np.array(encoding.encode_ordinary(clean[r.doc_id]), "<u4").tobytes()


def test_stages_keep_columns_with_dots(spark):
    docs = table(spark, [" ".join(f"w{k * j}" for j in range(80)) for k in range(1, 9)] + [None]).withColumns({"a.b": F.lit(7), "key": F.lit(1), "_doc": F.lit(2)})
    for stage in (near_dedup.keep_one, secrets.redact, mixing.mix):
        got = stage(docs)
        assert got.columns == docs.columns and {r["a.b"] for r in got.collect()} == {7}


def test_redaction_grows_with_the_text_only(spark):
    text = "".join(f"é word{i} password=abcdef{i} 😀 " for i in range(8000)) + "x" * 5000
    began = time.perf_counter()
    got = {r.doc_id: r.text for r in secrets.redact(table(spark, [text, "password=abcdef1", "a password=abcdef1password=abcdef2 b", "", None])).collect()}
    assert time.perf_counter() - began < 60
    assert got == {0: redacted(text), 1: "[SECRET]", 2: redacted("a password=abcdef1password=abcdef2 b"), 3: "", 4: None}

"""MinHash near-dedup on SetSketch registers (operator 1).

A document's set holds its distinct word shingles. Its sketch has REGISTERS values: the k-th is a truncated minimum,
floor(1 - log_b E), of exponential variates E that each shingle draws for register k. Values of two sketches merge by
taking the larger of each, and two sets agree in a register with a probability close to their Jaccard similarity.

1. Documents with equal sets (size and 128-bit fingerprint) form a class; only its smallest identifier goes on.
2. Registers are cut in bands; classes with equal values in a band share a bucket. In each bucket all are compared
   with its smallest member, which is one pair for each member and not one for each pair of members.
3. A pair is dropped if its sizes alone forbid the similarity, or if the joint likelihood of its registers (how many
   are larger, equal, smaller, given both sizes) falls short by more than DOUBT (four standard deviations) at every similarity that would do.
4. What is left is compared on whole shingle sets; those confirmed are links, and links make components.
5. Buckets that are not connected yet go on in blocks, dealt by a hash of the identifier and bounded by BLOCK members
   and BLOCK_SHINGLES shingles on average. A task gets two blocks of one bucket with whole shingle sets: it drops pairs
   by likelihood, takes exact intersections of the others, and reports only links that join components, so fewer rows
   than the blocks have members, however many pairs are alike or nearly alike. First the first block of each bucket
   meets all of its blocks, then the first GROWTH blocks, and so on, until every two blocks met or the bucket is
   connected; between rounds components are contracted, so that pairs inside one are not compared. A pair that shares
   several buckets is compared in the first band that it shares, and in no other.

A pair at exactly 0.85 misses all 26 bands of 5 registers with probability (1 - 0.85^5)^26 < 3e-7, one at
exactly 0.80, the bound of the pipeline, with probability below 4e-5.

Null or empty texts, or without words: size 0, linked with nothing. Rows that repeat a doc_id are one document and
stay or go together; a null doc_id has no component and is kept. Ties: the smallest doc_id stays. Texts may be of any
length: a set is 8 bytes a shingle, and a block holds one such set at least. Other columns stay as they are, whatever
their names. Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .hashing import WordHashes, mixed
from .shared import cut

BANDS, ROWS = 26, 5
REGISTERS = BANDS * ROWS
BASE, RATE, LIMIT = 1.001, 20.0, 65534
DOUBT = 8.0
#: Members and shingles of a block, on average; blocks in the first round and growth of their number; pairs at once.
BLOCK, BLOCK_SHINGLES, GROWTH, AT_ONCE = 256, 1 << 18, 16, 8192
#: Shingles that this many pairs of two blocks share, or more, are counted by matrix products, DENSE at once.
OFTEN, DENSE = 64, 4096

_RNG = np.random.default_rng(20240131)
_ODD = _RNG.integers(0, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _RNG.integers(0, 2**63, REGISTERS, dtype=np.uint64)


_hashes = WordHashes()


def shingle_set(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text, A-Z lowered."""
    found = (text or "").encode().lower().split()  # bytes: exactly the six ASCII spaces and exactly A-Z
    h = np.fromiter(map(_hashes.__getitem__, found), np.uint64, len(found))
    if not len(h):
        return h
    n = min(n, len(h))
    total = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
    return np.unique(total)


def _fingerprint(shingles: np.ndarray) -> int:
    """Half of the fingerprint of a set."""
    return int(mixed(shingles + np.uint64(1)).sum(dtype=np.uint64).astype(np.int64))


def registers(shingles: np.ndarray) -> np.ndarray:
    """The sketch of a set that is not empty."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        part = shingles[at : at + 2048, None]
        np.minimum(least, ((part ^ _FLIP) * _ODD).min(0), out=least)
    draws = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(draws) / np.log(BASE)), 0, LIMIT + 1).astype("<u2")


def sketch(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """doc_id, n_shingles, two halves of the fingerprint of the set, and the registers (null for an empty set)."""

    @F.pandas_udf("n_shingles long, f1 long, f2 long, registers binary")
    def sketched(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch:
                s = shingle_set(text, shingle)
                if len(s):
                    f1 = _fingerprint(s)
                    f2 = int(mixed(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64))
                    rows.append((len(s), f1, f2, registers(s).tobytes()))
                else:
                    rows.append((0, 0, 0, None))
            yield pd.DataFrame(rows, columns=["n_shingles", "f1", "f2", "registers"])

    return docs.select("doc_id", sketched("text").alias("s")).select("doc_id", "s.*")


def _agreement(x: np.ndarray) -> np.ndarray:
    """Probability that one register exceeds another, from the part of the union that only its set holds."""
    return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)


def likely(n_a: np.ndarray, n_b: np.ndarray, more: np.ndarray, less: np.ndarray, percent: int) -> np.ndarray:
    """Whether a similarity of percent / 100 or more is not ruled out, for pairs with sizes n_a and n_b.

    more, less: how many registers of a exceed those of b, and fall short of them; the rest are equal.
    """
    u = n_a / (n_a + n_b)
    v = 1 - u
    top = np.minimum(u / v, v / u)  # no similarity can exceed the ratio of the sizes
    grid = np.linspace(0, 1, 33)[None, :] * top[:, None]
    low = np.clip(percent / 100, 0, None)
    grid = np.concatenate([grid, np.minimum(low, top)[:, None]], 1)
    p, q = _agreement(u[:, None] - v[:, None] * grid), _agreement(v[:, None] - u[:, None] * grid)
    tiny = 1e-12
    equal = REGISTERS - more - less
    fit = (
        more[:, None] * np.log(np.maximum(p, tiny))
        + less[:, None] * np.log(np.maximum(q, tiny))
        + equal[:, None] * np.log(np.maximum(1 - p - q, tiny))
    )
    best = fit.max(1)
    good = np.where(grid >= low - 1e-9, fit, -np.inf).max(1)
    return (100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)) & (good >= best - DOUBT)


def plausible(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that the joint likelihood of their registers does not rule out."""
    side = lambda x: sketches.select(
        F.col("id").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("registers").alias(f"r_{x}")
    )

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            if len(x):
                a = np.frombuffer(b"".join(x.r_a), "<u2").reshape(-1, REGISTERS)
                b = np.frombuffer(b"".join(x.r_b), "<u2").reshape(-1, REGISTERS)
                ok = likely(
                    x.n_a.to_numpy(float), x.n_b.to_numpy(float), (a > b).sum(1), (a < b).sum(1), percent
                )
                yield x.loc[ok, ["a", "b"]]

    return pairs.join(side("b"), "b").join(side("a"), "a").mapInPandas(keep, "a long, b long")


def confirm(pairs: DataFrame, texts: DataFrame, percent: int, shingle: int) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets are similar enough. texts: id, text of all that stand in pairs."""

    def same(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, mine = None, None
        for x in batches:
            ok = []
            for a, one, other in zip(x.a, x.text_a, x.text_b, strict=True):
                if (a, one) != last:
                    last, mine = (a, one), shingle_set(one, shingle)
                theirs = shingle_set(other, shingle)
                both = len(np.intersect1d(mine, theirs, assume_unique=True))
                ok.append(100 * both >= percent * (len(mine) + len(theirs) - both))
            yield x.loc[np.array(ok, bool), ["a", "b"]]

    joined = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").join(
        texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a"
    )
    return joined.mapInPandas(same, "a long, b long")


def _ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def label(docs: DataFrame, percent: int = 80, shingle: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs (doc_id, text)."""
    drawn = cut(sketch(docs, shingle), "near-sketches")
    has = drawn.where("n_shingles > 0 and doc_id is not null")
    classes = has.groupBy("n_shingles", "f1", "f2").agg(
        F.min("doc_id").alias("id"), F.min_by("registers", "doc_id").alias("registers")
    )
    classes = cut(classes, "near-classes")
    slot = lambda i: F.xxhash64(F.lit(i), F.substring("registers", i * ROWS * 2 + 1, ROWS * 2))
    banded = classes.select(
        "id", "n_shingles", F.posexplode(F.array(*[slot(i) for i in range(BANDS)])).alias("band", "bucket")
    )
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES))
    sizes = banded.groupBy("bucket").agg(
        F.min("id").alias("hub"), F.count("*").alias("n"), blocks.cast("int").alias("blocks")
    ).where("n > 1")
    placed = cut(banded.drop("n_shingles").join(sizes, "bucket"), "near-buckets")

    known = classes.select("id", "f1", "n_shingles", "registers")
    first = cut(placed.where("id <> hub").select(*_ordered("hub", "id")).distinct(), "near-pairs")
    groups = components(_links(cut(plausible(first, known, percent), "near-likely"), docs, percent, shingle))
    since, until = 0, 1
    while True:
        # buckets that are not connected yet, and whose blocks have not all had their turn
        inside = placed.where((F.col("n") > 2) & (F.col("blocks") > since)).join(groups, "id", "left")
        inside = inside.withColumn("component", F.coalesce("component", "id"))
        apart = (
            inside.groupBy("bucket")
            .agg(F.min("component").alias("_min"), F.max("component").alias("_max"))
            .where("_min < _max")
            .select("bucket")
        )
        open_ = cut(inside.join(apart, "bucket").select("bucket", "band", "blocks", "id", "component"), "near-open")
        if open_.isEmpty():
            break
        sets = _sets(docs, open_, shingle).join(known, ["id", "f1"])
        found = cut(_in_blocks(open_, sets, since, until, percent), "near-joined")
        groups = _contracted(groups, found)
        since, until = until, until * GROWTH

    of = has.join(classes.select("n_shingles", "f1", "f2", "id"), ["n_shingles", "f1", "f2"]).join(groups, "id", "left")
    found = of.groupBy("doc_id").agg(F.min(F.coalesce("component", "id")).alias("component_id"))
    out = drawn.select("doc_id", "n_shingles").join(found, "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def _contracted(groups: DataFrame, found: DataFrame) -> DataFrame:
    """groups (id, component) after links (a, b) between components were found."""
    if found.isEmpty():
        return groups
    merged = components(found)
    heads = merged.select(F.col("id").alias("component"), F.col("component").alias("_head"))
    old = groups.join(heads, "component", "left").select("id", F.coalesce("_head", "component").alias("component"))
    # documents that stood alone so far
    return cut(old.union(merged.join(groups, "id", "left_anti").select("id", "component")), "near-groups")


def _sets(docs: DataFrame, open_: DataFrame, shingle: int) -> DataFrame:
    """id, f1, shingles (sorted, 8 bytes each) of the documents that stand in open buckets."""

    @F.pandas_udf("f1 long, shingles binary")
    def packed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            sets = [shingle_set(t, shingle) for t in texts]
            yield pd.DataFrame({"f1": [_fingerprint(s) for s in sets], "shingles": [s.tobytes() for s in sets]})

    texts = docs.select(F.col("doc_id").alias("id"), "text").join(open_.select("id").distinct(), "id", "left_semi")
    # a repeated doc_id has each of its sets once
    return texts.select("id", packed("text").alias("s")).select("id", "s.*").dropDuplicates(["id", "f1"])


def shared_counts(one: list[np.ndarray], other: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of one list has in common with each set of another."""
    out = np.zeros((len(one), len(other)), np.int64)
    sides = [np.concatenate([x, np.zeros(0, np.uint64)]) for x in (np.concatenate(one), np.concatenate(other))]
    owner = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (one, other)]
    both = np.intersect1d(*[np.unique(x) for x in sides], assume_unique=True)
    if not len(both):
        return out
    entries = []
    for values, who in zip(sides, owner, strict=True):
        at = np.minimum(np.searchsorted(both, values), len(both) - 1)
        hit = both[at] == values
        at, who = at[hit], who[hit]
        order = np.argsort(at, kind="stable")
        entries.append((at[order], who[order]))
    (at_a, a), (at_b, b) = entries
    n_a, n_b = np.bincount(at_a, minlength=len(both)), np.bincount(at_b, minlength=len(both))
    often = n_a * n_b >= OFTEN
    # rare shingles: every pair that shares one, spelled out; fewer than OFTEN for each shingle
    rare = ~often[at_a]
    reps = n_b[at_a[rare]]
    start = (np.cumsum(n_b) - n_b)[at_a[rare]]
    j = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps) + np.repeat(start, reps)
    cells = np.repeat(a[rare], reps) * len(other) + b[j]
    out += np.bincount(cells, minlength=out.size).reshape(out.shape)
    # shingles that many share: products of 0/1 matrices, exact in float32 below 2^24 columns
    number = np.cumsum(often) - 1
    for low in range(0, int(often.sum()), DENSE):
        halves = []
        for at, who, rows in ((at_a, a, len(one)), (at_b, b, len(other))):
            use = often[at] & (number[at] >= low) & (number[at] < low + DENSE)
            m = np.zeros((rows, DENSE), np.float32)
            m[who[use], number[at[use]] - low] = 1
            halves.append(m)
        out += (halves[0] @ halves[1].T).astype(np.int64)
    return out


def _spanning(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, int]]:
    """Of links (a, b) those that join what the links before them did not."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            root[x] = root.get(root[x], root[x])
            x = root[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
            yield x, y


def _joining(h: dict, m: dict, same: bool, band: int, percent: int) -> list[tuple[int, int]]:
    """Links (component, component) between the members h and m of two blocks of a bucket, spanning ones only."""
    wanted = h["component"][:, None] != m["component"][None, :]
    if same:
        wanted &= h["id"][:, None] < m["id"][None, :]
    n_h, n_m = h["n_shingles"][:, None], m["n_shingles"][None, :]
    wanted &= 100 * np.minimum(n_h, n_m) >= percent * np.maximum(n_h, n_m)
    i, j = np.nonzero(wanted)
    kept = []
    for at in range(0, len(i), AT_ONCE):
        p, q = i[at : at + AT_ONCE], j[at : at + AT_ONCE]
        r, t = h["registers"][p], m["registers"][q]
        agree = (r == t).reshape(-1, BANDS, ROWS).all(2).argmax(1) == band
        p, q, r, t = p[agree], q[agree], r[agree], t[agree]
        sizes = h["n_shingles"][p].astype(float), m["n_shingles"][q].astype(float)
        ok = likely(*sizes, (r > t).sum(1), (r < t).sum(1), percent)
        kept.append((p[ok], q[ok]))
    if not sum(len(p) for p, _ in kept):
        return []
    p, q = (np.concatenate(x) for x in zip(*kept, strict=True))
    rows, p_at = np.unique(p, return_inverse=True)
    columns, q_at = np.unique(q, return_inverse=True)
    both = shared_counts([h["shingles"][x] for x in rows], [m["shingles"][x] for x in columns])[p_at, q_at]
    ok = 100 * both >= percent * (h["n_shingles"][p] + m["n_shingles"][q] - both)
    return [*_spanning(h["component"][p[ok]], m["component"][q[ok]])]


def _in_blocks(open_: DataFrame, sets: DataFrame, since: int, until: int, percent: int) -> DataFrame:
    """Links (a, b) between components of open buckets, from pairs of blocks, one of them since-th to until-th.

    Both halves of a pair of blocks are dealt by bucket and both numbers, so that a large bucket meets in many tasks.
    """
    member = F.struct("id", "component", "n_shingles", "registers", "shingles")
    spread = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    blocks = (
        open_.withColumn("block", F.floor(spread * F.col("blocks") / (1 << 30)).cast("int"))
        .join(sets, "id")
        .groupBy("bucket", "band", "blocks", "block")
        .agg(F.collect_list(member).alias("members"))
    )
    turn = (F.col("block") >= since) & (F.col("block") < until)
    heads = blocks.where(turn).select(
        "bucket", F.col("block").alias("lo"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("hi"), F.col("members").alias("heads")
    )
    last = F.least(F.col("block"), F.lit(until - 1))
    others = blocks.where(F.col("block") >= since).select(
        "bucket", "band", F.explode(F.sequence(F.lit(since), last)).alias("lo"), F.col("block").alias("hi"), "members"
    )
    pairs = others.join(heads, ["bucket", "lo", "hi"]).select("band", "lo", "hi", "heads", "members")

    def table(of: pa.Array) -> dict:
        rows = of.flatten()
        column = lambda c: rows.field(c).to_numpy(zero_copy_only=False)
        out = {c: column(c).astype(np.int64) for c in ("id", "component", "n_shingles")}
        out["registers"] = np.frombuffer(b"".join(column("registers")), "<u2").reshape(-1, REGISTERS)
        out["shingles"] = [np.frombuffer(x, np.uint64) for x in column("shingles")]
        return out

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                of = {c: one.column(c) for c in ("band", "lo", "hi", "heads", "members")}
                links = _joining(
                    table(of["heads"]), table(of["members"]), of["lo"][0] == of["hi"][0], of["band"][0].as_py(), percent
                )
                if links:
                    a, b = zip(*links, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return pairs.mapInArrow(met, "a long, b long")


def _links(pairs: DataFrame, docs: DataFrame, percent: int, shingle: int) -> DataFrame:
    """The pairs whose texts are similar enough."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = cut(docs.select(F.col("doc_id").alias("id"), "text").join(wanted, "id", "left_semi"), "near-texts")
    return cut(confirm(pairs, texts, percent, shingle), "near-links")


def keep_one(docs: DataFrame, percent: int = 80, shingle: int = 5) -> DataFrame:
    """docs with one document of each group of near copies, that of the smallest doc_id."""
    dropped = label(docs.select("doc_id", "text"), percent, shingle).where("not kept").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])

"""License scans (operator 9), in DataFrame functions only.

Texts and templates are reduced to lower-case words of letters and digits. Windows of WIDTH words, one every STEP, cover
a text so that each stretch of WIDTH - STEP + 1 words lies whole in one; templates longer than that are cut in pieces.
A window and a piece are sets of SHINGLE-word shingles.

1. BANDS bands of one MinHash value each retrieve the templates that a window may hold a piece of: every band value of
   a window is looked up in a hash table of the values of all pieces. A piece of n words that lies whole in a window has
   a Jaccard similarity of at least s = (n - 2) / (WIDTH - 2), so it is missed with a probability of (1 - s)^BANDS:
   4e-8 at five words, the least that a template may have, and less at more. A band value is the hash of one shingle, so
   windows without a shingle of any template cannot collide; a bit map finds that before they are sketched.
2. Each retrieved template is verified exactly: it is reported where one stretch of the text, at most 1 / CONTAINMENT
   times as long as the template, holds at least CONTAINMENT of its shingles. Words of a template that stand scattered
   over a text are not a license.

The library of templates is a parameter. It goes into the plan as literals of bounded size; a larger one is dealt in
parts of PART words, each a further pass over the windows of a row, so their number has no cap. Windows are made and
verified in the row of their text, so no text moves and no key gathers rows.

Null or empty text: nothing found. Ties: of several stretches the first counts. Repeated rows: each is scanned. Texts of
any length; the work is linear in a text, and in its matches times the length of a template. Empty table: no rows.
Columns of the input stay, whatever their names, but for the one that this operator adds.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_texts import TEMPLATES
from .shared import aside, back, bind

WIDTH, STEP, SHINGLE = 12, 4, 3
BANDS = 48
CONTAINMENT = 0.8
LEAST_WORDS = 5
_PIECE = WIDTH - STEP + 1
#: Words of templates in one part of the library, and bits of the map of its shingles.
PART, BITS = 20_000, 1 << 20
_HIT = "array<struct<word:int,name:string>>"


def tokens(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def _shingles(words: list[str]) -> list[str]:
    return list(dict.fromkeys(" ".join(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)))


def _parts(templates) -> list[list[tuple[str, list[str]]]]:
    """The templates as words, in parts of about PART words."""
    out, size = [[]], 0
    for name, text in templates:
        words = tokens(text)
        if len(words) < LEAST_WORDS:
            raise ValueError(f"a template has {LEAST_WORDS} words or more")
        if out[-1] and size + len(words) > PART:
            out.append([])
            size = 0
        out[-1].append((name, words))
        size += len(words)
    return [p for p in out if p]


def _hash_of(words: Column, i: Column) -> Column:
    return F.xxhash64(*[F.get(words, i + k) for k in range(SHINGLE)])


def _sketch(hashes: Column) -> Column:
    """One MinHash value for each band."""
    least = lambda b: F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, b)))
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, least(b)))


class _Library:
    """One part of the templates as literal columns: bits, slots (band value -> templates) and the templates."""

    def __init__(self, spark: SparkSession, templates: list[tuple[str, list[str]]]):
        pieces = []
        for t, (_, words) in enumerate(templates):
            starts = [*range(0, len(words) - _PIECE, _PIECE - SHINGLE + 1), max(0, len(words) - _PIECE)]
            pieces += [(t, words[s : s + _PIECE]) for s in dict.fromkeys(starts)]
        # hashes of the library alone, by the functions that hash the texts
        split = lambda c: F.transform(F.col(c), lambda s: F.xxhash64(*[F.get(F.split(s, " "), F.lit(k)) for k in range(SHINGLE)]))
        rows = [(t, _shingles(words)) for t, words in pieces]
        sketched = spark.createDataFrame(rows, "t int, s array<string>").select("t", _sketch(split("s")).alias("v")).collect()
        whole = spark.createDataFrame([(t, _shingles(words)) for t, (_, words) in enumerate(templates)], "t int, s array<string>")
        hashed = {r.t: r.h for r in whole.select("t", split("s").alias("h")).collect()}
        bits = [0] * (BITS // 64)
        for h in {h for hs in hashed.values() for h in hs}:
            at = h % BITS
            bits[at // 64] |= 1 << at % 64
        values = {(v, r.t) for r in sketched for v in r.v}
        self.size = 1 << max(4, len(values).bit_length())
        slots = [[] for _ in range(self.size)]
        for v, t in sorted(values):
            slots[v % self.size].append({"v": v, "t": t})
        literal = lambda value, kind: F.from_json(F.lit(json.dumps(value)), kind)  # noqa: E731  folded once, when planned
        self.bits = literal([b - (1 << 64) if b >> 63 else b for b in bits], "array<bigint>")
        self.slots = literal(slots, "array<array<struct<v:bigint,t:int>>>")
        self.templates = literal(
            [{"name": name, "reach": math.ceil(len(words) / CONTAINMENT), "h": hashed[t]} for t, (name, words) in enumerate(templates)],
            "array<struct<name:string,reach:int,h:array<bigint>>>",
        )

    def known(self, h: Column) -> Column:
        at = F.pmod(h, F.lit(BITS))
        word = F.get(self.bits, F.floor(at / 64).cast("int"))
        return F.call_function("shiftrightunsigned", word, (at % 64).cast("int")).bitwiseAND(F.lit(1)) == 1

    def retrieved(self, windows: Column) -> Column:
        """The templates that share a band value with one of the windows."""
        slot = lambda v: F.get(self.slots, F.pmod(v, F.lit(self.size)).cast("int"))
        of = lambda v: F.transform(F.filter(slot(v), lambda x: x["v"] == v), lambda x: x["t"])
        return F.array_sort(F.array_distinct(F.flatten(F.transform(F.flatten(F.transform(windows, _sketch)), of))))


def _found(h: Column, library: _Library) -> Column:
    """(word, name) of the templates of one part that a text, given as its shingle hashes in order, holds."""
    on = F.filter(F.transform(h, lambda x, i: F.when(library.known(x), F.struct(i.alias("i"), x.alias("h")))), lambda x: x.isNotNull())

    def windows(marks: Column) -> Column:
        """Distinct hashes of the windows that hold a shingle of some template."""
        low = lambda i: F.floor(F.greatest(i - (WIDTH - SHINGLE) + STEP - 1, F.lit(0)) / STEP) * STEP
        starts = F.array_distinct(
            F.flatten(F.transform(marks, lambda x: F.sequence(low(x["i"]), F.floor(x["i"] / STEP) * STEP, F.lit(STEP).cast("long"))))
        )
        return F.transform(starts, lambda s: F.array_distinct(F.slice(h, s.cast("int") + 1, WIDTH - SHINGLE + 1)))

    def verified(marks: Column, t: Column) -> Column:
        def judged(template: Column) -> Column:
            hits = F.filter(marks, lambda x: F.array_contains(template["h"], x["h"]))
            need = F.lit(CONTAINMENT) * F.size(template["h"])
            distinct = lambda xs: F.size(F.array_distinct(F.transform(xs, lambda x: x["h"])))

            def first(own: Column) -> Column:
                near = lambda x, j: F.filter(
                    F.slice(own, j + 1, template["reach"]), lambda y: y["i"] <= x["i"] + template["reach"] - SHINGLE
                )
                starts = F.filter(F.transform(own, lambda x, j: F.when(distinct(near(x, j)) >= need, x["i"])), lambda i: i.isNotNull())
                return F.when(distinct(own) >= need, F.array_min(starts))

            return bind(bind(hits, first), lambda i: F.when(i.isNotNull(), F.struct(i.cast("int").alias("word"), template["name"].alias("name"))))

        return bind(F.get(library.templates, t), judged)

    def of(marks: Column) -> Column:
        retrieved = bind(windows(marks), library.retrieved)
        checked = F.filter(F.transform(retrieved, lambda t: verified(marks, t)), lambda x: x.isNotNull())
        return F.when(F.size(marks) > 0, checked.cast(_HIT)).otherwise(F.array().cast(_HIT))

    return bind(on, of)


def scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """docs with `licenses`: array of (word, name), the first word of the first stretch that verifies it, sorted."""
    spark = docs.sparkSession
    libraries = [_Library(spark, part) for part in _parts(templates)]
    clean = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col("text"), F.lit(""))), "[^a-z0-9]+", " "))
    hashes = lambda w: F.when(
        F.size(w) >= SHINGLE, F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: _hash_of(w, i))
    ).otherwise(F.array().cast("array<bigint>"))
    every = lambda h: F.sort_array(F.concat(*[_found(h, library) for library in libraries])) if libraries else F.array().cast(_HIT)
    rows = aside(docs, "text").select("_doc", bind(F.split(clean, " "), hashes).alias("_h"))
    return back(rows, docs, licenses=every(F.col("_h")))

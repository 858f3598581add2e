"""Personal data, by patterns and by what the corpus discloses (operator 7).

Patterns find e-mail addresses, IP addresses, payment cards and phone numbers: the protected entities. Other words can
give an entity away: where most texts that hold a word hold one entity, reading the word tells the entity. The corpus
measures that:

1. Candidates: every word of a text that holds an entity, however far from it, as long as it can still disclose one: an
   entity that H texts hold is disclosed by no word of more than H / GENERALISE texts. Such words go before pairs form,
   first by the texts with entities alone, then by all texts.
2. For candidates, how many different texts hold the word anywhere, and how many of those hold the entity as well.
3. disclosure = P(entity | word), and bits = log2 P(entity | word) / P(entity), over different texts. A word of at least
   MIN_BITS bits is generalised from GENERALISE on and removed from REMOVE on, wherever it stands.
4. A pair counts if the lower bound of Wilson's interval for disclosure, one-sided with Z, is at least CONFIDENT. Its
   successes are texts with both, but no more than the different contexts (CONTEXT words before and behind) in which
   those texts hold the entity, so copies with small changes elsewhere are one success; its failures are texts with the
   word alone. Two successes without a failure are enough (0.55), one is not (0.38).

A word inside an entity is no evidence about it, but its text counts as one that holds the word.

Words that step 2 need not look at are passed over by a bit map of BITS bits, of the same size for any corpus; a full
map only lets more words through to the exact join. Counts and joins are keyed by a hash of the text, so that rows
that repeat, or that have no doc_id, need no special care: equal texts have equal spans.

Null or empty text: no spans. Ties: of words that disclose several entities the highest disclosure counts. Texts of any
length: what moves is words and hashes, never texts but to their own spans. Empty table: no rows. Columns of the input
stay, whatever their names, but for the one that this operator adds.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import WordHashes
from .shared import aside, back, cut

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "generalise", "remove")
MARKS = {k: f"[{k.upper()}]" for k in BASE_KINDS} | {"generalise": "[RELATED]", "remove": ""}

CONTEXT = 6
CONFIDENT, Z = 0.5, 1.2816
MIN_BITS = 3.0
GENERALISE, REMOVE = 0.8, 0.95
BITS = 1 << 22

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A run of digits that fails from its first digit fails from all others, so none of those is tried.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W\d_]{3,}")
_hashes = WordHashes()


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ with a domain behind it, from the start of the local part; linear in the text."""
    done, q = 0, text.find("@")
    while q >= 0:
        start = q
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, q + 1) if start < q else None
        if m:
            done = m.end()
            yield start, done
        else:
            done = q + 1
        q = text.find("@", max(done, q + 1))


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns; kind is a place in BASE_KINDS."""
    out = [(s, 0, e) for s, e in _emails(text)]
    if text.count(".") >= 3:
        for m in _IP.finditer(text):
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
                out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _digits(m[0])
            if 14 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def _entity(text: str, span: tuple[int, int, int]) -> str:
    value = text[span[0] : span[2]]
    return f"{span[1]}:{value.lower() if span[1] < 2 else _digits(value)}"


def _key() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


SEEN = "key long, entity long, context long, term string, bit long"


def evidence(docs: DataFrame) -> DataFrame:
    """For texts that hold an entity: rows (key, entity, context) of their entities, rows (key, term, bit) of their words."""

    def held(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rows = []
            for key, text in zip(x["key"], x["text"], strict=True):
                text = text or ""
                spans = base_spans(text)
                if not spans:
                    continue
                plain = list(text)
                for s, _, e in spans:  # an entity is no evidence about another
                    plain[s:e] = " " * (e - s)
                found = [(m.start(), m[0].lower()) for m in _TERM.finditer("".join(plain))]
                starts = [at for at, _ in found]
                held_here = set()
                for span in spans:
                    at = bisect_left(starts, span[0])  # no word begins inside an entity
                    near = " ".join(w for _, w in found[max(0, at - CONTEXT) : at + CONTEXT])
                    held_here.add((_signed(hash_of(_entity(text, span))), _signed(hash_of(near))))
                rows += [(key, entity, context, None, None) for entity, context in held_here]
                rows += [(key, None, None, w, hash_of(w) % BITS) for w in {w for _, w in found}]
            out = pd.DataFrame(rows, columns=["key", "entity", "context", "term", "bit"], dtype=object)
            yield out.astype({"key": "int64", "entity": "Int64", "context": "Int64", "bit": "Int64"})

    return docs.select(_key().alias("key"), "text").mapInPandas(held, SEEN).distinct()


def hash_of(word: str) -> int:
    return _hashes[word.encode()]


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _bit_map(candidates: DataFrame) -> np.ndarray:
    """The BITS / 8 bytes of the bit map of the candidates; its size does not depend on their number."""
    page = 32768
    rows = (
        candidates.groupBy(F.floor(F.col("bit") / page).alias("page"))
        .agg(F.bitmap_construct_agg(F.col("bit") % page).alias("bits"))
        .collect()
    )
    out = np.zeros(BITS // 8, np.uint8)
    for r in rows:
        out[r["page"] * page // 8 :][: page // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def postings(docs: DataFrame, candidates: DataFrame) -> DataFrame:
    """term, key for each candidate term, and for terms that share its bit, and each text that holds it."""
    shared = docs.sparkSession.sparkContext.broadcast(_bit_map(candidates).tobytes())

    def held(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.frombuffer(shared.value, np.uint8)
        for x in batches:
            terms, keys = [], []
            for key, text in zip(x["key"], x["text"], strict=True):
                words = list({w.lower() for w in _TERM.findall(text or "")})
                h = np.fromiter(map(hash_of, words), np.uint64, len(words)) % np.uint64(BITS)
                on = np.nonzero(bits[h >> np.uint64(3)] >> (h & np.uint64(7)).astype(np.uint8) & 1)[0]
                terms += [words[i] for i in on]
                keys += [key] * len(on)
            yield pd.DataFrame({"term": pd.Series(terms, dtype=object), "key": np.array(keys, np.int64)})

    return docs.select(_key().alias("key"), "text").mapInPandas(held, "term string, key long").distinct()


def _lower(successes: Column, failures: Column) -> Column:
    """The lower bound of Wilson's interval for successes / (successes + failures)."""
    n = (successes + failures).cast("double")
    p, zz = successes / n, Z * Z
    return (p + zz / (2 * n) - Z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))) / (1 + zz / n)


def disclosing(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(term, disclosure, bits) of the words that give an entity away, and their postings (term, key)."""
    seen = cut(evidence(docs), "pii-evidence")
    entities = seen.where("entity is not null").select("entity", "context", "key")
    enough = lambda successes: _lower(successes, F.lit(0)) >= CONFIDENT
    of_entity = entities.groupBy("entity").agg(F.count_distinct("key").alias("holders"), F.count_distinct("context").alias("_contexts"))
    of_entity = of_entity.where(enough(F.least("holders", "_contexts"))).drop("_contexts")
    holding = cut(entities.join(of_entity, "entity"), "pii-holding")
    most = holding.groupBy("key").agg(F.max("holders").alias("most"))
    near = cut(seen.where("term is not null").select("term", "bit", "key").join(most, "key"), "pii-near")
    # a word stands in at least the texts that hold it beside some entity: where those are too many, so are all
    beside = near.groupBy("term", "bit").agg(F.count("*").alias("_near"), F.max("most").alias("most"))
    candidates = cut(beside.where(enough(F.col("_near")) & (F.col("most") >= GENERALISE * F.col("_near"))).drop("_near"), "pii-open")
    held = cut(postings(docs, candidates), "pii-postings")
    of_term = held.groupBy("term").agg(F.count("*").alias("texts")).join(candidates, "term")
    of_term = of_term.where(F.col("most") >= GENERALISE * F.col("texts")).select("term", "texts")
    # no more texts can hold both than hold the entity
    pairs = near.select("term", "key").join(of_term, "term").join(holding, "key").where(F.col("holders") >= GENERALISE * F.col("texts"))
    together = pairs.groupBy("entity", "term").agg(
        F.count_distinct("key").alias("together"), F.count_distinct("context").alias("contexts"),
        F.first("texts").alias("texts"), F.first("holders").alias("holders"),
    )
    total = docs.select(_key().alias("key")).distinct().agg(F.count("*").alias("total"))
    failures = F.col("texts") - F.col("together")
    measured = (
        together.join(F.broadcast(total))  # one row
        .where(_lower(F.least("contexts", "together"), failures) >= CONFIDENT)
        .withColumn("disclosure", F.col("together") / F.col("texts"))
        .withColumn("bits", F.log2(F.col("disclosure") * F.col("total") / F.col("holders")))
        .where((F.col("disclosure") >= GENERALISE) & (F.col("bits") >= MIN_BITS))
    )
    terms = cut(measured.groupBy("term").agg(F.max("disclosure").alias("disclosure"), F.max("bits").alias("bits")), "pii-terms")
    return terms, held


def find(docs: DataFrame) -> DataFrame:
    """docs with `found`: array of (s, k, e, kind), code points, by start and then by kind in the order of KINDS."""
    terms, held = disclosing(docs.select("text"))
    by_text = cut(
        held.join(terms, "term")
        .groupBy("key")
        .agg(F.collect_list(F.struct("term", (F.col("disclosure") >= REMOVE).alias("out"))).alias("terms")),
        "pii-by-text",
    )

    @F.pandas_udf("array<struct<s:long,k:int,e:long,kind:string>>")
    def spans_of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, terms_of in batches:
            out = []
            for text, listed_terms in zip(texts, terms_of, strict=True):
                text = text or ""
                spans = base_spans(text)
                if listed_terms is not None:
                    kind = {t["term"]: 4 + bool(t["out"]) for t in listed_terms}
                    words = ((m, kind.get(m[0].lower())) for m in _TERM.finditer(text))
                    spans = sorted(spans + [(m.start(), k, m.end()) for m, k in words if k])
                out.append([{"s": s, "k": k, "e": e, "kind": KINDS[k]} for s, k, e in spans])
            yield pd.Series(out, dtype=object)

    rows = aside(docs, "text", _key().alias("_key"))
    joined = rows.join(by_text.select(F.col("key").alias("_key"), F.col("terms").alias("_terms")), "_key", "left")
    return back(joined, docs, found=spans_of("text", "_terms"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def base(spans: Column) -> Column:
    return F.filter(spans, lambda x: x["k"] < len(BASE_KINDS))


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with personal data replaced by marks, and the words that disclose it generalised or removed."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for text, spans in zip(texts, found, strict=True):
            if text is None or not len(spans):
                out.append(text)
                continue
            parts, at = [], 0
            for x in spans:
                if x["e"] > at:
                    if x["s"] >= at:
                        parts += [text[at : x["s"]], MARKS[x["kind"]]]
                    at = x["e"]
            out.append("".join([*parts, text[at:]]))
        return pd.Series(out, dtype=object)

    found = find(aside(docs, "text"))
    return back(found, docs, text=clean("text", "found")).select(*[F.col(f"`{c}`") for c in docs.columns])

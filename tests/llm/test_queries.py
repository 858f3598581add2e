"""The registered queries, all columns, against plain-Python versions of what they promise, on odd rows."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import pytest
import tiktoken

from broadsheet.llm import pii, queries

from .test_operators import BASE, quality_base, secret_spans

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
OPAQUE = "Ab3dEf6hIj9lMn2pQr5tUv8x"


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def given():
    rng = random.Random(77)
    word = lambda: f"w{rng.randrange(900)}"
    some = lambda n: " ".join(word() for _ in range(n))
    out = [some(rng.randrange(1, 140)) for _ in range(60)]
    out += [f"{some(60)} {rng.choice(['user=robert', 'password: hunter22x', 'AKIA' + 'A1B2C3D4' * 2, OPAQUE, 'https://h.example/a', '0123456789abcdef01234567'])} "
            f"{'z ' * rng.randrange(0, 300)} {rng.choice(['login: bob99', OPAQUE, 'token=abcdef', 'x'])} {some(30)}" for _ in range(40)]
    out += [f"{some(4)} kestrel {some(2)} ann@x.example.org 10.0.0.{i} {some(60)}" for i in range(9)]
    out += [f"{some(9)} +1 (555) 010-{i:04d} 4111 1111 1111 1111 999.1.1.1 {some(50)}" for i in range(5)]
    out += [None, "", " \n\t", "é😀 " * 70 + "password=abcdef1", "x" * 9000, "line one two\n" * 30 + some(60), some(5000), "Ünï " + "日本語テキスト" * 400]
    out += ["#$% " * 40 + some(60), out[3], out[3]]
    return out


def rows():
    texts = given()
    out = [(i, t, "en" if i % 3 else "de", None if i % 11 == 0 else f"src{i % 4}", None) for i, t in enumerate(texts)]
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("docs"))
    spark.createDataFrame(rows(), SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    return at


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("none"))
    spark.createDataFrame([], SCHEMA).write.parquet(f"{at}/documents.parquet")
    return at


def run(spark, name, folder):
    return {r.doc_id: r.asDict() for r in queries.QUERIES[name](spark, folder).collect()}


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_empty_tables_give_no_rows(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).count() == 0


def digest(spans, kinds):
    return ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in spans)


PARTS = {
    "opaque": r"[A-Za-z0-9+/_-]{24,}={0,2}",
    "login": r"""(?i:\b(?:user(?:_?name)?|login|account|client_?id|access_?key_?id))["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}""",
    "endpoint": r"""(?i:\b(?:https?|ftp|postgres(?:ql)?|mysql|mongodb|redis|amqp)://)[^\s"'<>]{4,}""",
}


def linked(text, base, scope=512):
    """Weak parts whose start is at most `scope` from the start of a complementary part."""
    of = {kind: [(m.start(), m.end(), m[0]) for m in re.finditer(p, text, re.A)] for kind, p in PARTS.items()}
    of["opaque"] = [x for x in of["opaque"] if all(re.search(c, x[2]) for c in ("[A-Z]", "[a-z]", "[0-9]"))]
    at = lambda kinds: [s for k in kinds for s, *_ in of.get(k, ())] + [s for s, k, _ in base if list(BASE)[k] in kinds]
    partners = {"opaque": at(["access", "login", "endpoint"])} | dict.fromkeys(["login", "endpoint"], at(["assign", "hex", "opaque"]))
    kinds = [*BASE, *PARTS]
    return [(s, kinds.index(k), e) for k, xs in of.items() for s, e, _ in xs if any(abs(s - p) <= scope for p in partners[k])]


def test_secrets(spark, folder):
    got = run(spark, "op3_secret_scans", folder)
    kinds = [*BASE, *PARTS]
    some = 0
    for i, text, *_ in rows():
        base = secret_spans(text)
        every = sorted(base + linked(text or "", base))
        some += len(every) > len(base)
        want = {"doc_id": i, "base_sha256": sha(digest(base, kinds)), "spans": digest(every, kinds)}
        want |= {f"n_{k}": sum(x[1] == n for x in base) for n, k in enumerate(BASE)}
        assert got[i] == want, text
    assert some > 5


def test_scopes_go_by_distance_alone(spark, tmp_path):
    texts = [" " * at + "user=robert" + " " * (gap - 11) + OPAQUE for at in (0, 255, 300, 1000, 5119) for gap in (257, 300, 511, 512, 513)]
    spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = run(spark, "op3_secret_scans", str(tmp_path))
    assert [bool(got[i]["spans"]) for i in range(len(texts))] == [True, True, True, True, False] * 5


def test_bpe(spark, folder):
    ranks, pattern = queries.vocabulary()
    encoding = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    got = run(spark, "op4_byte_bpe", folder)
    for i, text, *_ in rows():
        ids = encoding.encode_ordinary(text or "")
        want = {"doc_id": i, "n_tokens": len(ids), "ids_sha256": sha(struct.pack(f"<{len(ids)}I", *ids)), "decoded_sha256": sha(text or "")}
        assert got[i] == want


def test_quality(spark, folder):
    got = run(spark, "op5_quality_rules", folder)
    for i, text, *_ in rows():
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
        assert tuple(got[i][n] for n in names) == quality_base(text)
        assert got[i]["kept"] is False if got[i]["base_failed"] else got[i]["kept"] in (True, False)


def blocks(all_texts, length=100):
    seen = set()
    for t in all_texts:
        b = (t or "").encode()
        gone = set()
        for i in range(len(b) - length + 1):
            if b[i : i + length] in seen:
                gone.update(range(i, i + length))
            seen.add(b[i : i + length])
        yield b, gone


def test_suffixes(spark, folder):
    got = run(spark, "op6_suffix_dedup", folder)
    for i, (b, gone) in enumerate(blocks(t for _, t, *_ in rows())):
        kept = bytes(x for k, x in enumerate(b) if k not in gone)
        spans = sum(k - 1 not in gone for k in gone)
        assert got[i] == {"doc_id": i, "n_bytes": len(b), "n_removed": len(gone), "n_spans": spans, "kept_sha256": sha(kept)}


def luhn(digits):
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else (d * 2 if d < 5 else d * 2 - 9)
    return total % 10 == 0


def personal(text):
    text, out = text or "", []
    only = lambda s: re.sub("[^0-9]", "", s)
    tests = (
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(only(s)) <= 19 and luhn(only(s))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(only(s)) <= 15),
    )
    for k, (pattern, good) in enumerate(tests):
        out += [(m.start(), k, m.end()) for m in re.finditer(pattern, text) if good(m[0])]
    return sorted(out)


def disclosed(texts):
    """term -> disclosure, counted text by text in plain sets."""
    texts = {t or "" for t in texts}
    contexts, both, holding, where = defaultdict(set), defaultdict(set), defaultdict(set), defaultdict(set)
    for t in texts:
        spans = personal(t)
        plain = list(t)
        for s, _, e in spans:
            plain[s:e] = " " * (e - s)
        words = [(m.start(), m[0].lower()) for m in re.finditer(r"[^\W\d_]{3,}", "".join(plain))]
        for m in re.finditer(r"[^\W\d_]{3,}", t):
            where[m[0].lower()].add(t)
        for s, k, e in spans:
            entity = k, t[s:e].lower() if k < 2 else re.sub("[^0-9]", "", t[s:e])
            holding[entity].add(t)
            before, after = [w for at, w in words if at < s][-6:], [w for at, w in words if at >= e][:6]
            for _, w in words:
                contexts[entity, w].add(" ".join(before + after))
                both[entity, w].add(t)
    out = {}
    lower = lambda good, bad: (
        (p := good / (good + bad)) + (z := 1.2816**2) / (2 * (n := good + bad)) - 1.2816 * (p * (1 - p) / n + z / (4 * n * n)) ** 0.5
    ) / (1 + z / n)
    for (entity, w), seen in contexts.items():
        together = len(both[entity, w])
        share = together / len(where[w]) if where[w] else 0
        if together == 0 or share < 0.8 or lower(min(len(seen), together), len(where[w]) - together) < 0.5:
            continue
        if share * len(texts) / len(holding[entity]) >= 2**3.0:
            out[w] = max(out.get(w, 0), share)
    return out


def test_personal_data(spark, folder):
    got = run(spark, "op7_pii", folder)
    terms = disclosed(t for _, t, *_ in rows())
    assert "kestrel" in terms or terms == {}
    for i, text, *_ in rows():
        base = personal(text)
        words = [(m.start(), 5 if terms[m[0].lower()] >= 0.95 else 4, m.end()) for m in re.finditer(r"[^\W\d_]{3,}", text or "") if m[0].lower() in terms]
        want = {"doc_id": i, "base_sha256": sha(digest(base, pii.KINDS)), "spans": digest(sorted(base + words), pii.KINDS)}
        want |= {f"n_{k}": sum(x[1] == n for x in base) for n, k in enumerate(pii.BASE_KINDS)}
        assert got[i] == want, text


def test_words_are_never_cut_for_context(spark, tmp_path):
    texts = [f"kestrelbird{' ' * 152}ann@x.example.org {i} b{'c' * i}d" for i in range(1, 6)] + [f"plain words here {i}" for i in range(60)]
    spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    docs = queries.documents(spark, str(tmp_path)).select("text")
    assert {r.term for r in pii.evidence(docs).collect()} & {"kestrelbird", "trelbird"} == {"kestrelbird"}


def test_media(spark, folder):
    got = run(spark, "op8_media_columns", folder)
    for i, text, *_ in rows():
        raw = (text or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        want = {"n_bytes": len(raw), "payload_bytes": len(payload), "payload_sha256": sha(payload), "tail_crc32": zlib.crc32(payload[-32:])}
        assert {c: got[i][c] for c in want} == want
        assert got[i]["feature"].startswith("image/png;") and got[i]["media_bytes"] > 0
    assert len({tuple(v for k, v in got[i].items() if k != "doc_id") for i in (3, len(got) - 1, len(got) - 2)}) == 1


def budget(sizes, names):
    """Targets: shares by weight, none above three times its source."""
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(names)}
    left, free, out = float(sum(sizes.values())), dict(weight), {}
    while free:
        share = {s: left * w / sum(free.values()) for s, w in free.items()}
        over = [s for s in free if share[s] >= 3 * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
            del free[s]
    return out


def test_mixing_document_by_document(spark, folder):
    got = run(spark, "op10_mixing", folder)
    by_source, sizes = defaultdict(list), Counter()
    for i, text, _, source, _ in rows():
        n = len(WORD.findall(text or ""))
        sizes[source] += n
        key = int(hashlib.md5(f"{i}:{text or ''}".encode()).hexdigest()[:15], 16)
        by_source[source].append((key, i, n))
    names = sorted((s for s in sizes if s is not None)) + [None]
    want = budget(sizes, names)
    for s in names:
        whole, rest = divmod(want[s], sizes[s])
        at, taking = 0, True
        for key, i, n in sorted(by_source[s]):
            if taking and n:
                taking = at + n <= rest or at + n - rest < rest - at
                at += n
            assert got[i]["taken"] == n * (whole + (taking if n else 0)), (s, i)
            assert (got[i]["size"], got[i]["source_size"]) == (n, sizes[s]) and got[i]["target"] == pytest.approx(want[s])

import random
import re

from broadsheet.llm import pii

from .corpus import SCHEMA, table, texts

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    odd = sum(map(int, d[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(x), 10)) for x in d[-2::-2])) % 10 == 0


def plain(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else None,
                "card": 14 <= len(d) <= 19 and luhn(d),
                "phone": 10 <= len(d) <= 15,
            }[kind]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_against_the_patterns():
    rng = random.Random(3)
    for _ in range(4000):
        t = "".join(rng.choice(["a", "b@", ".", "1", "25", "0", "+1", " ", "-", "(", "@", "c.d", "4111 1111 1111 1111", "é"]) for _ in range(rng.randrange(30)))
        assert pii.base_spans(t) == plain(t), t


def test_long_runs_are_linear():
    assert pii.base_spans("a" * 300_000 + " " + "1" * 300_000 + "." * 10) == []


def test_words_that_disclose(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    told = [f"{word()} {word()} kestrel {word()} ann@x.example.org {word()} {word()} {word()} {i}" for i in range(9)]
    given = [*told, *(" ".join(word() for _ in range(40)) for _ in range(160)), "a kestrel again", told[0], None, ""]
    docs = table(spark, given)
    got = {r.doc_id: [(x["kind"], given[r.doc_id][x["s"] : x["e"]]) for x in r.found] for r in pii.find(docs).collect()}
    assert got[0] == [("generalise", "kestrel"), ("email", "ann@x.example.org")]
    assert got[len(told) + 160] == [("generalise", "kestrel")]
    assert all(got[i] == [] for i in (*range(9, 169), 171, 172))
    clean = {r.doc_id: r for r in pii.sanitise(docs).collect()}
    assert clean[169].text == "a [RELATED] again" and clean[169].kept == "clash" and clean[171].text is None
    assert "[EMAIL]" in clean[0].text and "ann@" not in clean[0].text


def test_copies_are_no_evidence(spark):
    same = "one two three rare word mail bob@y.example.org stands four five six"
    got = pii.find(table(spark, [same] * 40 + ["rare word"] + texts(2)))
    assert {x["kind"] for r in got.collect() for x in r.found} == {"email"}


def test_empty_and_null_ids(spark):
    assert pii.find(spark.createDataFrame([], SCHEMA)).count() == 0
    docs = spark.createDataFrame([(None, "bob@y.example.org", None, None, None, None)] * 2, SCHEMA)
    assert [len(r.found) for r in pii.find(docs).collect()] == [1, 1]

"""What counts as disclosure: whole texts, few contexts, entities without words near them."""

import random

from broadsheet.llm import pii

from .corpus import table


def corpus():
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    some = lambda n: " ".join(word() for _ in range(n))
    near = [f"{some(3)} kestrel {some(2)} ann@x.example.org {some(9)}" for _ in range(7)]
    far = [f"kestrel {some(40)} ann@x.example.org {some(9)}" for _ in range(3)]
    twice = [f"{some(3)} plover {some(1)} bob@y.example.org {some(7)}" for _ in range(2)]
    edited = [f"one heron two eve@z.example.org three four five six seven eight {some(20)}" for _ in range(6)]
    spread = [f"{some(3)} wren {some(1)} {who}@v.example.org {some(7)}" for who in ("u", "u", "w", "q")]
    bare = ["zed@w.example.org"] + [f"{some(3)} dunlin zed@w.example.org {some(7)} {i}" for i in range(3)]
    return [*near, *far, *twice, *edited, *spread, *bare, *(some(30) for _ in range(120))]


def test_texts_decide_and_two_contexts_are_enough(spark):
    docs = table(spark, corpus()).select("text")
    terms = {r.term: r.disclosure for r in pii.disclosing(docs)[0].collect()}
    assert terms == {"kestrel": 1.0, "plover": 1.0, "dunlin": 1.0}  # heron stands in six texts, but in one context


def test_entities_without_words_count_as_held(spark):
    docs = table(spark, ["zed@w.example.org", "abc zed@w.example.org"]).select("text")
    rows = pii.evidence(docs).collect()
    assert len({r.entity for r in rows if r.entity is not None}) == 1 and len({r.key for r in rows if r.entity is not None}) == 2
    assert [r.term for r in rows if r.term is not None] == ["abc"]


def test_copies_of_a_table_change_no_bits(spark):
    given = corpus()
    once = {tuple(r) for r in pii.disclosing(table(spark, given).select("text"))[0].collect()}
    many = {tuple(r) for r in pii.disclosing(table(spark, given * 3).select("text"))[0].collect()}
    assert once == many


def test_a_name_in_the_head_is_found_by_a_number_at_the_foot(spark):
    rng = random.Random(3)
    some = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    letters = [f"Dear Quillfeather {some(200)} call +1 (555) 010-4477 {some(8)}" for _ in range(12)]
    others = [some(30) for _ in range(300)] + [f"Dear friend {some(50)}" for _ in range(20)]
    docs = table(spark, letters + others)
    terms = {r.term: r.disclosure for r in pii.disclosing(docs.select("text"))[0].collect()}
    assert terms["quillfeather"] == 1.0 and "dear" not in terms
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert all("uillfeather" not in clean[i] and "010-4477" not in clean[i] for i in range(12))
    assert all(clean[i] == (letters + others)[i] for i in range(12, len(clean)))


def test_words_of_too_many_texts_go_before_pairs_form(spark):
    """A word of more than 1.25 times the texts of every entity beside it is no candidate, and no pair is made of it."""
    rng = random.Random(4)
    some = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    hold = [f"common {some(5)} rare {some(9)} ann@x.example.org {some(3)}" for _ in range(4)]
    docs = table(spark, hold + [f"common {some(20)}" for _ in range(40)] + ["rare words here"])
    terms = {r.term: r.disclosure for r in pii.disclosing(docs.select("text"))[0].collect()}
    assert terms == {"rare": 0.8}

"""Token counts against the tokenizers library itself, with blocks of every size."""

import random

import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from broadsheet.llm import queries, token_counts

from .corpus import SCHEMA, rows, table, texts

ODD = [
    "it's we'll'd 'twas O'Neil's 12345 3½ ²", "<|endoftext|>", "a<|startoftext|><|endoftext|>b <|endoftext", "ΣΊΣΥΦΟΣ Σ ΑΣ ΑΣ. İstanbul ẞ ǅ",
    "é e ́ ạ̈ ẛ̣ 한글 한", "a\x1cb\x1dc\x85d e f　g​h", "\x00\x01 ﻿",
    "日本語テキスト" * 40, "😀👨‍👩‍👧 🇩🇪", "x" * 5000, "ab " * 3000, "!!!???...---'''", "\t\n\x0b\x0c\r ", "<|ENDOFTEXT|> < |endoftext|>",
]


def vocabulary(name="word_bpe_49k.json"):
    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        return file.read()


def given():
    rng = random.Random(5)
    pool = "abcDE'.,!?19 é́ Σ\n日<|>"
    return [*texts(3), *ODD, *["".join(rng.choice(pool) for _ in range(rng.randrange(80))) for _ in range(150)]]


@pytest.mark.parametrize("block", [{}, {"block_docs": 1}, {"block_docs": 7, "block_bytes": 900}])
def test_counts_are_those_of_the_library(spark, block):
    tokenizer, all_texts = vocabulary(), given()
    library = Tokenizer.from_str(tokenizer)
    got = token_counts.count(table(spark, all_texts), tokenizer, spaced=True, limit=100, **block)
    assert got.columns == ["doc_id", "lang", "source", "n_chars", "kept", "n_bytes", "n_tokens", "over_limit"]
    found = {r.doc_id: r for r in got.collect()}
    assert len(found) == len(all_texts)
    for i, text in enumerate(all_texts):
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert (found[i].n_bytes, found[i].n_tokens, found[i].over_limit) == (len((text or "").encode()), n, n > 100), text
        assert (found[i].lang, found[i].kept, found[i].n_chars) == ("en", "clash", None)


def test_tokenizers_whose_pre_tokens_hold_spaces_take_whole_texts(spark):
    tokenizer, all_texts = vocabulary("byte_bpe_50k.json"), given()
    library = Tokenizer.from_str(tokenizer)
    found = {r.doc_id: r.n_tokens for r in token_counts.count(table(spark, all_texts), tokenizer).collect()}
    assert found == {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(all_texts)}


def test_each_distinct_pre_token_meets_the_model_once(spark):
    cutter = token_counts.PreTokens(vocabulary())
    found = token_counts.frequencies([b"The the THE cat's", b"", b"the<|endoftext|>cat"], cutter, True)
    assert found["words"] == ["the", "cat", "'s"]
    assert found["places"].tolist() == [0, 1, 2, 0, 1] and found["times"].tolist() == [3, 1, 1, 1, 1]
    gaps = token_counts.unpacked(token_counts.packed(token_counts._gaps(found["places"], found["per"])))
    assert token_counts._places(gaps, found["per"]).tolist() == found["places"].tolist()
    assert found["per"].tolist() == [3, 0, 2] and found["special"].tolist() == [0, 0, 1]


def test_clashing_columns_repeated_rows_and_empty_tables(spark):
    docs = spark.createDataFrame(rows(["a b", "a b", None]), SCHEMA).withColumns({"a.b": F.lit(1), "n_tokens": F.lit("x"), "block": F.lit(2), "words": F.lit(3)})
    docs = docs.union(docs.where("doc_id = 0"))
    got = token_counts.count(docs, vocabulary(), spaced=True)
    assert set(got.columns) == {*docs.columns, "n_bytes", "n_tokens", "over_limit"} - {"text"}
    assert sorted((r.doc_id, r.n_tokens, r["a.b"], r.block) for r in got.collect()) == [(0, 2, 1, 2), (0, 2, 1, 2), (1, 2, 1, 2), (2, 0, 1, 2)]
    assert token_counts.count(docs.limit(0), vocabulary(), spaced=True).count() == 0


def test_special_tokens_that_depend_on_neighbours_are_refused():
    with pytest.raises(ValueError, match="not supported"):
        token_counts.PreTokens(vocabulary().replace('"lstrip":false', '"lstrip":true').replace('"lstrip": false', '"lstrip": true'))


def test_query(spark, tmp_path):
    some = given()
    table(spark, some).write.parquet(f"{tmp_path}/documents.parquet")
    library = Tokenizer.from_str(vocabulary())
    got = queries.QUERIES["op11_token_counts"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(some)}
    assert {r.doc_id: r.n_tokens for r in got.collect()} == want
    assert any(n > 2048 for n in want.values())
    assert all(r.over_limit == (want[r.doc_id] > 2048) for r in got.collect())


def test_stretches_are_cut_alike_alone_and_together():
    cutter = token_counts.PreTokens(vocabulary())
    stretches = sorted({s.decode() for t in given() for s in (t or "").encode().split()})
    assert list(cutter.of_each(stretches)) == [cutter.of(s) for s in stretches]
    assert list(cutter.of_each([s for s in stretches if s.isascii() and "<|" not in s])) == [cutter.of(s) for s in stretches if s.isascii() and "<|" not in s]


def test_counts_go_back_to_blocks_in_several_parts(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "SENT", 5)
    some = given()
    library = Tokenizer.from_str(vocabulary())
    found = {r.doc_id: r.n_tokens for r in token_counts.count(table(spark, some), vocabulary(), spaced=True, block_docs=9).collect()}
    assert found == {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(some)}

"""The corpus operators as queries over the documents table, with DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, infilling, licenses, media, mixing, near_dedup, pii, quality, secrets, substring, suffixes, token_counts
from .shared import cut, small_batches


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return near_dedup.label(documents(spark, sf_dir).select("doc_id", "text"), percent=85, shingle=3)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    left = substring.remove(documents(spark, sf_dir).select("doc_id", "text"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    left = suffixes.remove(documents(spark, sf_dir).select("doc_id", "text"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(documents(spark, sf_dir).select("doc_id", "text")).drop("text")
    spans = F.col("secrets")
    return found.select(
        "doc_id",
        *[secrets.count(spans, kind).alias(f"n_{kind}") for kind in secrets.BASE_KINDS],
        F.sha2(secrets.listed(secrets.base(spans)), 256).alias("base_sha256"),
        secrets.listed(spans).alias("spans"),
    )


def vocabulary() -> tuple[dict[bytes, int], str]:
    import public_tokenizers

    return bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    coded = bpe.encode(documents(spark, sf_dir).select("doc_id", "text"), *vocabulary())
    return coded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", "source")
    measured = cut(quality.measure(docs).drop("text"), "quality")
    judged = quality.judge(measured, quality.sketches(measured))
    return judged.select("doc_id", *quality.ADDED, "kept")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    found = pii.find(documents(spark, sf_dir).select("doc_id", "text"))
    spans = F.col("found")
    return found.select(
        "doc_id",
        *[pii.count(spans, kind).alias(f"n_{kind}") for kind in pii.BASE_KINDS],
        F.sha2(pii.listed(pii.base(spans)), 256).alias("base_sha256"),
        pii.listed(spans).alias("spans"),
    )


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    stored = media.store(documents(spark, sf_dir).select("doc_id", "text")).drop("text")
    read = stored.withColumns({"payload": media.payload(), "sniffed": media.sniff("media", F.lit("text/plain"))})
    read = read.withColumn("inside", media.sniff("payload"))
    pieces = F.transform(F.col("inside.embedded"), lambda x: F.concat_ws(":", x["type"], x["start"], x["end"]))
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(";", "sniffed.type", "sniffed.length", "inside.type", F.array_join(pieces, ",")).alias("feature"),
    )


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(documents(spark, sf_dir).select("doc_id", "text"))
    names = F.array_sort(F.array_distinct(F.transform("licenses", lambda x: x["name"])))
    return found.select(
        "doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.array_join(names, ",").alias("licenses")
    )


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "source")
    rows = cut(mixing.sized(docs).drop("text"), "mix-sizes")
    return mixing.take(rows).select("doc_id", "size", "source_size", "target", "taken")


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    small_batches(spark)
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        tokenizer = file.read()
    return token_counts.count(documents(spark, sf_dir).select("doc_id", "text"), tokenizer, spaced=True)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return collocations.mine(documents(spark, sf_dir).select("text", "lang"))


def op13_infilling(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    made = infilling.transform(documents(spark, sf_dir).select("doc_id", "text"))
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(infilling.restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


QUERIES = {
    "op1_near_dedup": op1_near_dedup,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_secret_scans": op3_secret_scans,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_quality_rules": op5_quality_rules,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_pii": op7_pii,
    "op8_media_columns": op8_media_columns,
    "op9_license_scans": op9_license_scans,
    "op10_mixing": op10_mixing,
    "op11_token_counts": op11_token_counts,
    "op12_collocations": op12_collocations,
    "op13_infilling": op13_infilling,
}

_WORDS = r"list_filter(regexp_split_to_array(coalesce({}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: The others have no SQL form, or one too slow for whole tables; tests/llm holds them against brute-force versions.
ORACLES: dict[str, str] = {
    "op1_near_dedup": f"""
with recursive d as (select doc_id, {_WORDS.format(_LOWERED)} as w from documents),
place as (select doc_id, w, unnest(case when len(w) between 1 and 2 then [1] else range(1, len(w) - 1) end) as i from d),
s as (select distinct doc_id, array_to_string(w[i:i + 2], ' ') as x from place),
n as (select doc_id, count(*) as n from s group by 1),
pair as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.x = b.x and a.doc_id <> b.doc_id group by 1, 2),
link as (select a, b from pair join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 85 * (x.n + y.n - k)),
reach(a, b) as (select doc_id, doc_id from d union select r.a, l.b from reach r join link l on l.a = r.b),
c as (select a, min(b) as c from reach group by 1)
select d.doc_id, coalesce(n.n, 0) as n_shingles, c as component_id, c = d.doc_id as kept
from d join c on c.a = d.doc_id left join n on n.doc_id = d.doc_id""",
    "op2_substring_dedup": f"""
with d as (select doc_id, {_WORDS.format("text")} as w from documents),
place as (select doc_id, w, unnest(range(1, len(w) - 33)) as i from d),
win as (select doc_id, i, count(*) over (partition by md5(array_to_string(w[i:i + 34], ' '))) as n from place),
gone as (select distinct doc_id, unnest(range(i, i + 35)) as i from win where n > 1),
word as (select doc_id, unnest(range(1, len(w) + 1)) as i, unnest(w) as x from d),
kept as (select doc_id, string_agg(x, ' ' order by i) as k, count(*) as n from word anti join gone using (doc_id, i) group by 1)
select doc_id, len(w) as n_words, len(w) - coalesce(n, 0) as n_removed, sha256(coalesce(k, '')) as kept_sha256
from d left join kept using (doc_id)""",
}

_SPACE = r"\x20\x09-\x0D"
#: Measure -> part and whole in the SQL below, ranks and reach.
_MEASURES = {
    "symbols": ("n_symbols", "word_chars", 250, 750, 6),
    "capitals": ("capitals", "word_chars", 250, 750, 6),
    "stress": ("stress", "word_chars", 250, 750, 6),
    "same_lines": ("n_dup_lines", "n_lines", 500, 980, 3),
    "repeated": ("n_repeat_words", "n_words", 500, 980, 3),
}


def _quality_sql() -> str:
    shares = ", ".join(
        f"case when {whole} = 0 then 0 else floor(1000000.0 * {part} / {whole})::int end as m_{m}" for m, (part, whole, *_) in _MEASURES.items()
    )
    dropped = lambda v: f"greatest(length(bin({v}::bigint)) - 7, 0)"
    edge = lambda v: f"(({v}::bigint >> {dropped(v)}) << {dropped(v)})"
    kept = [*[f"m_{m}" for m in _MEASURES], "word_chars", "n_lines", "n_words"]
    lists = ", ".join(f"list_sort(list({edge(c)})) as s_{c}" for c in kept)
    at = lambda c, q: f"s_{c}[(n * {q} + 999) // 1000]"
    top = lambda c, q: f"({at(c, q)} + (1::bigint << {dropped(at(c, q))}) - 1)"
    fences = ", ".join(
        f"({top('m_' + m, hi)} + {reach} * greatest({top('m_' + m, hi)} - {at('m_' + m, lo)}, 1000000 // greatest({at(whole, 250)}, 1)))::double as f_{m}"
        for m, (_, whole, lo, hi, reach) in _MEASURES.items()
    )
    group = lambda by: f"select {by + ', ' if by else ''}n, {fences} from (select {by + ', ' if by else ''}count(*) as n, {lists} from good {'group by ' + by if by else ''})"
    one = lambda m: f"(l.n * l.f_{m} + 200 * c.f_{m}) / (l.n + 200.0)"
    two = lambda m: f"(o.n * o.f_{m} + 200 * {one(m)}) / (o.n + 200.0)"
    within = " and ".join(f"m_{m} <= coalesce(least(c.f_{m}, {one(m)}, {two(m)}), 1000000)" for m in _MEASURES)
    columns = ", ".join(["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lines", *[f"m_{m}" for m in _MEASURES]])
    return rf"""
with d as (select doc_id, lang, source, coalesce(text, '') as text, {_WORDS.format("text")} as w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^{_SPACE}]')) as ls from documents),
tri as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as s from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from d)),
win as (select doc_id, i, count(*) over (partition by doc_id, s) as n from tri),
rep as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + 3)) as p from win where n > 1) group by 1),
c as (select d.doc_id, lang, source, len(w) as n_words, length(regexp_replace(text, '[{_SPACE}]+', '', 'g')) as word_chars, len(ls) as n_lines, len(ls) - len(list_distinct(ls)) as n_dup_lines,
  length(text) - length(translate(text, '#*$%&|<>', '')) as n_symbols, length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) as capitals,
  length(text) - length(translate(text, '!?', '')) as stress, coalesce(rep.n, 0) as n_repeat_words from d left join rep on rep.doc_id = d.doc_id),
m as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, {shares} from c),
good as (select * from m where not base_failed), corpus as ({group('')}), language as ({group('lang')}), own as ({group('lang, source')})
select {columns}, not base_failed and {within} as kept from m cross join corpus c left join language l on l.lang is not distinct from m.lang
left join own o on o.lang is not distinct from m.lang and o.source is not distinct from m.source"""


def _license_sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rows = []
    for name, template in licenses.TEMPLATES:
        words = licenses.tokens(template)
        threes = sorted({" ".join(words[i : i + 3]) for i in range(len(words) - 2)})
        rows += [f"({quoted(name)}, {-(-len(words) * 5 // 4)}, {len(threes)}, {quoted(x)})" for x in threes]
    return f"""
with t(name, reach, n, s) as (values {", ".join(rows)}),
d as (select doc_id, list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') as w from documents),
g as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as s from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from d)),
hit as (select doc_id, name, reach, n, i, s from g join t using (s)),
held as (select a.doc_id, a.name from hit a join hit b on a.doc_id = b.doc_id and a.name = b.name and b.i between a.i and a.i + a.reach - 3
  group by a.doc_id, a.name, a.i, a.n having count(distinct b.s) >= 0.8 * a.n),
names as (select doc_id, count(*) as k, string_agg(name, ',' order by name) as names from (select distinct doc_id, name from held) group by 1)
select d.doc_id, coalesce(k, 0) as n_licenses, coalesce(names, '') as licenses from d left join names on names.doc_id = d.doc_id"""


def _infilling_sql() -> str:
    draw = lambda k: f"('0x' || substr(hash, {8 * k + 1}, 8))::bigint"
    return f"""
with d as (select doc_id, coalesce(text, '') as text, length(coalesce(text, '')) as n, sha256('1:' || doc_id) as hash from documents),
h as (select *, {draw(0)} % (n + 1) as x, {draw(1)} % (n + 1) as y, {draw(2)} as h3, {draw(3)} as h4 from d),
f as (select doc_id, text, n, least(x, y) as a, greatest(x, y) as b, case
  when n = 0 or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain'
  when h4 % 100 < 20 then 'spm' else 'psm' end as form from h),
p as (select *, substr(text, 1, a) as prefix, substr(text, a + 1, b - a) as middle, substr(text, b + 1) as suffix from f)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
  else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256, sha256(text) as restored_sha256 from p"""


_COLLOCATIONS = """
with recursive d as (select doc_id, coalesce(lang, 'und') as lang, string_split(regexp_replace(translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]', chr(10), 'g'), chr(10)) as ps from documents),
p as (select lang, list_filter(regexp_split_to_array(unnest(ps), '[ \x09]+'), lambda x: x <> '') as w from d),
g as (select lang, k, i, array_to_string(w[i:i + k - 1], ' ') as s from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from p, range(1, 5) t(k))),
f as (select lang, k, s, count(*) as f from g group by all),
n as (select lang, sum(f)::bigint as n from f where k = 1 group by 1),
c as (select lang, k, s, f as a, string_split(s, ' ') as w from f where k > 1 and f >= 30),
cuts as (select lang, k, s, a, j, array_to_string(w[1:j], ' ') as x, array_to_string(w[j + 1:k], ' ') as y from (select *, unnest(range(1, k)) as j from c)),
scored as (select c.lang, c.k, c.s, a, l.f as l, r.f as r, ((2000000::hugeint * a) // (l.f + r.f))::bigint as score, j from cuts c
  join f l on l.lang = c.lang and l.s = x and l.k = j join f r on r.lang = c.lang and r.s = y and r.k = c.k - j),
least as (select * from scored qualify row_number() over (partition by lang, s order by score, j) = 1),
inner_ as (select lang, a, m, array_to_string(w[i:i + m - 1], ' ') as s from (select lang, a, w, k, m, unnest(range(1, k - m + 2)) as i from c, range(2, 4) t(m) where m < k)),
most as (select lang, s, max(a) as most from inner_ group by all),
left_ as (select lang, s, a, l, r, score from least anti join (select lang, s from least join most using (lang, s) where 100::hugeint * most >= 80::hugeint * a) using (lang, s)),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, encode(s)) as rank from left_)
select lang, rank, s as phrase, a, l, r, n, score from ranked join n using (lang) where rank <= 2000"""


ORACLES |= {"op12_collocations": _COLLOCATIONS}
ORACLES |= {"op13_infilling": _infilling_sql()}
ORACLES |= {"op5_quality_rules": _quality_sql(), "op9_license_scans": _license_sql()}

"""Parts of the DuckDB oracles. Patterns are RE2's, so they are written on their own and not shared with the Spark side."""

from __future__ import annotations

from ..functions import lexicons

SPACE = r"\s\x{0b}\x{a0}\x{feff}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
STOP = "a an the and or but of in on at to for from with by as is are was were be been being it its this that these those his her their our your my he she they we you i not no new says said after over under into about more most than then will would can could may might should who whom which what when where why how amid among across during while also just has have had do does did get got make made take took one two three first second last year years day days week weeks month months time times report reports reported study news say some many according"
MORE_STOP = "told call called back out up down off per via near next still yet own way even much long"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def listed(words) -> str:
    return "[" + ", ".join(quoted(w) for w in words) + "]"


def any_word(words: str) -> str:
    return rf"(?i)\b(?:{words})\b".replace("'", "''")


def words_of(column: str) -> str:
    return rf"list_filter(string_split(regexp_replace(lower({column}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')"


def tokens_of(column: str) -> str:
    return f"list_filter({words_of(column)}, lambda w: length(w) > 3 and not list_contains({listed(STOP.split())}, w))"


def terms_of(column: str) -> str:
    parts = rf"list_transform(string_split(regexp_replace(lower({column}), '[^a-z0-9$%.-]+', ' ', 'g'), ' '), lambda w: regexp_replace(w, '^[.\-]+|[.\-]+$', '', 'g'))"
    return f"list_filter({parts}, lambda w: length(w) > 3 and not list_contains({listed((STOP + ' ' + MORE_STOP).split())}, w))"


def trimmed(column: str) -> str:
    return f"regexp_replace({column}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def sentences_of(column: str) -> str:
    """Inner dots are masked, one rule after the other, and put back."""
    masked = rf"regexp_replace({column}, '(\d)\.(\d)', '\1' || chr(1) || '\2', 'g')"
    masked = rf"regexp_replace({masked}, '\b([A-Z])\.([A-Z])\.', '\1' || chr(1) || '\2' || chr(1), 'g')"
    masked = rf"regexp_replace({masked}, '(?i)\b({lexicons.TITLES})\.', '\1' || chr(1), 'g')"
    found = rf"""regexp_extract_all({masked}, '[^.!?]+(?:[.!?]+["’'')\]]*|$)')"""
    clean = f"list_transform({found}, lambda s: {trimmed('replace(s, chr(1), chr(46))')})"
    return f"list_filter({clean}, lambda s: len(regexp_split_to_array(s, '[{SPACE}]+')) >= 6)"


def headed_of(n: int) -> str:
    """Title and opening, from a column `sents` with the sentences of the summary."""
    return f"title || '. ' || case when len(sents) > 0 then array_to_string(sents[1:{n}], ' ') else summary_text end"


def facts_of(column: str) -> str:
    pattern = r"(?i)\$[\d,.]+\s?(?:billion|million|trillion|bn|m)?|\b\d[\d,.]*\s?(?:percent|%|people|votes?|years?|months?|days?|cases?|deaths?|jobs?)\b|\b\d{2,}\b"
    return rf"list_distinct(list_transform(regexp_extract_all({column}, '{pattern}'), lambda m: trim(regexp_replace(lower(m), '\s+', ' ', 'g'))))"


def replaced_each(text: str, pattern: str, use) -> str:
    """text with each match of the pattern replaced by use(match, index from 1, gap before it)."""
    p = quoted(pattern)
    return f"array_to_string(list_transform(regexp_split_to_array({text}, {p}), lambda g, i: g || coalesce({use(f'regexp_extract_all({text}, {p})[i]')}, '')), '')"

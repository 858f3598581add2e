"""Text functions as Column expressions. Word boundaries are ASCII, as the data model asks, whatever the language."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicons import COUNTED, NOT_NAMES, STOP_WORDS, TERM_STOP_WORDS, TITLES

AHEAD, BEHIND = "(?![A-Za-z0-9_])", "(?<![A-Za-z0-9_])"
#: Where a word of ASCII letters, digits and underscores begins or ends.
EDGE = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
#: White space as the data model has it, which is more than the `\\s` of Java, for use inside brackets. The rarer ones
#: stand behind a range of their own, so that other characters are told apart by one comparison and not by nine.
SPACE = r"\s\u00a0[\u1680-\uffff&&[\ufeff\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]"


def whole(words: str) -> str:
    """A case-insensitive pattern for one of the alternatives as whole words."""
    return f"(?i){BEHIND}(?:{words}){EDGE}"


def bind(value: Column, use) -> Column:
    """use(value) with value computed once for a row, also where `use` names it inside a lambda."""
    return F.transform(F.array(value), use)[0]


def replace_each(text: Column, pattern: str, use: Callable[[Column], Column]) -> Column:
    """text with every match of the pattern replaced by use(match)."""

    def put(t: Column) -> Column:
        found = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
        # the gap behind the last match has none to go with
        parts = F.zip_with(F.split(t, pattern, -1), found, lambda gap, m: F.concat(gap, F.when(m.isNotNull(), use(m)).otherwise("")))
        return F.when(t.rlike(pattern), F.array_join(parts, "")).otherwise(t)

    return bind(text, put)


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+\z", "")


def first_upper(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 2**31 - 1))


def plain_words(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9."""
    return F.array_remove(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " "), "")


def tokens(text: Column, stop: Sequence[str] = STOP_WORDS) -> Column:
    return F.filter(plain_words(text), lambda w: (F.length(w) > 3) & ~w.isin(*stop))


def terms(text: Column, stop: Sequence[str] = TERM_STOP_WORDS) -> Column:
    """Like tokens, but numbers and money keep their signs, and more words are passed over."""
    parts = F.split(F.regexp_replace(F.lower(text), "[^a-z0-9$%.-]+", " "), " ")
    bare = F.transform(parts, lambda w: F.regexp_replace(w, r"^[.\-]+|[.\-]+\z", ""))
    return F.filter(bare, lambda w: (F.length(w) > 3) & ~w.isin(*stop))




def _inner_dots() -> str:
    """Dots that end nothing: in decimals, in and after pairs of initials, after titles.

    Pairs are told off from the left, so in a chain of single digits or initials every other dot opens a pair; chains of
    up to eight are looked back through.
    """
    pairs = lambda unit: [rf"(?:\.{unit}\.{unit})" * k for k in range(4)]
    initial = rf"{BEHIND}(?<!{BEHIND}[A-Z]\.)[A-Z]"
    return "|".join(
        [rf"(?<=(?<![0-9]\.)[0-9]{p})\.(?=[0-9])" for p in pairs("[0-9]")]
        + [rf"(?<={initial}{p})\.(?=[A-Z]\.)" for p in pairs("[A-Z]")]
        + [rf"(?<={initial}\.[A-Z]{p})\." for p in pairs("[A-Z]")]
        + [rf"(?<={BEHIND}(?i:{t}))\." for t in TITLES.split("|")]
    )


SENTENCE = rf"[^.!?]++(?:(?:{_inner_dots()})[^.!?]*+)*+(?:[.!?]+[\"’')\]]*|\z)"


def sentences(text: Column, least: int = 6) -> Column:
    """Sentences of `least` words or more; decimals, initials and titles do not end one."""
    found = F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0))
    return F.filter(F.transform(found, trimmed), lambda s: F.size(F.split(s, rf"[{SPACE}]+")) >= least)


#: Characters of a text that are read for each of its first sentences before the rest is.
HEAD = 256


def first_sentences(text: Column, n: int) -> Column:
    """The first n of `sentences`. Long texts are read whole only if their head holds no more than n.

    A sentence of six words that follows another is longer than what the pattern looks ahead, so wherever the head is cut,
    all of its sentences but the last are those of the text.
    """
    room = HEAD * (n + 1)

    def of(found: Column) -> Column:
        return F.slice(F.when((F.size(found) > n) | (F.length(text) <= room), found).otherwise(sentences(text)), 1, n)

    return bind(sentences(F.left(text, F.lit(room))), of)


def first_sentence(text: Column) -> Column:
    """Up to the first end of a sentence, or the first 160 characters where there is none."""
    sentence = F.regexp_extract(text, "^[.!?]*([^.!?]+[.!?])", 1)
    return F.coalesce(F.nullif(sentence, F.lit("")), F.substring(text, 1, 160), F.lit(""))


def opening(text: Column, n: int = 2) -> Column:
    """The first n sentences of a summary, or all of it where it has none."""
    return bind(first_sentences(text, n), lambda s: F.when(F.size(s) > 0, F.array_join(s, " ")).otherwise(text))


def headed(title: Column, summary: Column, n: int = 2) -> Column:
    """What an item says of itself: its title and its opening."""
    return F.concat(F.coalesce(title, F.lit("")), F.lit(". "), opening(F.coalesce(summary, F.lit("")), n))


def first_story(text: Column) -> Column:
    """Without what a digest joins on after its first story."""
    at = F.regexp_instr(text, F.lit(rf"(?i)[.!?][{SPACE}]+(?:And|Also|Plus|Meanwhile|Elsewhere),[{SPACE}]+"))
    return F.when(at > 21, trimmed(F.left(text, at))).otherwise(text)


def hard_facts(text: Column) -> Column:
    """Money, counted things and numbers of two digits or more, lower case, in order of first appearance."""
    pattern = (
        r"(?i)\$[\d,.]+\s?(?:billion|million|trillion|bn|m)?"
        rf"|{BEHIND}\d[\d,.]*\s?(?:(?:{COUNTED}){AHEAD}|%(?=[A-Za-z0-9_]))|{BEHIND}\d{{2,}}{AHEAD}"
    )
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.array_distinct(F.transform(found, lambda m: F.trim(F.regexp_replace(F.lower(m), r"\s+", " "))))


def proper_names(text: Column) -> Column:
    """Runs of one to three capitalised words that do not begin with a listed word."""
    one = "[A-Z][a-z]{2,}"
    found = F.regexp_extract_all(text, F.lit(rf"{BEHIND}{one}(?:\s+{one}){{0,2}}{AHEAD}"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda m: ~m.rlike(f"^(?:{NOT_NAMES}){AHEAD}")))


def shingles(text: Column, n: int = 7) -> Column:
    def of(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.array_join(F.slice(w, i + 1, n), " "))
        return F.array_distinct(F.when(F.size(w) >= n, each).otherwise(F.array().cast("array<string>")))

    # inside a one-element array the words are computed once for a text, not once for a shingle
    return F.transform(F.array(plain_words(text)), of)[0]


def overlap(a: Column, b: Column) -> Column:
    """Shared part of the smaller of two sets; 0 if one is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def restates(a: Column, b: Column) -> Column:
    """Whether two arrays of terms are mostly the same."""
    return overlap(F.array_distinct(a), F.array_distinct(b)) > 0.45


def same_idea(a: Column, b: Column, core: Column) -> Column:
    """Whether two texts share wording, or most of the terms that they add to the core."""

    def added(text: Column) -> Column:
        return F.array_except(terms(text), core)

    close = bind(added(a), lambda x: bind(added(b), lambda y: (F.least(F.size(x), F.size(y)) >= 3) & (overlap(x, y) > 0.5)))
    return (overlap(shingles(a, 5), shingles(b, 5)) > 0.3) | close


def link_key(url: Column) -> Column:
    return F.regexp_replace(F.substring_index(url, "?", 1), r"/\z", "")


def story_id(link: Column) -> Column:
    """The last 24 letters and digits of a link without its query."""
    return F.right(F.regexp_replace(F.substring_index(link, "?", 1), "[^A-Za-z0-9]+", ""), F.lit(24))


#: Named entities in the order in which they are decoded; numeric ones come after the first, `&amp;` last.
ENTITIES = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&rsquo;", "'"), ("&lsquo;", "'"), ("&apos;", "'"), ("&ldquo;", '"'),
    ("&rdquo;", '"'), ("&hellip;", "..."), ("&mdash;", ", "), ("&ndash;", ", "), ("&amp;", "&"),
)


def _character(hexadecimal: Column) -> Column:
    """The character of a code point; one that is none becomes the replacement character."""
    digits = F.upper(F.regexp_replace(hexadecimal, "^0+(?=.)", ""))
    padded = F.lpad(digits, 8, "0")
    valid = (F.length(digits) <= 6) & (padded <= "0010FFFF") & ~padded.between("0000D800", "0000DFFF")
    return F.when(valid, F.decode(F.unhex(F.when(valid, padded).otherwise("0000FFFD")), "UTF-32")).otherwise("\ufffd")


def decode_entities(text: Column) -> Column:
    def number(m: Column) -> Column:
        value = F.regexp_extract(m, "([0-9A-Fa-f]+);", 1)
        return _character(F.when(m.rlike("(?i)^&#x"), value).otherwise(F.conv(value, 10, 16)))

    def named(t: Column) -> Column:
        for entity, is_ in ENTITIES:
            t = F.replace(t, F.lit(entity), F.lit(is_))
        return t

    def decoded(t: Column) -> Column:
        spaced = F.replace(t, F.lit("&nbsp;"), F.lit(" "))
        numbers = bind(spaced, lambda s: F.when(s.contains("&#"), replace_each(s, "(?i)&#(?:x[0-9a-f]+|[0-9]+);", number)).otherwise(s))
        return bind(numbers, lambda s: F.when(s.contains("&"), named(s)).otherwise(s))

    # most texts hold no entity at all: one look for the sign that begins them saves fourteen passes
    return bind(text, lambda t: F.when(t.contains("&"), decoded(t)).otherwise(t))


def strip_tags(text: Column) -> Column:
    out = F.regexp_replace(text, r"(?is)<script.*?</script>", " ")
    out = F.regexp_replace(out, r"(?is)<style.*?</style>", " ")
    return F.regexp_replace(out, r"<[^>]*+>", " ")


def strip_html(html: Column, rounds: int = 3) -> Column:
    """Text of a page: entities decoded and tags dropped `rounds` times, since some feeds escape twice; tidy spaces.

    A round that changes nothing leaves the text as it is, so texts that are plain sooner are not harmed by the rest.
    """
    turn = lambda t: F.when(t.contains("<") | t.contains("&"), strip_tags(decode_entities(t))).otherwise(t)
    out = F.coalesce(html, F.lit(""))
    for _ in range(rounds):
        out = bind(out, turn)
    return plain_marks(bind(out, lambda t: F.when(t.contains("&"), F.regexp_replace(t, r"(?i)&[a-z]+;", " ")).otherwise(t)))


#: A run of white space that is not one plain space.
_UNEVEN = rf"[{SPACE}&&[^ ]][{SPACE}]*+| [{SPACE}]++"


def plain_marks(text: Column) -> Column:
    """A text without markup with straight quotes and tidy spaces."""
    out = text
    for curly, straight in (("\u2018", "'"), ("\u2019", "'"), ("\u201c", '"'), ("\u201d", '"')):
        out = F.replace(out, F.lit(curly), F.lit(straight))
    # from here on a run of spaces is one
    out = F.regexp_replace(F.regexp_replace(out, _UNEVEN, " "), r" ([),.;:!?])", "$1")
    return F.trim(F.replace(out, F.lit("( "), F.lit("(")))


def escape_html(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(plain), F.lit(entity))
    return out


def without_dashes(text: Column) -> Column:
    """Dashes become commas, runs of spaces one space."""
    return trimmed(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), rf"[{SPACE}]*[–—][{SPACE}]*", ", "), rf"[{SPACE}]{{2,}}", " "))


def long_date(day: Column) -> Column:
    return F.date_format(day, "EEEE, MMMM d, yyyy")


def edition_date(ts: Column, zone: str = "America/Denver") -> Column:
    """The reader's calendar day of a time in UTC."""
    return F.to_date(F.from_utc_timestamp(ts, zone))


def listed(names: Column) -> Column:
    """a, b and c."""
    n = F.size(names)
    most = F.array_join(F.slice(names, 1, F.greatest(n - 1, F.lit(0))), ", ")
    return F.when(n > 1, F.concat(most, F.lit(" and "), F.get(names, n - 1))).otherwise(F.coalesce(F.get(names, F.lit(0)), F.lit("")))

"""Secret scans with linked credential parts (operator 3), in DataFrame functions only.

Three patterns report on their own: assignments of passwords and keys, access identifiers, long hexadecimal runs.
Other parts are weak alone: an opaque token, a login name, an endpoint. They are reported only where complementary
parts stand in one scope: an opaque token with an access identifier, a login or an endpoint; a login or an endpoint
with an opaque token or a strong secret. Two parts are in one scope if their starts are at most SCOPE code points
apart, wherever in the text they stand. That is an interval join of two sorted lists: parts and partners are merged by
start, running maxima and minima give each part the nearest partner before and behind it, and their distances decide.
Parts of one document never leave its row, so no shuffle happens, and neither a common key nor a long document can
gather rows in one task; the work is near linear in the parts of a text.

Null or empty text: no spans. Ties: parts that start together are in one scope. Repeated rows: each gets its spans.
Texts of any length. Empty table: no rows. Columns of the input stay, whatever their names, but for the one that this
operator adds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import aside, back, bind

#: The base patterns; letters of the key words in either case.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"  # the maximal run AKIA[A-Z0-9]+ if it has 20 characters or more
HEX = r"[0-9a-f]{24,}"  # the maximal run [0-9a-f]+ if it has 24 characters or more

#: Parts that are weak alone.
OPAQUE = r"[A-Za-z0-9+/_-]{24,}={0,2}"
LOGIN = r"""(?i:\b(?:user(?:_?name)?|login|account|client_?id|access_?key_?id))["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}"""
ENDPOINT = r"""(?i:\b(?:https?|ftp|postgres(?:ql)?|mysql|mongodb|redis|amqp)://)[^\s"'<>]{4,}"""

SCOPE = 512
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "opaque", "login", "endpoint")
#: Elements of a block of a running fold, and how often blocks are folded in blocks: enough for BLOCK^4 matches.
_BLOCK, _DEPTH = 64, 3


def _before(values: Column, fold, start: Column, depth: int = _DEPTH) -> Column:
    """For each element the fold of those before it, in blocks of blocks so that the work stays near linear."""
    whole = lambda xs: F.aggregate(xs, start, fold)
    if depth == 0:
        return F.transform(values, lambda _, i: whole(F.slice(values, 1, i)))
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _BLOCK).cast("int")),
        lambda b: F.slice(values, b * _BLOCK + 1, _BLOCK),
    )

    def placed(parts: Column) -> Column:
        within = lambda bases: F.flatten(
            F.transform(
                parts, lambda part, b: bind(F.get(bases, b), lambda base: F.transform(part, lambda _, i: fold(base, whole(F.slice(part, 1, i)))))
            )
        )
        totals = F.transform(parts, whole)
        bases = F.when(F.size(parts) == 1, F.array(start)).otherwise(bind(totals, lambda t: _before(t, fold, start, depth - 1)))
        return bind(bases, within)

    return bind(blocks, placed)


def _sums_before(lengths: Column) -> Column:
    return _before(lengths, lambda a, x: a + x, F.lit(0).cast("long"))


def _spans(text: Column, pattern: str, keep=None) -> Column:
    """Array of (s, e), code points, end exclusive, of the leftmost matches that do not overlap.

    What lies between the matches comes from splitting by the same pattern; lengths of both give the places.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    empty = F.array().cast("array<struct<s:bigint,e:bigint>>")

    def located(m: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g).cast("long"))
        sizes = F.transform(m, lambda x: F.length(x).cast("long"))

        def place(gap: Column) -> Column:
            both = F.transform(sizes, lambda n, i: F.get(gap, i) + n)
            return bind(
                both,
                lambda step: F.zip_with(
                    _sums_before(step),
                    step,
                    lambda before, n: F.struct(before.alias("b"), (before + n).alias("e")),
                ),
            )

        ends = bind(gaps, place)
        spans = F.zip_with(
            ends, sizes, lambda x, n: F.struct((x["e"] - n).alias("s"), x["e"].alias("e"))
        )
        if keep is not None:
            spans = F.filter(F.zip_with(spans, keep, lambda s, k: F.when(k, s)), lambda s: s.isNotNull())
        return F.when(F.size(m) > 0, spans).otherwise(empty)

    return bind(found, located)


_FAR = 1 << 60


def _linked(spans: Column, partners: Column) -> Column:
    """The spans whose start is at most SCOPE away from the start of a partner."""
    own = F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(1).alias("own"), x["e"].alias("e")))
    other = F.transform(partners, lambda x: F.struct(x["s"].alias("s"), F.lit(0).alias("own"), x["e"].alias("e")))

    def near(merged: Column) -> Column:
        """Distances to the nearest partner before each of the merged parts and behind it; partners first of ties."""
        starts = lambda none: F.transform(merged, lambda x: F.when(x["own"] == 0, x["s"]).otherwise(F.lit(none)))
        last = _before(starts(-_FAR), lambda a, x: F.greatest(a, x), F.lit(-_FAR).cast("long"))
        following = F.reverse(_before(F.reverse(starts(_FAR)), lambda a, x: F.least(a, x), F.lit(_FAR).cast("long")))
        gap = F.zip_with(last, following, lambda b, a: F.struct(b.alias("b"), a.alias("a")))
        close = F.zip_with(merged, gap, lambda x, g: F.when((x["own"] == 1) & (F.least(x["s"] - g["b"], g["a"] - x["s"]) <= SCOPE), x))
        return F.transform(F.filter(close, lambda x: x.isNotNull()), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))

    none = F.slice(spans, 1, 0)
    return F.when((F.size(spans) == 0) | (F.size(partners) == 0), none).otherwise(bind(F.sort_array(F.concat(own, other)), near))


def scan(docs: DataFrame) -> DataFrame:
    """docs with `secrets`: array of (s, k, e, kind), by start and then by kind in the order of KINDS."""
    rows = aside(docs, "text").withColumn("_t", F.coalesce(F.col("text"), F.lit("")))
    text = F.col("_t")
    value = F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= ASSIGN_VALUE)
    mixed = F.transform(
        F.regexp_extract_all(text, F.lit(OPAQUE), F.lit(0)),
        lambda v: v.rlike("[A-Z]") & v.rlike("[a-z]") & v.rlike("[0-9]"),
    )
    found = rows.withColumns(
        {
            "_assign": _spans(text, ASSIGN, value),
            "_access": _spans(text, ACCESS),
            "_hex": _spans(text, HEX),
            "_opaque": _spans(text, OPAQUE, mixed),
            "_login": _spans(text, LOGIN),
            "_endpoint": _spans(text, ENDPOINT),
        }
    )
    strong = F.concat("_assign", "_hex", "_opaque")
    linked = found.withColumns(
        {
            "_opaque": _linked(F.col("_opaque"), F.concat("_access", "_login", "_endpoint")),
            "_login": _linked(F.col("_login"), strong),
            "_endpoint": _linked(F.col("_endpoint"), strong),
        }
    )

    def named(k: int, kind: str) -> Column:
        return F.transform(
            F.col(f"_{kind}"),
            lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"), F.lit(kind).alias("kind")),
        )

    every = F.concat(*[named(k, kind) for k, kind in enumerate(KINDS)])
    return back(linked, docs, secrets=F.sort_array(every))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def base(spans: Column) -> Column:
    return F.filter(spans, lambda x: x["k"] < len(BASE_KINDS))


#: Code points of one stretch of a text that is cut; what lies before a stretch is not read again for each cut.
STRETCH = 1024


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of a secret in its text replaced by the mark; overlapping spans by one.

    The text is divided once into stretches; what stands between spans is taken from the stretches that it touches, and
    all is joined once, so the work grows with the text and the number of spans, not with their product.
    """
    text = F.col("text")
    gap = lambda a, b: F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    state = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<a:bigint,b:bigint>>").alias("gaps"))

    def step(acc: Column, x: Column) -> Column:
        more = F.when(x["s"] < acc["at"], acc["gaps"]).otherwise(F.concat(acc["gaps"], F.array(gap(acc["at"], x["s"]))))
        return F.when(x["e"] <= acc["at"], acc).otherwise(F.struct(x["e"].alias("at"), more.alias("gaps")))

    ends = F.aggregate("_spans", state, step, lambda acc: F.concat(acc["gaps"], F.array(gap(acc["at"], F.length(text)))))

    def between(stretches: Column, x: Column) -> Column:
        first, last = F.floor(x["a"] / STRETCH), F.floor((x["b"] - 1) / STRETCH)
        touched = F.array_join(F.slice(stretches, (first + 1).cast("int"), (last - first + 1).cast("int")), "")
        cut_ = F.substring(touched, (x["a"] - first * STRETCH + 1).cast("int"), (x["b"] - x["a"]).cast("int"))
        return F.when(x["b"] > x["a"], cut_).otherwise("")

    stretches = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{STRETCH}}}"), F.lit(0))
    clean = bind(stretches, lambda parts: F.array_join(F.transform(ends, lambda x: between(parts, x)), mark))
    found = scan(aside(docs, "text")).withColumnRenamed("secrets", "_spans")
    cleaned = F.when(F.size("_spans") > 0, clean).otherwise(text)
    return back(found, docs, text=cleaned).select(*[F.col(f"`{c}`") for c in docs.columns])

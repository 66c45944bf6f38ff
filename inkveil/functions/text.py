"""Text expressions: blanks, matches with their places, literal search."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space as layouts mean it, no-break space and byte order mark included: a Java class body.
BLANK = r"\s\x{00A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once wherever then names it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def trimmed(text: Column) -> Column:
    """Without blanks at its ends. A run of blanks inside is looked at once, from its start."""
    return F.regexp_replace(text, f"^[{BLANK}]+|(?<![{BLANK}])[{BLANK}]++$", "")


#: Signs of BLANK that are no space, or two spaces; and how those of more bytes begin, other signs among them.
_NARROW, _WIDE = ("  ", "\t", "\n", "\x0b", "\f", "\r"), ("c2a0", "efbbbf", "e19a80", "e280", "e2819f", "e38080")


def single_spaced(text: Column) -> Column:
    """Words joined by one space, as lines are rebuilt from words.

    Most lines are so already. Asking for single signs is much quicker than a
    regular expression, which only the other lines run.
    """
    raw = text.cast("binary")
    wide = (F.octet_length(text) > F.length(text)) & reduce(or_, [F.contains(raw, F.unhex(F.lit(x))) for x in _WIDE])
    odd = reduce(or_, [F.contains(text, F.lit(x)) for x in _NARROW]) | wide
    return F.trim(F.when(~odd, text).otherwise(F.regexp_replace(text, f"[{BLANK}]+", " ")))


def held(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once a row, whatever reads them.

    The optimiser writes a plain column's expression into whatever names it, a
    lambda's body too, where it would run once an element; it does not look
    into a generator.
    """
    kept = [c for c in df.columns if c not in columns]
    one = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return df.select(*kept, one.alias("_held")).select(*kept, *[F.col(f"_held.{n}").alias(n) for n in columns])


#: Values that a running sum adds one by one; longer arrays are summed part by part.
PART = 64


def running(values: Column) -> Column:
    """For each value the sum of those before it.

    An array that grows in a fold is copied at each step, and summing all values
    anew for each is no better. So the values are cut into parts, and a value
    adds up its own part only, onto the sum of the parts before.
    """
    plus = lambda a, x: a + x
    zero = F.lit(0)

    def by_parts(v: Column, starts: Column, sums: Column) -> Column:
        def one(c: Column) -> Column:
            own = F.struct(F.slice(v, c * PART + 1, PART).alias("own"), F.aggregate(F.slice(sums, 1, c), zero, plus).alias("base"))
            return let(own, lambda p: F.transform(p["own"], lambda _, i: F.aggregate(F.slice(p["own"], 1, i), p["base"], plus)))

        return F.flatten(F.transform(starts, one))

    def cut(v: Column) -> Column:
        starts = F.when(F.size(v) > 0, F.sequence(F.lit(0), F.floor((F.size(v) - 1) / PART).cast("int"))).otherwise(F.array().cast("array<int>"))
        return let(F.transform(starts, lambda c: F.aggregate(F.slice(v, c * PART + 1, PART), zero, plus)), lambda sums: by_parts(v, starts, sums))

    return let(values, cut)


def leading(n: Column, test: Callable[[Column], Column]) -> Column:
    """How many of the indexes 0 to n - 1 pass, where those that pass come first: a binary search."""

    def step(s: Column, _: Column) -> Column:
        mid = F.shiftright(s["low"] + s["high"], 1)
        passes = test(mid)
        half = F.struct(F.when(passes, mid + 1).otherwise(s["low"]).alias("low"), F.when(passes, s["high"]).otherwise(mid).alias("high"))
        return F.when(s["low"] < s["high"], half).otherwise(s)

    state = F.struct(F.lit(0).alias("low"), n.cast("int").alias("high"))
    return F.aggregate(F.sequence(F.lit(0), F.length(F.bin(n))), state, step, lambda s: s["low"])


def matches(text: Column, pattern: str, around: tuple[int, int] | None = None) -> Column:
    """All matches, leftmost first: array of (start, raw), start from 0; with around also so many characters before and after.

    The text between matches and the matches themselves alternate, so a start
    is the length of all gaps up to it and all matches before it.
    """
    fields = "start:int,raw:string" + (",before:string,after:string" if around else "")

    def placed(found: Column, gaps: Column) -> Column:
        gap = lambda i: F.coalesce(F.get(gaps, i), F.lit(""))
        raw = lambda i: F.coalesce(F.get(found, i), F.lit(""))
        sizes = F.transform(found, lambda m, i: F.length(F.get(gaps, i)) + F.length(m))

        def item(m: Column, i: Column, before: Column) -> Column:
            out = [(F.get(before, i) + F.length(F.get(gaps, i))).alias("start"), m.alias("raw")]
            if around:  # a match has a character at least, so as many neighbours are enough
                near = F.when(i > 0, F.transform(F.sequence(F.greatest(i - around[0], F.lit(0)), i - 1), lambda k: F.concat(gap(k), raw(k)))).otherwise(F.array().cast("array<string>"))
                out.append(F.right(F.concat(F.array_join(near, ""), gap(i)), F.lit(around[0])).alias("before"))
                next_ = [x for k in range(1, around[1] + 1) for x in (gap(i + k), raw(i + k))]
                out.append(F.left(F.concat(*next_), F.lit(around[1])).alias("after"))
            return F.struct(*out)

        return let(running(sizes), lambda before: F.transform(found, lambda m, i: item(m, i, before)))

    none = F.array().cast(f"array<struct<{fields}>>")
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    return let(found, lambda m: F.when(F.size(m) > 0, let(F.split(text, pattern, -1), lambda gaps: placed(m, gaps))).otherwise(none))


def literal_places(text: Column, needle: Column) -> Column:
    """Starts of all non-overlapping places of needle in text, case-insensitive, whatever signs either holds."""
    size = F.length(needle)
    quoted = F.concat(F.lit("\\Q"), F.replace(F.lower(needle), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))

    def places(parts: Column) -> Column:
        lengths = F.transform(parts, lambda p: F.length(p) + size)
        return let(running(lengths), lambda before: F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p, i: F.get(before, i) + F.length(p)))

    some = (size > 0) & F.contains(F.lower(text), F.lower(needle))
    return F.when(some, let(F.split(F.lower(text), quoted, -1), places)).otherwise(F.array().cast("array<int>"))


def clamp_confidence(value: Column) -> Column:
    """Into 0 to 1; what is no finite number counts as 0.5."""
    odd = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(odd, 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def defuse(text: Column) -> Column:
    """Breaks page_text tags in a document's text, so that it cannot end the fence around it."""
    return F.regexp_replace(text, "(?i)<(/?page_text>)", "‹$1")

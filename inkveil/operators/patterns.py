"""Detection by patterns: matches, guards, and the veto inside web addresses.

Lines are read once for all targets. Only lines that pass a cheap test for a
target run its regular expressions, and the guards come right after the match,
before any box is looked up. A line's matches stay in arrays until their words
are found, so that no text is copied for each match; places and words come from
running sums and binary searches, so a line's cost grows with its length.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.functions.geometry import union_all
from inkveil.functions.text import BLANK, held, leading, let, matches, trimmed
from inkveil.operators.layout import words_in_range
from inkveil.sources.text_layout import mono_span, mono_starts
from inkveil.targets import EDGE, URL_SIGNS, URLS, Target

#: Targets that never count inside a web address.
NOT_IN_URLS = ("phone", "dob")

# What makes a run of digits a number to call.
LABELS = "phone|mobile|mob|tel|cell|contact|whatsapp|call"
LABEL_REACH, MIN_DIGITS, MAX_DIGITS, SURE_DIGITS = 24, 7, 15, 9
YEARS = rf"{EDGE}(?:19|20)[0-9]{{2}}{EDGE}[^0-9]{{1,3}}{EDGE}(?:19|20)[0-9]{{2}}{EDGE}"

DETECTION = (
    "doc_id bigint, page int, target string, box struct<x:double,y:double,width:double,height:double>, text string, "
    "confidence double, source string, word_ids array<string>, seq array<int>"
)


#: Characters before and after a match that its guard looks at.
AROUND = (LABEL_REACH, 2)
_HITS = "array<struct<seq:array<int>,target:string,start:int,raw:string>>"


def phone_guard(raw: Column, before: Column, after: Column) -> Column:
    """No year range or percentage, and a label before, a plus in front or nine digits. before and after as AROUND says."""
    digits = F.length(F.regexp_replace(raw, "[^0-9]", ""))
    sure = F.lower(before).rlike(LABELS) | raw.rlike(r"^\s*\+") | (digits >= SURE_DIGITS)
    return digits.between(MIN_DIGITS, MAX_DIGITS) & ~raw.rlike(YEARS) & ~after.rlike(r"^\s*%") & sure


def guard(target_id: str, m: Column) -> Column:
    """Guards go by target id, so a target of one's own named so has them too. m has start and raw, and before and after for a phone."""
    if target_id == "phone":
        return phone_guard(m["raw"], m["before"], m["after"])
    if target_id == "dob":
        return F.length(trimmed(m["raw"])) > 3
    return F.lit(True)


def _has_one(text: Column, signs: tuple[str, ...]) -> Column:
    return reduce(or_, [F.instr(text, s) > 0 for s in signs])


def url_matches(text: Column) -> Column:
    """An array of the matches of each address pattern, in order; lines without an address's signs are not searched."""
    none = F.array().cast("array<array<struct<start:int,raw:string>>>")
    return F.when(_has_one(text, URL_SIGNS), F.array(*[matches(text, p) for p in URLS])).otherwise(none)


def in_url(urls: Column, m: Column) -> Column:
    """Whether a match overlaps one of url_matches. Those of one pattern stand in order: the last that begins before m ends is the one to ask."""
    end = m["start"] + F.length(m["raw"])

    def met(own: Column) -> Column:
        before = leading(F.size(own), lambda k: F.get(own, k)["start"] < end)
        return let(F.get(own, before - 1), lambda u: F.coalesce(u["start"] + F.length(u["raw"]) > m["start"], F.lit(False)))

    return F.exists(urls, met)


def _worth(target: Target, text: Column) -> Column:
    """A cheap test that every line with a match passes."""
    worth = _has_one(text, target.needs) if target.needs else F.lit(True)
    if target.id == "phone" and target.patterns:
        worth = worth & _has_one(text, tuple("0123456789")) & text.rlike("[0-9]{2}[^0-9]{0,3}[0-9]{2}")
    if target.id == "email":
        worth = worth & text.rlike(r"[A-Za-z0-9._%+-]\s?@")
    return worth


def may_match(text: Column, targets: list[Target]) -> Column:
    """A cheap test that every text with a match in one of its lines passes, before it is cut into lines. Any run of blanks may be one space there."""

    def one(target: Target) -> Column:
        worth = _has_one(text, target.needs) if target.needs else F.lit(True)
        if target.id == "phone":
            worth = worth & text.rlike(f"[0-9]{{2}}(?:[{BLANK}]++|[^0-9{BLANK}]){{0,3}}[0-9]{{2}}")
        return worth

    return reduce(or_, [one(t) for t in targets if t.patterns], F.lit(False))


def _hits(target: Target, n: int, k: int, found: Column, guarded: bool) -> Column:
    """What its guard lets through of the matches of pattern k of the n-th target: array of (seq, target, start, raw)."""

    def kept(m: Column) -> Column:
        some = trimmed(m["raw"]) != ""
        return some & guard(target.id, m) if guarded else some

    def item(m: Column, i: Column) -> Column:
        return F.struct(F.array(F.lit(n), F.lit(k), i).alias("seq"), F.lit(target.id).alias("target"), m["start"].alias("start"), m["raw"].alias("raw"))

    return F.transform(F.filter(found, kept), item)


def line_hits(lines: DataFrame, targets: list[Target], guarded: bool = True) -> DataFrame:
    """lines that have hits, with ``hits``: those inside web addresses are left out where they have no business there.

    Addresses are searched once, for their own target and for the veto alike;
    where only the veto asks, lines with other hits are searched only.
    """
    text, some = F.col("text"), [t for t in targets if t.patterns]
    none = F.array().cast(_HITS)
    veto = guarded and any(t.id in NOT_IN_URLS for t in some)
    wanted = any(t.patterns == URLS for t in some)
    found = {"_urls": url_matches(text)} if wanted else {}
    for n, t in enumerate(some):
        for k, pattern in enumerate(t.patterns if t.patterns != URLS else ()):
            own = matches(text, pattern, AROUND if guarded and t.id == "phone" else None)
            found[f"_found_{n}_{k}"] = F.when(_worth(t, text), own)
    rows = held(lines, **found) if found else lines
    of = lambda t, n, k: F.get("_urls", F.lit(k)) if t.patterns == URLS else F.col(f"_found_{n}_{k}")
    arrays = [F.coalesce(_hits(t, n, k, of(t, n, k), guarded), none) for n, t in enumerate(some) for k in range(len(t.patterns))]
    rows = held(rows, hits=F.flatten(F.array(*arrays)) if arrays else none).drop(*[c for c in found if c != "_urls"]).filter(F.size("hits") > 0)
    if veto:
        rows = rows if wanted else held(rows, _urls=url_matches(text))
        outside = F.filter("hits", lambda m: ~m["target"].isin(*NOT_IN_URLS) | ~in_url(F.col("_urls"), m))
        rows = held(rows, hits=outside).filter(F.size("hits") > 0)
    return rows.drop("_urls")


def line_matches(lines: DataFrame, targets: list[Target], guarded: bool = True) -> DataFrame:
    """lines with target, start, raw and seq for each match that its guard lets through."""
    return line_hits(lines, targets, guarded).select(*lines.columns, F.explode("hits").alias("m")).select(*lines.columns, "m.*")


def trimmed_span(m: Column, then: Callable[[Column], Column]) -> Column:
    """then(span) of a match without blanks at its ends: value, begin and end."""
    lead = F.length(m["raw"]) - F.length(F.regexp_replace(m["raw"], f"^[{BLANK}]+", ""))

    def span(s: Column) -> Column:
        return then(F.struct(s["value"].alias("value"), s["begin"].alias("begin"), (s["begin"] + F.length(s["value"])).alias("end")))

    return let(F.struct(trimmed(m["raw"]).alias("value"), (m["start"] + lead).alias("begin")), span)


def detect_patterns(lines: DataFrame, targets: list[Target], guarded: bool = True) -> DataFrame:
    """Detections of pattern targets. Lines come from build_lines, or from text_lines in fixed pitch."""

    def worded(words_of: Callable[[Column, Column], Column]) -> Callable[[Column], Column]:
        def one(m: Column) -> Column:
            return trimmed_span(m, lambda s: F.struct(m["target"].alias("target"), m["seq"].alias("seq"), s["value"].alias("value"), words_of(s["begin"], s["end"]).alias("w")))

        return one

    rows = line_hits(lines, targets, guarded)
    if "words" in lines.columns:
        every = F.transform("hits", worded(lambda a, b: words_in_range(F.col("words"), a, b)))
    else:
        rows = held(held(rows, _parts=F.split("text", " ")), _starts=mono_starts(F.col("_parts")))
        line = [F.col(c) for c in ("page", "slot", "first", "_parts", "_starts")]
        every = F.transform("hits", worded(lambda a, b: mono_span(*line, a, b)))
    hits = rows.select("doc_id", "page", "line_no", F.explode(every).alias("m")).select("doc_id", "page", "line_no", "m.*").filter(F.size("w") > 0)
    return hits.select(
        "doc_id", "page", "target", union_all(F.transform("w", lambda x: x["box"])).alias("box"), F.col("value").alias("text"), F.lit(1.0).alias("confidence"),
        F.lit("pattern").alias("source"), F.transform("w", lambda x: x["word_id"]).alias("word_ids"),
        F.array(F.lit(0), F.get("seq", F.lit(0)), F.col("line_no"), F.get("seq", F.lit(1)), F.get("seq", F.lit(2))).alias("seq"),
    )

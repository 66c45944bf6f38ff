"""Line-first quality rules, in DataFrame functions only.

Each line is judged alone. It fails if it has no letter or digit, if it does not
end as a sentence does (a closing sign, with quotes or brackets after it), if
over a tenth of it are the signs #*$%&|<>, if it is navigation (bars between
entries, or an address for every four words), stutter, or boilerplate (a short
line with a copyright mark and year or a stock phrase). Failing lines are
removed. A document is rejected when they hold too much of its words; before
that come text-wide rules: too few words, and too many words inside repeated
5-word windows.

Everything is an expression over one row, so there is no shuffle and no group.
Repeated windows are found without comparing all pairs: the windows' hashes are
counted as a set first, and only texts that do repeat sort (hash, place) pairs
and look at neighbours. Two windows count as equal when their 64-bit XXH64 of
the five words' own XXH64 are. Of a line's rules those that cost a regular
expression at each sign run only where a cheaper test leaves them a chance.

Defined cases: null and blank texts have no words and fail the base rule; a text
of any length is judged whole, as one row; rows that repeat are judged alike; an
empty table gives an empty result; all columns that the caller passes through
survive, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import spread

#: Characters between words, as a Java class body.
BLANK = r" \t-\r"


@dataclass(frozen=True)
class LineRules:
    """Limits of the line rules and of what a document may lose."""

    max_symbol_share: float = 0.1
    max_stutter_share: float = 0.3
    max_lost_share: float = 0.5
    window: int = 5


#: What a line ends with: a closing sign, then quotes and brackets.
SENTENCE_END = r'[.!?…:;。！？]["\x27”’»)\]]*[\x20\x09-\x0D]*\z'
#: A web address's beginning, and a copyright mark with its year.
ADDRESS = r"(?:https?://|www[.])"
COPYRIGHT = r"(?:©|[(]c[)]|copyright) *(?:19|20)[0-9][0-9]"
#: Characters of a line's end that are asked for that first.
TAIL = 32
#: What stands between the entries of navigation.
BARS = ("|", ">", "»", "•", "·")
#: Phrases that mark a boilerplate line, compared in lower case.
BOILERPLATE = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of service", "terms of use",
    "subscribe to our newsletter", "click here", "read more", "sign up", "log in", "share this",
    "javascript is disabled", "enable javascript", "lorem ipsum", "accept cookies", "skip to content",
)


def words_of(text: Column) -> Column:
    """The words of a text. A blank at either end leaves an empty piece, which goes."""
    return F.filter(F.split(text, f"[{BLANK}]+"), lambda w: w != "")


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value computed once, however often and wherever then names it.

    A plain column would not do: a filter that is pushed below the projection
    spells out the whole expression at each mention.
    """
    return F.element_at(F.transform(F.array(value), then), 1)


def _windows(words: Column, n: Column, size: int) -> Column:
    """Hashes of all windows of size words; each word is hashed once and by itself, so their ends are unambiguous."""

    def from_each(own: Column) -> Column:
        return F.transform(F.slice(own, 1, F.greatest(n - (size - 1), F.lit(0))), lambda h, i: F.xxhash64(h, *[F.get(own, i + k) for k in range(1, size)]))

    return let(F.transform(words, lambda w: F.xxhash64(w)), from_each)


def _repeat_words(hashes: Column, size: int) -> Column:
    """Words inside windows that occur at least twice, each word once."""

    def places(pairs: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(pairs, k)["h"] == x["h"], F.lit(False))
        twice = F.filter(pairs, lambda x, k: same(x, k - 1) | same(x, k + 1))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def covered(at: Column) -> Column:
        gaps = F.transform(at, lambda x, k: F.least(F.lit(size), F.coalesce(F.get(at, k + 1) - x, F.lit(size))))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeats = F.size(hashes) > F.size(F.array_distinct(hashes))
    return F.when(repeats, let(pairs, lambda p: let(places(p), covered))).otherwise(F.lit(0))


def _judged(text: Column, rules: LineRules) -> Column:
    """A struct of all counts of one text."""
    size, solid = rules.window, lambda x: x.rlike(f"[^{BLANK}]")

    def counts(words: Column, lines: Column) -> Column:
        n = F.size(words)
        return F.struct(
            n.cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            let(_windows(words, n, size), lambda h: _repeat_words(h, size)).cast("long").alias("n_repeat_words"),
            _count_words(F.filter(lines, lambda x: ~_line_ok(x, rules))).cast("long").alias("n_bad_words"),
        )

    lines = F.filter(F.split(text, "\n"), solid)
    return let(words_of(text), lambda w: let(lines, lambda x: counts(w, x)))


def quality(df: DataFrame, text_col: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """df's rows in the struct ``row``, with the counts, base_failed and kept."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bad_words"]
    row = spread(df).select(F.struct("*").alias("row"))
    found = row.withColumn("found", _judged(F.coalesce(F.col("row")[text_col].cast("string"), F.lit("")), rules))

    def base(s: Column) -> Column:
        return (s["n_words"] < 10) | (100 * s["n_repeat_words"] > 20 * s["n_words"])

    def verdict(s: Column) -> Column:
        return F.struct(*[s[n].alias(n) for n in names], base(s).alias("base_failed"), (~base(s) & ~(s["n_bad_words"] > rules.max_lost_share * s["n_words"])).alias("kept"))

    return found.select("row", let(F.col("found"), verdict).alias("found")).select("row", "found.*")


def cleaned(text: Column, rules: LineRules = LineRules()) -> Column:
    """The text without the lines that fail; blank lines stay."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~x.rlike(f"[^{BLANK}]") | _line_ok(x, rules)), "\n")


def clean(df: DataFrame, text_col: str = "text", chars_col: str = "n_chars", rules: LineRules = LineRules()) -> DataFrame:
    """df with its texts cleaned; a column of their lengths, where there is one, follows."""
    kind = dict(df.dtypes)
    out = df.withColumn(text_col, cleaned(F.col(text_col), rules))
    return out.withColumn(chars_col, F.length(text_col).cast(kind[chars_col])).select(*df.columns) if chars_col in kind else out


def _count_words(lines: Column) -> Column:
    return F.aggregate(F.transform(lines, lambda x: F.regexp_count(x, F.lit(f"[^{BLANK}]+"))), F.lit(0), lambda a, x: a + x)


def _line_ok(line: Column, rules: LineRules) -> Column:
    """A line passes unless it is no sentence, mostly signs, navigation, stutter or boilerplate.

    Signs are judged against the line's length, navigation by separators that
    stand between its entries or by its addresses, stutter by words that repeat
    the one before, and boilerplate by a mark in a line too short to be prose
    that quotes it.
    """
    some = lambda *signs: reduce(or_, [F.contains(line, F.lit(s)) for s in signs])
    ends = F.right(line, F.lit(TAIL)).rlike(SENTENCE_END) | line.rlike(SENTENCE_END)  # the whole line only where its end is no answer
    sentence = line.rlike(r"[\p{L}\p{N}]") & ends
    signs = F.regexp_count(line, F.lit(r"[#*$%&|<>]"))
    marked = signs > rules.max_symbol_share * F.length(line)
    bars = F.regexp_count(line, F.lit(f"[{''.join(BARS)}]"))
    addresses = F.regexp_count(line, F.lit(ADDRESS))
    stutter = F.regexp_count(line, F.lit(rf"(?<![^{BLANK}])([^{BLANK}]++)[{BLANK}]++(?=\1(?![^{BLANK}]))"))
    boiler = F.lower(line).rlike("|".join((*BOILERPLATE, COPYRIGHT)))

    def passes(words: Column) -> Column:
        listed = some(*BARS) & let(bars, lambda n: (n >= 3) & (4 * n >= words))
        linked = some("http", "www.") & let(addresses, lambda n: (n > 0) & (4 * n >= words))
        return ~(listed | linked | ((words < 30) & boiler) | ((words >= 5) & (stutter > rules.max_stutter_share * words)))

    return sentence & ~marked & let(F.regexp_count(line, F.lit(f"[^{BLANK}]+")), passes)


#: DuckDB: the same counts with windows as word lists, and the line rules as expressions.
ORACLE_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
w AS (
  SELECT doc_id, x, regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+') AS w,
         list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines FROM t),
win AS (
  SELECT doc_id, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4] AS g
  FROM w, LATERAL (SELECT unnest(range(1, len(w) - 3)) AS i)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id),
lin AS (
  SELECT doc_id, l, regexp_extract_all(l, '[^\\x20\\x09-\\x0D]+') AS lw,
         len(regexp_extract_all(l, '[#*$%&|<>]')) AS signs, len(regexp_extract_all(l, '[|>»•·]')) AS bars,
         len(regexp_extract_all(l, '{ADDRESS}')) AS addresses
  FROM w, LATERAL (SELECT unnest(lines) AS l)),
bad AS (
  SELECT doc_id, sum(len(lw)) AS n FROM lin
  WHERE NOT regexp_matches(l, '[\\p{{L}}\\p{{N}}]') OR NOT regexp_matches(l, '{SENTENCE_END}')
     OR signs > {LineRules().max_symbol_share} * length(l) OR (bars >= 3 AND 4 * bars >= len(lw)) OR (addresses > 0 AND 4 * addresses >= len(lw))
     OR (len(lw) >= 5 AND len(list_filter(range(2, len(lw) + 1), lambda i: lw[i] = lw[i-1])) > {LineRules().max_stutter_share} * len(lw))
     OR (len(lw) < 30 AND regexp_matches(lower(l), '{"|".join((*BOILERPLATE, COPYRIGHT))}'))
  GROUP BY doc_id),
c AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(x, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(cov.n, 0)::BIGINT AS n_repeat_words, coalesce(bad.n, 0) AS n_bad
  FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN bad USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT n_bad > {LineRules().max_lost_share} * n_words AS kept FROM f
"""

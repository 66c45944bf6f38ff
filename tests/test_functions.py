"""Expressions against small models in Python."""

import random
import re
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkveil.errors import UnknownTarget
from inkveil.functions import geometry as geo
from inkveil.functions.grid import column_index, column_label, parse_cell
from inkveil.functions.text import clamp_confidence, defuse, literal_places, matches, running, single_spaced, trimmed
from inkveil.operators.layout import line_numbers
from inkveil.operators.model_vision import label_of
from inkveil.providers import strict_schema
from inkveil.sources.tables import partitions, plain_scan
from inkveil.sources.text_layout import text_lines
from inkveil.targets import BARE_ENDINGS, BUILTIN, DOB, EDGE, EMAIL, PHONE, SOCIAL, URL_BARE, URL_PATH, URLS, Target, builtin_target_ids, resolve_targets

SLOW = settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@SLOW
@given(st.lists(st.text("ab1 .😀", max_size=30), min_size=1, max_size=20))
def test_match_places(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: [(m["start"], m["raw"]) for m in r["m"]] for r in df.select("i", matches(F.col("t"), "a+1?|b.").alias("m")).collect()}
    assert got == {i: [(m.start(), m[0]) for m in re.finditer("a+1?|b.", t)] for i, t in enumerate(texts)}


@SLOW
@given(st.lists(st.tuples(st.text("aAb ", max_size=25), st.text("aAb ", max_size=3)), min_size=1, max_size=20))
def test_literal_places(spark, pairs):
    def model(text, needle):
        out, at = [], 0
        while needle and (at := text.lower().find(needle.lower(), at)) >= 0:
            out.append(at)
            at += len(needle)
        return out

    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = {r["i"]: r["p"] for r in df.select("i", literal_places(F.col("a"), F.col("b")).alias("p")).collect()}
    assert got == {i: model(a, b) for i, (a, b) in enumerate(pairs)}


def test_places_of_signs_that_mean_something(spark):
    df = spark.createDataFrame([("a\x01b jane", "jane"), ("x\\E.jane\\e.", "\\E."), ("a.b$1", ".B$"), ("aaa", "")], "t string, n string")
    assert [r[0] for r in df.select(literal_places(F.col("t"), F.col("n"))).collect()] == [[4], [1, 8], [1], []]


@SLOW
@given(st.lists(st.lists(st.integers(0, 9), max_size=400), min_size=1, max_size=4))
def test_running_sums(spark, arrays):
    df = spark.createDataFrame(list(enumerate(arrays)), "i int, a array<int>")
    got = {r["i"]: r["s"] for r in df.select("i", running(F.col("a")).alias("s")).collect()}
    assert got == {i: [sum(a[:k]) for k in range(len(a))] for i, a in enumerate(arrays)}


def test_matches_know_what_is_around(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["a", "aa", "b", " ", "", "c"]) for _ in range(60)) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r["i"]: [tuple(m) for m in r["m"]] for r in df.select("i", matches(F.col("t"), "a+", (5, 2)).alias("m")).collect()}
    assert got == {i: [(m.start(), m[0], t[max(0, m.start() - 5) : m.start()], t[m.end() : m.end() + 2]) for m in re.finditer("a+", t)] for i, t in enumerate(texts)}


# The shapes as they read most plainly; the engine's own find the same without recursion and without reading a run twice.
PLAIN_HOST = r"(?<![@A-Za-z0-9_.-])(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+"
PLAIN = {
    EMAIL: r"(?i)[A-Z0-9._%+-]+\s?@\s?[A-Z0-9.-]+\.[A-Z]{2,}",
    PHONE: r"(?:\+[0-9]{1,3}[\s.-]?)?(?:\([0-9]{1,4}\)[\s.-]?)?[0-9]{2,5}(?:[\s.-]?[0-9]{2,5}){1,4}" + EDGE,
    URL_PATH: rf"(?i){PLAIN_HOST}[a-z]{{2,}}/[^\s<>\"')\]]*",
    URL_BARE: rf"(?i){PLAIN_HOST}(?:{'|'.join(BARE_ENDINGS)}){EDGE}",
}


@pytest.mark.parametrize("seed", [1, 2])
def test_shapes_find_what_the_plain_ones_do(spark, seed):
    rng = random.Random(seed)
    pieces = ["a", "b-", "-", ".", "..", ".com", "co.", "uk", "/", "x", "@", "_", " ", "io", "A", "é", "-.", ".-", "1", "22", "55555", "+", "(4)", "9" * 30, "a.b.org/x", "x@y.org", "%"]
    texts = [("".join(rng.choice(pieces) for _ in range(rng.randint(0, 25))),) for _ in range(8000)]
    df = spark.createDataFrame(texts, "t string")
    for own, plain in PLAIN.items():
        both = df.select(F.regexp_extract_all("t", F.lit(own), 0).alias("a"), F.regexp_extract_all("t", F.lit(plain), 0).alias("b"), F.split("t", own, -1).alias("c"), F.split("t", plain, -1).alias("d"))
        assert both.filter("a <> b or c <> d").count() == 0 and both.filter("size(a) > 0").count() > 100


def test_long_lines_pass_every_shape(spark):
    """A megabyte of what makes a careless pattern recurse or read a run again from each of its letters."""
    n = 1_000_000
    big = ["a." * (n // 2) + "com", "a-" * (n // 2), "1234567890" * (n // 10), "12 " * (n // 3), "a@" * (n // 2), "x@" + "a" * n, "www." + "a." * (n // 2), "." * n + "@", " " * n + "x", "+1 (2) " * (n // 7)]
    df = spark.createDataFrame([(x,) for x in big], "t string")
    began = time.time()
    for shape in (EMAIL, PHONE, SOCIAL, DOB, *URLS):
        assert df.select(F.size(F.regexp_extract_all("t", F.lit(shape), 0)).alias("n")).agg(F.sum("n")).first()[0] >= 0
    assert df.select(F.length(trimmed(F.col("t"))).alias("n")).agg(F.sum("n")).first()[0] > 0
    assert time.time() - began < 120


def test_counting_partitions_starts_no_job(spark, tmp_path):
    spark.range(100).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    frames = {"scan": df, "grouped": df.groupBy("id").count(), "dealt": df.repartition(3), "sorted": df.orderBy("id"), "met": df.join(F.broadcast(df), "id"), "first": df.limit(5), "behind": spark.createDataFrame(df.repartition(3).rdd, df.schema)}
    spark.sparkContext.setJobGroup("counting", "")
    plain = {k for k, v in frames.items() if plain_scan(v) and partitions(v) > 0}
    assert all(partitions(v) > 0 for v in frames.values()) and plain == {"scan"}
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("counting")
    spark.sparkContext.setJobGroup("", "")


def test_lines_by_windows_are_the_folds_lines(spark):
    rng = random.Random(6)
    rows = [(d, 0, i, (float(rng.randint(0, 300)), float(rng.randint(0, 60)), 5.0, float(rng.choice([2, 6, 12, 30])))) for d in range(6) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, page int, ord int, box struct<x:double,y:double,width:double,height:double>")
    got = {(r["doc_id"], r["ord"]): r["line"] for r in line_numbers(df).collect()}
    for d in range(6):
        line, low = -1, float("-inf")
        for _, _, i, (x, y, _, h) in sorted((r for r in rows if r[0] == d), key=lambda r: (r[3][1], r[3][0], r[2])):
            if y + h / 2 > low:
                line, low = line + 1, y + h
            low = max(low, y + h)
            assert got[d, i] == line


def test_blanks_of_all_kinds_become_one_space(spark):
    df = spark.createDataFrame([("\t a  b﻿ c \x0b",)], "t string")
    assert df.select(single_spaced(F.col("t"))).first()[0] == "a b c"


def test_confidence(spark):
    df = spark.createDataFrame([(x,) for x in (None, float("nan"), float("inf"), -1.0, 0.3, 7.0)], "c double")
    assert [r[0] for r in df.select(clamp_confidence(F.col("c"))).collect()] == [0.5, 0.5, 0.5, 0.0, 0.3, 1.0]


def test_defused_tags(spark):
    df = spark.createDataFrame([("</page_text> <PAGE_TEXT> <page>",)], "t string")
    assert df.select(defuse(F.col("t"))).first()[0] == "‹/page_text> ‹PAGE_TEXT> <page>"


def test_column_labels(spark):
    got = spark.range(0, 19000, 7).select("id", column_label(F.col("id")).alias("a")).select("id", "a", column_index(F.col("a")).alias("b")).collect()
    assert all(r["a"] == label_of(r["id"]) and r["b"] == r["id"] for r in got if r["id"] < 18278)


def test_long_column_labels(spark):
    ends = [18278 - 1, 475254 - 1, 12356630 - 1, 321272406 - 1, 2**53, 2**63 - 3]
    ids = [*range(18270, 19000), *(i + k for i in ends for k in (-1, 0, 1)), None]
    df = spark.createDataFrame([(i,) for i in ids], "id bigint")
    got = df.select("id", column_label(F.col("id")).alias("a")).select("id", "a", column_index(F.col("a")).alias("b")).collect()
    assert all((r["a"], r["b"]) == (label_of(r["id"]), r["id"]) for r in got if r["id"] is not None)
    assert [r["a"] for r in got if r["id"] in (18278, None)] == ["AAAA", "AAAA", None]


def test_cells(spark):
    df = spark.createDataFrame([(x,) for x in ("C4", " c 4 ", "aa10", "A0", "4C", "ABCD1", "", None)], "c string")
    got = [r[0] and (r[0]["col"], r[0]["row"]) for r in df.select(parse_cell(F.col("c"))).collect()]
    assert got == [(2, 3), (2, 3), (26, 9), None, None, None, None, None]


def test_regions(spark):
    rng = random.Random(5)
    rows = [tuple(float(rng.randint(0, 20)) for _ in range(8)) for _ in range(300)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, f double, g double, h double")
    a, b = geo.box(*[F.col(x) for x in "abcd"]), geo.box(*[F.col(x) for x in "efgh"])

    def model(r):
        ax, ay, aw, ah, bx, by, bw, bh = r
        w, h = min(ax + aw, bx + bw) - max(ax, bx), min(ay + ah, by + bh) - max(ay, by)
        inter = w * h if w > 0 and h > 0 else 0
        inside = lambda ox, oy, ow, oh, ix, iy, iw, ih: ix >= ox - 1 and iy >= oy - 1 and ix + iw <= ox + ow + 1 and iy + ih <= oy + oh + 1
        share = inter / (aw * ah + bw * bh - inter) if inter else 0
        return inside(*r) or inside(*r[4:], *r[:4]) or share > 0.5

    assert [r[0] for r in df.select(geo.same_region(a, b)).collect()] == [model(r) for r in rows]


def test_targets():
    assert builtin_target_ids()[:3] == ["name", "email", "phone"] and len(BUILTIN) == 15
    own = Target("clearance", "A clearance level.")
    assert [t.id for t in resolve_targets(["email", own, "email"])] == ["email", "clearance"]
    with pytest.raises(UnknownTarget, match="Known targets: name, email"):
        resolve_targets(["nothing"])
    with pytest.raises(UnknownTarget):
        Target("a+b", "")


def test_strict_schema():
    given_ = {"type": "object", "required": ["a"], "properties": {"a": {"type": "string", "minLength": 2}, "format": {"type": ["integer"], "default": 1}}}
    assert strict_schema(given_) == {
        "type": "object", "required": ["a", "format"], "additionalProperties": False,
        "properties": {"a": {"type": "string"}, "format": {"type": ["integer", "null"]}},
    }


def test_lines_with_odd_blanks_are_single_spaced(spark):
    texts = ["a b", " a  b ", "a\tb", "a\u00a0b", "a \u2009b", "\u2019a b\u2019", "\u3000", "\ufeffa", "a\x0bb\x0c", "\u00e9 \u1680b\u205f", ""]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(single_spaced(F.col("t"))).collect()]
    assert got == ["a b", "a b", "a b", "a b", "a b", "\u2019a b\u2019", "", "a", "a b", "\u00e9 b", ""]


def test_lines_are_counted_once_a_page(spark):
    words = spark.range(1).select(F.col("id").alias("doc_id"), F.lit("a b\n\nc\nd e f\n" + "g h\n" * 60).alias("text"))
    plan = text_lines(words)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 2  # the document into lines, and each line once into words
    got = [(r["page"], r["slot"], r["line_no"], r["first"]) for r in text_lines(words).orderBy("page", "slot").collect()]
    assert got[:4] == [(0, 0, 1, 0), (0, 2, 2, 2), (0, 3, 3, 3), (0, 4, 4, 6)] and got[59:61] == [(1, 0, 1, 0), (1, 1, 2, 2)]

"""Sharding, LM scores, chat rendering and the pipeline."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

import corpus_pipeline
from inkveil.llm import chat_format, exact_dedup, lm_scoring, packing, quality_rules, queries, sharding, simhash, toxicity
from inkveil.llm.common import crc32_mod, numbered, shared_dir, table as read
from tests.compare import check
from tests.llm.test_text_ops import line_passes

CLASHING = "doc_id bigint, text string, size string, shard string, h string, block string, unit string, word string"


def table(spark, pairs):
    return spark.createDataFrame([(i, t, *"abcdef") for i, t in pairs], CLASHING)


ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (None, "x y"), (5, "word " * 300), (6, "a b c d"), (6, "a b c d"), (7, "é" * 9)]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_duckdb(spark, data, name):
    check(spark, queries.queries()[name], queries.oracle_sql()[name], data)


def slow_sharding(pairs, shards, hashes):
    """The rule told row by row: classes of groups, large ones first, each to the shard with the highest dot product."""
    groups = defaultdict(list)
    for i, t in pairs:
        groups[t or ""].append(i)
    vector = {t: np.array([(len(t.encode()) + 16) * len(ids), len(t.split()) * len(ids), len(ids)], float) for t, ids in groups.items()}
    total = sum(vector.values())
    share = {t: v * shards / np.maximum(total, 1) for t, v in vector.items()}
    assert all(max(s[0], s[2]) <= sharding.SPLIT_ABOVE for s in share.values())
    level = {t: 0 if max(s) > 1 / sharding.CLASS else max(1, math.floor(-math.log(max(s), sharding.CLASS))) for t, s in share.items()}
    left, to = np.ones((shards, 3)), {}
    for k in sorted(set(level.values())):
        own = sorted((t for t in groups if level[t] == k), key=lambda t: (-max(share[t]), hashes[t]))
        whole = sum(share[t] for t in own)
        part = left * whole / left.sum(axis=0)
        load = np.zeros_like(left)
        for t in own:
            best = max(range(shards), key=lambda b: (sum(part[b] * share[t]), -b))
            to[t] = best
            part[best] = part[best] - share[t]
            load[best] += share[t]
        left = np.maximum(left - load, 0)
    return to


def shard_case(seed):
    rng = random.Random(seed)
    return ODD + [(100 + i, "w " * rng.randint(1, 90) + str(rng.randint(0, 900))) for i in range(1500)] + [(4000 + i, f"copied {i % 40}") for i in range(700)] + [(None, "no id at all")] * 60


def test_groups_go_where_brute_force_puts_them(spark):
    pairs, df = shard_case(1), None
    df = table(spark, pairs)
    hashes = {r["t"]: r["h"] for r in df.select(F.coalesce("text", F.lit("")).alias("t"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    want = slow_sharding(pairs, 5, hashes)
    by_crc = defaultdict(set)
    for r in sharding.shard(df, 5).collect():
        by_crc[r["text_crc32"]].add(r["shard"])
    assert {t: by_crc[zlib.crc32(t.encode())] for t in want} == {t: {k} for t, k in want.items()}


@pytest.mark.parametrize("cell", [10_000, 50])
def test_shards(spark, monkeypatch, cell):
    monkeypatch.setattr(sharding, "CELL_GROUPS", cell)
    pairs = shard_case(cell) + [(5000 + i if i % 2 else None, "a hot text") for i in range(1500)]
    got = sharding.shard(table(spark, pairs), 5).collect()
    rows = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in pairs)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == rows
    assert {(r["law"], r["grown_shard"]) for r in got} == {("bytes", None)}
    slots, by_text, sizes = defaultdict(list), defaultdict(set), Counter()
    for r in got:
        slots[r["shard"]].append(r["slot"])
        by_text[r["text_crc32"]].add(r["shard"])
        sizes[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(5))
    assert max(sizes.values()) < 1.1 * min(sizes.values()) and max(map(len, slots.values())) < 1.2 * min(map(len, slots.values()))
    hot = zlib.crc32(b"a hot text")  # two fifths of all rows: two mean shards
    assert all(len(s) == 1 for t, s in by_text.items() if t != hot) and len(by_text[hot]) > 1


def test_sharding_of_no_rows_and_of_one_text(spark):
    assert sharding.shard(table(spark, []), 5).count() == 0
    got = sharding.shard(table(spark, [(None, "x")] * 200), 4).collect()
    assert sorted(Counter(r["shard"] for r in got)) == [0, 1, 2, 3] and len({(r["shard"], r["slot"]) for r in got}) == 200


def slow_scores(pairs, order):
    docs = [(i, (t or "").split()) for i, t in pairs]
    counts = Counter(tuple(w[k : k + n]) for _, w in docs for n in range(1, order + 1) for k in range(len(w) - n + 1))
    total = sum(len(w) for _, w in docs)
    out = []
    for i, w in docs:
        score = 0.0
        for k in range(len(w)):
            for n in range(min(order, k + 1), 0, -1):
                g = tuple(w[k - n + 1 : k + 1])
                if counts[g] > 1:
                    score += math.log((counts[g] - 1) / ((counts[g[:-1]] if n > 1 else total) - 1))
                    break
                score += math.log(0.4) if n > 1 else math.log(1 / total)
        out.append((i or 0, len(w), score))
    return sorted(out)


@pytest.mark.parametrize(("order", "group_bits"), [(1, 10), (2, 1), (3, 10), (4, 1)])
def test_scores_of_any_order(spark, monkeypatch, order, group_bits):
    """Also with tables of two partitions only, so that counts go up and down several levels."""
    monkeypatch.setattr(lm_scoring, "BLOCK_WORDS", 300)
    monkeypatch.setattr(lm_scoring, "GROUP_BITS", group_bits)
    rng = random.Random(order)
    pairs = ODD + [(100 + i, " ".join(rng.choice("abcde") for _ in range(rng.randint(0, 40)))) for i in range(150)]
    assert len(lm_scoring.levels(8)) == (1 if group_bits == 10 else 3)
    df = table(spark, pairs).repartition(8).checkpoint()
    got = sorted((r["doc_id"] or 0, r["n_words"], r["score_micro"] / 1e6) for r in lm_scoring.lm_scores(df, order=order).collect())
    for a, b in zip(got, slow_scores(pairs, order), strict=True):
        assert a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-5 * (a[1] + 1)
    assert lm_scoring.lm_scores(table(spark, [])).count() == 0


def test_scores_of_a_shuffled_frame_and_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "TEXT_PART", 64)
    pairs = [(i, f"some words {i % 7} and others {i % 11}") for i in range(200)] + [(999, "a long text " * 5000)]
    got = sorted((r["doc_id"], r["n_words"], r["score_micro"] / 1e6) for r in lm_scoring.lm_scores(table(spark, pairs).repartition(5)).collect())
    for a, b in zip(got, slow_scores(pairs, 3), strict=True):
        assert a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-5 * (a[1] + 1)


TURNS = [
    ("c", 0, "system", "Be kind <|end|>", "x"), ("c", 1, "ann", "Hello", "x"), ("c", 2, "bob lee", "Hi Ann", "x"), ("c", 300, "ann", None, "x"),
    ("c", 2, "bob lee", "Hi Ann", "x"), ("d", 0, "system", "alone", "x"), (None, None, None, "lost", "x"), ("e", 5, "ann", "é😀", "x"),
]


def test_each_speaker_is_once_the_assistant(spark):
    df = spark.createDataFrame(TURNS, "conv_id string, turn bigint, role string, text string, start string")
    got = chat_format.rotate(df).collect()
    whole = defaultdict(list)
    for r in got:
        whole[r["conv_id"], r["perspective"]].append(r)
    assert set(whole) == {("c", "ann"), ("c", "bob lee"), (None, "unknown"), ("e", "ann")}
    for (_, me), rows in whole.items():
        rows.sort(key=lambda r: r["start"])
        text = "".join(r["segment"] for r in rows)
        at = 0
        for r in rows:
            assert r["start"] == at
            at += len(r["segment"])
            said = text[r["mask_start"] : r["mask_start"] + r["mask_length"]]
            assert said.endswith("<|end|>") == (r["role"] == "assistant") and (r["role"] == "user") == bool(r["name"])
        masked = "".join(text[r["mask_start"] : r["mask_start"] + r["mask_length"]] for r in rows)
        assert masked.count("<|end|>") == sum(r["role"] == "assistant" for r in rows) and me != "system"
    ann = "".join(r["segment"] for r in whole["c", "ann"])
    assert ann.startswith("<|turn|>system\nBe kind < |end|><|end|>\n<|turn|>assistant\nHello<|end|>\n<|turn|>user name=bob%20lee\nHi Ann<|end|>\n")
    assert chat_format.rotate(df.limit(0)).count() == 0
    alike = spark.createDataFrame([("f", n, who, "x" * 100_000 if n else "", "x") for n, who in enumerate(("a b", "a_b", "a  b", "a%20b", "me"))], df.schema)
    shown = {r["name"] for r in chat_format.rotate(alike).collect() if r["perspective"] == "me" and r["role"] == "user"}
    assert shown == {"a%20b", "a_b", "a%20%20b", "a%2520b"}


def tidied(row):
    """The row with failing lines gone, by the rules told in Python."""
    text = "\n".join(x for x in row["text"].split("\n") if not x.strip(" \t\n\x0b\x0c\r") or line_passes(x))
    return Row(**row.asDict() | {"text": text, "n_chars": len(text)})


def test_stages_take_odd_rows(spark, data):
    """Nulls, empty and very long texts, repeats, no rows, columns with clashing names: each stage gives rows of its input's columns."""
    line = "A plain line of words that says something and then ends as all sentences should do."
    rows = [(i, t, "en", "s", 1, "row", "kept", 0.5) for i, t in [*ODD, (None, None), (11, line), (11, line), (None, line), (12, f"{line} {line.lower()} more of it."), (13, " ".join(f"w{i}" for i in range(60_000)) + ".")]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, kept string, score double")
    for frame in (docs, docs.limit(0)):
        out = frame
        for name, stage in corpus_pipeline.STAGES[:-1]:
            found = stage(spark, out, data)
            assert found.schema == docs.schema, name
            out = spark.createDataFrame(found.collect(), docs.schema)
        assert sorted((r["doc_id"], len(r["text"])) for r in out.collect()) == ([] if frame is not docs else [(11, len(line)), (13, len(rows[-1][1]))])
        pieces = corpus_pipeline.pack(spark, out, data)
        assert (pieces.count() > 0) == (frame is docs)


def test_pipeline_does_what_its_operators_say(spark, data):
    """Each stage on its own input, by brute force where the rows allow it."""
    docs = read(spark, data, "documents")
    model = queries.toxicity_model(docs, read(spark, data, "labels"))
    automaton = model.automaton()
    kept = [r for r in docs.collect() if model.score(r["text"], automaton) < 0.5]
    stage = corpus_pipeline.drop_toxic(spark, docs, data)
    assert stage.schema == docs.schema and sorted(stage.collect()) == sorted(kept)
    second = corpus_pipeline.drop_low_quality(spark, stage, data)
    good = {r["row"]["doc_id"] for r in quality_rules.quality(docs).filter("kept").collect()}
    kept = [tidied(r) for r in kept if r["doc_id"] in good]
    assert second.schema == docs.schema and sorted(second.collect()) == sorted(kept)
    last = {}
    for r in sorted(kept, key=lambda r: r["doc_id"]):
        last[r["text"]] = r
    third = corpus_pipeline.drop_copies(spark, second, data)
    assert third.schema == docs.schema and sorted(third.collect()) == sorted(last.values())
    fps = {r["doc_id"]: simhash.fingerprint((r["text"] or "").encode()) & (2**64 - 1) for r in last.values()}
    parent = {i: i for i in fps}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in fps:
        for b in fps:
            if a < b and bin(fps[a] ^ fps[b]).count("1") <= simhash.MAX_BITS:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    fourth = corpus_pipeline.drop_near_copies(spark, third, data)
    assert fourth.schema == docs.schema and {r["doc_id"] for r in fourth.collect()} == {find(i) for i in fps}
    pieces = corpus_pipeline.run(spark, data)
    assert pieces.schema == packing.SCHEMA and {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == {find(i) for i in fps}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_rules", "exact_dedup", "simhash", "packing"]


def test_every_query_runs(spark, data):
    for name, query in queries.queries().items():
        assert query(spark, data).count() > 0, name


def test_helpers(spark):
    assert numbered(["A", "a_1"], "a") == "a_2"
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    df = spark.createDataFrame([(7,), (None,)], "doc_id bigint")
    assert [r[0] for r in df.select(crc32_mod("doc_id", 4)).collect()] == [zlib.crc32(b"7") % 4, 0]
    assert toxicity.Model().score("x", toxicity.Model().automaton()) < 0.5 and exact_dedup.MAX_LEVEL == 64

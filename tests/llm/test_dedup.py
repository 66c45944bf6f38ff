"""Exact and near duplicates against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from inkveil.llm import exact_dedup, simhash

DOCS = "doc_id bigint, text string, lang string, uid bigint, sha string, row string, n int, kept boolean"


def table(spark, pairs):
    return spark.createDataFrame([(i, t, "en", 5, "x", "r", None, True) for i, t in pairs], DOCS)


def exact(pairs):
    groups = {}
    for i, t in pairs:
        groups.setdefault(t or "", []).append(i)
    return groups


PAIRS = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "b" * 70_000), (6, "b" * 70_000), (None, "a"), (7, "A"), (8, "a "), (9, "é"), (10, "é")]


def test_exact_groups(spark):
    got = exact_dedup.exact_dedup(table(spark, PAIRS)).collect()
    assert len(got) == len(PAIRS)
    want = exact(PAIRS)
    for r in got:
        text = next(t for i, t in PAIRS if i == r["id"]) or ""
        ids = want[text]
        keep = max(i for i in ids if i is not None)
        assert (r["keep_id"], r["group_size"], r["kept"]) == (keep, len(ids), r["id"] == keep)
        assert bytes(r["sha"]) == hashlib.sha256(text.encode()).digest()


def test_one_of_equal_rows_stays_with_all_its_columns(spark):
    df = table(spark, [(1, "x"), (1, "x"), (1, "x"), (None, "y"), (None, "y")])
    got = exact_dedup.exact_dedup(df).collect()
    assert sorted((r["group_size"], r["kept"]) for r in got) == [(2, False), (2, True), (3, False), (3, False), (3, True)]
    rows = exact_dedup.dedup_rows(df)
    assert rows.schema == df.schema and sorted((r["doc_id"] or 0, r["text"]) for r in rows.collect()) == [(0, "y"), (1, "x")]


def test_null_ids_of_one_text_keep_one_row(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MEMBERS", 2)
    pairs = [(None, "y")] * 7 + [(3, "z"), (3, "z"), (None, "z"), (3, "z"), (2, "z")]
    got = exact_dedup.exact_dedup(table(spark, pairs)).collect()
    assert sorted((r["keep_id"] or 0, r["group_size"], r["kept"]) for r in got) == [(0, 7, False)] * 6 + [(0, 7, True)] + [(3, 5, False)] * 4 + [(3, 5, True)]
    assert all(r["id"] == 3 for r in got if r["kept"] and r["keep_id"])


def test_no_rows(spark):
    assert exact_dedup.exact_dedup(table(spark, [])).count() == 0 and exact_dedup.dedup_rows(table(spark, [])).count() == 0


@pytest.mark.parametrize("limit", [200, 3000, 1 << 20])
def test_buckets_that_do_not_fit_are_partitioned_again(limit):
    rng = random.Random(limit)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 9))) for _ in range(600)] + ["same"] * 900
    batches = []
    for at in range(0, len(texts), 100):
        part = texts[at : at + 100]
        row = pa.StructArray.from_arrays([pa.array(part)], ["text"])
        uid = pa.array(range(at, at + len(part)), pa.int64())
        batches.append(pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(t.encode()).digest() for t in part]), uid, uid, pa.array([1] * len(part), pa.int64()), row], names=["sha", "id", "uid", "n", "row"]))
    out = pa.Table.from_batches(list(exact_dedup.resolve(iter(batches), "text", limit))).to_pylist()
    want = exact(enumerate(texts))
    assert {r["row"]["text"]: (r["n"], r["id"]) for r in out} == {t: (len(i), max(i)) for t, i in want.items()} and len(out) == len(want)


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    for text in ("", " \t\n", "one", "A b\x0bC", "a b c d", "a b c d e a b c d e", "ÀÉ x y z w", "w " * 5000 + "end"):
        assert simhash.fingerprint(text.encode()) & (2**64 - 1) == slow_fingerprint(text)


def brute_components(fps):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= simhash.MAX_BITS:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("block", [2000, 20])
def test_links_connect_what_brute_force_does(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(block)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(240):  # chains and a dense group around the first
        base = rng.choice(fps[:5]) if rng.random() < 0.5 else rng.choice(fps)
        for b in rng.sample(range(64), rng.randint(0, 5)):
            base ^= 1 << b
        fps.append(base)
    fps = sorted(set(fps))
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    nodes = spark.createDataFrame([(f,) for f in signed], "fp bigint")
    labels = {r["node"]: r["root"] for r in simhash.components(simhash.links(nodes)).collect()}
    got = [labels.get(f, f) for f in signed]
    want = brute_components(fps)
    assert len(set(got)) == len(set(want)) and len(set(zip(got, want, strict=True))) == len(set(got))


def test_near_duplicates_of_odd_rows(spark):
    words = " ".join(f"w{i}" for i in range(400))
    pairs = [(5, words), (3, words), (9, words.replace("w7 ", "v7 ")), (4, None), (2, "  "), (None, words), (8, "quite another text of several words"), (8, "quite another text of several words")]
    df = table(spark, pairs)
    got = sorted((r["doc_id"] or 0, r["component_id"]) for r in simhash.near_duplicates(df).collect())
    assert got == [(0, 3), (2, 2), (3, 3), (4, 2), (5, 3), (8, 8), (8, 8), (9, 3)]
    kept = simhash.one_of_each(df)
    assert kept.schema == df.schema and sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 8]
    apart = table(spark, [(1, words), (7, words), (7, "an id that another text has as well"), (None, "without an id"), (None, "without an id")])
    assert sorted((r["doc_id"] or 0, len(r["text"])) for r in simhash.one_of_each(apart.repartition(3)).collect()) == [(0, 13), (1, len(words)), (7, 35)]
    assert simhash.near_duplicates(table(spark, [])).count() == 0

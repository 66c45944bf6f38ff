"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint of 64 bits is cut into three segments, so that two fingerprints
with at most four differing bits have a segment with at most one. Each segment
is indexed under all its variants with one bit left open; an equality join on
those finds every pair, and the full fingerprints verify it.

The join never spells out the pairs of a group. Equal fingerprints are one node
first. A key's rows go to one task in blocks of bounded size: keys with more
rows than a block are split into tiles of two blocks, so that every pair meets
in some tile. Within a tile a search from one fingerprint to all it links with
emits a spanning star of each connected part, n - 1 links for n members, and
connectivity is all that components need.

Components come from minimum labels with pointer jumping, written to the shared
checkpoint folder each round; the loop ends when no label changes.

Defined cases: null or blank text has fingerprint zero and links like any other;
fewer words than a shingle make one shingle of all; texts are read whole, as bytes,
also those that are no UTF-8; rows that repeat an id are named together; a null id
is never a component's smallest id unless it has no other; other columns are not
read; an empty table gives an empty result. A fingerprint of very many rows, such as
zero where many texts are blank, is one node; what its rows' last join has of
skew is split by adaptive execution alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import cut, numbered, prepare, spread, stable

SHINGLE = 4
SEED = 42
MAX_BITS = 4
#: (first bit, bits) of the three segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Rows of one key that one block holds.
BLOCK = 2000

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: bytes) -> int:
    """Signed 64 bits, each the majority of the shingles' hash bits (over half of them)."""
    words = _WORD.findall(text.translate(_LOWER))
    if not words:
        return 0
    joined = b" ".join(words)
    ends, at = [], -1
    for w in words:
        at += 1 + len(w)
        ends.append(at)
    hash64 = xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        hashes = [hash64(joined, SEED)]
    else:
        starts = [0, *[e + 1 for e in ends[: len(ends) - SHINGLE]]]
        hashes = [hash64(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :], strict=True)]
    h = np.array(hashes, dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 15):  # a bounded part at a time
        ones += np.unpackbits(h[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        fps = pa.array([fingerprint(t or b"") for t in texts], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), fps], names=["doc_id", "row", "fp"])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", row=None) -> DataFrame:
    """doc_id, row, fp; row is an expression that tells rows apart, null if none is given."""
    prepare(df.sparkSession)
    row = F.lit(None).cast("long") if row is None else row
    slim = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), row.alias("row"))
    return spread(slim).mapInArrow(_fingerprints, "doc_id long, row long, fp long")


def _segment(fp, k: int):
    first, bits = SEGMENTS[k]
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << bits) - 1))


def _variant(value, k: int, bit: int):
    """The key of a segment with one bit left open: segment, bit and the other bits' value."""
    bits = SEGMENTS[k][1]
    return value.bitwiseAND(F.lit(((1 << bits) - 1) ^ (1 << bit))).bitwiseOR(F.lit(k << 27 | bit << 22)).cast("int")


def _variants(fp, only: int | None = None, value=None):
    which = range(len(SEGMENTS)) if only is None else [only]
    return F.array(*[_variant(_segment(fp, k) if value is None else value, k, bit) for k in which for bit in range(SEGMENTS[k][1])])


def _heavy(nodes: DataFrame) -> DataFrame:
    """Keys of more rows than a block holds, with their number of blocks: key, blocks.

    A key's rows are those of two segment values, so the values are counted, not the variants.
    """
    values = nodes.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), _segment(F.col("fp"), k).alias("v")) for k in range(len(SEGMENTS))])).alias("s"))
    counts = values.groupBy("s.k", "s.v").count().filter(F.col("count") > BLOCK // 2)
    keys = F.lit(None)
    for k in reversed(range(len(SEGMENTS))):
        keys = F.when(F.col("k") == k, _variants(None, k, F.col("v"))).otherwise(keys)
    spelt = counts.select(F.explode(keys).alias("key"), "count")
    sums = spelt.groupBy("key").agg(F.sum("count").alias("rows"))
    return sums.filter(F.col("rows") > BLOCK).select("key", F.ceil(F.col("rows") / BLOCK).cast("int").alias("blocks"))


def star_links(fps: np.ndarray) -> Iterator[tuple[int, int]]:
    """(member, root) for each connected part of distinct fingerprints; holds one row of distances at a time."""
    left = np.sort(fps).view(np.uint64)
    while len(left) > 1:
        root, left = left[0], left[1:]
        frontier = [root]
        while frontier and len(left):
            near = np.bitwise_count(left ^ frontier.pop()) <= MAX_BITS
            if near.any():
                found = left[near]
                left = left[~near]
                for x in found.view(np.int64).tolist():
                    yield x, int(root.astype(np.int64))
                frontier.extend(found)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by (key, tile); a group may go over batch ends."""

    def flush(group: np.ndarray, fp: np.ndarray) -> pa.RecordBatch | None:
        if len(fp) < 2:
            return None
        bounds = np.flatnonzero(np.diff(group)) + 1
        starts, ends = np.r_[0, bounds], np.r_[bounds, len(fp)]
        sizes = ends - starts
        a, b = [], []
        small = sizes[sizes > 1]
        for lag in range(1, 4):  # pairs of groups of two to four rows, all groups at once
            i = np.flatnonzero(group[lag:] == group[:-lag]) if len(small) else np.array([], dtype=int)
            size = np.repeat(sizes, sizes)[i]
            i = i[size <= 4]
            i = i[np.bitwise_count((fp[i] ^ fp[i + lag]).view(np.uint64)) <= MAX_BITS]
            a.append(np.maximum(fp[i], fp[i + lag]))
            b.append(np.minimum(fp[i], fp[i + lag]))
        stars = [x for k in np.flatnonzero(sizes > 4) for x in star_links(fp[starts[k] : ends[k]])]
        if stars:
            s = np.array(stars, dtype=np.int64)
            a.append(s.max(axis=1))
            b.append(s.min(axis=1))
        pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    held_g, held_f = np.array([], dtype=np.int64), np.array([], dtype=np.int64)
    for batch in batches:
        g = (batch.column(0).to_numpy().astype(np.int64) << 32) | batch.column(1).to_numpy().astype(np.int64)
        held_g, held_f = np.concatenate([held_g, g]), np.concatenate([held_f, batch.column(2).to_numpy()])
        if len(held_g) < 50_000:
            continue
        last = int(np.searchsorted(-(held_g == held_g[-1]).astype(np.int8)[::-1], 0)) if held_g[0] != held_g[-1] else len(held_g)
        whole = len(held_g) - last
        if whole and (out := flush(held_g[:whole], held_f[:whole])):
            yield out
        held_g, held_f = held_g[whole:], held_f[whole:]
    if out := flush(held_g, held_f):
        yield out


def links(nodes: DataFrame) -> DataFrame:
    """Links that connect whatever fingerprints of nodes.fp are within MAX_BITS: a > b, distinct."""
    heavy = cut(_heavy(nodes))
    rows = nodes.select(F.explode(_variants(F.col("fp"))).alias("key"), "fp")
    if heavy.isEmpty():
        rows = rows.withColumn("tile", F.lit(0))
    else:
        rows = rows.join(heavy, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        own = F.pmod(F.xxhash64("fp", F.lit("block")), F.col("blocks")).cast("int")
        tiles = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.least(j, own) * F.col("blocks") + F.greatest(j, own))
        rows = rows.withColumn("tile", F.explode(tiles))
    dealt = rows.select("key", "tile", "fp").repartition("key", "tile").sortWithinPartitions("key", "tile")
    return dealt.mapInArrow(_links, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of the edges (a, b); root is the component's smallest node."""
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        # Each node takes the least label among its neighbours' and its own ...
        told = both.join(labels, both["b"] == labels["node"]).select(F.col("a").alias("node"), "root")
        least = cut(told.union(labels.select("node", "root")).groupBy("node").agg(F.min("root").alias("root")))
        # ... and then its label's label. Both sides of each join come straight from a written table, so hot labels can be split.
        up = least.select(F.col("node").alias("of"), F.col("root").alias("top"))
        jumped = least.join(up, least["root"] == up["of"], "left").select("node", F.least("root", "top").alias("root"))
        jumped = cut(jumped)
        same = labels.select("node", F.col("root").alias("was"))
        moved = jumped.join(same, "node").filter(F.col("root") != F.col("was")).limit(1).count()
        labels = jumped
        if not moved:
            return labels


def _named(docs: DataFrame) -> DataFrame:
    """docs (doc_id, row, fp) with root, the least fingerprint of the component, and component_id, its smallest doc_id."""
    nodes = cut(docs.groupBy("fp").agg(F.min("doc_id").alias("least")))
    labels = components(links(nodes.select("fp")))
    rooted = cut(nodes.join(labels, nodes["fp"] == labels["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    tops = cut(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    named = cut(rooted.join(tops, "root").select("fp", "root", "component_id"))
    return docs.join(named, "fp")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id (the component's smallest doc_id)."""
    named = _named(cut(fingerprints(df, id_col, text_col)))
    return named.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component: of those with its smallest id the first; a row without an id stays only where all have none.

    Rows are known by their places, so df must be read in equal order again: a
    plain scan is, and any other frame is written first.
    """
    base, mark = stable(df), numbered(df.columns, "kept_row")
    named = _named(cut(fingerprints(base, id_col, text_col, F.monotonically_increasing_id())))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row"))
    stay = named.groupBy("root").agg(first.alias("first")).select(F.col("first.row").alias(mark))
    return base.withColumn(mark, F.monotonically_increasing_id()).join(stay, mark, "left_semi").select(*[F.col(f"`{c}`") for c in df.columns])

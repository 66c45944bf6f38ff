"""Stupid-backoff language-model scores of a corpus against its own counts.

Every document's n-grams are exploded, counted in tables partitioned by hash,
joined to those tables by hash, and summed per document. Rows travel in pages: a
block of documents explodes into its distinct n-gram hashes with their counts
(the map-side part of the count), one page for each hash range. The task of a
range adds its pages up to the count table of that range, joins each page to the
table, and sends the page's counts back to its block, which sums them over its
documents. Nothing is as large as the exploded n-grams, a common n-gram is one
entry a block, and the count tables grow with the corpus.

Pages would grow with the square of the input if every block dealt to every
range. So ranges are those of a group of GROUP partitions; where there are more
groups, a range's table in one group is itself dealt, by further bits of the
hash, to tables over GROUP groups, and so on up; the counts come back down the
same way. A page has about as many entries at any size of the input.

A token is scored by the longest n-gram that occurs elsewhere too: its own
occurrence does not count. With c the corpus counts, an n-gram g with context h
gives (c(g) - 1) / (c(h) - 1); each shorter order costs a factor 0.4; a word
that occurs nowhere else gives 1 / N. Logarithms are added in millionths, as
integers, so that sums do not depend on order. N-grams are known by 64 bits of a
hash of their words (A-Z lower-cased).

Blocks are read twice, once for their n-grams and once for their documents, so
the input must give equal rows in equal order again: a plain scan does, and any
other frame is written to the shared folder first.

Defined cases: null or blank text has no words and score 0; words are split as
bytes, so bytes that are no UTF-8 belong to their words; n-grams do not cross
documents; repeated rows and rows with equal ids are scored and counted each; a
text of any length is one document in one block; other columns are not read; an
empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import cut, partitions, prepare, stable

ORDER = 3
BACKOFF = 0.4
#: Words of a block; a block holds one whole document at least.
BLOCK_WORDS = 1_750_000
#: Partitions, or groups of them, whose n-grams meet in one count table, as a power of two.
GROUP_BITS = 10
#: Hash ranges for each partition of a group.
RANGES = 8
#: Bytes of text whose words are taken apart at once.
TEXT_PART = 1 << 22
#: Millionths of a natural logarithm.
SCALE = 1_000_000

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _pack(values: np.ndarray) -> bytes:
    """Unsigned integers as byte planes, which compress where high bytes are alike."""
    wide = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T)
    return zstandard.compress(wide.tobytes(), 1)


def _unpack(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(size, -1).T).view(kind).ravel()


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ (a >> np.uint64(29))) * _ODD + b
    x ^= x >> np.uint64(32)
    return x * _MIX


def ngrams(words: np.ndarray, lengths: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For n from 1 to order: the hash of the n-gram that ends at each place, and whether there is one."""
    place = np.arange(len(words)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    found = [(words, place >= 0)]
    for n in range(2, order + 1):
        longer = np.zeros_like(words)
        if len(words) >= n:
            longer[n - 1 :] = _mixed(found[-1][0][n - 2 : -1], words[n - 1 :])
        found.append((longer, place >= n - 1))
    return found


class _Hasher:
    """Hashes of words, those of frequent words remembered."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def _part(self, text: bytes) -> np.ndarray:
        words = _WORD.findall(text.translate(_LOWER))
        known, hashed = self.known, xxhash.xxh64_intdigest
        if len(known) > 300_000:
            known.clear()
        for w in set(words).difference(known):
            known[w] = hashed(w)
        return np.array(list(map(known.__getitem__, words)), dtype=np.uint64)

    def __call__(self, text: bytes) -> np.ndarray:
        if len(text) <= TEXT_PART:
            return self._part(text)
        parts, at = [], 0
        while at < len(text):
            m = _BLANK.search(text, at + TEXT_PART)
            end = m.start() if m else len(text)
            parts.append(self._part(text[at:end]))
            at = end
        return np.concatenate(parts)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, np.ndarray, np.ndarray]]:
    """(block, doc ids, words of each, word hashes): the same blocks whenever the input is read again."""
    hasher, block = _Hasher(), TaskContext.get().partitionId() << 32
    ids, lengths, parts, n = [], [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            words = hasher(text or b"")
            ids.append(doc_id)
            lengths.append(len(words))
            parts.append(words)
            n += len(words)
            if n >= BLOCK_WORDS:
                yield block, ids, np.array(lengths), np.concatenate(parts)
                block, ids, lengths, parts, n = block + 1, [], [], [], 0
    if ids:
        yield block, ids, np.array(lengths), np.concatenate(parts)


def _distinct(words: np.ndarray, lengths: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of a block, all orders together, and their counts."""
    every = np.sort(np.concatenate([h[there] for h, there in ngrams(words, lengths, order)]))
    first = np.flatnonzero(np.r_[True, every[1:] != every[:-1]]) if len(every) else np.array([], dtype=np.int64)
    return every[first], np.diff(np.r_[first, len(every)])


def _aligned(every: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each hash its count, where counts go with the sorted distinct hashes. Sorting beats searching here."""
    order = np.argsort(every)
    ranked = every[order]
    out = np.empty(len(every), dtype=np.int64)
    out[order] = counts[np.cumsum(np.r_[False, ranked[1:] != ranked[:-1]])] if len(every) else 0
    return out


#: A page: grp and unit name the count table it goes to, node the block or the lower table it comes from.
_PAGE = "grp long, unit long, kind int, node long, one binary, two binary"
#: A page's counts on their way back.
_TOLD = "node long, unit long, one binary"
_DOCS = "doc_id long, n_words long, micro long, n_unigram long, n_unseen long"
_ARROW = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[kind]) for c, (_, kind) in zip(zip(*rows, strict=True), fields, strict=True)], names=[name for name, _ in fields])


def levels(parts: int) -> list[int]:
    """Bits of the hash that each level of count tables is dealt by, lowest level first."""
    group = 1 << GROUP_BITS
    bits, groups = [max(4, (RANGES * min(parts, group) - 1).bit_length())], -(-parts // group)
    while groups > 1:
        bits.append((min(groups, group) - 1).bit_length())
        groups = -(-groups // group)
    return bits


def _pages(grp: int, node: int, prefix: int, bits: int, done: int, hashes: np.ndarray, counts: np.ndarray) -> Iterator[tuple]:
    """Pages of sorted hashes that begin with the done bits of prefix, dealt by the next bits."""
    units = np.arange(1, 1 << bits, dtype=np.uint64) + np.uint64(prefix << bits)
    edges = np.r_[0, np.searchsorted(hashes, units << np.uint64(64 - done - bits)), len(hashes)]
    counts = counts.astype("<u8")
    for k in np.flatnonzero(np.diff(edges)):
        h = hashes[edges[k] : edges[k + 1]]
        yield grp, (prefix << bits) + int(k), 0, node, _pack(np.r_[h[:1], np.diff(h)].astype("<u8")), _pack(counts[edges[k] : edges[k + 1]])


def _exploded(batches, order: int, bits: int) -> Iterator[pa.RecordBatch]:
    """The pages of each block: its distinct n-grams by hash range."""
    for block, _, lengths, words in _blocks(batches):
        if rows := list(_pages(block >> 32 + GROUP_BITS, block, 0, bits, 0, *_distinct(words, lengths, order))):
            yield _batch(rows, _PAGE)


def _by(batches, keys: tuple[str, ...]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of sorted batches, grouped by their keys."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            at = [batch.schema.names.index(k) for k in keys]
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield tuple(row[k] for k in at), row

    for key, group in itertools.groupby(rows(), key=lambda x: x[0]):
        yield key, [row for _, row in group]


def _hashes(pages: list[tuple]) -> list[np.ndarray]:
    return [np.cumsum(_unpack(p[4], "<u8"), dtype=np.uint64) for p in pages]


def _count_table(hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The count table of pages: sorted distinct hashes and their sums; and for each entry of the pages its place in the table."""
    every = np.concatenate(hashes)
    ranked = np.sort(every)
    table = ranked[np.r_[True, ranked[1:] != ranked[:-1]]]
    place = np.searchsorted(table, every)
    return table, np.bincount(place, weights=np.concatenate(counts), minlength=len(table)).astype("<u8"), place


def _told(pages: list[tuple], hashes: list[np.ndarray], sums: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """Each page joined to the table: its n-grams' counts, in their order."""
    parts = np.split(sums[place], np.cumsum([len(h) for h in hashes])[:-1])
    return _batch([(p[3], p[1], _pack(c)) for p, c in zip(pages, parts, strict=True)], _TOLD)


def _joined(batches) -> Iterator[pa.RecordBatch]:
    """The highest count tables: each page gets its counts."""
    for _, pages in _by(batches, ("grp", "unit")):
        hashes = _hashes(pages)
        _, sums, place = _count_table(hashes, [_unpack(p[5], "<u8") for p in pages])
        yield _told(pages, hashes, sums, place)


def _raised(batches, bits: int, done: int) -> Iterator[pa.RecordBatch]:
    """Lower count tables as pages for the next level."""
    for (grp, unit), pages in _by(batches, ("grp", "unit")):
        table, sums, _ = _count_table(_hashes(pages), [_unpack(p[5], "<u8") for p in pages])
        yield _batch(list(_pages(grp >> GROUP_BITS, grp, unit, bits, done, table, sums)), _PAGE)


def _lowered(batches) -> Iterator[pa.RecordBatch]:
    """Lower count tables again, with the counts that came back for them in place of their own."""
    for _, rows in _by(batches, ("grp", "unit")):
        pages = [r for r in rows if r[2] == 0]
        hashes = _hashes(pages)
        sums = np.concatenate([_unpack(r[4], "<u8") for r in rows if r[2] == 1])
        _, _, place = _count_table(hashes, [np.zeros(len(h)) for h in hashes])
        yield _told(pages, hashes, sums, place)


def _counted(pages: DataFrame, bits: list[int], level: int = 0) -> DataFrame:
    """The counts of every page's n-grams over the whole corpus: node, unit, one."""
    dealt = pages.repartition("grp", "unit").sortWithinPartitions("grp", "unit")
    if level == len(bits) - 1:
        return dealt.mapInArrow(_joined, _TOLD)
    more, done = bits[level + 1], sum(bits[: level + 1])
    back = _counted(dealt.mapInArrow(lambda b: _raised(b, more, done), _PAGE), bits, level + 1)
    back = back.select(F.col("node").alias("grp"), F.shiftright("unit", more).alias("unit"), F.lit(1).alias("kind"), F.col("unit").alias("node"), "one", F.lit(None).cast("binary").alias("two"))
    met = pages.union(back).repartition("grp", "unit").sortWithinPartitions("grp", "unit", "kind", "node")
    return met.mapInArrow(_lowered, _TOLD)


def _documents(batches) -> Iterator[pa.RecordBatch]:
    """A row for each block: its documents as codes into its distinct words, frequent ones first. Unit -1 sorts first."""
    for block, ids, lengths, words in _blocks(batches):
        distinct, codes, n = np.unique(words, return_inverse=True, return_counts=True)
        order = np.argsort(-n, kind="stable")
        rank = np.empty(len(order), dtype="<u4")
        rank[order] = np.arange(len(order), dtype="<u4")
        known = np.array([d is not None for d in ids], dtype=np.uint8)
        head = np.array([len(ids), len(distinct)], dtype="<i8").tobytes()
        one = head + np.array([d or 0 for d in ids], dtype="<i8").tobytes() + known.tobytes() + lengths.astype("<i8").tobytes() + distinct[order].tobytes()
        yield _batch([(block, -1, zstandard.compress(one, 1), _pack(rank[codes]))], f"{_TOLD}, two binary")


def _scores(batches, order: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (node, unit): a block's documents, then the counts of its distinct n-grams. Sums per document."""
    for _, rows in _by(batches, ("node",)):
        one, two = rows[0][2:]
        raw = zstandard.decompress(one)
        n, m = np.frombuffer(raw[:16], "<i8")
        ids, known = np.frombuffer(raw, "<i8", n, 16), np.frombuffer(raw, np.uint8, n, 16 + 8 * n)
        lengths = np.frombuffer(raw, "<i8", n, 16 + 9 * n)
        words = np.frombuffer(raw[16 + 17 * n :], "<u8", m)[_unpack(two, "<u4")] if m else np.array([], dtype=np.uint64)
        grams = [(h[there], there) for h, there in ngrams(words, lengths, order)]
        totals = np.concatenate([_unpack(r[2], "<u8") for r in rows[1:]]).astype(np.int64) if len(rows) > 1 else np.array([], dtype=np.int64)
        counts = np.split(_aligned(np.concatenate([h for h, _ in grams]), totals), np.cumsum([len(h) for h, _ in grams])[:-1])
        micro = np.zeros(len(words), dtype=np.int64)
        level = np.zeros(len(words), dtype=np.int64)  # the order that scored the token; 0: none
        context = None
        for k, ((_, there), found) in enumerate(zip(grams, counts, strict=True), 1):
            own = np.zeros(len(words), dtype=np.int64)
            own[there] = found
            seen = own > 1
            if k == 1:
                value = np.log(np.maximum(own - 1, 1))
            else:
                before = np.r_[np.int64(1), context[:-1]] if len(context) else context
                value = np.log(np.maximum(own - 1, 1) / np.maximum(before - 1, 1))
            micro = np.where(seen, np.floor(value * SCALE + 0.5).astype(np.int64), micro)
            level = np.where(seen, k, level)
            context = own
        place = np.arange(len(words)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        most = np.minimum(place + 1, order)
        doc = np.repeat(np.arange(n), lengths)
        micro += np.int64(np.floor(np.log(BACKOFF) * SCALE + 0.5)) * (most - np.maximum(level, 1))
        total = np.zeros(n, dtype=np.int64)
        np.add.at(total, doc, micro)
        one_word, none = (np.bincount(doc[level == k], minlength=n) for k in (1, 0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, mask=known == 0), *[pa.array(x.astype(np.int64)) for x in (lengths, total, one_word, none)]],
            names=["doc_id", "n_words", "micro", "n_unigram", "n_unseen"],
        )


def lm_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """Per row: doc_id, n_words, n_unigram and n_unseen (tokens scored so), score_micro (log score in millionths)."""
    prepare(df.sparkSession)
    slim = stable(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    bits = levels(partitions(slim))
    pages = slim.mapInArrow(lambda b: _exploded(b, order, bits[0]), _PAGE)
    told = _counted(pages, bits).withColumn("two", F.lit(None).cast("binary"))
    both = slim.mapInArrow(_documents, f"{_TOLD}, two binary").union(told)
    met = both.repartition("node").sortWithinPartitions("node", "unit")
    raw = cut(met.mapInArrow(lambda b: _scores(b, order), _DOCS))
    n = raw.agg(F.sum("n_words")).first()[0] or 0
    less = F.lit(int(np.floor(np.log(max(n - 1, 1)) * SCALE + 0.5))) * F.col("n_unigram")
    rare = F.lit(int(np.floor(np.log(max(n, 1)) * SCALE + 0.5))) * F.col("n_unseen")
    return raw.select("doc_id", "n_words", "n_unigram", "n_unseen", (F.col("micro") - less - rare).alias("score_micro"))


#: DuckDB: the same sums by exploding, counting and joining rows.
ORACLE_SQL = f"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
tok AS (
  SELECT doc_id, i, w[i] AS a1,
         CASE WHEN i > 1 THEN w[i-1] || ' ' || w[i] END AS a2,
         CASE WHEN i > 2 THEN w[i-2] || ' ' || w[i-1] || ' ' || w[i] END AS a3
  FROM docs, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS i)),
c1 AS (SELECT a1, count(*) AS n FROM tok GROUP BY a1),
c2 AS (SELECT a2, count(*) AS n FROM tok WHERE a2 IS NOT NULL GROUP BY a2),
c3 AS (SELECT a3, count(*) AS n FROM tok WHERE a3 IS NOT NULL GROUP BY a3),
counted AS (
  SELECT doc_id, i, c1.n AS n1, coalesce(c2.n, 0) AS n2, coalesce(c3.n, 0) AS n3,
         lag(c1.n) OVER o AS p1, lag(c2.n) OVER o AS p2
  FROM tok JOIN c1 USING (a1) LEFT JOIN c2 USING (a2) LEFT JOIN c3 USING (a3)
  WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
scored AS (
  SELECT doc_id,
         CASE WHEN n3 > 1 THEN 3 WHEN n2 > 1 THEN 2 WHEN n1 > 1 THEN 1 ELSE 0 END AS level,
         CASE WHEN n3 > 1 THEN floor(ln((n3 - 1)::DOUBLE / (p2 - 1)) * {SCALE} + 0.5)
              WHEN n2 > 1 THEN floor(ln((n2 - 1)::DOUBLE / (p1 - 1)) * {SCALE} + 0.5)
              WHEN n1 > 1 THEN floor(ln((n1 - 1)::DOUBLE) * {SCALE} + 0.5) ELSE 0 END::BIGINT AS micro,
         least(i, 3) AS most
  FROM counted),
total AS (SELECT count(*) AS n FROM tok),
summed AS (
  SELECT doc_id, count(*) AS n_words,
         sum(micro + floor(ln({BACKOFF}) * {SCALE} + 0.5)::BIGINT * (most - greatest(level, 1))) AS micro,
         count(*) FILTER (level = 1) AS n_unigram, count(*) FILTER (level = 0) AS n_unseen
  FROM scored GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_unigram, 0)::BIGINT AS n_unigram,
       coalesce(n_unseen, 0)::BIGINT AS n_unseen,
       coalesce(micro - n_unigram * floor(ln(greatest(n - 1, 1)::DOUBLE) * {SCALE} + 0.5)::BIGINT
                      - n_unseen * floor(ln(greatest(n, 1)::DOUBLE) * {SCALE} + 0.5)::BIGINT, 0)::BIGINT AS score_micro
FROM docs d LEFT JOIN summed USING (doc_id) CROSS JOIN total
"""

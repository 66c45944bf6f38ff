"""Packing by minimum bin slack.

Each document's ids, its end id included, are cut into pieces of at most one
sequence; full pieces are sequences already. The rest wait in a bounded window.
To fill a sequence, the longest waiting piece goes in, and dynamic programming
over a bitset of reachable sums finds the multiset of the other lengths that
comes closest to the capacity left; each length counts as often as it waits, in
binary multiples, and stored bitsets give the chosen counts by walking back. If
too few pieces wait to come close, the shortest of them is cut to fill the rest.

A partition packs its own rows, as sequences are independent, so there is no
shuffle. What remains at its end is one part of a sequence at most a partition:
it is cut at powers of two, where sequences need no padding.

Defined cases: null or empty text packs as the end id alone; rows with equal
ids, and equal rows, are packed one by one; very long texts give many full pieces;
bytes that are no UTF-8 are read as the replacement character; of multisets that
leave equal slack the one with longer pieces is taken; other columns are not read;
an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from array import array
from collections import defaultdict, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkveil.llm.bpe import library_ids
from inkveil.llm.common import prepare, spread, texts_of

CAPACITY = 4096
#: Pieces that wait at once.
WINDOW = 512
#: Slack that no multiset can fill and that is worth cutting a waiting piece for.
MAX_SLACK = 32
END = 2

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        *[T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")],
    ]
)


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many of each length to take so that their sum comes closest to capacity without passing it.

    Bit s of ``reach`` says that sum s is reachable. A count c becomes multiples
    1, 2, 4, ... and the rest, so every number up to c is expressible.
    """
    mask = (1 << (capacity + 1)) - 1
    reach, full = 1, 1 << capacity
    steps: list[tuple[int, int, int]] = []
    for length in sorted(counts, reverse=True):
        left, times = min(counts[length], capacity // length), 1
        while left and not reach & full:
            k = min(times, left)
            steps.append((length, k, reach))
            reach |= (reach << (length * k)) & mask
            left, times = left - k, 2 * times
    total = reach.bit_length() - 1
    chosen: dict[int, int] = defaultdict(int)
    for length, k, before in reversed(steps):
        if not (before >> total) & 1:
            chosen[length] += k
            total -= length * k
    return dict(chosen)


class Packer:
    """Pieces in, sequences out; a piece is (doc_id, start, ids crc, doc_tokens) under its length."""

    def __init__(self, capacity: int = CAPACITY, window: int = WINDOW, first_id: int = 0):
        self.capacity, self.window, self.next = capacity, window, first_id
        self.waiting: dict[int, deque] = defaultdict(deque)
        self.n, self.total = 0, 0

    def _place(self, pieces: list[tuple]) -> Iterator[tuple]:
        at = 0
        for length, (doc_id, start, ids, doc_tokens) in pieces:
            yield doc_id, start, length, zlib.crc32(ids), doc_tokens, self.next, at
            at += length
        self.next += 1

    def add(self, doc_id, ids: array) -> Iterator[tuple]:
        n = len(ids)
        for start in range(0, n, self.capacity):
            part = ids[start : start + self.capacity]
            if len(part) == self.capacity:
                yield from self._place([(len(part), (doc_id, start, part.tobytes(), n))])
            else:
                self._wait(len(part), (doc_id, start, part.tobytes(), n))
        while self.n > self.window:
            yield from self.sequence()

    def _wait(self, length: int, piece: tuple) -> None:
        self.waiting[length].append(piece)
        self.n, self.total = self.n + 1, self.total + length

    def _take(self, length: int) -> tuple:
        queue = self.waiting[length]
        piece = queue.popleft()
        if not queue:
            del self.waiting[length]
        self.n, self.total = self.n - 1, self.total - length
        return length, piece

    def sequence(self) -> Iterator[tuple]:
        """The longest waiting piece and the multiset that leaves least slack beside it."""
        pieces = [self._take(max(self.waiting))]
        chosen = fill({n: len(q) for n, q in self.waiting.items()}, self.capacity - pieces[0][0])
        for length, k in chosen.items():
            pieces += [self._take(length) for _ in range(k)]
        slack = self.capacity - sum(length for length, _ in pieces)
        if slack > MAX_SLACK and self.waiting:
            # Whatever still waits is longer than the slack, or it would have been chosen.
            length, (doc_id, start, ids, doc_tokens) = self._take(min(self.waiting))
            pieces.append((slack, (doc_id, start, ids[: 4 * slack], doc_tokens)))
            self._wait(length - slack, (doc_id, start + slack, ids[4 * slack :], doc_tokens))
        yield from self._place(pieces)

    def finish(self) -> Iterator[tuple]:
        while self.total >= self.capacity:
            yield from self.sequence()
        rest = [self._take(length) for length in sorted(self.waiting, reverse=True) for _ in range(len(self.waiting[length]))]
        room, total = 0, sum(length for length, _ in rest)
        pieces: list[tuple] = []
        for length, (doc_id, start, ids, doc_tokens) in rest:
            at = 0
            while at < length:
                if not room:
                    yield from self._place(pieces) if pieces else ()
                    pieces, room = [], 1 << (total.bit_length() - 1)
                k = min(room, length - at)
                pieces.append((k, (doc_id, start + at, ids[4 * at : 4 * (at + k)], doc_tokens)))
                at, room, total = at + k, room - k, total - k
        if pieces:
            yield from self._place(pieces)


def _packed(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = library_ids(path)
    packer = Packer(first_id=TaskContext.get().partitionId() << 33)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=SCHEMA.names)

    for given in batches:
        rows: list[tuple] = []
        encoded = own.encode(texts_of(given.column(1)))
        for doc_id, ids in zip(given.column(0).to_pylist(), encoded, strict=True):
            ids.append(END)
            rows += packer.add(doc_id, ids)
        if rows:
            yield batch(rows)
    if rows := list(packer.finish()):
        yield batch(rows)


def pack(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    prepare(df.sparkSession)
    slim = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    dealt = spread(slim)
    if dealt is not slim:  # dealt rows come in any order; sorted, a small table packs alike each time
        dealt = dealt.sortWithinPartitions("doc_id", F.xxhash64("text"))
    return dealt.mapInArrow(lambda b: _packed(path, b), SCHEMA)

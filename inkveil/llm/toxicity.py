"""Toxicity by a weighted lexicon, matched with Aho-Corasick.

Texts are folded first: compatibility forms to plain letters, lower case,
look-alike letters of other scripts to Latin ones, digits and signs that stand
for letters to those letters, and everything else that is no letter to one space.
A ! or | is a letter only with another right after it, so that one at a word's
end stays a sign. A text with accents is read a second time without them, as
they may be spelling or disguise, and the heavier reading counts. The lexicon holds words and beginnings of words with the
log-odds at which they mark toxic texts; exceptions that cover a match cancel it.
The matched weight, absolute and by the text's length, goes through a logistic
curve to the score.

Lexicon, exceptions and curve are learned from at most PER_CLASS labelled rows
of each class, those whose ids have the smallest hashes, each near copy once (in
a fixed order, so that rows in another order teach the same); one half finds the
entries and the other half fits the curve. Exceptions are words that begin like
an entry, and phrases of a matched word and its neighbour, which harmless texts
have and toxic ones have not. Lexicon and exceptions are as long as that sample
gives reason for. Only text enters a score.

Defined cases: null and empty texts match nothing and get the curve's score for
that; texts of any length are scored whole; bytes that are no UTF-8 count as
gaps; equal texts have equal scores, and a score of 0.5 counts as toxic; without
labels of both classes nothing is toxic; ids that repeat in the labels count once
for each row; other columns pass through untouched inside ``row``, whatever their
names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import cut, prepare, spread, texts_of, widened

#: Labelled training rows of each class, at most.
PER_CLASS = 4000
#: Letters of a word's beginning that may become an entry.
SHORTEST, LONGEST = 4, 8
#: Toxic texts that must have an entry at least, and its least log-odds; harmless texts that must have an exception phrase.
SUPPORT, LEAST_WEIGHT, EXCEPTION_SUPPORT = 3, 3.0, 3
#: Hashes that near copies are known by: texts that share one are copies.
NEAR_KEYS = 4

# Letters that look like Latin ones, and digits and signs written for letters.
LOOKALIKES = {
    "cyrillic": ("авгеклмнопрстухьѕіјһԁԛԝѵӏґҽ", "abrekjmhonpctyxbsijhdqwvlre"),
    "greek": ("αβγεηικμνοπρςστυχωϲϳ", "abyenikuvonpcotuxwcj"),
    "armenian": ("օսհոց", "ouhng"),
    "small capitals": ("ᴀʙᴄᴅᴇꜰɢʜɪᴊᴋʟᴍɴᴏᴘʀꜱᴛᴜᴠᴡʏᴢ", "abcdefghijklmnoprstuvwyz"),
    "latin": ("ɑɡɩɛəʋʌɯɾøłđħŧıȷðɔɵ", "agieeuvwrolohtijdoo"),
}
DIGRAPHS = {"æ": "ae", "œ": "oe", "ß": "ss"}
SUBSTITUTES = dict(zip("013457@$!|", "oieastasil", strict=True))
INVISIBLE = (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)

_UNSEEN = {chr(c): "" for c in (*range(0x300, 0x370), *INVISIBLE)}
_LETTERS = _UNSEEN | {a: b for odd, plain in LOOKALIKES.values() for a, b in zip(odd, plain, strict=True)}
_PLAIN = _LETTERS | DIGRAPHS
_NO_LETTER = re.compile(r"[!|]{2,}|[!|](?![^\W_]|[@$])")
_GAP = re.compile(r"[\W_]+")


def _swapped(text: str, table: dict[str, str]) -> str:
    """The text with the table's signs replaced. Few of them occur, so each that does is replaced on its own."""
    for c in table.keys() & set(text):
        text = text.replace(c, table[c])
    return text


def fold(text: str | None) -> str:
    """The folded text between single spaces, its accents kept."""
    low = (text or "").lower()
    if not low.isascii():
        low = _swapped(unicodedata.normalize("NFKC", low).lower(), _LETTERS)
    if "!" in low or "|" in low:
        low = _NO_LETTER.sub(" ", low)
    for sign, letter in SUBSTITUTES.items():
        low = low.replace(sign, letter)
    return f" {_GAP.sub(' ', low).strip()} "


def readings(folded: str) -> tuple[str, ...]:
    """A folded text, and the same without accents where it has some."""
    if folded.isascii():
        return (folded,)
    plain = _swapped(unicodedata.normalize("NFKD", folded), _PLAIN)
    return (folded, plain) if plain != folded else (folded,)


def entries(folded: str) -> set[str]:
    """What may become lexicon entries: words and their beginnings, a space marking a word's ends."""
    found = set()
    for word in {w for f in readings(folded) for w in f.split()}:
        found.add(f" {word} ")
        found.update(f" {word[:n]}" for n in range(SHORTEST, min(LONGEST, len(word)) + 1))
    return found


@dataclass
class Model:
    lexicon: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    curve: tuple[float, ...] = (-20.0, 0.0, 0.0)

    def automaton(self):
        found = ahocorasick.Automaton()
        for phrase in self.exceptions:
            found.add_word(f" {phrase} ", (len(phrase) + 2, None))
        for entry, weight in self.lexicon.items():
            found.add_word(entry, (len(entry), weight))
        found.make_automaton()
        return found

    def matched(self, folded: str, automaton) -> dict[int, tuple[float, int]]:
        """The heaviest entry at each start, with its end, without what exceptions cover."""
        best: dict[int, tuple[float, int]] = {}
        spared: list[tuple[int, int]] = []
        if len(automaton):
            for end, (size, weight) in automaton.iter(folded):
                start = end - size + 1
                if weight is None:
                    spared.append((start, end))
                elif weight > best.get(start, (0.0, 0))[0]:
                    best[start] = (weight, end)
        if spared and best:
            spared.sort()
            starts = np.array([s for s, _ in spared])
            reach = np.maximum.accumulate([e for _, e in spared])
            at = {s: np.searchsorted(starts, s, side="right") - 1 for s in best}
            best = {s: v for s, v in best.items() if at[s] < 0 or reach[at[s]] < v[1]}
        return best

    def signs(self, text: str | None, automaton) -> tuple[float, float]:
        """Log of the matched weight, and of the weight per thousand words."""
        folded = fold(text)
        total = max(sum(w for w, _ in self.matched(f, automaton).values()) for f in readings(folded))
        return float(np.log1p(total)), float(np.log1p(1000 * total / max(1, folded.count(" ") - 1)))

    def score(self, text: str | None, automaton) -> float:
        a, b = self.signs(text, automaton)
        return float(1 / (1 + np.exp(-np.clip(self.curve[0] + self.curve[1] * a + self.curve[2] * b, -30, 30))))


def phrases(folded: str, matched: dict[int, tuple[float, int]]) -> set[str]:
    """A matched word with the word before it, and with the word after it."""
    found = set()
    for start, (_, end) in matched.items():
        stop = folded.index(" ", end if folded[end] == " " else end + 1)
        before, after = folded.rfind(" ", 0, start), folded.find(" ", stop + 1)
        if before >= 0:
            found.add(folded[before + 1 : stop])
        if after >= 0:
            found.add(folded[start + 1 : after])
    return found


def _near_keys(folded: str) -> list[int]:
    """Least hashes of the text's word triples, of several hash functions: near copies share one of them."""
    words = folded.split()
    h = np.array([xxhash.xxh64_intdigest(" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))], dtype=np.uint64)
    return [int((h * np.uint64(2 * k * 0x9E3779B97F4A7C15 + 1 & 2**64 - 1)).min() >> np.uint64(1)) for k in range(NEAR_KEYS)]


def _learn_curve(x: np.ndarray, y: np.ndarray, share: float) -> tuple[float, ...]:
    """Ridge logistic regression by Newton steps; the classes weigh as they do among all labels: share is the toxic ones'."""
    x = np.c_[np.ones(len(x)), x]
    each = np.where(y == 1, share / max(1, (y == 1).sum()), (1 - share) / max(1, (y == 0).sum()))
    w, ridge = np.zeros(3), np.diag([1e-5, 1e-4, 1e-4])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (each * p * (1 - p))[:, None]) + ridge, x.T @ (each * (p - y)) + ridge @ w)
        w = w - step
    return tuple(map(float, w))


def _lexicon(counts: DataFrame, bad: str, good: str, n_bad: int, n_good: int) -> tuple[dict[str, float], tuple[str, ...]]:
    """Entries with their weights, and harmless words that begin like an entry.

    A word that n texts have is in toxic ones only, by chance, with probability
    share ** n; an entry must be in so many toxic texts that less than one such
    word is to be expected. Longer entries that say no more than their beginning
    are left out.
    """
    weight = F.log((F.col(bad) + 0.5) / (n_bad + 1)) - F.log((F.col(good) + 0.5) / (n_good + 1))
    weighed = counts.select("entry", F.col(bad).alias("bad"), F.col(good).alias("good"), weight.alias("w"))
    candidates = weighed.filter(F.col("bad") + F.col("good") >= SUPPORT).count()
    support = math.log(max(candidates, 2)) / math.log((n_bad + n_good) / max(1, n_bad))
    top = weighed.filter((F.col("bad") >= max(SUPPORT, support)) & (F.col("w") >= LEAST_WEIGHT))
    lexicon: dict[str, float] = {}
    for r in sorted(top.collect(), key=lambda r: (len(r["entry"]), r["entry"])):  # no more than the sample's words
        word = r["entry"]
        shorter = (lexicon.get(word[:n]) for n in range(SHORTEST + 1, len(word)))
        if not any(w is not None and w >= r["w"] - 1 for w in shorter):
            lexicon[word] = float(r["w"])
    starts = sorted(e for e in lexicon if not e.endswith(" "))
    if not starts:
        return lexicon, ()
    begins = F.array(*[F.substring("entry", 1, n) for n in range(SHORTEST + 1, LONGEST + 2)])
    harmless = weighed.filter(F.col("entry").endswith(" ") & (F.col("good") >= 2) & (F.col("w") < 1))
    spare = harmless.filter(F.arrays_overlap(begins, F.array(*map(F.lit, starts)))).select("entry")
    return lexicon, tuple(sorted(r["entry"].strip() for r in spare.collect()))


def _exceptions(sample: DataFrame, model: Model) -> tuple[str, ...]:
    """Phrases around matches that enough harmless texts of the sample have, and no toxic one."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton()
        for batch in batches:
            rows = [(y, p) for y, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) for f in readings(text) for p in phrases(f, model.matched(f, automaton))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string())], names=["y", "phrase"])

    found = sample.select("y", "text").mapInArrow(told, "y int, phrase string").groupBy("phrase").agg(F.sum("y").alias("bad"), F.count("*").alias("n"))
    return tuple(sorted(r["phrase"] for r in found.filter((F.col("bad") == 0) & (F.col("n") >= EXCEPTION_SUPPORT)).select("phrase").collect()))


def _model(sample: DataFrame, counts: DataFrame, bad: str, good: str, n_bad: int, n_good: int) -> Model:
    model = Model(*_lexicon(counts, bad, good, n_bad, n_good))
    model.exceptions += _exceptions(sample, model)
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learns from labels' rows (id, 0 or 1), as many as PER_CLASS of each class."""
    prepare(docs.sparkSession)
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("id is not null and y in (0, 1)")
    labelled = {r["y"]: r["count"] for r in marks.groupBy("y").count().collect()}
    share = labelled.get(1, 0) / max(1, sum(labelled.values()))
    picked = None
    for y in (0, 1):
        some = marks.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(PER_CLASS)
        picked = some if picked is None else picked.union(some)
    ids = F.broadcast(picked)  # 2 * PER_CLASS rows at most
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [fold(t) for t in texts_of(batch.column(2))]
            keys = pa.array([_near_keys(t) for t in texts], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), keys, pa.array(texts, pa.string())], names=["order", "y", "keys", "text"])

    sample = slim.join(ids, "id").select(F.xxhash64("id").alias("order"), "y", "text").mapInArrow(folded, "order long, y int, keys array<long>, text string")
    for k in range(NEAR_KEYS):  # of texts that share a key the least in (order, label, text) stays
        sample = sample.groupBy(F.get("keys", F.lit(k))).agg(F.min(F.struct("order", "y", "text", "keys")).alias("r")).select("r.*")
    sample = cut(sample.select("y", "text", (F.xxhash64(F.get("keys", F.lit(0))) % 2 == 0).alias("half")))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}
        for batch in batches:
            for y, text, half in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2)), strict=True):
                for e in entries(text):
                    n = seen.setdefault(e, [0, 0, 0, 0])
                    n[y] += 1
                    n[2 + y] += half
        rows = list(seen.items())
        for at in range(0, len(rows), 50_000):
            part = rows[at : at + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in part], pa.string()), *[pa.array([n[i] for _, n in part], pa.int64()) for i in range(4)]],
                names=["entry", "good", "bad", "half_good", "half_bad"],
            )

    sizes = {(r["half"], r["y"]): r["count"] for r in sample.groupBy("half", "y").count().collect()}
    size = lambda y, *halves: sum(sizes.get((h, y), 0) for h in halves)
    if not all(size(y, half) for y in (0, 1) for half in (True, False)):
        return Model()
    counts = sample.select("y", "text", F.col("half").cast("int")).mapInArrow(counted, "entry string, good long, bad long, half_good long, half_bad long")
    counts = cut(counts.groupBy("entry").agg(*[F.sum(c).alias(c) for c in ("good", "bad", "half_good", "half_bad")]))
    model = _model(sample.filter("half"), counts, "half_bad", "half_good", size(1, True), size(0, True))

    def signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton()
        for batch in batches:
            found = [model.signs(t, automaton) for t in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([f[k] for f in found], pa.float64()) for k in (0, 1)]], names=["y", "a", "b"])

    got = sorted(map(tuple, sample.filter("not half").select("y", "text").mapInArrow(signs, "y int, a double, b double").collect()))
    if len({y for y, _, _ in got}) == 2:
        x = np.array(got)
        model.curve = _learn_curve(x[:, 1:], x[:, 0], share)
    else:
        model.curve = (-2.0, 1.0, 0.0)
    last = _model(sample, counts, "bad", "good", size(1, True, False), size(0, True, False))
    return Model(last.lexicon, last.exceptions, model.curve)


def score(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """df's rows in the struct ``row``, with score (0 to 1) and predicted (0 or 1)."""
    prepare(df.sparkSession)
    rows = spread(df).select(F.struct("*").alias("row"))
    schema = widened(rows, "score double, predicted int")

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton()
        for batch in batches:
            scores = [model.score(t, automaton) for t in texts_of(batch.column(0).field(text_col))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())],
                names=["row", "score", "predicted"],
            )

    return rows.mapInArrow(told, schema)

"""Language identification with error-correcting output codes.

Each language has a codeword; a binary classifier over hashed byte n-grams
learns each bit. A text's bits are decoded to the language whose codeword costs
least, every bit weighing as much as it proved right in training, so some wrong
bits are corrected. A small gap between the two cheapest flags ambiguity.

Every language is learned. Training takes at most PER_LANGUAGE ids of each, and
fewer once all would be over TRAINING: those with the smallest hashes; of rows
that share an id and a language the text with the smallest hash counts. So the
driver gets TRAINING rows of FEATURES half-precision shares at most (64 MB), or one a
language where there are more languages than that. Prediction reads every text
whole. Only text enters a prediction.

Defined cases: null text, or one without a letter, is ``und`` with score 0; no
training rows make every text ``und``; null languages are not learned; texts of
any length are read whole, a batch's letters at a time; bytes that are no UTF-8
are read as the replacement character; of languages that cost the same the first
by name wins, and such a text is flagged ambiguous; repeated rows are predicted
alike; other columns pass through untouched inside ``row``, whatever their names;
an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkveil.llm.common import prepare, spread, texts_of, widened

#: Training texts of each language, at most.
PER_LANGUAGE = 500
#: Training texts of all languages, at most, but one of each in any case: many languages get fewer each.
TRAINING = 16 * PER_LANGUAGE
#: Hashed features.
FEATURES = 4096
#: Probability gap between the best two below which a text is ambiguous.
AMBIGUOUS = 0.2


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n rows of +1 and -1. Up to five languages get every split of them; more get the best of seeded draws."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:
        splits = [[1 if k == 0 or not (s >> (k - 1)) & 1 else -1 for k in range(n)] for s in range(1, 1 << (n - 1))]
        return np.array(splits, dtype=float).T
    bits = math.ceil(10 * math.log2(n))
    rng = np.random.default_rng(seed)
    best, apart = None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], size=(n, bits))
        gaps = (bits - code @ code.T) / 2 + bits * np.eye(n)
        if gaps.min() > apart and (np.abs(code.sum(axis=0)) < n).all():
            best, apart = code, gaps.min()
    return best


def features(texts: list[str | None]) -> np.ndarray:
    """A row of n-gram shares (1 to 3 bytes of the lower-cased text) for each text."""
    raw = [b" " + (t or "").lower().encode() + b"  " for t in texts]
    sizes = np.array([len(r) for r in raw])
    codes = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.int32)
    base = np.repeat(np.arange(len(raw), dtype=np.int32) * FEATURES, sizes)
    two = np.r_[codes[1:], np.int32([32])]
    three = np.r_[codes[2:], np.int32([32, 32])][: len(codes)]
    pair = codes * 251 + two * 7919
    total = np.bincount(base + codes * 2654 % FEATURES, minlength=len(raw) * FEATURES)
    total += np.bincount(base + (pair + 97) % FEATURES, minlength=len(raw) * FEATURES)
    total += np.bincount(base + (pair * 31 + three * 104729 + 1009) % FEATURES, minlength=len(raw) * FEATURES)
    return total.reshape(len(raw), FEATURES).astype(np.float32) / (3 * sizes[:, None]).astype(np.float32)


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        if not self.languages:
            return [("und", 0.0, False)] * len(texts)
        margins = np.sqrt(features(texts)) @ self.weights + self.bias
        loss = np.logaddexp(0, -margins[:, None, :] * self.code[None]) @ self.trust
        p = np.exp(-(loss - loss.min(axis=1, keepdims=True)))
        p /= p.sum(axis=1, keepdims=True)
        top = np.sort(p, axis=1)
        gap = top[:, -1] - (top[:, -2] if p.shape[1] > 1 else 0)
        out = []
        for text, k, share, apart in zip(texts, p.argmax(axis=1), p.max(axis=1), gap, strict=True):
            if text is None or not any(map(str.isalpha, text)):
                out.append(("und", 0.0, False))
            else:
                out.append((self.languages[k], float(share), bool(apart < AMBIGUOUS)))
        return out


def fit(x: np.ndarray, langs: list[str]) -> Model:
    """Regularised logistic regressions, one a bit, by full gradients with momentum."""
    languages = sorted(set(langs))
    code = codewords(len(languages))
    y = code[[languages.index(v) for v in langs]] if langs else np.ones((0, code.shape[1]))
    x, y = np.sqrt(x).astype(np.float32), y.astype(np.float32)
    w, b = np.zeros((FEATURES, code.shape[1]), dtype=np.float32), np.zeros(code.shape[1], dtype=np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(200 if len(languages) > 1 else 0):
        g = -y / (1 + np.exp(y * (x @ w + b))) / len(y)
        vw, vb = 0.9 * vw - 4 * (x.T @ g + np.float32(1e-6) * w), 0.9 * vb - g.sum(axis=0)
        w, b = w + vw, b + vb
    if len(languages) == 1:
        b += 5
    right = np.mean((x @ w + b) * y > 0, axis=0) if len(y) else np.ones(code.shape[1])
    trust = np.clip(np.log(np.clip(right, 1e-3, 0.999) / np.clip(1 - right, 1e-3, 0.999)), 0.01, None)
    return Model(languages, code, w, b, trust / trust.mean())


def sampled(df: DataFrame, lang_col: str, text_col: str, id_col: str) -> DataFrame:
    """lang, text of the training rows: at most PER_LANGUAGE ids of each language."""
    rows = df.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    slim = rows.select("id", "lang").distinct()
    langs = slim.select("lang").distinct().count()
    most = max(1, min(PER_LANGUAGE, TRAINING // max(1, langs)))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("id"), "id"))  # cut to the first of each partition before the shuffle
    ids = F.broadcast(slim.withColumn("rank", rank).filter(F.col("rank") <= most).select(F.col("id").alias("of"), F.col("lang").alias("in")))  # most * langs rows
    met = rows.join(ids, rows["id"].eqNullSafe(F.col("of")) & (rows["lang"] == F.col("in")), "left_semi")
    return met.groupBy("lang", "id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("first")).select("lang", "first.text")


def train(df: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id") -> Model:
    """A model of all languages of df, from at most PER_LANGUAGE ids of each."""
    prepare(df.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(1))
            x = [r.astype(np.float16).tobytes() for at in range(0, len(texts), 64) for r in features(texts[at : at + 64])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.binary())], names=["lang", "x"])

    got = sampled(df, lang_col, text_col, id_col).mapInArrow(counted, "lang string, x binary").collect()
    got.sort(key=lambda r: (r["lang"], bytes(r["x"])))
    x = np.stack([np.frombuffer(r["x"], dtype=np.float16) for r in got]).astype(np.float32) if got else np.zeros((0, FEATURES), dtype=np.float32)
    return fit(x, [r["lang"] for r in got])


def identify(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """df's rows in the struct ``row``, with lang_pred, score (0 to 1) and ambiguous."""
    prepare(df.sparkSession)
    rows = spread(df).select(F.struct("*").alias("row"))
    schema = widened(rows, "lang_pred string, score double, ambiguous boolean")

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(0).field(text_col))
            found = [x for at in range(0, len(texts), 128) for x in model.predict(texts[at : at + 128])]
            columns = list(zip(*found, strict=True)) if found else [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.bool_())],
                names=["row", "lang_pred", "score", "ambiguous"],
            )

    return rows.mapInArrow(told, schema)

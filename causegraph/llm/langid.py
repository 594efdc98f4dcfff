"""Operator 8: language identification from character n-grams.

Texts are lower-cased, all but letters become spaces, and runs of one to three
characters are hashed into a fixed number of buckets.  Document frequencies are
counted over all learnable documents; a sparse multinomial logistic regression on
TF-IDF values is fitted by follow-the-regularised-leader with an elastic net on a
bounded sample of them, and a temperature, fitted on a part of the sample held back
from it, calibrates the probabilities.  The sample is drawn per language, so that a rare
one is learned however large the table is; it weighs more there than in the table.
Each text is scored whole.

Null texts and texts without a letter are ``und`` with score 0.  Without learnable
rows all are.  Rows with a null language teach nothing but are scored.  Equal texts
get equal results, however often they are repeated; of languages that are equally likely
the first in alphabetical order is predicted.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from causegraph.llm.common import crc, documents, with_columns

BUCKETS = 1 << 15
#: Expected size of the sample that the weights are fitted on; document frequencies cover all rows.
TRAIN_ROWS = 4000
#: A language has at least so many rows in the sample, or all of its rows.
LEAST_ROWS = 100
EPOCHS, ALPHA, BETA, L1, L2 = 4, 0.5, 1.0, 0.02, 0.5
HELD_BACK = 5  # every fifth row of a language's sample calibrates
SLICE = 1 << 20

_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _LETTER[0]


def counts(text: str | None, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray] | None:
    """Buckets that occur and how often; None if the text has no letter."""
    if not text:
        return None
    total, any_letter = None, False
    for a in range(0, len(text), SLICE):
        c = np.frombuffer(text[a : a + SLICE + 2].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        is_letter = _letters()[c]
        any_letter = any_letter or bool(is_letter.any())
        c = np.where(is_letter, c, np.uint32(32))
        keep = is_letter.copy()
        h1 = c * np.uint32(0x9E3779B1)
        h2 = (h1[:-1] ^ np.uint32(0x5BD1E995)) * np.uint32(0x85EBCA6B) + c[1:] * np.uint32(0xC2B2AE35)
        h3 = (h2[:-1] ^ np.uint32(0x27D4EB2F)) * np.uint32(0x165667B1) + c[2:] * np.uint32(0x9E3779B1)
        spans = (h1[keep], h2[keep[:-1] | keep[1:]], h3[keep[1:-1]])
        h = np.concatenate(spans)
        h = ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(16)
        n = np.bincount((h % np.uint32(buckets)).astype(np.intp), minlength=buckets)
        total = n if total is None else total + n
    if not any_letter:
        return None
    at = np.flatnonzero(total)
    return at, total[at]


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # buckets x languages
    bias: np.ndarray
    idf: np.ndarray
    temperature: float

    def values(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        v = np.log1p(n) * self.idf[at]
        norm = float(np.sqrt(v @ v))
        return v / norm if norm else v

    def logits(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        return self.values(at, n) @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        got = counts(text, len(self.idf))
        if got is None or not self.langs:
            return "und", 0.0
        z = self.logits(*got) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(np.argmax(p))
        return self.langs[k], float(p[k])


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(-1, keepdims=True))
    return p / p.sum(-1, keepdims=True)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[str], idf: np.ndarray) -> Model:
    """FTRL-proximal with per-coordinate rates; L1 keeps the weights sparse."""
    langs = sorted(set(labels))
    k, d = len(langs), len(idf)
    model = Model(langs, np.zeros((d, max(k, 1))), np.zeros(max(k, 1)), idf, 1.0)
    if k < 2:
        return model
    y = np.array([langs.index(x) for x in labels])
    values = [model.values(*r) for r in rows]
    z, n = np.zeros((d, k)), np.zeros((d, k))
    zb, nb = np.zeros(k), np.zeros(k)
    order = np.random.default_rng(8)
    seen = [0] * k
    back = np.zeros(len(rows), bool)
    for i, c in enumerate(y):
        seen[c] += 1
        back[i] = seen[c] % HELD_BACK == 0
    learn = np.flatnonzero(~back)

    def leader(z, n, l1):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for i in order.permutation(learn):
            at, v = rows[i][0], values[i]
            w, b = leader(z[at], n[at], L1), leader(zb, nb, 0.0)
            g = _softmax(v @ w + b)
            g[y[i]] -= 1
            gw = v[:, None] * g
            step = (np.sqrt(n[at] + gw * gw) - np.sqrt(n[at])) / ALPHA
            z[at] += gw - step * w
            n[at] += gw * gw
            zb += g - (np.sqrt(nb + g * g) - np.sqrt(nb)) / ALPHA * b
            nb += g * g
    model.weights, model.bias = leader(z, n, L1), leader(zb, nb, 0.0)
    held = np.flatnonzero(back)
    if len(held):
        logits = np.stack([values[i] @ model.weights[rows[i][0]] + model.bias for i in held])
        grid = np.exp(np.linspace(np.log(0.2), np.log(5), 40))
        loss = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(held)), y[held]], 1e-12)).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
    return model


def train(df: DataFrame, learnable: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", buckets: int = BUCKETS, train_rows: int = TRAIN_ROWS) -> Model:
    """Fit on the rows for which ``learnable`` holds and the language is not null."""
    rows = df.where(learnable & F.col(lang).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df_, n = np.zeros(buckets, np.int64), Counter()
        for batch in batches:
            for t, lang_ in zip(batch.column(0), batch.column(1).to_pylist()):
                got = counts(t.as_py(), buckets)
                if got is not None:
                    df_[got[0]] += 1
                    n[lang_] += 1
        at = np.flatnonzero(df_)
        bucket, lang_ = at.tolist() + [None] * len(n), [None] * len(at) + list(n)
        yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(lang_, pa.string()), pa.array(df_[at].tolist() + list(n.values()), pa.int64())], ["bucket", "lang", "n"])

    found = rows.select("text", "lang").mapInArrow(frequencies, "bucket int, lang string, n long").groupBy("bucket", "lang").agg(F.sum("n").alias("n")).collect()  # one row per bucket and language
    frequency = np.zeros(buckets)
    have: dict[str, int] = {}
    for r in found:
        if r.bucket is None:
            have[r.lang] = r.n
        else:
            frequency[r.bucket] = r.n
    total = sum(have.values())
    idf = np.log((1 + total) / (1 + frequency)) + 1

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(lang_, got) for t, lang_ in zip(batch.column(0), batch.column(1).to_pylist()) if (got := counts(t.as_py(), buckets)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.string()), pa.array([g[0].astype(np.uint16).tobytes() for _, g in out], pa.binary()), pa.array([np.minimum(g[1], 65535).astype(np.uint16).tobytes() for _, g in out], pa.binary())], ["lang", "at", "n"])

    # Twice the least number is drawn at least: fewer than that number then come only where rows of a language share few keys.
    share = {x: min(1.0, max(train_rows / total, 2 * LEAST_ROWS / n)) for x, n in have.items()}
    usual = min(1.0, train_rows / max(total, 1))
    more = {x: int(v * (1 << 30)) for x, v in share.items() if v > usual}
    limit = F.lit(int(usual * (1 << 30)))
    if more:
        limit = F.coalesce(F.try_element_at(F.create_map(*[F.lit(y) for x in sorted(more.items()) for y in x]), F.col("lang")), limit)
    chosen = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < limit
    schema = "lang string, at binary, n binary"
    sample = [tuple(r) for r in rows.where(chosen).select("text", "lang").mapInArrow(vectors, schema).collect()]
    drawn = Counter(x for x, _, _ in sample)
    for x in sorted(have):
        if drawn[x] < min(have[x], LEAST_ROWS):
            again = rows.where(F.col("lang") == x).select("text", "lang").mapInArrow(vectors, schema).limit(LEAST_ROWS)
            sample = [r for r in sample if r[0] != x] + [tuple(r) for r in again.collect()]
    sample.sort()
    read = lambda b: np.frombuffer(bytes(b), np.uint16).astype(np.int64)
    mixed = np.random.default_rng(88).permutation(len(sample))
    sample = [sample[i] for i in mixed]
    return fit([(read(a), read(n)) for _, a, n in sample], [x for x, _, _ in sample], idf)


def identify(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """All rows, with the columns ``keep`` (all of them by default), lang_pred and score; columns of these two names are replaced."""
    held = df.sparkSession.sparkContext.broadcast(model)  # buckets x languages, a fixed size

    def run(texts: list) -> list[pa.Array]:
        got = [held.value.predict(t.as_py()) for t in texts]
        return [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]

    return with_columns(df, run, "lang_pred string, score double", text, keep)


def held_out(key: str = "doc_id") -> Column:
    return crc(F.col(key).cast("string")) % 4 == 2


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs, ~held_out())
    return identify(docs.select("doc_id", "text").withColumn("held_out", held_out()), model, keep=["doc_id", "held_out"])

"""Operator 1: toxicity by a factorization machine over hashed terms.

A text's terms are its distinct words and their beginnings of four and five
characters, hashed into a fixed number of buckets.  The machine scores
bias + sum of weights + sum over pairs of terms of the products of their factors, so
a pair such as an insult and the mention of a group can count beyond what both do
alone.  It is fitted by AdaGrad on a bounded sample of the labelled rows, over the
terms which that sample shows to matter, alone or in a pair: a likelihood-ratio test
keeps a term on which the label depends, and a second one both terms of a pair each of
which changes the label among the rows that hold the other, even where neither says
anything alone.  Pairs are tested among the PAIR_TERMS most frequent terms.  All other
terms have weight zero, so the length of a text does not move its score.  Texts are
scored whole.

Null and empty texts score the bias alone.  Rows without a label, or with a null one,
teach nothing.  With no rows of one class the score is the share of label 1 (0.0
without labels).  Several labels of a document each count as a row, and so do repeated
documents; equal texts get equal scores.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from causegraph.llm.common import crc, documents, with_columns

BUCKETS = 1 << 20
#: Expected size of the sample of labelled rows.
TRAIN_ROWS = 12_000
FACTORS, EPOCHS, RATE, L2_WEIGHT, L2_FACTOR = 8, 12, 0.1, 1e-4, 1e-3
LEAST_ROWS, LEAST_TEST = 4, 15.0
#: Terms whose pairs are tested (a square of them is held on the driver), and the test's floor: 5e-11 for one of two million pairs.
PAIR_TERMS, LEAST_PAIR_TEST = 2048, 43.0
CACHE_WORDS, LONG_WORD = 200_000, 40

_EDGE = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


def buckets_of(word: str, buckets: int = BUCKETS) -> list[int]:
    """Buckets of a raw word: itself without punctuation at its ends, and its beginnings."""
    w = word.strip(_EDGE)
    if not w:
        return []
    terms = {f"w{w}", f"4{w[:4]}", f"5{w[:5]}"} if len(w) >= 4 else {f"w{w}"}
    return [zlib.crc32(t.encode("utf-8", "surrogatepass")) % buckets for t in terms]


@dataclass
class Model:
    """Weights of the terms that were kept; ``place`` gives a bucket's row."""

    place: dict[int, int]
    bias: float
    weights: np.ndarray
    factors: np.ndarray
    buckets: int = BUCKETS
    cache: dict[str, tuple[int, ...]] = field(default_factory=dict, repr=False)

    def rows(self, text: str | None) -> list[int]:
        if not text or not self.place:
            return []
        found: set[int] = set()
        cache, place = self.cache, self.place
        if len(cache) > CACHE_WORDS:
            cache.clear()
        for w in set(text.lower().split()):
            at = cache.get(w)
            if at is None:
                at = tuple(place[b] for b in buckets_of(w, self.buckets) if b in place)
                if len(w) <= LONG_WORD:
                    cache[w] = at
            if at:
                found.update(at)
        return sorted(found)

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.margin(self.rows(text)), -500, 500))))

    def margin(self, at: list[int]) -> float:
        if not at:
            return self.bias
        v = self.factors[at]
        s = v.sum(0)
        return float(self.bias + self.weights[at].sum() + 0.5 * (s @ s - (v * v).sum()))


def _tests(n, pos, rows, positive):
    """Likelihood-ratio statistic of the label against terms: of so many ``rows``, of which ``positive`` have
    label 1, ``n`` hold a term and ``pos`` of these have label 1. Arguments may be arrays."""
    a, b, c, d = pos, n - pos, positive - pos, rows - positive - (n - pos)
    total = 0.0
    for cell, r, k in ((a, n, positive), (b, n, rows - positive), (c, rows - n, positive), (d, rows - n, rows - positive)):
        expected = np.maximum(r * k / np.maximum(rows, 1), 1e-12)
        total = total + np.where(cell > 0, cell * np.log(np.maximum(cell, 1e-12) / expected), 0.0)
    return 2 * total


def _in_pairs(x: list[np.ndarray], y: np.ndarray, terms: np.ndarray, buckets: int) -> np.ndarray:
    """Those of ``terms`` that are in a pair whose terms each depend on the label among the rows that hold the other."""
    place = np.full(buckets, -1)
    place[terms] = np.arange(len(terms))
    n, pos = (np.zeros((len(terms), len(terms)), np.float32) for _ in range(2))
    for to, part in ((n, range(len(x))), (pos, np.flatnonzero(y))):
        for first in range(0, len(part), 1024):
            block = np.zeros((min(1024, len(part) - first), len(terms)), np.float32)
            for row, i in zip(block, part[first : first + 1024]):
                at = place[x[i]]
                row[at[at >= 0]] = 1
            to += block.T @ block  # rows that hold both terms, for each pair
    own, own_pos = np.diag(n).astype(float), np.diag(pos).astype(float)
    found = np.zeros(len(terms), bool)
    for i in range(len(terms)):
        both, both_pos = n[i].astype(float), pos[i].astype(float)
        ok = np.minimum(_tests(both, both_pos, own[i], own_pos[i]), _tests(both, both_pos, own, own_pos)) >= LEAST_PAIR_TEST
        ok[i] = False
        found |= ok
    return terms[found]


def fit(rows: list[np.ndarray], y: np.ndarray, buckets: int = BUCKETS, seed: int = 1) -> Model:
    positive = int(y.sum())
    share = positive / len(y) if len(y) else 0.0
    if not len(y) or positive in (0, len(y)):
        bias = np.log(max(share, 1e-9) / max(1 - share, 1e-9))
        return Model({}, float(bias), np.zeros(0), np.zeros((0, FACTORS)), buckets)
    n = np.bincount(np.concatenate(rows), minlength=buckets)
    pos = np.bincount(np.concatenate([r for r, t in zip(rows, y) if t]), minlength=buckets)
    often = np.flatnonzero(n >= LEAST_ROWS)
    test = _tests(n[often].astype(float), pos[often].astype(float), len(y), positive)
    usual = often[np.argsort(-n[often], kind="stable")[:PAIR_TERMS]]
    kept = np.union1d(often[test >= LEAST_TEST], _in_pairs(rows, y, usual, buckets))
    row_of = np.full(buckets, -1)
    row_of[kept] = np.arange(len(kept))
    x = [(r := row_of[b])[r >= 0] for b in rows]
    rng = np.random.default_rng(seed)
    w, v, b = np.zeros(len(kept)), rng.normal(0, 0.01, (len(kept), FACTORS)), float(np.log(share / (1 - share)))
    gw, gv, gb = np.full(len(kept), 1e-6), np.full((len(kept), FACTORS), 1e-6), 1e-6
    for _ in range(EPOCHS):
        for i in rng.permutation(len(y)):
            at = x[i]
            s = v[at].sum(0)
            z = b + w[at].sum() + 0.5 * (s @ s - (v[at] ** 2).sum())
            e = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[i]
            gb += e * e
            b -= RATE * e / np.sqrt(gb)
            if len(at):
                dw = e + L2_WEIGHT * w[at]
                gw[at] += dw * dw
                w[at] -= RATE * dw / np.sqrt(gw[at])
                dv = e * (s - v[at]) + L2_FACTOR * v[at]
                gv[at] += dv * dv
                v[at] -= RATE * dv / np.sqrt(gv[at])
    return Model({int(k): i for i, k in enumerate(kept)}, b, w, v, buckets)


def train(df: DataFrame, labels: DataFrame, learnable: Column, key: str = "doc_id", text: str = "text", label: str = "toxic", buckets: int = BUCKETS, train_rows: int = TRAIN_ROWS) -> Model:
    """Fit on rows of ``df`` with a label; ``learnable`` is an expression over the key."""
    marks = labels.where(F.col(label).isNotNull() & learnable).select(F.col(key).alias("key"), (F.col(label) > 0).cast("int").alias("y"))
    share = min(1.0, train_rows / max(marks.count(), 1))
    chosen = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int(share * (1 << 30))
    marks = marks.where(chosen)
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text")).where(chosen).join(F.broadcast(marks), "key").select("text", "y")  # about train_rows rows

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, list[int]] = {}
        for batch in batches:
            out = []
            for t in batch.column(0):
                found: set[int] = set()
                for w in set((t.as_py() or "").lower().split()):
                    if (at := cache.get(w)) is None:
                        at = buckets_of(w, buckets)
                        if len(cache) < CACHE_WORDS and len(w) <= LONG_WORD:
                            cache[w] = at
                    found.update(at)
                out.append(np.array(sorted(found), np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), batch.column(1)], ["terms", "y"])

    sample = sorted((bytes(r.terms), r.y) for r in rows.mapInArrow(terms, "terms binary, y int").collect())
    return fit([np.frombuffer(t, np.uint32).astype(np.int64) for t, _ in sample], np.array([y for _, y in sample], float), buckets)


def score(df: DataFrame, model: Model, text: str = "text", out: str = "score", keep: list[str] | None = None) -> DataFrame:
    """All rows, with the columns ``keep`` (all of them by default) and the score; a column of its name is replaced."""
    held = df.sparkSession.sparkContext.broadcast(model)  # the terms kept of those in about TRAIN_ROWS texts

    def run(texts) -> list[pa.Array]:
        return [pa.array([held.value.score(t.as_py()) for t in texts], pa.float64())]

    return with_columns(df, run, f"{out} double", text, keep)


def held_out(key: str = "doc_id") -> Column:
    return crc(F.col(key).cast("string")) % 5 == 0


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out())
    return score(docs, model, keep=["doc_id"]).select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))

"""The dictionary at size: nothing missed, little moved, scores, hot terms, odd texts."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from causegraph.operators import dictionary

TERMS = "text string, db string, id string, name string, status string"


def plainly(rows, terms):
    """(key, word, id) by looking at every group of words."""
    by_norm = {}
    for text, _, i, *_ in terms:
        by_norm.setdefault(tuple(text.lower().split()), set()).add(i)
    longest = max(map(len, by_norm))
    out = []
    for key, text in rows:
        w = (text or "").lower().split()
        out += [(key, a, i) for a in range(len(w)) for n in range(1, longest + 1) if a + n <= len(w) for i in by_norm.get(tuple(w[a : a + n]), ())]
    return sorted(out)


@pytest.fixture(scope="module")
def many(spark):
    """60,000 terms of one to six words, many with the same beginning, and texts of the same words."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    common = [f"c{i}" for i in range(30)]
    terms = [(" ".join([rng.choice(common if rng.random() < 0.4 else words) for _ in range(rng.randint(2, 6))]), "MESH", str(i), "t", "name") for i in range(60_000)] + [("c0", "HP", "one", "t", "name"), ("c0 c1", "HP", "two", "t", "synonym")]
    texts = [(k, " ".join(rng.choice(common) if rng.random() < 0.5 else rng.choice(terms)[0] for _ in range(60))) for k in range(300)]
    return terms, texts, dictionary.prepared(dictionary.term_table(spark.createDataFrame(terms, TERMS)))


def test_no_place_is_missed(spark, many):
    terms, texts, held = many
    found = dictionary.candidates(spark.createDataFrame(texts, "k long, text string"), held, "k")
    assert sorted((r.k, r.word, r.id) for r in found.collect()) == plainly(texts, terms)


def test_little_moves_but_places_that_hold_terms(spark, many):
    """What leaves the workers: the places found and a few per cent of the words beside; of words that begin no term almost nothing."""
    terms, texts, held = many
    df = spark.createDataFrame(texts, "k long, text string")
    moved = dictionary.likely(df, held, "k").count()
    real = dictionary.candidates(df, held, "k").select("k", "word", "n_words").distinct().count()
    words = sum(len(x.split()) for _, x in texts)
    assert real <= moved <= real + 0.05 * words
    foreign = spark.range(200).select(F.col("id").alias("k"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(200)), lambda i: F.concat(F.lit("x"), F.col("id") * 1000 + i)), " ").alias("text"))
    rows = dictionary.likely(foreign, held, "k")
    bytes_moved = rows.select(F.sum(F.length("norm") + F.length("surface") + 24)).first()[0] or 0
    assert bytes_moved < 0.1 * foreign.select(F.sum(F.length("text"))).first()[0]


def test_filters_hold_all_that_was_put_in(spark):
    rng = np.random.default_rng(0)
    h = rng.integers(-(2**63), 2**63 - 1, 5000)
    made = dictionary._filter(spark.createDataFrame([(int(x),) for x in h], "h long"), len(h))
    assert dictionary._held(made, h).all() and len(made) * 8 == 1 << 18
    assert dictionary._held(made, rng.integers(-(2**63), 2**63 - 1, 20_000)).mean() < 0.006


def test_scores(spark):
    terms = [("Yellow fever", "DOID", "1", "yellow fever", "name"), ("yellow Jack", "DOID", "1", "yellow fever", "synonym"), ("AIDS", "MESH", "2", "AIDS", "name"), ("aids", "HP", "3", "hearing aids", "former"), ("Aids", "GO", "4", "no", "name")]
    held = dictionary.term_table(spark.createDataFrame(terms, TERMS))
    texts = spark.createDataFrame([(1, "yellow fever, YELLOW FEVER; Yellow-fever"), (2, "aids AIDS Aids"), (3, "yellow jack")], "k long, text string")
    got = {(r.k, r.word, r.id): round(r.score, 4) for r in dictionary.candidates(texts, held, "k").collect()}
    assert got == {(1, 0, "1"): 0.9, (1, 2, "1"): 0.75, (1, 4, "1"): 1.0, (2, 0, "2"): 0.75, (2, 1, "2"): 1.0, (2, 2, "2"): 0.75, (2, 0, "3"): 0.8, (2, 1, "3"): 0.6, (2, 2, "3"): 0.72, (3, 0, "1"): 0.675}
    best = {(r.k, r.word): r.id for r in dictionary.best(dictionary.ground(texts, held, "k"), "k").collect()}
    assert best[2, 0] == "3" and best[2, 1] == "2"


def test_odd_texts_and_no_terms(spark, many):
    terms, _, held = many
    rows = [(1, None), (2, ""), (3, " ... "), (4, "C0"), (None, "c0 c1"), (5, "c0 " * 30_000), (5, "c0 " * 30_000)]
    df = spark.createDataFrame(rows, "k long, text string").selectExpr("*", "1 as h", "2 as norm", "3 as word", "4 as id")
    found = dictionary.candidates(df, held, "k").groupBy("k").count().collect()
    assert {r.k: r["count"] for r in found} == {4: 1, None: len(plainly([(0, "c0 c1")], terms)), 5: len(plainly([(0, "c0 " * 30_000)] * 2, terms))}
    assert dictionary.candidates(df, dictionary.term_table(spark.createDataFrame([], TERMS)), "k").count() == 0
    assert dictionary.candidates(df.where("false"), held, "k").count() == 0


def test_places_of_slices():
    """Arrow arrays that begin in the middle of another, and null rows."""
    words = pa.array([[1, 2, 3], None, [], [2, 3]], pa.list_(pa.int64()))
    ones = np.full(1 << 13, 255, np.uint8)
    whole = dictionary._places_of(words, (1, 2), ones, ones).to_pylist()
    assert [[(x["word"], x["n_words"]) for x in r] for r in whole] == [[(0, 1), (0, 2), (1, 1), (1, 2), (2, 1)], [], [], [(0, 1), (0, 2), (1, 1)]]
    assert dictionary._places_of(words.slice(2), (1, 2), ones, ones).to_pylist() == whole[2:]
    assert whole[0][3]["h"] == whole[3][1]["h"] == dictionary._group_hash(np.array([2, 3], np.uint64))

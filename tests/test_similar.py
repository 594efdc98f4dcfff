"""The similarity join against all pairs by difflib."""

import random
from difflib import SequenceMatcher

import pytest

from causegraph.functions import edit
from causegraph.operators import similar


def all_pairs(names, labels, cutoff):
    return sorted((n, x) for n in {*names} - {None, ""} for x in {*labels} - {None, ""} if SequenceMatcher(None, x, n).ratio() >= cutoff)


def frames(spark, names, labels):
    return spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(x,) for x in labels], "label string")


@pytest.mark.parametrize("cutoff", [0.3, 0.6, 0.7, 0.85, 1.0])
def test_no_pair_is_lost(spark, cutoff):
    rng = random.Random(int(cutoff * 100))
    word = lambda: "".join(rng.choice("aabcdeé😀 ") for _ in range(rng.randint(1, 14)))
    labels = [word() for _ in range(60)] + ["x", "", None, "same", "same"]
    names = [word() for _ in range(60)] + ["same", "", None, "y" * 3000]
    for x in labels[:60]:
        y = list(x)
        y[rng.randrange(len(y))] = rng.choice("aé😀")
        names.append("".join(y))
    got = similar.similar(*frames(spark, names, labels), cutoff).collect()
    assert sorted((r.name, r.label) for r in got) == all_pairs(names, labels, cutoff)
    assert all(r.ratio == SequenceMatcher(None, r.label, r.name).ratio() for r in got)


def test_closest_prefers_the_greatest_of_equals(spark):
    labels = ["Anemia A", "Anemia B", "Asthma", "Malaria"]
    got = {r.name: r.label for r in similar.closest(*frames(spark, ["Anemia", "Anemia C", "asthma", "Malarias", "zzz"], labels), 0.8).collect()}
    assert got == {n: x for n in ("Anemia", "Anemia C", "asthma", "Malarias", "zzz") if (x := edit.closest(n, labels, 0.8))}
    assert got["Anemia C"] == "Anemia B" and "zzz" not in got


def test_nothing_and_wrong_cutoffs(spark):
    assert similar.similar(*frames(spark, ["a"], []), 0.5).count() == 0
    assert similar.similar(*frames(spark, [], ["a"]), 0.5).count() == 0
    with pytest.raises(ValueError):
        similar.similar(*frames(spark, ["a"], ["a"]), 0.0)


def test_few_pairs_are_compared_exactly(spark):
    """Long labels at a high cut-off: the built-in bounds leave little for the exact ratio."""
    rng = random.Random(8)
    labels = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(24)) for _ in range(400)]
    names = [x[:10] + "q" + x[11:] for x in labels]
    a, b = (similar._keyed(df, c, 0.85) for df, c in zip(frames(spark, names, labels), ("name", "label")))
    met = a.join(b.withColumnsRenamed({"n": "m", "letters": "others"}), "key").where("size(array_intersect(letters, others)) >= (n + m) * 0.425").select("name", "label").distinct().count()
    assert 400 <= met < 0.02 * 400 * 400
    assert similar.similar(*frames(spark, names, labels), 0.85).count() >= 400

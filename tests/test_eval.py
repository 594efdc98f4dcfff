"""Transcript metrics over whole turns, against plain Python."""

import random
import re

import pytest

from causegraph.functions import edit
from causegraph.plans import eval_queries


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def turns():
    rng = random.Random(6)
    words = ["the", "other", "with", "a", "fever", "Path,", "9th", "cough"]
    rows = [(1, k, " ".join(rng.choice(words) for _ in range(n))) for k, n in enumerate((5, 40, 90, 150, 60, 130))]
    return rows + [(2, 0, "calm " * 60 + "with the other"), (2, 1, ""), (2, 3, "?!")]


@pytest.fixture
def turns_dir(spark, tmp_path):
    spark.createDataFrame(turns(), "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    return str(tmp_path)


def pairs():
    for conv, turn, text in turns():
        ref = re.sub("[^a-z0-9 ]", "", text.lower())
        yield conv, turn, ref, (ref.replace("th", "d"), ref[6:], ref + " uh")[turn % 3]


def test_whole_turns_are_scored(spark, turns_dir):
    cer = {(r.conv_id, r.turn): r for r in eval_queries.eval_cer(spark, turns_dir).collect()}
    wer = {r.id: r for r in eval_queries.eval_wer_sdi(spark, turns_dir).collect()}
    edits = words = 0
    for conv, turn, ref, hyp in pairs():
        a, b = ref.replace(" ", ""), hyp.replace(" ", "")
        r = cer[conv, turn]
        assert (r.edits, r.ref_len) == (distance(a, b), len(a)) and (r.cer is None) == (not a)
        w = wer[f"{conv}.{turn}"]
        assert (w.s + w.d + w.i, w.n) == (distance(ref.split(), hyp.split()), len(ref.split()))
        edits, words = edits + w.s + w.d + w.i, words + w.n
    total = wer["__AGGREGATE__"]
    assert (total.s + total.d + total.i, total.n) == (edits, words) and len(wer) == len(cer) + 1
    assert cer[2, 0].edits > 0 and wer["2.0"].s == 3  # all of them after character 120


def test_alignment_is_of_least_cost():
    rng = random.Random(7)
    for _ in range(500):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in range(2))
        s, d, i = edit.alignment(a, b)
        assert s + d + i == distance(a, b) == edit.distance("".join(a), "".join(b)) and i - d == len(b) - len(a)

"""Spans against plain brute force: every run of words by difflib, every pair of text and needle, short and long needles."""

import random
import re
from difflib import SequenceMatcher

import numpy as np
import pytest

from causegraph.functions import edit
from causegraph.operators import grounding


def plainly(text, needle, least=0.7):
    e, low = needle.strip().lower(), text.lower()
    if (a := low.find(e)) >= 0:
        return a, a + len(e), "exact", 1.0
    words, n, best = [m.span() for m in re.finditer(r"\S+", text)], len(e.split()), None
    for k in range(n, n + 5):
        for i in range(len(words) - k + 1):
            a, b = words[i][0], words[i + k - 1][1]
            r = SequenceMatcher(None, e, text[a:b].lower()).ratio()
            if r >= least and (best is None or r > best[3]):
                best = (a, b, "fuzzy", r)
    return best


def invented(rng, n, alphabet="abcdeiou"):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 8))) for _ in range(n))


def reworded(rng, text, share):
    return "".join(rng.choice("xyzq") if c != " " and rng.random() < share else c for c in text)


@pytest.fixture(scope="module")
def material():
    rng = random.Random(12)
    texts = [invented(rng, rng.choice((0, 1, 3, 30, 90, 160))) for _ in range(18)] + ["", "  ", "İstanbul ve İZMİR aynı gün " * 12, "tab\tand\nline  breaks in here " * 5]
    wide = invented(rng, 120, "abcdefghijklmnopqrstuvwxyzäöüßéèçñ0123456789")
    needles = [reworded(rng, " ".join(wide.split()[20:75]), 0.03), reworded(rng, " ".join(wide.split()[40:100]), 0.25)]
    for t in texts:
        w = t.split()
        for n in (1, 2, 5, 28, 70):
            if len(w) > n:
                a = rng.randrange(len(w) - n)
                needles.append(reworded(rng, " ".join(w[a : a + n]), rng.choice((0, 0.05, 0.15, 0.3))))
    return [*texts, wide], needles[:2] + rng.sample(needles[2:], 30) + ["", "  ", None, "not there at all", "izmir ayni"]


def test_no_pair_is_lost(spark, material):
    """Needles of one word to over 200 characters, half of them too far from any place, in all texts."""
    texts, needles = material
    wanted = {(d, i): p for d, t in enumerate(texts) for i, n in enumerate(needles) if n and n.strip() and (p := plainly(t, n))}
    assert sum(p[2] == "fuzzy" for p in wanted.values()) > 20 and any(len(needles[i]) >= 200 and p[2] == "fuzzy" for (_, i), p in wanted.items())
    d = spark.createDataFrame([*enumerate(texts), (99, None)], "doc int, text string").selectExpr("*", "1 as block", "2 as needle")
    e = spark.createDataFrame([*enumerate(needles)], "item int, needle string")
    for block in (256, 7):
        got = {(r.doc, r.item): (r.start, r.end, r.kind, r.similarity) for r in grounding.search_spans(d, e, block=block).collect()}
        assert got == wanted
    assert grounding.search_spans(d, e.where("false")).count() == 0


def test_bounds_are_never_below_the_ratio(material):
    rng = random.Random(4)
    for _ in range(60):
        alphabet = rng.choice(("ab ", "abcde ", "abcdefghijklmnopqrstuvwxyz    ", "etaoin shrdlu   "))
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(200, 900)))
        phrase = reworded(rng, text[40 : 40 + rng.randint(150, 330)], rng.random() / 2).strip()
        w = edit._Windows(text, str.lower)
        starts, ends, bound = w.bounds(phrase, 0.0)
        w.tightened(phrase, 0.0, starts, ends, bound)
        for i in rng.sample(range(len(starts)), min(len(starts), 30)):
            assert SequenceMatcher(None, phrase, text[starts[i] : ends[i]]).ratio() <= bound[i] + 1e-9


def test_known_subsequences_settle_later_runs(material):
    """Runs whose bound comes from an earlier one have a subsequence no longer than that."""
    rng = random.Random(9)
    text, phrase = invented(rng, 200), invented(rng, 25)
    w = edit._Windows(text, str.lower)
    starts, ends, bound = w.bounds(phrase, 0.6)
    before = bound.copy()
    w.tightened(phrase, 0.6, starts, ends, bound)
    bits = edit._bits(phrase)
    for i in np.flatnonzero(before >= 0.6):
        exact = 2 * edit._common(bits, len(phrase), text[starts[i] : ends[i]], [int(ends[i] - starts[i])])[0] / (ends[i] - starts[i] + len(phrase))
        assert exact - 1e-9 <= bound[i] and (bound[i] < 0.6 or abs(bound[i] - min(exact, before[i])) < 1e-9)


def test_screened_phrases_and_each_by_itself(monkeypatch):
    """Many phrases share a reading of a text; its bounds hold, lower most runs, and change nothing in what is found."""
    from difflib import SequenceMatcher

    rng = random.Random(5)
    words = ["ción", "de", "la", "ñarie", "boda", "querr", "les", "rr", "mente", "os", "ß", "zz."]
    text = " ".join(rng.choice(words) for _ in range(400))
    parts = text.split(" ")
    needles = [" ".join(w if rng.random() < keep else rng.choice(words) for w in parts[a : a + n]) for a, n, keep in ((5, 14, 0.9), (60, 20, 0.6), (200, 60, 0.85), (9, 25, 0.0), (150, 70, 0.0), (300, 16, 0.3))]
    monkeypatch.setattr(edit, "MANY", 1)
    for near in (8, 140):
        monkeypatch.setattr(edit, "NEAR", near)
        windows, screen = edit._Windows(text, str.lower), edit._Screen(tuple(needles))
        for k, bound in screen.bounds(windows, [*range(len(needles))], 0.7).items():
            _, _, starts, ends, _, _ = windows.of(len(needles[k].split()))
            for i in range(0, len(bound), 7):
                true = SequenceMatcher(None, needles[k], windows.low[starts[i] : ends[i]]).ratio()
                assert true <= bound[i] + 1e-9
            assert (bound < windows.by_length(needles[k])).mean() > 0.5 or len(needles[k]) > 200
        alone = [(i, *s) for i, n in enumerate(needles) for s in edit.spans(text, [n])]
        assert edit.each_span(text, needles) == alone and len(alone) >= 2

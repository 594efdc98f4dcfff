"""Text, edit and audio functions on hand-made values."""

import difflib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from causegraph.functions import audio, edit, text as t


def one(spark, schema, values, *columns):
    return list(spark.createDataFrame([values], schema).select(*columns).first())


def test_identifiers(spark):
    got = one(spark, "a string, b string, c string", ("OMIM:1:2", "VAs-01.02.03", "nocolon"), t.namespace("a"), t.namespace("c"), t.parent_by_dot("b"), t.parent_by_dot("c"), t.partition("a", ":")[2], t.partition("c", ":")[1], t.curie("x", "c"))
    assert got == ["OMIM", "nocolon", "VAs-01.02", None, "1:2", False, "x:nocolon"]
    assert [t.question_target(c) for c in ("b_0100", "b_0101")] == ["who.va:VAs-01", "who.va:VAs-01.01"]


@pytest.mark.parametrize("raw,want", [(" A000 ", "A00.0"), ("A00", "A00"), ("a00b", "a00.b"), ("1000", "1000"), ("AB.1", "AB.1"), (None, None)])
def test_icd10_cause(spark, raw, want):
    assert one(spark, "a string", (raw,), t.icd10_cause("a")) == [want]


def test_numbers_and_names(spark):
    got = one(spark, "a string, b string, c string, n int", ("..", "1.23456", "NaN", 5), t.number("a"), t.number("b"), t.number("c"), t.int_or("a", 0), t.sex_name("n"), t.sex_name(F.lit(2)), t.ratio("n", F.lit(0)))
    assert got == [None, 1.235, None, 0, "5", "female", None]
    got = one(spark, "a string, b string", (" x ", "id"), t.display("a", "b"), t.display(F.lit(""), "b"), t.display(F.lit(None).cast("string"), "b"), t.without_parenthetical(F.lit("Homicide (assault)")), t.last_segment(F.lit("http://x/y")), t.tabulation_title(F.lit("- - A - b")))
    assert got == ["x", "id", "id", "Homicide", "y", "A b"]


def test_durations_and_languages(spark):
    assert one(spark, "a double", (3723.4,), t.duration("a"), t.duration(F.lit(62.0)), t.duration(F.lit(3.25))) == ["1h 02m 03.4s", "1m 02.0s", "3.3s"]
    assert one(spark, "a string", (" EN ",), t.language_code("a", ["en", "pt"], {"english": "en"}), t.language_code(F.lit("english"), ["en"], {"english": "en"}), t.language_code(F.lit("xx"), ["en"], {})) == ["en", "en", None]


def test_text_normalising_and_counting(spark):
    got = one(spark, "a string", ("Élan—it's  a_b\tC! ",), t.scoring_text("a"), t.tokens("a"), t.occurrences(F.lit("aaaa"), "aa"), t.mentions(F.lit("chest pain, heart"), ["chest pain", "heart"]))
    assert got == ["élan it s a_b c", ["Élan—it's", "a_b", "C!"], 2, 2]


def test_positions_years_and_segments(spark):
    assert one(spark, "a int, b int, c int", (1, None, 3), t.positional_join([F.col("a"), F.col("b"), F.col("c")])) == ["1;;3"]
    df = spark.createDataFrame([("..", "2.5")], "`2019 [YR2019]` string, `2020 [YR2020]` string")
    assert df.select(t.year_map(df.columns)).first()[0] == {"2020": 2.5}
    seg = "s array<struct<text:string,no_speech_prob:double>>, l string"
    rows = [([(" a", 0.1), (" b", 0.9)], "en", "a"), ([("x", 0.7)], "bn", "x"), ([("x", 0.7)], "en", ""), ([], "en", "raw")]
    for s, lang, want in rows:
        assert one(spark, seg, (s, lang), t.spoken_text(F.col("s"), "l", F.lit(" raw "))) == [want]


def test_alignment_of_words():
    assert edit.alignment([], []) == (0, 0, 0)
    assert edit.alignment(["a"], []) == (0, 1, 0) and edit.alignment([], ["a", "b"]) == (0, 0, 2)
    assert edit.alignment("a b c".split(), "a x c d".split()) == (1, 0, 1)
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 8))] for _ in range(2))
        s, d, i = edit.alignment(a, b)
        assert len(a) - d + i == len(b)
        row = list(range(len(b) + 1))
        for x in a:
            row = _next(row, x, b)
        assert s + d + i == row[-1]


def _next(row, x, b):
    out = [row[0] + 1]
    for j, y in enumerate(b, 1):
        out.append(min(out[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
    return out


def test_spans():
    text = "The chest pain began, then chest pains and a feverish night."
    got = edit.spans(text, ["chest pain", "CHEST PAIN", "  ", "feverysh night", "nothing like this"])
    assert [g[2] for g in got] == ["exact", "exact", "fuzzy"]
    assert got[0][:2] == (4, 14) and got[1][:2] == (27, 37) and got[2][3] == "feverish night."
    assert got[2][4] == pytest.approx(difflib.SequenceMatcher(None, "feverysh night", "feverish night.").ratio())
    assert edit.spans("", ["x"]) == [] and edit.spans("x", None) == [] and edit.spans("abc", ["ABC"], case_sensitive=True) == []


def test_closest_and_overlap():
    assert edit.closest("Anemia", ["Anemias", "Asthma"], 0.85) == "Anemias" and edit.closest("zzz", ["Anemias"], 0.85) is None
    assert edit.closest("Anemia", ["Anemias", "Asthma"], 0.85) == difflib.get_close_matches("Anemia", ["Anemias", "Asthma"], 1, 0.85)[0]
    assert edit.overlap_join("a b c", "b c d") == "a b c d" and edit.overlap_join("", "x") == "x" and edit.overlap_join("a", "b") == "a b"


def test_audio(spark):
    loud, quiet = np.full(16000, 1000, "<i2").tobytes(), np.zeros(16000, "<i2").tobytes()
    df = spark.createDataFrame([(loud,), (quiet,)], "pcm binary").select(audio.levels("pcm").alias("l")).select("l.*")
    a, b = df.collect()
    assert a.n == 16000 and a.peak == pytest.approx(1000 / 32768) and b.peak == 0
    assert df.select(t.silent("peak")).collect()[1][0] is True
    got = one(spark, "x array<double>, n int", ([2.0, -2.0, 0.5, 0.0], 2), audio.to_int16(F.col("x")), audio.mono("x", "n"), audio.resample("x", F.lit(8000)))
    assert got[0] == [32767, -32767, 16383, 0] and got[1] == [0.0, 0.25] and len(got[2]) == 8
    w = one(spark, "d double", (60.0,), audio.windows("d"))[0]
    assert [(x.start, x.end) for x in w] == [(0.0, 29.5), (28.5, 58.0), (57.0, 60.0)]

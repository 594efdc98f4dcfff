"""Dialogue, streaming, grounding, evaluation, inference, files and settings."""

import gzip
import json
import zipfile
from glob import glob

import pytest
from pyspark.sql import functions as F

from causegraph.__main__ import main
from causegraph.functions import text as t
from causegraph.operators import dialogue, evaluate, graph, grounding
from causegraph.plans import inference, settings
from causegraph.sources import readers, sinks
from causegraph.streaming import processors

TALK = "dialogue string, seq int, text string"


def scores(spark, *texts):
    df = spark.createDataFrame([("d", i, x) for i, x in enumerate(texts)], TALK)
    return inference.keyword_causes(df, "dialogue", "seq").orderBy("seq").collect()


def test_keyword_causes(spark):
    for x, code in (("The patient had a high fever and temperature.", "U07.1"), ("Severe chest pain.", "I46.9"), ("Some issues.", "R99")):
        r = scores(spark, x)[0]
        assert r.causes[f"icd10:{code}"].score > 0.5 and r.top_cause.label == f"icd10:{code}"
    both = scores(spark, "fever and chest", "pain")  # a phrase across two chunks
    assert [r.chunks_processed for r in both] == [1, 2] and both[1].causes["icd10:I46.9"].score == 0.5
    assert abs(sum(c.score for c in both[1].causes.values()) - 1) < 1e-3 and both[1].top_cause.label == "icd10:U07.1"


def test_reset_starts_anew(spark):
    df = spark.createDataFrame([("d", 0, "fever", False), ("d", 1, "heart", False), ("d", 2, None, True), ("d", 3, "nothing", False)], TALK + ", reset boolean")
    s = dialogue.resets(df, "dialogue", "seq", F.col("reset")).withColumn("k", F.concat_ws("#", "dialogue", F.col("session").cast("string")))
    assert [r.chunks_processed for r in inference.keyword_causes(s, "k", "seq").orderBy("seq").collect()] == [1, 2, 1]


def test_requests(spark):
    with pytest.raises(inference.BadRequest):
        inference.check_requests(spark.createDataFrame([("a",)], "chunk_id string"))
    df = spark.createDataFrame([("a", "x", [], 5.0), ("b", None, [], None)], "chunk_id string, text string, annotations array<string>, timestamp double")
    a, b = inference.check_requests(df).orderBy("chunk_id").collect()
    assert (a.timestamp, a.error) == (5.0, None) and b.timestamp > 1e9 and b.error == "missing: text"


GATE = [("c", i, " ".join("w" * n)) for i, n in enumerate([14, 1, 15, 16, 0, 3, 20, 2])]


def test_gate_in_batch_and_stream(spark, tmp_path):
    df = spark.createDataFrame([*GATE, ("e", 0, None), ("e", 1, "x y")], TALK)
    batch = sorted(tuple(r) for r in dialogue.gate(df, "dialogue", "seq").collect())
    assert [b for k, _, b in batch if k == "c"] == [0, 0, 1, 2, 3, 3, 3, 4]
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", processors.ROCKSDB)
    out = processors.gate_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "dialogue", "seq")
    q = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == batch
    texts = dialogue.batch_texts(dialogue.gate(df, "dialogue", "seq"), df, "dialogue", "seq").where("dialogue = 'c'").orderBy("batch").collect()
    assert [r.n for r in texts] == [2, 1, 1, 3, 1]
    assert [r.batch for r in dialogue.gate(df, "dialogue", "seq", least=0).where("dialogue = 'c'").orderBy("seq").collect()] == list(range(8))


def test_line_deltas_in_stream(spark, tmp_path):
    rows = [("s", 1, "0", "hello"), ("s", 2, "0", "hello there"), ("s", 3, None, "how are"), ("s", 4, "2", "how are you"), ("s", 5, None, "how are"), ("s", 6, "0", ""), ("s", 7, "2", "fine thanks"), ("s", 8, None, "today")]
    df = spark.createDataFrame(rows, "session string, seq int, line string, text string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", processors.ROCKSDB)
    out = processors.line_delta_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "session", "seq")
    q = out.writeStream.format("memory").queryName("deltas").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = [(r.text, r.committed) for r in spark.table("deltas").orderBy("seq").collect()]
    assert got == [("hello", True), ("there", True), ("how are", False), ("how are you", True), ("fine thanks", True), ("today", False)]
    batch = dialogue.line_deltas(df.where("line is not null"), ["session", "line"], "seq").orderBy("seq").collect()
    assert [r.delta for r in batch] == [x for x, c in got if c]


def test_vectors_and_rerank(spark):
    index = spark.createDataFrame([(i, [float(i == j) + 0.1 * (i == 2) for j in range(4)]) for i in range(4)], "c int, vector array<double>")
    q = spark.createDataFrame([(0, [1.0, 0.0, 0.0, 0.0])], "q int, vector array<double>")
    got = grounding.top_k(q, index, 2, index_block=2).orderBy("rank").collect()
    assert [(r.c, r.rank, r.cosine) for r in got] == [(0, 1, 1.0), (2, 2, 0.1)]
    assert grounding.top_k(q, index, 3, least=0.9).count() == 1
    r = spark.createDataFrame([("k", "a", "A", 0.9), ("k", "b", "B", 0.8)], "q string, id string, name string, score double")
    order = spark.createDataFrame([("k", ["x", "b", "a", "b"])], "q string, ids array<string>")
    assert [(x.id, x.pos, x.score) for x in grounding.rerank(r, order).orderBy("pos").collect()] == [("b", 1, 0.8), ("a", 2, 0.9)]


def test_labels_to_causes(spark):
    df = spark.createDataFrame([("d", 0, "Sepsis", 0.4), ("d", 1, "anemias ", 0.3), ("d", 2, "Anemia", 0.2), ("d", 3, "Other", 0.1), ("d", 4, "Undetermined", 0.05), ("d", 5, "zzz", 0.9), ("d", 6, None, 0.1)], "k string, pos int, cause_name string, probability double")
    labels, codes = ["Sepsis", "Anemias", "Other", "Undetermined"], {"Sepsis": "A41", "Anemias": "D64", "Other": "R99", "Undetermined": "R99"}
    m = grounding.match_labels(df, labels, codes)
    assert [r.matched for r in m.orderBy("pos").collect()] == ["Sepsis", "Anemias", "Anemias", "Other", "Undetermined", None, None]
    causes = grounding.cause_map(m, ["k"], "pos").first().causes
    assert {k: (v.name, v.score) for k, v in causes.items()} == {"icd10:A41": ("Sepsis", 0.4), "icd10:D64": ("Anemias", 0.2), "icd10:R99": ("Undetermined", 0.05)}


def test_label_agent(spark):
    calls = []

    def client(prompt):
        if "broken" in prompt:
            raise RuntimeError
        return {"top_causes": [{"cause_name": "Sepsis", "probability": 0.7}], "reasoning": "r"}

    agent = inference.LabelAgent(client, ["Sepsis"], {"Sepsis": "A41"}, wait=calls.append)
    df = spark.createDataFrame([("d", 0, "fine"), ("e", 0, "broken")], TALK)
    got = {r.dialogue: r for r in agent.infer(df, "dialogue", "seq").collect()}
    assert got["d"].answer.reasoning == "r" and got["e"].answer.failed and agent.call("broken") == {"api_failed": True} and calls == [1.0, 2.0]
    assert agent.causes(agent.infer(df, "dialogue", "seq"), "dialogue", "seq").first().causes["icd10:A41"].score == 0.7


def test_grounding_pipeline(spark):
    encode = grounding.hashing_encoder()
    terms = spark.createDataFrame([("t:1", "icd10", "fever"), ("t:2", "icd10", "chest pain")], "id string, label string, name string")
    index = grounding.vector_index(grounding.embed(terms, "name", encode), "icd10")
    assert grounding.vector_index(grounding.embed(terms, "name", encode), "other") is None and grounding.vector_dimension(grounding.embed(terms, "name", encode), "icd10") == 64
    df = spark.createDataFrame([(1, "High FEVER and chest pain"), (2, "  ")], "doc int, text string")
    g = grounding.ground(df, "doc", index, grounding.lexicon_client(["fever", "chest pain"]), encode)
    assert {r.concept: r.match.id for r in grounding.first_matches(g, "doc").collect()} == {"fever": "t:1", "chest pain": "t:2"}
    a = grounding.annotate(g, "doc").orderBy("start").collect()
    assert [(r.text, r.start, r.end) for r in a] == [("FEVER", 5, 10), ("chest pain", 15, 25)] == [(r.text, r.start, r.end) for r in grounding.annotate(g, "doc", "concept").orderBy("start").collect()]


def test_metrics(spark):
    df = spark.createDataFrame([(1, ["A.1", "B"], ["A.2", "B", " "]), (2, [], []), (3, ["A"], None)], "k int, ref array<string>, pred array<string>")
    got = {(r.k, r.level): tuple(r)[2:] for r in evaluate.code_metrics(df, "k").collect()}
    assert got[1, "strict"] == (0.5, 0.5, 0.5, 1 / 3) and got[1, "parent"] == (1, 1, 1, 1) and got[2, "strict"] == (1, 1, 1, 1) and got[3, "strict"] == (0, 0, 0, 0)
    w = spark.createDataFrame([("a b c", "a x c d", 1.0, 10.0), ("", "", 1.0, 10.0)], "r string, h string, latency_s double, duration_s double")
    e = evaluate.word_errors(w, "r", "h")
    x = e.where("n > 0").first()
    assert (x.s, x.d, x.i, x.n, x.char_edits, x.char_len) == (1, 0, 1, 3, 2, 3) and e.where("n = 0").first().wer is None
    c = evaluate.corpus_errors(e).first()
    assert (c.wer, c.rtf) == (2 / 3, 0.1)


def test_files(spark, tmp_path):
    p = str(tmp_path)
    df = spark.createDataFrame([("b", 'say "x"\ty', None), ("a", "", "1;2")], "`id:ID` string, name string, `v:int[]` string")
    for k in ("one", "two"):
        sinks.tsv_gz(df, f"{p}/{k}")
    a, b = (gzip.open(glob(f"{p}/{k}/*.gz")[0]).read() for k in ("one", "two"))
    assert a == b
    back = readers.tsv(spark, f"{p}/one").collect()
    assert [tuple(r) for r in back] == [("a", None, "1;2"), ("b", 'say "x"\ty', None)]
    assert graph.typed(readers.tsv(spark, f"{p}/one")).columns == ["id:ID", "name", "v"]
    with zipfile.ZipFile(f"{p}/z.zip", "w") as z:
        z.writestr("m.csv", "country,name\n1,C\xf4te\n2,\n".encode("latin1"))
    assert [tuple(r) for r in readers.zip_member(spark, f"{p}/z.zip", "m.csv", encoding="latin1").collect()] == [("1", "Côte"), ("2", None)]
    (tmp_path / "t.obo").write_text("format-version: 1.2\n\n[Term]\nid: HP:1\nname: All\nis_a: HP:0 ! root\nproperty_value: skos:exactMatch OMIM:1\n\n[Typedef]\nid: x\n")
    assert [tuple(r) for r in readers.obo(spark, f"{p}/t.obo").collect()] == [("HP:1", "All", ["skos:exactMatch OMIM:1"], ["HP:0"], False)]
    (tmp_path / "h.tsv").write_text("#x\n#y\na\tb\n1\t2\n")
    assert [r.asDict() for r in readers.tsv_after(spark, f"{p}/h.tsv", 2).collect()] == [{"a": "1", "b": "2"}]
    (tmp_path / "m.json").write_text('{"x": "y"}')
    assert [tuple(r) for r in readers.json_map(spark, f"{p}/m.json").collect()] == [("x", "y")]
    (tmp_path / "07_en.txt").write_text("\n\nTranscripted Line\nhello\n")
    assert [tuple(r) for r in readers.transcripts(spark, f"{p}/07_en.txt").collect()] == [("07", "hello\n")]
    assert readers.exists(spark, f"{p}/m.json") and not readers.exists(spark, f"{p}/none")
    assert spark.range(1).select(readers.overridden(F.lit("11"), {"11": "12"})).first()[0] == "12"
    cached = [sinks.cached(spark.range(n).selectExpr("id"), f"{p}/cache").count() for n in (3, 5)]
    assert cached == [3, 3]


def test_run_outputs(spark, tmp_path):
    c = spark.createDataFrame([(0, "c0", "hi", ["x"], 0.1, 0.2)], "seq int, chunk_id string, text string, annotations array<string>, grounding_s double, inference_s double")
    sinks.run_outputs(c, str(tmp_path), {"k": 1}, spark.createDataFrame([("R99",)], "cause string"))
    r = json.loads(spark.read.text(f"{tmp_path}/inference").first()[0])
    assert r["total_s"] == pytest.approx(0.3) and r["cause"] == "R99" and spark.read.text(f"{tmp_path}/transcript").first()[0] == "hi"


def test_settings():
    env = {"CAUSEGRAPH_MIN_WORDS": " 7 ", "CAUSEGRAPH_RERANK": "No", "CAUSEGRAPH_TOP_K": " "}
    s = settings.Settings.load(env)
    assert (s.min_words, s.rerank, s.top_k) == (7, False, 10)
    with pytest.raises(ValueError):
        settings.read({"X": "maybe"}, "X", True)


def test_runner(spark, tmp_path, capsys):
    with pytest.raises(SystemExit):
        main(["--text", "a", "--input", "b"])
    assert main(["--text", "a high fever"]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["top_cause"]["label"] == "icd10:U07.1"


def test_translation_and_silence(spark):
    df = spark.createDataFrame([("bonjour tout", "fr"), ("oui", "fr"), ("hi you", "en")], "text string, lang string")
    assert sorted(r.text for r in inference.translated(df, lambda x, _: x.upper()).collect()) == ["BONJOUR TOUT", "hi you", "oui"]
    assert spark.range(1).select(t.silent(F.lit(32), integer=True)).first()[0] is True


def test_keyword_causes_from_counts_equal_those_from_the_text_so_far(spark):
    """Words that overlap themselves, within an event and beside a joint, words with a space across joints, nulls and empty texts."""
    texts = ["Cardiacardiac", "chest", "pain and CHEST", None, "pain", "", "cardiac", "heart heart", "aha ah aha", "fever chest  pain", "ab ab", "ab"]
    df = spark.createDataFrame([(k, i, t) for k in "xy" for i, t in enumerate(texts if k == "x" else texts[::-1])], "k string, i int, text string")
    for words in (["cardiac", "chest pain"], ["aha", "cardiac"], ["ab ab"]):
        causes = {"one": ("A", "first", words), "two": ("B", "second", ["fever", "heart"]), "other": ("C", "third", [])}
        plain = dialogue.keyword_scores(dialogue.running_text(df, "k", "i"), {"one": words, "two": ["fever", "heart"]})
        want = {(r.k, r.i): (r.score_one, r.score_two, r.score_other, r.chunks) for r in plain.collect()}
        got = inference.keyword_causes(df, "k", "i", causes)
        assert "all_text" not in got.columns
        assert {(r.k, r.i): (*[r.causes[f"icd10:{c}"].score for c in "ABC"], r.chunks_processed) for r in got.collect()} == want

"""The build from files, the dictionary, entities, components and live sessions."""

import json
import random
import re
from difflib import SequenceMatcher
from glob import glob

import pytest
from pyspark.sql import functions as F

from causegraph.__main__ import main
from causegraph.functions import edit
from causegraph.functions.text import mentions
from causegraph.operators import dialogue, dictionary, graph, grounding
from causegraph.plans import build, inference
from causegraph.sources import readers, sinks
from causegraph.streaming import processors


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def sources(folder):
    write(folder / "icd10/nodes.tsv", "code\tkind\tname\nA00\tcategory\tCholera\nA01\tcategory\tOther\n")
    write(folder / "icd10/edges.csv", "source,target,kind\nA00,A01,\nA00,B99,is_a\n")
    write(folder / "acme/nodes.tsv", "code\tkind\tname\nA00\tcategory\tCHOLERA\n")
    write(folder / "acme/edges.tsv", "source\ttarget\tkind\nA00\tA01\tx\n")
    write(folder / "who_va/categories.csv", 'who_va_id,who_va_name,icd10_codes\nVAs-01,Infections,\nVAs-01.01,Sepsis,"A00-A01, (B20)"\n')
    write(folder / "who_va/codes.tsv", "code\nA00\nA01\nB20\n")
    write(folder / "mondo/terms.obo", "format: 1\n\n[Term]\nid: MONDO:1\nname: one\nproperty_value: skos:exactMatch OMIM:5\n\n[Typedef]\nid: x\n")
    return folder


def test_build(spark, tmp_path, capsys):
    folder, out = sources(tmp_path / "in"), tmp_path / "out"
    assert main(["--build", str(folder), "--output", str(out)]) == 0
    shown = [json.loads(line) for line in capsys.readouterr().out.splitlines() if line.startswith("{")]
    assert {r["source"]: (r["n_nodes"], r["n_edges"]) for r in shown} == {"icd10": (2, 2), "acme": (1, 1), "who_va": (2, 4), "mondo": (1, 1)}
    nodes = readers.tsv(spark, f"{out}/icd10_nodes.tsv.gz")
    assert sorted(r.name for r in nodes.collect()) == ["Cholera", "Other"]
    report = lambda name: readers.tsv(spark, f"{out}/reports/{name}.tsv").collect()
    assert [(r.id, r.sources, r.conflicting_attrs) for r in report("duplicate_nodes")] == [("icd10:A00", "acme;icd10", "name")]
    assert {r.missing_id for r in report("missing_nodes")} == {"icd10:B99", "icd10:B20", "omim:5"}
    assert len(report("bridges")) == 5 and len(report("source_summary")) == 4
    made = json.loads("".join(open(f).read() for f in glob(f"{out}/manifest.json/part-*")))
    assert (made["total_nodes"], made["total_edges"], made["n_sources"]) == (6, 8, 4)
    kept = spark.read.parquet(f"{out}/graph/nodes").where("id = 'icd10:A00'").collect()
    assert [(r.name, r.source) for r in kept] == [("CHOLERA", "acme")]


def test_build_is_strict_on_demand(spark, tmp_path):
    folder = sources(tmp_path / "in")
    with pytest.raises(graph.DuplicateNodeError):
        build.build(spark, str(folder), str(tmp_path / "out"), strict=True)
    (folder / "who_va/codes.tsv").unlink()
    with pytest.raises(FileNotFoundError, match="who_va lacks codes"):
        build.read_inputs(spark, str(folder))


def test_preamble_lines_that_come_again_as_rows(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("x||y\nz\na||b\n1||2\nx||y\nx||y\na||b\n")
    got = sorted(tuple(r) for r in readers.tsv_after(spark, str(tmp_path / "a.tsv"), 2, "||").collect())
    assert got == [("1", "2"), ("a", "b"), ("x", "y"), ("x", "y")]


def test_sorted_files(spark, tmp_path):
    df = spark.range(5000).selectExpr("id * 7919 % 5000 AS k", "'v' AS v")
    sinks.tsv_gz(df, str(tmp_path / "a"), ["k"], 4)
    parts = [[int(r.k) for r in readers.tsv(spark, f).collect()] for f in sorted(glob(f"{tmp_path}/a/*.gz"))]
    assert len(parts) == 4 and sum(parts, []) == list(range(5000))


TERMS = [("Yellow fever", "MESH", "1", "yf"), ("fever", "HP", "2", "f"), ("Fever!", "DOID", "3", "f"), ("chest pain", "GO", "4", "cp"), ("pain in chest", "HP", "5", "pc"), ("..", "HP", "6", "")]


def test_dictionary(spark):
    terms = dictionary.term_table(spark.createDataFrame(TERMS, "text string, db string, id string, name string"))
    texts = spark.createDataFrame([(1, "Fever; yellow-fever, chest pain in chest"), (2, None), (3, ""), (4, "no term"), (1, "x")], "k int, text string")
    every = sorted((r.k, r.word, r.n_words, r.id) for r in dictionary.candidates(texts, terms, "k").collect())
    assert every == [(1, 0, 1, "2"), (1, 0, 1, "3"), (1, 1, 2, "1"), (1, 2, 1, "2"), (1, 2, 1, "3"), (1, 4, 3, "5")]
    best = sorted((r.word, r.n_words, r.id) for r in dictionary.best(dictionary.ground(texts, terms, "k"), "k").collect())
    assert best == [(0, 1, "3"), (1, 2, "1"), (4, 3, "5")]
    assert dictionary.candidates(texts, terms.where("false"), "k").count() == 0


def test_entities(spark):
    tag = dictionary.lexicon_tagger({"fever": "Disease", "aspirin": "Chemical", "yellow fever": "Disease"})

    def failing(sentence):
        if "broken" in sentence:
            raise RuntimeError
        return tag(sentence)

    text = "Yellow fever? It is.  Aspirin broke the Fever. broken fever! no"
    found = dictionary.entities(spark.createDataFrame([(1, text), (2, None)], "k int, text string"), failing, "k").collect()
    assert [(r.k, r.sentence, r.entity, r.start) for r in found] == [(1, 0, "Yellow fever", 0), (1, 2, "Fever", 18)]
    assert all(text[r.begin + r.start : r.begin + r.end] == r.entity for r in found)
    assert dictionary.sentences("One. Two!\nThree") == [(0, "One."), (5, "Two!"), (10, "Three")]


def test_components_are_made_anew_as_settings_change(spark):
    nodes = spark.createDataFrame([("a:1", "one", "a", [1.0, 0.0]), ("b:1", "uno", "b", [1.0, 0.0])], "id string, name string, label string, embedding array<double>")
    made = []
    makers = lambda kind, value: lambda: made.append(kind) or value
    extractors = {"lexicon": makers("lexicon", grounding.lexicon_client(["one"])), "other": makers("other", grounding.lexicon_client(["two"]))}
    g = grounding.Grounder(grounding.Settings(label="a"), nodes, extractors, {"hashing": makers("hashing", lambda x: [1.0, 0.0])})
    df = spark.createDataFrame([(1, "one and two")], "k int, text string")
    best = lambda: [(r.concept, r.match.id) for r in g.ground(df, "k").collect()]
    assert best() == [("one", "a:1")] and made == ["lexicon", "hashing"]
    g.update(extractor="other", label="b")
    assert best() == [("two", "b:1")] and made == ["lexicon", "hashing", "other"]
    with pytest.raises(ValueError, match="no vectors"):
        g.update(label="c")


def test_providers():
    assert inference.client(" Keywords ")("x\nnarrative:\n fever")["top_causes"][0]["probability"] == 1.0
    with pytest.raises(ValueError, match="no provider"):
        inference.client("none")


def test_running_mentions(spark):
    """Counts that are summed equal counts in the running text, whatever lies across the joints."""
    rng = random.Random(4)
    words = ["on the", "is", "the", "chest pain", "x"]
    rows = [(k, i, rng.choice(["on", "the", "", None, "chest", "pain", "is", "i", "s", "on the", "x x", "THE"])) for k in range(8) for i in range(25)]
    df = spark.createDataFrame(rows, "k int, i int, text string")
    slow = dialogue.running_text(df, "k", "i").withColumn("n", mentions(F.lower("all_text"), words))
    fast = dialogue.running_mentions(df, "k", "i", words, "n")
    key = lambda x: sorted((r.k, r.i, r.n) for r in x.select("k", "i", "n").collect())
    assert key(fast) == key(slow)
    with pytest.raises(ValueError):
        dialogue.running_mentions(df, "k", "i", ["ab ab"], "n")


def brute_spans(text, evidence, least=0.7):
    wanted, low, taken, out = [e.strip().lower() for e in evidence if e.strip()], text.lower(), [], {}
    free = lambda a, b: all(b <= x or a >= y for x, y in taken)
    for k, e in enumerate(wanted):
        at = [i for i in range(len(low)) if low.startswith(e, i) and free(i, i + len(e))]
        if at:
            taken.append((at[0], at[0] + len(e)))
            out[k] = (*taken[-1], "exact", text[at[0] : at[0] + len(e)], 1.0)
    words = [m.span() for m in re.finditer(r"\S+", text)]
    for k, e in enumerate(wanted):
        n, found = len(e.split()), []
        for size in range(n, n + 5) if k not in out else ():
            for i in range(len(words) - size + 1):
                a, b = words[i][0], words[i + size - 1][1]
                if free(a, b) and (r := SequenceMatcher(None, e, low[a:b]).ratio()) >= least:
                    found.append((-r, size, i, a, b))
        if found:
            r, _, _, a, b = min(found)
            taken.append((a, b))
            out[k] = (a, b, "fuzzy", text[a:b], -r)
    return [out[k] for k in sorted(out)]


def test_spans_against_brute_force():
    rng = random.Random(3)
    words = ["Fever", "cough", "chest", "pain", "the", "of", "a", "in", "severe", "acute", "x"]
    for _ in range(300):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 22)))
        evidence = [" ".join(rng.choice([*words, "fevre", "pian"]) for _ in range(rng.randint(0, 4))) for _ in range(rng.randint(0, 4))]
        assert edit.spans(text, evidence) == brute_spans(text, evidence), (text, evidence)


def streamed(spark, df, process, tmp_path, **trigger):
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", processors.ROCKSDB)
    out = process(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    return out, out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).trigger(**trigger).start(str(tmp_path / "out"))


def test_chunks_in_stream(spark, tmp_path):
    rows = [("a", 1, b"abc", False), ("a", 2, b"defg", False), ("a", 3, None, False), ("a", 4, b"h", True), ("b", 1, b"xy", False)]
    df = spark.createDataFrame(rows, "k string, i int, blob binary, end boolean")
    out, run = streamed(spark, df, lambda s: processors.chunk_stream(s, "k", "i", 3), tmp_path, availableNow=True)
    assert run.awaitTermination(60)
    got = spark.read.schema(out.schema).parquet(str(tmp_path / "out")).collect()
    assert sorted((r.k, r.chunk, bytes(r.blob)) for r in got if r.error is None) == [("a", 0, b"abc"), ("a", 1, b"def"), ("a", 2, b"gh")]
    assert [r.k for r in got if r.error] == ["a"]


def test_idle_gate_fires_without_input(spark, tmp_path):
    rows = [("a", 1, "two words", False), ("b", 1, "w " * 15, False), ("c", 1, "last", True)]
    df = spark.createDataFrame(rows, "k string, i int, text string, end boolean")
    out, run = streamed(spark, df, lambda s: processors.idle_gate_stream(s, "k", "i", 15, 1000), tmp_path, processingTime="1 second")
    try:
        import time

        until = time.time() + 60
        got = []
        while len(got) < 3 and time.time() < until:
            time.sleep(2)
            if glob(f"{tmp_path}/out/*.parquet"):
                got = spark.read.schema(out.schema).parquet(str(tmp_path / "out")).collect()
    finally:
        run.stop()
    assert {r.k: (r.n, r.why) for r in got} == {"a": (1, "idle"), "b": (1, "words"), "c": (1, "end")}


def test_files_arrive_as_a_stream(spark, tmp_path):
    """Files of a folder as a stream, one at a time."""
    for i in range(3):
        write(tmp_path / f"audio/{i}.raw", "x" * (i + 1))
    blobs = readers.audio_stream(spark, str(tmp_path / "audio")).selectExpr("length", "length(content) as n")
    run = blobs.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(str(tmp_path / "out"))
    run.awaitTermination()
    assert sorted((r.length, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, 1), (2, 2), (3, 3)]

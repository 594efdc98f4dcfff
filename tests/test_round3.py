"""Findings of round 3: queries on odd inputs and several files against their own SQL."""

from datetime import datetime, timedelta

import duckdb
import __spark_entry__


def same(spark, folder, name, *tables):
    """The query's rows and its SQL's, sorted."""
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in tables:
        c.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet/*.parquet')")
    key = lambda r: [(x is None, str(x)) for x in r]
    got = [tuple(r) for r in __spark_entry__.queries()[name](spark, str(folder)).collect()]
    return sorted(got, key=key), sorted(c.execute(__spark_entry__.oracle_sql()[name]).fetchall(), key=key)


def test_translated_odd_texts(spark, tmp_path):
    texts = ["groß und straße", "ᾀᾳ ῳΐ ﬀŉ", "\none", "one\n", "\t\n", "", "two\nwords", "a\x0bb", None, " x y "]
    rows = [(10 * i + j, t, lang) for i, t in enumerate(texts) for j, lang in enumerate(("en", "de", "fr", None))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got, wanted = same(spark, tmp_path, "inf_translated", "documents")
    assert got == wanted


def test_idle_stream_of_several_years(spark, tmp_path):
    """Micro-batches whose events lie further apart than any fixed delay lose none of them."""
    begin = datetime(2020, 1, 1)
    rows = [(i, i % 3, begin + timedelta(days=(i * 37) % 1000, minutes=i), "view" if i % 2 else "click") for i in range(120)]
    rows.sort(key=lambda r: r[2], reverse=True)
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz, event_type string").repartitionByRange(7, "event_id").write.parquet(f"{tmp_path}/events.parquet")
    got, wanted = same(spark, tmp_path, "dlg_idle_stream", "events")
    assert got == wanted and len(got) > 40


def test_spans_that_are_taken_apart_are_searched_once(spark, sf):
    from pyspark.sql import functions as F

    from causegraph.operators import grounding

    df = spark.createDataFrame([(1, "one two three", ["two"])], "id long, text string, evidences array<string>").repartition(2)
    plan = grounding.find_spans(df).select("id", F.posexplode("spans"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_places_of_a_batch_take_bounded_memory(monkeypatch):
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from causegraph.operators import dictionary

    rng = np.random.default_rng(3)
    hashes = rng.integers(0, 50, 2_000_000)
    ends = np.sort(rng.choice(len(hashes), 4000))
    words = pa.ListArray.from_arrays(pa.array([0, *ends, len(hashes)], pa.int32()), pa.array(hashes))
    bits = rng.integers(0, 256, dictionary.FILTER_BITS[0] // 8, dtype=np.uint8) & rng.integers(0, 256, dictionary.FILTER_BITS[0] // 8, dtype=np.uint8)
    tracemalloc.start()
    got = dictionary._places_of(words, (2, 3), bits, bits)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3 * hashes.nbytes and sum(map(len, got.to_pylist())) > 1000
    monkeypatch.setattr(dictionary, "WORDS", 1 << 40)
    assert got == dictionary._places_of(words, (2, 3), bits, bits)
    assert len(dictionary._places_of(words.slice(0, 0), (2, 3), bits, bits)) == 0


def test_import_shuffles_ends_and_not_edges(spark):
    from causegraph.operators import graph

    nodes = spark.createDataFrame([(f"n:{i}", "s") for i in range(50)] + [("n:1", "t"), (None, "t")], "id string, source string")
    rows = [(f"n:{i % 60}" if i % 11 else None, f"n:{i % 55}" if i % 13 else None, "k") for i in range(600)]
    edges = spark.createDataFrame(rows, "start_id string, end_id string, type string")
    kept = graph.keep_complete(edges, nodes)
    good = {f"n:{i}" for i in range(50)}
    assert sorted((r.start_id, r.end_id, r.type) for r in kept.collect()) == sorted(r for r in rows if r[0] in good and r[1] in good)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan
    assert sorted(graph.keep_complete(edges, nodes.limit(0)).collect()) == []
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where very many ids have no node
    try:
        assert sorted(map(str, graph.keep_complete(edges, nodes).collect())) == sorted(map(str, kept.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_exact_search_hands_on_about_k_rows_a_query(spark, tmp_path):
    import numpy as np
    from pyspark.sql import functions as F

    from causegraph.operators import vector_index

    x = np.random.default_rng(8).normal(size=(900, 16))
    nodes = spark.createDataFrame([(i, str(i), "one", v.tolist()) for i, v in enumerate(x)], "id long, name string, label string, embedding array<double>")
    index = vector_index.ensure(nodes, str(tmp_path), "one", cells=6)
    x /= np.linalg.norm(x, axis=1)[:, None]
    visits = spark.createDataFrame([(q, x[q].tolist(), -2.0, c) for q in range(20) for c in range(6)], "q int, vector array<double>, floor double, cell int")
    got = vector_index._reaching(index, visits, 5).collect()
    assert {(r.q, r.c) for r in got} == {(q, int(c)) for q in range(20) for c in np.argsort(-(x[:20] @ x.T), axis=1)[q, :5]} and len(got) == 100

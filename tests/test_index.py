"""The vector index in files: whole, opened without building, pruned, exact by its bounds, and of the wanted recall."""

import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from causegraph.operators import grounding, vector_index

SCHEMA = "id long, name string, label string, embedding array<float>"


def brute(ids, x, queries, k):
    """(q, [ids of the k most similar]), ties by id; vectors without a cosine are left out."""
    good = [i for i, v in enumerate(x) if v is not None and len(v) == len(x[0]) and np.isfinite(v).all() and np.any(v)]
    u = {i: np.array(x[i], float) / np.linalg.norm(x[i]) for i in good}
    return {q: [i for _, i in sorted((-round(float(np.dot(u[i], v / np.linalg.norm(v))), 12), ids[i]) for i in good)][:k] for q, v in queries}


def found(df):
    out = {}
    for r in df.orderBy("q", "rank").collect():
        out.setdefault(r.q, []).append(r.c)
    return out


@pytest.fixture(scope="module")
def clustered(spark, tmp_path_factory):
    """Nodes in clusters, a third of them in one, with copies, odd vectors and another label."""
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(12, 20))
    x = [(centre[0 if i % 3 == 0 else i % 12] + 0.3 * rng.normal(size=20)).astype(np.float32).tolist() for i in range(1500)]
    x[70] = x[71] = x[72]
    x[100], x[101], x[102], x[103], x[104] = None, [1.0, 2.0], [0.0] * 20, [float("nan")] + [1.0] * 19, [float("inf")] + [1.0] * 19
    nodes = spark.createDataFrame([(i, f"n{i}", "disease", v) for i, v in enumerate(x)] + [(9000, "other", "sign", [1.0] * 20), (9001, "bare", "bare", None)], SCHEMA)
    root = str(tmp_path_factory.mktemp("index"))
    return nodes, x, root, vector_index.ensure(nodes, f"file://{root}", "disease", cells=16)


def test_every_usable_node_is_indexed(spark, clustered):
    nodes, x, root, index = clustered
    ids = {r.id for r in index.table(spark, "vectors").collect()}
    assert ids == {i for i in range(1500) if i not in range(100, 105)} and index.n == 1495 and index.dim == 20
    codes = index.table(spark, "codes")
    assert codes.count() == 1495 and codes.select(F.octet_length("code").alias("n")).distinct().collect()[0].n == 3


def test_exact_search_equals_brute_force(spark, clustered):
    nodes, x, root, index = clustered
    queries = [(i, np.array(x[i], float)) for i in (0, 1, 2, 70, 71, 72, 500)] + [(-1, -np.array(x[0], float)), (-2, np.ones(20))]
    df = spark.createDataFrame([(q, v.tolist()) for q, v in queries] + [(-3, None), (-4, [0.0] * 20), (-5, [1.0])], "q long, vector array<double>")
    assert found(vector_index.search(index, df, 10, least=-1.0)) == brute(range(1500), x, queries, 10)
    assert found(vector_index.search(index, df, 2000, least=-1.0)) == brute(range(1500), x, queries, 2000)


def test_blocks_change_nothing(spark, clustered, monkeypatch):
    nodes, x, root, index = clustered
    monkeypatch.setattr(vector_index, "CODES_BLOCK", 50)
    monkeypatch.setattr(vector_index, "QUERIES_BLOCK", 4)
    queries = [(i, np.array(x[i], float)) for i in range(0, 90, 3)]
    df = spark.createDataFrame([(q, v.tolist()) for q, v in queries], "q long, vector array<double>")
    assert found(vector_index.search(index, df, 5, least=-1.0)) == brute(range(1500), x, queries, 5)


def test_floor_cuts_after_the_nearest_were_chosen(spark, clustered):
    nodes, x, root, index = clustered
    df = spark.createDataFrame([(0, x[0])], "q long, vector array<float>")
    near = vector_index.search(index, df, 10, least=0.999).collect()
    assert near and all((1 + r.cosine) / 2 >= 0.999 for r in near) and near[0].name == "n0"


def test_a_second_call_reads_and_does_not_build(spark, clustered):
    nodes, x, root, index = clustered
    unreadable = nodes.withColumn("embedding", F.expr("cast(raise_error('read again') as array<float>)"))
    again = vector_index.ensure(unreadable, f"file://{root}", "disease")
    assert again.n == index.n and again.probes == index.probes and np.array_equal(again.centroids, index.centroids) and np.array_equal(again.books, index.books)


def test_an_unfinished_index_is_made_anew(spark, clustered, tmp_path):
    nodes, x, root, index = clustered
    one = vector_index.ensure(nodes, f"file://{tmp_path}", "disease", cells=4)
    import shutil

    shutil.rmtree(f"{one.path.removeprefix('file://')}/about")
    assert vector_index.open_index(spark, one.path) is None
    assert vector_index.ensure(nodes, f"file://{tmp_path}", "disease", cells=4).n == one.n


def test_only_visited_cells_are_read(spark, clustered):
    nodes, x, root, index = clustered
    df = spark.createDataFrame([(0, x[0])], "q long, vector array<float>")
    visits = vector_index._visits(index, df.select("q", grounding.unit(F.col("vector")).alias("vector"), F.lit(-2.0).alias("floor")), 2)
    assert visits.count() == 2
    codes = index.table(spark, "codes").where(F.col("cell").isin([r.cell for r in visits.collect()]))
    assert len({f for f in codes.inputFiles()}) > 0
    plan = codes._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan
    read = {r.cell for r in codes.select("cell").distinct().collect()}
    assert len(read) == 2


def test_labels_without_vectors_are_skipped_with_a_warning(spark, clustered, tmp_path):
    nodes, x, root, index = clustered
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        made = vector_index.ensure_all(nodes, f"file://{tmp_path}", {"bare": ["embedding"], "absent": ["embedding"], "sign": ["embedding"]})
    assert [k for k, v in made.items() if v is None] == [("bare", "embedding"), ("absent", "embedding")] and len(said) >= 2
    assert made["sign", "embedding"].n == 1
    one = spark.createDataFrame([(1, [1.0] * 20)], "q long, vector array<double>")
    assert found(vector_index.search(made["sign", "embedding"], one)) == {1: [9000]}


def test_recall_on_the_given_vectors(spark, tmp_path):
    """Vectors without clusters, the hard case: queries are nodes that the number of probes was not chosen by."""
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    nodes = e.select(F.col("vec_id").alias("id"), F.lit("").alias("name"), F.lit("vec").alias("label"), "embedding")
    index = vector_index.ensure(nodes, f"file://{tmp_path}", "vec")
    queries = e.where("vec_id % 10 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("vector"))
    near = found(vector_index.search(index, queries, exact=False))
    rows = e.collect()
    true = brute([r.vec_id for r in rows], [r.embedding for r in rows], [(r.vec_id, np.array(r.embedding, float)) for r in rows if r.vec_id % 10 == 0], 10)
    got = sum(len({*near.get(q, ())} & {*ids}) for q, ids in true.items()) / sum(map(len, true.values()))
    assert got >= 0.95 and index.probes < len(index.centroids)

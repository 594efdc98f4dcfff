"""A vector index that is made once, kept in files, and opened by later calls.

An index belongs to one label and one property of the nodes, and is an inverted file with
residual product codes: every unit vector lies in the cell of the centroid most like it,
and what is left of it is written as one byte for each eight dimensions.  Two tables are
kept, both in one folder per cell: ``codes`` (id, code, error) and ``vectors`` (id, name,
vector).  A search reads the narrow table of the cells it visits, no other folder, and
only the candidates' vectors.  Centroids and code books are fitted on a bounded sample of
the nodes (SAMPLE rows by a hash of their ids); every node is indexed.

Two ways to search: with ``probes`` cells per query, chosen when the index is made so that
the wanted recall is reached on nodes taken as queries; or exactly, where a first search
gives each query the cosine that its k-th best must reach, and a second visits every
cell that can reach it (its vectors lie within a known angle of its centroid) and takes
products of blocks of whole vectors, so that about k rows a query leave it.

Vectors that are null, of another length than the first, of length zero or that hold null or
non-finite components are not indexed; such queries find nothing.  Of repeated ids each row
is indexed.  Work is dealt out as blocks of a cell's codes or vectors with blocks of the queries that
visit it, so a hot cell is many tasks.
"""

from __future__ import annotations

import json
import warnings
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window

from causegraph.functions import text as t
from causegraph.operators import grounding
from causegraph.storage import stored

#: The sample's rows, the most cells, dimensions of one byte of a code.
SAMPLE, CELLS, PART = 16_384, 512, 8
#: Rows of a block of codes, of vectors and of queries; of the candidates by code, so many for each wanted neighbour are compared exactly at first.
CODES_BLOCK, VECTORS_BLOCK, QUERIES_BLOCK, CANDIDATES = 65_536, 16_384, 1024, 16
RECALL, TRIALS = 0.97, 128
#: An exact search learns its floors from so many cells.
FIRST = 8
_SLACK = 1e-9


@dataclass(frozen=True)
class Index:
    """An index as it lies in a folder; ``reach`` is the least cosine of a cell's vectors to its centroid."""

    path: str
    label: str
    prop: str
    dim: int
    n: int
    probes: int
    candidates: int
    centroids: np.ndarray
    books: np.ndarray
    sizes: np.ndarray
    reach: np.ndarray

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(f"{self.path}/{name}")

    @property
    def parts(self) -> int:
        return self.books.shape[0]


def usable(vector: Column, dim: int) -> Column:
    """Whether a vector has a cosine: of the right length, finite throughout, not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) == dim) & finite & F.exists(vector, lambda x: x != 0)


def location(root: str, label: str, prop: str) -> str:
    return f"{root.rstrip('/')}/{label}_{prop}"


def open_index(spark: SparkSession, path: str) -> Index | None:
    """The index in a folder, None if there is none or its making was broken off: what describes it is written last."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/about/_SUCCESS")
    if not fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs):
        return None
    about = json.loads(spark.read.text(f"{path}/about", wholetext=True).first()[0])
    arrays = {k: np.array(about.pop(k)) for k in ("centroids", "books", "sizes", "reach")}
    return Index(path=path, **about, **arrays)


def ensure(nodes: DataFrame, root: str, label: str, prop: str = "embedding", cells: int | None = None, recall: float = RECALL) -> Index | None:
    """The index of a label's property, made if it isn't there; None, with a warning, if no node has a vector."""
    spark, path = nodes.sparkSession, location(root, label, prop)
    if (found := open_index(spark, path)) is not None:
        return found
    dim = grounding.vector_dimension(nodes, label, prop)
    if dim is None:
        warnings.warn(f"no vectors in {label}.{prop}: no index is made", stacklevel=2)
        return None
    own = nodes.where((F.col("label") == label) & usable(F.col(prop), dim))
    rows = own.select("id", "name", grounding.unit(_scaled(F.col(prop))).alias("vector"))
    sampled = rows.orderBy(F.xxhash64("id"), F.xxhash64("vector")).limit(SAMPLE).select("vector").toPandas()["vector"]
    if not len(sampled):
        warnings.warn(f"no usable vectors in {label}.{prop}: no index is made", stacklevel=2)
        return None
    x, n = np.stack(sampled.to_list()).astype(float), rows.count()
    rng = np.random.default_rng(17)
    centroids = _directions(x, min(cells or max(1, round(n**0.5)), CELLS, len(x)), rng)
    books = _code_books(x - centroids[np.argmax(x @ centroids.T, axis=1)], rng)
    held = rows.mapInArrow(_coder(centroids, books), f"cell int, id {rows.schema['id'].dataType.simpleString()}, name string, vector array<double>, code binary, error double, near double")
    held.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/all")
    held = spark.read.parquet(f"{path}/all")
    held.select("cell", "id", "code", "error").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/codes")
    held.select("cell", "id", "name", "vector").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
    sizes, reach = np.zeros(len(centroids), int), np.ones(len(centroids))
    for r in held.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("near").alias("near")).collect():  # as many rows as cells
        sizes[r.cell], reach[r.cell] = r.n, r.near
    made = _settled(Index(path, label, prop, dim, int(sizes.sum()), len(centroids), CANDIDATES, centroids, books, sizes, reach), rows, x, recall)
    about = {k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in made.__dict__.items() if k != "path"}
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/all")
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return made


def ensure_all(nodes: DataFrame, root: str, wanted: dict[str, list[str]]) -> dict[tuple[str, str], Index | None]:
    """An index for each label's properties."""
    return {(label, prop): ensure(nodes, root, label, prop) for label, props in wanted.items() for prop in props}


def _scaled(vector: Column) -> Column:
    """By the largest component, so that squares neither overflow nor vanish."""
    by_largest = lambda d: t.let(F.array_max(F.transform(d, lambda x: F.abs(x))), lambda m: F.transform(d, lambda x: x / m))
    return t.let(F.transform(vector, lambda x: x.cast("double")), by_largest)


def _directions(x: np.ndarray, k: int, rng, rounds: int = 12) -> np.ndarray:
    """Spherical k-means: unit centroids. One that no row is nearest to moves to the row that is least like its own."""
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        s = x @ c.T
        own = np.argmax(s, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        norm = np.linalg.norm(total, axis=1)
        lost = np.flatnonzero(norm < 1e-12)
        total[lost] = x[np.argsort(s[np.arange(len(x)), own])[: len(lost)]]
        norm[lost] = 1.0
        c = total / norm[:, None]
    return c


def _pieces(r: np.ndarray) -> np.ndarray:
    """(part, row, PART) of a table of vectors, filled up with zeros."""
    wide = np.pad(r, ((0, 0), (0, -r.shape[1] % PART)))
    return wide.reshape(len(r), -1, PART).transpose(1, 0, 2)


def _code_books(residuals: np.ndarray, rng, rounds: int = 8) -> np.ndarray:
    """(part, entry, PART): the entries of each part by k-means, 256 at most."""
    parts = _pieces(residuals)
    k = max(1, min(256, parts.shape[1] // 4))
    books = []
    for x in parts:
        c = x[rng.choice(len(x), k, replace=False)].copy()
        for _ in range(rounds):
            own = np.argmin((c * c).sum(1) - 2 * x @ c.T, axis=1)
            n = np.bincount(own, minlength=k)
            total = np.zeros_like(c)
            np.add.at(total, own, x)
            c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
        books.append(c)
    return np.stack(books)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(float)


def _coder(centroids: np.ndarray, books: np.ndarray):
    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                x = _matrix(part.column(2))
                s = x @ centroids.T
                cell = np.argmax(s, axis=1)
                left = _pieces(x - centroids[cell])
                codes = np.stack([np.argmin((c * c).sum(1) - 2 * y @ c.T, axis=1) for y, c in zip(left, books)], axis=1).astype(np.uint8)
                error = np.sqrt(sum(((y - c[codes[:, i]]) ** 2).sum(1) for i, (y, c) in enumerate(zip(left, books))))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell.astype(np.int32)), *part.columns, pa.array([r.tobytes() for r in codes], pa.binary()), pa.array(error), pa.array(s[np.arange(len(x)), cell])],
                    ["cell", "id", "name", "vector", "code", "error", "near"],
                )

    return run


def _settled(index: Index, rows: DataFrame, sample: np.ndarray, recall: float, k: int = grounding.TOP_K) -> Index:
    """The index with as many probes and candidates as sampled nodes, taken as queries, need to find so large a share of their
    true neighbours: the cells in which these lie give the first number, searches of the kind that will follow the last."""
    spark = rows.sparkSession
    x = sample[:TRIALS]
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "q int, vector array<double>")
    true = search(index, queries, k, least=-1.0).select("q", "c").toPandas()  # TRIALS * k rows, as below
    cells = index.table(spark, "vectors").select(F.col("id").alias("c"), "cell").join(F.broadcast(spark.createDataFrame(true)), "c").select("q", "cell").toPandas()
    order = np.argsort(np.argsort(-(x @ index.centroids.T), axis=1, kind="stable"), axis=1)
    needed = np.sort(order[cells["q"], cells["cell"]])
    # half of what may be missed goes to cells that are not visited, the rest to candidates chosen by code
    index = replace(index, probes=int(needed[int(np.ceil((1 + recall) / 2 * len(needed))) - 1]) + 1)
    wanted = set(zip(true["q"], true["c"]))
    while index.candidates * k < index.n:
        near = search(index, queries, k, least=-1.0, exact=False).select("q", "c").toPandas()
        if len(wanted & set(zip(near["q"], near["c"]))) >= recall * len(wanted):
            break
        index = replace(index, candidates=2 * index.candidates)
    return index


def _angles(x: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x, -1, 1))


def _visits(index: Index, queries: DataFrame, probes: int | None) -> DataFrame:
    """(q, vector, floor, cell): the cells that a query visits, the most similar ones, or all that can hold a cosine of its floor."""
    centroids, reach, full = index.centroids, index.reach, index.sizes > 0

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            s = _matrix(batch.column(1)) @ centroids.T
            if probes is not None:
                wanted = np.argsort(np.argsort(-np.where(full, s, -2), axis=1, kind="stable"), axis=1) < probes
            else:
                most = np.cos(np.maximum(0, _angles(s) - _angles(reach)))
                wanted = most >= batch.column(2).to_numpy(zero_copy_only=False)[:, None] - _SLACK
            row, cell = np.nonzero(wanted & full)
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(row)) for c in batch.columns), pa.array(cell.astype(np.int32))], ["q", "vector", "floor", "cell"])

    q = queries.schema["q"].dataType.simpleString()
    return queries.select("q", "vector", "floor").mapInArrow(run, f"q {q}, vector array<double>, floor double, cell int")


def _dealt(index: Index, visits: DataFrame, rows: DataFrame, size: int) -> tuple[DataFrame, DataFrame, tuple[str, ...]]:
    """Visits and rows (cell, id, ...) of the index in blocks of bounded size, each with each within a cell, and the columns that name a pair of blocks."""
    asked = {r.cell: r.n for r in visits.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # as many rows as cells
    deal = visits.sparkSession.createDataFrame([(c, -(-int(index.sizes[c]) // size), -(-n // QUERIES_BLOCK)) for c, n in asked.items()], "cell int, rows int, queries int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    block = lambda key, n: F.pmod(F.xxhash64(F.lit(5), key), F.col(n).cast("long")).cast("int")
    left = visits.join(F.broadcast(deal), "cell").select("cell", block("q", "queries").alias("i"), every("rows").alias("j"), "q", "vector", "floor")
    own = rows.where(F.col("cell").isin(list(asked)))  # the folders of no other cell are read
    right = own.join(F.broadcast(deal), "cell").select("cell", every("queries").alias("i"), block("id", "rows").alias("j"), *[c for c in rows.columns if c != "cell"])
    return left, right, ("cell", "i", "j")


def _candidates(index: Index, visits: DataFrame, most: int) -> DataFrame:
    """(q, cell, c, score): codes whose score by the code is among the best."""
    centroids, books = index.centroids, index.books
    codes = index.table(visits.sparkSession, "codes").select("cell", "id", "code")
    left, right, keys = _dealt(index, visits, codes, CODES_BLOCK)
    kinds = visits.schema["q"].dataType.simpleString(), codes.schema["id"].dataType.simpleString()

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        cell, out = key[0].as_py(), []
        code = np.frombuffer(b"".join(right.column("code").to_pylist()), np.uint8).reshape(right.num_rows, -1)
        for a in range(0, left.num_rows if right.num_rows else 0, 64):
            part = left.slice(a, 64)
            x = _matrix(part.column("vector").combine_chunks())
            score = np.repeat((x @ centroids[cell])[:, None], len(code), axis=1)
            for i, (y, book) in enumerate(zip(_pieces(x), books)):
                score += (y @ book.T)[:, code[:, i]]
            at = np.argpartition(-score, min(most, len(code)) - 1, axis=1)[:, :most]
            row, at = np.repeat(np.arange(len(x)), at.shape[1]), at.ravel()
            out.append(pa.table({"q": part.column("q").take(pa.array(row)), "cell": np.full(len(row), cell, np.int32), "c": right.column("id").take(pa.array(at)), "score": score[row, at]}))
        empty = pa.table({"q": left.column("q").slice(0, 0), "cell": np.zeros(0, np.int32), "c": right.column("id").slice(0, 0), "score": np.zeros(0)})
        return pa.concat_tables(out) if out else empty

    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, f"q {kinds[0]}, cell int, c {kinds[1]}, score double")
    w = Window.partitionBy("q").orderBy(F.desc("score"), "c")
    return found.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most).drop("_k")


def _reaching(index: Index, visits: DataFrame, k: int) -> DataFrame:
    """(q, cell, c): the vectors of the visited cells that may be among a query's k nearest, by products of blocks of whole vectors.
    A block gives k of them for a query and those as near but for _SLACK, and of all blocks' only such stay."""
    vectors = index.table(visits.sparkSession, "vectors").select("cell", "id", "vector")
    left, right, keys = _dealt(index, visits, vectors, VECTORS_BLOCK)
    kinds = visits.schema["q"].dataType.simpleString(), vectors.schema["id"].dataType.simpleString()

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = [pa.table({"q": left.column("q").slice(0, 0), "c": right.column("id").slice(0, 0), "score": np.zeros(0)})]
        held = _matrix(right.column("vector").combine_chunks()) if right.num_rows else None
        for a in range(0, left.num_rows if right.num_rows else 0, 64):
            part = left.slice(a, 64)
            score = _matrix(part.column("vector").combine_chunks()) @ held.T
            least = part.column("floor").to_numpy()[:, None]
            if score.shape[1] > k:
                least = np.maximum(least, -np.partition(-score, k - 1, axis=1)[:, k - 1 : k])
            row, at = np.nonzero(score >= least - _SLACK)
            out.append(pa.table({"q": part.column("q").take(pa.array(row)), "c": right.column("id").take(pa.array(at)), "score": score[row, at]}))
        return pa.concat_tables(out).append_column("cell", pa.array(np.full(sum(map(len, out)), key[0].as_py(), np.int32))).select(["q", "cell", "c", "score"])

    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, f"q {kinds[0]}, cell int, c {kinds[1]}, score double")
    ranked = found.withColumn("_k", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"))))
    least = F.max(F.when(F.col("_k") == k, F.col("score"))).over(Window.partitionBy("q"))
    return ranked.withColumn("_least", least).where(F.col("_least").isNull() | (F.col("score") >= F.col("_least") - _SLACK)).select("q", "cell", "c")


def _nearest(index: Index, queries: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """(q, c, name, rank, cosine) of the candidates with the highest cosines, from their own vectors, equal ones by c."""
    spark = queries.sparkSession
    vectors = index.table(spark, "vectors").select("cell", F.col("id").alias("c"), "name", F.col("vector").alias("_v"))
    full = found.select("q", "cell", "c").distinct().join(vectors, ["cell", "c"]).join(queries.select("q", "vector"), "q")
    w = Window.partitionBy("q").orderBy(F.desc(F.round("cosine", 12)), "c")
    out = full.select("q", "c", "name", grounding.dot(F.col("vector"), F.col("_v")).alias("cosine"))
    return out.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k).select("q", "c", "name", "rank", "cosine")


def search(index: Index, queries: DataFrame, k: int = grounding.TOP_K, least: float = grounding.LEAST_SIMILARITY, exact: bool = True, probes: int | None = None) -> DataFrame:
    """(q, c, name, rank, cosine): the k indexed nodes most similar to each query (q, vector), ties by c. The rescaled cosine
    (1 + cos) / 2 must reach ``least``, after the k were chosen. Exact, or within ``probes`` cells (those of the index if not given)."""
    vector = grounding.unit(_scaled(F.col("vector"))).alias("vector")
    asked = stored(queries.where(usable(F.col("vector"), index.dim)).select("q", vector, F.lit(-2.0).alias("floor")), "queries")
    near = _visits(index, asked, min(probes or index.probes, FIRST) if exact else probes or index.probes)
    out = _nearest(index, asked, _candidates(index, stored(near, "visits"), k * index.candidates), k)
    if exact:
        kth = out.groupBy("q").agg(F.when(F.count(F.lit(1)) == k, F.min("cosine")).otherwise(F.lit(-2.0)).alias("floor"))
        known = asked.drop("floor").join(kth, "q", "left").withColumn("floor", F.coalesce("floor", F.lit(-2.0)))
        out = _nearest(index, asked, stored(_reaching(index, stored(_visits(index, known, None), "visits"), k), "reaching"), k)
    return out.where((1 + F.col("cosine")) / 2 >= least)

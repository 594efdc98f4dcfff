"""Operator 10: near-duplicate embeddings by spherical k-means cells.

Equal vectors of a label are first reduced to one with a count.  The vectors of a label
and dimension are a cell to begin with.  A cell of more than CELL_ROWS vectors is split by
spherical k-means, whose centroids are fitted on a bounded sample of the cell; cells that
are still too large are split again, level by level, so their number grows with the table
while a task holds the centroids of one cell only.  Within a split every vector goes to the
cell of its nearest centroid, its home.  Two vectors at an angle of at most t have homes
that neither is more than 2t farther from than from its own, so each vector also visits
the earlier cells that near: no linked pair is missed.  A pair meets as visitors only, at
some level, in all cells but one.  Within a cell all others are compared by blocked cosine
products in double precision.  A cell of any size is dealt out as pairs of blocks of
bounded size; a task returns link counts and a spanning forest of the links it found,
never the pairs themselves.

A cell is split only if that halves the comparisons at least, visits included, and if its
vectors visit few cells: with vectors that form no clusters more cells would only copy, and
blocks do the work.

Vectors that are null, zero or hold null or non-finite components link with nothing,
nor do those without a label; vectors of unequal dimension aren't compared.  Vectors are
scaled by their largest component first, so no norm overflows or vanishes.  Rows that
repeat a vector are vectors of their own, linked with each other, also where they repeat
the vec_id.  Columns but these three are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from causegraph.llm.common import bounds_of, components, grouped, in_blocks, roots_of, row_ids
from causegraph.storage import stored

LEAST_COSINE = 0.98
#: A cell's rows before it is split, expected rows of the sample its centroids are fitted on, their number, and the levels.
CELL_ROWS, SAMPLE_ROWS, CELLS, LEVELS = 1000, 10_000, 1024, 8
#: Cells that a vector may visit on average in the first split and in each later one.
VISITS, ROUNDS = (3.0, 0.25), 8
BLOCK, ASSIGN_ROWS = 1024, 20_000
_SLACK = 1e-6


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 10) -> np.ndarray:
    """Unit centroids of unit vectors; empty cells keep their centroid."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        home = np.concatenate([np.argmax(x[a : a + 4096] @ c.T, 1) for a in range(0, len(x), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, home, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 1e-12, total / np.maximum(norm, 1e-12), c)
    return c


def _visits(x: np.ndarray, c: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Home of each vector, and the earlier cells it visits as a mask."""
    angle = np.arccos(np.clip(x @ c.T, -1, 1))
    home = np.argmin(angle, 1)
    near = angle <= angle[np.arange(len(x)), home][:, None] + 2 * reach + _SLACK
    return home, near & (np.arange(len(c)) < home[:, None])


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(vectors: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    return _unit(flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))


def centroids(sample: np.ndarray, rows: int, reach: float, cell_rows: int = CELL_ROWS, most: float = VISITS[0]) -> np.ndarray:
    """Centroids for a cell of so many rows: of numbers that double, the one that leaves the fewest comparisons, which are
    as (1 + visits)^2 / number; a single one if none halves them."""
    k, best, least = 2, spherical_kmeans(sample, 1), 0.5 + 1e-9
    while k <= CELLS and (k - 1) * cell_rows < 4 * rows and k <= len(sample):
        c = spherical_kmeans(sample, k)
        visits = np.concatenate([_visits(sample[a : a + 1024], c, reach)[1].sum(1) for a in range(0, len(sample), 1024)]).mean()
        if visits > most:
            break
        if (1 + visits) ** 2 / k <= least:
            best, least = c, (1 + visits) ** 2 / k
        k *= 2
    return best


def _split(cells: DataFrame, large: DataFrame, level: int, reach: float, cell_rows: int) -> DataFrame:
    """Rows of ``cells`` in the cells named by ``large`` (cell, n), each in its home and the cells it visits."""
    kind = cells.schema["embedding"].dataType.simpleString()
    rows = cells.join(large, "cell")
    chosen = F.pmod(F.xxhash64(F.lit(100 + level), "rep"), F.lit(1 << 30)) < SAMPLE_ROWS / F.col("n") * (1 << 30)

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by("rep")
        c = centroids(_matrix(table["embedding"], table["dim"][0].as_py()), table["n"][0].as_py(), reach, cell_rows, VISITS[min(level, 1)])
        return pa.table({"cell": table["cell"][:1], "n": table["n"][:1], "centres": pa.array([c.tobytes()], pa.binary())})

    sample = rows.where(chosen).select("cell", "n", "rep", "dim", "embedding")
    centres = stored(sample.groupBy("cell").applyInArrow(fit, "cell long, n long, centres binary"), "centres")
    tasks = F.ceil(F.col("n") / ASSIGN_ROWS)
    task = lambda number: F.xxhash64(F.lit(11), "cell", number)
    heads = centres.select("cell", F.explode(F.sequence(F.lit(0).cast("long"), tasks - 1)).alias("number"), "centres")
    heads = heads.select(task(F.col("number")).alias("task"), F.lit(-1).cast("long").alias("rep"), "centres")
    columns = ["rep", "copies", "embedding", "dim", "cell", "visits"]
    dealt = rows.select(task(F.pmod(F.xxhash64(F.lit(13), "rep"), tasks)).alias("task"), *columns, F.lit(None).cast("binary").alias("centres"))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = np.zeros((1, 1))
        for batch in batches:
            bounds = bounds_of(batch.column("task").to_numpy()) if batch.num_rows else [0]
            for a, b in zip(bounds, bounds[1:]):
                part = batch.slice(a, b - a)
                raw = part.column("centres")[0].as_py()
                if raw is not None:  # the first row of a task
                    centre, part = np.frombuffer(raw), part.slice(1)
                if not part.num_rows:
                    continue
                dim = part.column("dim")[0].as_py()
                home, near = _visits(_matrix(part.column("embedding"), dim), centre.reshape(-1, dim), reach)
                own, other = np.nonzero(near)
                take = np.concatenate([np.arange(len(home)), own])
                out = part.select(columns).take(pa.array(take))
                bit = np.where(np.arange(len(take)) < len(home), 0, 1 << level)
                visits = pa.array(out.column("visits").to_numpy() | bit)
                yield pa.RecordBatch.from_arrays([*out.columns[:-1], visits, pa.array(np.concatenate([home, other]), pa.int64())], [*columns, "sub"])

    both = dealt.unionByName(heads, allowMissingColumns=True).repartition("task").sortWithinPartitions("task", "rep")
    split = both.mapInArrow(assign, f"rep long, copies long, embedding {kind}, dim int, cell long, visits long, sub long")
    return split.withColumn("cell", F.xxhash64("cell", "sub")).drop("sub")


def _in_cells(vectors: DataFrame, reach: float, cell_rows: int) -> DataFrame:
    """Rows (rep, copies, embedding, dim, cell, visits); bit k of ``visits`` says that a row is a visitor at level k."""
    cells = stored(vectors.withColumn("visits", F.lit(0).cast("long")), "cells")
    for level in range(LEVELS):
        sizes = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
        large = sizes.where(F.col("n") > cell_rows)
        if level:  # a cell that the last split left whole is not split again
            large = large.join(before, ["cell", "n"], "left_anti")
        large = stored(large, "large")
        if large.isEmpty():
            break
        before = large.select(F.xxhash64("cell", F.lit(0).cast("long")).alias("cell"), "n")
        split = _split(cells, large, level, reach, cell_rows)
        cells = stored(cells.join(large.select("cell"), "cell", "left_anti").unionByName(split), "cells")
    return cells


def _links(least: float):
    """Per vector of a task: rows it links with, and a vector of its piece of the links found."""

    def run(table: pa.Table) -> pa.Table:
        ids, copies, visits = (table.column(c).to_numpy() for c in ("rep", "copies", "visits"))
        block, two = table.column("block").to_numpy(), table.column("two").to_numpy(zero_copy_only=False)
        links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
        bounds = bounds_of(table.column("task").to_numpy())
        for a, b in zip(bounds, bounds[1:]):
            if b - a < 2:
                continue
            x = _matrix(table.column("embedding").slice(a, b - a), table.column("dim")[a].as_py())
            linked = np.zeros((b - a, b - a), bool)
            for i in range(0, b - a, 512):
                part = slice(a + i, min(a + i + 512, b))
                ok = x[i : i + 512] @ x.T >= least
                ok &= (visits[part, None] & visits[None, a:b]) == 0  # two visitors meet in another cell
                if two[a]:
                    ok &= block[part, None] != block[None, a:b]  # pairs within a block have their own task
                linked[i : i + 512] = ok
            np.fill_diagonal(linked, False)
            links[a:b] = [copies[a:b][row].sum() for row in linked]
            i, j = np.nonzero(linked)
            root[a:b] = a + roots_of(b - a, i, j)
        at = np.flatnonzero(links)
        return pa.table({"rep": pa.array(ids[at]), "links": pa.array(links[at]), "root": pa.array(ids[root[at]])})

    return run


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = LEAST_COSINE, cell_rows: int = CELL_ROWS, block: int = BLOCK) -> DataFrame:
    """Per row: key, n_links, component_id, kept. Cells of more than ``cell_rows`` vectors are split; a task compares two blocks."""
    reach = float(np.arccos(least))
    v = F.col(vector)
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    valid = F.coalesce(F.col(label).isNotNull() & v.isNotNull() & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0), F.lit(False))
    same = lambda seed: F.when(valid, F.xxhash64(F.lit(seed), label, vector))
    rows = df.select(F.col(key).cast("long").alias("vec_id"), v.alias("embedding"), F.col(label).alias("label"), same(1).alias("h1"), same(2).alias("h2"))
    reps = rows.where("h1 is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first(F.struct("embedding", "label")).alias("v"))
    reps = reps.select("h1", "h2", "least", "copies", F.col("v.embedding").alias("embedding"), F.col("v.label").alias("label"), F.size("v.embedding").alias("dim"))
    reps = stored(row_ids(reps, "rep"), "vectors")

    cells = _in_cells(reps.select("rep", "copies", "embedding", "dim", F.xxhash64(F.lit(14), "label", "dim").alias("cell")), reach, cell_rows)
    sizes = stored(cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")
    n = F.col("n")
    tasks = in_blocks(cells.join(sizes, "cell"), "cell", F.ceil(n / block)).select("task", "block", "two", "rep", "copies", "visits", "dim", "embedding")
    found = stored(grouped(tasks, _links(least), "rep long, links long, root long"), "links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(found.select("rep", "root"), "rep", "root").withColumnsRenamed({"node": "rep", "root": "component"})
    whole = stored(reps.select("h1", "h2", "rep", "copies", "least").join(links, "rep", "left").join(roots, "rep", "left"), "members")
    first = stored(whole.where("component is not null").groupBy("component").agg(F.min("least").alias("first")), "components")
    whole = whole.join(first, "component", "left")
    whole = whole.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("first", "least").alias("component_id"))
    out = rows.select("vec_id", "h1", "h2").join(whole, ["h1", "h2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(F.col("vec_id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op10_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: Brute force: all pairs of a label, and the closure of their links.
ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT vec_id, label, e, sqrt(list_inner_product(e, e)) AS norm FROM v),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND a.norm > 0 AND b.norm > 0
  WHERE list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, p.b FROM reach JOIN p ON reach.b = p.a),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a), c AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.c AS component_id, e.vec_id = c.c AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id JOIN c ON c.a = e.vec_id"""

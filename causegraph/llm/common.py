"""What several operators share: gapless numbering, components, columns made in Python, free names."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window

from causegraph.storage import stored

_SUPER = 1024


def fresh(df: DataFrame, *names: str, also: tuple[str, ...] = ()) -> list[str]:
    """Names for working columns that no column of ``df`` has, nor ``also``."""
    taken, out = {c.lower() for c in (*df.columns, *also)}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def row_ids(df: DataFrame, out: str) -> DataFrame:
    """Adds a long that differs in every row. It holds only once written: store the table before it is used twice."""
    return df.withColumn(out, F.monotonically_increasing_id())


def numbered(df: DataFrame, group: list[str], row: str, out: str, buckets: Column | int) -> DataFrame:
    """Number the rows of each group 0, 1, 2, ... without gaps into the long column ``out``.

    ``df`` is a stored table and ``row`` a column with another value in every row, so
    rows that are equal otherwise part too. A group may hold any share of the rows: a
    hash of ``row`` splits it into ``buckets`` (a number, or a column that is constant
    within a group), and each bucket is numbered by itself. Where each begins comes from
    prefix sums in two steps, over the buckets of every thousand and over the thousands,
    so no task meets all buckets of a large group either.
    """
    b, s, n, before, rank = fresh(df, "b", "s", "n", "before", "rank", also=(out,))
    many = F.lit(buckets) if isinstance(buckets, int) else buckets
    bucket = F.pmod(F.xxhash64(F.lit(12), row), many.cast("long"))
    df = df.withColumns({b: bucket, s: F.floor(bucket / _SUPER)})
    counts = df.groupBy(*group, s, b).agg(F.count(F.lit(1)).alias(n))
    former = lambda w: F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    above = counts.groupBy(*group, s).agg(F.sum(n).alias(n))
    above = above.withColumn(before, former(Window.partitionBy(*group).orderBy(s))).drop(n)
    begin = counts.withColumn(rank, former(Window.partitionBy(*group, s).orderBy(b))).join(above, [*group, s])
    begin = begin.select(*group, b, (F.col(before) + F.col(rank)).alias(before))
    within = Window.partitionBy(*group, b).orderBy(row)
    ranked = df.drop(s).withColumn(rank, F.row_number().over(within) - 1)
    return ranked.join(begin, [*group, b]).withColumn(out, (F.col(before) + F.col(rank)).cast("long")).drop(b, rank, before)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected edge table with long ends.

    Returns (node, root) for each node of an edge, root being the smallest node of
    its component.  Alternating large-star and small-star steps (Kiveris et al.,
    2014): each is one aggregation with map-side combine and one join, and the
    table never holds more rows than the edges it began with.  The least neighbours are
    stored before they are joined, so that Spark can split a node with very many edges.
    """
    e = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "cc")
    while not _stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc")
        # large star: each larger neighbour of u is linked to the smallest node near u
        e = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its smaller neighbours are linked to the smallest of them
        e = stored(e, "cc")
        low = stored(e.groupBy("u").agg(F.min("v").alias("m")), "cc")
        small = e.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        e = stored(small.where("u <> v").distinct(), "cc")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _stars(e: DataFrame) -> bool:
    """Whether edges (u, v), v the smaller, are stars: every u has one v, and no v is a u. Then the v are the components' roots."""
    ends = e.groupBy("u").agg(F.count(F.lit(1)).alias("up"), F.lit(False).alias("hub")).unionByName(e.select("v").distinct().select(F.col("v").alias("u"), F.lit(0).cast("long").alias("up"), F.lit(True).alias("hub")))
    bad = ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("hub").alias("hub")).where("up > 1 or (up > 0 and hub)")
    return bad.isEmpty()


def roots_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of each row's component under the links a-b."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new
    return root


def grouped(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """Apply ``run`` to Arrow tables of whole tasks: rows of one task number follow one another,
    and a task has a bounded number of rows."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            task = table.column("task").to_numpy()
            last = int(np.searchsorted(task, task[-1], "left"))
            if last:
                yield from run(table.slice(0, last).combine_chunks()).to_batches()
            rest = table.slice(last)
        if rest is not None and rest.num_rows:
            yield from run(rest.combine_chunks()).to_batches()

    return df.repartition("task").sortWithinPartitions("task").mapInArrow(apply, schema)


def in_blocks(df: DataFrame, group: str, size: Column, rep: str = "rep") -> DataFrame:
    """Deal each group out as tasks, one for each pair of its blocks; adds task, block, and whether a task has two blocks.
    ``size`` is the number of blocks."""
    df = df.withColumn("_of", size.cast("int")).withColumn("block", F.pmod(F.xxhash64(F.lit(3), rep), F.col("_of").cast("long")).cast("int"))
    df = df.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_of") - 1)))
    i, j = F.least("block", "_other"), F.greatest("block", "_other")
    return df.withColumns({"task": F.xxhash64(F.lit(4), group, i, j), "two": i != j}).drop("_of", "_other")


def bounds_of(task: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(np.diff(task)) + 1, [len(task)]])


def with_columns(df: DataFrame, run, added: str, text: str, keep: list[str] | None = None) -> DataFrame:
    """Rows of ``df`` with columns that ``run`` makes from a batch of one column's values.

    ``run`` gets an Arrow array and returns one Arrow array per column of the schema
    string ``added``.  The text crosses to Python once; it comes back only if kept.
    """
    from pyspark.sql.types import StructType, _parse_datatype_string

    new = _parse_datatype_string(added)
    names = [c for c in (df.columns if keep is None else keep) if c not in new.names]
    sent = names if text in names else [*names, text]
    at = sent.index(text)

    def apply(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *run(batch.column(at))], [*names, *new.names])

    fields = {f.name: f for f in df.schema.fields}
    return df.select(*[F.col(f"`{c}`") for c in sent]).mapInArrow(apply, StructType([*(fields[c] for c in names), *new.fields]))


def crc(c: Column | str) -> Column:
    """crc32 of a text's UTF-8 bytes; null counts as empty."""
    return F.crc32(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")).cast("binary"))


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df

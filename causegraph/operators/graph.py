"""Property graphs as DataFrames: quality control, merging, reports and import.

Nodes: id, label, name and further attributes, with the source they come from.
Edges: start_id, end_id, type, source and properties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F, Window

from causegraph.functions.text import namespace
from causegraph.storage import stored


class DuplicateNodeError(ValueError):
    """Nodes of one id contradict each other."""


class MissingNodeError(ValueError):
    """An edge ends at an id that no node has."""


class BadImportError(ValueError):
    """An import rejected more rows than it tolerates."""


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Union by name; attributes that a frame lacks are NULL there."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def _attributes(nodes: DataFrame, skip: tuple[str, ...]) -> list[str]:
    return [c for c in nodes.columns if c not in skip]


def _latest(nodes: DataFrame, row_no: str | None) -> DataFrame:
    """One record per source and id, the last one by row number."""
    if row_no is None:
        return nodes.dropDuplicates(["source", "id"])
    w = Window.partitionBy("source", "id").orderBy(F.desc(row_no))
    return nodes.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def _merged(nodes: DataFrame, row_no: str | None = None) -> tuple[DataFrame, list[str]]:
    """Per id that occurs more than once: sources, and per attribute its first value (in the
    order of the sources' names) and whether values differ.  NULL never conflicts."""
    attrs = _attributes(nodes, ("id", "source", row_no or ""))
    one = _latest(nodes, row_no)
    aggs = [F.array_sort(F.collect_set("source")).alias("_sources")]
    for a in attrs:
        v = F.col(f"`{a}`").cast("string")
        aggs.append(F.min_by(F.col(f"`{a}`"), F.when(v.isNotNull(), F.col("source"))).alias(a))
        aggs.append((F.min(v) != F.max(v)).alias(f"_differs_{a}"))
    often = nodes.groupBy("id").agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1")
    return one.join(often, "id", "left_semi").groupBy("id").agg(*aggs), attrs


def duplicate_report(nodes: DataFrame, row_no: str | None = None, strict: bool = False) -> DataFrame:
    """id, n_sources, sources, n_conflicting_attrs, conflicting_attrs of ids that occur more than once."""
    merged, attrs = _merged(nodes, row_no)
    names = F.array_sort(F.array_compact(F.array(*[F.when(F.col(f"`_differs_{a}`"), F.lit(a)) for a in attrs])))
    out = merged.select("id", F.size("_sources").cast("long").alias("n_sources"), F.array_join("_sources", ";").alias("sources"), F.size(names).cast("long").alias("n_conflicting_attrs"), F.array_join(names, ";").alias("conflicting_attrs"))
    if strict and not out.where("n_conflicting_attrs > 0").isEmpty():
        raise DuplicateNodeError("nodes of one id have conflicting attributes")
    return out.orderBy(F.desc("n_conflicting_attrs"), F.desc("n_sources"), F.asc("id"))


def combined_nodes(nodes: DataFrame, row_no: str | None = None) -> DataFrame:
    """One node for each id that occurs more than once, with ``sources`` joined by semicolons."""
    merged, attrs = _merged(nodes, row_no)
    return merged.select("id", *[f"`{a}`" for a in attrs], F.array_join("_sources", ";").alias("sources"))


def missing_nodes(nodes: DataFrame, edges: DataFrame, strict: bool = False) -> DataFrame:
    """source, missing_id, count: ends of edges (both counted) that no node has."""
    ends = edges.select("source", F.explode(F.array("start_id", "end_id")).alias("missing_id"))
    out = ends.groupBy("source", "missing_id").agg(F.count(F.lit(1)).alias("count")).join(nodes.select(F.col("id").alias("missing_id")).distinct(), "missing_id", "left_anti")
    if strict and (first := out.first()) is not None:
        raise MissingNodeError(f"{first.source}: {first.missing_id} has no node")
    return out.select("source", "missing_id", "count").orderBy("source", F.desc("count"), "missing_id")


def first_by_id(nodes: DataFrame, order: list[Column]) -> DataFrame:
    """One node per id, the first in the given order."""
    w = Window.partitionBy("id").orderBy(*order)
    return nodes.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def keep_complete(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which both ends are nodes.

    Spark finds the ids that no node has among the distinct ends, of which each task hands on one, and edges meet only these; they are
    a table of their own, so that it is broadcast where it is small, and else the edges of a hub are split.
    """
    ids = stored(nodes.select("id").distinct(), "ids")
    ends = edges.select(F.explode(F.array("start_id", "end_id")).alias("id")).where("id is not null").distinct()
    missing = stored(ends.join(ids, "id", "left_anti"), "missing")
    known = edges.where("start_id is not null and end_id is not null")
    return known.join(missing.withColumnRenamed("id", "start_id"), "start_id", "left_anti").join(missing.withColumnRenamed("id", "end_id"), "end_id", "left_anti")


def import_graph(nodes: DataFrame, edges: DataFrame, order: list[Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """Bulk import: typed columns, the first node of each id, and edges between nodes that exist."""
    nodes, edges = typed(nodes), typed(edges)
    first = first_by_id(nodes, order or [F.col("source")])
    return first, keep_complete(edges, nodes)  # the ids are the same as those of the first nodes, without their sort


def checked_import(nodes: DataFrame, edges: DataFrame, order: list[Column] | None = None, tolerance: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame, dict[str, int]]:
    """Bulk import that accounts for every row: nodes, edges, rejects and the number of rejects by reason.

    Rejected are, by the first reason that holds: nodes and edges with a ``value`` that its column's type cannot
    hold, elements of arrays included (but text that is empty is null), nodes without an id (``no id``), nodes of an id that an earlier one in the
    order has (``duplicate``; of rows that are equal in the order any one stays), and edges whose start or end is no
    imported node (``no start``, ``no end``; a null end is none).  rejects: kind, reason, start_id (a node's id),
    end_id, source, and the values as read in ``row`` (JSON).  The numbers are observed while the rejects are written;
    beyond ``tolerance`` of them the import fails before it returns a table.
    """
    n, e = _accounted(nodes), _accounted(edges)
    reason = F.when(~F.col("_fits"), "value").when(F.col("id").isNull(), "no id")
    n = stored(n.withColumns({"_reason": reason, "_no": F.monotonically_increasing_id()}), "import_nodes")
    # Spark keeps one row of each id in a task before it shuffles for the first one; rows meet them by their numbers and
    # edges by ids that are a table of their own, so that neither an id of very many rows nor a hub is one task's work
    ids = stored(first_by_id(n.where("_reason is null"), order or [F.col("source")]).select("id", "_no"), "import_ids")
    n = n.join(ids.select("_no", F.lit(True).alias("_first")), "_no", "left")
    n = stored(n.withColumn("_reason", F.coalesce("_reason", F.when(F.col("_first").isNull(), "duplicate"))), "import_nodes")
    for end in ("start", "end"):
        e = e.join(ids.select(F.col("id").alias(f"{end}_id"), F.lit(True).alias(f"_{end}")), f"{end}_id", "left")
    reason = F.when(~F.col("_fits"), "value").when(F.col("_start").isNull(), "no start").when(F.col("_end").isNull(), "no end")
    e = stored(e.withColumn("_reason", reason), "import_edges")

    def rejected(df: DataFrame, kind: str, start: str, end: Column) -> DataFrame:
        return df.where("_reason is not null").select(F.lit(kind).alias("kind"), F.col("_reason").alias("reason"), F.col(start).alias("start_id"), end.alias("end_id"), "source", F.col("_row").alias("row"))

    seen = Observation()
    counts = [F.count(F.when(F.col("reason") == r, 1)).alias(r) for r in REASONS]
    both = rejected(n, "node", "id", F.lit(None).cast("string")).unionByName(rejected(e, "edge", "start_id", F.col("end_id")))
    rejects = stored(both.observe(seen, *counts), "import_rejects")
    found = {r: seen.get[r] for r in REASONS}
    if tolerance is not None and sum(found.values()) > tolerance:
        raise BadImportError(f"more than {tolerance} rows rejected: {found}")
    own = ("_fits", "_row", "_reason", "_no", "_first", "_start", "_end")
    keep = lambda df: df.where("_reason is null").drop(*own)
    return keep(n), keep(e), rejects, found


REASONS = ("value", "no id", "duplicate", "no start", "no end")


def _accounted(df: DataFrame) -> DataFrame:
    """Typed, with ``_row`` (the values as read, as JSON) and ``_fits``: whether every text that isn't empty could be cast."""
    raw = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_in"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("_row"))
    fits, out = F.lit(True), []
    for c in df.columns:
        text = F.col(f"_in.`{c}`")
        name, x = _cast(c, text)
        out.append(x.alias(name))
        if name != c:
            kind = c.partition(":")[2]
            parts = F.split(text, ";") if kind.endswith("[]") else F.array(text.cast("string"))
            bad = lambda v: v.isNotNull() & (F.trim(v) != "") & v.try_cast(TYPES[kind.removesuffix("[]")]).isNull()  # noqa: B023, E731
            fits = fits & ~F.coalesce(F.exists(parts, bad), F.lit(False))
    return raw.select(*out, fits.alias("_fits"), "_row")


#: Header suffixes and the types they stand for.
TYPES = {"int": "int", "long": "bigint", "float": "double", "double": "double", "boolean": "boolean", "string": "string"}


def _cast(header: str, x: Column) -> tuple[str, Column]:
    """The name in a header ``name:type`` or ``name:type[]`` and the text as that type; arrays are parted by semicolons."""
    name, found, kind = header.partition(":")
    base = kind.removesuffix("[]")
    if not found or base not in TYPES or not name:
        return header, x
    if kind.endswith("[]"):
        return name, F.when(x != "", F.split(x, ";")).try_cast(f"array<{TYPES[base]}>")
    return name, x.try_cast(TYPES[base])


def typed(df: DataFrame) -> DataFrame:
    """Columns named ``name:type`` or ``name:type[]`` cast from text and renamed."""
    out = []
    for c in df.columns:
        name, x = _cast(c, F.col(f"`{c}`"))
        out.append(x.alias(name))
    return df.select(*out)


def source_summary(nodes: DataFrame, edges: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """source, n_nodes, n_edges, node_labels, edge_types (distinct, sorted, joined by semicolons);
    with ``sizes`` (source, nodes_file_bytes, edges_file_bytes) also the files' megabytes."""
    distinct = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ";")
    n = nodes.groupBy("source").agg(F.count(F.lit(1)).alias("n_nodes"), distinct("label").alias("node_labels"))
    e = edges.groupBy("source").agg(F.count(F.lit(1)).alias("n_edges"), distinct("type").alias("edge_types"))
    zero, empty = F.lit(0).cast("long"), F.lit("")
    out = n.join(e, "source", "full").select("source", F.coalesce("n_nodes", zero).alias("n_nodes"), F.coalesce("n_edges", zero).alias("n_edges"), F.coalesce("node_labels", empty).alias("node_labels"), F.coalesce("edge_types", empty).alias("edge_types"))
    if sizes is not None:
        mb = lambda c: F.round(F.col(c) / 1e6, 3)
        out = out.join(sizes, "source", "left").withColumns({"nodes_file_mb": mb("nodes_file_bytes"), "edges_file_mb": mb("edges_file_bytes")}).drop("nodes_file_bytes", "edges_file_bytes")
    return out.orderBy("source")


def bridge_matrix(edges: DataFrame) -> DataFrame:
    """source, start_ns, end_ns, count."""
    out = edges.groupBy("source", namespace("start_id").alias("start_ns"), namespace("end_id").alias("end_ns")).agg(F.count(F.lit(1)).alias("count"))
    return out.orderBy("source", F.desc("count"), "start_ns", "end_ns")


def manifest(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per source: node and edge counts, their totals, the number of sources, and an order-free digest of the content:
    the sum of 60 bits of the MD5 of each row, its columns but the source as text (null: empty) joined by U+001F."""

    def digest(df: DataFrame) -> Column:
        cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in sorted(df.columns) if c != "source"]
        bits = F.conv(F.substring(F.md5(F.concat_ws("\x1f", *cells).cast("binary")), 1, 15), 16, 10)
        return F.sum(bits.cast("decimal(20,0)")).cast("string")

    n = nodes.groupBy("source").agg(F.count(F.lit(1)).alias("n_nodes"), digest(nodes).alias("nodes_digest"))
    e = edges.groupBy("source").agg(F.count(F.lit(1)).alias("n_edges"), digest(edges).alias("edges_digest"))
    zero = F.lit(0).cast("long")
    out = n.join(e, "source", "full").withColumns({"n_nodes": F.coalesce("n_nodes", zero), "n_edges": F.coalesce("n_edges", zero)})
    total = out.agg(F.sum("n_nodes").alias("total_nodes"), F.sum("n_edges").alias("total_edges"), F.count(F.lit(1)).alias("n_sources"))
    return out.crossJoin(F.broadcast(total))  # one row


def file_digests(files: DataFrame) -> DataFrame:
    """path, bytes and sha256 of files read with the binaryFile source."""
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))

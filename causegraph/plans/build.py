"""The whole build: files of the sources to graph, checks, reports and manifest.

``DIR`` holds a folder for each source, named as in ``kg_sources.REGISTRY``, and in it a
file for each of the builder's inputs: ``<input>.tsv``, ``.tsv.gz``, ``.csv``, ``.obo``,
``.json`` (a JSON object as name and value) or ``.parquet``.  A source without a folder is
left out.
"""

from __future__ import annotations

import inspect

from pyspark.sql import DataFrame, SparkSession, functions as F

from causegraph.operators import graph, kg_sources
from causegraph.sources import readers, sinks

#: Columns of text files that aren't text, by source and input.
TYPES: dict[tuple[str, str], dict[str, str]] = {
    ("icd11", "tabulation"): {"row_no": "long", "depth": "int", "is_residual": "boolean"},
    ("icd11", "mapping"): {"row_no": "long"},
    ("phmrc", "causes"): {"row_no": "long"},
    ("wdi", "mesh_nodes"): {"row_no": "long"},
    ("who_mortality", "deaths"): {"Country": "int", "Year": "int", "Sex": "int"},
    ("who_mortality", "population"): {"Country": "int", "Year": "int", "Sex": "int"},
    ("icd10", "embeddings"): {"embedding": "array<double>"},
}
KINDS = (".parquet", ".tsv.gz", ".tsv", ".csv", ".obo", ".json")


def read_input(spark: SparkSession, path: str, kind: str, types: dict[str, str]) -> DataFrame:
    if kind == ".parquet":
        df = spark.read.parquet(path)
    elif kind == ".obo":
        df = readers.obo(spark, path)
    elif kind == ".json":
        df = readers.json_map(spark, path)
    else:
        df = readers.csv(spark, path) if kind == ".csv" else readers.tsv(spark, path)
    texts = {f.name for f in df.schema.fields if f.dataType.simpleString() == "string"}
    cast = {c: F.split(c, ";").cast(x) if x.startswith("array") else F.col(c).try_cast(x) for c, x in types.items() if c in texts}
    return df.withColumns(cast) if cast else df


def read_inputs(spark: SparkSession, folder: str) -> dict[str, dict[str, DataFrame]]:
    """Inputs by source and name; a source that lacks an input it needs raises."""
    out: dict[str, dict[str, DataFrame]] = {}
    for source, builder in kg_sources.REGISTRY.items():
        base = f"{folder.rstrip('/')}/{source}"
        if not readers.exists(spark, base):
            continue
        found, needed = {}, []
        for name, parameter in inspect.signature(builder).parameters.items():
            kind = next((k for k in KINDS if readers.exists(spark, f"{base}/{name}{k}")), None)
            if kind is not None:
                found[name] = read_input(spark, f"{base}/{name}{kind}", kind, TYPES.get((source, name), {}))
            elif parameter.default is inspect.Parameter.empty:
                needed.append(name)
        if needed:
            raise FileNotFoundError(f"{source} lacks {', '.join(needed)}")
        out[source] = found
    return out


def build(spark: SparkSession, folder: str, out: str, version: str = "1", strict: bool = False) -> DataFrame:
    """Writes nodes and edges of each source, the combined graph, four reports and the manifest; returns the summary.
    ``strict``: nodes that contradict each other and edges without their nodes raise before anything is written."""
    from causegraph.storage import stored

    nodes, edges = (stored(df, "graph") for df in kg_sources.build(read_inputs(spark, folder)))
    duplicates, missing = graph.duplicate_report(nodes, strict=strict), graph.missing_nodes(nodes, edges, strict=strict)
    for source in (r.source for r in nodes.select("source").union(edges.select("source")).distinct().collect()):  # one row a source
        for name, df in (("nodes", nodes), ("edges", edges)):
            own = df.where(F.col("source") == source).drop("source")
            sinks.tsv_gz(_plain(own), f"{out}/{source}_{name}.tsv.gz")
    sinks.graph_tables(*graph.import_graph(nodes, edges), f"{out}/graph")
    sinks.tsv_gz(_plain(graph.combined_nodes(nodes)), f"{out}/combined_nodes.tsv.gz", ["id"])
    summary = graph.source_summary(nodes, edges)
    for name, df in (("duplicate_nodes", duplicates), ("missing_nodes", missing), ("source_summary", summary), ("bridges", graph.bridge_matrix(edges))):
        sinks.report(df, f"{out}/reports/{name}.tsv")
    sinks.manifest(graph.manifest(nodes, edges), f"{out}/manifest.json", version)
    return summary


def _plain(df: DataFrame) -> DataFrame:
    """Arrays as texts parted by semicolons, which TSV can hold."""
    arrays = [f.name for f in df.schema.fields if f.dataType.typeName() == "array"]
    return df.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ";") for c in arrays}) if arrays else df

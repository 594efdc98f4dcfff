"""Writers of graphs, reports, traces and results."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, functions as F


def _csv(df: DataFrame):
    return df.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "")


def tsv_gz(df: DataFrame, path: str, order: list[str] | None = None, files: int | None = None) -> None:
    """Gzipped TSV with a header, rows in a fixed order over the files in the order of their names: as many as the
    amount of data asks for, or the number given."""
    keys = [F.asc_nulls_last(f"`{k}`") for k in (order or df.columns)]
    if files == 1:
        part = df.coalesce(1)
    else:
        part = df.repartitionByRange(*([files] if files else []), *keys)
    _csv(part.sortWithinPartitions(*keys)).option("compression", "gzip").option("sep", "\t").csv(path)


def report(df: DataFrame, path: str) -> None:
    """An uncompressed TSV report. Sorted rows keep their order, over files in the order of their names."""
    _csv(df).option("sep", "\t").csv(path)


def manifest(df: DataFrame, path: str, version: str) -> None:
    """One JSON document: version, time, totals and a list of the sources."""
    sources = F.array_sort(F.collect_list(F.struct(*[c for c in df.columns if not c.startswith("total_") and c != "n_sources"])))
    one = df.agg(sources.alias("sources"), F.max("total_nodes").alias("total_nodes"), F.max("total_edges").alias("total_edges"), F.max("n_sources").alias("n_sources"))
    doc = one.select(F.to_json(F.struct(F.lit(version).alias("version"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("built_at"), *one.columns)))
    doc.coalesce(1).write.mode("overwrite").text(path)


def trace(df: DataFrame, path: str) -> None:
    """JSON lines, appended."""
    df.write.mode("append").json(path)


def trace_stream(df: DataFrame, path: str, checkpoint: str):
    return df.writeStream.format("json").outputMode("append").option("checkpointLocation", checkpoint).start(path)


def transcripts(df: DataFrame, path: str, lang: str = "lang", text: str = "text") -> None:
    """A folder of text files for each language."""
    df.select(F.col(lang).alias("lang"), F.col(text).alias("value")).write.mode("overwrite").partitionBy("lang").text(path)


def run_outputs(chunks: DataFrame, path: str, meta: dict, final: DataFrame) -> None:
    """A run's folder: transcript, annotations, chunks and inference.

    chunks: seq, chunk_id, text, annotations, grounding_s, inference_s; final: one row with the last causes.
    """
    one = chunks.orderBy("seq")
    one.select("text").write.mode("overwrite").text(f"{path}/transcript")
    one.select("chunk_id", F.explode("annotations").alias("annotation")).write.mode("overwrite").json(f"{path}/annotations")
    one.drop("seq").write.mode("overwrite").json(f"{path}/chunks")
    timing = chunks.agg(F.sum("grounding_s").alias("grounding_s"), F.sum("inference_s").alias("inference_s"), F.count(F.lit(1)).alias("n_chunks"))
    timing = timing.withColumn("total_s", F.col("grounding_s") + F.col("inference_s"))
    final.crossJoin(timing).withColumn("meta", F.lit(json.dumps(meta, sort_keys=True))).coalesce(1).write.mode("overwrite").json(f"{path}/inference")  # one row each


def results(detail: DataFrame, aggregate: DataFrame, path: str) -> None:
    """A CSV of results with the aggregate row last."""
    both = detail.withColumn("_o", F.lit(0)).unionByName(aggregate.withColumn("_o", F.lit(1)), allowMissingColumns=True)
    _csv(both.orderBy("_o", detail.columns[0]).drop("_o")).csv(path)


def graph_tables(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """The imported graph as Parquet, parted by label and type."""
    nodes.write.mode("overwrite").partitionBy("label").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("type").parquet(f"{path}/edges")


def cached(df: DataFrame, path: str) -> DataFrame:
    """The JSON at the path; written first if it isn't there."""
    df.write.mode("ignore").json(path)
    return df.sparkSession.read.schema(df.schema).json(path)

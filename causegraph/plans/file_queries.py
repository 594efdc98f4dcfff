"""Queries that write the driver's tables in the formats of the graph's sources and of runs, and read them back."""

from __future__ import annotations

import io
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from causegraph.catalog import query, table
from causegraph.functions import text as t
from causegraph.operators import graph
from causegraph.plans import graph_queries
from causegraph.sources import readers, sinks
from causegraph.storage import shared_root

C = F.col


def folder(spark: SparkSession) -> str:
    return f"{shared_root(spark)}/files-{uuid.uuid4().hex}"


def put(spark: SparkSession, path: str, content: bytes) -> None:
    """One small file, as an archive or a resource is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p)
    out.write(bytearray(content))
    out.close()


def lines(df: DataFrame, path: str, *parts: Column | str, sep: str = "\t") -> None:
    df.select(F.concat_ws(sep, *[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts]).alias("value")).write.text(path)


PART_SQL = "SELECT p_partkey::VARCHAR AS id, p_name || ' \"' || p_brand || '\"' AS name, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_type END AS kind FROM part"


def parts(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat("p_name", F.lit(' "'), "p_brand", F.lit('"'))
    return table(spark, sf, "part").select(C("p_partkey").cast("string").alias("id"), name.alias("name"), F.when(C("p_size") % 3 != 0, C("p_type")).alias("kind"))


@query("io_tsv", PART_SQL)
def io_tsv(spark: SparkSession, sf: str) -> DataFrame:
    """Gzipped TSV with quotes and empty cells, all columns."""
    path = folder(spark)
    sinks.tsv_gz(parts(spark, sf), path, ["id"])
    return readers.tsv(spark, path)


@query("io_tsv_projected", f"SELECT kind, count(*) AS n FROM ({PART_SQL}) GROUP BY kind")
def io_tsv_projected(spark: SparkSession, sf: str) -> DataFrame:
    """One column of a gzipped TSV."""
    path = folder(spark)
    sinks.tsv_gz(parts(spark, sf), path, ["id"], 2)
    return readers.tsv(spark, path).select("kind").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("io_csv", PART_SQL)
def io_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Quoted CSV, iterated lazily."""
    path = folder(spark)
    sinks.results(parts(spark, sf), parts(spark, sf).limit(0), path)
    return readers.csv(spark, path)


@query("io_csv_latin", "SELECT n_nationkey::VARCHAR AS country, n_name || ' é' AS name FROM nation")
def io_csv_latin(spark: SparkSession, sf: str) -> DataFrame:
    path = folder(spark)
    n = table(spark, sf, "nation").select(C("n_nationkey").alias("country"), F.concat(F.lit(" "), "n_name", F.lit(" é ")).alias("name"))
    n.write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return readers.csv(spark, path, encoding="ISO-8859-1").select("country", F.trim("name").alias("name"))


@query("io_preamble", "SELECT s_suppkey::VARCHAR AS database_id, s_name AS disease_name, (s_nationkey % 3)::VARCHAR AS aspect FROM supplier")
def io_preamble(spark: SparkSession, sf: str) -> DataFrame:
    """A TSV below four lines that describe it."""
    path = folder(spark)
    s = table(spark, sf, "supplier").orderBy("s_suppkey")
    rows = [("\t".join((str(r.s_suppkey), r.s_name, str(r.s_nationkey % 3)))) for r in s.toLocalIterator()]
    put(spark, path, "\n".join(["#description: a", "#version: 1", "#tracker: b", "#hpo-version: c", "database_id\tdisease_name\taspect", *rows, ""]).encode())
    return readers.tsv_after(spark, path, 4)


@query("io_zip", "SELECT n_nationkey::VARCHAR AS key, n_name AS name, r_name AS region FROM nation JOIN region ON r_regionkey = n_regionkey")
def io_zip(spark: SparkSession, sf: str) -> DataFrame:
    """A member of a zip archive."""
    path = f"{folder(spark)}/a.zip"
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), C("r_regionkey") == C("n_regionkey"))
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("other.txt", "x")
        z.writestr("in/table.csv", "key,name,region\n" + "".join(f"{r.n_nationkey},{r.n_name},{r.r_name}\n" for r in n.toLocalIterator()))
    put(spark, path, raw.getvalue())
    return readers.zip_member(spark, path, "in/table.csv")


@query("io_obo", "SELECT 'MONDO:' || p_partkey AS id, p_name AS name, 'skos:exactMatch OMIM:' || p_size AS property_value, 'MONDO:' || (p_partkey // 2) AS is_a, p_partkey % 7 = 0 AS is_obsolete FROM part")
def io_obo(spark: SparkSession, sf: str) -> DataFrame:
    """An ontology in stanzas; the header and other stanzas are passed over."""
    path = folder(spark)
    k = C("p_partkey").cast("string")
    stanza = F.concat(
        F.lit("[Term]\nid: MONDO:"), k, F.lit("\nname: "), "p_name", F.lit("\nis_a: MONDO:"), F.floor(C("p_partkey") / 2).cast("string"), F.lit(" ! above"), F.lit('\nproperty_value: skos:exactMatch OMIM:'), C("p_size").cast("string"),
        F.when(C("p_partkey") % 7 == 0, "\nis_obsolete: true").otherwise(""), F.lit("\n\n[Typedef]\nid: x"),
    )
    table(spark, sf, "part").select(stanza.alias("value")).write.option("lineSep", "\n\n").text(path)
    return readers.obo(spark, path).select("id", "name", C("property_value")[0].alias("property_value"), C("is_a")[0].alias("is_a"), "is_obsolete")


@query("io_json_map", "SELECT n_name AS name, r_name AS value FROM nation JOIN region ON r_regionkey = n_regionkey")
def io_json_map(spark: SparkSession, sf: str) -> DataFrame:
    import json

    path = f"{folder(spark)}.json"
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), C("r_regionkey") == C("n_regionkey"))
    put(spark, path, json.dumps({r.n_name: r.r_name for r in n.collect()}, indent=1).encode())  # 25 rows
    return readers.json_map(spark, path)


@query("io_lines", "SELECT DISTINCT p_type AS value FROM part")
def io_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines, trimmed, without empty ones."""
    path = folder(spark)
    p = table(spark, sf, "part").select("p_type").distinct().withColumn("v", F.explode(F.array(F.concat(F.lit("  "), "p_type", F.lit(" ")), F.lit(" "))))
    p.select(C("v").alias("value")).write.text(path)
    return readers.text_lines(spark, path)


def talks(spark: SparkSession, sf: str) -> DataFrame:
    """All customers' names, a text of lines for each nation."""
    c = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_list("c_name")).alias("t"))
    return c.select(C("c_nationkey").alias("nation"), F.array_join("t", "\n").alias("text"))


@query("io_transcripts", "SELECT 'day' || c_nationkey AS encounter_id, string_agg(c_name, chr(10) ORDER BY c_name) AS text FROM customer GROUP BY c_nationkey")
def io_transcripts(spark: SparkSession, sf: str) -> DataFrame:
    """A folder of transcripts with blank lines and a header line before the text."""
    path = folder(spark)
    for r in talks(spark, sf).toLocalIterator():  # a file for each of 25 nations
        put(spark, f"{path}/day{r.nation}_en.txt", f"\n  \nTranscripted Line\n{r.text}".encode())
    return readers.transcripts(spark, f"{path}/*.txt")


@query("io_encounters", "SELECT DISTINCT CASE c_nationkey WHEN 1 THEN 'day2' WHEN 2 THEN 'day1' ELSE 'day' || c_nationkey END AS encounter_id FROM customer")
def io_encounters(spark: SparkSession, sf: str) -> DataFrame:
    """Ids from the names of files, two of them exchanged."""
    path = folder(spark)
    for r in table(spark, sf, "customer").select("c_nationkey").distinct().collect():  # 25 nations
        put(spark, f"{path}/day{r.c_nationkey}_en.txt", b"x")
    put(spark, f"{path}/notes.md", b"x")
    found = readers.encounters(spark, path, r"(day\d+)_en\.txt$")
    return found.select(readers.overridden("encounter_id", {"day1": "day2", "day2": "day1"}).alias("encounter_id"))


@query(
    "io_result_files",
    "SELECT backend, language, size, conv_id::VARCHAR AS encounter_id, role AS hyp_text FROM (SELECT DISTINCT conv_id, role FROM conversations WHERE turn = 0), (SELECT unnest(['fast', 'slow']) AS backend, unnest(['en', 'de']) AS language, unnest(['small', 'base']) AS size)",
)
def io_result_files(spark: SparkSession, sf: str) -> DataFrame:
    """Tables of two runs, named by backend, language and size, each with its aggregate row; a third file is missing."""
    base = folder(spark)
    c = table(spark, sf, "conversations").where("turn = 0").select(C("conv_id").cast("string").alias("encounter_id"), "role").distinct()
    detail = c.select("encounter_id", F.concat("encounter_id", F.lit(".wav")).alias("audio_file"), C("role").alias("hyp_text"))
    total = spark.createDataFrame([(None, "__AGGREGATE__", None)], "encounter_id string, audio_file string, hyp_text string")
    paths = [f"{base}/{name}.csv" for name in ("fast_en_small", "slow_de_base", "none_fr_base")]
    for path in paths[:2]:
        sinks.results(detail, total, f"{path}")
    found = readers.result_files(spark, paths, r"([^/_]+)_([a-z]{2})_([^/_.]+)\.csv(?:/|$)")
    hypotheses = readers.hypotheses(found.withColumn("encounter_id", F.concat_ws("/", "backend", "language", "size", "encounter_id")).where("audio_file is not null"))
    part = F.split("encounter_id", "/")
    return hypotheses.where(F.size(part) == 4).select(part[0].alias("backend"), part[1].alias("language"), part[2].alias("size"), part[3].alias("encounter_id"), "hyp_text")


@query("io_cached", "SELECT n_nationkey, n_name FROM nation")
def io_cached(spark: SparkSession, sf: str) -> DataFrame:
    """A result that is there already isn't written again."""
    path = folder(spark)
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    assert not readers.exists(spark, path)
    sinks.cached(n, path)
    assert readers.exists(spark, path)
    return sinks.cached(n.where("false"), path)


@query("io_graph_tables", f"{graph_queries.GRAPH_SQL} SELECT 'node' AS kind, label AS part, count(*) AS n FROM n GROUP BY ALL UNION ALL SELECT 'edge', type, count(*) FROM e GROUP BY ALL")
def io_graph_tables(spark: SparkSession, sf: str) -> DataFrame:
    """The graph as tables parted by label and type; only the parts are read."""
    path = folder(spark)
    sinks.graph_tables(graph_queries.nodes(spark, sf), graph_queries.edges(spark, sf), path)
    count = lambda name, kind, part: spark.read.parquet(f"{path}/{name}").groupBy(C(part).alias("part")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "part", "n")
    return count("nodes", "node", "label").unionByName(count("edges", "edge", "type"))


@query("io_report", f"{graph_queries.GRAPH_SQL}, c AS (SELECT source, split_part(start_id, ':', 1) AS s, split_part(end_id, ':', 1) AS t, count(*) AS n FROM e GROUP BY ALL) SELECT row_number() OVER (ORDER BY source, n DESC, s, t)::BIGINT AS place, source, s AS start_ns, t AS end_ns, n::VARCHAR AS count FROM c")
def io_report(spark: SparkSession, sf: str) -> DataFrame:
    """A report's rows in the order in which its files hold them."""
    path = folder(spark)
    sinks.report(graph.bridge_matrix(graph_queries.edges(spark, sf)), path)
    files = readers.tsv(spark, path).withColumns({"f": F.input_file_name(), "i": F.monotonically_increasing_id()})
    from pyspark.sql import Window

    return files.select(F.row_number().over(Window.orderBy("f", "i")).cast("long").alias("place"), "source", "start_ns", "end_ns", "count")  # a few rows


@query("io_manifest", f"{graph_queries.GRAPH_SQL}, s AS (SELECT source FROM n UNION SELECT source FROM e) SELECT '7' AS version, (SELECT count(*) FROM n) AS total_nodes, (SELECT count(*) FROM e) AS total_edges, string_agg(source, ',' ORDER BY source) AS sources FROM s")
def io_manifest(spark: SparkSession, sf: str) -> DataFrame:
    path = folder(spark)
    sinks.manifest(graph.manifest(graph_queries.nodes(spark, sf), graph_queries.edges(spark, sf)), path, "7")
    got = spark.read.schema("version string, built_at string, total_nodes long, total_edges long, sources array<struct<source:string>>").json(path)
    return got.select("version", "total_nodes", "total_edges", F.array_join("sources.source", ",").alias("sources"))


@query("io_digests", "SELECT n_nationkey AS key, length(n_name)::BIGINT AS bytes, sha256(n_name) AS sha256 FROM nation")
def io_digests(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes and digests of files."""
    path = folder(spark)
    for r in table(spark, sf, "nation").collect():  # 25 rows
        put(spark, f"{path}/{r.n_nationkey}", r.n_name.encode())
    return graph.file_digests(spark.read.format("binaryFile").load(path)).select(t.last_segment("path").cast("int").alias("key"), "bytes", "sha256")


@query("io_trace", "SELECT conv_id, turn, role FROM conversations UNION ALL SELECT conv_id, turn, 'again' FROM conversations WHERE turn = 0")
def io_trace(spark: SparkSession, sf: str) -> DataFrame:
    """JSON lines, appended twice."""
    path = folder(spark)
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    sinks.trace(c, path)
    sinks.trace(c.where("turn = 0").withColumn("role", F.lit("again")), path)
    return spark.read.schema(c.schema).json(path)


@query("io_transcript_folders", r"SELECT lang, regexp_replace(coalesce(text, ''), '[\t\n\x0B\f\r ]', ' ', 'g') AS text FROM documents WHERE lang IS NOT NULL")
def io_transcript_folders(spark: SparkSession, sf: str) -> DataFrame:
    """A folder of texts for each language, read back whole."""
    path = folder(spark)
    sinks.transcripts(table(spark, sf, "documents").where("lang is not null").select("lang", F.regexp_replace("text", r"\s", " ").alias("text")), path)
    return spark.read.schema("value string, lang string").text(path).select("lang", F.col("value").alias("text"))


@query("io_run", "SELECT count(*) AS n_chunks, sum(turn) * 0.5 AS grounding_s, sum(turn) * 0.5 + count(*) * 0.25 AS total_s, (SELECT count(*) FROM conversations WHERE role <> 'user') AS annotations, string_agg(conv_id || '.' || turn, ' ' ORDER BY conv_id, turn) AS text FROM conversations")
def io_run(spark: SparkSession, sf: str) -> DataFrame:
    """A run's folder: transcript, annotations, chunks and timing."""
    path = folder(spark)
    ident = F.concat_ws(".", C("conv_id").cast("string"), C("turn").cast("string"))
    notes = F.when(C("role") != "user", F.array("role")).otherwise(F.array().cast("array<string>"))
    chunks = table(spark, sf, "conversations").select((C("conv_id") * 100_000 + C("turn")).alias("seq"), ident.alias("chunk_id"), ident.alias("text"), notes.alias("annotations"), (C("turn") * 0.5).cast("double").alias("grounding_s"), F.lit(0.25).cast("double").alias("inference_s"))
    sinks.run_outputs(chunks, path, {"by": "test"}, spark.createDataFrame([("cause",)], "causes string"))
    timing = spark.read.schema("causes string, grounding_s double, inference_s double, n_chunks long, total_s double, meta string").json(f"{path}/inference")
    spoken = spark.read.text(f"{path}/transcript").select(F.split("value", r"\.").alias("p")).agg(F.array_sort(F.collect_list(F.struct(C("p")[0].cast("long"), C("p")[1].cast("long"), F.array_join("p", ".").alias("x")))).alias("s"))
    noted = spark.read.schema("chunk_id string, annotation string").json(f"{path}/annotations").agg(F.count(F.lit(1)).alias("annotations"))
    out = timing.select("n_chunks", "grounding_s", "total_s").crossJoin(noted).crossJoin(spoken)  # one row each
    return out.select("n_chunks", "grounding_s", "total_s", "annotations", F.array_join(F.transform("s", lambda s: s["x"]), " ").alias("text"))

"""Readers of the file formats that the graph's sources and the evaluation use."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType


def header(spark: SparkSession, path: str, sep: str = "\t") -> list[str]:
    """Column names of a delimited file, from its first line."""
    return [c.strip('"') for c in spark.read.text(path).first()[0].split(sep)]


def tsv(spark: SparkSession, path: str, schema: StructType | str | None = None, sep: str = "\t", encoding: str = "UTF-8", comment: str | None = None) -> DataFrame:
    """A delimited file (gzipped or not) with a header and quoted fields; all text unless a schema is given.
    Only selected columns are parsed."""
    if schema is None:
        schema = StructType([StructField(c, StringType()) for c in header(spark, path, sep)])
    r = spark.read.schema(schema).option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').option("encoding", encoding).option("multiLine", False)
    return (r.option("comment", comment) if comment else r).csv(path)


def csv(spark: SparkSession, path: str, schema: StructType | str | None = None, encoding: str = "UTF-8") -> DataFrame:
    return tsv(spark, path, schema, ",", encoding)


def tsv_after(spark: SparkSession, path: str, skip: int, sep: str = "\t") -> DataFrame:
    """A delimited file whose header follows ``skip`` lines of preamble. Rows that equal a line of the preamble stay:
    of such a line as many copies go as the preamble has."""
    lines = spark.read.text(path)
    head = [r[0] for r in lines.limit(skip + 1).collect()]
    alike = lines.where(F.col("value").isin(head)).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    more = alike.withColumn("n", F.col("n") - F.array_size(F.filter(F.array(*map(F.lit, head)), lambda x: x == F.col("value"))))
    again = more.where("n > 0").select("value", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).select("value")
    names = ", ".join(f"`{n}` STRING" for n in head[skip].lstrip("#").split(sep))
    rows = lines.where(~F.col("value").isin(head)).unionByName(again)
    return rows.select(F.from_csv("value", F.lit(names), {"sep": sep}).alias("r")).select("r.*")


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed lines that aren't empty, in the column ``value``."""
    return spark.read.text(path).select(F.trim("value").alias("value")).where("value <> ''")


def json_map(spark: SparkSession, path: str, key: str = "name", value: str = "value") -> DataFrame:
    """A JSON object of texts as (key, value) rows."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "map<string,string>")).alias(key, value))


def zip_member(spark: SparkSession, path: str, member: str, sep: str = ",", encoding: str = "utf-8") -> DataFrame:
    """A delimited member of zip archives, read where the archive is; all columns text."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for b in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(b)) as z, z.open(member) as f:
                    yield pd.DataFrame({"line": [io.TextIOWrapper(f, encoding).readline().rstrip("\r\n")]})

    columns = [c.strip().strip('"') for c in files.limit(1).mapInPandas(names, "line string").first()[0].split(sep)]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for b in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(b)) as z, z.open(member) as f:
                    for part in pd.read_csv(f, sep=sep, encoding=encoding, dtype=str, keep_default_na=False, na_values=[""], names=columns, header=0, chunksize=50_000):
                        yield part.astype(object).where(part.notna(), None)

    return files.mapInPandas(rows, StructType([StructField(c, StringType()) for c in columns]))


def excel(spark: SparkSession, path: str, sheet: str | int = 0) -> DataFrame:
    """A spreadsheet's sheet as text columns; needs one of pandas' spreadsheet engines on the driver."""
    try:
        pdf = pd.read_excel(path, sheet_name=sheet, dtype=str)
    except ImportError as e:
        raise RuntimeError("reading spreadsheets needs an engine such as openpyxl; export the sheet as CSV instead") from e
    schema = StructType([StructField(str(c), StringType()) for c in pdf.columns])
    return spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), schema)


def obo(spark: SparkSession, path: str) -> DataFrame:
    """An OBO ontology's terms: id, name, property_value (array), is_a (array of ids), is_obsolete."""
    stanzas = spark.read.option("lineSep", "\n\n").text(path).where(F.col("value").contains("[Term]"))
    lines = F.split("value", "\n")

    def values(tag: str) -> Column:
        found = F.filter(lines, lambda x: x.startswith(f"{tag}: "))
        return F.transform(found, lambda x: F.trim(F.substring(x, len(tag) + 3, 1 << 20)))

    first = lambda tag: F.try_element_at(values(tag), F.lit(1))
    bare = lambda xs: F.transform(xs, lambda x: F.trim(F.substring_index(x, " ! ", 1)))
    value = F.transform(values("property_value"), lambda x: F.regexp_replace(x, r'^(\S+) "(.*)".*$', "$1 $2"))
    return stanzas.select(first("id").alias("id"), first("name").alias("name"), value.alias("property_value"), bare(values("is_a")).alias("is_a"), F.coalesce(first("is_obsolete") == "true", F.lit(False)).alias("is_obsolete"))


def transcripts(spark: SparkSession, path: str, pattern: str = r"([^/]+?)(?:_[a-z]{2})?\.txt$") -> DataFrame:
    """Files of spoken lines as (encounter_id, text): leading blank lines and the header line go."""
    whole = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    body = F.regexp_replace(F.regexp_replace("value", r"^(\s*\n)+", ""), r"(?i)^[ \t]*transcripted line[ \t]*(\r?\n|$)", "")
    return whole.select(F.regexp_extract("file", pattern, 1).alias("encounter_id"), body.alias("text")).orderBy("encounter_id")


def encounters(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Ids in the names of a folder's files, sorted; the content isn't read."""
    files = spark.read.format("binaryFile").load(path).select("path")
    return files.select(F.regexp_extract("path", pattern, 1).alias("encounter_id")).where("encounter_id <> ''").distinct().orderBy("encounter_id")


def overridden(ident: Column | str, swaps: dict[str, str]) -> Column:
    """An id through an override map."""
    from causegraph.functions.text import col, lookup

    return lookup(swaps, col(ident), col(ident)) if swaps else col(ident)


def hypotheses(results: DataFrame) -> DataFrame:
    """encounter_id, hyp_text of a result table, without its aggregate row."""
    return results.where("audio_file <> '__AGGREGATE__' and encounter_id is not null").select("encounter_id", "hyp_text")


def result_files(spark: SparkSession, paths: list[str], pattern: str = r"([^/_]+)_([a-z]{2})_([^/_.]+)\.csv$") -> DataFrame | None:
    """Result tables of several runs with backend, language and size from their file names; missing files are passed over."""
    jvm = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsc.hadoopConfiguration()
    there = [p for p in paths if (q := jvm.Path(p)).getFileSystem(conf).exists(q)]
    out = None
    for p in there:
        df = csv(spark, p).withColumn("_f", F.input_file_name())
        df = df.withColumns({n: F.regexp_extract("_f", pattern, i) for i, n in enumerate(("backend", "language", "size"), 1)}).drop("_f")
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def audio_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """Binary blobs that arrive in a folder, as a stream (path, modificationTime, length, content)."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(folder)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a result is there already."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)

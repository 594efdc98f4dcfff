"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all documents that its predecessor
kept; all but the last return the columns of ``documents``.

1. language_id: documents without a letter, or whose language is too uncertain, go.
2. toxicity: documents with a score of 0.5 or more go.
3. line_dedup: later occurrences of three-line windows are cut out of the texts; a
   document of which nothing is left goes, one that was blank before stays.
4. near_dedup: one document stays of each group linked by a Jaccard similarity of 0.8,
   and one of rows that are repeated with their doc_id.
5. packing: the documents' tokens, cut and packed into sequences of 2048.

Columns that ``documents`` has beyond COLUMNS are left out. Null and empty texts have no
language and go in the first stage; without labels no text is toxic; an empty table stays
empty. Rows that share a doc_id but not the text are documents of their own, except that
line_dedup, which goes by doc_id, takes them for one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from causegraph.llm import jaccard, langid, lines, packing, toxicity
from causegraph.storage import shared_root

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: With less probability than this a language counts as not recognised.
LEAST_LANGUAGE, LEAST_TOXIC = 0.4, 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.train(docs, ~langid.held_out())
    found = langid.identify(docs.select(*COLUMNS), model)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE)).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~toxicity.held_out())
    return toxicity.score(docs.select(*COLUMNS), model).where(F.col("score") < LEAST_TOXIC).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = lines.remove_repeats(docs.select(*COLUMNS))
    left = out.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    return left.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs.select(*COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [("language_id", language_id), ("toxicity", drop_toxic), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("packing", pack)]

#: No SQL: the models and the packing aren't expressible; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES:
        path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

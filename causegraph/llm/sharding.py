"""Operator 5: weighted rendezvous hashing of record keys over shards.

Every shard scores every key by a hash of both, scaled by the shard's weight; the
highest score wins.  A new shard can only take keys for itself, so all others stay
where they are.  Sizes, scores and checksums are one projection of Spark functions,
made once and stored; only that narrow table is numbered.

A null key is a key like any other.  Null texts have no bytes.  Rows with equal keys
go to one shard; each row has a slot of its own, whatever it repeats, and which one
depends on how the rows are stored.  ``shard`` keeps all columns but replaces ``shard``
and ``grown_shard``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from causegraph.llm.common import crc, documents, numbered, row_ids
from causegraph.storage import stored

SHARDS, OVERHEAD = 40, 16
SLOT_BUCKET = 1000


def shard_of(key: Column, weights: list[float]) -> Column:
    """The winning shard, from 0; weights are positive."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    uniform = lambda s: (F.shiftrightunsigned(F.xxhash64(key, s), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    scores = F.transform(w, lambda x, i: F.struct((-x / F.log(uniform(i))).alias("score"), (-i).alias("back")))
    return -F.array_max(scores)["back"]


def shard(df: DataFrame, key: str = "doc_id", weights: list[float] | None = None, grown: float | None = 1.0) -> DataFrame:
    """All rows with ``shard``, and ``grown_shard``: where they go with one more shard of that weight."""
    weights = weights or [1.0] * SHARDS
    out = df.withColumn("shard", shard_of(F.col(key), weights))
    return out if grown is None else out.withColumn("grown_shard", shard_of(F.col(key), [*weights, grown]))


def slots(df: DataFrame, row: str, shards: int = SHARDS) -> DataFrame:
    """Number each shard's rows from 0 without gaps; ``df`` is a stored table, ``row`` a column that differs in every row."""
    per_shard = -(-df.count() // shards)
    return numbered(df, ["shard"], row, "slot", max(1, -(-per_shard // SLOT_BUCKET)))


def op5_rendezvous_sharding(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + OVERHEAD).cast("long")
    narrow = shard(docs.select("doc_id", size.alias("size"), crc("text").cast("long").alias("text_crc32"), F.lit("key").alias("law")))
    return slots(stored(row_ids(narrow, "row"), "shards"), "row").drop("row")

"""Queries on the vector index that is kept in files."""

from __future__ import annotations

import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession, functions as F

from causegraph.catalog import query, table
from causegraph.operators import vector_index
from causegraph.plans.grounding_queries import FLOOR
from causegraph.storage import shared_root

#: Two labels of nodes with vectors and one without.
LABEL_SQL = "CASE vec_id % 5 WHEN 0 THEN 'one' WHEN 1 THEN 'one' WHEN 4 THEN 'none' ELSE 'two' END"


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    label = F.expr(LABEL_SQL)
    name = F.concat(F.lit("vector "), F.col("vec_id").cast("string"))
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), name.alias("name"), label.alias("label"), F.when(label != "none", F.col("embedding")).alias("embedding"))


def indexes(spark: SparkSession, sf: str) -> dict:
    """Both labels' indexes, made, and then opened by a second call that is given no nodes at all."""
    root, all_nodes = f"{shared_root(spark)}/index-{uuid.uuid4().hex}", nodes(spark, sf)
    wanted = {"one": ["embedding"], "two": ["embedding"], "none": ["embedding"]}
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        made = vector_index.ensure_all(all_nodes, root, wanted)
        opened = vector_index.ensure_all(all_nodes.where("false"), root, wanted)
    assert [k for k, v in made.items() if v] == [k for k, v in opened.items() if v]
    return {label: index for (label, _), index in opened.items() if index is not None}


@query(
    "gnd_index_build",
    f"""WITH v AS (SELECT {LABEL_SQL} AS label, vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings)
SELECT label, id, 'vector ' || id AS name, round(e[1] / sqrt(list_inner_product(e, e)), 6) AS first, round(e[64] / sqrt(list_inner_product(e, e)), 6) AS last,
count(*) OVER (PARTITION BY label) AS n, len(e)::INT AS dim FROM v WHERE label <> 'none'""",
)
def gnd_index_build(spark: SparkSession, sf: str) -> DataFrame:
    """What the indexes hold: every node with a vector, under its label, at length one."""
    out = None
    for label, index in indexes(spark, sf).items():
        component = lambda i: F.round(F.element_at("vector", i), 6)
        rows = index.table(spark, "vectors").select(F.lit(label).alias("label"), "id", "name", component(1).alias("first"), component(-1).alias("last"), F.lit(index.n).cast("long").alias("n"), F.lit(index.dim).alias("dim"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    "gnd_index_probe",
    f"""WITH v AS (SELECT {LABEL_SQL} AS label, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
p AS (SELECT b.label, a.vec_id AS q, b.vec_id AS c, list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e) * list_inner_product(b.e, b.e)) AS cosine FROM v a JOIN v b ON a.vec_id % 100 = 0 AND b.label <> 'none'),
k AS (SELECT *, row_number() OVER (PARTITION BY label, q ORDER BY round(cosine, 12) DESC, c) AS rank FROM p)
SELECT label, q, c, 'vector ' || c AS name, rank, round(cosine, 6) AS cosine FROM k WHERE rank <= 10 AND (1 + cosine) / 2 >= {FLOOR}""",
)
def gnd_index_probe(spark: SparkSession, sf: str) -> DataFrame:
    """The ten nodes nearest to every hundredth vector in each label's index, exactly, if they are near enough."""
    queries = table(spark, sf, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("vector"))
    out = None
    for label, index in indexes(spark, sf).items():
        near = vector_index.search(index, queries, 10, FLOOR).select(F.lit(label).alias("label"), "q", "c", "name", "rank", F.round("cosine", 6).alias("cosine"))
        out = near if out is None else out.unionByName(near)
    return out

"""Queries on the idioms that the graph's sources are built of."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from causegraph.catalog import query, table
from causegraph.functions import text as t
from causegraph.operators import etl

RANK = {"1-URGENT": 0, "2-HIGH": 1, "3-MEDIUM": 2}


@query(
    "etl_most_granular",
    """WITH r AS (SELECT *, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 END AS rk FROM orders)
SELECT o_custkey AS custkey, o_orderpriority AS priority, o_orderkey AS orderkey FROM r JOIN (SELECT o_custkey, min(rk) AS b FROM r GROUP BY 1) m USING (o_custkey) WHERE rk = b""",
)
def etl_most_granular(spark: SparkSession, sf: str) -> DataFrame:
    out = etl.most_granular(table(spark, sf, "orders"), ["o_custkey"], t.lookup(RANK, "o_orderpriority"))
    return out.select(F.col("o_custkey").alias("custkey"), F.col("o_orderpriority").alias("priority"), F.col("o_orderkey").alias("orderkey"))


@query(
    "etl_anti_union",
    """WITH a AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS series FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT strftime(l_shipdate, '%Y-%m-%d') AS series FROM lineitem)
SELECT series, 'orders' AS origin FROM a UNION ALL SELECT series, 'lineitem' FROM b ANTI JOIN a USING (series)""",
)
def etl_anti_union(spark: SparkSession, sf: str) -> DataFrame:
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias("series")
    a = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(day("o_orderdate")).distinct().withColumn("origin", F.lit("orders"))
    b = table(spark, sf, "lineitem").select(day("l_shipdate")).distinct().withColumn("origin", F.lit("lineitem"))
    return etl.union_unless_known(a, b, "series")


@query(
    "etl_lookup_coalesce",
    """SELECT n_name AS name, coalesce(m.v, n_name) AS normalised, coalesce(CASE n_regionkey WHEN 1 THEN 'male' WHEN 2 THEN 'female' WHEN 9 THEN 'unspecified' END, n_regionkey::VARCHAR) AS sex
FROM nation LEFT JOIN (SELECT r_name AS k, 'region of ' || r_name AS v FROM region UNION ALL SELECT n_name, upper(n_name) || '!' FROM nation WHERE n_nationkey % 3 = 0) m ON m.k = n_name""",
)
def etl_lookup_coalesce(spark: SparkSession, sf: str) -> DataFrame:
    nation = table(spark, sf, "nation")
    mapping = table(spark, sf, "region").select(F.col("r_name").alias("k"), F.concat(F.lit("region of "), "r_name").alias("v"))
    mapping = mapping.unionByName(nation.where("n_nationkey % 3 = 0").select(F.col("n_name").alias("k"), F.concat(F.upper("n_name"), F.lit("!")).alias("v")))
    out = etl.replace_by(nation.withColumn("normalised", F.col("n_name")), "normalised", mapping, "k", "v")
    return out.select(F.col("n_name").alias("name"), "normalised", t.sex_name("n_regionkey").alias("sex"))


@query("etl_lookup_last_wins", "SELECT p_name AS name, max_by('part:' || p_partkey, p_partkey) AS id FROM part GROUP BY p_name")
def etl_lookup_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    return etl.last_wins(table(spark, sf, "part").withColumn("id", t.curie("part", "p_partkey")), "p_name", "id", "p_partkey").withColumnRenamed("p_name", "name")


def yearly(spark: SparkSession, sf: str) -> DataFrame:
    """Orders per customer and year, as wide text columns ``1995 [YR1995]`` for all years that occur; ``..`` where there are none."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("key"), F.year("o_orderdate").cast("string").alias("y"))
    years = sorted(r.y for r in o.select("y").distinct().collect())  # one row a year
    wide = o.groupBy("key").pivot("y", years).count()
    return wide.select("key", *[F.coalesce(F.col(f"`{y}`").cast("string"), F.lit("..")).alias(f"{y} [YR{y}]") for y in years])


@query(
    "etl_year_map",
    """WITH c AS (SELECT o_custkey AS key, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY ALL)
SELECT key, string_agg(y || '=' || n || '.0', ';' ORDER BY y) AS years_data FROM c GROUP BY key""",
)
def etl_year_map(spark: SparkSession, sf: str) -> DataFrame:
    w = yearly(spark, sf)
    m = t.year_map(w.columns)
    entries = F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return w.select("key", F.array_join(entries, ";").alias("years_data")).where("years_data <> ''")


@query(
    "etl_unpivot",
    """WITH c AS (SELECT o_custkey AS key, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY ALL)
SELECT k.key AS id, y.y || ' [YR' || y.y || ']' AS col, CASE WHEN c.n IS NULL THEN '..' ELSE c.n::VARCHAR END AS value
FROM (SELECT DISTINCT key FROM c) k CROSS JOIN (SELECT DISTINCT y FROM c) y LEFT JOIN c ON c.key = k.key AND c.y = y.y""",
)
def etl_unpivot(spark: SparkSession, sf: str) -> DataFrame:
    w = yearly(spark, sf)
    return etl.long_form(w, ["key"], [c for c in w.columns if c != "key"]).withColumnRenamed("key", "id")


@query("etl_explode_codes", "SELECT p_partkey AS id, trim(c) AS code FROM (SELECT p_partkey, unnest(string_split(p_name || ' ; ' || p_type || ';', ';')) AS c FROM part) WHERE trim(c) <> ''")
def etl_explode_codes(spark: SparkSession, sf: str) -> DataFrame:
    cells = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(" ; "), "p_type", F.lit(";")).alias("cell"))
    return etl.exploded_codes(cells, "cell").select("id", "code")


@query(
    "etl_code_normalise",
    r"""WITH c AS (SELECT p_partkey AS id, substr(p_type, 1, 1) || lpad((p_partkey % 1000)::VARCHAR, 3, '0') AS raw, p_name || ' (' || p_brand || ')' AS title, 'http://x/' || p_partkey AS uri FROM part)
SELECT id, raw, substr(raw, 1, 3) || '.' || substr(raw, 4, 1) AS normalised, substr(raw, 1, 3) AS parent, trim(split_part(title, ' (', 1)) AS name, split_part(uri, '/', 4) AS tail FROM c""",
)
def etl_code_normalise(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    raw = F.concat(F.substring("p_type", 1, 1), F.lpad((F.col("p_partkey") % 1000).cast("string"), 3, "0"))
    c = p.select(F.col("p_partkey").alias("id"), raw.alias("raw"), F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")")).alias("title"), F.concat(F.lit("http://x/"), F.col("p_partkey").cast("string")).alias("uri"))
    n = c.withColumn("normalised", t.icd10_cause("raw"))
    return n.select("id", "raw", "normalised", t.category("normalised").alias("parent"), t.without_parenthetical("title").alias("name"), t.last_segment("uri").alias("tail"))


@query("etl_set_concat_first", "SELECT p_brand AS brand, string_agg(DISTINCT p_type, '|' ORDER BY p_type) AS types, min_by(p_name, p_partkey) AS first_name FROM part GROUP BY p_brand")
def etl_set_concat_first(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").withColumnsRenamed({"p_brand": "brand", "p_type": "types", "p_name": "first_name"})
    return etl.joined_sets(p, ["brand"], ["types"]).join(etl.first_value(p, ["brand"], "first_name", "p_partkey"), "brand")


@query(
    "etl_collect_structs",
    """SELECT c_nationkey AS nation, count(*) AS n, string_agg(c_custkey || ';' || CASE WHEN c_acctbal >= 0 THEN (c_acctbal::BIGINT)::VARCHAR ELSE '' END || ';' || c_mktsegment, '|' ORDER BY c_custkey) AS entries
FROM (SELECT c_nationkey, c_custkey, trunc(c_acctbal) AS c_acctbal, c_mktsegment FROM customer) GROUP BY c_nationkey""",
)
def etl_collect_structs(spark: SparkSession, sf: str) -> DataFrame:
    """Entries of a nation in order, as positional texts with an empty place for a null."""
    c = table(spark, sf, "customer")
    entry = t.positional_join([F.col("c_custkey"), F.when(F.col("c_acctbal") > -1, F.col("c_acctbal").cast("long")), F.col("c_mktsegment")])
    out = c.groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("c_custkey", entry.alias("e")))).alias("s"))
    return out.select("nation", "n", F.array_join(F.transform("s", lambda x: x["e"]), "|").alias("entries"))

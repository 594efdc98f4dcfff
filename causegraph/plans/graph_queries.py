"""Graph queries: the driver's star schema as a property graph, its quality control and hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from causegraph.catalog import query, table
from causegraph.functions.text import curie
from causegraph.operators import graph, hierarchy


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes: id, label, name, source."""

    def n(name, ns, key, title):
        return table(spark, sf, name).select(curie(ns, key).alias("id"), F.lit(ns).alias("label"), F.col(title).cast("string").alias("name"), F.lit(name).alias("source"))

    return graph.union_all(
        [
            n("region", "region", "r_regionkey", "r_name"),
            n("nation", "nation", "n_nationkey", "n_name"),
            n("customer", "customer", "c_custkey", "c_name"),
            n("supplier", "supplier", "s_suppkey", "s_name"),
            n("part", "part", "p_partkey", "p_name"),
            n("orders", "order", "o_orderkey", "o_orderpriority"),
        ]
    )


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges: start_id, end_id, type, source."""

    def e(name, start, end, kind):
        return table(spark, sf, name).select(curie(*start).alias("start_id"), curie(*end).alias("end_id"), F.lit(kind).alias("type"), F.lit(name).alias("source"))

    return graph.union_all(
        [
            e("nation", ("nation", "n_nationkey"), ("region", "n_regionkey"), "part_of"),
            e("customer", ("customer", "c_custkey"), ("nation", "c_nationkey"), "located_in"),
            e("supplier", ("supplier", "s_suppkey"), ("nation", "s_nationkey"), "located_in"),
            e("orders", ("order", "o_orderkey"), ("customer", "o_custkey"), "placed_by"),
            e("lineitem", ("order", "l_orderkey"), ("part", "l_partkey"), "contains"),
            e("lineitem", ("order", "l_orderkey"), ("supplier", "l_suppkey"), "supplied_by"),
        ]
    )


NODES_SQL = """
SELECT 'region:' || r_regionkey AS id, 'region' AS label, r_name AS name, 'region' AS source FROM region
UNION ALL SELECT 'nation:' || n_nationkey, 'nation', n_name, 'nation' FROM nation
UNION ALL SELECT 'customer:' || c_custkey, 'customer', c_name, 'customer' FROM customer
UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier', s_name, 'supplier' FROM supplier
UNION ALL SELECT 'part:' || p_partkey, 'part', p_name, 'part' FROM part
UNION ALL SELECT 'order:' || o_orderkey, 'order', o_orderpriority, 'orders' FROM orders"""

EDGES_SQL = """
SELECT 'nation:' || n_nationkey AS start_id, 'region:' || n_regionkey AS end_id, 'part_of' AS type, 'nation' AS source FROM nation
UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'located_in', 'customer' FROM customer
UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'located_in', 'supplier' FROM supplier
UNION ALL SELECT 'order:' || o_orderkey, 'customer:' || o_custkey, 'placed_by', 'orders' FROM orders
UNION ALL SELECT 'order:' || l_orderkey, 'part:' || l_partkey, 'contains', 'lineitem' FROM lineitem
UNION ALL SELECT 'order:' || l_orderkey, 'supplier:' || l_suppkey, 'supplied_by', 'lineitem' FROM lineitem"""

GRAPH_SQL = f"WITH n AS ({NODES_SQL}), e AS ({EDGES_SQL})"


@query("graph_bridge_matrix", f"{GRAPH_SQL} SELECT source, split_part(start_id, ':', 1) AS start_ns, split_part(end_id, ':', 1) AS end_ns, count(*) AS count FROM e GROUP BY ALL")
def graph_bridge_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return graph.bridge_matrix(edges(spark, sf))


SUMMARY_SQL = f"""{GRAPH_SQL},
ns AS (SELECT source, count(*) AS n, string_agg(DISTINCT label, ';' ORDER BY label) AS l FROM n GROUP BY source),
es AS (SELECT source, count(*) AS n, string_agg(DISTINCT type, ';' ORDER BY type) AS t FROM e GROUP BY source)"""


@query("graph_source_summary", f"{SUMMARY_SQL} SELECT source, coalesce(ns.n, 0) AS n_nodes, coalesce(es.n, 0) AS n_edges, coalesce(l, '') AS node_labels, coalesce(t, '') AS edge_types FROM ns FULL JOIN es USING (source)")
def graph_source_summary(spark: SparkSession, sf: str) -> DataFrame:
    return graph.source_summary(nodes(spark, sf), edges(spark, sf))


DIGEST_SQL = "sum(('0x' || substr(md5(concat_ws(chr(31), {})), 1, 15))::BIGINT)::VARCHAR"


@query(
    "graph_manifest",
    f"""{GRAPH_SQL}, ns AS (SELECT source, count(*) AS n_nodes, {DIGEST_SQL.format("id, label, name")} AS nodes_digest FROM n GROUP BY source),
es AS (SELECT source, count(*) AS n_edges, {DIGEST_SQL.format("end_id, start_id, type")} AS edges_digest FROM e GROUP BY source),
s AS (SELECT source, coalesce(n_nodes, 0) AS n_nodes, coalesce(n_edges, 0) AS n_edges, nodes_digest, edges_digest FROM ns FULL JOIN es USING (source))
SELECT *, (SELECT sum(n_nodes) FROM s)::BIGINT AS total_nodes, (SELECT sum(n_edges) FROM s)::BIGINT AS total_edges, (SELECT count(*) FROM s) AS n_sources FROM s""",
)
def graph_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return graph.manifest(nodes(spark, sf), edges(spark, sf))


@query(
    "graph_missing_nodes",
    f"""{GRAPH_SQL}, kept AS (SELECT id FROM n ANTI JOIN (SELECT 'supplier:' || s_suppkey AS id FROM supplier WHERE s_acctbal < 0) USING (id)),
ends AS (SELECT source, start_id AS missing_id FROM e UNION ALL SELECT source, end_id FROM e)
SELECT source, missing_id, count(*) AS count FROM ends WHERE missing_id NOT IN (SELECT id FROM kept) GROUP BY ALL""",
)
def graph_missing_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers in debt are taken out of the nodes, so that edges dangle."""
    gone = table(spark, sf, "supplier").where("s_acctbal < 0").select(curie("supplier", "s_suppkey").alias("id"))
    return graph.missing_nodes(nodes(spark, sf).join(gone, "id", "left_anti"), edges(spark, sf))


def twins(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as two sources see them: the second lacks every third segment and has another nation for every seventh."""
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    base = {"id": curie("customer", "c_custkey"), "label": F.lit("customer"), "name": F.col("c_name")}
    first = c.select(*[x.alias(n) for n, x in base.items()], F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("string").alias("nation"), F.lit("crm").alias("source"))
    second = c.where(k % 2 == 0).select(*[x.alias(n) for n, x in base.items()], F.when(k % 3 != 0, F.col("c_mktsegment")).alias("segment"), F.when(k % 7 == 0, F.lit("other")).otherwise(F.col("c_nationkey").cast("string")).alias("nation"), F.lit("billing").alias("source"))
    return first.unionByName(second)


TWINS_SQL = """WITH a AS (
SELECT 'customer:' || c_custkey AS id, c_name AS name, c_mktsegment AS segment, c_nationkey::VARCHAR AS nation, c_custkey AS k FROM customer WHERE c_custkey % 2 = 0),
b AS (SELECT *, CASE WHEN k % 3 <> 0 THEN segment END AS segment2, CASE WHEN k % 7 = 0 THEN 'other' ELSE nation END AS nation2 FROM a)"""


@query("graph_duplicate_report", f"{TWINS_SQL} SELECT id, 2::BIGINT AS n_sources, 'billing;crm' AS sources, (nation <> nation2)::BIGINT AS n_conflicting_attrs, CASE WHEN nation <> nation2 THEN 'nation' ELSE '' END AS conflicting_attrs FROM b")
def graph_duplicate_report(spark: SparkSession, sf: str) -> DataFrame:
    return graph.duplicate_report(twins(spark, sf))


@query("graph_merged_nodes", f"{TWINS_SQL} SELECT id, 'customer' AS label, name, segment, nation2 AS nation, 'billing;crm' AS sources FROM b")
def graph_merged_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return graph.combined_nodes(twins(spark, sf))


@query(
    "graph_import",
    f"""{GRAPH_SQL}, kept AS (SELECT * FROM n ANTI JOIN (SELECT 'supplier:' || s_suppkey AS id FROM supplier WHERE s_acctbal < 0) USING (id))
SELECT 'node' AS kind, id AS a, label AS b, name AS c, source AS d FROM kept
UNION ALL SELECT 'edge', start_id, end_id, type, source FROM e WHERE start_id IN (SELECT id FROM kept) AND end_id IN (SELECT id FROM kept)""",
)
def graph_import(spark: SparkSession, sf: str) -> DataFrame:
    """Of nodes that are there twice, under other names, the first stays; edges stay between nodes that exist."""
    gone = table(spark, sf, "supplier").where("s_acctbal < 0").select(curie("supplier", "s_suppkey").alias("id"))
    n = nodes(spark, sf).join(gone, "id", "left_anti")
    twice = n.unionByName(n.withColumns({"source": F.lit("zz"), "name": F.lit("another")}))
    kept, complete = graph.import_graph(twice, edges(spark, sf))
    rows = kept.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.col("label").alias("b"), F.col("name").alias("c"), F.col("source").alias("d"))
    return rows.unionByName(complete.select(F.lit("edge").alias("kind"), F.col("start_id").alias("a"), F.col("end_id").alias("b"), F.col("type").alias("c"), F.col("source").alias("d")))


@query(
    "graph_import_rejects",
    """WITH n AS (SELECT 'supplier:' || s_suppkey AS id, s_suppkey % 7 <> 0 AS fits FROM supplier),
e AS (SELECT 'part:' || l_partkey AS s, CASE WHEN l_suppkey % 9 <> 0 THEN 'supplier:' || l_suppkey END AS t, l_suppkey % 7 <> 0 AS known, l_quantity FROM lineitem),
f AS (SELECT *, CASE WHEN l_quantity > 48 THEN 'value' WHEN t IS NULL OR NOT known THEN 'no end' END AS reason FROM e),
r AS (SELECT 'node' AS kind, 'value' AS reason, id AS start_id, NULL AS end_id, 1 AS n FROM n WHERE NOT fits
  UNION ALL SELECT 'node', 'no id', NULL, NULL, count(*) FROM supplier WHERE s_suppkey % 4 = 0 HAVING count(*) > 0
  UNION ALL SELECT 'node', 'duplicate', 'supplier:' || s_suppkey, NULL, 1 FROM supplier WHERE s_suppkey % 5 = 0 AND s_suppkey % 7 <> 0
  UNION ALL SELECT 'edge', reason, s, t, count(*) FROM f WHERE reason IS NOT NULL GROUP BY ALL)
SELECT kind, reason, start_id, end_id, sum(n)::BIGINT AS n, NULL::DOUBLE AS total FROM r GROUP BY ALL
UNION ALL SELECT 'kept node', NULL, 'supplier:' || s_suppkey, NULL, 1, s_acctbal FROM supplier WHERE s_suppkey % 7 <> 0
UNION ALL SELECT 'kept edge', NULL, s, t, count(*), sum(l_quantity)::DOUBLE FROM f WHERE reason IS NULL GROUP BY ALL""",
)
def graph_import_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers and what they deliver as text with typed headers. Every seventh balance is no number, every fifth
    supplier is there twice (under another source that comes later, with a good balance only where the first has one),
    every fourth has a twin without an id; every ninth supplier's edges have no end, and large quantities are no numbers."""
    k = F.col("s_suppkey")
    balance = F.when(k % 7 != 0, F.col("s_acctbal").cast("string")).otherwise("none")
    s = table(spark, sf, "supplier").select(k, curie("supplier", "s_suppkey").alias("id"), F.lit("supplier").alias("source"), balance.alias("balance:double"))
    again = s.where((k % 5 == 0) & (k % 7 != 0)).withColumn("source", F.lit("zz"))
    nameless = s.where(k % 4 == 0).withColumns({"id": F.lit(None).cast("string"), "balance:double": F.lit("")})
    parts = table(spark, sf, "part").select(curie("part", "p_partkey").alias("id"), F.lit("part").alias("source"), F.lit("").alias("balance:double"))
    line = table(spark, sf, "lineitem")
    quantity = F.when(F.col("l_quantity") > 48, "many").otherwise(F.col("l_quantity").cast("string"))
    end = F.when(F.col("l_suppkey") % 9 != 0, curie("supplier", "l_suppkey"))
    e = line.select(curie("part", "l_partkey").alias("start_id"), end.alias("end_id"), F.lit("supplied_by").alias("type"), F.lit("lineitem").alias("source"), quantity.alias("quantity:double"))
    kept, complete, rejects, _ = graph.checked_import(graph.union_all([s.drop("s_suppkey"), again.drop("s_suppkey"), nameless.drop("s_suppkey"), parts]), e)
    none = lambda t: F.lit(None).cast(t)
    r = rejects.groupBy("kind", "reason", "start_id", "end_id").agg(F.count(F.lit(1)).alias("n")).withColumn("total", none("double"))
    n = kept.where("source <> 'part'").select(F.lit("kept node").alias("kind"), none("string").alias("reason"), F.col("id").alias("start_id"), none("string").alias("end_id"), F.lit(1).cast("long").alias("n"), F.col("balance").alias("total"))
    c = complete.groupBy("start_id", "end_id").agg(F.count(F.lit(1)).alias("n"), F.sum("quantity").alias("total"))
    return r.unionByName(n).unionByName(c.select(F.lit("kept edge").alias("kind"), none("string").alias("reason"), "start_id", "end_id", "n", "total"))


DEPTH = "1 + (length(text) % 4)"


@query(
    "hier_depth_parent",
    f"""WITH d AS (SELECT conv_id, turn, conv_id || '.' || turn AS id, {DEPTH} AS depth FROM conversations),
p AS (SELECT conv_id, id AS child, depth, """
    + ", ".join(f"last_value(CASE WHEN depth = {d} THEN id END IGNORE NULLS) OVER w AS p{d}" for d in (1, 2, 3))
    + """ FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT child, CASE depth WHEN 2 THEN p1 WHEN 3 THEN p2 WHEN 4 THEN p3 END AS parent FROM p""",
)
def hier_depth_parent(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as a sequence of depths (from the text's length), one for each conversation."""
    d = table(spark, sf, "conversations").select("conv_id", "turn", F.concat_ws(".", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.expr(DEPTH).alias("depth"))
    return hierarchy.depth_parent(d, "id", "depth", "turn", 4, ["conv_id"]).select(F.col("id").alias("child"), "parent")


@query("hier_id_parent", "SELECT DISTINCT replace(p_brand, '#', '.') || '.' || p_size AS child, replace(p_brand, '#', '.') AS parent FROM part")
def hier_id_parent(spark: SparkSession, sf: str) -> DataFrame:
    ids = table(spark, sf, "part").select(F.concat(F.replace("p_brand", F.lit("#"), F.lit(".")), F.lit("."), F.col("p_size").cast("string")).alias("id")).distinct()
    return hierarchy.dotted_parents(ids, "id")


@query(
    "hier_range_expand",
    """WITH codes AS (SELECT DISTINCT substr(p_type, 1, 1) || lpad((p_partkey % 100)::VARCHAR, 2, '0') AS code FROM part),
r AS (SELECT item_id, chr((65 + item_id % 20)::INTEGER) || lpad((item_id % 50)::VARCHAR, 2, '0') AS a, chr((65 + item_id % 20 + item_id % 3)::INTEGER) || lpad((item_id % 50 + 25)::VARCHAR, 2, '0') AS z FROM benchmark)
SELECT item_id AS range_id, code AS member FROM r JOIN codes ON code BETWEEN a AND z""",
)
def hier_range_expand(spark: SparkSession, sf: str) -> DataFrame:
    """Code ranges such as ``C07-C32`` or ``C07-E32`` and the codes within them."""
    codes = table(spark, sf, "part").select(F.concat(F.substring("p_type", 1, 1), F.lpad((F.col("p_partkey") % 100).cast("string"), 2, "0")).alias("code")).distinct()
    i = F.col("item_id")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    letter = lambda more: F.char(65 + i % 20 + more)
    cells = table(spark, sf, "benchmark").select("item_id", F.concat(letter(F.lit(0)), two(i % 50), F.lit("-"), letter(i % 3), two(i % 50 + 25)).alias("cell"))
    return hierarchy.expand_ranges(hierarchy.code_ranges(cells, "cell"), codes, "code").select(F.col("item_id").alias("range_id"), F.col("code").alias("member"))


@query(
    "hier_closure",
    f"""WITH RECURSIVE e AS ({EDGES_SQL}), up AS (SELECT start_id AS node, end_id AS ancestor FROM e WHERE type IN ('part_of', 'located_in')
UNION SELECT up.node, e.end_id FROM up JOIN e ON e.start_id = up.ancestor AND e.type IN ('part_of', 'located_in')) SELECT node, ancestor FROM up""",
)
def hier_closure(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.closure(edges(spark, sf).where("type in ('part_of', 'located_in')"), "start_id", "end_id")

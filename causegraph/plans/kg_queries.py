"""The graph's sources, each over raw tables that are made from the driver's, with what it makes as SQL.

Rows are nodes and edges in one shape: kind, and a to e as texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from causegraph.catalog import query, table
from causegraph.operators import graph, kg_sources as kg

NODE, EDGE = ("id", "label", "name"), ("start_id", "end_id", "type")


def flat(made: kg.Graph, node: tuple = NODE, edge: tuple = EDGE) -> DataFrame:
    """Chosen columns of nodes and edges as rows (kind, a, b, c, d, e)."""

    def rows(df: DataFrame, kind: str, columns: tuple) -> DataFrame:
        cells = [F.col(c) if isinstance(c, str) else c for c in columns]
        cells = [*cells, *[F.lit(None)] * (5 - len(cells))]
        return df.select(F.lit(kind).alias("kind"), *[c.cast("string").alias(n) for c, n in zip(cells, "abcde")])

    return rows(made[0], "node", node).unionByName(rows(made[1], "edge", edge))


def text(*parts: Column | str) -> Column:
    """Columns (and literal strings) as one text."""
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def two(c: Column) -> Column:
    return F.lpad(c.cast("string"), 2, "0")


C = F.col


def part_codes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(text(F.substring("p_type", 1, 1), two(C("p_partkey") % 100)).alias("code"), "p_partkey", "p_name")


CODES_SQL = "SELECT substr(p_type, 1, 1) || lpad((p_partkey % 100)::VARCHAR, 2, '0') AS code, p_partkey, p_name FROM part"


@query(
    "kg_icd10",
    """WITH p AS (SELECT 'S' || p_partkey AS code, p_partkey FROM part), v AS (SELECT 'S' || vec_id AS code, len(embedding) AS n, floor(embedding[1]::DOUBLE * 1000000)::BIGINT AS first, floor(embedding[len(embedding)]::DOUBLE * 1000000)::BIGINT AS last FROM embeddings)
SELECT DISTINCT 'node' AS kind, 'icd10:' || code AS a, 'icd10' AS b, CASE WHEN p_partkey % 100 < 10 THEN 'block' ELSE 'category' END AS c, code AS d, n || ' ' || first || ' ' || last AS e FROM p LEFT JOIN v USING (code)
UNION ALL SELECT DISTINCT 'edge', 'icd10:' || code, 'icd10:' || substr(code, 1, 1), CASE WHEN p_partkey % 2 = 0 THEN 'related_to' ELSE 'is_a' END, NULL, NULL FROM p""",
)
def kg_icd10(spark: SparkSession, sf: str) -> DataFrame:
    """Codes with a kind, some with a vector, and links of which some have no kind."""
    p = table(spark, sf, "part").select(text("S", C("p_partkey")).alias("code"), "p_partkey")
    nodes = p.select("code", F.when(C("p_partkey") % 100 < 10, "block").otherwise("category").alias("kind"))
    edges = p.select(C("code").alias("source"), F.substring("code", 1, 1).alias("target"), F.when(C("p_partkey") % 2 == 1, "is_a").alias("kind"))
    v = table(spark, sf, "embeddings").select(text("S", C("vec_id")).alias("code"), "embedding")
    millionths = lambda i: F.floor(F.try_element_at("embedding", F.lit(i)).cast("double") * 1_000_000).cast("string")
    held = F.when(C("embedding").isNotNull(), F.concat(F.size("embedding").cast("string"), F.lit(" "), millionths(1), F.lit(" "), millionths(-1)))
    return flat(kg.code_graph(nodes, edges, embeddings=v), ("id", "label", "class_kind", "code", held))


@query(
    "kg_acme",
    """SELECT 'node' AS kind, 'icd10:N' || n_nationkey AS a, 'icd10' AS b, n_name AS c, NULL AS d, NULL AS e FROM nation
UNION ALL SELECT DISTINCT 'edge', 'icd10:N' || n_nationkey, 'icd10:N' || n_regionkey, 'related_to', NULL, NULL FROM nation""",
)
def kg_acme(spark: SparkSession, sf: str) -> DataFrame:
    """Codes with names, and links without a kind."""
    n = table(spark, sf, "nation")
    nodes = n.select(text("N", C("n_nationkey")).alias("code"), F.lit("code").alias("kind"), C("n_name").alias("name"))
    edges = n.select(text("N", C("n_nationkey")).alias("source"), text("N", C("n_regionkey")).alias("target"), F.lit(None).cast("string").alias("kind"))
    return flat(kg.REGISTRY["acme"](nodes, edges))


@query(
    "kg_icd11",
    """WITH t AS (SELECT conv_id, turn, conv_id || '-' || turn AS id, 1 + length(text) % 4 AS depth, role FROM conversations WHERE turn % 7 <> 6),
p AS (SELECT *, last_value(CASE WHEN depth = 1 THEN id END IGNORE NULLS) OVER w AS p1, last_value(CASE WHEN depth = 2 THEN id END IGNORE NULLS) OVER w AS p2,
  last_value(CASE WHEN depth = 3 THEN id END IGNORE NULLS) OVER w AS p3 FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
u AS (SELECT id, CASE depth WHEN 2 THEN p1 WHEN 3 THEN p2 WHEN 4 THEN p3 END AS parent FROM p),
m AS (SELECT conv_id || '-' || turn AS id, CASE WHEN turn % 3 = 0 AND turn % 2 = 1 THEN NULL WHEN turn % 2 = 0 THEN 'B' || turn ELSE 'A' || turn END AS code FROM conversations)
SELECT 'node' AS kind, 'icd11:' || id AS a, 'icd11' AS b, role AS c, 'C' || turn AS d, 'category' AS e FROM t
UNION ALL SELECT 'edge', 'icd11:' || id, 'icd11:' || parent, 'is_a', NULL, NULL FROM u WHERE parent IS NOT NULL
UNION ALL SELECT 'edge', 'icd11:' || t.id, 'icd10:' || code, 'maps_to', NULL, NULL FROM t JOIN m USING (id) WHERE code IS NOT NULL""",
)
def kg_icd11(spark: SparkSession, sf: str) -> DataFrame:
    """Dialogues as chapters: depths make parents, every seventh turn is residual, and the last mapping of a turn counts."""
    c = table(spark, sf, "conversations")
    uri = text("http://id/", C("conv_id"), "-", C("turn"))
    tab = c.select(C("turn").alias("row_no"), C("conv_id").alias("chapter"), uri.alias("foundation_uri"), text("C", C("turn")).alias("code"), text("- - ", C("role")).alias("title"), F.lit("category").alias("class_kind"), (1 + F.length("text") % 4).alias("depth"), (C("turn") % 7 == 6).alias("is_residual"))
    first = c.select(F.lit(1).alias("row_no"), uri.alias("foundation_uri"), F.when(C("turn") % 3 == 0, "No Mapping").otherwise(text("A", C("turn"))).alias("icd10_code"))
    later = c.where("turn % 2 = 0").select(F.lit(2).alias("row_no"), uri.alias("foundation_uri"), text("B", C("turn")).alias("icd10_code"))
    return flat(kg.icd11(tab, first.unionByName(later), 4), ("id", "label", "name", "code", "class_kind"))


@query(
    "kg_phmrc",
    """WITH r AS (SELECT p_partkey AS k, p_brand AS age, CASE WHEN p_size % 4 = 0 THEN 'None' ELSE split_part(p_type, ' ', 1) END AS grp, p_name AS name, 'C' || p_size AS code, CASE WHEN p_size = 9 THEN 'P23' ELSE 'R' || p_size END AS icd, p_size FROM part),
x AS (SELECT k, age, grp, CASE WHEN p_size = 7 THEN 'Leukemia/Lymphomas' ELSE name END AS name, CASE WHEN p_size = 7 THEN 'D91' ELSE code END AS code, icd FROM r
  UNION ALL SELECT k, age, grp, 'Lymphomas', 'G96', icd FROM r WHERE p_size = 7)
SELECT 'node' AS kind, 'phmrc:' || code AS a, 'phmrc' AS b, string_agg(DISTINCT name, '|' ORDER BY name) AS c, string_agg(DISTINCT age, '|' ORDER BY age) AS d, string_agg(DISTINCT grp, '|' ORDER BY grp) AS e FROM x GROUP BY code
UNION ALL SELECT 'edge', 'phmrc:' || code, 'icd10:' || min_by(icd, k), 'maps_to', NULL, NULL FROM x GROUP BY code""",
)
def kg_phmrc(spark: SparkSession, sf: str) -> DataFrame:
    """A cause list: names in parentheses, rows without a group, a double code and a rewritten one."""
    size = C("p_size")
    causes = table(spark, sf, "part").select(
        C("p_partkey").alias("row_no"), C("p_brand").alias("age_group"), F.when(size % 4 != 0, F.split("p_type", " ")[0]).alias("group"), text(C("p_name"), " (all)").alias("name"),
        F.when(size == 7, "D91 (G96)").otherwise(text("C", size)).alias("smart_va"), F.when(size == 9, "P23/J22").otherwise(text("R", size)).alias("icd10"), F.lit("x").alias("comments"),
    )
    return flat(kg.phmrc(causes), ("id", "label", "name", "age_group", "cod_group"))


@query(
    "kg_who_va",
    f"""WITH codes AS (SELECT DISTINCT code FROM ({CODES_SQL})),
b AS (SELECT item_id AS i, 'VAs-' || lpad((item_id % 20)::VARCHAR, 2, '0') || CASE WHEN item_id >= 20 THEN '.' || lpad((item_id // 20)::VARCHAR, 2, '0') ELSE '' END AS id, chr((65 + item_id % 19)::INTEGER) AS l1, chr((66 + item_id % 19)::INTEGER) AS l2 FROM benchmark),
r AS (SELECT id, l1 || '10' AS f, l2 || '05' AS t FROM b WHERE i % 3 <> 0)
SELECT 'node' AS kind, 'who.va:' || id AS a, 'who.va' AS b, 'Category ' || i AS c, NULL AS d, NULL AS e FROM b
UNION ALL SELECT 'edge', 'who.va:' || id, 'who.va:' || split_part(id, '.', 1), 'is_a', NULL, NULL FROM b WHERE contains(id, '.')
UNION ALL SELECT DISTINCT 'edge', 'icd10:' || code, 'who.va:' || id, 'maps_to', NULL, NULL FROM (
  SELECT code, id FROM r JOIN codes ON code BETWEEN f AND t || chr(65535) UNION SELECT 'Q' || i, id FROM b WHERE i % 3 <> 0)""",
)
def kg_who_va(spark: SparkSession, sf: str) -> DataFrame:
    """Categories with code ranges over two letters, single codes in parentheses, or blank cells."""
    i = C("item_id")
    ident = text("VAs-", two(i % 20), F.when(i >= 20, text(".", two(F.floor(i / 20)))).otherwise(""))
    letter = lambda n: F.char(n + i % 19)
    cells = F.when(i % 3 == 0, " ").otherwise(text(letter(65), "10-", letter(66), "05, (Q", i, ");"))
    categories = table(spark, sf, "benchmark").select(ident.alias("who_va_id"), text("Category ", i).alias("who_va_name"), cells.alias("icd10_codes"))
    return flat(kg.who_va(categories, part_codes(spark, sf).select("code").distinct()))


@query(
    "kg_probbase",
    """WITH q AS (SELECT * FROM customer WHERE c_custkey % 5 <> 0)
SELECT 'node' AS kind, 'who.va.q:Q' || c_custkey AS a, 'who.va.q' AS b, c_name AS c, c_mktsegment AS d, NULL AS e FROM q
UNION ALL SELECT 'edge', 'who.va.q:Q' || c_custkey, 'who.va:VAs-01', 'probbase_rel', chr((65 + c_custkey % 5)::INTEGER), NULL FROM q
UNION ALL SELECT 'edge', 'who.va.q:Q' || c_custkey, 'who.va:VAs-01.02', 'probbase_rel', CASE WHEN c_nationkey > 12 THEN 'N' END, NULL FROM q
UNION ALL SELECT 'edge', 'who.va.q:Q' || c_custkey, 'who.va:VAs-12', 'probbase_rel', c_nationkey::VARCHAR, NULL FROM q""",
)
def kg_probbase(spark: SparkSession, sf: str) -> DataFrame:
    """A question matrix: questions without an indicator go, empty cells stay."""
    k = C("c_custkey")
    blank = [F.lit("").alias(c) for c in ("sdesc", "ilab", "subst", "samb")]
    questions = table(spark, sf, "customer").select(
        text("Q", k).alias("who_2016"), C("c_name").alias("qdesc"), F.when(k % 5 != 0, C("c_mktsegment")).alias("indic"), *blank,
        F.char(65 + k % 5).alias("b_0100"), F.when(C("c_nationkey") > 12, "N").alias("b_0102"), C("c_nationkey").cast("string").alias("b_1200"),
    )
    return flat(kg.probbase(questions), ("id", "label", "name", "indic"), ("start_id", "end_id", "type", "value"))


@query(
    "kg_hpo",
    """WITH l AS (SELECT DISTINCT CASE WHEN l_partkey % 2 = 0 THEN 'omim:' ELSE 'orpha:' END || l_partkey AS d, 'hp:' || l_suppkey AS h, CASE WHEN l_partkey % 2 = 0 THEN 'omim' ELSE 'orpha' END AS ns, l_suppkey, l_partkey, l_returnflag AS ev, l_linestatus AS fr FROM lineitem)
SELECT DISTINCT 'node' AS kind, d AS a, ns AS b, 'Disease ' || l_partkey AS c, NULL AS d, NULL AS e FROM l
UNION ALL SELECT DISTINCT 'node', h, 'hp', s_name, NULL, NULL FROM l LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 3 <> 0) ON s_suppkey = l_suppkey
UNION ALL SELECT DISTINCT 'edge', d, h, 'has_phenotype', ev, fr FROM l""",
)
def kg_hpo(spark: SparkSession, sf: str) -> DataFrame:
    """Annotations with many repetitions, and terms of which a third are unknown."""
    k = C("l_partkey")
    empty = [F.lit("").alias(c) for c in ("onset", "qualifier", "sex", "modifier")]
    a = table(spark, sf, "lineitem").select(text(F.when(k % 2 == 0, "OMIM:").otherwise("ORPHA:"), k).alias("database_id"), text("Disease ", k).alias("disease_name"), text("HP:", C("l_suppkey")).alias("hpo_id"), C("l_returnflag").alias("evidence"), C("l_linestatus").alias("frequency"), F.lit("P").alias("aspect"), *empty)
    terms = table(spark, sf, "supplier").where("s_suppkey % 3 <> 0").select(text("HP:", C("s_suppkey")).alias("id"), C("s_name").alias("name"))
    return flat(kg.hpo(a, terms), edge=("start_id", "end_id", "type", "evidence", "frequency"))


@query(
    "kg_mesh_hierarchy",
    """WITH isa AS (SELECT 'S' || s_suppkey AS child, 'N' || s_nationkey AS parent FROM supplier UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation
  UNION ALL SELECT 'R' || r_regionkey, CASE r_regionkey WHEN 0 THEN 'D001419' WHEN 1 THEN 'D014780' ELSE 'D005842' END FROM region WHERE r_regionkey < 4 UNION ALL SELECT 'S' || s_suppkey, 'R4' FROM supplier WHERE s_suppkey % 5 = 0),
terms AS (SELECT 'S' || s_suppkey AS id, s_name AS name FROM supplier UNION ALL SELECT 'N' || n_nationkey, n_name FROM nation UNION ALL SELECT 'R' || r_regionkey, r_name FROM region UNION ALL SELECT unnest(['D001419', 'D014780', 'D005842']), 'root'),
place AS (SELECT 'S' || s_suppkey AS id, s_nationkey AS n FROM supplier UNION ALL SELECT 'N' || n_nationkey, n_nationkey FROM nation),
reg AS (SELECT id, n_regionkey AS r FROM place JOIN nation ON n_nationkey = n UNION ALL SELECT 'R' || r_regionkey, r_regionkey FROM region),
cls AS (SELECT t.id, t.name, (t.id LIKE 'S%' AND substr(t.id, 2)::INT % 2 = 0) OR t.id IN ('R4', 'N3') AS dis,
  coalesce(r.r IN (0, 1), false) OR t.id IN ('D001419', 'D014780') AS pat, coalesce(r.r IN (2, 3), false) OR t.id = 'D005842' AS geo FROM terms t LEFT JOIN reg r USING (id)),
kept AS (SELECT * FROM cls WHERE dis OR pat OR geo)
SELECT 'node' AS kind, 'mesh:' || id AS a, 'mesh' AS b, name AS c, NULL AS d, NULL AS e FROM kept
UNION ALL SELECT DISTINCT 'edge', 'mesh:' || k.id, 'mesh:' || p.id, 'isa', NULL, NULL FROM kept k JOIN isa ON isa.child = k.id JOIN cls p ON p.id = isa.parent
WHERE (NOT k.dis OR p.dis) AND (NOT k.pat OR p.pat) AND (NOT k.geo OR p.geo)""",
)
def kg_mesh_hierarchy(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers below nations below regions below the roots of pathogens and places; every other supplier is a disease too."""
    s, n, r = (table(spark, sf, x) for x in ("supplier", "nation", "region"))
    pair = lambda df, child, parent: df.select(child.alias("child"), parent.alias("parent"))
    key = C("r_regionkey")
    root = F.when(key == 0, "D001419").when(key == 1, "D014780").otherwise("D005842")
    isa = graph.union_all([
        pair(s, text("S", C("s_suppkey")), text("N", C("s_nationkey"))), pair(n, text("N", C("n_nationkey")), text("R", C("n_regionkey"))),
        pair(r.where(key < 4), text("R", key), root), pair(s.where("s_suppkey % 5 = 0"), text("S", C("s_suppkey")), F.lit("R4")),
    ])
    term = lambda df, ident, name: df.select(ident.alias("id"), C(name).alias("name"))
    roots = spark.createDataFrame([(x, "root") for x in ("D001419", "D014780", "D005842")], "id string, name string")
    terms = graph.union_all([term(s, text("S", C("s_suppkey")), "s_name"), term(n, text("N", C("n_nationkey")), "n_name"), term(r, text("R", key), "r_name"), roots])
    disease = s.where("s_suppkey % 2 = 0").select(text("S", C("s_suppkey")).alias("id")).unionByName(spark.createDataFrame([("R4",), ("N3",)], "id string"))
    return flat(kg.mesh_hierarchy(terms, isa, disease))


@query(
    "kg_mondo",
    """SELECT DISTINCT 'node' AS kind, 'mondo:' || p_partkey AS a, 'mondo' AS b, p_name AS c, NULL AS d, NULL AS e FROM part WHERE p_partkey % 4 <> 0
UNION ALL SELECT 'edge', 'mondo:' || p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'omim:' || p_size ELSE 'mesh:D' || p_size || ':x' END, 'skos:exactMatch', NULL, NULL FROM part WHERE p_partkey % 4 <> 0 AND p_partkey % 3 <> 2""",
)
def kg_mondo(spark: SparkSession, sf: str) -> DataFrame:
    """Terms of two ontologies; cross-references with accepted and other prefixes, other relations, and without a prefix."""
    k, size = C("p_partkey"), C("p_size")
    target = F.when(k % 3 == 0, text("OMIM:", size)).when(k % 3 == 1, text("MESH:D", size, ":x")).otherwise(text("UMLS:", size))
    props = F.array(text("skos:exactMatch ", target), text("skos:broadMatch OMIM:", k), text("skos:exactMatch nothing"))
    terms = table(spark, sf, "part").select(text(F.when(k % 4 != 0, "MONDO:").otherwise("HP:"), k).alias("id"), C("p_name").alias("name"), props.alias("property_value"))
    return flat(kg.mondo(terms))


@query(
    "kg_wdi",
    """WITH o AS (SELECT n_nationkey AS k, n_name AS country, o_orderpriority AS code, year(o_orderdate) AS y, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL),
dev AS (SELECT * FROM o WHERE code < '4'), rows AS (SELECT * FROM dev UNION ALL SELECT * FROM o WHERE code >= '3' AND code NOT IN (SELECT code FROM dev)),
m AS (SELECT * FROM rows WHERE k % 6 <> 5)
SELECT DISTINCT 'node' AS kind, 'wdi:' || code AS a, 'wdi' AS b, 'Series ' || code AS c, NULL AS d, NULL AS e FROM m
UNION ALL SELECT 'edge', 'mesh:G' || k, 'wdi:' || code, 'has_indicator', '{' || string_agg('"' || y || '":' || n || '.0', ',' ORDER BY y) || '}', NULL FROM m GROUP BY k, code""",
)
def kg_wdi(spark: SparkSession, sf: str) -> DataFrame:
    """Two tables of yearly values by nation, of which the second repeats a series; names of some nations are mapped, some are unknown."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), C("c_custkey") == C("o_custkey")).join(table(spark, sf, "nation"), C("n_nationkey") == C("c_nationkey"))
    rows = o.select(C("n_name").alias("Country Name"), C("o_orderpriority").alias("Series Code"), text("Series ", C("o_orderpriority")).alias("Series Name"), F.year("o_orderdate").cast("string").alias("y"))
    years = sorted(r.y for r in rows.select("y").distinct().collect())  # one row a year
    wide = rows.groupBy("Country Name", "Series Code", "Series Name").pivot("y", years).count()
    wide = wide.select("Country Name", "Series Code", "Series Name", *[F.coalesce(C(y).cast("string"), F.lit("..")).alias(f"{y} [YR{y}]") for y in years])
    n = table(spark, sf, "nation")
    mapping = n.where("n_nationkey % 2 = 0").select(C("n_name").alias("name"), text("The ", C("n_name")).alias("mesh_name"))
    known = n.where("n_nationkey % 6 <> 5").select(F.lit(2).alias("row_no"), text("mesh:G", C("n_nationkey")).alias("id"), F.when(C("n_nationkey") % 2 == 0, text("The ", C("n_name"))).otherwise(C("n_name")).alias("name"))
    old = known.withColumns({"row_no": F.lit(1), "id": F.lit("mesh:old")})
    return flat(kg.wdi(wide.where("`Series Code` < '4'"), wide.where("`Series Code` >= '3'"), mapping, old.unionByName(known)), edge=("start_id", "end_id", "type", "years_data"))


@query(
    "kg_who_mortality",
    """WITH d AS (SELECT c_nationkey AS country, year(o_orderdate) AS y, ['104', '10M', '103', '101'][1 + (c_nationkey + year(o_orderdate) + o_orderkey % 2) % 4] AS list, CASE WHEN o_orderkey % 9 = 0 THEN 'aaa' ELSE 'A' || lpad((o_orderkey % 500)::VARCHAR, 3, '0') END AS cause, [1, 2, 9][1 + o_orderkey % 3] AS sex, o_orderkey AS n FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 4 <> 1),
k AS (SELECT *, CASE list WHEN '104' THEN 0 WHEN '10M' THEN 1 WHEN '103' THEN 2 END AS rk FROM d),
best AS (SELECT * FROM (SELECT *, min(rk) OVER (PARTITION BY country, y) AS m FROM k WHERE rk IS NOT NULL) WHERE rk = m AND cause <> 'aaa'),
pop AS (SELECT n_nationkey AS country, 2019 + n_regionkey AS y FROM nation WHERE n_regionkey >= 2),
s AS (SELECT country, string_agg('{"year":' || y || ',"sex":"' || s || '","population_total":' || (country * 100) || ',"age_populations":[' || array_to_string(list_transform(range(2, 27), lambda i: i::VARCHAR), ',') || ']' || '}', ',' ORDER BY s) AS j FROM pop, (SELECT unnest(['male', 'unspecified']) AS s) GROUP BY country),
known AS (SELECT country FROM best UNION SELECT country FROM pop)
SELECT 'node' AS kind, 'who_mortality:' || k.country AS a, 'who_mortality' AS b, CASE WHEN k.country % 5 = 0 THEN '' ELSE n_name END AS c, coalesce('[' || j || ']', '') AS d, NULL AS e FROM known k JOIN nation ON n_nationkey = k.country LEFT JOIN s ON s.country = k.country
UNION ALL SELECT 'edge', 'who_mortality:' || country, 'icd10:' || substr(cause, 1, 3) || '.' || substr(cause, 4), 'has_mortality', y || '|' || CASE sex WHEN 1 THEN 'male' WHEN 2 THEN 'female' ELSE 'unspecified' END || '|' || n,
  '2;;' || array_to_string(list_transform(range(4, 27), lambda i: i::VARCHAR), ';') FROM best""",
)
def kg_who_mortality(spark: SparkSession, sf: str) -> DataFrame:
    """Deaths by nation and year in lists of several details, with regional rows and totals over all causes; populations and names of some."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), C("c_custkey") == C("o_custkey"))
    k, y = C("o_orderkey"), F.year("o_orderdate")
    pick = lambda values, i: F.get(F.array(*map(F.lit, values)), i.cast("int"))
    ages = [F.lit(None if i == 3 else i).cast("int").alias(f"Deaths{i}") for i in range(2, 27)]
    deaths = o.select(
        C("c_nationkey").alias("Country"), F.when(k % 4 == 1, "r").alias("Admin1"), F.lit(None).cast("string").alias("SubDiv"), y.alias("Year"),
        text(" ", pick(["104", "10M", "103", "101"], (C("c_nationkey") + y + k % 2) % 4)).alias("List"), F.when(k % 9 == 0, "aaa").otherwise(text("A", F.lpad((k % 500).cast("string"), 3, "0"))).alias("Cause"),
        pick([1, 2, 9], k % 3).alias("Sex"), k.alias("Deaths1"), *ages,
    )
    n = table(spark, sf, "nation").withColumn("sex", F.explode(F.array(F.lit(1), F.lit(9))))
    population = n.select(C("n_nationkey").alias("Country"), F.lit(None).cast("string").alias("Admin1"), (2019 + C("n_regionkey")).alias("Year"), C("sex").alias("Sex"), (C("n_nationkey") * 100).alias("Pop1"), *[F.lit(i).alias(f"Pop{i}") for i in range(2, 27)], F.lit(None).cast("int").alias("Lb"))
    names = table(spark, sf, "nation").where("n_nationkey % 5 <> 0").select(C("n_nationkey").cast("string").alias("country"), text(" ", C("n_name"), " ").alias("name"))
    edge = ("start_id", "end_id", "type", F.concat_ws("|", C("year").cast("string"), "sex", C("deaths_total").cast("string")), "age_deaths")
    return flat(kg.who_mortality(deaths, population, names), ("id", "label", "name", "population_data"), edge)


@query(
    "kg_build",
    f"""WITH p AS ({CODES_SQL}), n AS (SELECT DISTINCT 'icd10' AS source, 'icd10:' || code AS id FROM p UNION ALL SELECT 'acme', 'icd10:N' || n_nationkey FROM nation),
e AS (SELECT DISTINCT 'icd10' AS source, 'icd10:' || code AS s, 'icd10:' || substr(code, 1, 1) AS t FROM p UNION ALL SELECT DISTINCT 'acme', 'icd10:N' || n_nationkey, 'icd10:N' || n_regionkey FROM nation)
SELECT source, (SELECT count(*) FROM n WHERE n.source = x.source) AS n_nodes, (SELECT count(*) FROM e WHERE e.source = x.source) AS n_edges,
  (SELECT count(*) FROM e WHERE e.source = x.source AND e.t NOT IN (SELECT id FROM n))::BIGINT AS n_missing FROM (SELECT DISTINCT source FROM n) x""",
)
def kg_build(spark: SparkSession, sf: str) -> DataFrame:
    """Two sources built, united and checked: counts of nodes, edges and ends without a node."""
    p = part_codes(spark, sf)
    n = table(spark, sf, "nation")
    none = F.lit(None).cast("string").alias("kind")
    made = kg.build({
        "icd10": {"nodes": p.select("code", none), "edges": p.select(C("code").alias("source"), F.substring("code", 1, 1).alias("target"), none)},
        "acme": {"nodes": n.select(text("N", C("n_nationkey")).alias("code"), none), "edges": n.select(text("N", C("n_nationkey")).alias("source"), text("N", C("n_regionkey")).alias("target"), none)},
    })
    missing = graph.missing_nodes(*made).groupBy("source").agg(F.sum("count").alias("n_missing"))
    out = graph.source_summary(*made).join(missing, "source", "left")
    return out.select("source", "n_nodes", "n_edges", F.coalesce("n_missing", F.lit(0)).cast("long").alias("n_missing"))

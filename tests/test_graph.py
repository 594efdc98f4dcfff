"""Graph operators, hierarchies and sources on mini fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from causegraph.operators import etl, graph, hierarchy, kg_sources as kg


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame(
        [("a", "x:1", "x", "one", None, 1), ("b", "x:1", "x", "one", "c1", 2), ("a", "x:2", "x", "two", "c", 3), ("b", "x:2", "x", "zwei", "c", 4), ("a", "x:3", "x", "old", "c", 5), ("a", "x:3", "x", "new", "c", 6), ("b", "x:4", "x", "four", None, 7)],
        "source string, id string, label string, name string, code string, row_no int",
    )


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([("a", "x:1", "x:9", "r"), ("a", "x:9", "x:9", "r"), ("b", "x:1", "x:4", "r"), ("b", "y:1", "x:2", "s")], "source string, start_id string, end_id string, type string")


def test_duplicates(nodes):
    got = [tuple(r) for r in graph.duplicate_report(nodes, "row_no").collect()]
    assert got == [("x:2", 2, "a;b", 1, "name"), ("x:1", 2, "a;b", 0, ""), ("x:3", 1, "a", 0, "")]
    assert rows(graph.combined_nodes(nodes, "row_no"), "id", "name", "code", "sources") == [("x:1", "one", "c1", "a;b"), ("x:2", "two", "c", "a;b"), ("x:3", "new", "c", "a")]
    with pytest.raises(graph.DuplicateNodeError):
        graph.duplicate_report(nodes, "row_no", strict=True)


def test_missing_and_import(nodes, edges):
    assert [tuple(r) for r in graph.missing_nodes(nodes, edges).collect()] == [("a", "x:9", 3), ("b", "y:1", 1)]
    with pytest.raises(graph.MissingNodeError):
        graph.missing_nodes(nodes, edges, strict=True)
    n, e = graph.import_graph(nodes, edges, [F.col("row_no")])
    assert rows(n, "id", "name") == [("x:1", "one"), ("x:2", "two"), ("x:3", "old"), ("x:4", "four")] and rows(e, "start_id", "end_id") == [("x:1", "x:4")]


def test_typed_headers(spark):
    df = spark.createDataFrame([("7", "a;b", "1.5;;2", "")], ["year:int", "tags:string[]", "v:float[]", "w:float[]"])
    r = graph.typed(df).first()
    assert (r.year, r.tags, r.v, r.w) == (7, ["a", "b"], [1.5, None, 2.0], None)


def test_reports(spark, nodes, edges):
    sizes = spark.createDataFrame([("a", 1_500_000, 10)], "source string, nodes_file_bytes long, edges_file_bytes long")
    s = graph.source_summary(nodes, edges, sizes).collect()
    assert [(r.source, r.n_nodes, r.n_edges, r.edge_types, r.nodes_file_mb) for r in s] == [("a", 4, 2, "r", 1.5), ("b", 3, 2, "r;s", None)]
    m = graph.manifest(nodes, edges).collect()
    assert {(r.total_nodes, r.total_edges, r.n_sources) for r in m} == {(7, 4, 2)}
    again = {r.source: r.nodes_digest for r in graph.manifest(nodes.orderBy(F.desc("row_no")), edges).collect()}
    assert again == {r.source: r.nodes_digest for r in m}
    assert [tuple(r) for r in graph.bridge_matrix(edges).collect()][0] == ("a", "x", "x", 2)


def test_hierarchies(spark):
    d = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, "c", 3), (4, "d", 2), (5, "e", 3), (6, "f", 1), (7, "g", 3)], "n int, id string, d int")
    assert rows(hierarchy.depth_parent(d, "id", "d", "n", 3), "id", "parent") == [("a", None), ("b", "a"), ("c", "b"), ("d", "a"), ("e", "d"), ("f", None), ("g", "d")]
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "c string, p string")
    assert rows(hierarchy.closure(e, "c", "p")) == [*[(i, j) for i in "abc" for j in "abc"], ("x", "y")]
    assert rows(hierarchy.below(e, ["y"], "c", "p")) == [("x",), ("y",)]
    assert rows(hierarchy.below(e, ["a", "nowhere"], "c", "p")) == [("a",), ("b",), ("c",)]
    r = hierarchy.code_ranges(spark.createDataFrame([(1, "A40-A41; (B20), C1 - D2"), (2, "")], "i int, c string"), "c")
    assert rows(r, "i", "range_from", "range_to") == [(1, "A40", "A41"), (1, "B20", "B20"), (1, "C1", "D2")]
    codes = spark.createDataFrame([("A40",), ("A40.1",), ("A41.9",), ("A42",), ("D2",), ("C9",)], "code string")
    assert rows(hierarchy.expand_ranges(r.where("range_from <> range_to"), codes, "code"), "code") == [("A40",), ("A40.1",), ("A41.9",), ("C9",), ("D2",)]


def test_etl(spark):
    df = spark.createDataFrame([(1, "103", 5), (1, "104", 6), (2, "103", 7), (2, "101", 8), (1, "104", 9)], "c int, l string, v int")
    from causegraph.functions.text import lookup

    assert rows(etl.most_granular(df, ["c"], lookup(kg.LIST_RANK, "l")), "v") == [(6,), (7,), (9,)]
    assert rows(etl.last_wins(df, "c", "v", "v")) == [(1, 9), (2, 8)]
    assert rows(etl.latest(df, ["c"], "v", 1), "v") == [(8,), (9,)]
    assert rows(etl.exploded_codes(spark.createDataFrame([(" a; ;b ",)], "x string"), "x"), "code") == [("a",), ("b",)]


def test_icd11(spark):
    tab = spark.createDataFrame([(1, "http://i/1", None, "Chapter", "chapter", 1, False), (2, "http://i/2", "1A", "- - Block", "block", 2, False), (3, "http://i/3", "1A0", "- X", "category", 3, False), (4, "http://i/3/other", "1AY", "rest", "category", 2, True), (5, "http://i/5", "1B", "Y", "block", 2, False)], "row_no int, foundation_uri string, code string, title string, class_kind string, depth int, is_residual boolean")
    m = spark.createDataFrame([(1, "http://i/2", "A00"), (2, "http://i/2", "A01"), (3, "http://i/5", "No Mapping")], "row_no int, foundation_uri string, icd10_code string")
    n, e = kg.icd11(tab, m, 3)
    assert rows(n, "id", "name") == [("icd11:1", "Chapter"), ("icd11:2", "Block"), ("icd11:3", "X"), ("icd11:5", "Y")]
    assert rows(e) == [("icd11:2", "icd10:A01", "maps_to"), ("icd11:2", "icd11:1", "is_a"), ("icd11:3", "icd11:2", "is_a"), ("icd11:5", "icd11:1", "is_a")]


def test_cause_lists(spark):
    c = spark.createDataFrame([(1, "adult", "G1", "Leukemia (all)", "D91 (G96)", "C95", "x"), (2, "child", None, "Pneumonia (any)", "J1", "P23/J22", "y"), (3, "adult", "G2", "Pneumonia", "J1", "J99", "y")], "row_no int, age_group string, `group` string, name string, smart_va string, icd10 string, comments string")
    n, e = kg.phmrc(c)
    assert rows(n, "id", "name", "cod_group", "age_group") == [("phmrc:D91", "Leukemia/Lymphomas", "G1", "adult"), ("phmrc:G96", "Lymphomas", "G1", "adult"), ("phmrc:J1", "Pneumonia", "G2|None", "adult|child")]
    assert rows(e) == [("phmrc:D91", "icd10:C95", "maps_to"), ("phmrc:G96", "icd10:C95", "maps_to"), ("phmrc:J1", "icd10:P23", "maps_to")]
    v = spark.createDataFrame([("VAs-01", "Inf", None), ("VAs-01.01", "Sepsis", "A40-A41; B20")], "who_va_id string, who_va_name string, icd10_codes string")
    n, e = kg.who_va(v, spark.createDataFrame([("A40",), ("A41",), ("A42",)], "code string"))
    assert rows(e) == [("icd10:A40", "who.va:VAs-01.01", "maps_to"), ("icd10:A41", "who.va:VAs-01.01", "maps_to"), ("icd10:B20", "who.va:VAs-01.01", "maps_to"), ("who.va:VAs-01.01", "who.va:VAs-01", "is_a")]
    q = spark.createDataFrame([("Q1", "d", "i1", "A", None), ("Q2", "d", None, "B", "C")], "who_2016 string, qdesc string, indic string, b_0100 string, b_0101 string").selectExpr("*", "'' sdesc", "'' ilab", "'' subst", "'' samb")
    n, e = kg.probbase(q)
    assert n.count() == 1 and rows(e, "end_id", F.coalesce("value", F.lit("-"))) == [("who.va:VAs-01", "A"), ("who.va:VAs-01.01", "-")]


def test_ontologies(spark):
    a = spark.createDataFrame([("OMIM:1", "Dis", "HP:1", "PCS"), ("OMIM:1", "Dis", "HP:1", "PCS"), ("ORPHA:2", "Dos", "HP:9", None)], "database_id string, disease_name string, hpo_id string, evidence string").selectExpr("*", "'' frequency", "'' onset", "'' qualifier", "'' sex", "'P' aspect", "'' modifier")
    n, e = kg.hpo(a, spark.createDataFrame([("HP:1", "Fever")], "id string, name string"))
    assert rows(n, "id", "label", F.coalesce("name", F.lit("-"))) == [("hp:1", "hp", "Fever"), ("hp:9", "hp", "-"), ("omim:1", "omim", "Dis"), ("orpha:2", "orpha", "Dos")] and e.count() == 2
    m = spark.createDataFrame([("MONDO:1", "A", ["skos:exactMatch OMIM:190685", "skos:exactMatch MESH:D1:x", "skos:broadMatch OMIM:2", "skos:exactMatch XX:1", "skos:exactMatch nocolon"]), ("HP:1", "B", [])], "id string, name string, property_value array<string>")
    n, e = kg.mondo(m)
    assert rows(n) == [("mondo:1", "mondo", "A")] and rows(e, "end_id") == [("mesh:D1:x",), ("omim:190685",)]
    terms = spark.createDataFrame([("D1", "dis"), ("D2", "both"), ("D005842", "places"), ("P1", "place"), ("X", "none"), ("D001419", "bacteria")], "id string, name string")
    isa = spark.createDataFrame([("D2", "D1"), ("D2", "D001419"), ("P1", "D005842"), ("D1", "X")], "child string, parent string")
    n, e = kg.mesh_hierarchy(terms, isa, spark.createDataFrame([("D1",), ("D2",)], "id string"))
    assert [r[0] for r in rows(n, "id")] == ["mesh:D001419", "mesh:D005842", "mesh:D1", "mesh:D2", "mesh:P1"] and rows(e, "start_id", "end_id") == [("mesh:P1", "mesh:D005842")]


def test_indicators_and_mortality(spark):
    cols = "`Country Name` string, `Series Code` string, `Series Name` string, `2019 [YR2019]` string, `2020 [YR2020]` string"
    dev = spark.createDataFrame([("Xland", "S1", "one", "..", "1.23456"), ("Nowhere", "S1", "one", "1", "2")], cols)
    health = spark.createDataFrame([("Xland", "S1", "dup", "9", "9"), ("Xland", "S2", "two", None, "..")], cols)
    mesh = spark.createDataFrame([(1, "mesh:old", "X Land"), (2, "mesh:G1", "X Land")], "row_no int, id string, name string")
    n, e = kg.wdi(dev, health, spark.createDataFrame([("Xland", "X Land")], "name string, mesh_name string"), mesh)
    assert rows(n) == [("wdi:S1", "wdi", "one"), ("wdi:S2", "wdi", "two")] and rows(e) == [("mesh:G1", "wdi:S1", "has_indicator", '{"2020":1.235}')]
    d = [(10, None, None, 2021, "103", "A00", 1, 5), (10, None, None, 2021, "104", "A000", 1, 3), (10, None, None, 2021, "104", "aaa", 1, 9), (10, "r", None, 2021, "104", "A001", 1, 9), (11, None, None, 2021, "101", "A00", 2, 1)]
    deaths = spark.createDataFrame(d, "Country int, Admin1 string, SubDiv string, Year int, List string, Cause string, Sex int, Deaths1 int")
    deaths = deaths.selectExpr("*", *[f"CAST({'NULL' if i == 3 else i} AS INT) AS Deaths{i}" for i in range(2, 27)])
    pop = spark.createDataFrame([(10, None, 2020, 1), (10, None, 2021, 9), (12, None, 2022, 2)], "Country int, Admin1 string, Year int, Sex int").selectExpr("*", "CAST(NULL AS INT) Lb", *[f"{i} AS Pop{i}" for i in range(1, 27)])
    n, e = kg.who_mortality(deaths, pop, spark.createDataFrame([("10", " Ten "), ("12", "Twelve")], "country string, name string"))
    assert rows(n, "id", "name") == [("who_mortality:10", "Ten"), ("who_mortality:12", "Twelve")]
    assert [p["sex"] for p in json.loads(n.where("id like '%:10'").first().population_data)] == ["unspecified"]
    r = e.collect()
    assert len(r) == 1 and (r[0].end_id, r[0].sex, r[0].deaths_total) == ("icd10:A00.0", "male", 3) and r[0].age_deaths.split(";")[:3] == ["2", "", "4"] and len(r[0].age_groups.split(";")) == 25


def test_build(spark):
    n = spark.createDataFrame([("A00", "category")], "code string, kind string")
    e = spark.createDataFrame([("A00", "A", None)], "source string, target string, kind string")
    emb = spark.createDataFrame([("A00", [1.0, 0.0])], "code string, embedding array<double>")
    nodes, edges = kg.build({"icd10": {"nodes": n, "edges": e, "embeddings": emb}, "acme": {"nodes": n, "edges": e}})
    assert rows(nodes, "source", "id") == [("acme", "icd10:A00"), ("icd10", "icd10:A00")] and rows(edges, "type") == [("related_to",)] * 2


def test_closure_takes_log_rounds_and_below_makes_only_what_it_returns(spark, monkeypatch):
    """A chain of 40 nodes, a cycle of 5 and a diamond; the tables stored are counted."""
    made = []
    keep = hierarchy.stored
    monkeypatch.setattr(hierarchy, "stored", lambda df, name: made.append((name, out := keep(df, name))) or out)
    chain = [(f"n{i:02}", f"n{i + 1:02}") for i in range(39)]
    pairs = [*chain, *[(f"r{i}", f"r{(i + 1) % 5}") for i in range(5)], ("d", "l"), ("d", "m"), ("l", "t"), ("m", "t"), ("d", "l"), (None, "t"), ("t", None)]
    edges = spark.createDataFrame(pairs, "c string, p string")
    want = {(f"n{i:02}", f"n{j:02}") for i in range(40) for j in range(i + 1, 40)} | {(f"r{i}", f"r{j}") for i in range(5) for j in range(5)} | {("d", "l"), ("d", "m"), ("d", "t"), ("l", "t"), ("m", "t")}
    got = rows(hierarchy.closure(edges, "c", "p"))
    assert len(got) == len(set(got)) and set(got) == want
    assert sum(name == "pairs" for name, _ in made) <= 7  # log2(39) rounds and one without new pairs
    with pytest.raises(ValueError):
        hierarchy.closure(edges, "c", "p", rounds=2)
    made.clear()
    assert rows(hierarchy.below(edges, ["n20", "t"], "c", "p")) == [("d",), ("l",), ("m",), *[(f"n{i:02}",) for i in range(21)], ("t",)]
    found = [df.count() for name, df in made if name == "found"]
    assert max(found) <= 25 and len(found) <= 25
    with pytest.raises(ValueError):
        hierarchy.below(edges, ["n39"], "c", "p", rounds=3)
    empty = spark.createDataFrame([], "c string, p string")
    assert rows(hierarchy.closure(empty, "c", "p")) == [] and rows(hierarchy.below(empty, ["a"], "c", "p")) == []


def test_import_accounts_for_every_row(spark):
    n = spark.createDataFrame(
        [("a", "s", "1", "1;2"), ("a", "t", "9", ""), ("b", "s", "x", None), ("c", "s", "", "1;y"), ("d", "s", None, ";3"), (None, "s", "2", None), (None, "s", "z", None), ("b", "t", "7", None), ("d", "s", None, ";3"), ("e:1", "u", " 5 ", "4")],
        "id string, source string, `weight:int` string, `codes:long[]` string",
    )
    e = spark.createDataFrame(
        [("a", "b", "s", "0.5"), ("a", "c", "s", "1"), ("c", "a", "s", "1"), (None, "a", "s", "1"), ("a", None, "s", "1"), ("a", "d", "s", "much"), ("e:1", "a", "t", ""), ("e:1", "a", "t", ""), ("c", "c", "s", "1")],
        "start_id string, end_id string, source string, `share:double` string",
    )
    nodes, edges, rejects, found = graph.checked_import(n, e)
    assert rows(nodes, "id", "source", "weight") == [("a", "s", 1), ("b", "t", 7), ("d", "s", None), ("e:1", "u", 5)]
    assert {r.id: r.codes for r in nodes.collect()} == {"a": [1, 2], "b": None, "d": [None, 3], "e:1": [4]}
    assert rows(edges, "start_id", "end_id", "share") == [("a", "b", 0.5), ("e:1", "a", None), ("e:1", "a", None)]
    got = sorted((r.kind, r.reason, r.start_id or "", r.end_id or "", r.source) for r in rejects.collect())
    assert got == sorted([
        ("node", "duplicate", "a", "", "t"), ("node", "duplicate", "d", "", "s"), ("node", "value", "b", "", "s"), ("node", "value", "c", "", "s"), ("node", "no id", "", "", "s"), ("node", "value", "", "", "s"),
        ("edge", "no end", "a", "c", "s"), ("edge", "no start", "c", "a", "s"), ("edge", "no start", "", "a", "s"), ("edge", "no end", "a", "", "s"), ("edge", "value", "a", "d", "s"), ("edge", "no start", "c", "c", "s"),
    ])
    assert found == {"value": 4, "no id": 1, "duplicate": 2, "no start": 3, "no end": 2}
    assert {json.loads(r.row)["share:double"] for r in rejects.where("kind = 'edge' and reason = 'value'").collect()} == {"much"}
    graph.checked_import(n, e, tolerance=12)
    with pytest.raises(graph.BadImportError, match="'no start': 3"):
        graph.checked_import(n, e, tolerance=11)
    last = graph.checked_import(n, e, [F.desc("source")])[0]
    assert rows(last, "id", "source")[0] == ("a", "t")
    none = graph.checked_import(n.limit(0), e.limit(0), tolerance=0)
    assert [df.count() for df in none[:3]] == [0, 0, 0] and set(none[3].values()) == {0}
    only = graph.checked_import(n.limit(0), e)[3]
    assert only["value"] == 1 and only["no start"] == 8


def test_an_id_of_very_many_rows_is_cut_down_before_the_shuffle(spark):
    n = spark.range(20_000).selectExpr("if(id % 3 = 0, 'hot', cast(id as string)) as id", "concat('s', id % 7) as source")
    e = spark.createDataFrame([], "start_id string, end_id string, source string")
    kept, _, rejects, found = graph.checked_import(n, e)
    assert kept.count() == 13_334 and found["duplicate"] == rejects.where("start_id = 'hot'").count() == 6666
    assert rows(kept.where("id = 'hot'"), "source") == [("s0",)]
    plan = graph.first_by_id(n, [F.col("source")])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.rindex("WindowGroupLimit") > plan.index("Exchange hashpartitioning")

"""The graph's sources: raw tables to (nodes, edges).

Each builder takes DataFrames as the readers return them and returns two DataFrames,
nodes (id, label, ...) and edges (start_id, end_id, type, ...), without duplicates.
``REGISTRY`` names them; ``build`` puts a source's name on its rows and unites all.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from causegraph.functions import text as t
from causegraph.operators import etl, hierarchy
from causegraph.operators.graph import union_all

Graph = tuple[DataFrame, DataFrame]

#: Cause lists in order of detail, the all-causes code, and age groups of format 00.
LIST_RANK = {"104": 0, "10M": 1, "103": 2}
ALL_CAUSES = "AAA"
AGE_GROUPS = [
    "0", "1", "2", "3", "4", "5-9", "10-14", "15-19", "20-24", "25-29", "30-34", "35-39", "40-44", "45-49", "50-54",
    "55-59", "60-64", "65-69", "70-74", "75-79", "80-84", "85-89", "90-94", "95+", "unknown",
]
#: Prefixes of exact matches and the namespaces they stand for.
MATCH_NAMESPACES = {"ICD10WHO": "icd10", "icd11.foundation": "icd11", "OMIM": "omim", "MESH": "mesh", "Orphanet": "orpha"}
EXACT_MATCH = "skos:exactMatch"


def _edges(df: DataFrame, start: Column, end: Column, kind: Column | str, *more: str | Column) -> DataFrame:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return df.select(start.alias("start_id"), end.alias("end_id"), kind.alias("type"), *more)


def code_graph(nodes: DataFrame, edges: DataFrame, namespace: str = "icd10", embeddings: DataFrame | None = None) -> Graph:
    """A graph of codes: nodes (code, kind, name) and edges (source, target, kind), as the
    ACME and ICD-10 tables are; embeddings (code, embedding) are optional."""
    name = F.col("name") if "name" in nodes.columns else F.lit(None).cast("string")
    n = nodes.select(t.curie(namespace, "code").alias("id"), F.lit(namespace).alias("label"), name.alias("name"), F.col("kind").alias("class_kind"), "code")
    if embeddings is not None:
        n = n.join(embeddings.select("code", "embedding"), "code", "left")
    e = _edges(edges, t.curie(namespace, "source"), t.curie(namespace, "target"), F.coalesce("kind", F.lit("related_to")))
    return n.distinct(), e.distinct()


def icd11(tabulation: DataFrame, mapping: DataFrame, most: int = 16) -> Graph:
    """tabulation: row_no, foundation_uri, code, title, class_kind, depth, is_residual, and chapter, if its chapters are to be
    worked on apart from each other; mapping: row_no, foundation_uri, icd10_code."""
    own = lambda: t.curie("icd11", t.last_segment("foundation_uri"))
    rows = tabulation.where(~F.col("is_residual")).withColumn("id", own())
    nodes = rows.select("id", F.lit("icd11").alias("label"), "code", t.tabulation_title("title").alias("name"), "class_kind")
    chapters = ["chapter"] if "chapter" in tabulation.columns else None
    up = hierarchy.depth_parent(rows, "id", "depth", "row_no", most, chapters).where("parent is not null")
    known = mapping.where("icd10_code <> 'No Mapping'").withColumn("id", own())
    known = etl.last_wins(known, "id", "icd10_code", "row_no")
    maps = rows.join(known, "id")
    edges = _edges(up, F.col("id"), F.col("parent"), "is_a").unionByName(_edges(maps, F.col("id"), t.curie("icd10", "icd10_code"), "maps_to"))
    return nodes.distinct(), edges.distinct()


def phmrc(causes: DataFrame) -> Graph:
    """causes: row_no, age_group, group, name, smart_va, icd10, comments. Two lymphoma codes share a row; sets are sorted."""
    both = F.col("smart_va") == "D91 (G96)"
    pair = F.when(both, F.array(F.struct(F.lit("D91").alias("code"), F.lit("Leukemia/Lymphomas").alias("name")), F.struct(F.lit("G96").alias("code"), F.lit("Lymphomas").alias("name"))))
    pair = pair.otherwise(F.array(F.struct(F.col("smart_va").alias("code"), t.without_parenthetical("name").alias("name"))))
    rows = causes.withColumn("_p", F.explode(pair)).select("row_no", F.col("_p.code").alias("code"), F.col("_p.name").alias("name"), "age_group", F.coalesce("group", F.lit("None")).alias("cod_group"), "comments", F.when(F.col("icd10") == "P23/J22", "P23").otherwise(F.col("icd10")).alias("icd10"))
    nodes = etl.joined_sets(rows, ["code"], ["age_group", "cod_group", "name", "comments"]).select(t.curie("phmrc", "code").alias("id"), F.lit("phmrc").alias("label"), "age_group", "cod_group", "name", "comments")
    first = etl.first_value(rows, ["code"], "icd10", "row_no")
    return nodes, _edges(first, t.curie("phmrc", "code"), t.curie("icd10", "icd10"), "maps_to")


def who_va(categories: DataFrame, codes: DataFrame) -> Graph:
    """categories: who_va_id, who_va_name, icd10_codes; codes: the ICD-10 codes that ranges expand to (column code)."""
    ident = t.curie("who.va", "who_va_id")
    nodes = categories.select(ident.alias("id"), F.col("who_va_name").alias("name"), F.lit("who.va").alias("label"))
    up = categories.where(t.parent_by_dot("who_va_id").isNotNull())
    ranges = hierarchy.code_ranges(categories.where(F.trim("icd10_codes") != ""), "icd10_codes")
    single = ranges.where("range_from = range_to").withColumn("code", F.col("range_from"))
    many = hierarchy.expand_ranges(ranges.where("range_from <> range_to"), codes.select("code"), "code")
    member = single.select("code", "who_va_id").unionByName(many.select("code", "who_va_id"))
    edges = _edges(up, ident, t.curie("who.va", t.parent_by_dot("who_va_id")), "is_a").unionByName(_edges(member, t.curie("icd10", "code"), ident, "maps_to"))
    return nodes.distinct(), edges.distinct()


def probbase(questions: DataFrame) -> Graph:
    """questions: who_2016, qdesc, indic, sdesc, ilab, subst, samb and a column ``b_...`` for each category."""
    kept = questions.na.drop(subset=["indic"]).withColumn("id", t.curie("who.va.q", "who_2016"))
    nodes = kept.select("id", F.col("qdesc").alias("name"), "indic", "sdesc", "ilab", "subst", "samb", F.lit("who.va.q").alias("label"))
    columns = [c for c in questions.columns if c.startswith("b_")]
    long = etl.long_form(kept, ["id"], columns)
    target = t.lookup({c: t.question_target(c) for c in columns}, "col")
    return nodes.distinct(), _edges(long, F.col("id"), target, "probbase_rel", "value").distinct()


def hpo(annotations: DataFrame, terms: DataFrame) -> Graph:
    """annotations: the phenotype table's columns; terms: id, name of the ontology."""
    rows = annotations.join(terms.select(F.col("id").alias("hpo_id"), F.col("name").alias("hpo_name")), "hpo_id", "left")
    kind = lambda c: F.lower(t.namespace(c))
    disease = rows.select(F.lower("database_id").alias("id"), kind("database_id").alias("label"), F.col("disease_name").alias("name"))
    phenotype = rows.select(F.lower("hpo_id").alias("id"), kind("hpo_id").alias("label"), F.col("hpo_name").alias("name"))
    edges = _edges(rows, F.lower("database_id"), F.lower("hpo_id"), "has_phenotype", "evidence", "frequency", "onset", "qualifier", "sex", "aspect", "modifier")
    return disease.unionByName(phenotype).distinct(), edges.distinct()


def mesh_hierarchy(terms: DataFrame, isa: DataFrame, disease: DataFrame, pathogen_roots: tuple[str, ...] = ("D001419", "D014780"), place_roots: tuple[str, ...] = ("D005842",)) -> Graph:
    """terms: id, name; isa: child, parent; disease: id. Kept are diseases and what is below the roots;
    an edge goes if its parent lacks a class of the child."""
    flag = lambda df, c, name: df.select(F.col(c).alias("id")).distinct().withColumn(name, F.lit(True))
    classes = terms
    for name, members in (("dis", flag(disease, "id", "dis")), ("pat", flag(hierarchy.below(isa, list(pathogen_roots), "child", "parent"), "node", "pat")), ("geo", flag(hierarchy.below(isa, list(place_roots), "child", "parent"), "node", "geo"))):
        classes = classes.join(members, "id", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    kept = classes.where("dis or pat or geo")
    nodes = kept.select(t.curie("mesh", "id").alias("id"), "name", F.lit("mesh").alias("label"))
    parents = classes.select(F.col("id").alias("parent"), *[F.col(c).alias(f"p_{c}") for c in ("dis", "pat", "geo")])
    pairs = kept.join(isa.withColumnRenamed("child", "id"), "id").join(parents, "parent", "left")
    fits = F.lit(True)
    for c in ("dis", "pat", "geo"):
        fits = fits & (~F.col(c) | F.coalesce(f"p_{c}", F.lit(False)))
    return nodes.distinct(), _edges(pairs.where(fits), t.curie("mesh", "id"), t.curie("mesh", "parent"), "isa").distinct()


def mondo(terms: DataFrame) -> Graph:
    """terms: id, name, property_value (array). Exact matches in known namespaces become edges."""
    own = terms.where(F.col("id").startswith("MONDO:"))
    nodes = own.select(F.lower("id").alias("id"), F.lit("mondo").alias("label"), "name")
    props = own.select("id", F.explode("property_value").alias("p"))
    relation, _, value = t.partition("p", " ")
    props = props.select("id", relation.alias("relation"), F.trim(value).alias("xref"))
    prefix, found, ident = t.partition("xref", ":")
    target = t.lookup(MATCH_NAMESPACES, prefix)
    kept = props.where((F.col("relation") == EXACT_MATCH) & found & target.isNotNull())
    return nodes.distinct(), _edges(kept, F.lower("id"), F.concat(target, F.lit(":"), ident), EXACT_MATCH).distinct()


def wdi(development: DataFrame, health: DataFrame, countries: DataFrame, mesh_nodes: DataFrame) -> Graph:
    """Indicator tables (Country Name, Series Code, Series Name, a column per year), a mapping of country names
    (name, mesh_name), and MeSH nodes (row_no, id, name). Empty and non-numeric years are left out."""
    rows = etl.union_unless_known(development, health, "Series Code")
    rows = etl.replace_by(rows, "Country Name", countries, "name", "mesh_name")
    ids = etl.last_wins(mesh_nodes, "name", "id", "row_no").withColumnsRenamed({"name": "_country", "id": "_country_id"})
    rows = rows.join(ids, F.col("Country Name") == F.col("_country"))
    nodes = rows.select(t.curie("wdi", F.col("Series Code")).alias("id"), F.lit("wdi").alias("label"), F.col("Series Name").alias("name"))
    years = rows.withColumn("_years", t.year_map(rows.columns)).where(F.size("_years") > 0)
    return nodes.distinct(), _edges(years, F.col("_country_id"), t.curie("wdi", F.col("Series Code")), "has_indicator", F.to_json("_years").alias("years_data"))


def who_mortality(deaths: DataFrame, population: DataFrame, countries: DataFrame, since: int = 2021) -> Graph:
    """deaths: Country, Admin1, SubDiv, Year, List, Cause, Sex, Deaths1 to Deaths26; population: Country, Admin1, Year,
    Sex, Pop1 to Pop26, Lb; countries: country, name."""
    national = deaths.where("Admin1 is null and SubDiv is null").withColumns({"List": F.trim(F.col("List").cast("string")), "Cause": F.trim(F.col("Cause").cast("string"))})
    detailed = national.where(F.col("List").isin(list(LIST_RANK)))
    best = etl.most_granular(detailed, ["Country", "Year"], t.lookup(LIST_RANK, "List")).where(F.upper("Cause") != ALL_CAUSES)
    pop = population.where((F.col("Admin1").isNull()) & (F.col("Year") >= since))
    entry = F.struct(F.col("Year").cast("int").alias("year"), t.sex_name("Sex").alias("sex"), t.int_or("Pop1").alias("population_total"), F.array(*[t.int_or(f"Pop{i}") for i in range(2, 27)]).alias("age_populations"), t.int_or("Lb").alias("live_births"))
    entries = pop.groupBy("Country").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    names = countries.select(F.col("country").cast("int").alias("Country"), F.trim("name").alias("name"))
    known = best.select(F.col("Country").cast("int")).union(pop.select(F.col("Country").cast("int"))).distinct()
    nodes = known.join(names, "Country", "left").join(entries, "Country", "left")
    nodes = nodes.select(t.curie("who_mortality", "Country").alias("id"), F.lit("who_mortality").alias("label"), F.coalesce("name", F.lit("")).alias("name"), F.coalesce(F.to_json("entries"), F.lit("")).alias("population_data"))
    ages = t.positional_join([t.int_or(f"Deaths{i}") for i in range(2, 27)])
    edges = _edges(
        best, t.curie("who_mortality", F.col("Country").cast("int")), t.curie("icd10", t.icd10_cause("Cause")), "has_mortality",
        F.col("Year").cast("int").alias("year"), t.sex_name("Sex").alias("sex"), t.int_or("Deaths1", 0).alias("deaths_total"), F.lit(";".join(AGE_GROUPS)).alias("age_groups"), ages.alias("age_deaths"),
    )
    return nodes, edges


#: Builders by source, in the order of precedence; each takes its inputs by name.
REGISTRY: dict[str, Callable[..., Graph]] = {
    "icd10": code_graph, "icd11": icd11, "phmrc": phmrc, "who_va": who_va, "acme": code_graph, "probbase": probbase,
    "hpo": hpo, "mesh_hierarchy": mesh_hierarchy, "mondo": mondo, "wdi": wdi, "who_mortality": who_mortality,
}


def build(inputs: dict[str, dict[str, DataFrame]]) -> Graph:
    """Nodes and edges of all given sources, each row with its source. A source may use another's nodes by taking them as input."""
    nodes, edges = [], []
    for name in REGISTRY:
        if name in inputs:
            n, e = REGISTRY[name](**inputs[name])
            nodes.append(n.withColumn("source", F.lit(name)))
            edges.append(e.withColumn("source", F.lit(name)))
    return union_all(nodes), union_all(edges)

"""Queries on the dictionary and on named entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from causegraph.catalog import query, table
from causegraph.functions import text as t
from causegraph.operators import dictionary, grounding

NORM = r"trim(regexp_replace(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"
#: Terms are the first words of the benchmark's texts, two or three, in four namespaces of which one isn't wanted.
TERMS_SQL = rf"""n AS (SELECT item_id, string_split({NORM.format("text")}, ' ') AS w FROM benchmark),
terms AS (SELECT DISTINCT array_to_string(w[1:2 + item_id % 2], ' ') AS norm, 2 + item_id % 2 AS n, ['MESH', 'DOID', 'HP', 'GO'][1 + item_id % 4] AS db, item_id::VARCHAR AS id FROM n WHERE len(w) >= 3 AND item_id % 4 <> 3),
d AS (SELECT doc_id, string_split({NORM.format("text")}, ' ') AS w, regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+') AS r FROM documents),
g AS (SELECT doc_id, i - 1 AS word, w[i] || ' ' || w[i + 1] AS two, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS three, r[i] || ' ' || r[i + 1] AS raw2, r[i] || ' ' || r[i + 1] || ' ' || r[i + 2] AS raw3
      FROM (SELECT doc_id, w, r, unnest(range(1, len(w) + 1)) AS i FROM d)),
m AS (SELECT doc_id, word, n, db, id, norm, raw2 AS raw FROM g JOIN terms ON terms.norm = g.two AND n = 2 UNION ALL SELECT doc_id, word, n, db, id, norm, raw3 FROM g JOIN terms ON terms.norm = g.three AND n = 3),
c AS (SELECT doc_id, word, n, db, id, (CASE id::INT % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.9 ELSE 0.8 END * CASE WHEN raw = norm THEN 1.0 WHEN lower(raw[1]) || raw[2:] = norm THEN 0.9 ELSE 0.75 END)::DOUBLE AS score FROM m)"""


def terms(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("item_id")
    b = table(spark, sf, "benchmark").select(i, t.tokens(t.scoring_text("text")).alias("w")).where(F.size("w") >= 3)
    db = F.get(F.array(*map(F.lit, ["MESH", "DOID", "HP", "GO"])), (i % 4).cast("int"))
    rows = b.select(F.array_join(F.slice("w", F.lit(1), (2 + i % 2).cast("int")), " ").alias("text"), db.alias("db"), i.cast("string").alias("id"), F.lit("term").alias("name"), F.get(F.array(*map(F.lit, ["name", "synonym", "former"])), (i % 3).cast("int")).alias("status"))
    return dictionary.term_table(rows)


@query("gnd_dictionary", f"WITH {TERMS_SQL} SELECT doc_id, word::INT AS word, n::INT AS n_words, db, id, round(score, 6) AS score FROM c")
def gnd_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    """All places of the terms of three namespaces in whole documents, with scores by kind and case."""
    found = dictionary.candidates(table(spark, sf, "documents"), terms(spark, sf), "doc_id")
    return found.select("doc_id", "word", "n_words", "db", "id", F.round("score", 6).alias("score"))


@query(
    "gnd_dictionary_best",
    f"""WITH RECURSIVE {TERMS_SQL}, l AS (SELECT doc_id, word, max(n) AS n FROM c GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY word) AS k FROM l),
s AS (SELECT doc_id, k, word, n, true AS taken, word + n AS upto FROM o WHERE k = 1
  UNION ALL SELECT o.doc_id, o.k, o.word, o.n, o.word >= s.upto, CASE WHEN o.word >= s.upto THEN o.word + o.n ELSE s.upto END FROM s JOIN o ON o.doc_id = s.doc_id AND o.k = s.k + 1)
SELECT doc_id, word::INT AS word, n::INT AS n_words, db || ':' || id AS curie, round(score, 6) AS score FROM s JOIN c USING (doc_id, word, n) WHERE taken
QUALIFY row_number() OVER (PARTITION BY doc_id, word ORDER BY round(score, 6) DESC, db, id) = 1""",
)
def gnd_dictionary_best(spark: SparkSession, sf: str) -> DataFrame:
    """The longest terms from the left, the best one for each place."""
    found = dictionary.best(dictionary.ground(table(spark, sf, "documents"), terms(spark, sf), "doc_id"), "doc_id")
    return found.select("doc_id", "word", "n_words", F.concat_ws(":", "db", "id").alias("curie"), F.round("score", 6).alias("score"))


LEXICON = {"the": "Disease", "of": "Chemical", "this": "Disease"}


@query(
    "gnd_entities",
    r"""WITH s AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS s, generate_subscripts(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), 1) AS k FROM documents),
b AS (SELECT * FROM s WHERE trim(regexp_replace(s, '\s+', ' ', 'g')) <> ''),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS sentence, len(regexp_extract_all(s, '(?i)\b(the|this)\b')) AS n, regexp_extract(s, '(?is)^(.*?)\b(the|this)\b', 1) AS before, regexp_extract(s, '(?i)\b(the|this)\b') AS entity FROM b)
SELECT doc_id, sentence::INT AS sentence, n, length(before)::INT AS start, entity FROM n WHERE n > 0""",
)
def gnd_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Per sentence the number of entities of the wanted label and the first one with its place in the sentence."""
    found = dictionary.entities(table(spark, sf, "documents"), dictionary.lexicon_tagger(LEXICON), "doc_id")
    first = F.min(F.struct("start", "entity"))
    return found.groupBy("doc_id", "sentence").agg(F.count(F.lit(1)).alias("n"), first.alias("f")).select("doc_id", "sentence", "n", "f.start", "f.entity")


@query("gnd_chunk_ids", "WITH h AS (SELECT conv_id, turn, md5(conv_id || chr(31) || turn) AS h FROM conversations) SELECT conv_id, turn, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21) AS chunk_id FROM h")
def gnd_chunk_ids(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", t.stable_id("conv_id", "turn").alias("chunk_id"))


@query(
    "gnd_annotate",
    """WITH f AS (SELECT conv_id, turn, strpos(text, 'the') - 1 AS s, strpos(text, 'of') - 1 AS o FROM conversations),
u AS (SELECT conv_id, turn, 'the' AS concept, s AS start FROM f WHERE s >= 0 UNION ALL SELECT conv_id, turn, 'of', o FROM f WHERE o >= 0)
SELECT conv_id * 100000 + turn AS id, concept, start::INT AS start, (start + length(concept))::INT AS "end", 'icd:' || length(concept) AS best FROM u""",
)
def gnd_annotate(spark: SparkSession, sf: str) -> DataFrame:
    """Concepts of an extractor on whole turns, the best match of each from an index of two, and where they stand."""
    lower = table(spark, sf, "conversations").select((F.col("conv_id") * 100_000 + F.col("turn")).alias("id"), "text")
    index = spark.createDataFrame([("icd:2", "two", [1.0, 0.0]), ("icd:3", "three", [0.0, 1.0])], "id string, name string, vector array<double>")

    def client(text: str) -> list[dict]:
        return [{"concept": w, "supporting_evidence": [w], "start": a, "end": a + len(w)} for w in ("the", "of") if (a := text.find(w)) >= 0]

    encode = lambda x: [1.0, 0.0] if x.startswith("of") else [0.0, 1.0]
    found = grounding.ground(lower, "id", index, client, encode)
    best = grounding.first_matches(found, "id").select("id", "concept", F.col("match.id").alias("best"))
    spans = grounding.annotate(found, "id", "concept").select("id", F.col("text").alias("concept"), "start", "end")
    return spans.join(best, ["id", "concept"]).select("id", "concept", "start", "end", "best")


@query(
    "gnd_node_vectors",
    """WITH v AS (SELECT p_partkey, [len(list_distinct(string_split(lower(p_name), ' '))), length(p_name), length(p_name) - length(replace(lower(p_name), 'e', ''))]::DOUBLE[] AS v FROM part)
SELECT 'part:' || p_partkey AS id, len(v)::INT AS dim, round(v[1] / sqrt(list_inner_product(v, v)), 6) AS words, round(v[2] / sqrt(list_inner_product(v, v)), 6) AS letters, round(v[3] / sqrt(list_inner_product(v, v)), 6) AS es FROM v""",
)
def gnd_node_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of nodes' names by an injected encoder (distinct words, characters, and how often e stands), as an index holds them."""
    nodes = table(spark, sf, "part").select(t.curie("part", "p_partkey").alias("id"), F.lit("part").alias("label"), F.col("p_name").alias("name"))
    held = grounding.embed(nodes, "name", lambda x: [float(len(set(x.lower().split(" ")))), float(len(x)), float(x.lower().count("e"))])
    dim = grounding.vector_dimension(held, "part")
    index = grounding.vector_index(held, "part")
    component = lambda i: F.round(F.col("vector")[i], 6)
    return index.select("id", F.lit(dim).alias("dim"), component(0).alias("words"), component(1).alias("letters"), component(2).alias("es"))

"""Queries on evaluation metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from causegraph.catalog import query, table
from causegraph.functions import text as t
from causegraph.operators import evaluate
from causegraph.plans.grounding_queries import TOP_SQL, neighbours


@query(
    "eval_normalise",
    r"""WITH n AS (SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g')) AS norm FROM documents)
SELECT doc_id, md5(norm) AS norm, CASE WHEN norm = '' THEN 0 ELSE len(string_split(norm, ' ')) END::BIGINT AS n_words FROM n""",
)
def eval_normalise(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", t.scoring_text("text").alias("norm"))
    return d.select("doc_id", F.md5(F.col("norm").cast("binary")).alias("norm"), F.size(t.tokens("norm")).cast("long").alias("n_words"))


def heard(spark: SparkSession, sf: str) -> DataFrame:
    """Whole turns as references and what a poor recogniser hears: some letters change, the beginning is lost or a word is added."""
    c = table(spark, sf, "conversations")
    ref = F.regexp_replace(F.lower("text"), "[^a-z0-9 ]", "")
    lost = F.when(F.col("turn") % 3 == 1, F.substr(ref, F.lit(7))).otherwise(F.concat(ref, F.lit(" uh")))
    hyp = F.when(F.col("turn") % 3 == 0, F.regexp_replace(ref, "th", "d")).otherwise(lost)
    return c.select("conv_id", "turn", ref.alias("ref"), hyp.alias("hyp"))


HEARD_SQL = r"""r AS (SELECT conv_id, turn, regexp_replace(lower(text), '[^a-z0-9 ]', '', 'g') AS ref FROM conversations),
h AS (SELECT *, CASE turn % 3 WHEN 0 THEN replace(ref, 'th', 'd') WHEN 1 THEN substr(ref, 7) ELSE ref || ' uh' END AS hyp FROM r),
c AS (SELECT conv_id, turn, trim(regexp_replace(ref, '\s+', ' ', 'g')) AS a, trim(regexp_replace(hyp, '\s+', ' ', 'g')) AS b FROM h),
k AS (SELECT *, replace(a, ' ', '') AS x, replace(b, ' ', '') AS y FROM c)"""


@query(
    "eval_cer",
    f"""WITH {HEARD_SQL}
SELECT conv_id, turn, levenshtein(x, y)::BIGINT AS edits, length(x)::BIGINT AS ref_len, CASE WHEN length(x) > 0 THEN round(levenshtein(x, y)::DOUBLE / length(x), 9) END AS cer FROM k""",
)
def eval_cer(spark: SparkSession, sf: str) -> DataFrame:
    e = evaluate.word_errors(heard(spark, sf), "ref", "hyp")
    return e.select("conv_id", "turn", F.col("char_edits").alias("edits"), F.col("char_len").alias("ref_len"), F.round("cer", 9).alias("cer"))


#: Rows of the table of edit costs, one for each reference word, then the walk back through it: a match where words are
#: equal, else a substitution, an insertion, a deletion, in this order, if it explains the cost.
WER_SQL = f"""WITH RECURSIVE {HEARD_SQL},
w AS (SELECT conv_id || '.' || turn AS id, x, y, list_filter(string_split(a, ' '), lambda t: t <> '') AS r, list_filter(string_split(b, ' '), lambda t: t <> '') AS q FROM k),
cost(id, i, c) AS (SELECT id, 0::BIGINT, range(len(q) + 1) FROM w
  UNION ALL SELECT id, i, list_transform(range(1, len(u) + 1), lambda j: j + list_min(u[1:j])) FROM (
    SELECT cost.id AS id, i + 1 AS i, list_transform(list_prepend(i + 1, list_transform(range(1, len(q) + 1), lambda j: least(c[j + 1] + 1, c[j] + (r[i + 1] <> q[j])::BIGINT))), lambda v, j: v - j) AS u
    FROM cost JOIN w ON w.id = cost.id WHERE i < len(r))),
walk(id, i, j, s, d, ins) AS (SELECT id, len(r), len(q), 0::BIGINT, 0::BIGINT, 0::BIGINT FROM w
  UNION ALL SELECT id, CASE WHEN step = 'i' THEN i ELSE i - 1 END, CASE WHEN step = 'd' THEN j ELSE j - 1 END, s + (step = 's')::BIGINT, d + (step = 'd')::BIGINT, ins + (step = 'i')::BIGINT FROM (
    SELECT walk.*, CASE WHEN r[walk.i] = q[j] THEN 'm' WHEN here.c[j + 1] = up.c[j] + 1 THEN 's' WHEN here.c[j + 1] = here.c[j] + 1 THEN 'i' ELSE 'd' END AS step
    FROM walk JOIN w ON w.id = walk.id JOIN cost here ON here.id = walk.id AND here.i = walk.i JOIN cost up ON up.id = walk.id AND up.i = walk.i - 1 WHERE walk.i > 0 AND j > 0)),
e AS (SELECT w.id AS id, walk.s AS s, walk.d + walk.i AS d, walk.ins + walk.j AS i, len(r) AS n, levenshtein(x, y)::BIGINT AS edits, length(x) AS chars
  FROM w JOIN walk ON walk.id = w.id WHERE walk.i = 0 OR walk.j = 0),
t AS (SELECT * FROM e UNION ALL SELECT '__AGGREGATE__', sum(s), sum(d), sum(i), sum(n), sum(edits), sum(chars) FROM e)
SELECT id, s::BIGINT AS s, d::BIGINT AS d, i::BIGINT AS i, n::BIGINT AS n, CASE WHEN n > 0 THEN (s + d + i)::DOUBLE / n::DOUBLE END AS wer, CASE WHEN chars > 0 THEN edits::DOUBLE / chars::DOUBLE END AS cer FROM t"""


@query("eval_wer_sdi", WER_SQL)
def eval_wer_sdi(spark: SparkSession, sf: str) -> DataFrame:
    e = evaluate.word_errors(heard(spark, sf), "ref", "hyp").withColumn("id", F.concat_ws(".", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    total = evaluate.corpus_errors(e)
    return evaluate.with_total(e.select("id", "s", "d", "i", "n", "wer", "cer"), total.select("s", "d", "i", "n", "wer", "cer"), "id")


def code_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Per query vector: codes of its neighbours up to rank 5 and of those from rank 3 on, as ``<label>.<id mod 3>``."""
    near = neighbours(spark, sf).join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("c"), "label"), "c")
    code = F.concat(F.col("label").cast("string"), F.lit("."), (F.col("c") % 3).cast("string"))
    pick = lambda cond: F.collect_set(F.when(cond, code))
    return near.groupBy("q").agg(pick(F.col("rank") <= 5).alias("ref"), pick((F.col("rank") > 2) & (F.col("q") % 300 != 0)).alias("pred"))


METRICS_SQL = f"""{TOP_SQL},
s AS (SELECT q, coalesce(list(DISTINCT label || '.' || (c % 3)) FILTER (rank <= 5), []) AS r, coalesce(list(DISTINCT label || '.' || (c % 3)) FILTER (rank > 2 AND q % 300 <> 0), []) AS p FROM t GROUP BY q),
l AS (SELECT q, 'strict' AS level, r, p FROM s UNION ALL SELECT q, 'parent', list_distinct(list_transform(r, lambda x: split_part(x, '.', 1))), list_distinct(list_transform(p, lambda x: split_part(x, '.', 1))) FROM s),
n AS (SELECT q, level, len(r) AS nr, len(p) AS np, len(list_intersect(r, p)) AS b FROM l),
m AS (SELECT q, level, CASE WHEN nr = 0 AND np = 0 THEN 1.0::DOUBLE WHEN nr = 0 OR np = 0 THEN 0.0 ELSE b::DOUBLE / np END AS precision,
  CASE WHEN nr = 0 AND np = 0 THEN 1.0::DOUBLE WHEN nr = 0 OR np = 0 THEN 0.0 ELSE b::DOUBLE / nr END AS recall,
  CASE WHEN nr = 0 AND np = 0 THEN 1.0::DOUBLE WHEN b = 0 THEN 0.0 ELSE 2 * (b::DOUBLE / np) * (b::DOUBLE / nr) / (b::DOUBLE / np + b::DOUBLE / nr) END AS f1,
  CASE WHEN nr = 0 AND np = 0 THEN 1.0::DOUBLE WHEN nr = 0 OR np = 0 THEN 0.0 ELSE b::DOUBLE / (nr + np - b) END AS jaccard FROM n)"""


@query("eval_code_metrics", f"{METRICS_SQL} SELECT q, level, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, round(jaccard, 9) AS jaccard FROM m")
def eval_code_metrics(spark: SparkSession, sf: str) -> DataFrame:
    m = evaluate.code_metrics(code_sets(spark, sf), "q")
    return m.select("q", "level", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "jaccard")])


@query(
    "eval_aggregate",
    f"""{METRICS_SQL}, long AS (SELECT level, unnest(['precision', 'recall', 'f1', 'jaccard']) AS metric, unnest([precision, recall, f1, jaccard]) AS value FROM m)
SELECT level, metric, count(*) AS n, round(avg(value), 9) AS mean, round(min(value), 9) AS min, round(max(value), 9) AS max FROM long GROUP BY ALL""",
)
def eval_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    s = evaluate.summary(evaluate.code_metrics(code_sets(spark, sf), "q"))
    return s.select("level", "metric", "n", *[F.round(c, 9).alias(c) for c in ("mean", "min", "max")])


TYPES = ["click", "error", "purchase", "signup", "view"]


@query(
    "eval_pivot",
    "SELECT (user_id % 5)::BIGINT AS bucket, " + ", ".join(f"round(avg(value) FILTER (event_type = '{x}'), 6) AS \"{x}\"" for x in TYPES) + " FROM events GROUP BY user_id % 5",
)
def eval_pivot(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("bucket", (F.col("user_id") % 5).cast("long"))
    return evaluate.mean_pivot(e, "bucket", "event_type", TYPES, "value", [3, 1, 4, 0, 2], 6)

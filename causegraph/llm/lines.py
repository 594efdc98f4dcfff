"""Operator 2: removal of repeated three-line windows.

Lines that aren't blank are numbered within their document, and every three in a row
form a window, named by a 128-bit hash of its trimmed lines (two lines or one, if the
document has no more, form one too, so a short copy is found like a long one).  A
window's first occurrence by (doc_id, position) stays; all later ones, in other
documents or further down in the same one, mark the lines they cover.  Marks of a
document are merged and its text is rebuilt from the other lines, blank ones included.

The table of windows, about a tenth of the text, is made once and stored.  Common
windows are counted with map-side combine and stored with their first occurrence, so the
join that finds the later ones is one of two tables, whose skewed partitions Spark splits.  Texts move once, in the last join.

Null texts stay null, empty ones empty.  A document that is repeated with its doc_id
counts as one.  Documents whose lines all repeat earlier ones end up empty.  Rows with a
null doc_id have no place in the order: they stay as they are and take no lines from others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from causegraph.llm.common import documents, fresh
from causegraph.storage import stored

WINDOW = 3
_SPACES = " \t\n\x0b\f\r"
_WORD = r"[^\x20\x09-\x0D]"


def windows(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, pos, a, b): a window's number within its document, and its hash."""
    trimmed = F.transform(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: x.rlike(_WORD)), lambda x: F.btrim(x, F.lit(_SPACES)))
    lines = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), trimmed.alias("lines"))
    hashed = lines.select("key", F.transform("lines", lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(2), x).alias("b"))).alias("h"))

    def of(i: Column, field: str) -> Column:
        return F.xxhash64(*[F.get("h", i + k)[field] for k in range(WINDOW)])

    n = F.greatest(F.size("h") - (WINDOW - 1), F.least(F.size("h"), F.lit(1)))
    each = F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)), lambda i: F.struct(i.alias("pos"), of(i, "a").alias("a"), of(i, "b").alias("b")))
    return hashed.select("key", F.inline(each))


def repeated(found: DataFrame) -> DataFrame:
    """Windows (key, pos) that occur earlier."""
    first = found.groupBy("a", "b").agg(F.min(F.struct("key", "pos")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("a", "b", "first")
    return found.join(stored(first, "first"), ["a", "b"]).where(F.struct("key", "pos") > F.col("first")).select("key", "pos")


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows and columns, with the text rebuilt and n_lines, n_removed (lines that aren't blank) added."""
    df = df.drop("n_lines", "n_removed")
    own, begin, lines, at, gone = fresh(df, "own", "begin", "lines", "at", "gone")
    later = repeated(stored(windows(df, key, text), "windows"))
    covered = later.groupBy("key").agg(F.collect_set("pos").alias(begin)).withColumnRenamed("key", own)
    joined = df.join(covered, F.col(key) == F.col(own), "left").withColumn(lines, F.split(text, "\n"))
    number = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(_WORD), i)), lambda i: i.isNotNull())
    joined = joined.withColumn(at, number)
    marks = F.flatten(F.transform(begin, lambda p: F.filter(F.array(*[F.get(at, p + k) for k in range(WINDOW)]), lambda i: i.isNotNull())))
    joined = joined.withColumn(gone, F.coalesce(F.array_distinct(marks), F.array().cast("array<int>")))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone), lambda i: F.get(lines, i))
    rebuilt = F.when(F.size(gone) > 0, F.array_join(kept, "\n")).otherwise(F.col(text))
    out = joined.withColumns({text: rebuilt, "n_lines": F.coalesce(F.size(at), F.lit(0)).cast("long"), "n_removed": F.size(gone).cast("long")})
    return out.drop(own, begin, lines, at, gone)


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir, "doc_id", "text"))


ORACLE = r"""
WITH l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ord FROM documents),
b AS (SELECT doc_id, ord, trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS t,
             row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS pos, count(*) OVER (PARTITION BY doc_id) AS n
      FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
w AS (SELECT doc_id, pos, n, t AS x, lead(t) OVER d AS y, lead(t, 2) OVER d AS z FROM b WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
later AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY x, y, z ORDER BY doc_id, pos) AS k FROM w WHERE pos <= greatest(n - 2, 1)) WHERE k > 1),
gone AS (SELECT DISTINCT b.doc_id, b.ord FROM b JOIN later USING (doc_id) WHERE b.pos BETWEEN later.pos AND later.pos + 2),
kept AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.ord) AS text FROM l ANTI JOIN gone USING (doc_id, ord) GROUP BY l.doc_id),
m AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id), c AS (SELECT doc_id, count(*) AS n FROM b GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN m.n IS NULL THEN d.text ELSE coalesce(kept.text, '') END AS text, coalesce(c.n, 0)::BIGINT AS n_lines, coalesce(m.n, 0)::BIGINT AS n_removed
FROM documents d LEFT JOIN kept USING (doc_id) LEFT JOIN m USING (doc_id) LEFT JOIN c USING (doc_id)"""

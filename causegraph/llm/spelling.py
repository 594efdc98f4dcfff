"""Operator 12: spelling variants of words, grouped by a symmetric-delete join.

Words are counted with map-side combine, so what is shuffled is the vocabulary of each
task and not the text.  Every word of the result emits itself and its distinct single
deletions as keys; two words that differ by one inserted, deleted or replaced code point
share one of them.  Words that share a key meet in an equi-join and are verified by
their exact distance, since a swap of neighbours shares a key too.  A key belongs to no
more words than one insertion can make of it, which the alphabet bounds, so no key is
hot however large the corpus is.  Each word's form is the commonest word near it, if
that is far commoner; roots come from joining the forms with themselves until no root
moves, and as forms grow by a factor at each step, a few rounds do.

Null texts have no words, an empty table gives an empty result, a null doc_id counts as
empty.  Equal rows count once each; columns of other names play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from causegraph.llm.common import documents
from causegraph.storage import stored

#: Letters, and which of them are folded.
LETTERS = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH, LEAST_COUNT, FACTOR = 6, 5, 5
#: Of this many runs one loses a code point, so that there are variants to be found.
ODDITY = 199


def folded(run: Column) -> Column:
    """A to Z in lower case. Most runs stay as they are in lower case throughout, which costs less to see."""
    return F.when(F.lower(run) == run, run).otherwise(F.translate(run, UPPER, LOWER))


def runs(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST_LENGTH) -> DataFrame:
    """(key, run): every maximal run of letters of at least so many code points, with its A to Z in lower case."""
    found = F.filter(F.regexp_extract_all(F.col(text), F.lit(LETTERS), F.lit(0)), lambda x: F.char_length(x) >= least)
    each = df.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.explode(found).alias("run"))
    return each.select("key", folded(F.col("run")).alias("run"))


def without(word: Column, at: Column) -> Column:
    """A word without its code point at a place counted from 0."""
    return F.concat(F.substr(word, F.lit(1), at), F.substr(word, at + 2))


def misspelt(each: DataFrame, one_in: int = ODDITY) -> DataFrame:
    """(word): runs of which one in so many lacks a code point, by a hash of key and run."""
    h = each.select("run", F.crc32(F.concat_ws(":", "key", "run").cast("binary")).alias("h"))
    at = F.pmod("h", F.char_length("run").cast("long")).cast("int")
    return h.select(F.when(F.pmod("h", F.lit(one_in)) == 0, without(F.col("run"), at)).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words that are long and frequent enough."""
    return words.where(F.char_length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def near(words: DataFrame) -> DataFrame:
    """(a, b), a before b, once each: words (word) that differ by exactly one inserted, deleted or replaced code point."""
    places = F.sequence(F.lit(0), F.char_length("word") - 1)
    deletions = F.transform(places, lambda i: without(F.col("word"), i))
    keyed = stored(words.select("word", F.explode(F.array_distinct(F.concat(F.array("word"), deletions))).alias("key")), "deletions")
    pairs = keyed.withColumnRenamed("word", "a").join(keyed.withColumnRenamed("word", "b"), "key").where("a < b").select("a", "b").distinct()
    return pairs.where(F.levenshtein("a", "b") == 1)


def forms(words: DataFrame, pairs: DataFrame, factor: int = FACTOR) -> DataFrame:
    """words (word, n) with form, n_near and form_n: the most frequent near word, of equals the first in code-point order, if it
    is so many times as frequent; null otherwise."""
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counted = both.join(words.select(F.col("word").alias("b"), F.col("n").alias("m")), "b")
    best = counted.groupBy("a").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "b")).alias("best"))
    out = words.join(best.withColumnRenamed("a", "word"), "word", "left")
    far = -F.col("best.m") >= factor * F.col("n")
    return out.select("word", F.when(far, F.col("best.b")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(far, -F.col("best.m")).alias("form_n"))


def rooted(found: DataFrame) -> DataFrame:
    """Adds ``root``: the last word that following the forms leads to. Each round doubles the steps that are known."""
    at = stored(found.withColumn("root", F.coalesce("form", "word")), "forms")
    while True:
        step = at.where("form is not null").select(F.col("word").alias("of"), F.col("root").alias("further"))
        new = stored(at.join(step, F.col("root") == F.col("of"), "left").withColumn("moved", F.col("of").isNotNull()).withColumn("root", F.coalesce("further", "root")).drop("of", "further"), "roots")
        at = new.drop("moved")
        if new.where("moved").isEmpty():
            return at


def group_variants(words: DataFrame) -> DataFrame:
    """words (word, n) to (word, form, root, n, n_near, form_n)."""
    words = stored(words, "words")
    return rooted(forms(words, near(words.select("word")))).select("word", "form", "root", "n", "n_near", "form_n")


def op12_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return group_variants(vocabulary(misspelt(runs(documents(spark, sf_dir, "doc_id", "text")))))


#: The sum of crc32 over a run's bytes from a table made by rule; near words by the places at which they can differ.
ORACLE = r"""
WITH RECURSIVE poly AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b::BIGINT)) AS t),
r AS (SELECT doc_id::VARCHAR AS d, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS k
      FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) WHERE length(run) >= 6 GROUP BY ALL),
x AS (SELECT d, run, k, hex(encode(coalesce(d, '') || ':' || run)) AS hx FROM r),
h AS (SELECT run, k, xor(list_reduce(range(1, length(hx), 2), lambda c, i: xor(c >> 8, t[1 + xor(c & 255, ('0x' || hx[i:i + 1])::BIGINT)]), 4294967295::BIGINT), 4294967295) AS h FROM x, poly),
w AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, k FROM h),
v AS (SELECT word, sum(k)::BIGINT AS n FROM w WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
p AS (SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS z FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
q AS (SELECT DISTINCT word AS long, a || z AS short FROM p),
e AS (SELECT x.word AS a, y.word AS b FROM p x JOIN p y ON x.i = y.i AND x.a = y.a AND x.z = y.z AND x.word <> y.word
      UNION SELECT q.long, v.word FROM q JOIN v ON v.word = q.short UNION SELECT v.word, q.long FROM q JOIN v ON v.word = q.short),
f AS (SELECT e.a AS word, e.b, v.n AS m, count(*) OVER (PARTITION BY e.a) AS n_near, row_number() OVER (PARTITION BY e.a ORDER BY v.n DESC, e.b) AS k FROM e JOIN v ON v.word = e.b),
g AS (SELECT v.word, v.n, coalesce(f.n_near, 0) AS n_near, CASE WHEN f.m >= 5 * v.n THEN f.b END AS form, CASE WHEN f.m >= 5 * v.n THEN f.m END AS form_n FROM v LEFT JOIN f ON f.word = v.word AND f.k = 1),
t AS (SELECT word, word AS root, form AS next FROM g UNION ALL SELECT t.word, t.next, g.form FROM t JOIN g ON g.word = t.next)
SELECT g.word, g.form, t.root, g.n, g.n_near, g.form_n FROM g JOIN t ON t.word = g.word AND t.next IS NULL"""

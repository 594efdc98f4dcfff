"""A similarity join of short texts by Ratcliff and Obershelp's ratio.

The ratio of two texts is at most twice the number of letters that both have, counted with
repetition, by the sum of their lengths.  Written as a set of numbered letters (the first
a, the second a, ...) that is an overlap of two sets, so two texts that are similar enough
share one of the first few numbered letters of each in an order common to all: as many as may be
missed and one more.  Texts meet by an equi-join on these, rarest first; lengths and whole
overlaps, all of them built-in functions, decide which pairs are compared exactly.  Nothing
above the cut-off is lost, and no text is compared with all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from causegraph.functions import edit, text as t

_SLACK = 1e-9


def numbered_letters(c: Column) -> Column:
    """array of struct<rare, h, letter>, in the common order: higher numbers first, which fewer texts have, then by a hash."""

    def of(s: Column) -> Column:
        number = lambda x, i: (i - F.array_position(s, x)).cast("int") + 2  # noqa: E731  the first is at 1, i counts from 0
        return F.transform(s, lambda x, i: F.struct((-number(x, i)).alias("rare"), F.xxhash64(x).alias("h"), F.concat(x, number(x, i).cast("string")).alias("letter")))

    return F.array_sort(t.let(F.array_sort(F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0))), of))


def _keyed(df: DataFrame, column: str, cutoff: float) -> DataFrame:
    """(column, n, letters, key): a row for each numbered letter of the prefix."""
    n = F.char_length(column)
    rows = df.select(column, n.alias("n"), numbered_letters(F.col(column)).alias("s"))
    shortest = F.ceil(F.col("n") * (cutoff / (2 - cutoff)) - _SLACK)  # of a text that is similar enough
    shared = F.ceil((F.col("n") + shortest) * (cutoff / 2) - _SLACK)  # with that one at least
    prefix = F.slice("s", F.lit(1), F.greatest(F.lit(1), (F.col("n") - shared + 1).cast("int")))
    letters = lambda s: F.transform(s, lambda x: x["letter"])
    return rows.select(column, "n", letters(F.col("s")).alias("letters"), F.explode(letters(prefix)).alias("key"))


def similar(names: DataFrame, labels: DataFrame, cutoff: float) -> DataFrame:
    """(name, label, ratio) of distinct names (name) and labels (label) whose ratio is at least the cut-off, which is above 0.

    Empty and null texts are similar to nothing. Names longer than any label allows go first.
    """
    if not 0 < cutoff <= 1:
        raise ValueError("the cut-off lies above 0 and is 1 at most")
    b = labels.where("label <> ''").select("label").distinct()
    longest = b.agg(F.max(F.char_length("label"))).first()[0] or 0
    a = names.where((F.col("name") != "") & (F.char_length("name") <= longest * (2 - cutoff) / cutoff + _SLACK)).select("name").distinct()
    right = _keyed(b, "label", cutoff).withColumnsRenamed({"n": "m", "letters": "others"})
    pairs = _keyed(a, "name", cutoff).join(right, "key")
    least = (F.col("n") + F.col("m")) * (cutoff / 2) - _SLACK
    pairs = pairs.where((F.least("n", "m") >= least) & (F.size(F.array_intersect("letters", "others")) >= least)).select("name", "label").distinct()
    return pairs.withColumn("ratio", edit.string_ratio(F.col("label"), F.col("name"))).where(F.col("ratio") >= cutoff)


def closest(names: DataFrame, labels: DataFrame, cutoff: float) -> DataFrame:
    """(name, label, ratio): the label most like each name, of equals the greatest; names without one are left out."""
    best = similar(names, labels, cutoff).groupBy("name").agg(F.max(F.struct("ratio", "label")).alias("b"))
    return best.select("name", "b.label", "b.ratio")

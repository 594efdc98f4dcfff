"""Metrics of transcripts and of code sets, their aggregates and pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from causegraph.functions import text as t
from causegraph.functions.edit import char_distance, word_alignment


def word_errors(df: DataFrame, ref: str, hyp: str) -> DataFrame:
    """Adds s, d, i, n, wer, accuracy, char_edits, char_len, cer of two texts, normalised first; spaces don't count as characters."""
    r, h = t.scoring_text(F.coalesce(F.col(ref), F.lit(""))), t.scoring_text(F.coalesce(F.col(hyp), F.lit("")))
    out = df.withColumns({"_r": r, "_h": h})
    out = out.withColumns({"_rt": t.tokens("_r"), "_ht": t.tokens("_h"), "_rc": F.replace(F.col("_r"), F.lit(" "), F.lit("")), "_hc": F.replace(F.col("_h"), F.lit(" "), F.lit(""))})
    out = out.withColumn("_a", word_alignment("_rt", "_ht"))
    out = out.withColumns({"s": F.col("_a.s").cast("long"), "d": F.col("_a.d").cast("long"), "i": F.col("_a.i").cast("long"), "n": F.size("_rt").cast("long"), "char_edits": char_distance("_rc", "_hc").cast("long"), "char_len": F.length("_rc").cast("long")})
    wer = t.ratio(F.col("s") + F.col("d") + F.col("i"), "n")
    out = out.withColumns({"wer": wer, "accuracy": 1 - wer, "cer": t.ratio("char_edits", "char_len")})
    return out.drop("_r", "_h", "_rt", "_ht", "_rc", "_hc", "_a")


def corpus_errors(detail: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Micro-averages over the rows of word_errors, with latency_s and duration_s where they are there."""
    sums = [F.sum(c).alias(c) for c in ("s", "d", "i", "n", "char_edits", "char_len", "latency_s", "duration_s") if c in detail.columns]
    out = detail.groupBy(*(keys or [])).agg(*sums)
    out = out.withColumns({"wer": t.ratio(F.col("s") + F.col("d") + F.col("i"), "n"), "cer": t.ratio("char_edits", "char_len")})
    return out.withColumn("rtf", t.ratio("latency_s", "duration_s")) if "latency_s" in out.columns and "duration_s" in out.columns else out


def with_total(detail: DataFrame, total: DataFrame, key: str, name: str = "__AGGREGATE__") -> DataFrame:
    """Detail rows and one aggregate row in a table."""
    return detail.unionByName(total.withColumn(key, F.lit(name)), allowMissingColumns=True)


def paired(reference: DataFrame, predicted: DataFrame, key: str) -> DataFrame:
    """(key, ref, pred) of encounters that have both; the others are passed over."""
    return reference.select(key, "ref").join(predicted.select(key, "pred"), key)


def _scores(r: Column, p: Column) -> dict[str, Column]:
    """Both sets empty: all 1; one of them: all 0."""
    both, union = F.size(F.array_intersect(r, p)), F.size(F.array_union(r, p))
    one, zero = F.lit(1.0), F.lit(0.0)
    none = (F.size(r) == 0) & (F.size(p) == 0)
    some = (F.size(r) == 0) | (F.size(p) == 0)
    case = lambda x: F.when(none, one).when(some, zero).otherwise(x)
    precision, recall = both / F.size(p), both / F.size(r)
    f1 = F.when(both > 0, 2 * precision * recall / (precision + recall)).otherwise(zero)
    return {"precision": case(precision), "recall": case(recall), "f1": case(f1), "jaccard": case(both / union)}


def code_metrics(df: DataFrame, key: str, ref: str = "ref", pred: str = "pred") -> DataFrame:
    """(key, level, precision, recall, f1, jaccard) of two arrays of codes, strictly and by category."""
    clean = lambda c: F.array_distinct(F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.trim(x) != ""))
    parents = lambda c: F.array_distinct(F.transform(clean(c), t.category))
    out = None
    for level, f in (("strict", clean), ("parent", parents)):
        part = df.select(F.col(key), f(ref).alias("_r"), f(pred).alias("_p")).select(key, F.lit(level).alias("level"), *[x.alias(n) for n, x in _scores(F.col("_r"), F.col("_p")).items()])
        out = part if out is None else out.unionByName(part)
    return out


def summary(metrics: DataFrame, names: tuple[str, ...] = ("precision", "recall", "f1", "jaccard")) -> DataFrame:
    """(level, metric, n, mean, min, max)."""
    long = metrics.unpivot(["level"], list(names), "metric", "value")
    return long.groupBy("level", "metric").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"))


def mean_pivot(df: DataFrame, rows: str, columns: str, values: list[str], metric: str, order: list | None = None, digits: int = 4) -> DataFrame:
    """Means by row and column value, rounded, rows in the given order of categories."""
    out = df.groupBy(rows).pivot(columns, values).agg(F.round(F.avg(metric), digits))
    return out if order is None else out.orderBy(F.array_position(F.array(*[F.lit(x) for x in order]), F.col(rows)))


def top_codes(annotations: DataFrame, key: str) -> DataFrame:
    """(key, pred): the distinct codes of the best matches, blank ones left out."""
    code = F.try_element_at("matches", F.lit(1))["code"]
    return annotations.groupBy(key).agg(F.array_sort(F.collect_set(F.when(F.trim(code) != "", code))).alias("pred"))

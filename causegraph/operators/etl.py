"""Idioms of the graph's sources: choosing rows, looking up, reshaping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window


def most_granular(df: DataFrame, keys: list[str], rank: Column) -> DataFrame:
    """Rows of the least rank among those of their keys; rows without a rank go. One shuffle, on the keys."""
    ranked = df.withColumn("_rank", rank).where("_rank is not null")
    return ranked.withColumn("_best", F.min("_rank").over(Window.partitionBy(*keys))).where("_rank = _best").drop("_rank", "_best")


def union_unless_known(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """All of the first and those rows of the second whose key the first lacks."""
    return first.unionByName(second.join(first.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def replace_by(df: DataFrame, column: str, mapping: DataFrame, key: str, value: str) -> DataFrame:
    """The column's value through a mapping table, itself where that has none."""
    m = mapping.select(F.col(key).alias("_k"), F.col(value).alias("_v"))
    return df.join(m, F.col(column) == F.col("_k"), "left").withColumn(column, F.coalesce("_v", column)).drop("_k", "_v")


def last_wins(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, value): of several rows of a key the last one's."""
    return df.groupBy(key).agg(F.max_by(value, order).alias(value))


def joined_sets(df: DataFrame, keys: list[str], columns: list[str], sep: str = "|") -> DataFrame:
    """Per key: the distinct values of each column, sorted and joined."""
    return df.groupBy(*keys).agg(*[F.array_join(F.array_sort(F.collect_set(c)), sep).alias(c) for c in columns])


def first_value(df: DataFrame, keys: list[str], column: str, order: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min_by(column, order).alias(column))


def long_form(df: DataFrame, ids: list[str], columns: list[str], name: str = "col", value: str = "value") -> DataFrame:
    """Columns to rows; NULL cells stay."""
    return df.unpivot(ids, columns, name, value)


def exploded_codes(df: DataFrame, cell: str, out: str = "code", sep: str = ";") -> DataFrame:
    """A row for each code of a separated cell, trimmed, without empty ones."""
    return df.withColumn(out, F.explode(F.split(F.col(cell), sep))).withColumn(out, F.trim(out)).where(F.col(out) != "")


def latest(df: DataFrame, keys: list[str], order: str, most: int) -> DataFrame:
    """The newest ``most`` rows of each key (older ones are shed)."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most).drop("_k")

"""Hierarchies: by depth in a sequence, by identifier, by code ranges, and their closure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

from causegraph.functions.text import parent_by_dot
from causegraph.operators.graph import union_all
from causegraph.storage import stored


def depth_parent(df: DataFrame, ident: str, depth: str, order: str, most: int, partition: list[str] | None = None) -> DataFrame:
    """Adds ``parent``: the last id seen before at the depth above (never forgotten), NULL at depth 1 or if none was.

    One running window per depth.  ``partition`` names columns of independent
    sequences (chapters); without them the sequence is one, and so is its task.
    """
    w = Window.partitionBy(*(partition or [F.lit(0)])).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    parent: Column = F.lit(None).cast("string")
    for d in range(2, most + 1):
        parent = F.when(F.col(depth) == d, F.last(F.when(F.col(depth) == d - 1, F.col(ident)), ignorenulls=True).over(w)).otherwise(parent)
    return df.withColumn("parent", parent)


def dotted_parents(df: DataFrame, ident: str, prefix: str = "") -> DataFrame:
    """(child, parent) of identifiers with a dot."""
    child = F.concat(F.lit(prefix), F.col(ident))
    return df.select(child.alias("child"), F.concat(F.lit(prefix), parent_by_dot(ident)).alias("parent")).where("parent is not null")


def code_ranges(df: DataFrame, cell: str) -> DataFrame:
    """A cell such as ``A92-A96, (J85); B20`` as rows with range_from and range_to (equal for a single code)."""
    parts = F.split(F.regexp_replace(F.col(cell), r"[()]", ""), "[;,]")
    out = df.withColumn("_part", F.explode(parts)).withColumn("_part", F.trim("_part")).where("_part <> ''")
    a, b = F.trim(F.substring_index("_part", "-", 1)), F.trim(F.regexp_extract("_part", r"-(.*)$", 1))
    return out.withColumns({"range_from": a, "range_to": F.when(b == "", a).otherwise(b)}).drop("_part")


def expand_ranges(ranges: DataFrame, codes: DataFrame, code: str, low: str = "range_from", high: str = "range_to", prefix: int = 1) -> DataFrame:
    """Codes within each range, both ends and their subcodes included.

    The leading letters are an equality key, so the range condition is checked within a
    letter only; a range over several letters is repeated for each.
    """
    letters = F.transform(F.sequence(F.ascii(F.col(low)), F.greatest(F.ascii(F.col(low)), F.ascii(F.col(high)))), lambda x: F.char(x))
    r = ranges.withColumn("_k", F.explode(letters))
    c = codes.withColumn("_k", F.substring(code, 1, prefix))
    upto = F.concat(F.col(high), F.lit("￿"))
    return r.join(c, "_k").where((F.col(code) >= F.col(low)) & (F.col(code) <= upto)).drop("_k")


def closure(edges: DataFrame, child: str, parent: str, rounds: int = 40) -> DataFrame:
    """All (node, ancestor) pairs of a hierarchy, cycles permitted.

    Round r joins walks of exactly 2^r steps with all pairs so far, which are up to 2^r steps apart, so that a chain of n
    nodes takes log2(n) rounds and not n.  A round without new pairs is the last.
    """
    pair = lambda a, b: [F.col(a).alias("node"), F.col(b).alias("ancestor")]
    walks = stored(edges.select(*pair(child, parent)).where("node is not null and ancestor is not null").distinct(), "walks")
    seen = [walks]
    for _ in range(rounds):
        first = walks.select("node", F.col("ancestor").alias("_via"))
        onward = lambda pairs: first.join(pairs.withColumnRenamed("node", "_via"), "_via").select("node", "ancestor").distinct()  # noqa: B023, E731
        so_far = union_all(seen)
        longer, walks = onward(so_far).unionByName(walks).distinct(), stored(onward(walks), "walks")
        new = stored(longer.join(so_far, ["node", "ancestor"], "left_anti"), "pairs")
        if new.isEmpty():
            return so_far
        seen.append(new)
    raise ValueError(f"the hierarchy is deeper than 2^{rounds}")


def below(edges: DataFrame, roots: list[str], child: str, parent: str, rounds: int = 10_000) -> DataFrame:
    """Distinct nodes that are below (or are) one of the roots, cycles permitted.

    The search goes down from the roots: a round joins the nodes found last with the edges and stores those not found
    before, so that nothing is made but the nodes asked for, each of them once.  A root must be in an edge.
    """
    e = stored(edges.select(F.col(child).alias("_c"), F.col(parent).alias("_p")).distinct(), "edges")
    new = stored(e.select(F.explode(F.array("_c", "_p")).alias("node")).where(F.col("node").isin(roots)).distinct(), "found")
    seen = [new]
    for _ in range(rounds):
        step = e.join(new, F.col("_p") == F.col("node")).select(F.col("_c").alias("node")).where("node is not null").distinct()
        new = stored(step.join(union_all(seen), "node", "left_anti"), "found")
        if new.isEmpty():
            return union_all(seen)
        seen.append(new)
        if len(seen) == 16:  # deep hierarchies: few tables to read in a round
            seen = [stored(union_all(seen), "found")]
    raise ValueError(f"the hierarchy is deeper than {rounds}")

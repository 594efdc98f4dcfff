"""Operator 7: Jaccard self-join of word shingles by chosen paths.

Documents are sets of five-word shingles (lower case, words parted by white space; a
text of one to four words is one shingle).  Texts with equal word sequences are copies
and take part as one.  In each of several independent runs a set chooses a token, the
shingle with the least value under the run's hash, and goes to that token's node: two
sets with similarity s choose alike with probability s.  Nodes are then compared whole
when they are small, or when their sets are alike on average; a large node of unlike
sets, such as the holders of a common passage, is split again on another sampled
token, down to a limited depth, and compared in blocks after that.  Runs are repeated
as often as the target recall needs at that depth, with the sketch's coordinates shared
by the splits of all runs: misses of a pair at the threshold are fewer than 1 - RECALL.

Comparing in a node is brute force on sketches of 96 sampled tokens, with a floor that a
pair at the threshold misses with a probability below FLOOR_MISS; it yields no pairs but
a spanning forest of candidates, whose components are clusters.  Exact sets are then made
once for each clustered document and parted by size, as linked sets differ in size by a
fifth at most; a set also visits the next larger size.  Every pair of a part is checked
exactly, in blocks of bounded size; a task returns link counts and a spanning forest of
exact links.

Null texts and texts without words link with nothing; each is a class of its own.  Rows
are told apart by themselves, not by their key: rows that repeat a key with its text are
copies, of which one is kept, and rows that share a key with other texts are documents of
their own.  A null key is the least of all keys.  Columns but key and text are not used.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from causegraph.llm.bpe import _slices
from causegraph.llm.common import bounds_of, components, documents, fresh, grouped, in_blocks, roots_of, row_ids
from causegraph.storage import stored

WORDS, THRESHOLD, RECALL, DEPTH = 5, 0.8, 0.99999, 3
COORDINATES, FLOOR_MISS = 96, 1e-7
LIKENESS = 4  # so many of the coordinates judge nodes, the others split them
NODE, ALIKE = 512, 0.25
BLOCK = 1024  # rows of a task's block; a task compares two
SLICE_BYTES = 2 << 20

_U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def _chance(k: int, n: int, p: float) -> float:
    return math.comb(n, k) * p**k * (1 - p) ** (n - k)


def floor(threshold: float = THRESHOLD, miss: float = FLOOR_MISS) -> int:
    """Agreements of two sketches that are too few: a pair at the threshold has no more with a probability below ``miss``."""
    total, k = 0.0, -1
    while (total := total + _chance(k + 1, COORDINATES, threshold)) < miss:
        k += 1
    return k


def missed(n_runs: float, threshold: float = THRESHOLD, depth: int = DEPTH) -> float:
    """Probability that a pair at the threshold was not compared, or not above the floor, after so many runs in which
    every node split down to ``depth``. Splits of all runs share the sketch's coordinates, so a pair that agrees in few
    of them is missed in many runs: the expectation is over the number of coordinates it agrees in."""
    shared = COORDINATES - LIKENESS
    apart = sum(_chance(k, shared, threshold) * (1 - threshold * (k / shared) ** (depth - 1)) ** n_runs for k in range(shared + 1))
    return apart + sum(_chance(k, COORDINATES, threshold) for k in range(floor(threshold) + 1))


def runs(threshold: float = THRESHOLD, recall: float = RECALL, depth: int = DEPTH) -> int:
    """Runs after which a pair at the threshold was missed with probability below 1 - recall, even if every node split down to ``depth``."""
    if missed(math.inf, threshold, depth) >= 1 - recall:
        raise ValueError(f"sketches of {COORDINATES} do not reach a recall of {recall} at {threshold}")
    n = 1
    while missed(n, threshold, depth) >= 1 - recall:
        n += 1
    return n


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def _odd(n: int, seed: int) -> np.ndarray:
    return _mix(np.arange(1, n + 1, dtype=_U) * _U(0x632BE59BD9B4E019) + _U(seed)) | _U(1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64."""
    if not _POWERS or len(_POWERS[0][0]) < n:
        size = 1 << (n - 1).bit_length()
        both = []
        for p in (_P, pow(_P, -1, 1 << 64)):
            out = np.ones(size, _U)
            have = 1
            while have < size:
                out[have : 2 * have] = out[:have] * _U(pow(p, have, 1 << 64))
                have *= 2
            both.append(out)
        _POWERS[:] = [tuple(both)]
    return _POWERS[0]


class Shingles:
    """Shingle hashes of a batch of texts, in order: ``values[first[i]:first[i + 1]]`` are those of text i."""

    def __init__(self, texts: list[str | None], k: int = WORDS):
        parts = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
        raw = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
        up, down = _powers(len(raw) + 1)
        space = _SPACE[raw]
        edge = np.diff(space.astype(np.int8), prepend=1)
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        end = end[end > start[0]] if len(start) else end[:0]
        hashed = np.concatenate([np.zeros(1, _U), np.cumsum(raw.astype(_U) * up[: len(raw)], dtype=_U)])
        word = _mix((hashed[end] - hashed[start]) * down[start] + (end - start).astype(_U))
        limits = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])])
        of = np.searchsorted(limits, start, "right") - 1
        self.words = np.bincount(of, minlength=len(texts)) if len(of) else np.zeros(len(texts), int)
        first = np.concatenate([[0], np.cumsum(self.words)])
        times = _odd(k, 77)
        values, counts = np.zeros(max(len(word) - k + 1, 0), _U), np.maximum(self.words - k + 1, 0)
        for j in range(k):
            values += word[j : len(word) - k + 1 + j] * times[j] if len(values) else values
        values = _mix(values)
        keep = of[: len(values)] == of[k - 1 :] if len(values) else np.zeros(0, bool)
        short = np.flatnonzero((self.words > 0) & (self.words < k))
        values = values[keep]
        at = np.cumsum(counts)[short]
        one = [_mix(np.array([int((word[first[i] : first[i + 1]] * times[: self.words[i]]).sum(dtype=_U)) + int(self.words[i])], _U))[0] for i in short]
        self.values = np.insert(values, at, np.array(one, _U)) if len(short) else values
        counts[short] = 1
        self.first = np.concatenate([[0], np.cumsum(counts)])
        # the sequence of words, for copies
        place = np.arange(len(word)) - np.repeat(first[:-1], self.words) if len(word) else np.zeros(0, int)
        has = np.flatnonzero(self.words)
        self.sequence = np.zeros((2, len(texts)), _U)
        if len(word):
            up, _ = _powers(int(self.words.max()) + 1)
            for row, salted in enumerate((word, _mix(word + _U(0xA0761D6478BD642F)))):
                self.sequence[row, has] = _mix(np.add.reduceat(salted * up[place], first[has]) + self.words[has].astype(_U))

    def least(self, times: np.ndarray) -> np.ndarray:
        """Per text with shingles and multiplier: the least product; (texts with shingles) x multipliers."""
        has = np.flatnonzero(np.diff(self.first))
        out = np.empty((len(has), len(times)), _U)
        for j, t in enumerate(times):
            out[:, j] = np.minimum.reduceat(self.values * t, self.first[has])
        return out

    def sets(self) -> list[np.ndarray]:
        return [np.unique(self.values[a:b]) for a, b in zip(self.first, self.first[1:])]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def signatures(df: DataFrame, key: str, text: str, n_runs: int) -> DataFrame:
    """Rows (key, h, f1, f2, chosen, sketch), h a hash of the text as it stands; null but for key and h where a text has no words."""
    times = _odd(COORDINATES + n_runs, 5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, 2, SLICE_BYTES):
                s = Shingles(part.column(2).to_pylist())
                has = np.flatnonzero(np.diff(s.first))
                place = np.full(part.num_rows, -1)
                place[has] = np.arange(len(has))
                at = pa.array(place, mask=place < 0)
                low = s.least(times) if len(has) else np.zeros((0, len(times)), _U)
                chosen = pa.FixedSizeListArray.from_arrays(_signed(np.ascontiguousarray(_mix(low[:, COORDINATES:])).ravel()), n_runs).cast(pa.list_(pa.int64()))
                sketch = np.ascontiguousarray((_mix(low[:, :COORDINATES]) >> _U(48)).astype(np.uint16))
                sketch = pa.array([r.tobytes() for r in sketch], pa.binary())
                f = [_signed(np.ascontiguousarray(s.sequence[i, has])) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], *(x.take(at) for x in (*f, chosen, sketch))], ["key", "h", "f1", "f2", "chosen", "sketch"])

    kind = df.schema[key].dataType.simpleString()
    return _keyed(df, key, text).mapInArrow(run, f"key {kind}, h long, f1 long, f2 long, chosen array<long>, sketch binary")


def _keyed(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key).alias("key"), F.xxhash64(F.lit(8), F.col(text)).alias("h"), F.col(text).alias("text"))


def _alike(most: int) -> Callable[[pa.Table], pa.Table]:
    """Candidates among the rows of each task, by more than ``most`` agreements of sketches: (a, b) edges of a forest."""

    def run(table: pa.Table) -> pa.Table:
        task, rep = table.column("task").to_numpy(), table.column("rep").to_numpy()
        block, two = table.column("block").to_numpy(), table.column("two").to_numpy(zero_copy_only=False)
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint16).reshape(len(rep), -1)
        bounds = bounds_of(task)
        size = np.diff(bounds)
        small = np.repeat(size <= 32, size)
        left, right = [], []

        def check(i: np.ndarray, j: np.ndarray) -> None:
            fit = (~two[i]) | (block[i] != block[j])
            i, j = i[fit], j[fit]
            ok = (sketch[i] == sketch[j]).sum(1) > most
            left.append(i[ok])
            right.append(j[ok])

        rows = np.flatnonzero(small)
        for d in range(1, 32):  # all pairs of small tasks at once, by distance
            i = rows[rows + d < len(task)]
            i = i[task[i] == task[i + d]]
            if not len(i):
                break
            check(i, i + d)
        for a, b in zip(bounds[:-1][size > 32], bounds[1:][size > 32]):
            for i in range(a, b - 1):
                j = np.arange(i + 1, b)
                check(np.full(len(j), i), j)
        i, j = (np.concatenate(x) if x else np.zeros(0, int) for x in (left, right))
        root = roots_of(len(rep), i, j)
        at = np.flatnonzero(root != np.arange(len(rep)))
        return pa.table({"a": pa.array(rep[at]), "b": pa.array(rep[root[at]])})

    return run


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets."""
    n = len(sets)
    if n == 2:
        x = np.intersect1d(sets[0], sets[1], assume_unique=True).size
        return np.array([[len(sets[0]), x], [x, len(sets[1])]])
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    element = np.concatenate(sets)
    order = np.argsort(element, kind="stable")
    owner, element = owner[order], element[order]
    begin = np.concatenate([[True], element[1:] != element[:-1]])
    number = np.cumsum(begin) - 1
    first = np.append(np.flatnonzero(begin), len(element))
    by_owner = np.argsort(owner, kind="stable")
    numbers, limits = number[by_owner], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])
    out = np.zeros((n, n), np.int32)
    for i in range(n):
        own = numbers[limits[i] : limits[i + 1]]
        a, c = first[own], first[own + 1] - first[own]
        post = np.repeat(a - np.concatenate([[0], np.cumsum(c)[:-1]]), c) + np.arange(c.sum())
        out[i] = np.bincount(owner[post], minlength=n)
    return out


def _exact(threshold: float) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        rep, copies, home = (table.column(c).to_numpy(zero_copy_only=False) for c in ("rep", "copies", "home"))
        block, two = table.column("block").to_numpy(), table.column("two").to_numpy(zero_copy_only=False)
        sets = [np.frombuffer(b, _U) for b in table.column("shingles").to_pylist()]
        sizes = np.array([len(s) for s in sets])
        links, root = np.zeros(len(rep), np.int64), np.arange(len(rep))
        bounds = bounds_of(table.column("task").to_numpy())
        for a, b in zip(bounds, bounds[1:]):
            if b - a < 2 or not home[a:b].any():
                continue
            both = _shared(sets[a:b])
            ok = np.zeros((b - a, b - a), bool)
            for i in range(0, b - a, 256):
                part = slice(a + i, min(a + i + 256, b))
                least = threshold * (sizes[part, None] + sizes[None, a:b] - both[i : i + 256]) - 1e-9
                ok[i : i + 256] = (both[i : i + 256] >= least) & (home[part, None] | home[None, a:b])
                if two[a]:
                    ok[i : i + 256] &= block[part, None] != block[None, a:b]
            np.fill_diagonal(ok, False)
            links[a:b] = [copies[a:b][row].sum() for row in ok]
            i, j = np.nonzero(ok)
            root[a:b] = a + roots_of(b - a, i, j)
        at = np.flatnonzero(links)
        return pa.table({"rep": pa.array(rep[at]), "links": pa.array(links[at]), "root": pa.array(rep[root[at]])})

    return run


def _candidates(reps: DataFrame, threshold: float) -> DataFrame:
    """Edges (a, b) of a forest over documents that agree well enough in some node."""
    rows = reps.select("rep", F.posexplode("chosen").alias("run", "token")).select("rep", F.xxhash64("run", "token").alias("node"))
    sketches = reps.select("rep", "sketch")
    compared: list[DataFrame] = []
    for depth in range(1, DEPTH + 1):
        size = stored(rows.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")  # so that Spark can split a node in the join
        level = stored(rows.join(size, "node").join(sketches, "rep"), "nodes")
        large = level.where(F.col("n") > NODE)
        if depth == DEPTH or large.isEmpty():
            compared.append(level)
            break
        # Likeness of a large node: how often two of its sets agree in one coordinate, which the node's hash names.
        # A misjudged node costs time only: runs() allows for splits down to DEPTH.
        one = 2 * F.pmod(F.xxhash64(F.lit(7), "node"), F.lit(LIKENESS)).cast("int") + 1
        alike = large.groupBy("node", F.substring(F.col("sketch"), one, F.lit(2)).alias("v")).agg(F.count(F.lit(1)).alias("m"), F.first("n").alias("n"))
        alike = alike.groupBy("node").agg((F.sum(F.col("m").cast("double") * F.col("m")) / F.first(F.col("n").cast("double") * F.col("n"))).alias("alike"))
        split = alike.where(F.col("alike") < ALIKE).select("node")
        split = stored(split, "split")
        compared.append(level.join(split, "node", "left_anti"))
        pick = LIKENESS + F.pmod(F.xxhash64(F.lit(6), "node"), F.lit(COORDINATES - LIKENESS)).cast("int")
        rows = stored(level.join(split, "node", "left_semi").select("rep", F.xxhash64("node", F.substring(F.col("sketch"), 2 * pick + 1, F.lit(2))).alias("node")), "paths")
    todo = compared[0]
    for more in compared[1:]:
        todo = todo.unionByName(more)
    n = F.col("n")
    blocks = F.greatest(F.ceil(n / BLOCK), F.least(F.lit(4), F.ceil(n / NODE)))
    tasks = in_blocks(todo, "node", blocks).select("task", "block", "two", "rep", "sketch")
    return grouped(tasks, _alike(floor(threshold)), "a long, b long")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _slices(batch, 3, SLICE_BYTES):
            found = Shingles(part.column(3).to_pylist()).sets()
            size = pa.array([len(x) for x in found], pa.int32())
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([x.tobytes() for x in found], pa.binary()), size], ["rep", "cluster", "copies", "shingles", "size"])


def _links(texts: DataFrame, threshold: float) -> DataFrame:
    """Exact links within clusters (rep, cluster, copies, text): rows (rep, links, root), several for a rep."""
    schema = "rep long, cluster long, copies long, shingles binary, size int"
    exact = stored(texts.mapInArrow(_sets, schema).dropDuplicates(["rep", "shingles"]), "shingles")
    kind = F.floor(F.log(F.col("size").cast("double")) / (1e-6 - math.log(threshold)))  # linked sets are of one kind or of two that follow each other
    parts = exact.withColumn("v", F.explode(F.array(F.struct(kind.alias("kind"), F.lit(True).alias("home")), F.struct((kind + 1).alias("kind"), F.lit(False).alias("home")))))
    parts = parts.withColumns({"part": F.xxhash64(F.lit(9), "cluster", "v.kind"), "home": F.col("v.home")}).drop("v")
    size = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.max("home").alias("any")).where("n > 1 and any").select("part", "n")
    n = F.col("n")
    blocks = F.greatest(F.ceil(n / BLOCK), F.least(F.lit(12), F.ceil(n / 128)))
    tasks = in_blocks(parts.join(stored(size, "sizes"), "part"), "part", blocks).select("task", "block", "two", "home", "rep", "copies", "shingles")
    return grouped(tasks, _exact(threshold), "rep long, links long, root long")


def classes(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: key and h (a hash of its text), class_id, n_links and kept."""
    n_runs = runs(threshold)
    signed = stored(row_ids(signatures(df, key, text, n_runs), "row"), "signatures")
    same = ["f1", "f2"]
    reps = signed.where("f1 is not null").groupBy(*same, "chosen", "sketch").agg(F.min(F.struct("key", "row", "h")).alias("first"), F.count(F.lit(1)).alias("copies"))
    reps = stored(reps.select(*same, "chosen", "sketch", "copies", F.col("first.row").alias("rep"), F.col("first.key").alias("key"), F.col("first.h").alias("h")), "reps")
    clusters = components(_candidates(reps, threshold)).withColumnsRenamed({"node": "rep", "root": "cluster"})
    clusters = stored(clusters.join(reps.select("rep", "copies", "key", "h"), "rep"), "clusters")
    rows, named = _keyed(df, key, text), clusters.withColumnsRenamed({"key": "_key", "h": "_h"})
    # All texts move once here, at every size: what is joined to them grows with the table.
    texts = rows.join(named.hint("merge"), (rows.h == named._h) & rows.key.eqNullSafe(named._key)).select("rep", "cluster", "copies", "text")
    found = stored(_links(texts, threshold), "links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(found.select("rep", "root"), "rep", "root").withColumnsRenamed({"node": "rep", "root": "class"})
    whole = stored(reps.select(*same, "rep", "copies", "key").join(links, "rep", "left").join(roots, "rep", "left"), "members")
    first = whole.where("class is not null").groupBy("class").agg(F.min(F.struct("key", "rep")).alias("first"))
    whole = whole.join(stored(first, "classes"), "class", "left")
    one = F.coalesce("first", F.struct("key", "rep"))
    whole = whole.select(*same, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.struct(one["key"].alias("key"), one["rep"].alias("row")).alias("first"))
    out = signed.select("key", "h", "row", *same).join(whole, same, "left")
    alone = F.col("first").isNull()
    class_id = F.when(alone, F.col("key")).otherwise(F.col("first.key"))
    return out.select("key", "h", class_id.alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), (alone | (F.col("row") == F.col("first.row"))).alias("kept"))


def join(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: key, class_id (least key of all documents reachable by links), n_links (other
    documents with a similarity of at least ``threshold``, copies included) and kept (it is the one its class keeps)."""
    return classes(df, key, text, threshold).drop("h").withColumnRenamed("key", key)


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``df``, with all columns, that their classes keep. Of rows that are equal in key and text one stays
    (any, where other columns differ), unless they have no words."""
    found = stored(classes(df, key, text, threshold), "found")
    own, h, often, mark = fresh(df, "own", "h", "often", "mark")
    each = found.groupBy("key", "h").agg(F.max("kept").alias("kept"), F.max("n_links").alias("links"), F.count(F.lit(1)).alias("n")).where("kept")
    each = stored(each.select(F.col("key").alias(own), F.col("h").alias(h), ((F.col("n") > 1) & (F.col("links") > 0)).alias(often)), "kept")
    rows = df.withColumn(mark, F.xxhash64(F.lit(8), F.col(text)))

    def those(chosen: DataFrame) -> DataFrame:
        return rows.join(chosen, (rows[mark] == chosen[h]) & rows[key].eqNullSafe(chosen[own]), "left_semi")

    out = those(each.where(~F.col(often))).drop(mark)
    repeated = each.where(often)
    return out if repeated.isEmpty() else out.unionByName(those(repeated).dropDuplicates([key, mark]).drop(mark))


def op7_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return join(documents(spark, sf_dir, "doc_id", "text"))

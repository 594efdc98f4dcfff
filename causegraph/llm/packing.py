"""Operator 9: best-fit packing by patterns of document lengths.

Lengths are counted into a histogram (one row per length, so its size is bounded by
the sequence length).  On the driver, patterns of two or three lengths that fill a
sequence are enumerated on a grid, non-negative least squares fits how often to
repeat each, counts are rounded down to what the histogram holds, and what remains
is packed by best fit decreasing, into gaps of the patterns as well as new sequences.
All of this handles lengths with counts, never single documents.  The outcome is a
bounded table of segments, each saying where the documents of ranks a to b among
those of one length go; documents are ranked without gaps and looked up in it.

Documents are token ids followed by one end id.  Longer ones than a sequence are cut
into full pieces, of which the first may be shorter.  Null and empty texts are one
end id.  Equal rows are packed each for itself, also where their ids repeat; which of
the documents of one length goes where depends on how the rows are stored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from causegraph.llm import bpe
from causegraph.llm.common import documents, fresh, numbered, row_ids
from causegraph.storage import stored

SIZE, GRID, END_ID = 2048, 8, 0
RANK_BUCKET = 250


def pieces(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = bpe.VOCABULARY, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """Per piece: key, piece, start, length, ids (little-endian unsigned 32-bit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = bpe.codec(vocabulary)
        end = np.array([end_id], np.uint32).tobytes()
        for batch in batches:
            for part in bpe._slices(batch, 1):
                rows: list[int] = []
                piece: list[int] = []
                start: list[int] = []
                ids: list[bytes] = []
                for i, t in enumerate(part.column(1).to_pylist()):
                    raw = c.encode(t) + end
                    n = len(raw) // 4
                    cuts = [0, *range(n % size or size, n, size), n]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        rows.append(i)
                        piece.append(k)
                        start.append(a)
                        ids.append(raw[4 * a : 4 * b])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                    ["key", "piece", "start", "length", "ids"],
                )

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, piece int, start long, length long, ids binary").withColumnRenamed("key", key)


def nnls(rows: np.ndarray, h: np.ndarray, tol: float = 1e-3) -> np.ndarray:
    """Lawson and Hanson's active-set method for min |Ax - h|, x >= 0; column j of A counts rows[j]."""
    n, m = len(h), len(rows)
    x, inside = np.zeros(m), np.zeros(m, bool)
    dense = lambda js: np.stack([np.bincount(rows[j][rows[j] >= 0], minlength=n) for j in js], 1).astype(float)
    padded, mask = np.maximum(rows, 0), rows >= 0
    order: list[int] = []
    a = np.zeros((n, 0))
    for _ in range(4 * n):
        slope = ((h - a @ x[order])[padded] * mask).sum(1) if order else (h[padded] * mask).sum(1)
        slope[inside] = -np.inf
        j = int(np.argmax(slope))
        if slope[j] <= tol * max(1.0, h.max(initial=0)):
            break
        inside[j] = True
        order.append(j)
        a = np.concatenate([a, dense([j])], 1)
        while True:
            g = a.T @ a
            s = np.linalg.solve(g + 1e-9 * np.eye(len(order)), a.T @ h)
            if s.min() > 0:
                x[order] = s
                break
            now = x[order]
            low = s <= 0
            step = float(np.min(now[low] / np.maximum(now[low] - s[low], 1e-30)))
            now = now + step * (s - now)
            keep = now > 1e-9
            x[order] = np.where(keep, now, 0)
            inside[np.array(order)[~keep]] = False
            order = [o for o, k in zip(order, keep) if k]
            a = a[:, keep]
            if not order:
                break
    return x


def _patterns(cells: int, present: np.ndarray) -> np.ndarray:
    """Rows of two or three cells that add up to a full sequence; -1 pads. Only cells that occur."""
    out = []
    for a in range(1, cells):
        b = cells - a
        if a >= b and present[a] and present[b]:
            out.append((a, b, -1))
        for b in range((cells - a + 1) // 2, min(a, cells - a - 1) + 1):
            c = cells - a - b
            if c >= 1 and b >= c and present[a] and present[b] and present[c]:
                out.append((a, b, c))
    return np.array(out, np.int64).reshape(-1, 3)


def _draw(stock: dict[int, list[list[int]]], cell: int, n: int, largest: bool) -> list[list[int]]:
    """Take n documents of a cell, as runs of [length, count], from its longest or shortest."""
    runs, out = stock[cell], []
    while n:
        run = runs[0 if largest else -1]
        k = min(n, run[1])
        out.append([run[0], k])
        run[1] -= k
        n -= k
        if not run[1]:
            runs.pop(0 if largest else -1)
    return out


def plan(histogram: dict[int, int], size: int = SIZE, grid: int = GRID) -> list[tuple[int, int, int, int, int, int]]:
    """Segments (length, first rank, end rank, first sequence, offset, documents per sequence)."""
    cells = size // grid
    stock: dict[int, list[list[int]]] = {}
    for length in sorted(histogram, reverse=True):
        if length < size and histogram[length]:
            stock.setdefault(-(-length // grid), []).append([length, histogram[length]])
    count = np.zeros(cells + 1)
    for cell, runs in stock.items():
        count[cell] = sum(n for _, n in runs)

    groups: list[tuple[int, list[tuple[int, int]]]] = []  # sequences alike: how many, and (length, how often) in each
    if histogram.get(size):
        groups.append((histogram[size], [(size, 1)]))
    pats = _patterns(cells, count > 0)
    if len(pats):
        fit = nnls(pats, count)
        for j in np.argsort(-fit, kind="stable"):
            pattern = [int(c) for c in pats[j] if c >= 0]
            left = min(int(count[c]) // pattern.count(c) for c in pattern)
            repeat = min(int(fit[j] + 1e-6), left)
            if repeat <= 0:
                continue
            lines = [([], repeat)]
            for k, c in enumerate(pattern):  # long ones meet short ones, which evens the gaps
                count[c] -= repeat
                drawn = _draw(stock, c, repeat, k % 2 == 0)
                merged, i = [], 0
                for lengths, n in lines:
                    while n:
                        t = min(n, drawn[i][1])
                        merged.append(([*lengths, drawn[i][0]], t))
                        drawn[i][1] -= t
                        n -= t
                        i += not drawn[i][1]
                lines = sorted(merged, key=lambda x: sum(x[0]))
            groups += [(n, [(x, 1) for x in lengths]) for lengths, n in lines]

    opened: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    for n, slots in groups:
        opened.setdefault(size - sum(x * k for x, k in slots), []).append((n, slots))
    rest = sorted(((length, n) for runs in stock.values() for length, n in runs if n), reverse=True)
    for length, n in rest:
        while n:
            gap = min((g for g, have in opened.items() if g >= length and have), default=None)
            if gap is None:
                per = size // length
                for many, times in ((n // per, per), (1 if n % per else 0, n % per)):
                    if many:
                        opened.setdefault(size - length * times, []).append((many, [(length, times)]))
                n = 0
                continue
            many, slots = opened[gap].pop()
            per = min(gap // length, n)
            k = min(many, n // per)
            opened.setdefault(gap - per * length, []).append((k, [*slots, (length, per)]))
            if many > k:
                opened[gap].append((many - k, slots))
            n -= k * per

    out, rank, seq = [], {}, 0
    for have in opened.values():
        for many, slots in have:
            offset = 0
            for length, per in slots:
                a = rank.get(length, 0)
                rank[length] = a + many * per
                out.append((length, a, a + many * per, seq, offset, per))
                offset += length * per
            seq += many
    return out


def pack(table: DataFrame, row: str, size: int = SIZE, grid: int = GRID, length: str = "length") -> DataFrame:
    """Add sequence_id and offset (columns of these names are replaced) to a stored table with a length column
    (1 to size); ``row`` differs in every row."""
    spark = table.sparkSession
    table = table.drop("sequence_id", "offset")
    own, n, a, z, seq, off, per, rank = fresh(table, "own", "n", "a", "z", "seq", "off", "per", "rank", also=("sequence_id", "offset"))
    histogram = {r[0]: r[1] for r in table.groupBy(length).agg(F.count(F.lit(1))).collect()}  # one row per length
    segments = plan(histogram, size, grid) or [(0, 0, 0, 0, 0, 1)]
    where = spark.createDataFrame(segments, ", ".join(f"{c} long" for c in (own, a, z, seq, off, per)))
    counts = spark.createDataFrame(list(histogram.items()) or [(0, 0)], f"{own} long, {n} long")
    counted = table.join(F.broadcast(counts), table[length] == F.col(own)).drop(own)  # at most `size` rows
    ranked = numbered(counted, [length], row, rank, F.ceil(F.col(n) / RANK_BUCKET)).drop(n)
    here = (ranked[length] == F.col(own)) & (F.col(rank) >= F.col(a)) & (F.col(rank) < F.col(z))
    joined = ranked.join(F.broadcast(where), here)  # bounded by `size`
    at = F.col(rank) - F.col(a)
    placed = {"sequence_id": F.col(seq) + F.floor(at / F.col(per)), "offset": F.col(off) + (at % F.col(per)) * F.col(length)}
    return joined.withColumns(placed).drop(own, a, z, seq, off, per, rank)


def pack_documents(docs: DataFrame) -> DataFrame:
    """Pieces of all documents with the place of each; ids are reduced to their crc32 before rows move.
    Of the documents only doc_id and text are used; other columns go."""
    cut = pieces(docs.select("doc_id", "text"))
    cut = cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(stored(row_ids(cut, "row"), "pieces"), "row").drop("row")


def op9_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir, "doc_id", "text"))

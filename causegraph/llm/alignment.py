"""Operator 11: alignment of two tokenizers' tokens, and how often their ids go together.

One Arrow function tokenises and cuts: it takes about SLICE_BYTES of texts at a time, marks the bytes at which both
vocabularies' tokens end, and hands over each document's groups, as decimal text and, where a group has more than one
token on a side, as two arrays of ids; a group of one token each is one link already.  The cutting is arithmetic on flat
arrays over all texts of a slice, so it takes time in proportion to the tokens.  All else is done by Spark: the digests,
the links of the other groups, which are the products of their ids, and the counts across documents.  A group too large
for products, as in a long stretch in which the two never agree, links its distinct ids with their counts multiplied,
which an ``aggregate`` bounds by the vocabularies and not by the stretch.

How many documents hold a pair is an aggregation with map-side combine, and so is each A
id's highest count.  Documents get the counts of their pairs back by a join: a broadcast
as long as the table of counts has at most BROADCAST_ROWS rows (about 30 MB), a sort-merge
join of stored tables, whose hot pairs Spark splits, beyond it.  Both give the same.

Texts that are null or empty, or that do not survive either vocabulary byte by byte (those
with U+2581, which vocabulary B takes for a space), have no tokens.  Strings that look like
special tokens are plain text.  Equal rows are documents of their own, a null doc_id
stays null, and columns of other names play no part.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from causegraph.llm import bpe, pieces
from causegraph.llm.common import documents, row_ids
from causegraph.storage import stored

VOCABULARY_A, VOCABULARY_B = bpe.VOCABULARY, pieces.VOCABULARY
#: Up to so many rows the table of counts is broadcast.
BROADCAST_ROWS = 1_000_000
#: Groups with more pairs of tokens link distinct ids only.
PRODUCT = 256
#: Texts of about so many bytes are tokenised and cut at a time.
SLICE_BYTES = 1 << 18
#: So many tokens' bytes are placed at a time.
PLACED = 1 << 15
#: B's ids are below this. A pair's number is A's id times B_IDS plus B's.
B_IDS = 1 << 17
#: What may stand behind an id in a document's text of groups: the last one ends the text.
MARKS = (",", "|", ";", "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often and wherever it is used."""
    return F.transform(F.array(value), body)[0]


def tokenised(df: DataFrame, key: str = "doc_id", text: str = "text", a: str = VOCABULARY_A, b: str = VOCABULARY_B) -> DataFrame:
    """(key, n_a, n_b, n_groups, groups, ones, more): tokens of space and text, in groups that end where tokens of both
    vocabularies do. ``groups`` is their text in decimals, ``ones`` the pairs' numbers of groups of one token each, ``more``
    the ids of the others. A text of which a vocabulary changes the bytes has no tokens."""

    def run(batches):
        one, two, numbers = bpe.codec(a), Library(b), None
        for batch in batches:
            numbers = numbers or Decimals(max(len(one.lengths), len(two.lengths)))
            for part in bpe._slices(batch, 1, SLICE_BYTES):
                yield pa.RecordBatch.from_arrays([part.column(0), *cut(part.column(1).to_pylist(), one, two, numbers)], ["key", *names])

    names = ["n_a", "n_b", "n_groups", "groups", "ones", "more"]
    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        run, f"key {kind}, n_a long, n_b long, n_groups long, groups binary, ones array<long>, more array<struct<a: array<int>, b: array<int>>>"
    )


class Library:
    """The piece vocabulary's own library, with the bytes of its tokens."""

    def __init__(self, name: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=bpe.vocabulary_path(name))
        of = lambda i, piece: bytes([int(piece[3:-1], 16)]) if self.model.is_byte(i) else piece.replace(pieces.SPACE, " ").encode()
        table = [of(i, self.model.id_to_piece(i)) for i in range(self.model.get_piece_size())]
        _lay(self, table)

    def direct(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of a text."""
        return array("I", self.model.encode(text)).tobytes()


class Decimals:
    """The decimals of numbers below ``n``, each followed by one of MARKS: those of number i and mark m are at len(MARKS) * i + m."""

    def __init__(self, n: int):
        _lay(self, [f"{i}{m}".encode() for i in range(n) for m in MARKS])


def _lay(table, entries: list[bytes]) -> None:
    table.lengths = np.array([len(t) for t in entries], np.int64)
    table.starts = np.concatenate([[0], np.cumsum(table.lengths)[:-1]])
    table.blob = np.frombuffer(b"".join(entries), np.uint8)


def in_a_row(table, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries' bytes in a row, and where each begins; the last number is where all end. Places are made for PLACED entries at
    a time, as they take many times the room of the bytes."""
    begins = _before(table.lengths[ids])
    out = np.empty(begins[-1], np.uint8)
    for i in range(0, len(ids), PLACED):
        part = begins[i : i + PLACED + 1]
        out[part[0] : part[-1]] = table.blob[np.repeat(table.starts[ids[i : i + PLACED]] - part[:-1], np.diff(part)) + np.arange(part[0], part[-1])]
    return out, begins


def _before(sizes: np.ndarray) -> np.ndarray:
    """Sums of the numbers before each, and of all."""
    out = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=out[1:])
    return out


def cut(texts: list[str | None], one, two, numbers: Decimals) -> list[pa.Array]:
    """The columns of :func:`tokenised` but for the key."""
    wanted = [b" " + x.encode() if x else b"" for x in texts]
    parts = [[one.direct(" " + x) if x else b"" for x in texts], [two.direct(x) if x else b"" for x in texts]]
    whole = [True] * len(texts)
    for table, side in zip((one, two), parts):
        raw, begins = in_a_row(table, np.frombuffer(b"".join(side), np.uint32))
        raw, at = raw.tobytes(), begins[_before([len(x) // 4 for x in side])].tolist()
        whole = [w and raw[i:j] == x for w, i, j, x in zip(whole, at, at[1:], wanted)]
    if not all(whole):
        parts = [[x if w else b"" for w, x in zip(whole, side)] for side in parts]
    a, b = (np.frombuffer(b"".join(side), np.uint32).astype(np.int64) for side in parts)
    a_of, b_of = (_before([len(x) // 4 for x in side]) for side in parts)  # where the documents' tokens begin

    # both sides have the same bytes, so a byte's place among all texts of the slice names it on either
    a_ends, b_ends = np.cumsum(one.lengths[a]), np.cumsum(two.lengths[b])
    marks = np.zeros((2, int(a_ends[-1]) + 1 if len(a) else 1), bool)
    marks[0, a_ends] = marks[1, b_ends] = True
    a_last, b_last = marks[1, a_ends], marks[0, b_ends]  # whether a token is the last one of its group
    a_behind, b_behind = np.flatnonzero(a_last) + 1, np.flatnonzero(b_last) + 1  # where the groups' tokens end
    a_size, b_size = np.diff(a_behind, prepend=0), np.diff(b_behind, prepend=0)
    a_group, b_group = np.repeat(np.arange(len(a_size)), a_size), np.repeat(np.arange(len(b_size)), b_size)
    of = _before(a_last)[a_of]  # where the documents' groups begin

    order = np.empty(len(a) + len(b), np.int64)
    b_marks = 2 * b_last.astype(np.int64)
    b_marks[b_of[1:][np.diff(b_of) > 0] - 1] = 3
    order[np.arange(len(a)) + (b_behind - b_size)[a_group]] = len(MARKS) * a + a_last
    order[np.arange(len(b)) + a_behind[b_group]] = len(MARKS) * b + b_marks
    written, begins = in_a_row(numbers, order)
    groups = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(begins[a_of + b_of].astype(np.int32)), pa.py_buffer(written)])

    single = (a_size == 1) & (b_size == 1)
    ones_of = _before(single)[of]
    ones = a[a_behind[single] - 1] * B_IDS + b[b_behind[single] - 1]
    more = [_lists(_before(size[~single]), ids[~single[group]].astype(np.int32)) for ids, size, group in ((a, a_size, a_group), (b, b_size, b_group))]
    return [*map(pa.array, (np.diff(a_of), np.diff(b_of), np.diff(of))), groups, _lists(ones_of, ones), _lists(of - ones_of, pa.StructArray.from_arrays(more, ["a", "b"]))]


def _lists(begins: np.ndarray, values) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), values if isinstance(values, pa.Array) else pa.array(values))


def counted(values: Column) -> Column:
    """Distinct values of an array of numbers, ascending, with how often each occurs: array of struct<v, n>."""

    def of(s: Column) -> Column:
        begins = F.array_compact(F.transform(s, lambda x, i: F.when((i == 0) | (x != F.get(s, i - 1)), i)))
        return let(begins, lambda b: F.transform(b, lambda i, k: F.struct(F.get(s, i).alias("v"), (F.coalesce(F.get(b, k + 1), F.size(s)) - i).cast("long").alias("n"))))

    return let(F.sort_array(values), of)


def aligned(tokens: DataFrame) -> DataFrame:
    """From :func:`tokenised`: (key, n_a, n_b, n_groups, n_links, groups_sha256, links, large). ``links`` has the number of each
    link's pair, but for links in large groups, whose distinct pairs are in ``large`` (v, n)."""
    pair = lambda x, y: x.cast("long") * F.lit(B_IDS) + y
    many = lambda g: F.size(g["a"]).cast("long") * F.size(g["b"])
    product = lambda g: F.flatten(F.transform(g["a"], lambda x: F.transform(g["b"], lambda y: pair(x, y))))

    def distinct(g: Column) -> Column:
        one = lambda x, y: F.struct(pair(x["v"], y["v"]).alias("v"), (x["n"] * y["n"]).alias("n"))
        return let(counted(g["b"]), lambda ys: F.flatten(F.transform(counted(g["a"]), lambda x: F.transform(ys, lambda y: one(x, y)))))

    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    return tokens.select(
        "key", "n_a", "n_b", "n_groups", (F.size("ones") + F.aggregate("more", F.lit(0).cast("long"), lambda s, g: s + many(g))).alias("n_links"), digest,
        F.concat("ones", F.flatten(F.transform(F.filter("more", lambda g: many(g) <= PRODUCT), product))).alias("links"),
        F.flatten(F.transform(F.filter("more", lambda g: many(g) > PRODUCT), distinct)).alias("large"),
    )


def pair_counts(held: DataFrame) -> DataFrame:
    """(v, count, best): for each pair how many rows hold it, and whether no pair with the same A id has more."""
    pairs = F.array_distinct(F.concat("links", F.transform("large", lambda x: x["v"])))
    counts = stored(held.select(F.explode(pairs).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("count")), "counts")
    a = F.floor(F.col("v") / F.lit(B_IDS))
    highest = counts.groupBy(a.alias("a")).agg(F.max("count").alias("highest"))
    return counts.withColumn("a", a).join(highest, "a").select("v", "count", (F.col("count") == F.col("highest")).alias("best"))


def alignment(df: DataFrame, key: str = "doc_id", text: str = "text", a: str = VOCABULARY_A, b: str = VOCABULARY_B, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Per row: key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    held = stored(row_ids(aligned(tokenised(df, key, text, a, b)), "row"), "links")
    counts = stored(pair_counts(held), "pairs")
    large = held.where(F.size("large") > 0).select("row", F.inline("large"))
    if counts.count() <= broadcast_rows:
        counts = F.broadcast(counts)
        rows = held.select("row", F.explode("links").alias("v"), F.lit(1).cast("long").alias("n")).unionByName(large)
    else:  # equal links of a document travel as one
        rows = held.select("row", F.inline(counted(F.col("links")))).unionByName(large)
    sums = rows.join(counts, "v").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    out = held.drop("links", "large").join(sums, "row", "left").fillna(0, ["n_best", "count_sum"])
    return out.select(F.col("key").alias(key), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op11_token_alignment(spark, sf_dir: str) -> DataFrame:
    return alignment(documents(spark, sf_dir, "doc_id", "text"))

"""Grounding by a dictionary of terms, and recognition of named entities within sentences.

Texts meet a dictionary of any size on hashes of their words.  Two bit maps, made by
aggregation and of a size that has a bound (FILTER_BITS), say which two words begin some
term and which whole groups of words are some term; a worker goes through its texts' words
with them, first by beginnings and, only where one fits, by longer and longer groups.
What leaves it are the places that very likely hold a term, not the words of the texts,
and a join with the terms, on the hash and then the words themselves, makes sure.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from causegraph.functions import text as t
from causegraph.storage import stored

#: The namespaces that the dictionary is limited to, and the entity label that is kept.
NAMESPACES, LABEL = ("MESH", "DOID", "HP"), "Disease"
Tagger = Callable[[str], list[dict]]

#: What a term's kind counts, and a place written as the term is, but for its first letter's case, or with other differences in case.
STATUS = {"name": 1.0, "synonym": 0.9, "former": 0.8}
AS_WRITTEN, FIRST_LETTER, FOLDED = 1.0, 0.9, 0.75

#: Bits of a filter: 32 a term, within these bounds; a term sets two.
FILTER_BITS = (1 << 16, 1 << 30)
_BUCKET = 32_768  # bits of a bucket of Spark's bit maps
_U = np.uint64
#: Words that a worker goes through at a time, so that its memory doesn't depend on the rows of a batch.
WORDS = 1 << 17
_PLACE = ArrayType(StructType([StructField("word", IntegerType()), StructField("n_words", IntegerType()), StructField("h", LongType())]))


def _words(text: Column) -> Column:
    return t.tokens(t.scoring_text(text))


def _as_written(text: Column, words: Column) -> Column:
    """The words with their own case; the normalised ones where lower case parts them in another way."""
    raw = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.when(F.size(raw) == F.size(words), raw).otherwise(words)


def term_table(terms: DataFrame, namespaces: tuple[str, ...] | None = NAMESPACES) -> DataFrame:
    """terms: text, db, id, name and perhaps status. Rows (norm, n_words, db, id, name, weight, spellings) of the wanted
    namespaces; a text of which no term survives is gone with its terms, and of equal terms of several kinds the best counts."""
    kept = terms if namespaces is None else terms.where(F.col("db").isin(list(namespaces)))
    weight = t.lookup(STATUS, "status", F.lit(min(STATUS.values()))) if "status" in terms.columns else F.lit(1.0)
    words = kept.select(_words(F.col("text")).alias("w"), "text", "db", "id", "name", weight.alias("weight")).where(F.size("w") > 0)
    rows = words.select(F.array_join("w", " ").alias("norm"), F.size("w").alias("n_words"), "db", "id", "name", "weight", F.array_join(_as_written(F.col("text"), F.col("w")), " ").alias("spelling"))
    return rows.groupBy("norm", "n_words", "db", "id", "name").agg(F.max("weight").alias("weight"), F.array_sort(F.collect_set("spelling")).alias("spellings"))


@dataclass(frozen=True)
class Dictionary:
    """Terms with their hashes, stored, and what says which words can begin or be a term."""

    terms: DataFrame
    sizes: tuple[int, ...]
    begin: np.ndarray
    whole: np.ndarray


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    return x ^ (x >> _U(29))


def _extended(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a group of words and one more."""
    return h * _U(0x9E3779B97F4A7C15) + _mixed(word)


def _group_hash(words: np.ndarray) -> int:
    h = _mixed(words[:1])
    for k in range(1, len(words)):
        h = _extended(h, words[k : k + 1])
    return int(_mixed(h).astype(np.int64)[0])


def _bits_of(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return h.astype(_U) & _U(bits - 1), (h.astype(_U) >> _U(33)) & _U(bits - 1)


def _held(filter_: np.ndarray, h: np.ndarray) -> np.ndarray:
    one, two = _bits_of(h, len(filter_) * 8)
    bit = lambda x: (filter_[(x >> _U(3)).astype(np.int64)] >> (x & _U(7)).astype(np.uint8)) & 1
    return (bit(one) & bit(two)).astype(bool)


def _filter(hashes: DataFrame, n: int) -> np.ndarray:
    """A bit map of hashes (h): Spark sets the bits bucket by bucket, and the driver, which gets no more than the most bits
    that a filter may have, lays the buckets side by side."""
    bits = min(FILTER_BITS[1], max(FILTER_BITS[0], 1 << int(np.ceil(np.log2(32 * max(1, n))))))
    place = F.explode(F.array(F.col("h").bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned("h", 33).bitwiseAND(F.lit(bits - 1)))).alias("p")
    made = hashes.select(place).select(F.floor(F.col("p") / _BUCKET).alias("b"), (F.col("p") % _BUCKET).alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("m"))
    out = np.zeros(bits // 8, np.uint8)
    for r in made.collect():
        out[r.b * _BUCKET // 8 : (r.b + 1) * _BUCKET // 8] = np.frombuffer(r.m, np.uint8)[: bits // 8]
    return out


def prepared(terms: DataFrame) -> Dictionary:
    """Rows of :func:`term_table` made ready for any number of texts."""

    @F.arrow_udf("struct<h:bigint,begin:bigint>")
    def hashes(words: pa.Array) -> pa.Array:
        of = [np.array(x, np.int64).astype(_U) for x in words.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([_group_hash(x) for x in of], pa.int64()), pa.array([_group_hash(x[:2]) for x in of], pa.int64())], ["h", "begin"])

    hashed = terms.withColumn("_h", hashes(F.transform(F.split("norm", " "), lambda w: F.xxhash64(w))))
    hashed = stored(hashed.withColumns({"h": F.col("_h.h"), "begin": F.col("_h.begin")}).drop("_h"), "terms")
    sizes = tuple(sorted(r[0] for r in hashed.select("n_words").distinct().collect()))  # as many rows as the longest term has words
    n = hashed.count()
    return Dictionary(hashed.drop("begin"), sizes, _filter(hashed.select(F.col("begin").alias("h")), n), _filter(hashed.select("h"), n))


def _places_of(words: pa.ListArray, sizes: tuple[int, ...], begin: np.ndarray, whole: np.ndarray) -> pa.ListArray:
    """For arrays of hashes of words, the groups (word, n_words, h) that are very likely terms, from about WORDS words at a time."""
    if isinstance(words, pa.ChunkedArray):
        words = words.combine_chunks()
    part = np.cumsum(words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)) // WORDS
    begins = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(words)]
    return pa.concat_arrays([_places_in(words.slice(a, b - a), sizes, begin, whole) for a, b in zip(begins, begins[1:])])


def _places_in(words: pa.ListArray, sizes: tuple[int, ...], begin: np.ndarray, whole: np.ndarray) -> pa.ListArray:
    flat = words.flatten().to_numpy(zero_copy_only=False).astype(np.int64).astype(_U)
    n = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(n)
    row = np.repeat(np.arange(len(n)), n)
    left = np.repeat(ends, n) - np.arange(len(flat))  # words to the end of the row
    at, h = np.arange(len(flat)), _mixed(flat) if len(flat) else flat
    found: list[tuple[np.ndarray, int, np.ndarray]] = []
    for k in range(1, (max(sizes) if sizes else 0) + 1):
        if k > 1:
            more = left[at] >= k
            at = at[more]
            h = _extended(h[more], flat[at + k - 1])
        last = _mixed(h)
        if k in sizes:
            good = _held(whole, last)
            found.append((at[good], k, last[good].astype(np.int64)))
        if k == 2:  # where no term begins, no longer group is looked at
            good = _held(begin, last)
            at, h = at[good], h[good]
    place = np.concatenate([a for a, _, _ in found]) if found else np.zeros(0, np.int64)
    size = np.concatenate([np.full(len(a), k) for a, k, _ in found]) if found else np.zeros(0, np.int64)
    value = np.concatenate([x for _, _, x in found]) if found else np.zeros(0, np.int64)
    order = np.lexsort((size, place))
    place, size, value = place[order], size[order], value[order]
    first = ends - n
    items = pa.StructArray.from_arrays([pa.array((place - first[row[place]]).astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(value)], ["word", "n_words", "h"])
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row[place], minlength=len(n)))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), items)


def likely(texts: DataFrame, held: Dictionary, key: str, text: str = "text") -> DataFrame:
    """(key, word, n_words, h, norm, surface): places that very likely hold a term, as normalised and as written."""
    sizes = held.sizes
    begin, whole = (texts.sparkSession.sparkContext.broadcast(x) for x in (held.begin, held.whole))

    @F.arrow_udf(_PLACE)
    def places(words: pa.Array) -> pa.Array:
        return _places_of(words, sizes, begin.value, whole.value)

    rows = texts.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text")).withColumn("_w", _words(F.col("_text")))
    rows = rows.select("_key", "_w", _as_written(F.col("_text"), F.col("_w")).alias("_r"), places(F.transform("_w", lambda w: F.xxhash64(w))).alias("_p"))
    part = lambda c, p: F.array_join(F.slice(c, p["word"] + 1, p["n_words"]), " ")
    full = F.transform("_p", lambda p: F.struct(p["word"].alias("word"), p["n_words"].alias("n_words"), p["h"].alias("h"), part("_w", p).alias("norm"), part("_r", p).alias("surface")))
    return rows.select(F.col("_key").alias(key), F.inline(full))


def candidates(texts: DataFrame, terms: DataFrame | Dictionary, key: str, text: str = "text") -> DataFrame:
    """(key, word, n_words, db, id, name, score): every place, counted in words of the normalised text, at which a term stands,
    and how well it fits: by the term's kind and by how far the text has it as it is written."""
    held = terms if isinstance(terms, Dictionary) else prepared(terms)
    found = likely(texts, held, key, text).join(held.terms, ["h", "n_words", "norm"])
    first_folded = lambda c: F.concat(F.lower(F.substring(c, 1, 1)), F.substr(c, F.lit(2)))
    alike = F.when(F.array_contains("spellings", F.col("surface")), AS_WRITTEN).when(F.exists("spellings", lambda x: first_folded(x) == first_folded(F.col("surface"))), FIRST_LETTER).otherwise(FOLDED)
    return found.select(key, "word", "n_words", "db", "id", "name", (F.col("weight") * alike).alias("score"))


def ground(texts: DataFrame, terms: DataFrame | Dictionary, key: str, text: str = "text") -> DataFrame:
    """The candidates of each text that no longer one covers, from the left: at a place the longest, and none that begins
    within one taken before. Places with several terms keep all of them."""
    found = stored(candidates(texts, terms, key, text), "places")
    longest = found.groupBy(key, "word").agg(F.max("n_words").alias("n_words"))

    def chosen(places: Column) -> Column:
        take = lambda acc, p: F.when(p["word"] >= acc["upto"], F.struct((p["word"] + p["n_words"]).alias("upto"), F.concat(acc["taken"], F.array(p)).alias("taken"))).otherwise(acc)
        none = F.array().cast("array<struct<word:int,n_words:int>>")
        return F.aggregate(places, F.struct(F.lit(0).alias("upto"), none.alias("taken")), take, lambda acc: acc["taken"])

    places = longest.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("word", "n_words"))).alias("p"))
    return found.join(places.select(key, F.inline(chosen(F.col("p")))), [key, "word", "n_words"])


def best(found: DataFrame, key: str) -> DataFrame:
    """One term for each place: of equal length the best by score, of equal ones the first by namespace and id."""
    w = Window.partitionBy(key, "word").orderBy(F.desc("score"), "db", "id")
    return found.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def sentences(text: str) -> list[tuple[int, str]]:
    """(begin, sentence): parted where white space follows a full stop, a question mark or an exclamation mark."""
    out, at = [], 0
    for m in re.finditer(r"(?<=[.!?])\s+", text):
        out.append((at, text[at : m.start()]))
        at = m.end()
    return [(a, s) for a, s in [*out, (at, text[at:])] if s.strip()]


def entities(df: DataFrame, tagger: Tagger, key: str, text: str = "text", labels: tuple[str, ...] = (LABEL,)) -> DataFrame:
    """(key, sentence, entity, label, start, end, begin): entities of the wanted labels that an injected tagger finds in each
    sentence, with offsets within it; ``begin`` is where the sentence begins in the text. A sentence on which the tagger
    fails has none."""
    kind = df.schema[key].dataType.simpleString()
    columns = [key, "sentence", "entity", "label", "start", "end", "begin"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, x in zip(pdf[key], pdf[text]):
                for number, (begin, sentence) in enumerate(sentences(x or "")):
                    try:
                        found = tagger(sentence)
                    except Exception:  # one sentence's failure is that sentence's only
                        continue
                    out += [(k, number, sentence[f["start"] : f["end"]], f["label"], f["start"], f["end"], begin) for f in found if f["label"] in labels]
            yield pd.DataFrame(out, columns=columns)

    return df.select(key, text).mapInPandas(run, f"`{key}` {kind}, sentence int, entity string, label string, start int, end int, begin int")


def lexicon_tagger(terms: dict[str, str]) -> Tagger:
    """A deterministic tagger: every place of a term (to its label), case folded, whole words."""
    pattern = re.compile(r"\b(" + "|".join(re.escape(x) for x in sorted(terms, key=len, reverse=True)) + r")\b", re.IGNORECASE) if terms else None
    label = {x.lower(): y for x, y in terms.items()}

    def tag(sentence: str) -> list[dict]:
        return [{"label": label[m[0].lower()], "start": m.start(), "end": m.end()} for m in pattern.finditer(sentence)] if pattern else []

    return tag

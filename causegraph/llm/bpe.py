"""Operator 4: byte-level BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over 16 code points cuts each text into chunks, so that a passage
shared by two documents gives the same chunks in both wherever it stands.  A worker
encodes each distinct chunk once and keeps its ids in a cache of bounded size.

Cuts fall anywhere, also within words, so each join of two chunks is repaired: the text
from a seam near the left chunk's end to a seam near the right one's beginning is
encoded again.  Seams are places where two characters must belong to different
pre-tokens (before white space, or between a letter or digit and punctuation).  Each
window holds one whole stretch between seams of either chunk beside the join itself, and
counts only if its ids begin and end with exactly the ids that the chunks gave those
stretches; if not, it grows, over further chunks too where one has no seam, until they
agree.

The cache lives in the worker process; no table of chunks is shuffled.  A chunk is
encoded once per worker, and a lost executor costs only its cache.

Null texts count as empty.  An empty text has no ids.  The text of a special token
is encoded as that token, as the vocabulary's own library does by default.  Repeated
rows are encoded each for itself.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

VOCABULARY = "byte_bpe_50k.json"
#: GPT-2's published pre-tokenization pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

WINDOW, AVERAGE, LARGEST = 16, 1024, 16_384
CACHE_BYTES = 32 << 20

#: Seams: between a character that is no white space and one that is, and between a letter or digit and punctuation, among
#: characters that have been of these kinds in all versions of Unicode. Words don't end before an apostrophe's letters alone.
_SEAM = re.compile(r"(?<=\S)(?=[ \t\n\r\f\v])|(?<=[0-9A-Za-zА-Яа-яぁ-ゔァ-ヴ一-龥가-힣])(?=[!-/:-@\[-`{-~、。「」『』])")
#: So many of a chunk's last characters are searched for its last seams first.
_NEAR = 256
_LOADED: dict[str, "Codec"] = {}


def vocabulary_path(name: str) -> str:
    """A file's place: ``name`` itself if it is a path, else where public_tokenizers has it."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def codec(name: str) -> "Codec":
    if name not in _LOADED:
        _LOADED[name] = Codec(vocabulary_path(name))
    return _LOADED[name]


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write bytes as printable characters: the printable Latin-1
    ones as themselves, the others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass(frozen=True)
class Chunk:
    """``left``, the text up to the second seam, ends with a stretch of ids ``head``; ``right``, from the last seam but
    one, begins with one of ids ``tail``; ``body`` are the ids between the two."""

    left: str
    right: str
    head: bytes
    body: bytes
    tail: bytes


class Codec:
    """Encodes and decodes with one byte-level vocabulary file."""

    def __init__(self, path: str):
        import tiktoken

        spec = json.load(open(path, encoding="utf-8"))
        bytes_of = _byte_of_char()
        ranks = {bytes(bytes_of[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token in special:
            ranks.pop(token.encode(), None)
        self.merge_order(spec["model"]["merges"], spec["model"]["vocab"])
        self.bpe = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.ordinary = self.bpe._core_bpe.encode_ordinary
        self.special = {t: array("I", [i]).tobytes() for t, i in special.items()}
        self.apart = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        n = max([*ranks.values(), *special.values()]) + 1
        table = [b""] * n
        for token, i in [*ranks.items(), *((t.encode(), i) for t, i in special.items())]:
            table[i] = token
        self.lengths = np.array([len(t) for t in table], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.blob = np.frombuffer(b"".join(table), np.uint8)
        self.chunks: dict[str, Chunk | None] = {}
        self.held = 0
        self.characters = self.reused = self.again = 0  # of all chunks, of those found in the cache, of windows at joins

    @staticmethod
    def merge_order(merges: list, vocab: dict[str, int]) -> None:
        """Ids serve as merge ranks; that holds only if they rise with the merges."""
        ids = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "", 1)] for m in merges]
        if any(x >= y for x, y in zip(ids, ids[1:])):
            raise ValueError("the vocabulary's ids don't follow the order of its merges")

    def direct(self, text: str) -> bytes:
        """Ids of a text without special tokens, taken by itself."""
        return array("I", self.ordinary(text)).tobytes()

    def chunk(self, text: str) -> "Chunk | None":
        """A chunk's ids between its seams, from the cache where it has been seen; None if it has fewer than three seams."""
        self.characters += len(text)
        if text in self.chunks:
            self.reused += len(text)
            return self.chunks[text]
        first = [m.start() for _, m in zip(range(2), _SEAM.finditer(text, 1))]
        last = [m.start() for m in _SEAM.finditer(text, max(1, len(text) - _NEAR))][-2:]
        if len(first) == 2 and len(last) < 2:
            last = [m.start() for m in _SEAM.finditer(text, 1)][-2:]
        got, size = None, 0
        if len(first) == 2 and first[1] <= last[0]:
            (a, c), (d, b) = first, last
            got = Chunk(text[:c], text[d:], self.direct(text[a:c]), self.direct(text[c:d]), self.direct(text[d:b]))
            size = len(got.body)
        if self.held > CACHE_BYTES:
            self.chunks.clear()
            self.held = 0
        self.chunks[text] = got
        self.held += size + 4 * len(text) + 400
        return got

    def encode(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids of the whole text."""
        if not text:
            return b""
        if self.apart is None or not self.apart.search(text):
            return self.joined(text)
        out, at = [], 0
        for m in self.apart.finditer(text):  # special tokens part the text before anything else does
            out += [self.joined(text[at : m.start()]), self.special[m[0]]]
            at = m.end()
        return b"".join([*out, self.joined(text[at:])])

    def joined(self, text: str) -> bytes:
        """Ids of a text without special tokens, from those of its chunks."""
        out: list[bytes] = []
        begin = b""  # ids that the window's text must begin with
        window = ""
        for piece in chunks(text) if text else ():
            got = self.chunk(piece)
            if got is not None:
                found = self.direct(window + got.left)
                self.again += len(window) + len(got.left)
                if found.startswith(begin) and found.endswith(got.head):
                    out += [found, got.body]
                    window, begin = got.right, got.tail
                    continue
            window += piece
        if window:
            found = self.direct(window)
            self.again += len(window)
            if not found.startswith(begin):
                return self.direct(text)
            out.append(found)
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 bytes of the decoded text; ill-formed parts become U+FFFD."""
        if not len(ids):
            return b""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        at = np.repeat(self.starts[ids] - (ends - lengths), lengths) + np.arange(ends[-1])
        raw = self.blob[at].tobytes()
        return raw.decode("utf-8", "replace").encode() if max(raw) > 127 else raw


def chunks(text: str) -> list[str]:
    """Cut where the rolling hash of the last 16 code points has its low bits set; pieces are at most LARGEST long."""
    if len(text) <= 2 * WINDOW:
        return [text]
    h = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    m = 0x9E3779B1
    for _ in range(4):  # h[i] covers 1, 2, 4, 8, then 16 code points
        step = 1 << _
        nxt = h.copy()
        nxt[step:] += h[:-step] * np.uint32(m)
        h, m = nxt, (m * m) & 0xFFFFFFFF
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
    cuts = np.flatnonzero((h >> np.uint32(16)) % np.uint32(AVERAGE) == 0) + 1
    out, a = [], 0
    for b in [*cuts.tolist(), len(text)]:
        if b - a < 2 * WINDOW and b < len(text):
            continue
        while b - a > LARGEST:
            out.append(text[a : a + LARGEST])
            a += LARGEST
        if b > a:
            out.append(text[a:b])
        a = b
    return out


def _slices(batch: pa.RecordBatch, text: int, budget: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts have about so many bytes, so that results stay small."""
    if not batch.num_rows:
        return
    sizes = np.cumsum(np.array([len(x) if x is not None else 0 for x in batch.column(text).cast(pa.large_string()).cast(pa.large_binary()).to_pylist()]))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + budget, "right")))
        yield batch.slice(a, b - a)
        a = b


def _list(parts: list[bytes]) -> pa.Array:
    n = np.array([len(p) // 4 for p in parts], np.int64)
    values = pa.array(np.frombuffer(b"".join(parts), np.int32))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), values)


def encode_decode(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Per row: the key, ``ids`` (array of int) and ``decoded`` (those ids as text); other columns go."""

    def run(batches):
        c = codec(vocabulary)
        for batch in batches:
            for part in _slices(batch, 1):
                ids = [c.encode(t) for t in part.column(1).to_pylist()]
                decoded = [c.decode(np.frombuffer(i, np.uint32)) for i in ids]
                yield pa.RecordBatch.from_arrays([part.column(0), _list(ids), pa.array(decoded, pa.binary()).cast(pa.string())], ["key", "ids", "decoded"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, ids array<int>, decoded string").withColumnRenamed("key", key)


def op4_bpe(spark, sf_dir: str) -> DataFrame:
    from causegraph.llm.common import documents

    out = encode_decode(documents(spark, sf_dir, "doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"), digest(F.col("decoded")).alias("decoded_sha256"))

"""Operator 13: encoding and decoding with a merge-type piece vocabulary, by a table over prefixes.

A merge-type vocabulary joins neighbouring pieces, the best score first and the leftmost
of equals, until no two neighbours form a piece.  The result is unique, so every prefix of
a text has one last token, and that token follows from those of shorter prefixes: among the
pieces that end the prefix (an automaton over the vocabulary lists them) it is the one that
is the whole prefix, or that is compatible with the last token of what stands before it.
Two pieces are compatible if merging the characters of both gives just these two.  The
table holds one token a prefix, and the ids are recovered from its end backwards; no queue
of merges is kept, and a text takes time in proportion to its length, however long a word
without a break it holds.

Texts are parted first where no piece can reach across: at characters that the vocabulary
lacks, which become byte tokens, and before white space that follows something else.  A
worker keeps the ids of the stretches it has seen in a cache of bounded size.

Null texts count as empty, and an empty text has no ids.  Strings that look like control
tokens are plain text.  Equal rows are encoded each for itself, and columns other than the
key and the text are left out, whatever their names.
"""

from __future__ import annotations

import codecs
import math
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from causegraph.llm.bpe import _list, _slices, vocabulary_path

VOCABULARY = "piece_bpe_32k.model"
SPACE = "▁"
#: Stretches and compatible pairs that a worker remembers; longer stretches than LONGEST are not kept.
STRETCHES, PAIRS, LONGEST = 200_000, 500_000, 64
_LOADED: dict[str, "Pieces"] = {}

#: Each byte that is not part of a character becomes one U+FFFD.
codecs.register_error("causegraph.bytewise", lambda e: ("�", e.start + 1))


def pieces(name: str) -> "Pieces":
    if name not in _LOADED:
        _LOADED[name] = Pieces(vocabulary_path(name))
    return _LOADED[name]


class Pieces:
    """Encodes and decodes with one merge-type vocabulary file."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        table = [b""] * n
        self.bytes = [b""] * 256
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                table[i] = bytes([int(piece[3:-1], 16)])
                self.bytes[table[i][0]] = array("I", [i]).tobytes()
            elif model.is_unknown(i):
                table[i] = " ⁇ ".encode()
            elif model.is_unused(i):
                raise ValueError("the vocabulary has unused pieces")
            elif not model.is_control(i):
                self.id[piece], self.score[piece] = i, model.get_score(i)
                table[i] = piece.replace(SPACE, " ").encode()
        if not all(self.bytes):
            raise ValueError("the vocabulary has no byte tokens to fall back on")
        if any(SPACE in p.lstrip(SPACE) for p in self.id):
            raise ValueError("pieces hold white space behind other characters")
        if model.encode("a") != [self.id.get(SPACE + "a", -1)] or model.encode(" a  b") != [i for p in (SPACE, SPACE + "a", SPACE, SPACE + "b") for i in [self.id.get(p, -1)]]:
            raise ValueError("the vocabulary's texts are not taken as they are, with one space before them")
        self.spaced = {i for p, i in self.id.items() if p[0] == SPACE}
        self.lengths = np.array([len(t) for t in table], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.blob = np.frombuffer(b"".join(table), np.uint8)
        known = "".join(re.escape(p) for p in self.id if len(p) == 1 and p != SPACE)
        self.stretch = re.compile(f"{SPACE}*[{known}]+|{SPACE}+|[^{known}{SPACE}]+")
        self.ends = ahocorasick.Automaton()
        for p in self.id:
            if self.merged(p)[-1][3] == 1:  # others never come out of merges
                self.ends.add_word(p, (len(p), self.id[p]))
        self.ends.make_automaton()
        self.piece = {i: p for p, i in self.id.items()}
        self.steps: dict[int, list] = {}
        self.agree: dict[tuple[int, int], bool] = {}
        self.seen: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merged(self, text: str) -> list[tuple[float, str, str, int]]:
        """The merges done one by one: the score of each, and the first, the last and the number of pieces before it; after the last one minus infinity."""
        out, score, steps = list(text), self.score, []
        while True:
            best, at = -math.inf, -1
            for i in range(len(out) - 1):
                s = score.get(out[i] + out[i + 1])
                if s is not None and s > best:
                    best, at = s, i
            steps.append((best, out[0], out[-1], len(out)))
            if at < 0:
                return steps
            out[at : at + 2] = [out[at] + out[at + 1]]

    def edges(self, i: int) -> list[tuple[float, str, str, int]]:
        got = self.steps.get(i)
        if got is None:
            got = self.steps[i] = self.merged(self.piece[i])
        return got

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging both pieces' characters gives these two: the merges of each run side by side, and none across may come before them."""
        a, b, score = self.edges(left), self.edges(right), self.score
        i = j = 0
        while True:
            (p, _, x, _), (q, y, _, _) = a[i], b[j]
            s = score.get(x + y)
            if s is not None and s > p and s >= q:  # of equals the leftmost comes first
                return False
            if p == q == -math.inf:
                return True
            if p >= q:
                i += 1
            else:
                j += 1

    def table(self, text: str) -> list[tuple[int, int]]:
        """(length, id) of the last token of each prefix of a text of known characters; the first entry stands for none."""
        last: list = [None] * (len(text) + 1)
        last[0] = (0, -1)
        agree = self.agree
        for end, piece in self.ends.iter(text):
            if last[end + 1] is None:
                n, i = piece
                if n > end:  # it is the whole prefix
                    last[end + 1] = piece
                    continue
                pair = (last[end + 1 - n][1], i)
                good = agree.get(pair)
                if good is None:
                    if len(agree) >= PAIRS:
                        agree.clear()
                    good = agree[pair] = self.compatible(*pair)
                if good:
                    last[end + 1] = piece
        return last

    def tokens(self, stretch: str) -> bytes:
        """Ids of a stretch: from the table, its end first, or of its bytes if the vocabulary lacks its characters."""
        if stretch[0] not in self.id:
            return b"".join([self.bytes[b] for b in stretch.encode()])
        last, out, at = self.table(stretch), array("I"), len(stretch)
        while at:
            n, i = last[at]
            out.append(i)
            at -= n
        out.reverse()
        return out.tobytes()

    def remember(self, stretch: str) -> bytes:
        """Ids of a stretch that the younger half of the cache lacks; when that is full, it becomes the older one."""
        got = self.older.get(stretch)
        if got is None:
            got = self.tokens(stretch)
        if len(stretch) <= LONGEST:
            if len(self.seen) >= STRETCHES:
                self.older = self.seen.copy()
                self.seen.clear()
            self.seen[stretch] = got
        return got

    def encode(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids of the whole text."""
        if not text:
            return b""
        seen, remember = self.seen.get, self.remember
        return b"".join([seen(s) or remember(s) for s in self.stretch.findall(SPACE + text.replace(" ", SPACE))])

    def raw(self, ids: np.ndarray) -> bytes:
        """The tokens' bytes in a row."""
        if not len(ids):
            return b""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        at = np.repeat(self.starts[ids] - (ends - lengths), lengths) + np.arange(ends[-1])
        return self.blob[at].tobytes()

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 bytes of the decoded text, without the space before it; ill-formed parts become U+FFFD."""
        raw = self.raw(ids)
        if len(ids) and ids[0] in self.spaced:
            raw = raw[1:]
        return raw.decode("utf-8", "causegraph.bytewise").encode() if raw and max(raw) > 127 else raw


def encode_decode(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Per row: the key, ``ids`` (array of int) and ``decoded`` (those ids as text); other columns go."""

    def run(batches):
        c = pieces(vocabulary)
        for batch in batches:
            for part in _slices(batch, 1):
                ids = [c.encode(t) for t in part.column(1).to_pylist()]
                decoded = [c.decode(np.frombuffer(i, np.uint32)) for i in ids]
                yield pa.RecordBatch.from_arrays([part.column(0), _list(ids), pa.array(decoded, pa.binary()).cast(pa.string())], ["key", "ids", "decoded"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, ids array<int>, decoded string").withColumnRenamed("key", key)


def op13_sentencepiece(spark, sf_dir: str) -> DataFrame:
    from causegraph.llm.common import documents

    out = encode_decode(documents(spark, sf_dir, "doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"), digest(F.col("decoded")).alias("decoded_sha256"))

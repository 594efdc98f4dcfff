"""Operators 11, 12 and 13 against plain Python and the vocabularies' own libraries."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from causegraph.llm import alignment, bpe, pieces, spelling

DOC = "doc_id long, text string"
ODD = [
    (1, None), (2, ""), (None, "null key"), (None, None), (3, "a▁b"), (4, "<s>hi</s> <|endoftext|> <0x41>"), (5, "日本語 中文😀 é́ " * 50), (6, "-" * 4000 + "x" * 3001), (6, "-" * 4000 + "x" * 3001),
    (7, " \n\t "), (8, "\x00"), (9, "ab" * 4000), (10, "=*" * 5000 + "aé" * 900), (11, "same words"), (12, "same words"), (13, " " * 100 + "x" + " " * 33), (14, "word " * 40_000),
]


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=bpe.vocabulary_path(pieces.VOCABULARY))


@pytest.fixture(scope="module")
def bytewise():
    t = Tokenizer.from_file(bpe.vocabulary_path(bpe.VOCABULARY))
    t.encode_special_tokens = True
    return t


@pytest.fixture(scope="module")
def codec():
    return pieces.pieces(pieces.VOCABULARY)


def odd(spark):
    """Rows of all kinds, beside columns whose names the operators use themselves."""
    df = spark.createDataFrame(ODD, DOC)
    return df.selectExpr("*", "1 as key", "2 as a", "3 as b", "'x' as word", "4 as row", "5 as ids", "6 as n")


# 13


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" ▁ab\n<>the"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_pieces_equal_the_library(model, codec, text):
    ids = np.frombuffer(codec.encode(text), np.uint32)
    assert ids.tolist() == model.encode(text) and codec.decode(ids).decode() == model.decode(ids.tolist())


def test_pieces_of_the_vocabulary_in_a_row(model, codec):
    rng = random.Random(5)
    vocabulary = [*codec.id]
    for _ in range(4000):
        text = "".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 12))).replace(pieces.SPACE, rng.choice(" ▁"))
        assert np.frombuffer(codec.encode(text), np.uint32).tolist() == model.encode(text), text
        ids = [rng.choice((rng.randrange(3, 259), rng.randrange(259, 32_000))) for _ in range(rng.randint(0, 8))]
        assert codec.decode(np.array(ids, np.int64)).decode() == model.decode(ids), ids


def test_each_prefix_has_one_last_token(codec, model):
    """The table's entry is the only compatible one, and the last token of the prefix encoded by itself."""
    for word in ("▁unbelievable", "▁▁▁▁the", "tokenization", "▁Straßenbahn", "aaaaaaaaaaaa", "▁" * 40):
        last = codec.table(word)
        for end in range(1, len(word) + 1):
            good = [i for n, i in {p for e, p in codec.ends.iter(word[:end]) if e == end - 1} if n == end or codec.compatible(last[end - n][1], i)]
            assert good == [last[end][1]]
            whole = codec.merged(word[:end])
            assert whole[-1][2] == codec.piece[last[end][1]]


def test_compatibility_is_what_merging_gives(codec):
    rng = random.Random(6)
    ids = [*codec.piece]
    for _ in range(20_000):
        a, b = rng.choice(ids), rng.choice(ids[:3000])
        both = codec.merged(codec.piece[a] + codec.piece[b])[-1]
        assert codec.compatible(a, b) == (both[1:] == (codec.piece[a], codec.piece[b], 2))


def test_caches_are_bounded_and_change_nothing(monkeypatch, model):
    monkeypatch.setattr(pieces, "STRETCHES", 3)
    monkeypatch.setattr(pieces, "PAIRS", 5)
    c = pieces.Pieces(bpe.vocabulary_path(pieces.VOCABULARY))
    for text in ("one two three four five six one two", "seven one eight " * 20, "x" * 1000):
        assert np.frombuffer(c.encode(text), np.uint32).tolist() == model.encode(text)
        assert len(c.seen) <= 3 and len(c.older) <= 3 and len(c.agree) <= 5


def test_op13_whole_table_and_odd_rows(spark, sf, model):
    def wanted(rows):
        out = []
        for k, x in rows:
            ids = model.encode(x or "")
            out.append((k, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest()))
        return sorted(out, key=str)

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    assert sorted(map(tuple, pieces.op13_sentencepiece(spark, sf).collect()), key=str) == wanted(docs.collect())
    got = [(r.doc_id, len(r.ids), hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest(), hashlib.sha256(r.decoded.encode()).hexdigest()) for r in pieces.encode_decode(odd(spark)).collect()]
    assert sorted(got, key=str) == wanted(ODD)
    assert pieces.encode_decode(spark.createDataFrame([], DOC)).count() == 0


# 11


def aligned_plainly(rows, model, bytewise):
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}
    entry = {i: t for t, i in bytewise.get_vocab().items()}
    docs = []
    for key, text in rows:
        groups = []
        if text:
            a, b = bytewise.encode(" " + text, add_special_tokens=False).ids, model.encode(text)
            ab = [bytes(byte[c] for c in entry[i]) for i in a]
            bb = [bytes([int(model.id_to_piece(i)[3:-1], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(ab) == b"".join(bb) == (" " + text).encode():
                ea, eb = np.cumsum([*map(len, ab)]).tolist(), np.cumsum([*map(len, bb)]).tolist()
                i = j = 0
                for e in sorted({*ea} & {*eb}):
                    x, y = ea.index(e, i) + 1, eb.index(e, j) + 1
                    groups.append((a[i:x], b[j:y]))
                    i, j = x, y
        docs.append((key, groups))
    held = Counter(p for _, g in docs for p in {(x, y) for a, b in g for x in a for y in b})
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    out = []
    for key, g in docs:
        links = [(x, y) for a, b in g for x in a for y in b]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        n = (sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links))
        out.append((key, *n, hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(map(tuple, df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=str)


def test_op11_whole_table(spark, sf, model, bytewise):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(alignment.op11_token_alignment(spark, sf)) == aligned_plainly(docs, model, bytewise)


@pytest.mark.parametrize("product,broadcast", [(256, 10**6), (0, 10**6), (256, 3), (0, 3)])
def test_alignment_of_odd_rows_by_every_path(spark, model, bytewise, monkeypatch, product, broadcast):
    """Large groups by distinct ids, and counts by a join of stored tables, give what all products and a broadcast give."""
    monkeypatch.setattr(alignment, "PRODUCT", product)
    out = alignment.alignment(odd(spark), broadcast_rows=broadcast)
    assert rows_of(out) == aligned_plainly(ODD, model, bytewise)


def test_alignment_of_nothing(spark):
    assert alignment.alignment(spark.createDataFrame([], DOC)).count() == 0
    assert rows_of(alignment.alignment(spark.createDataFrame([(1, None), (2, "")], DOC))) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_alignment_runs_python_only_to_tokenise(spark):
    plan = alignment.aligned(alignment.tokenised(spark.createDataFrame(ODD, DOC)))._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall("MapInArrow", plan)) == 1 and not re.search("PythonUDF|MapInPandas|FlatMapGroups", plan)


def test_texts_are_cut_alike_alone_and_together(model, bytewise):
    """A slice's flat arrays keep texts apart: odd ones, texts without tokens between others, equal ones, in any order."""
    one, two = bpe.codec(bpe.VOCABULARY), alignment.Library(pieces.VOCABULARY)
    numbers = alignment.Decimals(max(len(one.lengths), len(two.lengths)))
    columns = lambda texts: list(zip(*[c.to_pylist() for c in alignment.cut(texts, one, two, numbers)]))
    rng = random.Random(8)
    texts = [x for _, x in ODD] + ["".join(rng.choice(["the ", "▁", "é", "日", "\n", "=*", "Ab", " 12"]) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    rng.shuffle(texts)
    assert columns([]) == [] and columns(texts) == [row for x in texts for row in columns([x])]
    for x, (n_a, n_b, n_groups, groups, ones, more) in zip(texts, columns(texts)):
        row = aligned_plainly([(1, x)], model, bytewise)[0]
        assert (n_a, n_b, n_groups) == row[1:4] and len(ones) + sum(len(g["a"]) * len(g["b"]) for g in more) == row[4]
        assert (hashlib.sha256(groups).hexdigest() if groups else "") == row[7]


def test_one_long_text_is_cut_in_bounded_room():
    """What a text needs at once is a bounded multiple of it, though the text of its groups is several times as long."""
    import tracemalloc

    one, two = bpe.codec(bpe.VOCABULARY), alignment.Library(pieces.VOCABULARY)
    numbers = alignment.Decimals(max(len(one.lengths), len(two.lengths)))
    text = " word" * 400_000
    tracemalloc.start()
    columns = alignment.cut([text], one, two, numbers)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert columns[0].to_pylist() == [400_001] and peak < 60 * len(text), peak / len(text)


def test_alignment_expands_only_groups_of_several_tokens(spark):
    """Spark's higher-order functions are interpreted: none goes over all tokens of a document, only over groups that need a product."""
    tokens = alignment.tokenised(spark.createDataFrame([(1, "same words"), (2, "日本語")], DOC))
    plan = alignment.aligned(tokens)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search("array_intersect|zip_with|array_join", plan)
    got = {r.key: r for r in tokens.collect()}
    assert len(got[1].ones) == got[1].n_a == got[1].n_b and not got[1].more and got[2].more


# 12


def variants_plainly(rows, least_length=6, least_count=5, factor=5, one_in=199):
    n = Counter()
    fold = str.maketrans(spelling.UPPER, spelling.LOWER)
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(fold)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % one_in == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= least_length and c >= least_count}

    def one_apart(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    by_length = defaultdict(list)
    for w in n:
        by_length[len(w)].append(w)
    near = {w: [x for k in (-1, 0, 1) for x in by_length[len(w) + k] if one_apart(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= factor * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), None if form[w] is None else n[form[w]]))
    return sorted(out)


def words_of(df):
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()))


def test_op12_whole_table(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = words_of(spelling.op12_spelling_variants(spark, sf))
    assert got == variants_plainly(docs) and any(r[1] for r in got)


def test_variants_of_odd_rows(spark):
    """Chains of forms, ties, swapped neighbours, doubled letters, letters outside ASCII, capitals that stay, null keys."""
    words = {"letter": 130, "lettter": 25, "letttter": 5, "leter": 5, "lettre": 130, "lettres": 26, "éééééé": 30, "ééééé": 9, "éééééÉ": 6, "abcdef": 10, "abcdeg": 50, "abcdeh": 50, "abcdefg": 5}
    rng = random.Random(2)
    rows = [(rng.randint(0, 5), w) for w, k in words.items() for _ in range(k)] + [(None, "unknown Unknown UNKNOWN unknown unknown unkown"), (3, None), (3, ""), (4, "x" * 50_000), (5, "many words " * 5000)]
    df = spark.createDataFrame(rows, DOC).selectExpr("*", "1 as word", "2 as n", "3 as key", "4 as root")
    for one_in in (199, 3):
        got = words_of(spelling.group_variants(spelling.vocabulary(spelling.misspelt(spelling.runs(df), one_in))))
        assert got == variants_plainly(rows, one_in=one_in)
    roots = {r[0]: r[2] for r in words_of(spelling.group_variants(spelling.vocabulary(spelling.misspelt(spelling.runs(df), 1 << 40))))}
    assert roots["letttter"] == "letter" and roots["abcdef"] == "abcdeg" and roots["lettres"] == "lettre"
    assert spelling.group_variants(spelling.vocabulary(spelling.misspelt(spelling.runs(spark.createDataFrame([], DOC))))).count() == 0


def test_spelling_runs_no_python(spark, sf):
    counted = spelling.vocabulary(spelling.misspelt(spelling.runs(spark.read.parquet(f"{sf}/documents.parquet"))))
    assert not re.search("Python|Pandas|Arrow", counted._jdf.queryExecution().optimizedPlan().toString())

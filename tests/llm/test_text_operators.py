"""Operators 1, 2, 3, 4, 8 and 9 on small fixtures, against plain Python."""

import hashlib
import json
import random
import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from causegraph import storage
from causegraph.llm import bpe, langid, lines, packing, quality, toxicity

DOC = "doc_id long, text string"
EDGE = ["", " ", "\n\n", "a", "it's 'RE don't", "  two  spaces \t tab\r\n", "<|endoftext|> x<|endoftext|>", "日本語 テキスト 🙂🙂", "\x00\x01", "word " * 3000, "x" * 40_000, "ab " + "é" * 3000]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(bpe.vocabulary_path(bpe.VOCABULARY))


def ids_of(tokenizer, text):
    return tokenizer.encode(text, add_special_tokens=False).ids


def test_bpe_equals_the_library_whatever_the_chunks(tokenizer, monkeypatch):
    monkeypatch.setattr(bpe, "AVERAGE", 8)  # cuts nearly everywhere
    c = bpe.Codec(bpe.vocabulary_path(bpe.VOCABULARY))
    rng = random.Random(4)
    parts = ["a", "b", " ", "  ", "\n", "é", "1", "'s", " the", "word", "<|endoftext|>", "!", "\t", "日本", "🙂", "<|end", " ", " "]
    texts = EDGE + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 150))) for _ in range(1500)]
    for t in texts:
        ids = np.frombuffer(c.encode(t), np.uint32)
        assert ids.tolist() == ids_of(tokenizer, t), t[:80]
        assert c.decode(ids).decode() == tokenizer.decode(ids.tolist(), skip_special_tokens=False) == t
    assert c.encode(None) == b"" and sum(map(len, bpe.chunks("x y " * 50_000))) == 200_000


def test_bpe_in_spark(spark, tokenizer):
    rows = [*enumerate(EDGE), (len(EDGE), None), (0, EDGE[4])]
    out = bpe.encode_decode(spark.createDataFrame(rows, DOC)).collect()
    assert sorted((r.doc_id, r.ids, r.decoded) for r in out) == sorted((i, ids_of(tokenizer, t or ""), t or "") for i, t in rows)
    assert bpe.encode_decode(spark.createDataFrame([], DOC)).count() == 0


def test_bpe_uses_chunks_again():
    """A passage within other texts is taken from the cache, also where it has no spaces; joins are a small part."""
    c = bpe.Codec(bpe.vocabulary_path(bpe.VOCABULARY))
    rng = random.Random(5)
    latin = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(6000))
    table = "\n".join("\t".join(str(rng.randrange(9999)) for _ in range(5)) for _ in range(1500))
    kana = "".join(rng.choice("あいうえおかきくけこさしすせそ日月火水木") + ("、" if k % 7 == 6 else "") for k in range(20_000))
    for passage in (latin, table, kana):
        c.encode(passage)
        c.characters = c.reused = c.again = 0
        c.encode("Another beginning; " + passage + " and another end.")
        assert c.reused > 0.8 * c.characters > 0.8 * len(passage) and c.again < 0.2 * c.characters


def brute_quality(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, repeated, dup = {}, set(), 0
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            repeated |= {i + k for i in at for k in range(3)}
    earlier = set()
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in earlier
            earlier.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(repeated)


def test_quality_measures(spark):
    rng = random.Random(3)
    texts = EDGE + [None] + ["".join(rng.choice(["a", "b", "c ", " ", "\n", "# ", "|", "the ", "\x0b"]) for _ in range(rng.randint(0, 200))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), DOC).selectExpr("*", "'clash' as n_words", "1 as _w", "2 as w", "3 as own", "4 as bullets", "5 as dots", "6 as n_lines_")
    df = df.union(df.where("doc_id < 3"))
    assert quality.measure(df).count() == len(texts) + 3
    for r in quality.measure(df).collect():
        assert (r._w, r.w, r.own, r.bullets, r.dots, r.n_lines_) == (1, 2, 3, 4, 5, 6)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_quality(texts[r.doc_id]), texts[r.doc_id]
    assert quality.measure(spark.createDataFrame([], DOC)).count() == 0


def test_quality_rules(spark):
    good = " ".join(f"the house{i} of town{i} is big{i}" for i in range(20))
    rows = [(0, good), (1, good.replace(" ", "*** ")), (2, "the of " * 60), (3, None), (4, " ".join(f"xq{i}" for i in range(90)))]
    m = quality.measure(spark.createDataFrame(rows, DOC)).withColumn("f", quality.base_failed()).withColumn("v", quality.verdict())
    assert [(r.f, r.f is False and r.v) for r in m.orderBy("doc_id").collect()] == [(False, True), (False, False), (True, False), (True, False), (False, False)]


def brute_lines(docs):
    windows, later = {}, {}
    for i, t in sorted(docs):
        own = [k for k, x in enumerate((t or "").split("\n")) if re.search(r"[^\x20\x09-\x0D]", x)]
        text = [x.strip(" \t\n\x0b\f\r") for x in (t or "").split("\n")]
        for p in range(max(len(own) - 2, min(len(own), 1))):
            w = tuple(text[k] for k in own[p : p + 3])
            if w in windows:
                later.setdefault(i, set()).update(own[p : p + 3])
            windows.setdefault(w, (i, p))
    return {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in later.get(i, ())) for i, t in docs}


def test_line_dedup(spark):
    rng = random.Random(2)
    pool = [f"line {k}" for k in range(8)] + ["", "  "]
    docs = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 12)))) for i in range(120)] + [(500, None), (501, ""), (502, "line 1"), (503, " line 1 ")]
    long = "\n".join(f"line of a very long text {k}" for k in range(60_000))
    docs += [(600, long), (601, "new\n" + long + "\nend")]
    df = spark.createDataFrame(docs, DOC).selectExpr("*", "7 as n_lines", "'x' as a", "'y' as pos", "1 as key", "2 as _key", "3 as own", "4 as begin", "5 as lines", "6 as at", "7 as gone", "8 as _lines")
    found = lines.remove_repeats(df)
    assert set(found.columns) == {*df.columns, "n_removed"}
    out = found.collect()
    assert {(r.key, r._key, r.own, r.begin, r.lines, r.at, r.gone, r._lines) for r in out} == {(1, 2, 3, 4, 5, 6, 7, 8)}
    assert {r.doc_id: r.text for r in out} == brute_lines(docs) and len(out) == len(docs)
    assert {r.a for r in out} == {"x"}
    assert lines.remove_repeats(spark.createDataFrame([], DOC)).count() == 0


def test_line_dedup_of_a_document_given_twice(spark):
    out = lines.remove_repeats(spark.createDataFrame([(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "a\nb\nc\nd")], DOC)).orderBy("doc_id").collect()
    assert [r.text for r in out] == ["a\nb\nc", "a\nb\nc", "d"]


def test_line_dedup_leaves_rows_without_a_key_alone(spark):
    out = lines.remove_repeats(spark.createDataFrame([(None, "a\nb\nc"), (1, "a\nb\nc"), (2, "a\nb\nc\nd"), (None, "a\nb\nc"), (None, None)], DOC)).collect()
    assert sorted((r.doc_id or 0, r.text or "", r.n_removed) for r in out) == [(0, "", 0), (0, "a\nb\nc", 0), (0, "a\nb\nc", 0), (1, "a\nb\nc", 0), (2, "d", 3)]


LANGS = {"en": "the house and of this is with that have from".split(), "de": "der haus und von dies ist mit dass haben aus".split(), "fr": "le maison et de cela est avec que avoir sur".split()}


def language_rows(n=240):
    rng = random.Random(8)
    return [(i, " ".join(rng.choice(LANGS[g]) for _ in range(30)), g) for i in range(n) for g in [list(LANGS)[i % 3]]]


def test_language_id(spark):
    rows = language_rows() + [(900, None, "en"), (901, "", "de"), (902, "123 !?", "fr"), (903, "the house and of this", None), (904, "le maison et " * 30_000, "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df, ~langid.held_out())
    out = {r.doc_id: r for r in langid.identify(df.selectExpr("*", "9 as score", "1 as _text_").withColumn("held", langid.held_out()), model).collect()}
    assert len(out) == len(rows)
    assert all(r.held == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in out.items())
    held = [r for i, r in out.items() if i < 900 and r.held]
    assert len(held) > 30 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in out.values())
    assert [out[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and out[903].lang_pred == "en" and out[904].lang_pred == "fr"


def test_language_id_without_rows_or_with_one_language(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = langid.train(empty, ~langid.held_out())
    assert langid.identify(empty, model).count() == 0 and model.predict("some text") == ("und", 0.0)
    one = spark.createDataFrame([(i, "some text", "xx") for i in range(20)], "doc_id long, text string, lang string")
    assert langid.train(one, ~langid.held_out()).predict("other") == ("xx", 1.0)


def test_language_id_against_dense_arithmetic():
    """The same leader, step by step, on dense vectors; and scores by hand."""
    rng = np.random.default_rng(4)
    d, names = 40, ["a", "b", "c"]
    labels = [names[i % 3] for i in range(60)]
    rows = []
    for i in range(60):
        n = np.zeros(d, int)
        n[rng.integers(0, 10, 6) + 10 * (i % 3)] += rng.integers(1, 5, 6)
        n[30 + rng.integers(0, 10, 3)] += 1
        rows.append((np.flatnonzero(n), n[np.flatnonzero(n)]))
    idf = rng.uniform(1, 3, d)
    model = langid.fit(rows, labels, idf)
    x = np.zeros((60, d))
    for i, (at, n) in enumerate(rows):
        x[i, at] = np.log1p(n) * idf[at]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = np.array([names.index(v) for v in labels])
    z, n, zb, nb = np.zeros((d, 3)), np.zeros((d, 3)), np.zeros(3), np.zeros(3)

    def weights(z, n, l1):
        return np.where(np.abs(z) <= l1, 0, -(z - np.sign(z) * l1) / ((langid.BETA + np.sqrt(n)) / langid.ALPHA + langid.L2))

    back = np.array([sum(labels[j] == labels[i] for j in range(i + 1)) % langid.HELD_BACK == 0 for i in range(60)])
    order = np.random.default_rng(8)
    for _ in range(langid.EPOCHS):
        for i in order.permutation(np.flatnonzero(~back)):
            w, b = weights(z, n, langid.L1), weights(zb, nb, 0.0)
            p = np.exp(x[i] @ w + b)
            g = p / p.sum() - np.eye(3)[y[i]]
            for j in range(d):
                for k in range(3):
                    gjk = x[i, j] * g[k]
                    z[j, k] += gjk - (np.sqrt(n[j, k] + gjk**2) - np.sqrt(n[j, k])) / langid.ALPHA * w[j, k]
                    n[j, k] += gjk**2
            zb += g - (np.sqrt(nb + g * g) - np.sqrt(nb)) / langid.ALPHA * b
            nb += g * g
    assert np.allclose(model.weights, weights(z, n, langid.L1)) and np.allclose(model.bias, weights(zb, nb, 0.0))
    assert 0.199 < model.temperature < 5.001
    p = np.exp((x[0] @ model.weights + model.bias) / model.temperature)
    got = np.exp(model.logits(*rows[0]) / model.temperature)
    assert np.allclose(got / got.sum(), p / p.sum())


def test_language_id_of_ties_and_repeated_rows(spark):
    rows = [(i, "same text", g) for i in range(60) for g in ("xx", "yy")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df, ~langid.held_out())
    out = langid.identify(df, model).collect()
    assert len(out) == 240 and len({(r.lang_pred, r.score) for r in out}) == 1 and out[0].lang_pred in ("xx", "yy")
    flat = langid.Model(["xx", "yy"], np.zeros((langid.BUCKETS, 2)), np.zeros(2), np.ones(langid.BUCKETS), 1.0)
    assert flat.predict("same text") == ("xx", 0.5)


def test_language_id_learns_a_rare_language_of_a_large_table(spark):
    rng = random.Random(9)
    common = {g: LANGS[g] for g in ("en", "de")}
    rows = [(i, " ".join(rng.choice(common[g]) for _ in range(12)), g) for i in range(3000) for g in [("en", "de")[i % 2]]]
    rows += [(5000 + i, " ".join(rng.choice(LANGS["fr"]) for _ in range(12)), "fr") for i in range(30)]
    rows += [(9000, "zyx wvu", "xx")] * 900  # one key and text for all rows of a language
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df, ~(df.doc_id < 0), train_rows=20)
    assert model.langs == ["de", "en", "fr", "xx"]
    assert [model.predict(" ".join(w))[0] for w in LANGS.values()] == ["en", "de", "fr"] and model.predict("zyx wvu")[0] == "xx"


def terms_of(words):
    return np.array(sorted({t for w in words for t in toxicity.buckets_of(w)}), np.int64)


@pytest.mark.parametrize("label", [lambda a, b: a != b, lambda a, b: a and b], ids=["xor", "and"])
def test_toxicity_learns_pairs(label):
    """One of two words, or both of them, among words that say nothing. Where exactly one makes a text toxic, neither says
    anything alone: a line of weights stays at chance."""
    rng = random.Random(1)
    noise = [f"n{k}oise{k * 7}" for k in range(200)]
    texts, y = [], []
    for _ in range(3000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        texts.append(rng.sample(noise, 15) + ["insultus"] * a + ["groupia"] * b)
        y.append(float(label(a, b)))
    x, y = [terms_of(t) for t in texts], np.array(y)
    m = toxicity.fit(x[:2200], y[:2200])
    right = lambda m: np.mean([(m.score(" ".join(t)) >= 0.5) == z for t, z in zip(texts[2200:], y[2200:])])
    assert right(m) > 0.9 and len(m.place) <= 8
    if label(True, False):
        m.factors[:] = 0
        additive = toxicity.Model(m.place, m.bias, m.weights, m.factors)
        weights = np.linalg.lstsq(np.array([[1.0, "insultus" in t, "groupia" in t] for t in texts[:2200]]), y[:2200], rcond=None)[0]
        guess = np.array([[1.0, "insultus" in t, "groupia" in t] for t in texts[2200:]]) @ weights >= 0.5
        assert np.mean(guess == y[2200:]) < 0.6 and right(additive) < 0.8


def test_toxicity_score_is_the_sum_over_all_pairs():
    rng = np.random.default_rng(2)
    words = [f"word{k}" for k in range(30)]
    place = {b: i for i, b in enumerate(sorted({b for w in words for b in toxicity.buckets_of(w)}))}
    m = toxicity.Model(place, -0.3, rng.normal(size=len(place)), rng.normal(size=(len(place), 8)))
    for n in (0, 1, 2, 9, 30):
        text = " ".join(rng.choice(words, n, replace=False)).upper() + ", unknown"
        at = sorted({place[b] for w in text.lower().split() for b in toxicity.buckets_of(w) if b in place})
        z = m.bias + sum(m.weights[i] for i in at) + sum(float(m.factors[i] @ m.factors[j]) for k, i in enumerate(at) for j in at[:k])
        assert abs(m.score(text) - 1 / (1 + np.exp(-z))) < 1e-9


def test_toxicity(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("abcdefgh") * rng.randint(2, 6) for _ in range(40)) + (f" vilewort{i % 9}" if i % 6 == 0 else ""), i % 6 == 0) for i in range(600)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(700, None), (701, ""), (702, "calm " * 50_000 + "vilewort")], DOC)
    labels = spark.createDataFrame([(i, int(y)) for i, _, y in rows] + [(700, None), (9999, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, ~toxicity.held_out())
    out = {r.doc_id: r.score for r in toxicity.score(docs.selectExpr("*", "'x' as score", "0 as y"), model).collect()}
    held = [(out[i], y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 80 and all((s >= 0.5) == y for s, y in held)
    assert out[700] == out[701] < 0.5 < out[702]
    twice = toxicity.train(docs.union(docs), labels.union(labels), ~toxicity.held_out())
    assert twice.score(None) < 0.5 < twice.score("calm vilewort3")
    assert toxicity.score(docs.where("false"), model).count() == 0 and toxicity.train(docs.where("false"), labels, ~toxicity.held_out()).score("") < 0.01
    none = toxicity.train(docs, labels.where("false"), ~toxicity.held_out())
    assert none.score("vilewort") < 0.01
    assert toxicity.train(docs, labels.where("toxic = 1"), ~toxicity.held_out()).score("") > 0.99


@pytest.mark.parametrize("lengths", [{}, {1: 5000}, {2048: 3, 2047: 2, 1: 7}, {n: 1 + n % 7 for n in range(1, 2049)}, {700: 40, 648: 40, 100: 3}])
def test_packing_plan(lengths):
    seen, placed = {}, {}
    for length, a, z, seq, offset, per in packing.plan(lengths):
        seen.setdefault(length, []).append((a, z))
        for r in range(a, z):
            placed.setdefault(seq + (r - a) // per, []).append((offset + (r - a) % per * length, length))
    for length, n in lengths.items():
        at = 0
        for a, z in sorted(seen.get(length, [])):
            assert a == at
            at = z
        assert at == n
    for slots in placed.values():
        end = 0
        for offset, length in sorted(slots):
            assert offset == end
            end += length
        assert end <= 2048
    total = sum(x * n for x, n in lengths.items())
    assert len(placed) <= 1.02 * total / 2048 + 2


def test_nnls_against_the_conditions():
    rng = np.random.default_rng(9)
    rows = np.array([(a, b, c) for a in range(1, 30) for b in range(1, a + 1) for c in (29 - a - b,) if 1 <= c <= b])
    h = rng.integers(0, 500, 31).astype(float)
    x = packing.nnls(rows, h, 1e-9)
    a = np.stack([np.bincount(r, minlength=31) for r in rows], 1)
    slope = a.T @ (h - a @ x)
    assert x.min() >= 0 and slope.max() < 1e-3 and np.abs(slope[x > 1e-9]).max() < 1e-3


def test_packing_in_spark(spark, tokenizer):
    rng = random.Random(6)
    texts = EDGE + [None] + [" ".join(rng.choice(["one", "two", "three", "four"]) for _ in range(rng.choice([3, 40, 700, 3000]))) for _ in range(60)]
    rows = list(enumerate(texts)) + [(5000 + i, "copy") for i in range(300)]
    out = packing.pack_documents(spark.createDataFrame(rows, DOC).selectExpr("*", "'z' as length", "3 as offset")).collect()
    by_doc, by_seq = {}, {}
    for r in out:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert len(by_doc) == len(rows)
    for i, t in rows:
        ids = ids_of(tokenizer, t or "") + [0]
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces))) and sum(r.length for r in pieces) == len(ids)
        assert all(r.length == 2048 for r in pieces[1:]) and (len(ids) <= 2048) == (len(pieces) == 1)
        for r in pieces:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    for rs in by_seq.values():
        end = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == end
            end += r.length
        assert end <= 2048
    assert packing.pack_documents(spark.createDataFrame([], DOC)).count() == 0


def test_packing_of_repeated_ids(spark):
    rows = [(7, "same")] * 500 + [(None, "null key")] * 3 + [(7, None)]
    df = spark.createDataFrame(rows, DOC).selectExpr("*", "1 as row", "2 as rank", "3 as seq")
    out = packing.pack_documents(df).collect()
    assert len(out) == 504 and len({(r.sequence_id, r.offset) for r in out}) == 504


def test_queries_by_name(spark, sf):
    """The registered queries whose results are checked by brute force elsewhere: one row per document, as their contracts say."""
    ids = sorted(r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    for query, columns in ((toxicity.op1_toxicity, ["doc_id", "held_out", "score", "predicted"]), (langid.op8_language_id, ["doc_id", "held_out", "lang_pred", "score"])):
        out = query(spark, sf)
        assert out.columns == columns and sorted(r.doc_id for r in out.collect()) == ids
    out = packing.op9_best_fit_packing(spark, sf)
    assert out.columns == ["length", "doc_id", "piece", "start", "ids_crc32", "sequence_id", "offset"] or set(out.columns) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
    assert sorted({r.doc_id for r in out.collect()}) == ids


def test_digests(spark, tokenizer, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in bpe.op4_bpe(spark, sf).collect():
        ids = ids_of(tokenizer, docs[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((docs[r.doc_id] or "").encode()).hexdigest())
    assert json.load(open(bpe.vocabulary_path(bpe.VOCABULARY)))["model"]["type"] == "BPE"


def test_a_window_that_half_of_the_rows_hold_is_split(spark):
    """The join that finds later windows splits a hot key over several tasks."""
    conf = {"autoBroadcastJoinThreshold": "-1", "adaptive.advisoryPartitionSizeInBytes": "8k", "adaptive.skewJoin.skewedPartitionThresholdInBytes": "10k", "adaptive.skewJoin.skewedPartitionFactor": "1.1", "adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(f"spark.sql.{k}") for k in conf}
    df = spark.range(20_000).selectExpr("id as doc_id", "if(id % 2 = 0, 'a\nb\nc', concat('x', id, '\ny', id, '\nz', id)) as text").repartition(8)
    try:
        for k, v in conf.items():
            spark.conf.set(f"spark.sql.{k}", v)
        later = lines.repeated(storage.stored(lines.windows(df), "windows"))
        assert len(later.collect()) == 9_999
        assert "skew=true" in later._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(f"spark.sql.{k}", v)

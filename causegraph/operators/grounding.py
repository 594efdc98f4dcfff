"""Text to graph terms: extraction, vector retrieval, re-ranking, spans, labels."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, Window

from causegraph.functions import edit, text as t
from causegraph.operators import similar
from causegraph.storage import stored

TOP_K, LEAST_SIMILARITY = 10, 0.0


def unit(vectors: Column) -> Column:
    """Scaled to length 1 in double precision; zero vectors stay."""
    norm = lambda d: F.sqrt(F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x))
    scaled = lambda d: t.let(norm(d), lambda n: F.when(n > 0, F.transform(d, lambda x: x / n)).otherwise(d))
    return t.let(F.transform(vectors, lambda x: x.cast("double")), scaled)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def vector_dimension(nodes: DataFrame, label: str, prop: str = "embedding") -> int | None:
    """Length of the first vector of a label's nodes, None without one."""
    row = nodes.where((F.col("label") == label) & F.col(prop).isNotNull()).select(F.size(prop).alias("n")).limit(1).first()
    return row.n if row else None


def vector_index(nodes: DataFrame, label: str, prop: str = "embedding") -> DataFrame | None:
    """Unit vectors of a label's nodes (id, name, vector), None if it has none."""
    if vector_dimension(nodes, label, prop) is None:
        return None
    return nodes.where((F.col("label") == label) & F.col(prop).isNotNull()).select("id", "name", unit(F.col(prop)).alias("vector"))


def _block_top_k(pdf: pd.DataFrame, k: int) -> pd.DataFrame:
    asked = pdf["c"].isna()
    q, c = pdf[asked].sort_values("q"), pdf[~asked].sort_values("c")
    if not len(q) or not len(c):
        return pd.DataFrame({"q": q["q"][:0], "c": c["c"][:0], "cosine": np.zeros(0)})
    m, x = np.stack(q["vector"]).astype(float), np.stack(c["vector"]).astype(float)
    out = []
    for a in range(0, len(q), 512):
        s = m[a : a + 512] @ x.T
        best = np.argsort(-s, axis=1, kind="stable")[:, :k]
        rows = np.repeat(np.arange(len(s)), best.shape[1])
        out.append(pd.DataFrame({"q": q["q"].to_numpy()[a : a + 512][rows], "c": c["c"].to_numpy()[best.ravel()], "cosine": s[rows, best.ravel()]}))
    return pd.concat(out).astype({"q": q["q"].dtype, "c": c["c"].dtype})


def top_k(queries: DataFrame, index: DataFrame, k: int = TOP_K, least: float = LEAST_SIMILARITY, query_block: int = 4096, index_block: int = 8192) -> DataFrame:
    """(q, c, rank, cosine): for each query (q, vector) the k most similar rows of the index (c, vector), ties by c.

    Exact.  Both sides are dealt into blocks of bounded size; a task compares one block
    of each and keeps k candidates per query, and only these are ranked.  The rescaled
    cosine (1 + cos) / 2 must reach ``least``, after the k were chosen.
    """
    nq, ni = max(1, -(-queries.count() // query_block)), max(1, -(-index.count() // index_block))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    vector = F.transform("vector", lambda x: x.cast("double")).alias("vector")
    qk, ck = queries.schema["q"].dataType, index.schema["c"].dataType
    a = queries.select("q", F.lit(None).cast(ck).alias("c"), vector, block("q", nq).alias("i"), every(ni).alias("j"))
    b = index.select(F.lit(None).cast(qk).alias("q"), "c", vector, every(nq).alias("i"), block("c", ni).alias("j"))
    near = a.unionByName(b).groupBy("i", "j").applyInPandas(lambda pdf: _block_top_k(pdf, k), f"q {qk.simpleString()}, c {ck.simpleString()}, cosine double")
    w = Window.partitionBy("q").orderBy(F.desc("cosine"), "c")
    out = near.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)
    return out.where((1 + F.col("cosine")) / 2 >= least).select("q", "c", "rank", "cosine")


def rerank(retrieved: DataFrame, ranked: DataFrame, key: str = "q") -> DataFrame:
    """retrieved: key, id, name, score; ranked: key, ids (array in the order wanted). Unknown ids go, the first of
    repeated ones counts, and scores come back from retrieval."""
    order = ranked.select(key, F.posexplode("ids").alias("pos", "id")).groupBy(key, "id").agg(F.min("pos").alias("pos"))
    out = retrieved.join(order, [key, "id"])
    w = Window.partitionBy(key).orderBy("pos")
    return out.withColumn("pos", F.row_number().over(w).cast("long")).select(key, "id", "name", "pos", F.coalesce("score", F.lit(0.0)).alias("score"))


def _plain_words(c: Column) -> Column:
    return t.tokens(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def exact_spans(texts: DataFrame, evidence: DataFrame) -> DataFrame:
    """(item, doc, start, end) of the first place, case folded, of each item (item, needle) in each text (doc, text) that holds it.

    Items and texts meet on keys rather than each with each: a needle's longest inner word,
    or, where it has none, its first characters, three at most.
    """
    words = _plain_words(F.col("needle"))
    inner = F.slice(words, F.lit(2), F.greatest(F.lit(0), F.size(words) - 2))
    longest = F.array_max(F.transform(inner, lambda x: F.struct(F.length(x).alias("n"), x.alias("w"))))["w"]
    needle = F.lower(F.trim("needle"))
    key = F.coalesce(F.concat(F.lit("w"), longest), F.concat(F.least(F.lit(3), F.length(needle)).cast("string"), F.substring(needle, 1, 3)))
    # a table of its own, met in a single join on words, so that Spark splits the frequent ones
    e = stored(evidence.where(F.trim("needle") != "").select("item", needle.alias("needle"), key.alias("word")), "wanted")
    lengths = sorted(r[0] for r in e.where("word not like 'w%'").select(F.substring("word", 1, 1)).distinct().collect())  # of 1, 2, 3
    d = texts.select("doc", F.lower("text").alias("text"))
    parts = [F.transform(F.array_distinct(_plain_words(F.col("text"))), lambda x: F.concat(F.lit("w"), x))]
    for n in lengths:
        last = F.length("text") - (int(n) - 1)
        grams = F.transform(F.when(last > 0, F.sequence(F.lit(1), last)), lambda i: F.concat(F.lit(n), F.substr("text", i, F.lit(int(n)))))
        parts.append(F.coalesce(F.array_distinct(grams), F.array().cast("array<string>")))
    pairs = d.select("doc", F.explode(F.concat(*parts)).alias("word")).join(e, "word").select("doc", "item", "needle")
    at = F.expr("locate(needle, text)")
    return pairs.join(d, "doc").withColumn("_at", at).where("_at > 0").select("item", "doc", (F.col("_at") - 1).cast("long").alias("start"), (F.col("_at") - 1 + F.length("needle")).cast("long").alias("end"))


#: Up to so many blocks of needles are sent along with the function.
BLOCKS = 64


def search_spans(texts: DataFrame, evidence: DataFrame, least: float = 0.7, block: int = 256) -> DataFrame:
    """(item, doc, start, end, kind, text, similarity): where each item (item, needle) stands in each text (doc, text), exactly
    or at the most similar place of at least ``least``, for every pair that has one.

    The items are a set of queries that every text is held against, dealt out in blocks; a text is read once for a block.
    Runs of words are compared only if bounds that are proven allow them the ratio, so nothing is lost, short needles included.
    """
    e = stored(evidence.where(F.trim("needle") != "").select("item", "needle"), "needles")
    n = max(1, -(-e.count() // block))
    number = F.pmod(F.xxhash64(F.lit(6), "item"), F.lit(n)).cast("int")
    blocks = e.groupBy(number.alias("block")).agg(F.collect_list(F.struct("item", "needle")).alias("needles"))
    blocks = stored(blocks, "blocks")
    dealt = texts.select("doc", "text", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block"))
    parts = dealt.sparkSession.sparkContext.defaultParallelism * 4
    if n <= BLOCKS:  # the function holds the needles, so that texts travel without them
        known = {r["block"]: [x["needle"] for x in r["needles"]] for r in blocks.collect()}
        found = dealt.repartition(parts, "doc", "block").select("doc", "block", F.explode(edit.block_spans(known, least)(F.col("text"), F.col("block"))).alias("s"))
        items = blocks.select("block", F.posexplode("needles").alias("i", "n")).select("block", "i", F.col("n.item").alias("item"))
        found = found.select("doc", "block", "s.*").join(F.broadcast(items), ["block", "i"])
        return found.select("item", "doc", "start", "end", "kind", "text", "similarity")
    found = dealt.join(blocks, "block").repartition(parts, "doc", "block")
    found = found.select("doc", "needles", F.explode(edit.needle_spans(least)(F.col("text"), F.transform("needles", lambda x: x["needle"]))).alias("s"))
    return found.select(F.get("needles", F.col("s.i"))["item"].alias("item"), "doc", "s.start", "s.end", "s.kind", "s.text", "s.similarity")


def find_spans(df: DataFrame, text: str = "text", evidences: str = "evidences", least: float = 0.7, case_sensitive: bool = False) -> DataFrame:
    """Adds ``spans``, exact then fuzzy, per row."""
    return df.withColumn("spans", edit.evidence_spans(least, case_sensitive)(F.col(text), F.col(evidences)))


def match_labels(df: DataFrame, labels: list[str], codes: dict[str, str], name: str = "cause_name", cutoff: float = 0.85) -> DataFrame:
    """Adds ``matched`` (an allowed label: exact, else but for case, else fuzzy) and ``code``. Rows without one keep NULL."""
    x = F.trim(F.coalesce(F.col(name), F.lit("")))
    exact = F.when(x.isin(labels), x)
    folded = t.lookup({v.lower(): v for v in labels}, F.lower(x))
    firm = df.withColumn("_firm", F.when(x != "", F.coalesce(exact, folded)))
    allowed = df.sparkSession.createDataFrame([(v,) for v in labels], "label string")
    near = similar.closest(firm.where(F.col("_firm").isNull()).select(x.alias("name")), allowed, cutoff)
    odd = near.select(F.col("name").alias("_x"), F.col("label").alias("_near"))
    out = firm.withColumn("_x", x).join(odd, "_x", "left").withColumn("matched", F.coalesce("_firm", "_near")).drop("_firm", "_near", "_x")
    return out.withColumn("code", t.lookup(codes, "matched"))


def cause_map(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """Per key a map from ``icd10:<code>`` to struct(name, identifiers, score); a later label of the same code replaces it."""
    known = df.where("code is not null")
    last = known.groupBy(*key, "code").agg(F.max_by(F.struct("matched", "probability"), order).alias("v"), F.min(order).alias("_o"))
    entry = F.struct(t.curie("icd10", "code").alias("key"), F.struct(F.col("v.matched").alias("name"), F.create_map(F.lit("icd10"), F.col("code")).alias("identifiers"), F.col("v.probability").alias("score")).alias("value"))
    ordered = F.array_sort(F.collect_list(F.struct(F.col("_o"), F.col("code"), F.to_json(entry).alias("j"))))
    kind = "key string, value struct<name:string,identifiers:map<string,string>,score:double>"
    return last.groupBy(*key).agg(F.map_from_entries(F.transform(ordered, lambda s: F.from_json(s["j"], kind))).alias("causes"))


@dataclass(frozen=True)
class Settings:
    """A grounder's configuration."""

    extractor: str = "lexicon"
    encoder: str = "hashing"
    label: str = "icd10"
    top_k: int = TOP_K
    min_similarity: float = LEAST_SIMILARITY
    rerank: bool = True


CONCEPT = "array<struct<concept:string,supporting_evidence:array<string>,start:int,end:int>>"


def extract(df: DataFrame, client: Callable[[str], list[dict]], text: str = "text") -> DataFrame:
    """Adds ``concepts`` by an injected client; blank texts have none, and neither has a text on which the client fails."""

    @F.pandas_udf(CONCEPT)
    def run(texts: pd.Series) -> pd.Series:
        def one(x):
            if not x or not x.strip():
                return []
            try:
                found = client(x)
            except Exception:  # one text's failure is that text's only
                return []
            good = [c for c in found if isinstance(c, dict) and c.get("concept")]
            return [{"concept": c["concept"], "supporting_evidence": [e for e in c.get("supporting_evidence") or [] if e], "start": c.get("start"), "end": c.get("end")} for c in good]

        return texts.map(one)

    return df.withColumn("concepts", run(F.col(text)))


def lexicon_client(terms: list[str]) -> Callable[[str], list[dict]]:
    """A deterministic extractor: terms found in the text, at their first place."""

    def client(x: str) -> list[dict]:
        low = x.lower()
        return [{"concept": w, "supporting_evidence": [x[a : a + len(w)]], "start": a, "end": a + len(w)} for w in terms if (a := low.find(w.lower())) >= 0]

    return client


def hashing_encoder(dim: int = 64) -> Callable[[str], np.ndarray]:
    """A deterministic encoder: hashed words, unit length."""
    import zlib

    def encode(x: str) -> np.ndarray:
        v = np.zeros(dim)
        for w in (x or "").lower().split():
            h = zlib.crc32(w.encode())
            v[h % dim] += 1 if h & 1 << 20 else -1
        n = np.linalg.norm(v)
        return v / n if n else v

    return encode


def embed(df: DataFrame, column: str, encode: Callable[[str], np.ndarray], out: str = "embedding") -> DataFrame:
    """Adds vectors of a text column (null: empty)."""

    @F.pandas_udf("array<double>")
    def run(xs: pd.Series) -> pd.Series:
        return pd.Series([encode(x or "") for x in xs])

    return df.withColumn(out, run(F.col(column)))


def ground(df: DataFrame, key: str, index: DataFrame, client: Callable, encode: Callable, settings: Settings = Settings(), reorder: Callable | None = None) -> DataFrame:
    """Per concept: key, concept, supporting_evidence, start, end and matches (array of struct<id, name, score>, best first)."""
    concepts = extract(df, client).select(key, "text", F.posexplode("concepts").alias("n", "c"))
    flat = concepts.select(key, "text", F.concat_ws("#", F.col(key).cast("string"), F.col("n").cast("string")).alias("q"), "c.*")
    queries = embed(flat.withColumn("_t", t.retrieval_text("concept", "supporting_evidence")), "_t", encode, "vector").select("q", "vector")
    near = top_k(queries, index.select(F.col("id").alias("c"), "vector"), settings.top_k, settings.min_similarity)
    named = near.join(index.select(F.col("id").alias("c"), "name"), "c").select("q", F.col("c").alias("id"), t.display("name", "c").alias("name"), F.col("rank").alias("pos"), F.col("cosine").alias("score"))
    if settings.rerank and reorder is not None:
        named = rerank(named.drop("pos"), reorder(named))
    matches = named.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("pos", "id", "name", "score"))).alias("m"))
    matches = matches.select("q", F.transform("m", lambda m: F.struct(m["id"].alias("id"), m["name"].alias("name"), m["score"].alias("score"))).alias("matches"))
    return flat.join(matches, "q", "left").drop("q")


class Grounder:
    """Grounds texts by components that its settings name: an extractor and an encoder from the given makers, and the index
    of the nodes with the settings' label. ``update`` makes anew only what a changed setting concerns."""

    def __init__(self, settings: Settings, nodes: DataFrame, extractors: dict[str, Callable], encoders: dict[str, Callable], reorder: Callable | None = None):
        self.nodes, self.makers, self.reorder = nodes, {"extractor": extractors, "encoder": encoders}, reorder
        self.settings = settings
        self.made: dict[str, object] = {}
        self._make(("extractor", "encoder", "label"))

    def _make(self, names) -> None:
        for name in names:
            wanted = getattr(self.settings, name)
            if name == "label":
                self.made[name] = vector_index(self.nodes, wanted)
                if self.made[name] is None:
                    raise ValueError(f"no vectors of {wanted!r}")
            elif wanted not in self.makers[name]:
                raise ValueError(f"no {name} {wanted!r}")
            else:
                self.made[name] = self.makers[name][wanted]()

    def update(self, **changes) -> "Grounder":
        before = self.settings
        self.settings = replace(before, **changes)
        self._make([n for n in ("extractor", "encoder", "label") if getattr(before, n) != getattr(self.settings, n)])
        return self

    def process(self, df: DataFrame, key: str) -> DataFrame:
        return ground(df, key, self.made["label"], self.made["extractor"], self.made["encoder"], self.settings, self.reorder)

    def ground(self, df: DataFrame, key: str) -> DataFrame:
        return first_matches(self.process(df, key), key)

    def annotate(self, df: DataFrame, key: str, highlight: str = "evidence") -> DataFrame:
        return annotate(self.process(df, key), key, highlight)


def structured(annotations: Column) -> Column:
    """(text, curie, name) of each annotation's best match; those without one go."""
    good = F.filter(annotations, lambda a: F.size(a["matches"]) > 0)
    return F.transform(good, lambda a: F.struct(a["text"].alias("text"), F.get(a["matches"], 0)["id"].alias("curie"), F.get(a["matches"], 0)["name"].alias("name")))


def first_matches(grounded: DataFrame, key: str) -> DataFrame:
    """The best match of each concept."""
    return grounded.select(key, "concept", F.try_element_at("matches", F.lit(1)).alias("match")).where("match is not null")


def annotate(grounded: DataFrame, key: str, highlight: str = "evidence") -> DataFrame:
    """Annotations (text, start, end, matches) of each concept's evidence, or of the concept's own place; concepts don't share their overlaps."""
    if highlight == "concept":
        spans = grounded.select(key, F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")).alias("text"), "start", "end", "matches", F.length("text").alias("_n"))
    else:
        s = find_spans(grounded, "text", "supporting_evidence").select(key, F.explode("spans").alias("s"), "matches", F.length("text").alias("_n"))
        spans = s.select(key, "s.text", "s.start", "s.end", "matches", "_n")
    return spans.where("start >= 0 and end <= _n and end > start").drop("_n")


def rendered(annotations: Column) -> Column:
    """``text = curie (name)`` for each annotation with a match."""
    good = F.filter(annotations, lambda a: F.size(a["matches"]) > 0)
    return F.transform(good, lambda a: F.concat(a["text"], F.lit(" = "), F.get(a["matches"], 0)["id"], F.lit(" ("), F.get(a["matches"], 0)["name"], F.lit(")")))

"""Queries on single functions of text, audio and dialogue, and on live sessions as streams."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession, functions as F

from causegraph.catalog import query, table
from causegraph.functions import audio, edit, text as t
from causegraph.operators import dialogue, evaluate, grounding
from causegraph.plans import inference
from causegraph.plans.dialogue_queries import streamed

C = F.col


@query(
    "fn_partition",
    "SELECT p_partkey AS id, CASE WHEN contains(x, ' ') THEN split_part(x, ' ', 1) ELSE x END AS before, contains(x, ' ') AS found, CASE WHEN contains(x, ' ') THEN substr(x, strpos(x, ' ') + 1) ELSE '' END AS after, replace('- - ' || x, '- ', '') AS title FROM (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_type ELSE replace(p_type, ' ', '') END AS x FROM part)",
)
def fn_partition(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").withColumn("x", F.when(C("p_size") % 2 == 0, C("p_type")).otherwise(F.replace("p_type", F.lit(" "), F.lit(""))))
    before, found, after = t.partition("x", " ")
    return p.select(C("p_partkey").alias("id"), before.alias("before"), found.alias("found"), after.alias("after"), t.tabulation_title(F.concat(F.lit("- - "), "x")).alias("title"))


@query(
    "fn_display",
    "SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN 'part:' || p_partkey ELSE trim(' ' || p_name) END AS shown, CASE WHEN p_size % 2 = 0 THEN p_name || chr(10) || chr(10) || p_type || ' ' || p_brand ELSE p_name END AS retrieval, CASE WHEN p_size % 3 = 0 THEN -1 ELSE p_size END AS size FROM part",
)
def fn_display(spark: SparkSession, sf: str) -> DataFrame:
    """A term's name or id, its text for retrieval, and a number that may be missing."""
    p, size = table(spark, sf, "part"), C("p_size")
    evidence = F.when(size % 2 == 0, F.array("p_type", "p_brand")).otherwise(F.array().cast("array<string>"))
    name = F.when(size % 3 != 0, F.concat(F.lit(" "), "p_name"))
    return p.select(C("p_partkey").alias("id"), t.display(name, t.curie("part", "p_partkey")).alias("shown"), t.retrieval_text("p_name", evidence).alias("retrieval"), t.int_or(F.when(size % 3 == 0, "none").otherwise(size.cast("string")), -1).cast("int").alias("size"))


@query(
    "fn_duration",
    """WITH s AS (SELECT event_id, event_id * 0.5::DOUBLE AS x FROM events), p AS (SELECT event_id, x, floor(x / 3600)::INT AS h, floor((x % 3600) / 60)::INT AS m, x % 60 AS r FROM s)
SELECT event_id AS id, CASE WHEN h > 0 THEN printf('%dh %02dm %04.1fs', h, m, r) WHEN m > 0 THEN printf('%dm %04.1fs', m, r) ELSE printf('%.1fs', r) END AS shown FROM p""",
)
def fn_duration(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(C("event_id").alias("id"), (C("event_id") * 0.5).alias("x"))
    return e.select("id", t.duration("x").alias("shown"))


@query("fn_language", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'de' WHEN lang IN ('en', 'de', 'fr') THEN lang END AS code FROM documents")
def fn_language(spark: SparkSession, sf: str) -> DataFrame:
    """Language codes in other spelling, through an alias, or not supported."""
    raw = F.when(C("doc_id") % 5 == 0, " German ").otherwise(F.upper("lang"))
    return table(spark, sf, "documents").select("doc_id", t.language_code(raw, ["en", "de", "fr"], {"german": "de"}).alias("code"))


@query(
    "fn_question_target",
    "SELECT p_partkey AS id, 'who.va:VAs-' || CASE WHEN p_size % 3 = 0 THEN lpad((p_size % 12)::VARCHAR, 2, '0') ELSE lpad((p_size % 12)::VARCHAR, 2, '0') || '.0' || (p_size % 3) END AS target FROM part",
)
def fn_question_target(spark: SparkSession, sf: str) -> DataFrame:
    """Names of a matrix's columns as categories, through the map of all of them."""
    names = [f"b_{a:02d}{b:02d}" for a in range(12) for b in range(3)]
    name = F.concat(F.lit("b_"), F.lpad((C("p_size") % 12).cast("string"), 2, "0"), F.lit("0"), (C("p_size") % 3).cast("string"))
    return table(spark, sf, "part").select(C("p_partkey").alias("id"), t.lookup({n: t.question_target(n) for n in names}, name).alias("target"))


@query(
    "fn_overlap_join",
    r"""WITH c AS (SELECT conv_id, turn, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM conversations),
p AS (SELECT conv_id, turn, w[1:len(w) // 2 + turn % 10] AS a, w[len(w) // 2 + 1:] AS b FROM c WHERE len(w) >= 2),
k AS (SELECT *, coalesce(list_max(list_filter(range(1, least(8, len(a), len(b)) + 1), lambda k: a[len(a) - k + 1:] = b[1:k])), 0) AS k FROM p)
SELECT conv_id, turn, array_to_string(a, ' ') || ' ' || array_to_string(b[k + 1:], ' ') AS joined FROM k""",
)
def fn_overlap_join(spark: SparkSession, sf: str) -> DataFrame:
    """Two windows of a turn that share none to nine words, of which eight are looked for, joined again."""
    half = F.floor(F.size("w") / 2).cast("int")
    c = table(spark, sf, "conversations").withColumn("w", t.tokens("text")).where(F.size("w") >= 2)
    first = F.slice("w", F.lit(1), half + (C("turn") % 10).cast("int"))
    parts = F.array(F.array_join(first, " "), F.array_join(F.slice("w", half + 1, F.size("w")), " "))
    return c.select("conv_id", "turn", edit.join_overlapping(parts).alias("joined"))


PCM = [0, 16384, -16384, 32767, -32768]


@query(
    "fn_audio",
    f"""WITH s AS (SELECT event_id, user_id, [{', '.join(map(str, PCM))}][1 + event_id % 5]::DOUBLE AS x FROM events), g AS (SELECT user_id, count(*) AS n, list(x ORDER BY event_id) AS xs FROM s GROUP BY user_id)
SELECT user_id, n::INT AS n, round(sqrt(list_avg(list_transform(xs, lambda x: (x / 32768) ** 2))), 9) AS rms, round(list_max(list_transform(xs, lambda x: abs(x / 32768))), 9) AS peak,
  list_max(list_transform(xs, lambda x: abs(x))) < 33 AS silent, round(list_sum(list_transform(xs, lambda x: trunc(greatest(-1, least(1, 2 * x / 32768)) * 32767))), 3) AS loud FROM g""",
)
def fn_audio(spark: SparkSession, sf: str) -> DataFrame:
    """Levels of each user's samples as PCM, the silence gate, and the samples twice as loud, clipped."""
    x = F.get(F.array(*map(F.lit, PCM)), (C("event_id") % 5).cast("int"))
    low = F.pmod(x, F.lit(65_536))
    two = F.concat(F.lpad(F.hex(low % 256), 2, "0"), F.lpad(F.hex(F.floor(low / 256)), 2, "0"))
    e = table(spark, sf, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", two.alias("h"), x.alias("x")))).alias("s"))
    e = e.withColumn("l", audio.levels(F.unhex(F.array_join(F.transform("s", lambda s: s["h"]), ""))))
    loud = audio.to_int16(F.transform(audio.from_int16(F.transform("s", lambda s: s["x"].cast("double"))), lambda v: 2 * v))
    total = F.aggregate(loud, F.lit(0.0), lambda a, v: a + v)
    return e.select("user_id", "l.n", F.round("l.rms", 9).alias("rms"), F.round("l.peak", 9).alias("peak"), t.silent(F.round(C("l.peak") * 32_768), integer=True).alias("silent"), F.round(total, 3).alias("loud"))


@query(
    "fn_resample",
    """WITH p AS (SELECT p_partkey AS id, p_size AS s, CASE WHEN p_size % 2 = 0 THEN p_size // 2 ELSE (p_size + (p_size // 2) % 2) // 2 END AS n,
  list_transform(range(p_size), lambda i: ((p_partkey * 7 + i * 13) % 50 + (i * i) % 7) / 2.0::DOUBLE) AS m FROM part),
j AS (SELECT *, unnest(range(n)) AS i FROM p),
x AS (SELECT *, CASE WHEN n = 1 THEN 0.0 ELSE i * ((s - 1)::DOUBLE / (n - 1)) END AS x FROM j),
f AS (SELECT *, least(floor(x)::BIGINT, s - 1) AS lo FROM x)
SELECT id, 2::INT AS channels, s::INT AS mono_n, list_sum(m)::DOUBLE AS mono_sum, n::INT AS n, i::INT AS i, round(m[lo + 1] + (x - lo) * (m[least(lo + 2, s)] - m[lo + 1]), 6) AS sample FROM f""",
)
def fn_resample(spark: SparkSession, sf: str) -> DataFrame:
    """Two channels mixed to one, then from 32 kHz to 16 kHz, sample by sample; half a sample is rounded to the even number."""
    k, n = C("p_partkey"), C("p_size")
    samples = F.flatten(F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), lambda i: F.array(((k * 7 + i * 13) % 50).cast("double"), ((i * i) % 7).cast("double"))))
    p = table(spark, sf, "part").where(n > 0).select(k.alias("id"), F.lit(2).alias("channels"), audio.mono(samples, F.lit(2)).alias("m"))
    p = p.withColumn("r", audio.resample("m", F.lit(2 * audio.RATE)))
    total = F.aggregate("m", F.lit(0.0), lambda a, x: a + x)
    return p.select("id", "channels", F.size("m").alias("mono_n"), total.alias("mono_sum"), F.size("r").alias("n"), F.posexplode("r").alias("i", "sample")).withColumn("sample", F.round("sample", 6))


@query(
    "fn_windows",
    """WITH d AS (SELECT event_id AS id, (event_id % 200) * 1.0 AS x FROM events), k AS (SELECT id, x, greatest(1, ceil((x - 1) / 28.5))::INT AS n FROM d)
SELECT id, i::INT AS window, i * 28.5::DOUBLE AS start, least(x::DOUBLE, i * 28.5::DOUBLE + 29.5) AS "end" FROM (SELECT id, x, unnest(range(n)) AS i FROM k)""",
)
def fn_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Overlapping windows over recordings of several lengths."""
    e = table(spark, sf, "events").select(C("event_id").alias("id"), audio.windows((C("event_id") % 200).cast("double")).alias("w"))
    return e.select("id", F.posexplode("w").alias("window", "w")).select("id", "window", C("w.start").cast("double").alias("start"), C("w.end").cast("double").alias("end"))


@query("dlg_committed", "SELECT conv_id, turn, sum(CASE WHEN turn % 9 = 8 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS session FROM conversations QUALIFY turn % 9 <> 8 AND turn % 4 <> 1")
def dlg_committed(spark: SparkSession, sf: str) -> DataFrame:
    """Final events with text, in sessions that a reset ends."""
    c = table(spark, sf, "conversations").withColumns({"committed": (C("turn") % 4 != 1) | (C("turn") % 9 == 8), "text": F.when(C("turn") % 4 == 1, " ").otherwise(C("text"))})
    s = dialogue.resets(c, "conv_id", "turn", C("turn") % 9 == 8)
    return dialogue.committed(s).select("conv_id", "turn", "session")


@query(
    "dlg_ranked_causes",
    "SELECT c_nationkey AS nation, string_agg(c_mktsegment, ',' ORDER BY n DESC, c_mktsegment) AS ranked FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL) GROUP BY c_nationkey",
)
def dlg_ranked_causes(spark: SparkSession, sf: str) -> DataFrame:
    """Causes by falling score; equals keep the order of their list."""
    n = table(spark, sf, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).cast("double").alias("score"))
    a = n.groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct(C("c_mktsegment").alias("label"), "score"))).alias("causes"))
    return a.select(C("c_nationkey").alias("nation"), F.array_join(F.transform(dialogue.ranked_causes(C("causes")), lambda x: x["label"]), ",").alias("ranked"))


@query("inf_requests", "SELECT conv_id, turn, CASE WHEN turn % 5 = 0 THEN CASE WHEN turn % 2 = 0 THEN 'missing: text, annotations' ELSE 'missing: text' END WHEN turn % 2 = 0 THEN 'missing: annotations' END AS error, CASE WHEN turn % 3 = 0 THEN turn::DOUBLE ELSE -1 END AS timestamp FROM conversations")
def inf_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Requests with missing fields are marked, row by row; timestamps given stay."""
    turn = C("turn")
    c = table(spark, sf, "conversations").select("conv_id", turn, turn.cast("string").alias("chunk_id"), F.when(turn % 5 != 0, C("text")).alias("text"), F.when(turn % 2 != 0, F.array("role")).alias("annotations"), F.when(turn % 3 == 0, turn.cast("double")).alias("timestamp"))
    return inference.check_requests(c).select("conv_id", "turn", "error", F.when(turn % 3 == 0, C("timestamp")).otherwise(-1.0).alias("timestamp"))


def upper(c: str) -> str:
    """A character's one upper-case character: where its full upper case has several, the title case or, of a sharp s, U+1E9E; else itself."""
    return next((u for u in (c.upper(), c.title(), "\u1e9e" if c == "\u00df" else c) if len(u) == 1), c)


@query("inf_translated", "SELECT doc_id, CASE WHEN lang = 'en' OR len(list_filter(string_split_regex(trim(text), '\\s+'), lambda x: x <> '')) <= 1 THEN md5(text) WHEN lang = 'de' THEN md5(text) ELSE md5(upper(text)) END AS text FROM documents")
def inf_translated(spark: SparkSession, sf: str) -> DataFrame:
    """Texts in other languages through a translator that knows all but one of them; what it fails on stays."""

    def translate(x: str, language: str) -> str:
        if language == "de":
            raise RuntimeError("not known")
        return "".join(map(upper, x))

    d = table(spark, sf, "documents").select("doc_id", "text", "lang")
    return inference.translated(d, translate).select("doc_id", F.md5(C("text").cast("binary")).alias("text"))


@query(
    "inf_label_agent",
    """WITH r AS (SELECT conv_id, turn, string_agg(CASE turn % 4 WHEN 0 THEN 'fever' WHEN 1 THEN 'heart' ELSE 'other' END, ' ') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS x FROM conversations),
k AS (SELECT conv_id, turn, contains(x, 'fever') AS f, contains(x, 'heart') AS h FROM r)
SELECT conv_id, turn, CASE WHEN f AND h THEN 'icd10:I46.9=0.5,icd10:U07.1=0.5' WHEN f THEN 'icd10:U07.1=1.0' WHEN h THEN 'icd10:I46.9=1.0' ELSE '' END AS causes FROM k""",
)
def inf_label_agent(spark: SparkSession, sf: str) -> DataFrame:
    """An agent over a registered provider's client: answers become causes, events without any have none."""
    turn = C("turn")
    said = F.when(turn % 4 == 0, "fever").when(turn % 4 == 1, "heart").otherwise("other")
    c = table(spark, sf, "conversations").select("conv_id", turn, said.alias("text"))
    codes = {name: code for code, name, words in inference.CAUSES.values() if words}
    agent = inference.LabelAgent(inference.client("keywords"), list(codes), codes)
    causes = agent.causes(agent.infer(c, "conv_id", "turn"), "conv_id", "turn")
    shown = F.array_join(F.array_sort(F.transform(F.map_entries("causes"), lambda e: F.concat(e["key"], F.lit("="), e["value"]["score"].cast("string")))), ",")
    return c.select("conv_id", "turn").join(causes, ["conv_id", "turn"], "left").select("conv_id", "turn", F.coalesce(shown, F.lit("")).alias("causes"))


@query(
    "eval_encounters",
    "SELECT c_nationkey AS encounter, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS pred, count(DISTINCT CASE WHEN c_acctbal > 0 THEN c_mktsegment END)::INT AS n_ref FROM customer WHERE c_nationkey % 3 <> 0 GROUP BY 1",
)
def eval_encounters(spark: SparkSession, sf: str) -> DataFrame:
    """Codes of the best matches of encounters that have a reference and a prediction."""
    c = table(spark, sf, "customer")
    matches = F.array(F.struct(C("c_mktsegment").alias("code")), F.struct(F.lit("second").alias("code")))
    pred = evaluate.top_codes(c.where("c_nationkey % 3 <> 0").select(C("c_nationkey").alias("encounter"), matches.alias("matches")), "encounter")
    ref = c.groupBy(C("c_nationkey").alias("encounter")).agg(F.collect_set(F.when(C("c_acctbal") > 0, C("c_mktsegment"))).alias("ref"))
    return evaluate.paired(ref, pred, "encounter").select("encounter", F.array_join("pred", ",").alias("pred"), F.size("ref").alias("n_ref"))


@query(
    "eval_corpus_wer",
    """WITH e AS (SELECT l_returnflag AS f, l_linenumber::BIGINT AS s, (l_quantity % 3)::BIGINT AS d, (l_suppkey % 2)::BIGINT AS i, (l_partkey % 50)::BIGINT AS n, l_tax AS lat, l_discount AS dur FROM lineitem)
SELECT f, sum(s)::BIGINT AS s, sum(n)::BIGINT AS n, round((sum(s) + sum(d) + sum(i))::DOUBLE / sum(n), 9) AS wer, round(sum(lat) / sum(dur), 6) AS rtf FROM e GROUP BY f""",
)
def eval_corpus_wer(spark: SparkSession, sf: str) -> DataFrame:
    """Errors and real-time factor of a corpus from sums, not from means of rows."""
    cast = lambda x: x.cast("long")
    e = table(spark, sf, "lineitem").select(
        C("l_returnflag").alias("f"), cast(C("l_linenumber")).alias("s"), cast(C("l_quantity") % 3).alias("d"), cast(C("l_suppkey") % 2).alias("i"), cast(C("l_partkey") % 50).alias("n"),
        F.lit(0).alias("char_edits"), F.lit(0).alias("char_len"), C("l_tax").alias("latency_s"), C("l_discount").alias("duration_s"),
    )
    return evaluate.corpus_errors(e, ["f"]).select("f", "s", "n", F.round("wer", 9).alias("wer"), F.round("rtf", 6).alias("rtf"))


@query(
    "gnd_structured",
    "SELECT p_partkey AS id, p_name AS text, 'brand:' || p_brand AS curie, p_type AS name FROM part WHERE p_size % 2 = 0",
)
def gnd_structured(spark: SparkSession, sf: str) -> DataFrame:
    """Annotations as (text, curie, name) of the best match."""
    match = F.struct(F.concat(F.lit("brand:"), "p_brand").alias("id"), C("p_type").alias("name"))
    some = F.when(C("p_size") % 2 == 0, F.array(match, F.struct(F.lit("x").alias("id"), F.lit("y").alias("name")))).otherwise(F.array().cast("array<struct<id:string,name:string>>"))
    p = table(spark, sf, "part").select(C("p_partkey").alias("id"), F.array(F.struct(C("p_name").alias("text"), some.alias("matches"))).alias("a"))
    return p.select("id", F.inline(grounding.structured(C("a"))))


LINES_SQL = """WITH l AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN NULL ELSE turn // 3 END AS line, CASE WHEN turn % 5 = 4 THEN role ELSE string_agg(role, ' ') OVER (PARTITION BY conv_id, turn // 3 ORDER BY turn ROWS UNBOUNDED PRECEDING) END AS t FROM conversations),
p AS (SELECT *, coalesce(lag(t) OVER (PARTITION BY conv_id, line ORDER BY turn), '') AS p FROM l)
SELECT conv_id, turn, CASE WHEN line IS NULL THEN t WHEN starts_with(t, p) THEN trim(substr(t, length(p) + 1)) ELSE t END AS text, line IS NOT NULL AS committed FROM p WHERE t <> p"""


def lines(c: DataFrame) -> DataFrame:
    """Growing lines of three turns; every fifth turn is a preview."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id", F.floor(C("turn") / 3)).orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    preview = C("turn") % 5 == 4
    grown = F.array_join(F.collect_list("role").over(w), " ")
    return c.select("conv_id", "turn", F.when(~preview, F.floor(C("turn") / 3).cast("string")).alias("line"), F.when(preview, C("role")).otherwise(grown).alias("text"))


@query("dlg_line_stream", LINES_SQL)
def dlg_line_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The lines' new parts and the changed previews, from a stream of dialogue revisions."""
    import uuid

    from causegraph.storage import shared_root
    from causegraph.streaming import processors

    base = f"{shared_root(spark)}/revisions-{uuid.uuid4().hex}"
    lines(table(spark, sf, "conversations")).write.parquet(f"{base}/revisions.parquet")
    return streamed(spark, base, "revisions", lambda df: processors.line_delta_stream(df, "conv_id", "turn"))


@query(
    "dlg_chunk_stream",
    """WITH b AS (SELECT conv_id, string_agg(role || turn, '' ORDER BY turn) AS x FROM conversations GROUP BY conv_id), k AS (SELECT conv_id, x, unnest(range(length(x) // 16)) AS chunk FROM b)
SELECT conv_id, chunk::BIGINT AS chunk, substr(x, chunk * 16 + 1, 16) AS blob FROM k""",
)
def dlg_chunk_stream(spark: SparkSession, sf: str) -> DataFrame:
    """A session's bytes in chunks of sixteen, from a stream."""
    from causegraph.streaming import processors

    def process(c: DataFrame) -> DataFrame:
        blobs = c.select("conv_id", "turn", F.concat("role", C("turn").cast("string")).cast("binary").alias("blob"))
        return processors.chunk_stream(blobs, "conv_id", "turn", 16)

    return streamed(spark, sf, "conversations", process).select("conv_id", "chunk", C("blob").cast("string").alias("blob"))


@query("dlg_transcribed", "SELECT conv_id, turn AS chunk, CASE WHEN turn % 4 = 0 OR turn % 7 = 6 THEN '' ELSE 'heard 32' END AS text, CASE WHEN turn % 7 = 6 AND turn % 4 <> 0 THEN 'noise' END AS error FROM conversations")
def dlg_transcribed(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of audio through a transcriber: some are silent, on some the recogniser fails."""

    def recognise(blob: bytes) -> str:
        if blob[0] == 99:
            raise ValueError("noise")
        return f"heard {len(blob)}"

    turn = C("turn")
    level = F.when(turn % 4 == 0, "0100").when(turn % 7 == 6, "6310").otherwise("0010")
    c = table(spark, sf, "conversations").select("conv_id", turn.cast("long").alias("chunk"), F.unhex(F.repeat(level, 16)).alias("blob"))
    return dialogue.ChunkTranscriber(recognise).events(c, "conv_id").select("conv_id", "chunk", "text", "error")



"""Queries on dialogue and event streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from causegraph.catalog import query, table
from causegraph.functions import audio, text as t
from causegraph.operators import dialogue, etl

GROUPS = {"a": ["the"], "b": ["on the", "is"]}
NAMES = ("a", "b", "other")


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return dialogue.running_scores(table(spark, sf, "conversations"), "conv_id", "turn", GROUPS)


SCORES_SQL = """WITH r AS (SELECT conv_id, turn, row_number() OVER w AS chunks, lower(' ' || string_agg(coalesce(text, ''), ' ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS x
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
k AS (SELECT conv_id, turn, chunks, (length(x) - length(replace(x, 'the', ''))) // 3 AS a, (length(x) - length(replace(x, 'on the', ''))) // 6 + (length(x) - length(replace(x, 'is', ''))) // 2 AS b FROM r),
s AS (SELECT conv_id, turn, chunks, CASE WHEN a + b > 0 THEN a::DOUBLE / (a + b) ELSE 0.0 END AS score_a, CASE WHEN a + b > 0 THEN b::DOUBLE / (a + b) ELSE 0.0 END AS score_b FROM k),
f AS (SELECT *, 1.0::DOUBLE - (score_a + score_b) AS score_other FROM s)"""


@query("dlg_running_score", f"{SCORES_SQL} SELECT conv_id, turn, chunks, round(score_a, 9) AS score_a, round(score_b, 9) AS score_b, round(score_other, 9) AS score_other FROM f")
def dlg_running_score(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).select("conv_id", "turn", "chunks", *[F.round(f"score_{g}", 9).alias(f"score_{g}") for g in NAMES])


@query(
    "dlg_top_cause",
    f"""{SCORES_SQL} SELECT conv_id, turn, CASE WHEN score_a >= score_b AND score_a >= score_other THEN 'a' WHEN score_b >= score_other THEN 'b' ELSE 'other' END AS label,
round(greatest(score_a, score_b, score_other), 9) AS score FROM f""",
)
def dlg_top_cause(spark: SparkSession, sf: str) -> DataFrame:
    top = dialogue.top_cause([(g, F.col(f"score_{g}")) for g in NAMES])
    return scored(spark, sf).withColumn("top", top).select("conv_id", "turn", "top.label", F.round("top.score", 9).alias("score"))


GATE_SQL = r"""WITH RECURSIVE e AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k,
  len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '')) AS w FROM conversations),
g AS (SELECT conv_id, turn, k, w AS words, 0::BIGINT AS batch FROM e WHERE k = 1
  UNION ALL SELECT e.conv_id, e.turn, e.k, CASE WHEN g.words >= 15 THEN e.w ELSE g.words + e.w END, CASE WHEN g.words >= 15 THEN g.batch + 1 ELSE g.batch END FROM g JOIN e ON e.conv_id = g.conv_id AND e.k = g.k + 1)
SELECT conv_id, turn, batch FROM g"""


@query("dlg_gate_batches", GATE_SQL)
def dlg_gate_batches(spark: SparkSession, sf: str) -> DataFrame:
    return dialogue.gate(table(spark, sf, "conversations"), "conv_id", "turn")


def streamed(spark: SparkSession, sf: str, name: str, process) -> DataFrame:
    """A table read as a file stream and put through ``process`` until it is used up; state and results lie in the shared folder."""
    path = f"{sf}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    # a stream reads a folder: the table's own, or, if it is one file, the only file of that name in its folder
    source = reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf) if _is_file(spark, path) else reader.parquet(path)
    return run_stream(spark, source, process, name)


def run_stream(spark: SparkSession, source: DataFrame, process, name: str, then=None) -> DataFrame:
    """A streaming table put through ``process`` until it is used up; what ``then`` adds to it is taken by the same stream after that,
    whatever the order in which the source lists its files. The state store provider is set for this stream's start only."""
    from causegraph.storage import shared_root
    from causegraph.streaming import processors

    work, provider = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}", "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, processors.ROCKSDB)
    try:
        out = process(source)
        use_up = lambda: out.writeStream.format("parquet").option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start(f"{work}/out").awaitTermination()
        use_up()
        if then is not None:
            then()
            use_up()
    finally:
        spark.conf.set(provider, before)
    return spark.read.schema(out.schema).parquet(f"{work}/out")


@query("dlg_gate_stream", GATE_SQL)
def dlg_gate_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The same from a file stream."""
    from causegraph.streaming import processors

    return streamed(spark, sf, "conversations", lambda df: processors.gate_stream(df, "conv_id", "turn"))


def _is_file(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile()


@query("dlg_chunks", "WITH r AS (SELECT user_id, ts, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 4 AS chunk FROM events) SELECT user_id, chunk, count(*) AS n, epoch_us(min(ts)) AS start_us FROM r GROUP BY ALL HAVING count(*) = 4")
def dlg_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of four events; an incomplete last one goes."""
    c = audio.chunks(table(spark, sf, "events"), "user_id", "event_id", 4, keep_tail=False)
    return c.groupBy("user_id", "chunk").agg(F.count(F.lit(1)).alias("n"), F.unix_micros(F.min(F.col("ts").cast("timestamp"))).alias("start_us"))


@query(
    "dlg_line_delta",
    """WITH l AS (SELECT conv_id * 100 + (turn // 3) AS line, turn AS seq, CASE WHEN turn % 5 = 4 THEN trim(text) ELSE trim(string_agg(text, ' ') OVER (PARTITION BY conv_id, turn // 3 ORDER BY turn)) END AS t FROM conversations),
p AS (SELECT *, coalesce(lag(t) OVER (PARTITION BY line ORDER BY seq), '') AS p FROM l WHERE t <> ''),
d AS (SELECT line, seq, CASE WHEN starts_with(t, p) THEN trim(substr(t, length(p) + 1)) ELSE t END AS delta FROM p WHERE t <> p) SELECT * FROM d WHERE delta <> ''""",
)
def dlg_line_delta(spark: SparkSession, sf: str) -> DataFrame:
    """Three turns are the growing revisions of a line; every fifth turn starts it over."""
    c = table(spark, sf, "conversations")
    part = F.floor(F.col("turn") / 3)
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id", part).orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    grown = F.array_join(F.collect_list("text").over(w), " ")
    lines = c.select((F.col("conv_id") * 100 + part).alias("line"), F.col("turn").alias("seq"), F.when(F.col("turn") % 5 == 4, F.col("text")).otherwise(grown).alias("text"))
    return dialogue.line_deltas(lines, ["line"], "seq").select("line", "seq", "delta")


@query("dlg_preview_changes", "WITH p AS (SELECT *, coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id), '') AS p FROM events) SELECT event_id, event_type AS text FROM p WHERE event_type <> '' AND event_type <> p")
def dlg_preview_changes(spark: SparkSession, sf: str) -> DataFrame:
    out = dialogue.preview_changes(table(spark, sf, "events"), "user_id", "event_id", "event_type")
    return out.select("event_id", F.col("event_type").alias("text"))


@query(
    "dlg_segment_filter",
    """WITH e AS (SELECT user_id, event_id, event_type, (event_id % 100) / 100.0 AS p, CASE WHEN user_id % 2 = 0 THEN 'en' ELSE 'bn' END AS lang FROM events)
SELECT user_id, trim(coalesce(string_agg(event_type || ' ', '' ORDER BY event_id) FILTER (p < CASE WHEN lang = 'en' THEN 0.6 ELSE 0.8 END), '')) AS text FROM e GROUP BY user_id""",
)
def dlg_segment_filter(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", "event_id", F.struct(F.concat("event_type", F.lit(" ")).alias("text"), ((F.col("event_id") % 100) / 100.0).alias("no_speech_prob")).alias("s"))
    g = e.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "s"))), lambda x: x["s"]).alias("segments"))
    g = g.withColumn("lang", F.when(F.col("user_id") % 2 == 0, "en").otherwise("bn"))
    return g.select("user_id", t.spoken_text(F.col("segments"), "lang", F.lit("")).alias("text"))


@query(
    "dlg_idle_flush",
    """WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) / 1e6 AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
g AS (SELECT user_id, k, s AS since, 0::BIGINT AS flush FROM e WHERE k = 1
  UNION ALL SELECT e.user_id, e.k, CASE WHEN e.s - g.since >= 86400 THEN e.s ELSE g.since END, CASE WHEN e.s - g.since >= 86400 THEN g.flush + 1 ELSE g.flush END FROM g JOIN e ON e.user_id = g.user_id AND e.k = g.k + 1)
SELECT user_id, flush AS flush_no, count(*) AS n FROM g GROUP BY ALL""",
)
def dlg_idle_flush(spark: SparkSession, sf: str) -> DataFrame:
    """The idle flush on event time, with a day's patience."""
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return dialogue.idle_flushes(e, "user_id", "ts", "event_id", 86_400).withColumnRenamed("flush", "flush_no")


IDLE_DAY, POLL_HOUR = 86_400_000, 3_600_000


@query(
    "dlg_idle_stream",
    f"""WITH RECURSIVE e AS (SELECT user_id, event_type, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
g AS (SELECT user_id, k, t AS since, t AS first, event_type AS text, 1 AS n, NULL::BIGINT AS idle_at, 0 AS idle_n, '' AS idle_text, NULL::BIGINT AS full_at, 0 AS full_n, '' AS full_text FROM e WHERE k = 1
  UNION ALL SELECT user_id, k, CASE WHEN n2 >= 4 THEN t WHEN due < t THEN due ELSE since END, CASE WHEN n1 = 0 THEN t ELSE first END, CASE WHEN n2 >= 4 THEN '' ELSE x END, CASE WHEN n2 >= 4 THEN 0 ELSE n2 END,
    CASE WHEN due < t THEN due END, n, text, CASE WHEN n2 >= 4 THEN t END, n2, x FROM (
    SELECT *, n1 + 1 AS n2, CASE WHEN n1 = 0 THEN event_type ELSE text || ' ' || event_type END AS x FROM (
      SELECT e.user_id, e.k, e.t, e.event_type, g.since, g.first, g.n, g.text, g.due, CASE WHEN g.due < e.t THEN 0 ELSE g.n END AS n1
      FROM (SELECT *, CASE WHEN n > 0 THEN greatest(since + {IDLE_DAY}000, first + {POLL_HOUR}000) END AS due FROM g) AS g JOIN e ON e.user_id = g.user_id AND e.k = g.k + 1))),
z AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY k DESC) AS r FROM g)
SELECT user_id, idle_at AS at, idle_n::BIGINT AS n, idle_text AS text, 'idle' AS why FROM g WHERE idle_at IS NOT NULL UNION ALL SELECT user_id, full_at, full_n, full_text, 'words' FROM g WHERE full_at IS NOT NULL
UNION ALL SELECT user_id, greatest(since + {IDLE_DAY}000, first + {POLL_HOUR}000), n, text, 'idle' FROM z WHERE r = 1 AND n > 0""",
)
def dlg_idle_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The gate with its idle flush as a stream on event time: four words, a day's patience, an hour's wait at least."""
    from causegraph.storage import shared_root
    from causegraph.streaming import processors

    e = table(spark, sf, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("text"))
    # rows come in any order here, so the watermark waits for as long as the table lasts
    ends = e.agg(F.unix_micros(F.min("ts")).alias("first"), F.unix_micros(F.max("ts")).alias("last")).first()
    days = 1 + (ends.last - ends.first) // 86_400_000_000 if ends.last is not None else 1
    path = f"{shared_root(spark)}/moments-{uuid.uuid4().hex}"
    e.write.parquet(path)

    def close() -> None:
        """A row of no user, long after the others, carries the watermark past the last flush; it must not be read before any of them."""
        far = ends.last + (days + 2) * 86_400_000_000 + 1000 * (IDLE_DAY + POLL_HOUR)
        last = spark.range(1).select(F.lit(-1).cast(e.schema["user_id"].dataType).alias("user_id"), F.lit(-1).cast(e.schema["event_id"].dataType).alias("event_id"), F.timestamp_micros(F.lit(far)).alias("ts"), F.lit("").alias("text"))
        last.write.mode("append").parquet(path)

    gate = lambda df: processors.event_idle_gate_stream(df, "user_id", "ts", "event_id", 4, IDLE_DAY, POLL_HOUR, f"{days} days")
    source = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 2).parquet(path)
    return run_stream(spark, source, gate, "moments", close if ends.last is not None else None)


@query("dlg_load_shed", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k <= 20")
def dlg_load_shed(spark: SparkSession, sf: str) -> DataFrame:
    return etl.latest(table(spark, sf, "events"), ["user_id"], "event_id", dialogue.MOST_PENDING).select("event_id")


WAITING = 3


@query(
    "dlg_pending_stream",
    f"""WITH RECURSIVE e AS (SELECT user_id, event_id, row_number() OVER w AS k, event_type IN ('purchase', 'click', 'view') AS done,
  CASE WHEN event_type = 'purchase' THEN lag(event_id, 1) OVER w WHEN event_type = 'click' THEN lag(event_id, 2) OVER w WHEN event_type = 'view' THEN lag(event_id, 5) OVER w ELSE event_id END AS request
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
q AS (SELECT user_id, 0::BIGINT AS k, NULL::BIGINT AS event_id, []::BIGINT[] AS queue, NULL::BIGINT AS request, NULL::VARCHAR AS why FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL SELECT e.user_id, e.k, e.event_id, CASE WHEN e.done THEN list_filter(q.queue, lambda x: x <> e.request) WHEN len(q.queue) = {WAITING} THEN list_append(q.queue[2:], e.request) ELSE list_append(q.queue, e.request) END,
    CASE WHEN e.done THEN e.request ELSE q.queue[1] END, CASE WHEN e.done THEN CASE WHEN list_contains(q.queue, e.request) THEN 'done' END WHEN len(q.queue) = {WAITING} THEN 'shed' END
  FROM q JOIN (SELECT user_id, k, event_id, done, coalesce(request, -1) AS request FROM e) AS e ON e.user_id = q.user_id AND e.k = q.k + 1)
SELECT user_id, event_id, request, why, len(queue) AS waiting FROM q WHERE why IS NOT NULL""",
)
def dlg_pending_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Signups and errors are requests; purchases, clicks and views answer what came one, two or five events before, if it waits."""
    from pyspark.sql import Window

    from causegraph.storage import shared_root
    from causegraph.streaming import processors

    w = Window.partitionBy("user_id").orderBy("event_id")
    back = {"purchase": 1, "click": 2, "view": 5}
    request = F.when(F.col("event_type") == "purchase", F.lag("event_id", 1).over(w)).when(F.col("event_type") == "click", F.lag("event_id", 2).over(w)).when(F.col("event_type") == "view", F.lag("event_id", 5).over(w))
    done = F.coalesce(F.col("event_type").isin(*back), F.lit(False))
    e = table(spark, sf, "events").select("user_id", "event_id", F.when(done, request).otherwise(F.col("event_id")).alias("request"), done.alias("done"))
    folder = f"{shared_root(spark)}/requests-{uuid.uuid4().hex}"
    e.write.parquet(folder)
    source = spark.readStream.schema(e.schema).parquet(folder)
    return run_stream(spark, source, lambda df: processors.pending_stream(df, "user_id", "event_id", "request", WAITING), "pending")


BLOB = 1000


@query(
    "dlg_live_blobs",
    f"""WITH h AS (SELECT conv_id, hex(encode(string_agg(coalesce(text, ''), chr(10) ORDER BY turn))) AS h FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
n AS (SELECT *, (length(h) // 2 + {BLOB - 1}) // {BLOB} AS n FROM h)
SELECT conv_id, i AS blob_no, substr(h, i * {2 * BLOB} + 1, {2 * BLOB}) AS blob, FALSE AS ended FROM (SELECT conv_id, h, unnest(generate_series(0, n - 1)) AS i FROM n WHERE n > 0)
UNION ALL SELECT conv_id, n, NULL, TRUE FROM n""",
)
def dlg_live_blobs(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations recorded as sessions, read back as a stream of blobs and delivered to an outbox."""
    from pyspark.sql import Window

    from causegraph.sources import live
    from causegraph.storage import shared_root

    work = f"{shared_root(spark)}/live-{uuid.uuid4().hex}"
    text = F.coalesce("text", F.lit(""))
    first = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) == 1
    spoken = table(spark, sf, "conversations").select("conv_id", "turn", F.when(first, text).otherwise(F.concat(F.lit("\n"), text)).cast("binary").alias("blob"))
    live.record_sessions(spoken, "conv_id", "turn", "blob", f"{work}/sessions")
    blobs = live.session_blobs(spark, f"{work}/sessions", BLOB)
    live.deliver(blobs, f"{work}/outbox", f"{work}/checkpoint", availableNow=True).awaitTermination()
    got = live.delivered(spark, f"{work}/outbox", blobs.schema)
    return got.select(F.col("session").cast("long").alias("conv_id"), F.col("at").alias("blob_no"), F.hex("blob").alias("blob"), F.col("end").alias("ended"))


@query("dlg_languages_pinned", "SELECT lang, count(*) AS n, row_number() OVER (ORDER BY lang <> 'en', lang) AS ord FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def dlg_languages_pinned(spark: SparkSession, sf: str) -> DataFrame:
    """Languages with English first; the window is over one row for each language."""
    from pyspark.sql import Window

    d = table(spark, sf, "documents").where("lang is not null").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return d.withColumn("ord", F.row_number().over(Window.orderBy(F.col("lang") != "en", "lang")).cast("long"))

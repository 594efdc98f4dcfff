"""Ordered dialogue in batch: running text and scores, gates, deltas, load shedding."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, Window

from causegraph.functions.text import mentions

MIN_WORDS, IDLE_SECONDS, MOST_PENDING = 15, 10.0, 20


def running_text(df: DataFrame, key: str, order: str, text: str = "text") -> DataFrame:
    """Adds ``chunks`` (how many so far) and ``all_text`` (each text after a space, up to this one)."""
    w = Window.partitionBy(key).orderBy(order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({"chunks": F.row_number().over(w).cast("long"), "all_text": F.concat(F.lit(" "), F.array_join(F.collect_list(F.coalesce(text, F.lit(""))).over(upto), " "))})


def _overlaps_itself(word: str) -> bool:
    return any(word.startswith(word[k:]) for k in range(1, len(word)))


def uncountable(words: list[str]) -> list[str]:
    """Words that :func:`running_mentions` refuses."""
    return [w for w in words if " " in w and _overlaps_itself(w.lower())]


def running_mentions(df: DataFrame, key: str, order: str, words: list[str], out: str, text: str = "text") -> DataFrame:
    """Adds how often the words occur, in lower case, in the running text up to each event, without building it.

    An event adds what lies in its own text and across the joint with the former one, for which
    the last characters of the running text, fewer than the longest word has, are enough.  Every
    event has at least its leading space, so as many former events hold them.  A word without a
    space lies in one event, so its events are counted by themselves.  A word with a space that
    overlaps itself could be counted otherwise at a joint and is refused.
    """
    if odd := uncountable(words):
        raise ValueError(f"cannot be counted event by event: {odd}")
    w = Window.partitionBy(key).orderBy(order)
    added = F.lit(0).cast("long")
    for word in words:
        n = len(word) - 1 if " " in word else 0
        own = F.concat(F.lit(" "), F.lower(F.coalesce(F.col(text), F.lit(""))))
        if n:
            former = F.array_join(F.collect_list(F.right(own, F.lit(n))).over(w.rowsBetween(-n, -1)), "")
            own = F.concat(F.right(former, F.lit(n)), own)
        added = added + mentions(own, [word])
    return df.withColumn("_added", added).withColumn(out, F.sum("_added").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_added")


def running_scores(df: DataFrame, key: str, order: str, groups: dict[str, list[str]], text: str = "text", other: str = "other") -> DataFrame:
    """``running_text`` with ``keyword_scores``, but for ``all_text``: chunks and score_<group> from counts that are summed."""
    out = df.withColumn("chunks", F.row_number().over(Window.partitionBy(key).orderBy(order)).cast("long"))
    for g, words in groups.items():
        out = running_mentions(out, key, order, words, f"_n_{g}", text)
    return _shares(out, groups, other)


def keyword_scores(df: DataFrame, groups: dict[str, list[str]], text: str = "all_text", other: str = "other") -> DataFrame:
    """Adds score_<group>: a group's share of all mentions; ``other`` gets 1 where there are none."""
    low = F.lower(F.col(text))
    return _shares(df.withColumns({f"_n_{g}": mentions(low, words) for g, words in groups.items()}), groups, other)


def _shares(out: DataFrame, groups: dict[str, list[str]], other: str) -> DataFrame:
    total = sum((F.col(f"_n_{g}") for g in groups), F.lit(0).cast("long"))
    out = out.withColumn("_total", total)
    scores = {f"score_{g}": F.when(F.col("_total") > 0, F.col(f"_n_{g}") / F.col("_total")).otherwise(F.lit(0.0)) for g in groups}
    out = out.withColumns(scores)
    rest = F.lit(0.0)
    for g in groups:
        rest = rest + F.col(f"score_{g}")
    return out.withColumn(f"score_{other}", F.lit(1.0) - rest).drop("_total", *[f"_n_{g}" for g in groups])


def top_cause(scores: list[tuple[str, Column]]) -> Column:
    """struct(label, score) of the highest score; of equals the first in the list."""
    entries = F.array(*[F.struct((-s).alias("neg"), F.lit(i).alias("pos"), F.lit(name).alias("label"), s.alias("score")) for i, (name, s) in enumerate(scores)])
    best = F.array_min(entries)
    return F.struct(best["label"].alias("label"), best["score"].alias("score"))


def ranked_causes(causes: Column) -> Column:
    """An array of struct<label, score> by falling score; equals keep their order."""
    keyed = F.transform(causes, lambda c, i: F.struct((-c["score"]).alias("neg"), i.alias("pos"), c.alias("cause")))
    return F.transform(F.array_sort(keyed), lambda x: x["cause"])


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda x: x != "")).cast("long")


def gate(df: DataFrame, key: str, order: str, text: str = "text", least: int = MIN_WORDS) -> DataFrame:
    """(key, order, batch): events gathered until a batch has ``least`` words (0: one event each); the tail is a batch too.

    A fold with a reset, which no window expresses; each key's events are small
    (their word counts only) and come to the worker sorted.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, batch long"
    narrow = df.select(key, order, word_count(F.coalesce(F.col(text), F.lit(""))).alias("_w"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: tuple = (None, 0, 0)  # key, words, batch; rows of a key follow one another
        for pdf in batches:
            numbers = []
            for k, w in zip(pdf[key], pdf["_w"]):
                last, words, batch = state
                if k != last:
                    words, batch = 0, 0
                numbers.append(batch)
                words += w
                state = (k, 0, batch + 1) if words >= least else (k, words, batch)
            yield pdf[[key, order]].assign(batch=numbers)

    return narrow.repartition(key).sortWithinPartitions(key, order).mapInPandas(run, schema)


def batch_texts(gated: DataFrame, df: DataFrame, key: str, order: str, text: str = "text") -> DataFrame:
    """One row per batch: its first event's order value, number of events and joined text."""
    j = df.join(gated, [key, order])
    parts = F.array_sort(F.collect_list(F.struct(order, text)))
    return j.groupBy(key, "batch").agg(F.min(order).alias(order), F.count(F.lit(1)).alias("n"), F.array_join(F.transform(parts, lambda p: p[text]), " ").alias("text"))


def idle_flushes(df: DataFrame, key: str, ts: str, order: str, idle: float = IDLE_SECONDS) -> DataFrame:
    """(key, flush, n): pending events leave when, at a new one, ``idle`` seconds have passed since the last
    flush (the first event starts the clock); what is left at the end is the last flush."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, since, number = None, 0.0, 0
        for pdf in batches:
            out = []
            for k, s in zip(pdf[key], pdf["_s"]):
                if k != last:
                    last, since, number = k, s, 0
                elif s - since >= idle:
                    since, number = s, number + 1
                out.append(number)
            yield pdf[[key]].assign(flush=out)

    narrow = df.select(key, order, (F.unix_micros(ts) / 1e6).alias("_s"))
    numbered = narrow.repartition(key).sortWithinPartitions(key, "_s", order).mapInPandas(run, f"`{key}` {kinds[key]}, flush long")
    return numbered.groupBy(key, "flush").agg(F.count(F.lit(1)).alias("n"))


def line_deltas(df: DataFrame, line: list[str], order: str, text: str = "text") -> DataFrame:
    """Rows whose line's text is new, with ``delta``: the part after the former text, or all of it where it doesn't continue it."""
    w = Window.partitionBy(*line).orderBy(order)
    trimmed = df.withColumn("_t", F.trim(F.coalesce(text, F.lit("")))).where("_t <> ''")
    prev = F.coalesce(F.lag("_t").over(w), F.lit(""))
    out = trimmed.withColumn("_p", prev).where("_t <> _p")
    delta = F.when(F.startswith(F.col("_t"), F.col("_p")), F.trim(F.expr("substring(_t, length(_p) + 1)"))).otherwise(F.col("_t"))
    return out.withColumn("delta", delta).where("delta <> ''").drop("_t", "_p")


def preview_changes(df: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """Rows with a preview that isn't empty and differs from the one before."""
    w = Window.partitionBy(key).orderBy(order)
    t = F.trim(F.coalesce(F.col(text), F.lit("")))
    out = df.withColumns({"_t": t, "_p": F.coalesce(F.lag(t).over(w), F.lit(""))})
    return out.where("_t <> '' and _t <> _p").drop("_t", "_p")


def committed(df: DataFrame) -> DataFrame:
    """Final events with text."""
    return df.where(F.col("committed") & (F.trim("text") != ""))


def resets(df: DataFrame, key: str, order: str, reset: Column) -> DataFrame:
    """Drops reset events and adds ``session``, which counts them: state keyed by (key, session) starts anew."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("session", F.sum(F.when(reset, 1).otherwise(0)).over(w).cast("long")).where(~reset)


class Transcriber:
    """What makes events (key, order, text, committed) of a stream of audio. A transcriber says in ``events`` how; it
    gets rows (key, chunk, blob) of 16-bit samples, batch or stream."""

    def events(self, chunks: DataFrame, key: str) -> DataFrame:
        raise NotImplementedError


class ChunkTranscriber(Transcriber):
    """Recognises each chunk by itself: an injected function from samples (bytes) to text; silence is empty text, and so is
    a chunk on which the function fails, with ``error`` set."""

    def __init__(self, recognise, silence: int = 33):
        self.recognise, self.silence = recognise, silence

    def events(self, chunks: DataFrame, key: str) -> DataFrame:
        import numpy as np

        kind = chunks.schema[key].dataType.simpleString()
        recognise, silence = self.recognise, self.silence

        def one(blob) -> tuple[str, str | None]:
            samples = np.frombuffer(bytes(blob or b""), "<i2", count=len(blob or b"") // 2)
            if not len(samples) or np.abs(samples.astype(np.int32)).max() < silence:
                return "", None
            try:
                return recognise(bytes(blob)), None
            except Exception as problem:  # one chunk's failure is that chunk's only
                return "", str(problem)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                got = [one(b) for b in pdf["blob"]]
                yield pdf[[key, "chunk"]].assign(text=[x for x, _ in got], committed=True, error=[e for _, e in got])

        return chunks.select(key, "chunk", "blob").mapInPandas(run, f"`{key}` {kind}, chunk long, text string, committed boolean, error string")

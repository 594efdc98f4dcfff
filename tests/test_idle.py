"""The idle flush on event time: the same flushes for any split into micro-batches, late rows, ties, ends."""

import os
import random
import uuid
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from causegraph.plans.dialogue_queries import run_stream
from causegraph.streaming import processors

SCHEMA = "k string, id long, ts timestamp, text string, end boolean"
BEGIN = datetime(2024, 1, 1, tzinfo=timezone.utc)
WORDS, IDLE, POLL = 5, 10_000, 1000


def plainly(rows):
    """(k, at in ms, n, text, why) by going through each dialogue."""
    out = []
    for key in sorted({r[0] for r in rows}):
        own = sorted((r[2], r[1], r[3], r[4]) for r in rows if r[0] == key)
        since, pending = own[0][0], []
        for ms, _, text, end in [*own, (float("inf"), 0, "", False)]:
            if pending and (due := max(since + IDLE, pending[0][0] + POLL)) < ms:
                out.append((key, due, len(pending), " ".join(t for _, t in pending), "idle"))
                since, pending = due, []
            if text:
                pending.append((ms, text))
            if pending and (end or sum(len(t.split()) for _, t in pending) >= WORDS):
                out.append((key, ms, len(pending), " ".join(t for _, t in pending), "end" if end else "words"))
                since, pending = ms, []
    return sorted(out)


def streamed(spark, folder, batches, delay="0 seconds"):
    """One file, and so one micro-batch, for each batch of rows; a last one carries the watermark on."""
    for i, rows in enumerate([*batches, [("none", 0, 10**9, "", False)]]):
        path = f"{folder}/part-{i}"
        data = [(k, n, BEGIN + timedelta(milliseconds=ms), text, end) for k, n, ms, text, end in rows]
        spark.createDataFrame(data, SCHEMA).coalesce(1).write.parquet(path)
        for f in os.listdir(path):
            os.utime(f"{path}/{f}", (1_700_000_000 + i, 1_700_000_000 + i))
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/part-*")
    gate = lambda df: processors.event_idle_gate_stream(df, "k", "ts", "id", WORDS, IDLE, POLL, delay)
    out = run_stream(spark, source, gate, "idle").collect()
    begin = int(BEGIN.timestamp() * 1000)
    return sorted((r.k, r["at"] // 1000 - begin, r.n, r.text, r.why) for r in out)


def dialogue(rng, n):
    ms, rows = 0, []
    for i in range(n):
        ms += rng.choice((0, 200, 900, 3000, 9000, 14_000))
        rows.append((rng.choice("ab"), i, ms, rng.choice(("", "one", "two words", "three more words", None)), rng.random() < 0.05))
    return rows


@pytest.fixture(scope="module")
def rows():
    return dialogue(random.Random(5), 120)


@pytest.mark.parametrize("cuts", [[], [1, 2, 60], [30, 60, 90]])
def test_any_split_gives_the_same_flushes(spark, rows, tmp_path, cuts):
    batches = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
    # a batch must not begin with the time that the one before ends with, as the watermark stands there
    got = streamed(spark, str(tmp_path), batches, "1 second")
    assert got == plainly(rows) and {r[4] for r in got} == {"idle", "words", "end"}


def test_order_within_the_delay_does_not_matter(spark, rows, tmp_path):
    mixed = rows[:]
    random.Random(2).shuffle(mixed)
    assert streamed(spark, str(tmp_path), [mixed[:50], mixed[50:]], "2 hours") == plainly(rows)


def test_late_rows_are_dropped(spark, tmp_path):
    first = [("a", 1, 0, "one", False), ("a", 2, 60_000, "two", False)]
    late = [("a", 3, 1000, "too late", False), ("a", 4, 61_000, "three", True)]
    assert streamed(spark, str(tmp_path), [first, [("b", 9, 60_500, "b", False)], late]) == plainly([*first, ("b", 9, 60_500, "b", False), late[1]])

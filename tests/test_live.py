"""Sessions as a stream of blobs, the outbox, and the queue of pending requests."""

import os
import random
from collections import Counter

import pytest
from pyspark.errors import StreamingQueryException

from causegraph.plans.dialogue_queries import run_stream
from causegraph.sources import live
from causegraph.streaming import processors


def write(path, data):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "ab") as f:
        f.write(data)


def delivered(spark, folder, schema):
    return sorted(((r.session, r["at"], bytes(r.blob) if r.blob is not None else None, r.end) for r in live.delivered(spark, f"{folder}/outbox", schema).collect()), key=lambda r: r[:2])


def test_sessions_grow_between_runs_and_nothing_is_lost_or_sent_twice(spark, tmp_path):
    folder = str(tmp_path)
    stream = live.session_blobs(spark, f"{folder}/in", 4)
    step = lambda: live.deliver(stream, f"{folder}/outbox", f"{folder}/ck", availableNow=True).awaitTermination()
    os.makedirs(f"{folder}/in")
    step()
    assert delivered(spark, folder, stream.schema) == []
    write(f"{folder}/in/a.raw", b"abcdefghij")
    write(f"{folder}/in/b.raw", b"12")
    write(f"{folder}/in/_draft", b"no session")
    step()
    assert delivered(spark, folder, stream.schema) == [("a", 0, b"abcd", False), ("a", 1, b"efgh", False)]
    write(f"{folder}/in/a.raw", b"kl")
    write(f"{folder}/in/b.raw", b"345")
    write(f"{folder}/in/b.end", b"")
    write(f"{folder}/in/c.raw", b"")
    write(f"{folder}/in/c.end", b"")
    step()
    # the outbox has its list, but Spark's log of the batch is gone, as after a crash between the two
    commits = f"{folder}/ck/commits"
    newest = max((n for n in os.listdir(commits) if n.isdigit()), key=int)
    for n in (newest, f".{newest}.crc"):
        if os.path.exists(f"{commits}/{n}"):
            os.remove(f"{commits}/{n}")
    write(f"{folder}/in/a.end", b"")
    step()
    step()
    assert delivered(spark, folder, stream.schema) == [
        ("a", 0, b"abcd", False), ("a", 1, b"efgh", False), ("a", 2, b"ijkl", False), ("a", 3, None, True),
        ("b", 0, b"1234", False), ("b", 1, b"5", False), ("b", 2, None, True), ("c", 0, None, True),
    ]
    # files of tasks that never came to a list don't count, nor does another stream's batch of the same number replace one
    listed = len(os.listdir(f"{folder}/outbox/commits"))
    live.deliver(stream, f"{folder}/outbox", f"{folder}/other", availableNow=True).awaitTermination()
    twice = Counter(r[:2] for r in delivered(spark, folder, stream.schema))
    assert set(twice.values()) == {2} and len(os.listdir(f"{folder}/outbox/commits")) > listed


def test_a_batch_whose_list_is_missing_is_sent_again(spark, tmp_path):
    """A crash before the list: the files stay unlisted, the batch is repeated from the same offsets."""
    folder = str(tmp_path)
    write(f"{folder}/in/a.raw", b"abcd")
    write(f"{folder}/in/a.end", b"")
    stream = live.session_blobs(spark, f"{folder}/in", 4)
    write(f"{folder}/outbox/commits", b"in the way of the folder for lists")
    run = live.deliver(stream, f"{folder}/outbox", f"{folder}/ck", availableNow=True)
    with pytest.raises(StreamingQueryException):
        run.awaitTermination()
    os.remove(f"{folder}/outbox/commits")
    assert delivered(spark, folder, stream.schema) == []
    live.deliver(stream, f"{folder}/outbox", f"{folder}/ck", availableNow=True).awaitTermination()
    assert delivered(spark, folder, stream.schema) == [("a", 0, b"abcd", False), ("a", 1, None, True)]


def test_slices_cover_every_byte_once(monkeypatch):
    monkeypatch.setattr(live, "SLICE", 64)
    rng = random.Random(1)
    for _ in range(300):
        size = rng.randint(1, 20)
        reader = live._SessionReader("/nowhere", size)
        start, end, want = {}, {}, {}
        for name in "abcde"[: rng.randint(0, 5)]:
            upto, ended = rng.randint(0, 400), rng.random() < 0.5
            before = rng.randint(0, upto // size) * size
            if rng.random() < 0.7:
                start[name] = [before, False]
            end[name] = [upto if ended else max(upto // size * size, before), ended]
            want[name] = (start.get(name, (0, 0))[0], *end[name])
        ranges = [r for s in reader.partitions(start, end) for r in s.ranges]
        for name, (a, b, ended) in want.items():
            own = [r for r in ranges if r[0] == name]
            assert [x for r in own for x in range(r[1], r[2])] == list(range(a, b))
            assert all(r[1] % size == 0 for r in own if r[1] < r[2]) and sum(r[3] for r in own) == ended
        assert all(sum(y - x for _, x, y, _ in s.ranges) <= max(64 // size, 1) * size for s in reader.partitions(start, end))
    with pytest.raises(ValueError):
        live._SessionReader("/nowhere", 0)


def test_recorded_sessions(spark, tmp_path):
    rows = [("b", 2, b"cd"), ("a", 1, None), ("b", 1, b"ab"), (None, 1, b"x"), ("c", 1, b"z")]
    live.record_sessions(spark.createDataFrame(rows, "k string, i int, blob binary"), "k", "i", "blob", str(tmp_path / "in"))
    assert sorted(os.listdir(tmp_path / "in")) == ["a.end", "a.raw", "b.end", "b.raw", "c.end", "c.raw"]
    assert (tmp_path / "in/b.raw").read_bytes() == b"abcd" and (tmp_path / "in/a.raw").read_bytes() == b""
    empty = spark.createDataFrame([], "k string, i int, blob binary")
    live.record_sessions(empty, "k", "i", "blob", str(tmp_path / "none"))
    assert live.delivered(spark, str(tmp_path / "none"), empty.schema).count() == 0


def plainly(events, most):
    queues, out = {}, []
    for k, at, request, done in sorted(events, key=lambda e: e[1]):
        q = queues.setdefault(k, [])
        if request is None:
            continue
        if done:
            if request in q:
                q.remove(request)
                out.append((k, at, request, "done", len(q)))
        elif request not in q:
            q.append(request)
            if len(q) > most:
                out.append((k, at, q.pop(0), "shed", len(q)))
    return sorted(out)


@pytest.mark.parametrize("most", [1, 3])
def test_pending_requests_over_micro_batches(spark, tmp_path, most):
    rng = random.Random(most)
    events = [(rng.choice("ab"), i, rng.choice([None, *range(max(i - 6, 0), i + 1)]), rng.random() < 0.4) for i in range(60)]
    for b in range(3):
        path = f"{tmp_path}/in/part-{b}"
        spark.createDataFrame(events[20 * b : 20 * b + 20], "k string, i long, request long, done boolean").coalesce(1).write.parquet(path)
        for f in os.listdir(path):
            os.utime(f"{path}/{f}", (1_700_000_000 + b, 1_700_000_000 + b))
    source = spark.readStream.schema("k string, i long, request long, done boolean").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/part-*")
    out = run_stream(spark, source, lambda df: processors.pending_stream(df, "k", "i", "request", most), "pending")
    got = sorted(tuple(r) for r in out.select("k", "i", "request", "why", "waiting").collect())
    assert got == plainly(events, most) and {r[3] for r in got} == {"done", "shed"}
    with pytest.raises(ValueError):
        processors.Pending("k", "i", "request", 0)

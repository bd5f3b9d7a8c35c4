from datetime import datetime, timedelta

import pytest

from lodestone.operators import assistant
from lodestone.streaming import limits
from lodestone.streaming.conversations import conversation_store
from lodestone.streaming.limits import Counter

START = datetime(2024, 1, 1)


def run(spark, tmp_path, rows, schema, make, mode="append"):
    """Feeds rows, a list of batches, as files in order; returns what the stream emits."""
    source, out = str(tmp_path / "in"), []
    for i, batch in enumerate(rows):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(source)
    query = make(stream).writeStream.foreachBatch(lambda df, _: out.extend(df.collect())).outputMode(mode).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    return out


def test_counter():
    c = Counter(10)
    c.count(0)
    c.count(9_000_000)
    assert c.at(18_999_999) == 2 and c.at(19_000_000) == 0


def plain_limits(events, limit, ttl):
    counters, out = {}, {}
    for key, event_id, ts in sorted(events, key=lambda e: (e[2], e[1])):
        c = counters.setdefault(key, Counter(ttl))
        micros = int((ts - START).total_seconds() * 1_000_000) + 10**15
        out[event_id] = c.at(micros) < limit
        if out[event_id]:
            c.count(micros)
    return out


def test_rate_limit_over_batches(spark, tmp_path):
    seconds = [0, 100, 200, 300, 650, 800, 1500, 2200, 2300, 2310, 2320, 5000]
    events = [(i % 2, i, START + timedelta(seconds=s)) for i, s in enumerate(x for x in seconds for _ in "ab")]
    batches = [events[:7], events[7:15], events[15:]]
    got = run(spark, tmp_path, batches, "key long, event_id long, ts timestamp", lambda s: limits.rate_limited(s, "key", 3, 600))
    assert {r.event_id: r.allowed for r in got} == plain_limits(events, 3, 600)


def test_breaker_opens_and_closes(spark, tmp_path):
    failed = [True, True, True, True, False, True]
    events = [(1, i, START + timedelta(seconds=i), f) for i, f in enumerate(failed)]
    got = run(spark, tmp_path, [events[:2], events[2:]], "key long, event_id long, ts timestamp, failed boolean", lambda s: limits.circuit_breaker(s, "key", 3))
    assert [r.open for r in sorted(got, key=lambda r: r.event_id)] == [False, False, True, True, False, False]


def test_late_events_meet_the_counter_as_it_stands(spark, tmp_path):
    """An event of the second batch lies before those of the first, within the watermark: it counts, and time doesn't turn back."""
    at = lambda s: START + timedelta(seconds=s)
    batches = [[(1, 0, at(1000)), (1, 1, at(1100))], [(1, 2, at(900)), (1, 3, at(1699)), (1, 4, at(1750))], [(1, 5, at(2400))]]
    got = run(spark, tmp_path, batches, "key long, event_id long, ts timestamp", lambda s: limits.rate_limited(s, "key", 3, 600))
    # the third is allowed late; the counter's last event is still the one at 1100, so it lives until 1700
    assert {r.event_id: (r.allowed, r.counted) for r in got} == {0: (True, 1), 1: (True, 2), 2: (True, 3), 3: (False, 3), 4: (True, 1), 5: (True, 1)}


def test_state_is_readable_and_dropped_in_time(spark, tmp_path):
    from lodestone.streaming.state import state_of

    at = lambda s: START + timedelta(seconds=s)
    batches = [[(1, 0, at(0)), (1, 1, at(10)), (2, 2, at(20))], [(2, 3, at(3000))], [(3, 4, at(3001))]]
    run(spark, tmp_path, batches, "key long, event_id long, ts timestamp", lambda s: limits.rate_limited(s, "key", 3, 600))
    left = {r.key: r.n for r in state_of(spark, str(tmp_path / "state"), "counter").collect()}
    assert left == {2: 1, 3: 1}  # the first key's counter went with its timer


def test_a_keys_batch_of_many_frames_is_in_order(spark, tmp_path):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        events = [(1, i, START + timedelta(seconds=(i * 37) % 101)) for i in range(100)]
        got = run(spark, tmp_path, [events], "key long, event_id long, ts timestamp", lambda s: limits.rate_limited(s, "key", 40, 600))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.event_id: r.allowed for r in got} == plain_limits(events, 40, 600)


def test_conversations_expire(spark, tmp_path):
    at = lambda h: START + timedelta(hours=h)
    rows = [[(1, 0, "user", "a", at(0)), (1, 1, "assistant", "b", at(1))], [(1, 2, "user", "c", at(8))], [(1, 3, "system", "d", at(17))]]
    got = run(spark, tmp_path, rows, "conv_id long, turn long, role string, content string, ts timestamp", conversation_store, "update")
    last = max(got, key=lambda r: r.last_seen)
    assert last.n_messages == 1 and last.recent == "Assistant: d"
    assert max(r.n_messages for r in got) == 3


@pytest.mark.parametrize("bucket", [60, 1000, 86_400])
def test_sessions_do_not_depend_on_stretches(spark, bucket):
    seconds = [0, 10, 59, 60, 200, 799, 1399, 2000, 86_399, 86_401, 200_000]
    df = spark.createDataFrame([(k, START + timedelta(seconds=s)) for s in seconds for k in (1, 2)], "k long, ts timestamp")
    got = sorted((r.k, r.session, (r.started - START).total_seconds(), r.n) for r in assistant.sessions(df, "k", "ts", 600, bucket).collect())
    assert got == [(k, i, s, n) for k in (1, 2) for i, s, n in ((1, 0, 6), (2, 1399, 1), (3, 2000, 1), (4, 86_399, 2), (5, 200_000, 1))]




def test_a_rebuild_that_fails_goes_on_where_it_was(spark, tmp_path, monkeypatch):
    """Four files, a file a micro-batch; the third fails after its segment is written. Each file counts once in the end."""
    from lodestone.operators import indexing
    from lodestone.sources.posts import POSTS
    from lodestone.sources.store import IndexStore
    from lodestone.streaming import index

    rows = [(i, "post", "draft" if i == 7 else "publish", f"title {i}", f"word{i % 3} text", "", "me", "s", "u", START) for i in range(12)]
    for part in range(4):
        spark.createDataFrame(rows[3 * part : 3 * part + 3], POSTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "posts"))
    store = IndexStore(spark, str(tmp_path / "index"))
    tries = []
    append = store.append

    def failing(*parts):
        append(*parts)
        tries.append(1)
        if len(tries) == 3:
            raise RuntimeError("the driver died")

    monkeypatch.setattr(store, "append", failing)
    stream = lambda: spark.readStream.schema(POSTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "posts"))
    start = lambda: index.rebuild(stream(), store, str(tmp_path / "state"))
    with pytest.raises(Exception, match="the driver died"):
        start().awaitTermination()
    assert store.get("rebuild")["status"] == "running" and store.get("rebuild")["processed"] in (5, 6)
    done = index.rebuilt(start(), store)
    assert (done["status"], done["processed"], len(done["batches"])) == ("complete", 11, 4) and len(tries) == 5
    assert indexing.status_of(store).first().total_docs == 11
    assert index.rebuilt(start(), store)["processed"] == 11 and len(tries) == 5


def test_the_corpus_is_fed_by_the_last_change_of_a_post(spark, tmp_path):
    """Kept ranks, new entries in the order of the feed, drafts and deletions gone, and a batch that is applied twice."""
    from pyspark.sql import functions as F

    from lodestone.operators import snapshot
    from lodestone.sources.posts import POSTS
    from lodestone.sources.store import IndexStore
    from lodestone.streaming import corpus

    post = lambda i, title, status="publish": (i, "post", status, title, "text", "", "me", "s", "u", START + timedelta(minutes=i))
    frame = lambda rows: spark.createDataFrame(rows, POSTS)
    store = IndexStore(spark, str(tmp_path / "index"))
    corpus.write(store, snapshot.build_corpus(frame([post(i, f"t{i}") for i in range(1, 6)])))
    schema = frame([]).withColumns({"seq": F.lit(0), "op": F.lit("")}).schema
    batches = [[(*post(9, "nine"), 1, "save"), (*post(3, "three"), 2, "save"), (*post(7, "seven"), 3, "save"), (*post(2, "x"), 4, "delete")], [(*post(9, "nine again"), 5, "save"), (*post(4, "x", "draft"), 6, "save"), (*post(2, "two"), 7, "save")]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "changes"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "changes"))
        corpus.feed(stream, store, str(tmp_path / "state")).awaitTermination()
    shown = lambda df: sorted((r.corpus_rank, r.post_id, r.title) for r in df.collect())
    want = [(1, 5, "t5"), (3, 3, "three"), (5, 1, "t1"), (1001, 9, "nine again"), (1003, 7, "seven"), (1007, 2, "two")]
    assert shown(corpus.read(store)) == want
    assert shown(corpus.fed(corpus.read(store), spark.createDataFrame(batches[1], schema))) == want

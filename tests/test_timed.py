import json
import random
import time

import pytest
from pyspark.sql import functions as F

from sediment.functions.formats import ObjectScan
from sediment.sources import sse
from sediment.streaming import events as ev
from sediment.streaming import timed

TEXTS = ["data: one\n\n", "data: é漢\r\ndata: two\r\n\r\n", ": note\rdata:3\r\r", "event: x\ndata\ndata: y\n\n\n\n", "\n\r\ndata: {\"a\": 1}\n\r\n", "id: 7\n\n", "data: last\r\n\r\n", "data: [DONE]\n\n", "data: after\n\n"]


def whole_events(data):
    return list(sse.events_in(lambda a, b: data[a:b], 0, len(data)))


def test_ranges_give_each_event_once():
    """Any two cuts of any stream, with any step back, give the events of the whole."""
    rng = random.Random(4)
    for trial in range(60):
        data = "".join(rng.choices(TEXTS, k=rng.randint(0, 6))).encode() + rng.choice([b"", b"data: open", b"data: open\n", b"\r", b"data: x\r"])
        want = whole_events(data)
        for a in range(len(data) + 1):
            sse.STEP_BYTES, kept = rng.choice([1, 2, 5, 64]), sse.STEP_BYTES
            b = rng.randint(a, len(data))
            got = [e for x, y in ((0, a), (a, b), (b, len(data))) for e in sse.events_in(lambda i, j, d=data: d[i:j], x, y)]
            sse.STEP_BYTES = kept
            assert got == want, (trial, a, b, data)
    assert [d.decode() for _, d in whole_events("".join(TEXTS).encode())] == ["one", "é漢\ntwo", "3", "\ny", '{"a": 1}', "last", "[DONE]", "after"]


@pytest.fixture(scope="module", autouse=True)
def two_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.fixture(scope="module")
def source(spark):
    spark.dataSource.register(sse.SseSource)
    return spark


def run(spark, frame, out, checkpoint):
    query = frame.writeStream.format("parquet").option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start(str(out))
    query.awaitTermination(120)


def test_stream_equals_batch_at_any_cut_and_after_restarts(source, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    rng = random.Random(6)
    streams = {f"s{n}.sse": "".join(rng.choices(TEXTS, k=12)).encode() + b"data: \xff\n\n" for n in range(3)}
    cuts = {name: [0, *sorted(rng.sample(range(len(data)), 2)), len(data)] for name, data in streams.items()}
    for k in range(3):  # each round is a query of its own, begun from the checkpoint of the one before
        for name, data in streams.items():
            with open(folder / name, "ab") as f:
                f.write(data[cuts[name][k] : cuts[name][k + 1]])
        run(source, source.readStream.format("sse").load(f"file://{folder}"), tmp_path / "out", tmp_path / "cp")
    want = [(name, at, None if b"\xff" in d else d.decode(), "bad_utf8" if b"\xff" in d else None) for name, data in streams.items() for at, d in whole_events(data)]
    got = source.read.parquet(str(tmp_path / "out")).collect()
    batch = source.read.format("sse").load(f"file://{folder}").collect()
    small = source.read.format("sse").option("rangeBytes", 17).load(f"file://{folder}")
    assert small.rdd.getNumPartitions() > 10
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, map(tuple, batch))) == sorted(map(str, map(tuple, small.collect()))) == sorted(map(str, want))
    empty = tmp_path / "none"
    empty.mkdir()
    assert source.read.format("sse").load(f"file://{empty}").collect() == []


def test_a_batch_is_replayed_alike(source, tmp_path):
    """A query killed in a batch, after its offsets were written, reads the same rows again."""
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.sse").write_bytes(b"data: 1\n\ndata: 2\n\ndata: 3")

    def lost(frame, n):
        raise RuntimeError("executor lost")

    stream = source.readStream.format("sse").load(f"file://{folder}")
    query = stream.writeStream.foreachBatch(lost).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="executor lost"):
        query.awaitTermination(60)
    with open(folder / "a.sse", "ab") as f:
        f.write(b"\n\ndata: 4\n\n")
    seen = []
    for _ in range(2):  # the first run ends the batch that was begun
        query = stream.writeStream.foreachBatch(lambda frame, n: seen.append([r["data"] for r in frame.collect()])).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(60)
    assert seen[0] == ["1", "2"] and sum(seen, []) == ["1", "2", "3", "4"]


def test_scan_of_any_pieces():
    rng = random.Random(2)
    objects = ['{"a": "} { \\\\" }"}', '{"b": {"c": [1, {"d": "\\\\\\\\"}]}}', "{}", '{"e": "é漢"}', '{ "f" : "\\\\u007d" }']
    objects = [o.replace("\\\\", "\\") for o in objects]
    for _ in range(200):
        text = 'say "hi [' + ' ,"'.join(rng.choices(objects, k=5)) + '] then {"open'
        scan, got, at = ObjectScan(), [], 0
        while at < len(text):
            step = rng.randint(1, 9)
            got += scan.feed(text[at : at + step])
            at += step
            assert len(scan.tail) <= 60
        assert got == [o for o in got if json.loads(o) is not None] and len(got) == 5 and scan.tail == '{"open'


def fed(spark, tmp_path, batches, schema, build, name):
    """The rows that a stream gives, batch by batch, each batch by a query of its own from one checkpoint."""
    for n, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.json(str(tmp_path / f"in/{n}"))
        source = spark.readStream.schema(schema).json(str(tmp_path / "in/*"))
        query = build(source).writeStream.outputMode("append").format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
        query.awaitTermination(120)
    return spark.read.parquet(str(tmp_path / "out")).collect()


def test_objects_cut_anywhere_come_once(spark, tmp_path):
    texts = {"s": '[{"a": "}{"}, {"b": {"c": 1}}, {"d": 2}]', "t": 'x {"é": "\\"漢"} {"open": '}
    pieces = [(k, n, t[n : n + 3]) for k, t in texts.items() for n in range(0, len(t), 3)]
    batches = [[p for p in pieces if p[1] < 20][::-1], [p for p in pieces if p[1] >= 20] + [("u", 0, None)]]
    got = fed(spark, tmp_path, batches, "stream_id string, seq long, piece string", lambda s: timed.objects_of_streams(s, None), "objects")
    assert sorted((r["stream_id"], r["n"], r["object"]) for r in got) == [("s", 0, '{"a": "}{"}'), ("s", 1, '{"b": {"c": 1}}'), ("s", 2, '{"d": 2}'), ("t", 0, '{"é": "\\"漢"}')]


def test_idle_texts_are_forgotten(spark, tmp_path):
    """With a time to live the state of an idle text goes: what follows is read as a new text."""
    schema = "stream_id string, seq long, piece string"
    build = lambda: timed.objects_of_streams(spark.readStream.schema(schema).json(str(tmp_path / "in")), 1)
    (tmp_path / "in").mkdir()
    query = build().writeStream.format("memory").queryName("idle").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    try:
        for n, piece in enumerate(['{"a": {', '"b": 1}} {"c": 2}']):
            spark.createDataFrame([("s", n, piece)], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
            until = time.time() + 25
            while time.time() < until and sum(p.numInputRows for p in query.recentProgress) <= n:
                time.sleep(0.2)
            time.sleep(3 * (n == 0))
        assert [(r["n"], r["object"]) for r in spark.sql("select * from idle").collect()] == [(0, '{"c": 2}')]
    finally:
        query.stop()


def test_nothing_after_the_end_mark(source, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for n, text in enumerate(["data: 1\n\ndata: 2\n\ndata: [DONE]\n\ndata: late", "\n\ndata: later\n\n"]):
        with open(folder / "a.sse", "a") as f:
            f.write(text)
        run(source, timed.until_done(source.readStream.format("sse").load(f"file://{folder}"), None), tmp_path / "out", tmp_path / "cp")
    assert sorted(r["data"] for r in source.read.parquet(str(tmp_path / "out")).collect()) == ["1", "2"]


def test_login_window_closes_by_a_timer(spark, tmp_path):
    schema = "ip string, seq long, at string, success boolean"
    at = lambda s: f"2024-01-01 00:{s // 60:02d}:{s % 60:02d}"
    batches = [[("a", n, at(n), False) for n in range(7)] + [("b", 50, at(3), False), ("b", 51, at(4), True), ("b", 52, at(5), False)], [("c", 90, at(200), False)], [("a", 8, at(201), False)]]
    build = lambda s: timed.login_windows(s.withColumn("at", F.col("at").cast("timestamp")))
    got = fed(spark, tmp_path, batches, schema, build, "logins")
    judged = {r["seq"]: (r["allowed"], r["attempts"]) for r in got if r["seq"] is not None}
    assert judged == {**{n: (n < 5, n + 1) for n in range(7)}, 50: (True, 1), 51: (True, 2), 52: (True, 1), 90: (True, 1), 8: (True, 1)}
    assert sorted((r["ip"], r["attempts"]) for r in got if r["seq"] is None) == [("a", 7), ("b", 1)]  # closed without another attempt


def test_replies_of_a_stream_equal_the_batch_reader(source, tmp_path):
    event = lambda text, reason=None: "data: " + json.dumps({"choices": [{"delta": {"content": text}, "finish_reason": reason}]}) + "\n\n"
    folder = tmp_path / "in"
    folder.mkdir()
    whole = (event("Hel") + event("lo é", "stop") + "data: [DONE]\n\n").encode()
    for a in range(0, len(whole), 61):
        with open(folder / "r.sse", "ab") as f:
            f.write(whole[a : a + 61])
    rows = source.read.format("sse").load(f"file://{folder}")
    reply = ev.replies(ev.parse_sse(rows), seq="at").first()
    pieces = source.createDataFrame([("r.sse", n, whole[a : a + 61]) for n, a in enumerate(range(0, len(whole), 61))], "stream_id string, seq long, payload binary")
    assert reply["content"] == "Hello é" and reply["complete"] and reply["finish_reason"] == "stop"
    assert [r["data"] for r in rows.orderBy("at").collect()][:-1] == [r["data"] for r in ev.read_sse(pieces).orderBy("seq").collect()]

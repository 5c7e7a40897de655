import json

from pyspark.sql import functions as F

from sediment.streaming import events as ev


def streamed(spark, tmp_path, rows, schema, build, mode="update"):
    """The rows of a stream fed with each list of rows as one batch."""
    for n, batch in enumerate(rows):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").json(str(tmp_path / f"in/{n}"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in/*"))
    query = build(source).writeStream.outputMode(mode).format("memory").queryName(f"out_{tmp_path.name}").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return [r.asDict() for r in spark.sql(f"select * from out_{tmp_path.name}").collect()]


def test_tool_calls_grow_over_batches(spark, tmp_path):
    schema = "stream_id string, call_index int, seq long, call_id string, name string, part string"
    rows = [[("s", 0, 1, "a", "f", '{"x"')], [("s", 0, 2, None, None, ": 1}"), ("s", 1, 3, "b", "g", "")], [("s", 1, 4, "c", None, "y" * 40_000)]]
    got = streamed(spark, tmp_path, rows, schema, lambda s: ev.tool_calls(s, idle_seconds=None))
    last = {r["call_index"]: r for r in got}
    assert last[0]["arguments"] == '{"x": 1}' and not last[0]["conflict"]
    assert last[1]["conflict"] and last[1]["too_long"] and len(last[1]["arguments"]) == 32 * 1024


def test_ended_conversation_stays_ended(spark, tmp_path):
    rows = [[("c", 1, "start", None), ("c", 2, "update", "a")], [("c", 3, "end", None)], [("c", 4, "update", "late")]]
    got = streamed(spark, tmp_path, rows, "conv_id string, seq long, kind string, text string", lambda s: ev.conversation_states(s, idle_seconds=None))
    assert (got[-1]["status"], got[-1]["text"]) == ("ended", "a")


def test_login_window_begins_with_first_attempt(spark, tmp_path):
    rows = [[("ip", n, 1000 * n, False) for n in range(7)], [("ip", 7, 61_000, False), ("ip", 8, 61_500, True), ("ip", 9, 62_000, False)]]
    got = streamed(spark, tmp_path, rows, "ip string, seq long, at_ms long, success boolean", lambda s: ev.login_attempts(s, idle_seconds=None), "append")
    assert {r["seq"]: r["allowed"] for r in got} == {0: True, 1: True, 2: True, 3: True, 4: True, 5: False, 6: False, 7: True, 8: True, 9: True}


def test_sse_batch(spark):
    def data(content, reason=None):
        return "data: " + json.dumps({"choices": [{"delta": {"content": content}, "finish_reason": reason}]})

    rows = [("s", 1, data("Hel")), ("s", 2, data("lo", "stop")), ("s", 3, data(None)), ("s", 4, "data: [DONE]"), ("t", 1, "data: {bad")]
    parsed = ev.parse_sse(spark.createDataFrame(rows, "stream_id string, seq long, data string"))
    assert parsed.where("bad").count() == 1
    got = {r["stream_id"]: r for r in ev.replies(parsed).collect()}
    assert (got["s"]["content"], got["s"]["finish_reason"], got["s"]["complete"]) == ("Hello", "stop", True) and not got["t"]["complete"]


def test_stream_windows_equal_batch(spark, tmp_path):
    rows = [[(f"2024-01-01 00:{m:02d}:00", "a")] for m in range(0, 50, 5)] + [[("2024-01-02 00:00:00", "z")]]
    got = streamed(spark, tmp_path, rows, "ts string, k string", lambda s: ev.windowed_counts(s, "ts", ["k"], "10 minutes"), "append")
    batch = ev.windowed_counts(spark.createDataFrame([r for b in rows for r in b], "ts string, k string"), "ts", ["k"], "10 minutes").where(F.col("k") == "a")
    assert sorted((r["window_start"], r["n"]) for r in got) == sorted((r["window_start"], r["n"]) for r in batch.collect())


def test_idle_state_is_dropped(spark, tmp_path):
    """With a timeout the plan asks for one; without, for none."""
    schema = "conv_id string, seq long, kind string, text string"
    source = spark.readStream.schema(schema).json(str(tmp_path))
    plans = [ev.conversation_states(source, idle_seconds=n)._jdf.queryExecution().logical().toString() for n in (60, None)]
    assert "ProcessingTimeTimeout" in plans[0] and "NoTimeout" in plans[1]


def test_read_sse_over_any_cut(spark):
    event = {"choices": [{"delta": {"content": "é漢"}, "finish_reason": None}]}
    last = {"choices": [{"delta": {}, "finish_reason": "stop"}]}
    whole = ("data: " + json.dumps(event, ensure_ascii=False) + "\r\n\r\n: note\ndata: " + json.dumps(last, indent=1).replace("\n", "\ndata: ") + "\n\ndata: [DONE]\n\ndata: {bad\n\n").encode()
    first = whole[: whole.index(b": note")]
    rows = [("a", n, whole[n : n + 1]) for n in range(len(whole))] + [("b", n, first[at : at + 7]) for n, at in enumerate(range(0, len(first), 7))]
    rows += [("c", 0, b"data: {bad\n\n"), ("d", 0, b"data: \xff\n\n"), ("e", 0, b'data: {"error": 1}\n\n'), ("f", 0, None)]
    got = {}
    for r in ev.read_sse(spark.createDataFrame(rows, "stream_id string, seq long, payload binary")).orderBy("stream_id", "seq").collect():
        got.setdefault(r["stream_id"], []).append((json.loads(r["data"]) if r["data"] else None, r["error"]))
    assert got["a"] == [(event, None), (last, None)] and got["b"] == [(event, None), (None, "unfinished")]
    assert [got[k][-1][1] for k in "cdef"] == ["bad_json", "bad_utf8", "failed", "unfinished"]

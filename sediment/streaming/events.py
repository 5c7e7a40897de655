"""Event streams: server-sent deltas, tool calls, conversation state, login attempts, windows."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DELTA = "struct<choices:array<struct<delta:struct<content:string,reasoning:string,tool_calls:array<struct<index:int,id:string,function:struct<name:string,arguments:string>>>>,finish_reason:string>>>"
ARGUMENT_BYTES = 32 * 1024


def _timeout(idle_seconds: int | None) -> str:
    """State goes when its key has been idle for so long; None keeps it for ever."""
    return GroupStateTimeout.ProcessingTimeTimeout if idle_seconds else GroupStateTimeout.NoTimeout


def whole(parts: Iterator[pd.DataFrame], order: list[str]) -> Iterator[pd.DataFrame]:
    """All rows of a key in this batch of the stream, in order: Arrow may hand them over in several frames."""
    held = list(parts)
    if held:
        yield pd.concat(held).sort_values(order, kind="stable")


def read_sse(pieces: DataFrame, stream: str = "stream_id", seq: str = "seq", payload: str = "payload") -> DataFrame:
    """(stream, seq, data, error): the events of server-sent byte streams, cut anywhere, from (stream, seq, payload binary).

    A stream's bytes are joined before they are decoded, so characters, line ends of both kinds and
    events may lie across pieces. Lines of data are joined; what follows the end mark is not read. The
    last row tells what is wrong, if anything: bad_utf8, bad_json, failed (the event is no object or
    reports an error) or unfinished (neither the end mark nor a finish reason came); events before it stay.
    """
    kind = pieces.schema[stream].dataType.simpleString()

    def read(part: pd.DataFrame) -> pd.DataFrame:
        key, rows, finished = part[stream].iloc[0], [], False

        def done(error: str | None = None) -> pd.DataFrame:
            if error:
                rows.append((key, len(rows), None, error))
            return pd.DataFrame(rows, columns=[stream, "seq", "data", "error"])

        raw = b"".join(bytes(x) for x in part.sort_values(seq, kind="stable")[payload] if x is not None)
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            return done("bad_utf8")
        held: list[str] = []
        for line in [*re.split(r"\r\n|\n|\r", text), ""]:
            if line.startswith("data:") or line == "data":
                held.append(line[5:].removeprefix(" "))
            elif not line and held:
                event, held = "\n".join(held), []
                if event.strip() == "[DONE]":
                    return done()
                try:
                    value = json.loads(event)
                except ValueError:
                    return done("bad_json")
                if not isinstance(value, dict) or value.get("error"):
                    return done("failed")
                finished = finished or any(c.get("finish_reason") is not None for c in value.get("choices") or ())
                rows.append((key, len(rows), event, None))
        return done(None if finished else "unfinished")

    return pieces.select(stream, seq, payload).groupBy(stream).applyInPandas(read, f"{stream} {kind}, seq long, data string, error string")


def parse_sse(events: DataFrame, column: str = "data") -> DataFrame:
    """events with content, reasoning, tool_calls, finish_reason, done and bad, from the data of server-sent events."""
    text = F.trim(F.regexp_replace(column, r"(?m)^data: ?", ""))
    out = events.withColumn("_t", text).withColumn("done", F.col("_t") == "[DONE]").withColumn("_j", F.from_json("_t", DELTA))
    first = F.try_element_at(F.col("_j.choices"), F.lit(1))
    out = out.withColumn("bad", ~F.col("done") & F.try_parse_json("_t").isNull())
    for name, value in (("content", first["delta"]["content"]), ("reasoning", first["delta"]["reasoning"]), ("tool_calls", first["delta"]["tool_calls"]), ("finish_reason", first["finish_reason"])):
        out = out.withColumn(name, value)
    return out.drop("_t", "_j")


def replies(parsed: DataFrame, stream: str = "stream_id", seq: str = "seq") -> DataFrame:
    """(stream, content, reasoning, finish_reason, complete): deltas joined in order; the last reason given wins."""
    def joined(c: str):
        return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(seq, F.coalesce(c, F.lit("")).alias("t")))), lambda x: x["t"]), "")

    reason = F.max_by("finish_reason", F.when(F.col("finish_reason").isNotNull(), F.col(seq)))
    return parsed.groupBy(stream).agg(joined("content").alias("content"), joined("reasoning").alias("reasoning"), reason.alias("finish_reason"), F.bool_or("done").alias("complete"))


def tool_calls(fragments: DataFrame, mode: str = "update", idle_seconds: int | None = 3600) -> DataFrame:
    """(stream_id, call_index, call_id, name, arguments, conflict, too_long) from fragments (stream_id, call_index, seq, call_id, name, part).

    Parts are appended in order of arrival, by seq within a batch of the stream. State goes after idle_seconds without a part. Another id or name than the first
    is a conflict; arguments over 32 KiB are cut off and marked.
    """
    out = "stream_id string, call_index int, call_id string, name string, arguments string, conflict boolean, too_long boolean"
    kept = "call_id string, name string, arguments string, conflict boolean, too_long boolean"

    def grow(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        call_id, name, text, conflict, long_ = state.get if state.exists else (None, None, "", False, False)
        for part in whole(parts, ["seq"]):
            for row in part.itertuples():
                for field, value in (("id", row.call_id), ("name", row.name)):
                    if value is None or pd.isna(value):
                        continue
                    have = call_id if field == "id" else name
                    conflict = conflict or (have is not None and have != value)
                    if have is None:
                        call_id, name = (value, name) if field == "id" else (call_id, value)
                text += row.part if isinstance(row.part, str) else ""
                if len(text.encode()) > ARGUMENT_BYTES:
                    text, long_ = text.encode()[:ARGUMENT_BYTES].decode("utf-8", "ignore"), True
        state.update((call_id, name, text, bool(conflict), bool(long_)))
        if idle_seconds:
            state.setTimeoutDuration(1000 * idle_seconds)
        yield pd.DataFrame([(*key, call_id, name, text, bool(conflict), bool(long_))], columns=[c.split()[0] for c in out.split(", ")])

    named = fragments.select("stream_id", "call_index", "seq", "call_id", F.col("name").alias("name"), "part")
    return named.groupBy("stream_id", "call_index").applyInPandasWithState(grow, out, kept, mode, _timeout(idle_seconds))


def conversation_states(events: DataFrame, mode: str = "update", idle_seconds: int | None = 86_400) -> DataFrame:
    """(conv_id, status, text) from events (conv_id, seq, kind, text): start, update, end. An ended stream stays ended: a late update does not revive it, a new start does."""
    def follow(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        status, text = state.get if state.exists else ("none", "")
        for part in whole(parts, ["seq"]):
            for row in part.itertuples():
                if row.kind == "start":
                    status, text = "running", ""
                elif row.kind == "update" and status == "running":
                    text = row.text
                elif row.kind == "end" and status == "running":
                    status = "ended"
        state.update((status, text))
        if idle_seconds:
            state.setTimeoutDuration(1000 * idle_seconds)
        yield pd.DataFrame([(key[0], status, text)], columns=["conv_id", "status", "text"])

    named = events.select("conv_id", "seq", "kind", "text")
    return named.groupBy("conv_id").applyInPandasWithState(follow, "conv_id string, status string, text string", "status string, text string", mode, _timeout(idle_seconds))


def login_attempts(attempts: DataFrame, most: int = 5, seconds: int = 60, mode: str = "append", idle_seconds: int | None = 3600) -> DataFrame:
    """(ip, seq, allowed) for attempts (ip, seq, at_ms, success): `most` in a window that begins with the first attempt; a success clears it."""
    def judge(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        begun, n = state.get if state.exists else (0, 0)
        for part in whole(parts, ["at_ms", "seq"]):
            rows = []
            for row in part.itertuples():
                if n == 0 or row.at_ms - begun >= seconds * 1000:
                    begun, n = row.at_ms, 0
                n += 1
                rows.append((key[0], row.seq, n <= most))
                if row.success and n <= most:
                    n = 0
            yield pd.DataFrame(rows, columns=["ip", "seq", "allowed"])
        state.update((int(begun), int(n)))
        if idle_seconds:
            state.setTimeoutDuration(1000 * max(idle_seconds, 2 * seconds))

    named = attempts.select("ip", "seq", "at_ms", "success")
    return named.groupBy("ip").applyInPandasWithState(judge, "ip string, seq long, allowed boolean", "begun long, n long", mode, _timeout(idle_seconds))


def windowed_counts(events: DataFrame, ts: str, keys: list[str], width: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts of tumbling or sliding windows with a watermark (an extension; the times must be TIMESTAMP)."""
    out = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    out = out.groupBy(F.window(ts, width, slide) if slide else F.window(ts, width), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, "n")


def sessions(events: DataFrame, ts: str, user: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user that end after a gap (an extension)."""
    out = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    out = out.groupBy(F.session_window(ts, gap).alias("s"), user).agg(F.count("*").alias("n"))
    return out.select(user, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")

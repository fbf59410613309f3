import datetime
import json

from pyspark.sql import functions as F

from quarry.sources import schemas
from quarry.streaming import logs


def audited(spark, lines, stderr=None, **kw):
    df = spark.createDataFrame([("e", i + 1, x if isinstance(x, str) else json.dumps(x)) for i, x in enumerate(lines)], "execution_id string, line_no int, value string")
    return logs.audit_executions(df, stderr=None if stderr is None else spark.createDataFrame([("e", stderr)], "execution_id string, value string"), **kw)


def audit(spark, lines, **kw):
    return audited(spark, lines, **kw).collect()[0]


START, DONE = {"type": "thread.started", "thread_id": "t"}, {"type": "turn.completed", "usage": {"input": 5, "output": 2}}


def kinds(row):
    return [v.kind for v in row.violations]


def test_audit_accepts_messages_and_reasoning(spark):
    good = audit(spark, [START, {"type": "item.completed", "item": {"type": "agent_message", "text": "x"}}, "  ", {"type": "item.completed", "item": {"type": "reasoning"}}, DONE])
    assert good.valid and good.usage == {"input": 5, "output": 2} and good.thread_id == "t" and good.events == 4 and good.tool_events == 0
    # only whole numbers count as usage, and the last turn with any wins
    assert audit(spark, [START, DONE, dict(DONE, usage={"output": 9, "rate": 1.5, "flag": True, "name": "x"}), dict(DONE, usage=None)]).usage == {"output": 9}


def test_audit_finds_tools_at_any_depth(spark):
    for kind in ("command_execution", "file_change", "web_search", "mcp_tool_call"):
        row = audit(spark, [START, {"type": "item.completed", "item": {"type": kind}}, DONE])
        assert row.tool_events == 1 and [tuple(v) for v in row.violations] == [(2, "external_tool", f"event.item.type={kind}")]
    deep = {"type": "x", "a": [1, {"B": {"TYPE": "My-Shell.v2"}}, [{"Tool_Name": 0}]], "command": "", "mcp_server": [], "tool_call": {}, "b": {"tool_name": None}}
    row = audit(spark, [START, deep, DONE])
    assert [tuple(v) for v in row.violations] == [(2, "external_tool", "event.a[1].B.TYPE=My-Shell.v2, event.a[2][0].Tool_Name")]
    assert kinds(audit(spark, [START, '{"\\u0063ommand": [1]}', DONE])) == ["external_tool"]  # an escaped name
    assert audit(spark, [START, {"type": "note", "text": "web_search, command"}, DONE]).valid  # words in texts are none
    nest = {"type": "web_search"}
    for _ in range(12):
        nest = {"in": [nest]}
    assert kinds(audit(spark, [START, nest, DONE])) == ["external_tool"]


def test_audit_finds_models_and_markers(spark):
    other = {"type": "metadata", "info": [{"Effective_Model": "b"}], "model": "a", "model_id": 7}
    row = audit(spark, [START, other, DONE], model="a")
    assert [tuple(v) for v in row.violations] == [(2, "unexpected_model", "event.info[0].Effective_Model: b")] and audit(spark, [START, other, DONE]).valid
    for text in ("selected gpt-5.3-codex", "selected gpt-5.6-codex", "Falling  back to another model", "model migration is active", "model substitution occurred", "a fallback"):
        assert kinds(audit(spark, [START, DONE], stderr=text)) == ["integrity_marker"], text
        assert kinds(audit(spark, [START, {"type": "x", "text": text}, DONE])) == ["integrity_marker"], text
    assert audit(spark, [START, DONE], stderr="gpt-5.3-codex-spark").valid


def test_audit_words_of_markers(spark):
    def marks(**kw):
        return [v.detail for v in audit(spark, [START, "\u00f1que. Que", "\u00e9que\u00e9", DONE], markers=[r"\bque\b"], **kw).violations if v.kind == "integrity_marker"]

    assert marks(ascii_words=True) == ["que"] and marks() == ["Que"]
    assert audit(spark, [START, "x", DONE], markers=[r"\bque\b"], stderr="\u00e9que\u00e9", ascii_words=True).violations[-1].kind == "integrity_marker"


def test_audit_counts_and_broken_lines(spark):
    assert [tuple(v) for v in audit(spark, [START, "nope", "[1]", "3", DONE]).violations] == [(2, "not_json", ""), (3, "not_object", ""), (4, "not_object", "")]
    assert kinds(audit(spark, [START])) == ["turn_completed"] and kinds(audit(spark, [" "])) == ["no_events", "thread_started", "turn_completed"]
    assert kinds(audit(spark, [START, START, DONE, {"type": "error"}, {"type": "turn.failed"}])) == ["thread_started", "error", "turn_failed"]


def test_retry_only_what_is_transient(spark):
    def retry(lines, code, stderr):
        return logs.may_retry(audited(spark, lines, stderr).withColumns({"exit_code": F.lit(code), "stderr": F.lit(stderr)})).collect()[0].retry

    full = [START, {"type": "error", "message": "Incomplete response returned, reason: max_output_tokens"}, {"type": "turn.failed"}]
    assert retry(full, 1, "Codex ran out of room in the model's context window.") and retry([START, DONE], 1, "Connection reset by peer")
    assert not retry([START, DONE], 0, "connection reset") and not retry([START, DONE], 1, "other") and not retry([START, DONE], 1, None)
    assert not retry([START, {"item": {"type": "command_execution"}}, DONE], 1, "timed out") and not retry([START, DONE], 1, "timed out, fallback")


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    write = lambda n, rows: (folder / f"{n}.json").write_text("\n".join(json.dumps(r) for r in rows))
    write(1, [{"type": "started", "thread_id": "a", "timestamp": "1"}, {"type": "heartbeat", "thread_id": "a", "timestamp": "2"}, {"type": "started", "thread_id": "b", "timestamp": "1"}])
    state = lambda df: logs.last_state(df, "thread_id", "type", ["timestamp"])
    logs.run_to_table(state(logs.read_log_stream(spark, str(folder))), "states_1", str(tmp_path / "cp"))
    assert {r.thread_id: r["last"] for r in spark.table("states_1").collect()} == {"a": "heartbeat", "b": "started"}
    write(2, [{"type": "completed", "thread_id": "a", "timestamp": "3"}])
    logs.run_to_table(state(logs.read_log_stream(spark, str(folder))), "states_2", str(tmp_path / "cp"))
    batch = state(spark.read.schema(schemas.ddl(schemas.EVENT)).json(str(folder)))
    assert sorted(map(tuple, spark.table("states_2").collect())) == sorted(map(tuple, batch.collect()))


def test_windows(spark, tmp_path, sf_dir):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").limit(200)
    ev.coalesce(1).write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(ev.schema).parquet(str(tmp_path / "ev"))
    for name, f in (("w", lambda df: logs.stream_counts(df, "ts", "event_type")), ("s", lambda df: logs.session_counts(df, "ts", "user_id"))):
        logs.run_to_table(f(stream), f"win_{name}", str(tmp_path / f"cp_{name}"))
        batch = f(spark.read.parquet(str(tmp_path / "ev")))
        assert sorted(map(str, spark.table(f"win_{name}").collect())) == sorted(map(str, batch.collect()))


def test_marks(spark):
    assert logs.progress_marks(spark.createDataFrame([(5,)], "done int"), 10).collect()[0].marks == [25, 50]
    assert logs.event_histogram(spark.createDataFrame([("e", '{"type":"a"}'), ("e", "{}")], "execution_id string, value string")).where(F.col("type") == "<missing>").count() == 1


def test_progress_of_a_growing_log(spark, tmp_path):
    at = lambda m: datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC) + datetime.timedelta(minutes=m)
    before = spark.conf.get(logs.STORE, None)

    def grow(rows):
        spark.createDataFrame([(e, k, at(m)) for e, k, m in rows], logs.PROGRESS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        logs.into_table(logs.progress_rows(spark.readStream.schema(logs.PROGRESS).parquet(f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/cp")
        found = spark.read.parquet(f"{tmp_path}/out").selectExpr("execution_id", "kind", "n", "int(unix_seconds(at) - 1704067200) div 60 as m").collect()
        return sorted(map(tuple, found))

    one = grow([("a", "heartbeat", 5), ("a", "started", 0), ("b", "started", 1), ("b", "completed", 9), ("b", "retry", 10), ("c", "started", 2)])
    assert one == [("a", "started", 1, 0), ("b", "completed", 2, 9), ("b", "started", 1, 1), ("c", "started", 1, 2)]
    # a is heard of again before it is missed, c is not; the log's end is minute 100
    two = grow([("a", "retry", 90), ("a", "started", 91), ("z", "heartbeat", 100)])
    assert sorted(set(two) - set(one)) == [("a", "retry", 1, 90), ("a", "started", 2, 91), ("c", "silent", 1, 2)]
    three = grow([("a", "completed", 120), ("z", "heartbeat", 200)])
    assert sorted(set(three) - set(two)) == [("a", "completed", 5, 120)]  # z is heard of at the end
    assert spark.conf.get(logs.STORE, None) == before

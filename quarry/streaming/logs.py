"""Execution logs, in batch and as streams."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from quarry.functions import expressions as x
from quarry.operators.lineage import cut
from quarry.sources import schemas

# What an execution may not do or name, and what is worth another try.
TOOL_TYPES = ("browser", "command_execution", "computer", "file_change", "image_generation", "mcp", "shell", "tool_call", "web_search")
TOOL_KEYS = ("command", "mcp_server", "tool_call", "tool_name")
MODEL_KEYS = ("effective_model", "model", "model_id", "model_name", "requested_model", "selected_model")
INTEGRITY = (
    r"\bgpt-5\.3-codex(?!-spark)\b", r"\bgpt-5\.6(?:-[a-z0-9_.-]+)?\b", r"\bfall(?:ing)?\s+back\b", r"\bfallback\b", r"\bmigrat(?:e|ed|es|ing|ion)\b", r"\bmodel\s+substitut(?:e|ed|es|ing|ion)\b",
)
TRANSIENT = (
    "connection (?:reset|closed|refused)", "incomplete response returned", "stream disconnected before completion", "max_output_tokens", "ran out of room in the model's context window",
    "selected model is at capacity", "temporarily unavailable", "timed? out", r"http (?:500|502|503|504)\b", "internal server error",
)
# The edge of a word in a pattern, and the same spelt out for words of ASCII.
_EDGE, _ASCII_EDGE = r"\b", r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"


def read_log_stream(spark: SparkSession, folder: str, schema: str = schemas.EVENT, files_per_trigger: int = 100) -> DataFrame:
    """A folder of JSON-line logs as a stream."""
    return spark.readStream.schema(schemas.ddl(schema)).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def last_state(events: DataFrame, key: str, value: str, order: Sequence[str]) -> DataFrame:
    """The last event of each key; on a stream, in update mode."""
    return events.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias("last"), F.count(F.lit(1)).alias("events"))


def walk(rows: DataFrame, value: str, keys: Sequence[str], root: str = "event") -> DataFrame:
    """Every entry of the Variant column at any depth: keys, path, name (null in arrays), kind and value (Variant).

    A round explodes the containers of the level before, until none is left, so there are as many rounds as the deepest value has
    levels; each round's rows are cut from their lineage.  kind is object, array, string, null or other.
    """
    kind = F.regexp_extract(F.schema_of_variant("value"), "^(OBJECT|ARRAY|STRING|VOID)", 1)
    kind = F.coalesce(F.nullif(F.lower(F.replace(kind, F.lit("VOID"), F.lit("null"))), F.lit("")), F.lit("other"))
    outer = rows.select(*keys, F.lit(root).alias("_at"), F.col(value).alias("_in"))
    out = None
    while True:
        inner = outer.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("_in").outer()))
        step = F.when(F.col("key").isNotNull(), F.concat(F.lit("."), "key")).otherwise(F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))
        level = cut(inner.select(*keys, F.concat("_at", step).alias("path"), F.col("key").alias("name"), kind.alias("kind"), "value"))
        out = level if out is None else out.unionByName(level)
        outer = level.where(F.col("kind").isin("object", "array")).select(*keys, F.col("path").alias("_at"), F.col("value").alias("_in"))
        if outer.isEmpty():
            return out


def audit_executions(
    lines: DataFrame, model: str | None = None, stderr: DataFrame | None = None, tool_types: Sequence[str] = TOOL_TYPES, tool_keys: Sequence[str] = TOOL_KEYS, model_keys: Sequence[str] = MODEL_KEYS,
    markers: Sequence[str] = INTEGRITY, ascii_words: bool = False,
) -> DataFrame:
    """One row an execution: counts, last usage, violations (line_no, kind, detail) and whether there are none.

    lines: (execution_id, line_no, value), a JSON object each; blank ones are passed over.  stderr: (execution_id, value), one text each.
    At every depth, names without regard to case: an entry ``type`` with a fragment of ``tool_types``, and an entry of ``tool_keys``
    that is not null or empty, are external tools; a text under one of ``model_keys`` must be ``model`` (if given).  ``markers`` may match
    in no line and no stderr text; words in them are of letters of any script, or with ``ascii_words`` of A-Z, a-z, 0-9 and _ alone,
    whatever Java's own ``\\b`` takes them to be.  There must be one thread.started and one turn.completed, and no error or turn.failed.

    Only lines that hold a searched word at all, or an escape that may spell one, are walked.  Violations are those of lines by
    line number, then the first match of each marker (lines before stderr), then those of the counts.  An object that repeats a name is
    not JSON here.
    """
    text = F.trim("value")
    v = F.try_parse_json("value")
    kind = F.when(F.col("v").isNull(), "not_json").when(~F.schema_of_variant("v").startswith("OBJECT"), "not_object")
    own = lines.select("execution_id", F.col("line_no").cast("int").alias("line_no"), "value", v.alias("v")).withColumn("broken", F.when(text != "", kind)).withColumn("is_event", (text != "") & F.col("broken").isNull())
    own = own.withColumn("type", F.when(F.col("is_event"), F.coalesce(F.try_variant_get("v", "$.type", "string"), F.lit("<missing>"))))
    item = F.try_variant_get("v", "$.item", "variant")
    own = own.withColumn("item_type", F.when(F.col("is_event") & F.schema_of_variant(item).startswith("OBJECT"), F.coalesce(F.try_variant_get("v", "$.item.type", "string"), F.lit("<missing>"))))

    # what the lines say inside
    words = [*tool_types, *tool_keys, *(model_keys if model is not None else [])]
    told = own.where("is_event").where(F.lower("value").rlike("|".join(map(re.escape, words)) + r"|\\u"))
    entries = walk(told, "v", ["execution_id", "line_no"]).where(F.col("name").isNotNull()).withColumns({"low": F.lower("name"), "text": F.when(F.col("kind") == "string", F.try_variant_get("value", "$", "string"))})
    empty = (F.col("kind") == "null") | F.to_json("value").isin('""', "[]", "{}")
    hits = F.filter(F.array(
        F.when(F.col("low").isin(*tool_keys) & ~empty, F.col("path")),
        F.when((F.col("low") == "type") & F.lower("text").rlike("|".join(map(re.escape, tool_types))), F.concat("path", F.lit("="), "text")),
    ), lambda h: h.isNotNull())
    tools = entries.select("execution_id", "line_no", F.explode(hits).alias("hit")).groupBy("execution_id", "line_no").agg(F.array_join(F.array_sort(F.collect_set("hit")), ", ").alias("detail")).withColumn("kind", F.lit("external_tool"))
    found = tools
    if model is not None:
        wrong = entries.where(F.col("low").isin(*model_keys) & (F.col("text") != model))
        found = found.unionByName(wrong.select("execution_id", "line_no", F.concat("path", F.lit(": "), "text").alias("detail"), F.lit("unexpected_model").alias("kind")))
    found = found.unionByName(own.where("broken is not null").select("execution_id", "line_no", F.lit("").alias("detail"), F.col("broken").alias("kind")))
    found = found.groupBy("execution_id").agg(F.array_sort(F.collect_set(F.struct("line_no", "kind", "detail"))).alias("told"), F.count_if(F.col("kind") == "external_tool").alias("tool_events"))

    # markers, by their place: lines, then stderr
    parts = own.select("execution_id", F.col("line_no").alias("at"), "value")
    if stderr is not None:
        parts = parts.unionByName(stderr.select("execution_id", F.lit((1 << 31) - 1).alias("at"), "value"))
    matches = [F.nullif(F.regexp_extract("value", f"(?i){m.replace(_EDGE, _ASCII_EDGE)}" if ascii_words else f"(?iU){m}", 0), F.lit("")) for m in markers]
    firsts = parts.groupBy("execution_id").agg(F.array(*[F.min_by(m, F.when(m.isNotNull(), F.col("at"))) for m in matches]).alias("marks"))

    count = lambda k: F.count_if(F.col("type") == k)
    usage = F.map_filter(F.try_variant_get("v", "$.usage", "map<string,variant>"), lambda k, x: F.schema_of_variant(x) == "BIGINT")
    usage = F.transform_values(usage, lambda k, x: F.try_variant_get(x, "$", "bigint"))
    usage = F.when((F.col("type") == "turn.completed") & F.schema_of_variant(F.try_variant_get("v", "$.usage", "variant")).startswith("OBJECT"), usage)
    thread = F.when(F.col("type") == "thread.started", F.try_variant_get("v", "$.thread_id", "string"))
    own = own.withColumns({"u": usage, "t": thread}).drop("v", "value")
    out = own.groupBy("execution_id").agg(
        F.count_if("is_event").alias("events"), count("thread.started").alias("started"), count("turn.completed").alias("completed"), count("error").alias("errors"), count("turn.failed").alias("failed"),
        F.max_by("u", F.when(F.col("u").isNotNull(), F.col("line_no"))).alias("usage"), F.max_by("t", F.when(F.col("t").isNotNull(), F.col("line_no"))).alias("thread_id"),
    )
    one = lambda k, detail="": F.struct(F.lit(None).cast("int").alias("line_no"), F.lit(k).alias("kind"), detail if isinstance(detail, Column) else F.lit(detail))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    counts = F.array(
        F.when(n("events") == 0, one("no_events")), F.when(n("started") != 1, one("thread_started", n("started").cast("string"))), F.when(n("completed") != 1, one("turn_completed", n("completed").cast("string"))),
        F.when(n("errors") > 0, one("error")), F.when(n("failed") > 0, one("turn_failed")),
    )
    out = out.join(found, "execution_id", "left").join(firsts, "execution_id", "full")
    kinds = "array<struct<line_no:int,kind:string,detail:string>>"
    marks = F.transform(F.filter("marks", lambda m: m.isNotNull()), lambda m: one("integrity_marker", m))
    told = F.coalesce(F.col("told").cast(kinds), F.array().cast(kinds))
    violations = F.array_distinct(F.concat(told, marks.cast(kinds), F.filter(counts, lambda c: c.isNotNull()).cast(kinds)))
    return out.select(
        "execution_id", n("events").alias("events"), n("started").alias("started"), n("completed").alias("completed"), n("errors").alias("errors"), n("failed").alias("failed"), n("tool_events").alias("tool_events"),
        F.coalesce("usage", F.create_map().cast("map<string,bigint>")).alias("usage"), "thread_id", violations.alias("violations"), (F.size(violations) == 0).alias("valid"),
    )


def may_retry(audits: DataFrame, exit_code: str = "exit_code", stderr: str = "stderr", markers: Sequence[str] = TRANSIENT) -> DataFrame:
    """audits with ``retry``: a failing exit with a transient marker, and no tool event, wrong model or integrity marker."""
    fatal = F.exists("violations", lambda v: v["kind"].isin("integrity_marker", "unexpected_model"))
    return audits.withColumn("retry", x.retryable(F.col(exit_code), F.coalesce(F.col(stderr), F.lit("")), F.col("tool_events"), fatal, [f"(?i){m}" for m in markers]))


def event_histogram(lines: DataFrame) -> DataFrame:
    """(execution_id, type, n) of events."""
    kind = F.coalesce(F.get_json_object("value", "$.type"), F.lit("<missing>"))
    return lines.groupBy("execution_id", kind.alias("type")).agg(F.count(F.lit(1)).alias("n"))


def stream_counts(events: DataFrame, ts: str, key: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Extension: counts in tumbling windows with a watermark."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, window), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), key, "n")


def session_counts(events: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Extension: session windows."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def run_to_table(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> None:
    """Process everything that is there, then stop; progress is kept in the checkpoint, so a restart does only what is new."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def marks(done, total) -> Column:
    """The quarter marks (25, 50, 75, 100) that a count has passed."""
    done, total = (F.col(c) if isinstance(c, str) else F.lit(c) for c in (done, total))
    return F.filter(F.array(*[F.when(done * 100 >= total * q, F.lit(q)) for q in (25, 50, 75, 100)]), lambda q: q.isNotNull())


def progress_marks(done: DataFrame, total: int) -> DataFrame:
    """Which quarter marks a count has passed."""
    return done.select(marks("done", total).alias("marks"))


PROGRESS = "execution_id string, event string, at timestamp"


class Progress(StatefulProcessor):
    """What an execution's log says as it grows: a row when it starts, is tried again, falls silent and ends.

    Events: started, heartbeat, retry, completed.  Every event but the last moves a timer ``silence`` ahead in event time; if it
    fires, the execution is reported silent once, and again only after it was heard of.  Later events of an execution that has ended are counted in
    the row of its end only if they come with it.
    """

    def __init__(self, silence_ms: int):
        self.silence_ms = silence_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "starts int, retries int, events int, ended boolean, due bigint, heard bigint")

    def handleInputRows(self, key, rows, timerValues):
        starts, retries, events, ended, due, heard = tuple(self.state.get()) if self.state.exists() else (0, 0, 0, False, 0, 0)
        for us, event in sorted((r.us, r.event) for r in rows):
            events += 1
            heard = max(heard, us)
            if ended:
                continue
            if event == "started":
                starts += 1
                yield Row(execution_id=key[0], kind="started", n=starts, us=us)
            elif event == "retry":
                retries += 1
                yield Row(execution_id=key[0], kind="retry", n=retries, us=us)
            elif event == "completed":
                ended = True
                yield Row(execution_id=key[0], kind="completed", n=events, us=us)
        if due:
            self.handle.deleteTimer(due)
        due = 0
        if not ended:
            # an execution that was heard of too late is silent as of now
            due = max(heard // 1000 + self.silence_ms, timerValues.getCurrentWatermarkInMs() + 1)
            self.handle.registerTimer(due)
        self.state.update((starts, retries, events, ended, due, heard))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        starts, retries, events, ended, _, heard = tuple(self.state.get())
        self.state.update((starts, retries, events, ended, 0, heard))
        yield Row(execution_id=key[0], kind="silent", n=events, us=heard)

    def close(self) -> None:
        pass


def progress_rows(events: DataFrame, silence_ms: int = 1_800_000, late: str = "0 seconds") -> DataFrame:
    """(execution_id, kind, n, at): the rows of ``Progress`` for a stream of (execution_id, event, at); its state store must keep timers (see ``into_table``).

    n: the number of the start or retry, else the events so far; at: the event's time, for silence that of the last event heard.
    """
    rows = events.select("execution_id", "event", "at", F.unix_micros("at").alias("us")).withWatermark("at", late).groupBy("execution_id")
    out = rows.transformWithState(Progress(silence_ms), "execution_id string, kind string, n int, us bigint", "Append", "EventTime")
    return out.select("execution_id", "kind", "n", F.timestamp_micros("us").alias("at"))


#: The setting that names the state store, and the store that keeps timers.
STORE, ROCKSDB = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def into_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append what is new to a Parquet table, a folder for each batch, so that a batch that runs again replaces its own rows; then stop.

    The state is kept in RocksDB, whatever the session's setting.
    """

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")

    conf = stream.sparkSession.conf
    before = conf.get(STORE, None)
    conf.set(STORE, ROCKSDB)
    try:
        stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        conf.set(STORE, before) if before else conf.unset(STORE)

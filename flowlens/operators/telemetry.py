"""Engine telemetry to store rows: metadata documents, webhook events, monitor texts, logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.functions import status as st
from flowlens.functions import timing
from flowlens.operators import ordered
from flowlens.operators.lineage import cut, release

# Texts and names the engines write.
STATUS_LINE = r"^INFO \[(.*)\] (.+)$"
MONITOR_TEXT = r"TaskHandler\[(.+)\]"
FINAL_LINE = "final process status is"


def _get(doc: str | Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(doc, path, kind)


def _is(doc: Column, what: str) -> Column:
    return F.coalesce(F.schema_of_variant(doc).startswith(what), F.lit(False))


def _each(df: DataFrame, source: Column, key: str = "key", pos: str = "pos", value: str = "value") -> DataFrame:
    """Rows of a VARIANT object (by key) or list (by position) next to the columns they came from."""
    spark = df.sparkSession
    out = df.withColumn("_src", source).lateralJoin(spark.tvf.variant_explode(F.col("_src").outer()))
    cols = [c for c in df.columns]
    return out.select(
        *cols, F.col("key").alias(f"_{key}"), F.col("pos").alias(f"_{pos}"), F.col("value").alias(f"_{value}")
    ).withColumnsRenamed({f"_{key}": key, f"_{pos}": pos, f"_{value}": value})


def walk(df: DataFrame, keys: list[str], root: str, child: str) -> DataFrame:
    """Every node of a nested VARIANT list: keys, `path` (positions from the root), `depth`, `node`.

    One explode per level until no level has children; each level is cut through the checkpoint
    folder. `child` is the field that holds the next list (a lone object counts as a list of one).
    """
    def as_list(v: Column) -> Column:
        return F.when(_is(v, "OBJECT"), F.to_variant_object(F.array(v))).otherwise(v)

    level = df.select(*keys, F.array().cast("array<int>").alias("path"), as_list(F.col(root)).alias("_list"))
    found, depth = None, 0
    while True:
        nodes = _each(level.where(_is(F.col("_list"), "ARRAY")), F.col("_list"), value="node").select(
            *keys, F.concat("path", F.array("pos")).alias("path"), F.lit(depth).alias("depth"), "node"
        )
        nodes = cut(nodes)
        if depth and nodes.isEmpty():
            return found
        found = nodes if found is None else found.unionByName(nodes)
        level = nodes.select(*keys, "path", as_list(F.variant_get("node", f"$.{child}", "variant")).alias("_list"))
        depth += 1


# --- metadata documents ------------------------------------------------------------------------


def run_rows(docs: DataFrame, keys: list[str]) -> DataFrame:
    """One run row per metadata document; `error` is the text of its failure tree, null without one."""
    failures = docs.select(*keys, F.variant_get("doc", "$.failures", "variant").alias("_failures"))
    rows = docs.select(
        *keys, _get("doc", "$.id").alias("engine_id"), _get("doc", "$.workflowName").alias("name"),
        _get("doc", "$.workflowRoot").alias("execution_dir"),
        st.from_engine_word("document", _get("doc", "$.status")).alias("status"),
        timing.parse_iso(_get("doc", "$.start")).alias("start"), timing.parse_iso(_get("doc", "$.end")).alias("finish"),
    )
    return rows.join(cause_text(failures, keys, "_failures"), keys, "left")


def cause_text(df: DataFrame, keys: list[str], failures: str) -> DataFrame:
    """Failure trees as text: `: ` downwards, `, ` across; generic "Workflow failed" heads dropped.

    Nodes that say something follow one another in path order. What stands between two of them comes
    from their paths, `: ` where the one before is an ancestor, so messages are never edited. A tree is
    one document's, so gathering its nodes is bounded by the document; one that says nothing is empty text.
    """
    nodes = walk(df.where(F.col(failures).isNotNull()), keys, failures, "causedBy")
    message = _get("node", "$.message")
    says = F.when(message.isNotNull() & (message != "") & ~message.startswith("Workflow failed"), F.struct("path", message.alias("t")))
    gathered = nodes.groupBy(*keys).agg(F.sort_array(F.collect_list(says)).alias("_n"))

    def joined(node: Column, i: Column) -> Column:
        before = F.get("_n", i - 1)["path"]
        below = F.slice(node["path"], F.lit(1), F.size(before)) == before
        return F.when(i == 0, node["t"]).otherwise(F.concat(F.when(below, ": ").otherwise(", "), node["t"]))

    return gathered.select(*keys, F.array_join(F.transform("_n", joined), "").alias("error"))


def _step_name(key: Column) -> Column:
    return F.regexp_replace(key, r"^[^.]*\.?", "")


def _call_level(level: DataFrame, keys: list[str]) -> DataFrame:
    steps = _each(level, F.col("_calls"), key="_step", pos="_p", value="_list").where(F.col("_step").isNotNull())
    calls = _each(steps.select(*keys, "_above", "_step", "_list"), F.col("_list"), pos="pos", value="call").where("call is not null")
    shard, attempt = _get("call", "$.shardIndex", "int"), _get("call", "$.attempt", "int")
    base = F.concat_ws("_", "_above", _step_name(F.col("_step")))
    is_shard, retry = F.coalesce(shard >= 0, F.lit(False)), F.coalesce(attempt > 1, F.lit(False))
    start, end = _get("call", "$.start"), _get("call", "$.end")
    root = _get("call", "$.callRoot")
    return calls.select(
        *keys,
        F.concat(
            base, F.when(is_shard, F.concat(F.lit("_shard-"), shard)).otherwise(""),
            F.when(retry, F.concat(F.lit("_attempt-"), attempt)).otherwise(""),
        ).alias("id"),
        F.when(is_shard | retry, base).otherwise(F.col("_above")).alias("parent"),
        _step_name(F.col("_step")).alias("name"),
        F.when(is_shard, shard).alias("shard"), F.when(retry, attempt).alias("attempt"),
        st.from_engine_word(
            "document", F.coalesce(F.nullif(_get("call", "$.status"), F.lit("")), _get("call", "$.executionStatus"))
        ).alias("status"),
        timing.parse_iso(start).alias("start"), timing.parse_iso(end).alias("finish"),
        F.coalesce(_get("call", "$.dockerImageUsed"), _get("call", "$.runtimeAttributes.docker")).alias("container"),
        _get("call", "$.jobId").alias("batchid"), F.coalesce(_get("call", "$.callCaching.hit", "boolean"), F.lit(False)).alias("cached"),
        _get("call", "$.stdout").alias("stdout"), _get("call", "$.stderr").alias("stderr"),
        _get("call", "$.returnCode").alias("returncode"), root.alias("workdir"),
        F.concat(F.lit("file:/"), F.rtrim(root, F.lit("/")), F.lit("/execution/script")).alias("script"),
        F.variant_get("call", "$.failures", "variant").alias("failures"),
        F.col("_above").alias("above"),
        F.variant_get("call", "$.subWorkflowMetadata.calls", "variant").alias("_sub"),
    )


def job_rows(docs: DataFrame, keys: list[str], as_of: Column) -> DataFrame:
    """Calls of metadata documents, sub-workflows included, as job rows with scatter parents.

    id = `[parent_]step[_shard-s][_attempt-n]`; shards and retries sit under the step. One explode per
    sub-workflow depth. A call without a start takes its children's earliest, then `as_of`.
    """
    level = docs.select(*keys, F.lit(None).cast("string").alias("_above"), F.variant_get("doc", "$.calls", "variant").alias("_calls"))
    found = None
    while True:
        calls = cut(_call_level(level, keys))
        if found is not None and calls.isEmpty():
            break
        rows = calls.drop("_sub")
        found = rows if found is None else found.unionByName(rows)
        level = calls.where("_sub is not null").select(*keys, F.col("id").alias("_above"), F.col("_sub").alias("_calls"))
    inner = found.where("above is not null").groupBy(*keys, F.col("above").alias("id")).agg(F.min("start").alias("_first"))
    jobs = cut(found.join(inner, [*keys, "id"], "left").withColumn("start", F.coalesce("start", "_first", as_of)).drop("_first"))
    shards = jobs.where("shard is not null")
    parents = shards.groupBy(*keys, F.col("parent").alias("id")).agg(
        F.any_value("above").alias("parent"), F.any_value("name").alias("name"), F.min("start").alias("start"),
        F.when(F.count("finish") == F.count(F.lit(1)), F.max("finish")).alias("finish"),
        st.collapse(F.col("status"), F.struct("shard", F.coalesce("attempt", F.lit(1)))).alias("status"),
    )
    return jobs.drop("above").unionByName(parents, allowMissingColumns=True)


def job_errors(jobs: DataFrame, keys: list[str]) -> DataFrame:
    """Job rows with `error` from their failure trees."""
    errors = cause_text(jobs, [*keys, "id"], "failures")
    return jobs.drop("failures").join(errors, [*keys, "id"], "left")


def call_times(docs: DataFrame, keys: list[str], legacy_prefix: bool = False) -> DataFrame:
    """Seconds of the first call of each step, recursing into sub-workflows; unfinished has none.

    `legacy_prefix` keeps only the innermost level in a nested name.
    """
    level = docs.select(*keys, F.lit("").alias("_prefix"), F.variant_get("doc", "$.calls", "variant").alias("_calls"))
    found, depth = None, 0
    while True:
        steps = _each(level, F.col("_calls"), key="_step", pos="_p", value="_list").where("_step is not null")
        call = F.variant_get("_list", "$[0]", "variant")
        rows = cut(
            steps.withColumn("_call", call).select(
                *keys, F.concat("_prefix", "_step").alias("name"), F.lit(depth).alias("depth"), "_step",
                _get("_call", "$.start").alias("start"), _get("_call", "$.end").alias("end"),
                F.variant_get("_call", "$.subWorkflowMetadata.calls", "variant").alias("_sub"),
            )
        )
        if found is not None and rows.isEmpty():
            break
        found = rows.drop("_sub", "_step") if found is None else found.unionByName(rows.drop("_sub", "_step"))
        prefix = F.col("_step") if legacy_prefix else F.col("name")
        level = rows.where("_sub is not null").select(*keys, F.concat(prefix, F.lit(".")).alias("_prefix"), F.col("_sub").alias("_calls"))
        depth += 1
    first = found.groupBy(*keys, "name").agg(
        F.min_by(F.struct("start", "end"), F.struct("depth", "start")).alias("_c")
    )
    secs = timing.seconds_between(timing.parse_iso(F.col("_c.start")), timing.parse_iso(F.col("_c.end")))
    return first.select(*keys, "name", F.col("_c.start").alias("start"), F.col("_c.end").alias("end"), secs.alias("seconds"))


def flatten_jobs(df: DataFrame, keys: list[str], tree: str) -> DataFrame:
    """Nested job lists to flat rows: depth-first `path`, depth, id, parent, name; keys are carried down."""
    nodes = walk(df, keys, tree, "jobs").select(
        *keys, "path", "depth", _get("node", "$.id").alias("id"), _get("node", "$.name").alias("name"),
        _get("node", "$.status").alias("status"),
    )
    up = nodes.select(*keys, F.col("path").alias("_up"), F.col("id").alias("parent"))
    above = F.slice("path", F.lit(1), F.size("path") - 1)
    return nodes.withColumn("_up", above).join(up, [*keys, "_up"], "left").drop("_up")


def output_rows(df: DataFrame, keys: list[str], outputs: str) -> DataFrame:
    """Engine outputs map to rows: key without its first dotted part (the rest joined bare), list position, value.

    An empty list is a row of its own with an empty value at the list's position.
    """
    key = F.array_join(F.slice(F.split("key", r"\."), 2, 1 << 30), "")
    level = _each(df.select(*keys, outputs), F.col(outputs)).where("key is not null").select(
        *keys, key.alias("id"), F.array().cast("array<int>").alias("path"), "value"
    )
    found = None
    while True:
        level = cut(level)
        if found is not None and level.isEmpty():
            return found
        located = level.withColumn(
            "value", F.when(_is(F.col("value"), "OBJECT"), F.variant_get("value", "$.location", "variant")).otherwise(F.col("value"))
        )
        is_list = _is(F.col("value"), "ARRAY")
        empty = is_list & (F.to_json("value") == "[]")
        done = located.where(~is_list | empty).select(*keys, "id", "path", F.when(empty, "").otherwise(F.try_variant_get("value", "$", "string")).alias("value"))
        found = done if found is None else found.unionByName(done)
        level = _each(
            located.where(is_list).withColumnRenamed("value", "_l"), F.col("_l")
        ).where("pos is not null").select(*keys, "id", F.concat("path", F.array("pos")).alias("path"), "value")


def file_rows(df: DataFrame, keys: list[str], files: str) -> DataFrame:
    """File objects with companions, companions of companions, and so on, as rows with their parent."""
    nodes = walk(df, keys, files, "secondaryFiles").select(
        *keys, "path", "depth", _get("node", "$.location").alias("location"), _get("node", "$.size", "bigint").alias("size"),
        _get("node", "$.format").alias("format"), _get("node", "$.checksum").alias("checksum"), _get("node", "$.contents").alias("contents"),
    )
    up = nodes.select(*keys, F.col("path").alias("_up"), F.col("location").alias("parent"))
    above = F.slice("path", F.lit(1), F.size("path") - 1)
    return nodes.withColumn("_up", above).join(up, [*keys, "_up"], "left").drop("_up")


# --- webhook events ----------------------------------------------------------------------------


def webhook_jobs(events: DataFrame, keys: list[str], at: Column, final_step: str = "") -> DataFrame:
    """`process_*` events to job rows; start only when running, finish only when completed.

    A null never overwrites on upsert, so a job keeps its earlier start. Events of `final_step` are
    the workflow's own and are left out.
    """
    trace = events.where(F.col("event").startswith("process_")).where(
        ~F.col("trace.process").eqNullSafe(F.lit(final_step))
    )
    status = st.from_engine_word("webhook", F.col("trace.status"))
    workdir = F.rtrim(F.col("trace.workdir"), F.lit("/"))

    def inside(name: str) -> Column:
        return F.concat(workdir, F.lit("/" + name))

    return trace.select(
        *keys, F.col("trace.name").alias("id"), F.lit(None).cast("string").alias("parent"), F.col("trace.name").alias("name"),
        status.alias("status"), F.when(status == "running", at).alias("start"), F.when(status == "completed", at).alias("finish"),
        F.col("trace.workdir").alias("workdir"), inside(".command.err").alias("stderr"), inside(".command.out").alias("stdout"),
        inside(".command.run").alias("script"), F.col("trace.native_id").alias("batchid"),
        F.col("trace.container").alias("container"), F.col("trace.exit").alias("returncode"), F.lit(False).alias("cached"),
    )


def cached_jobs(events: DataFrame, keys: list[str], at: Column) -> DataFrame:
    """One job row per cached process of a completion or error event."""
    ended = events.where(F.col("event").isin("completed", "error"))
    each = ended.select(*keys, at.alias("_when"), F.explode("metadata.workflow.workflowStats.processes").alias("p")).where("p.cached = 1")
    status = st.cached_process_status(F.col("p.errored"))
    return each.select(
        *keys, F.col("p.name").alias("id"), F.col("p.name").alias("name"), status.alias("status"),
        F.lit(None).cast("timestamp").alias("start"), F.when(status == "completed", F.col("_when")).alias("finish"), F.lit(True).alias("cached"),
    )


def unknown_events(events: DataFrame) -> DataFrame:
    """Events of no known kind (an error for the caller to raise)."""
    known = F.col("event").isin("completed", "error", "started") | F.col("event").startswith("process_")
    return events.where(~F.coalesce(known, F.lit(False)))


def monitor_fields(df: DataFrame, text: str) -> DataFrame:
    """`TaskHandler[k: v; ...]` texts to fields; of `k: v: w` only v counts."""
    body = F.regexp_extract(text, MONITOR_TEXT, 1)
    entries = F.filter(F.split(body, "; "), lambda e: e.contains(": "))
    pairs = F.transform(
        entries,
        lambda e: F.struct(F.trim(F.get(F.split(e, ": "), F.lit(0))).alias("k"), F.trim(F.get(F.split(e, ": "), F.lit(1))).alias("v")),
    )

    def field(name: str) -> Column:
        return F.get(F.transform(F.filter(pairs, lambda p: p.getField("k") == name), lambda p: p.getField("v")), F.lit(0))

    workdir = F.regexp_replace(field("workDir"), " started$", "")
    status, code = field("status"), field("exit")
    return df.select(
        *df.columns, field("id").alias("task_id"), field("name").alias("task_name"),
        F.when((status == "COMPLETED") & (code == "0"), "completed").when((status == "COMPLETED") & (code == "1"), "failed")
        .otherwise("processing").alias("task_status"),
        code.alias("exit"), workdir.alias("workdir"),
        F.concat(workdir, F.lit("/.command.out")).alias("stdout"), F.concat(workdir, F.lit("/.command.err")).alias("stderr"),
    )


# --- log lines ---------------------------------------------------------------------------------


def severity(line: Column) -> Column:
    low = F.ltrim(F.lower(line))
    return (
        F.when(low.startswith("error"), "error").when(low.startswith("warn"), "warn").when(low.startswith("info"), "info").otherwise("other")
    )


def error_lines(lines: DataFrame, slice_size: int | None = None) -> DataFrame:
    """Lines from an error line up to the next warning or info line."""
    sev = severity(F.col("line"))
    rows, at = ordered.sliced(lines, ["run_id"], ["line_no"], ordered.number_slice(F.col("line_no"), slice_size) if slice_size else None)
    marked = rows.withColumn("_sev", F.when(sev != "other", sev))
    known = ordered.last_known(marked, ["run_id"], ["line_no"], at, "_sev", "_state")
    return known.where("_state = 'error'").select(*lines.columns)


def error_texts(lines: DataFrame, block: int = 1000) -> DataFrame:
    """Error text per run in blocks of line numbers; a run's text is its blocks in order."""
    rows = error_lines(lines).withColumn("block", ordered.number_slice(F.col("line_no"), block))
    packed = rows.groupBy("run_id", "block").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("_l"))
    return packed.select("run_id", "block", F.array_join(F.col("_l.line"), "\n").alias("error"))


def final_status(lines: DataFrame) -> DataFrame:
    """Final status per log by its first final line; a log without one was aborted."""
    low = F.lower("line")
    hit = F.col("line").isNotNull() & low.contains(FINAL_LINE)
    verdict = F.when(low.contains("fail"), "failed").when(low.contains("success"), "completed").otherwise("aborted")
    return lines.groupBy("run_id").agg(
        F.coalesce(F.min_by(verdict, F.when(hit, F.col("line_no"))), F.lit("aborted")).alias("status")
    )


def step_lines(lines: DataFrame) -> DataFrame:
    """Status lines `INFO [component step] action` as `component, step, action`; others are dropped."""
    hits = lines.where(F.col("line").rlike(STATUS_LINE))
    words = F.split(F.regexp_extract("line", STATUS_LINE, 1), " ")
    return (
        hits.withColumn("_w", words).where(F.size("_w") <= 2)
        .select(
            *lines.columns, F.get("_w", F.lit(0)).alias("component"), F.get("_w", F.lit(1)).alias("step"),
            F.regexp_extract("line", STATUS_LINE, 2).alias("action"),
        )
    )


def step_scopes(lines: DataFrame, slice_size: int | None = None) -> DataFrame:
    """Step events of logs with their nested workflow scope: run_id, line_no, id, parent, name, status.

    A workflow start pushes its name, a workflow completion pops the last one (and is an event of its
    own under what is left). No stack is replayed: the depth of a line is a running sum of pushes and
    pops less its running minimum, the enclosing workflow is the latest push one level up, and full
    scope texts are found by pointer doubling over the pushes - log(depth) joins.
    """
    key, order = ["run_id"], ["line_no"]
    wf, done = F.col("component") == "workflow", F.col("action") == "completed success"
    named = F.coalesce(F.col("step"), F.lit("")) != ""
    push = wf & (F.col("action") == "start") & named
    hits = step_lines(lines).where(F.col("component").isin("workflow", "step")).where(done | (F.col("action") == "start"))
    moved = cut(hits.select(
        "run_id", "line_no", "step", F.when(done, "completed").otherwise("running").alias("status"),
        push.alias("push"), (named & ~(wf & ~done)).alias("emits"),
        F.when(push, 1).when(wf & done, -1).otherwise(0).alias("_d"),
    ))
    given = ordered.number_slice(F.col("line_no"), slice_size) if slice_size else None
    rows, at = ordered.sliced(moved, key, order, given)
    summed = ordered.running_sum(rows, key, order, at, "_d", "_s")
    depth = (F.col("_s") - F.least(F.lit(0), F.col("_m"))).cast("int")
    levelled = cut(ordered.running_min(summed, key, order, at, "_s", "_m").withColumn("depth", depth).drop("_d", "_s", "_m", ordered.MADE))
    release(moved)

    pushes = levelled.where("push")
    givers = pushes.select("run_id", F.col("depth").alias("level"), "line_no", F.col("line_no").alias("_push"))
    seekers = levelled.where("push or emits").select(
        "run_id", F.when(F.col("push"), F.col("depth") - 1).otherwise(F.col("depth")).alias("level"), "line_no",
        F.lit(None).cast("bigint").alias("_push"),
    ).where("level > 0")
    asked, at = ordered.sliced(givers.unionByName(seekers), ["run_id", "level"], order, given)
    known = ordered.last_known(asked, ["run_id", "level"], order, at, "_push", "_at")
    above = known.where("_push is null").select("run_id", "line_no", F.col("_at").alias("up"))

    scopes = cut(pushes.join(above, ["run_id", "line_no"], "left").select("run_id", "line_no", "up", F.col("step").alias("scope")))
    while not scopes.where("up is not null").isEmpty():
        over = scopes.select("run_id", F.col("line_no").alias("up"), F.col("up").alias("_up"), F.col("scope").alias("_scope"))
        scopes = cut(
            scopes.join(over, ["run_id", "up"], "left").select(
                "run_id", "line_no", F.col("_up").alias("up"), F.concat_ws("_", "_scope", "scope").alias("scope")
            )
        )
    parents = scopes.select("run_id", F.col("line_no").alias("up"), F.col("scope").alias("parent"))
    events = levelled.where("emits").join(above, ["run_id", "line_no"], "left").join(parents, ["run_id", "up"], "left")
    return events.select(
        "run_id", "line_no", F.concat_ws("_", "parent", "step").alias("id"), "parent", F.col("step").alias("name"), "status"
    )


def tail(lines: DataFrame, n: int) -> DataFrame:
    """Last n lines per log. Spark keeps at most n candidates per log before the shuffle; beyond its limit slices do."""
    from pyspark.sql import Window

    if n > int(lines.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")):
        rows, at = ordered.slices(lines, ["run_id"], ["line_no"])
        if at is not None:
            return ordered.last_rows(rows, ["run_id"], ["line_no"], at, n).select(*lines.columns)
    w = Window.partitionBy("run_id").orderBy(F.desc("line_no"))
    return lines.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def gather_outputs(outs: DataFrame, keys: list[str], block: int = 1000) -> DataFrame:
    """Outputs by key, list order kept; a file's companions go under `{key}_{extension}`.

    `outs`: keys, key, pos, value, secondaries. Values come in blocks of positions.
    """
    side = outs.select(*keys, "key", "pos", F.posexplode("secondaries").alias("_i", "value")).withColumn(
        "key", F.concat("key", F.lit("_"), F.substring_index("value", ".", -1))
    )
    rows = outs.select(*keys, "key", "pos", F.lit(-1).alias("_i"), "value").where("value is not null").unionByName(side)
    packed = rows.groupBy(*keys, "key", ordered.number_slice(F.col("pos"), block).alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "_i", "value"))).alias("_v")
    )
    return packed.select(*keys, "key", "block", F.col("_v.value").alias("values"))

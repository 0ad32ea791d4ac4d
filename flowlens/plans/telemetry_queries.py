"""Queries: metadata documents, webhook events, monitor texts and logs."""

from __future__ import annotations


from pyspark.sql import functions as F

from flowlens.functions import timing
from flowlens.operators import store
from flowlens.operators import telemetry as tel
from flowlens.operators.lineage import new_path
from flowlens.plans.adapter import Tables
from flowlens.plans.registry import query
from flowlens.sources import contigs as contig_files
from flowlens.sources import documents as docs

START, END = "1998-03-01T00:00:00Z", "1998-03-01T02:30:00Z"

# A metadata document per order. Every eleventh is cut short and must be rejected.
DOC = f"""concat('{{"id":"e', o_orderkey, '","workflowName":"', o_orderpriority, '","workflowRoot":"/exec/', o_custkey,
  '","status":"', case o_orderstatus when 'F' then 'Succeeded' when 'O' then 'Running' else 'Submitted' end,
  '","start":"{START}"', case when o_orderstatus = 'F' then ',"end":"{END}"' else '' end,
  case when o_orderkey % 4 = 0 then concat(',"failures":[{{"message":"Workflow failed","causedBy":[{{"message":"a', o_orderkey,
    '","causedBy":[]}},{{"message":"b","causedBy":[{{"message":"c: d"}}]}}]}}]') else '' end,
  ',"calls":{{"wf.align":[{{"executionStatus":"Done","shardIndex":0,"attempt":1,"start":"{START}","end":"{END}","callRoot":"/r/', o_orderkey,
  '","returnCode":0}},{{"executionStatus":"', case when o_orderkey % 3 = 0 then 'Failed","failures":[{{"message":"no: , way","causedBy":[{{"message":"deep, : "}}]}}],"note":"' else 'Done' end,
  '","shardIndex":1,"attempt":1,"start":"1998-03-01T00:10:00Z","end":"1998-03-01T03:00:00Z","callCaching":{{"hit":true}}}}',
  case when o_orderkey % 3 = 0 then ',{{"executionStatus":"Running","shardIndex":1,"attempt":2,"start":"1998-03-01T04:00:00Z"}}' else '' end,
  '],"wf.sub.x":[{{"executionStatus":"Running","shardIndex":-1,"attempt":1,"jobId":"j', o_custkey,
  '","subWorkflowMetadata":{{"calls":{{"inner.qc":[{{"executionStatus":"Done","shardIndex":-1,"attempt":1,"start":"1998-03-01T01:00:00Z","end":"1998-03-01T01:00:07.500Z","dockerImageUsed":"ubuntu:', o_orderkey % 5,
  '"}}]}}}}}}]', case when o_orderkey % 11 = 0 then '' else '}}}}' end)"""


def _docs(t: Tables):
    return t.orders.selectExpr("cast(o_orderkey as string) run_id", f"{DOC} text")


def _good(t: Tables):
    return docs.parse_documents(_docs(t))[0]


GOOD = "from orders where o_orderkey % 11 <> 0"


@query("a2_parse_documents", "", """select cast(o_orderkey as varchar) run_id, o_orderkey % 11 <> 0 ok from orders""")
def _(t):
    good, bad = docs.parse_documents(_docs(t))
    return good.select("run_id", F.lit(True).alias("ok")).unionByName(bad.select("run_id", F.lit(False).alias("ok")))


@query("a3_save_documents", "", """select cast(o_orderkey as varchar) submission_id, 'savedMetadata' as key from orders
  where o_orderkey % 11 <> 0 and o_orderstatus <> 'F'""")
def _(t):
    saved = t.orders.where("o_orderstatus = 'F'").selectExpr("cast(o_orderkey as string) submission_id", "'savedMetadata' key")
    fresh = _good(t).withColumnRenamed("run_id", "submission_id")
    return docs.save_documents(fresh, saved, new_path(t.spark, "documents"))


@query("t1_run_rows", "", f"""select cast(o_orderkey as varchar) run_id, concat('e', o_orderkey) engine_id, o_orderpriority as name,
   concat('/exec/', o_custkey) execution_dir, case o_orderstatus when 'F' then 'completed' when 'O' then 'running' else 'queued' end status,
   timestamp '1998-03-01' as start, case when o_orderstatus = 'F' then timestamp '1998-03-01 02:30:00' end finish,
   case when o_orderkey % 4 = 0 then concat('a', o_orderkey, ', b: c: d') end error {GOOD}""")
def _(t):
    rows = tel.run_rows(_good(t), ["run_id"])
    return rows.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("finish", F.col("finish").cast("timestamp_ntz"))


@query("t2_job_rows", "", f"""with o as (select o_orderkey k, o_custkey c, cast(o_orderkey as varchar) run_id, o_orderkey % 3 = 0 r {GOOD})
  select run_id, 'align_shard-0' id, 'align' parent, 'align' as name, 0 shard, null attempt, 'completed' status, timestamp '1998-03-01' as start,
    timestamp '1998-03-01 02:30:00' finish, null container, null batchid, false cached, '0' returncode, concat('/r/', k) workdir, concat('file://r/', k, '/execution/script') script, null::varchar error from o
  union all select run_id, 'align_shard-1', 'align', 'align', 1, null, case when r then 'failed' else 'completed' end, timestamp '1998-03-01 00:10:00',
    timestamp '1998-03-01 03:00:00', null, null, true, null, null, null, case when r then 'no: , way: deep, : ' end from o
  union all select run_id, 'align_shard-1_attempt-2', 'align', 'align', 1, 2, 'running', timestamp '1998-03-01 04:00:00', null, null, null, false, null, null, null, null from o where r
  union all select run_id, 'sub.x', null, 'sub.x', null, null, 'running', timestamp '1998-03-01 01:00:00', null, null, concat('j', c), false, null, null, null, null from o
  union all select run_id, 'sub.x_qc', 'sub.x', 'qc', null, null, 'completed', timestamp '1998-03-01 01:00:00', timestamp '1998-03-01 01:00:07.5', concat('ubuntu:', k % 5), null, false, null, null, null, null from o
  union all select run_id, 'align', null, 'align', null, null, case when r then 'running' else 'completed' end, timestamp '1998-03-01',
    case when not r then timestamp '1998-03-01 03:00:00' end, null, null, null, null, null, null, null from o""")
def _(t):
    rows = tel.job_errors(tel.job_rows(_good(t), ["run_id"], F.expr("timestamp'2000-01-01 00:00:00'")), ["run_id"])
    return rows.select(
        "run_id", "id", "parent", "name", "shard", "attempt", "status", F.col("start").cast("timestamp_ntz").alias("start"),
        F.col("finish").cast("timestamp_ntz").alias("finish"), "container", "batchid", "cached", "returncode", "workdir", "script", "error")


@query("d7_call_times", "", f"""select cast(o_orderkey as varchar) run_id, n as name, s as seconds from (select o_orderkey,
    unnest(['wf.align', 'wf.sub.x', 'wf.sub.x.inner.qc']) n, unnest([9000.0, null, 7.5])::double s {GOOD})""")
def _(t):
    return tel.call_times(_good(t), ["run_id"]).select("run_id", "name", "seconds")


@query("d14_cause_text", "", f"select cast(o_orderkey as varchar) run_id, concat('a', o_orderkey, ', b: c: d') error {GOOD} and o_orderkey % 4 = 0")
def _(t):
    failed = _good(t).select("run_id", F.variant_get("doc", "$.failures", "variant").alias("failures"))
    return tel.cause_text(failed, ["run_id"], "failures")


TREE = """concat('[{"id":"a', o_orderkey, '","name":"top","status":"running","jobs":[{"id":"b","name":"', o_orderpriority,
  '","status":"completed"}', case when o_orderkey % 3 = 0 then ',{"id":"c","name":"mid","status":"failed","jobs":[{"id":"d","name":"leaf","status":"failed"}]}' else '' end,
  ']},{"id":"z","name":"last","status":"queued"}]')"""


@query("f8_f9_x2_flatten_jobs", "", """select cast(o_custkey as varchar) submission_id, cast(o_orderkey as varchar) run_id, n.path, n.depth, n.id, n.parent, n.name, n.status from
  (select o_custkey, o_orderkey, o_orderpriority, unnest([
     {'path': '0', 'depth': 0, 'id': concat('a', o_orderkey), 'parent': null, 'name': 'top', 'status': 'running'},
     {'path': '0,0', 'depth': 1, 'id': 'b', 'parent': concat('a', o_orderkey), 'name': o_orderpriority, 'status': 'completed'},
     {'path': '0,1', 'depth': 1, 'id': 'c', 'parent': concat('a', o_orderkey), 'name': 'mid', 'status': 'failed'},
     {'path': '0,1,0', 'depth': 2, 'id': 'd', 'parent': 'c', 'name': 'leaf', 'status': 'failed'},
     {'path': '1', 'depth': 0, 'id': 'z', 'parent': null, 'name': 'last', 'status': 'queued'}]) n from orders)
  where n.id not in ('c', 'd') or o_orderkey % 3 = 0""")
def _(t):
    nested = t.orders.select(
        F.col("o_custkey").cast("string").alias("submission_id"), F.col("o_orderkey").cast("string").alias("run_id"),
        F.parse_json(F.expr(TREE)).alias("tree"))
    flat = tel.flatten_jobs(nested, ["submission_id", "run_id"], "tree")
    return flat.withColumn("path", F.array_join(F.col("path").cast("array<string>"), ","))


OUTS = """concat('{"wf.out":"/p/', o_orderkey, '","wf.list":["/a/', o_custkey, '",{"location":"/b"}],"wf.a.b":{"location":"gs://x/', o_orderkey, '"},"wf.n":[[1,2],[3]],"wf.none":[],"wf.some":[[],[4]]}')"""


@query("t7_output_rows", "", """select cast(o_orderkey as varchar) run_id, n.id, n.path, n.value from (select o_orderkey, unnest([
    {'id': 'out', 'path': '', 'value': concat('/p/', o_orderkey)}, {'id': 'list', 'path': '0', 'value': concat('/a/', o_custkey)}, {'id': 'list', 'path': '1', 'value': '/b'},
    {'id': 'ab', 'path': '', 'value': concat('gs://x/', o_orderkey)}, {'id': 'n', 'path': '0,0', 'value': '1'}, {'id': 'n', 'path': '0,1', 'value': '2'},
    {'id': 'n', 'path': '1,0', 'value': '3'}, {'id': 'none', 'path': '', 'value': ''}, {'id': 'some', 'path': '0', 'value': ''}, {'id': 'some', 'path': '1,0', 'value': '4'}]) n from orders)""")
def _(t):
    rows = t.orders.select(F.col("o_orderkey").cast("string").alias("run_id"), F.parse_json(F.expr(OUTS)).alias("outputs"))
    return tel.output_rows(rows, ["run_id"], "outputs").withColumn("path", F.array_join(F.col("path").cast("array<string>"), ","))


FILES = """concat('[{"location":"/d/', page_id, '","size":', length(html), ',"checksum":"', md5(url), '","secondaryFiles":[{"location":"/d/', page_id,
  '.bai","size":3,"secondaryFiles":[{"location":"/d/deep"}]}]},{"location":"/e","format":"txt"}]')"""


@query("t10_file_rows", "", """select cast(page_id as varchar) id, n.* from (select page_id, unnest([
    {'path': '0', 'location': concat('/d/', page_id), 'size': length(html)::bigint, 'format': null, 'checksum': md5(url), 'parent': null},
    {'path': '0,0', 'location': concat('/d/', page_id, '.bai'), 'size': 3, 'format': null, 'checksum': null, 'parent': concat('/d/', page_id)},
    {'path': '0,0,0', 'location': '/d/deep', 'size': null, 'format': null, 'checksum': null, 'parent': concat('/d/', page_id, '.bai')},
    {'path': '1', 'location': '/e', 'size': null, 'format': 'txt', 'checksum': null, 'parent': null}]) n from pages)""")
def _(t):
    rows = t.pages.select(F.col("page_id").cast("string").alias("id"), F.parse_json(F.expr(FILES)).alias("files"))
    return tel.file_rows(rows, ["id"], "files").select(
        "id", F.array_join(F.col("path").cast("array<string>"), ",").alias("path"), "location", "size", "format", "checksum", "parent")


# Webhook events: one JSON text per event row.
HOOK = """case when event_type = 'error' then concat('{"event":"completed","metadata":{"workflow":{"workflowStats":{"processes":[{"name":"c', event_id,
    '","cached":1,"errored":', case when event_id % 2 = 0 then 'true' else 'false' end, '},{"name":"n","cached":0,"errored":false}]}}}}')
  when event_type = 'signup' then '{"event":"started"}'
  else concat('{"event":"process_', event_type, '","trace":{"name":"p', event_id % 5, '","process":"', case when event_id % 9 = 0 then 'final' else 'run' end,
    '","task_id":"', event_id, '","workdir":"/w/', user_id, '","exit":"', event_id % 2, '","native_id":"', event_id % 100, '","container":"ubuntu","status":"',
    case event_type when 'view' then 'RUNNING' when 'click' then 'SUBMITTED' else 'COMPLETED' end, '"}}') end"""


def _hooks(t):
    return t.events.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), F.expr(HOOK).alias("value")).select(
        "user_id", "event_id", "ts", F.from_json("value", docs.WEBHOOK_DDL).alias("e")).select("user_id", "event_id", "ts", "e.*")


@query("t4_webhook_jobs", "", """select cast(user_id as varchar) run_id, event_id, concat('p', event_id % 5) id, case event_type when 'view' then 'running' when 'click' then 'queued' else 'completed' end status,
    case when event_type = 'view' then ts end as start, case when event_type = 'purchase' then ts end finish, concat('/w/', user_id) workdir,
    concat('/w/', user_id, '/.command.err') stderr, concat('/w/', user_id, '/.command.run') script, cast(event_id % 100 as varchar) batchid, cast(event_id % 2 as varchar) returncode
  from events where event_type not in ('error', 'signup') and event_id % 9 <> 0""")
def _(t):
    events = _hooks(t).withColumn("run_id", F.col("user_id").cast("string"))
    jobs = tel.webhook_jobs(events, ["run_id", "event_id"], F.col("ts"), final_step="final")
    return jobs.select("run_id", "event_id", "id", "status", F.col("start").cast("timestamp_ntz").alias("start"),
                       F.col("finish").cast("timestamp_ntz").alias("finish"), "workdir", "stderr", "script", "batchid", "returncode")


@query("t5_cached_jobs", "", """select cast(user_id as varchar) run_id, concat('c', event_id) id, case when event_id % 2 = 0 then 'failed' else 'completed' end status,
    case when event_id % 2 = 1 then ts end finish, true cached from events where event_type = 'error'""")
def _(t):
    events = _hooks(t).withColumn("run_id", F.col("user_id").cast("string"))
    return tel.cached_jobs(events, ["run_id"], F.col("ts")).select("run_id", "id", "status", F.col("finish").cast("timestamp_ntz").alias("finish"), "cached")


MONITOR = """concat('~> TaskHandler[id: ', event_id, '; name: step', user_id, '; status: ', case when event_id % 3 = 0 then 'RUNNING' else 'COMPLETED' end,
  '; exit: ', case when event_id % 3 = 0 then '-' else cast(event_id % 2 as {s}) end, '; error: -; workDir: /w/', user_id, case when event_id % 2 = 0 then ' started: 16189' else '' end, ']')"""


@query("t6_monitor_fields", "", """select event_id, cast(event_id as varchar) task_id, concat('step', user_id) task_name,
    case when event_id % 3 = 0 then 'processing' when event_id % 2 = 0 then 'completed' else 'failed' end task_status,
    case when event_id % 3 = 0 then '-' else cast(event_id % 2 as varchar) end exit, concat('/w/', user_id) workdir, concat('/w/', user_id, '/.command.out') stdout,
    concat('/w/', user_id, '/.command.err') stderr from events""")
def _(t):
    rows = t.events.select("event_id", F.expr(MONITOR.format(s="string")).alias("text"))
    return tel.monitor_fields(rows, "text").drop("text")


SEV_SQL = "case when ltrim(lower(line)) like 'error%' then 'error' when ltrim(lower(line)) like 'warn%' then 'warn' when ltrim(lower(line)) like 'info%' then 'info' else 'other' end"


@query("t8_severity", "event_lines", f"select run_id, line_no, {SEV_SQL} severity from v_event_lines")
def _(t):
    return t.event_lines.select("run_id", "line_no", tel.severity(F.col("line")).alias("severity"))


@query("t9_step_lines", "event_lines", r"""select run_id, line_no, split_part(w, ' ', 1) component, case when contains(w, ' ') then split_part(w, ' ', 2) end step, action from
    (select run_id, line_no, regexp_extract(line, '^INFO \[(.*)\] (.+)$', 1) w, regexp_extract(line, '^INFO \[(.*)\] (.+)$', 2) action from v_event_lines
     where regexp_matches(line, '^INFO \[(.*)\] (.+)$'))""")
def _(t):
    return tel.step_lines(t.event_lines).drop("line")


@query("d16_error_texts", "", """with c as (select cast(conv_id as varchar) run_id, turn * 100000::bigint + i as line_no,
     concat(case when i > 1 then '' when role = 'system' then 'ERROR ' when role = 'user' then case when turn % 3 = 0 then 'warning ' when conv_id % 4 = 0 then ' error: ' else 'INFO ' end else '' end, parts[i]) line
     from (select *, unnest(range(1, len(parts) + 1)) i from (select *, string_split(text, chr(10)) parts from conversations))),
   s as (select *, case when ltrim(lower(line)) like 'error%' then 'error' when ltrim(lower(line)) like 'warn%' then 'warn' when ltrim(lower(line)) like 'info%' then 'info' end sev from c),
   l as (select *, last_value(sev ignore nulls) over (partition by run_id order by line_no) state from s)
  select run_id, cast(line_no // 1000 as bigint) block, string_agg(line, chr(10) order by line_no, line) error from l where state = 'error' group by 1, 2""")
def _(t):
    lines = t.conversations.selectExpr("*", "posexplode(split(text, '\n', -1)) as (i, part)").selectExpr(
        "cast(conv_id as string) run_id", "turn * 100000L + i + 1 line_no",
        "concat(case when i > 0 then '' when role = 'system' then 'ERROR ' when role = 'user' then case when turn % 3 = 0 then 'warning ' when conv_id % 4 = 0 then ' error: ' else 'INFO ' end else '' end, part) line")
    return tel.error_texts(lines)


FINAL = """case when event_id % 37 = 0 then case event_type when 'purchase' then 'Final process status is success' when 'error' then 'Final process status is permanentFail'
  when 'view' then 'INFO final process status is odd' else 'nothing' end else concat('line ', event_type) end"""


@query("d17_final_status", "", f"""select run_id, coalesce(arg_min(case when lower(line) like '%fail%' then 'failed' when lower(line) like '%success%' then 'completed' else 'aborted' end, line_no)
    filter (lower(line) like '%final process status is%'), 'aborted') status from (select cast(user_id as varchar) run_id, event_id line_no, {FINAL} line from events) group by 1""")
def _(t):
    return tel.final_status(t.events.selectExpr("cast(user_id as string) run_id", "event_id line_no", f"{FINAL} line"))


@query("e4_tail", "event_lines", "select run_id, line_no, line from v_event_lines qualify row_number() over (partition by run_id order by line_no desc) <= 5")
def _(t):
    return tel.tail(t.event_lines, 5)


@query("d13_gather_outputs", "", """with o as (select cast(l_orderkey as varchar) run_id, concat('o', l_linenumber) as key, l_partkey pos, concat('/x/p', l_suppkey, '.bam') as value, l_returnflag = 'R' s from lineitem),
   r as (select run_id, key, pos, -1 i, value from o union all select run_id, concat(key, '_bai'), pos, 0, concat(value, '.bai') from o where s
     union all select run_id, concat(key, '_idx'), pos, 1, replace(value, '.bam', '.idx') from o where s)
  select run_id, key, cast(pos // 1000 as bigint) block, string_agg(value, ',' order by pos, i, value) vals from r group by 1, 2, 3""")
def _(t):
    outs = t.lineitem.selectExpr(
        "cast(l_orderkey as string) run_id", "concat('o', l_linenumber) key", "l_partkey pos", "concat('/x/p', l_suppkey, '.bam') value",
        "case when l_returnflag = 'R' then array(concat('/x/p', l_suppkey, '.bam.bai'), concat('/x/p', l_suppkey, '.idx')) end secondaries")
    return tel.gather_outputs(outs, ["run_id"]).select("run_id", "key", "block", F.array_join("values", ",").alias("vals"))


def _export(df, t: Tables, compression: str = "none") -> str:
    """Write text lines derived from the tables into the shared folder, for the file readers to read."""
    path = new_path(t.spark, "lines")
    df.write.option("compression", compression).text(path)
    return path


@query("a5_reference_contigs", "contigs", "select distinct contig from v_contigs")
def _(t):
    path = _export(t.contigs.selectExpr("concat_ws('\t', contig, input, '60', '61') value"), t, "gzip")
    return contig_files.reference_contigs(t.spark, path).select("contig").distinct()


@query("a6_interval_contigs", "contigs", "select distinct contig from v_contigs where cast(input as bigint) % 2 = 0")
def _(t):
    lines = t.contigs.selectExpr("case when cast(input as bigint) % 2 = 0 then concat(contig, ' \t', input, '\t100') else concat('\t', input) end value")
    return contig_files.interval_contigs(t.spark, _export(lines, t)).select("contig").distinct()


@query("s1_step_scopes", "event_lines", """with recursive n as (select run_id, line_no, line, row_number() over (partition by run_id order by line_no) rn from v_event_lines where line like 'INFO%'),
   r as (select run_id, 0::bigint rn, 0::bigint line_no, '' line, cast([] as varchar[]) scope from n group by run_id
     union all select n.run_id, n.rn, n.line_no, n.line,
       case when n.line like 'INFO [workflow w%' then list_append(r.scope, n.line[16:17]) when n.line like 'INFO [workflow ]%' then r.scope[1:greatest(len(r.scope) - 1, 0)] else r.scope end
     from r join n on n.run_id = r.run_id and n.rn = r.rn + 1)
  select run_id, line_no, concat_ws('_', nullif(array_to_string(scope, '_'), ''), line[12:13]) id, nullif(array_to_string(scope, '_'), '') parent, line[12:13] as name,
    case when line like '%start' then 'running' else 'completed' end status from r where line like 'INFO [step%'""")
def _(t):
    return tel.step_scopes(t.event_lines)


@query("a10_webhook_intake", "", """select event, name, status, processes, count(*) n from (select
    case when event_type = 'error' then 'completed' when event_type = 'signup' then 'started' else concat('process_', event_type) end event,
    case when event_type not in ('error', 'signup') then concat('p', event_id % 5) end as name,
    case event_type when 'view' then 'RUNNING' when 'click' then 'SUBMITTED' when 'purchase' then 'COMPLETED' end status,
    case when event_type = 'error' then 2 end processes from events) group by all""")
def _(t):
    events = docs.webhook_events(t.events.select(F.expr(HOOK).alias("value")))
    stats = F.col("metadata.workflow.workflowStats.processes")
    return events.groupBy(
        "event", F.col("trace.name").alias("name"), F.col("trace.status").alias("status"), F.when(stats.isNotNull(), F.size(stats)).alias("processes")
    ).agg(F.count(F.lit(1)).alias("n"))


@query("s2_webhook_upserts", "", """with j as (select cast(user_id as varchar) run_id, concat('p', event_id % 5) id, ts, event_id,
     case event_type when 'view' then 'running' when 'click' then 'queued' else 'completed' end status, case when event_type = 'view' then ts end as start,
     case when event_type = 'purchase' then ts end finish, concat('/w/', user_id) workdir, false cached from events where event_type not in ('error', 'signup') and event_id % 9 <> 0
   union all select cast(user_id as varchar), concat('c', event_id), ts, event_id, case when event_id % 2 = 0 then 'failed' else 'completed' end, null, case when event_id % 2 = 1 then ts end, null, true
     from events where event_type = 'error')
  select run_id, id, arg_max(status, row(ts, event_id)) status, arg_max(start, row(ts, event_id)) filter (start is not null) as start,
    arg_max(finish, row(ts, event_id)) filter (finish is not null) finish, arg_max(workdir, row(ts, event_id)) filter (workdir is not null) workdir, bool_or(cached) cached from j group by 1, 2""")
def _(t):
    events = _hooks(t).withColumn("run_id", F.col("user_id").cast("string")).withColumn("seq", F.struct("ts", "event_id"))
    started = tel.webhook_jobs(events, ["run_id", "seq"], F.col("ts"), final_step="final")
    cached = tel.cached_jobs(events, ["run_id", "seq"], F.col("ts"))
    rows = started.unionByName(cached, allowMissingColumns=True)
    jobs = store.reduce_delta(rows.select("run_id", "id", "seq", "status", "start", "finish", "workdir", "cached"), ("run_id", "id"), "seq")
    return jobs.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("finish", F.col("finish").cast("timestamp_ntz"))

"""Queries: scans, lookups, predicates, store maintenance, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.engine import Engine
from flowlens.functions import paths, status as st, timing, values
from flowlens.operators import jobs as jb
from flowlens.operators import ordered, status as sta, store
from flowlens.operators.lineage import cut, new_path, release
from flowlens.plans.adapter import Tables
from flowlens.plans.registry import query
from flowlens.schema import SPECS
from flowlens.sources import inventory, logs

AS_OF = "timestamp_ntz'1999-06-01 00:00:00'"


@query("a1_table_scan", "raw_jobs",
       "select id, run_id, start from v_raw_jobs where status = 'failed' and shard = 1 and start >= timestamp '1998-01-01'")
def _(t: Tables):
    return store.scan(
        t.raw_jobs, ["id", "run_id", "start"], {"status": "failed", "shard": 1},
        "start >= timestamp_ntz'1998-01-01 00:00:00'",
    )


@query("a4_log_lines", "document_lines", "select run_id, line_no, line from v_document_lines")
def _(t):
    return t.document_lines


A8_LINE = """case event_type when 'signup' then concat('out', event_id % 9, ' = ', props)
  when 'view' then concat('out', event_id % 9, '=[a', user_id, ', b', event_id, ']')
  when 'click' then 'files=[]' when 'purchase' then concat('x=', event_id, '=y')
  else concat(' key_', user_id, ' = v ') end"""


@query("a8_output_lines", "", f"""
  with l as (select event_id, {A8_LINE} line from events),
  p as (select event_id, string_split(line, '=') parts from l),
  q as (select event_id, len(parts) = 2 ok, trim(parts[1]) as key, trim(parts[2]) as value from p)
  select event_id, case when ok then key end as key, case when ok then value like '[%' end is_list,
    case when ok and value = '[]' then cast(0 as int)
         when ok and value like '[%' then cast(len(string_split(trim(value, '[]'), ', ')) as int) end n_items,
    case when ok and value <> '[]' and value like '[%' then string_split(trim(value, '[]'), ', ')[-1] end last_item,
    case when ok and value not like '[%' then value end as value, case when not ok then 'not one key and one value' end reason
  from q""")
def _(t):
    parsed = logs.key_values(t.events.selectExpr("event_id", f"{A8_LINE} line"))
    return parsed.select(
        "event_id", "key", "is_list", F.when(F.col("items").isNotNull(), F.size("items")).alias("n_items"),
        F.expr("try_element_at(items, -1)").alias("last_item"), "value", "reason",
    )


@query("a9_kv_pivot", "kv", """select submission_id, run_id, max(value) filter (key = 'status') status,
  max(value) filter (key = 'name') as name, max(value) filter (key = 'day') as day from v_kv group by 1, 2""")
def _(t):
    return store.kv_pivot(t.kv, ["submission_id", "run_id"], ["status", "name", "day"])


A11_SQL = """select r.status, j.status job_status, count(*) n, min(j.start) first_start
  from {runs} r join {jobs} j on j.run_id = r.id where r.name like '%URGENT%' group by r.status, j.status"""


@query("a11_raw_sql", "runs raw_jobs", A11_SQL.format(runs="v_runs", jobs="v_raw_jobs"))
def _(t):
    return Engine(t.spark).register({"runs": t.runs, "jobs": t.raw_jobs}).sql(A11_SQL.format(runs="runs", jobs="jobs"))


@query("a12_json_decode", "", """select event_id, cast(json_extract(props, '$.k') as int) k, null as kept from events where event_id % 3 <> 0
  union all select event_id, null, concat(props, '}}') from events where event_id % 3 = 0""")
def _(t):
    doc = values.decode_json(F.expr("case when event_id % 3 = 0 then concat(props, '}}') else props end"))
    return t.events.select(
        "event_id", F.try_variant_get(doc, "$.k", "int").alias("k"),
        F.when(F.schema_of_variant(doc) == "STRING", F.try_variant_get(doc, "$", "string")).alias("kept"),
    )


@query("b1_query_runs", "submissions runs", """select s.id, s.output_dir, r.name, r.status, r.start
  from v_submissions s join v_runs r on r.submission_id = s.id where r.status = 'completed' and lower(r.name) like '4-not%'""")
def _(t):
    meta = t.runs.drop("id")
    return sta.query_runs(t.submissions, meta, "completed", "4-NOT").select("id", "output_dir", "name", "status", "start")


@query("b2_lookup_strict", "raw_jobs", """select run_id, id, any_value(status) status, any_value(shard) shard
  from v_raw_jobs group by 1, 2 having count(*) = 1""")
def _(t):
    return store.lookup(t.raw_jobs, t.raw_jobs, ["run_id", "id"]).select("run_id", "id", "status", "shard")


@query("b2_lookup_first", "raw_jobs", """select run_id, id, arg_min(status, row(start, l_partkey, l_suppkey, l_extendedprice)) status
  from v_raw_jobs where id = 'step3' group by 1, 2""")
def _(t):
    wanted = t.raw_jobs.where("id = 'step3'")
    return store.lookup(
        t.raw_jobs, wanted, ["run_id", "id"], strict=False,
        first_by=["start", "l_partkey", "l_suppkey", "l_extendedprice"],
    ).select("run_id", "id", "status")


PROGRESS = """select cast(user_id as string) submission_id, case event_type when 'signup' then 'start'
  when 'view' then 'submitWorkflow' when 'purchase' then 'copiedOutputs' when 'click' then 'savedLogs'
  else 'cleanedUp' end key, ts timestamp from {src}"""


@query("b3_milestone_reached", "", f"""select s.id, s.author from (select cast(c_custkey as varchar) id, c_name author from customer) s
  where exists (select 1 from ({PROGRESS.format(src='events').replace(' string)', ' varchar)').replace('end key, ts timestamp', 'end as key, ts as timestamp')}) p
    where p.submission_id = s.id and p.key = 'copiedOutputs')""")
def _(t):
    progress = t.spark.sql(PROGRESS.format(src="{e}"), e=t.events)
    return store.reached(t.submissions, progress, "copiedOutputs").select("id", "author")


STATUS_DIM_SQL = """(values ('processing','Processing','...',false,false,0,null),('prepared','Prepared',':',false,false,0,null),
  ('queued','Queued',' ',false,true,0,null),('running','Running','~',false,true,0,null),
  ('execution-ended','Ended execution successfully (finalizing)','%%',false,false,0,null),
  ('completed','Completed','✓',true,true,0,null),('failed','Failed','!',true,true,3,'#a63030'),
  ('aborting','Aborting','~x',false,false,3,null),('aborted','Terminated','T',true,true,3,null),
  ('dry-run','Dry run','DR',true,false,0,null),('on-hold','On hold','?',false,true,0,null),
  ('suspended','Suspended','II',true,true,3,null)) d(status, label, symbol, is_final, notifies, exit_code, color)"""


@query("b4_status_attributes", "raw_jobs", f"""select j.run_id, j.id, j.start, j.l_partkey, d.* from v_raw_jobs j
  join {STATUS_DIM_SQL} on d.status = j.status""")
def _(t):
    return sta.describe(t.raw_jobs.select("run_id", "id", "start", "l_partkey", "status"))


WORD = """case event_type when 'signup' then 'Submitted' when 'view' then 'Running' when 'click' then 'fail'
  when 'purchase' then case when event_id % 4 = 0 then 'Done' else 'Succeeded' end
  else case when event_id % 5 = 0 then null when event_id % 5 = 1 then 'Odd' when event_id % 5 = 2 then 'Aborting' else 'Failed' end end"""


@query("b5_document_engine_status", "", f"""select event_id, word, case when word is null then 'processing'
    when lower(word) in ('fail', 'starting') then 'processing' when lower(word) in ('submitted', 'queuedincromwell') then 'queued'
    when lower(word) = 'running' then 'running' when lower(word) in ('succeeded', 'done') then 'completed'
    when lower(word) = 'aborting' then 'aborting' when lower(word) = 'aborted' then 'aborted' else 'failed' end status
  from (select event_id, {WORD} word from events)""")
def _(t):
    return sta.map_engine_words(t.events.selectExpr("event_id", f"{WORD} word"), "word", "document")


@query("b6_webhook_engine_status", "", """select event_id, word, case word when 'COMPLETED' then 'completed' when 'RUNNING' then 'running'
    when 'FAILED' then 'failed' else 'queued' end status,
  case when errored = false then 'completed' else 'failed' end cached_status
  from (select event_id, case event_type when 'purchase' then 'COMPLETED' when 'view' then 'RUNNING' when 'error' then 'FAILED'
    when 'click' then 'running' else 'SUBMITTED' end word, case when event_id % 3 < 2 then event_id % 3 = 1 end errored from events)""")
def _(t):
    words = t.events.selectExpr(
        "event_id", "case event_type when 'purchase' then 'COMPLETED' when 'view' then 'RUNNING' when 'error' then 'FAILED' "
        "when 'click' then 'running' else 'SUBMITTED' end word",
        "case when event_id % 3 < 2 then event_id % 3 = 1 end errored",
    )
    return sta.map_engine_words(words, "word", "webhook").select(
        "event_id", "word", "status", st.cached_process_status(F.col("errored")).alias("cached_status")
    )


@query("b7_stuck_jobs", "jobs", """select j.run_id, j.id, j.workdir from
    (select *, case when shard <> 3 then concat('/exec/', run_id, '/', id) end workdir from v_jobs) j
  where status = 'running' and workdir is not null and start <= timestamp '1999-06-01' - interval '600' second
    and not exists (select 1 from (select concat('/exec/', o_orderkey, '/step', o_orderkey % 7 + 1, '/execution/script') path from orders) i
      where i.path = concat(j.workdir, '/execution/script'))""")
def _(t):
    jobs = t.jobs.selectExpr(
        "run_id", "id", "status", "start lastupdated",
        "case when shard <> 3 then concat('/exec/', run_id, '/', id) end workdir",
    )
    inv = t.orders.selectExpr("concat('/exec/', o_orderkey, '/step', o_orderkey % 7 + 1, '/execution/script') path")
    return sta.stuck_jobs(jobs, inv, F.expr(AS_OF)).select("run_id", "id", "workdir")


@query("b8_submission_finished", "submissions runs", """select s.id, s.status from
    (select id, case when engine in ('building', 'machinery') then 'completed' when engine = 'furniture' then 'failed' else 'running' end status from v_submissions) s
  where s.status in ('completed', 'failed') and s.id in
    (select submission_id from v_runs group by 1 having bool_and(status in ('completed', 'failed', 'aborted', 'dry-run', 'suspended')
       or start < timestamp '1998-06-01'))""")
def _(t):
    subs = t.submissions.selectExpr(
        "id", "case when engine in ('building', 'machinery') then 'completed' when engine = 'furniture' then 'failed' else 'running' end status"
    )
    runs = t.runs.selectExpr("submission_id", "case when start < timestamp_ntz'1998-06-01 00:00:00' then 'suspended' else status end status")
    return sta.finished(subs, runs)


@query("b10_changed_fields", "kv", """select d.submission_id, d.run_id, d.key, d.value from
    (select submission_id, run_id, key, case when cast(run_id as bigint) % 4 = 0 then concat(value, '!') when cast(run_id as bigint) % 4 = 1 then null else value end as value from v_kv) d
  left join (select * from v_kv where cast(run_id as bigint) % 10 <> 3) b using (submission_id, run_id, key)
  where d.value is not null and d.value is distinct from b.value""")
def _(t):
    base = t.kv.where("cast(run_id as bigint) % 10 <> 3")
    delta = t.kv.withColumn("value", F.expr(
        "case when cast(run_id as bigint) % 4 = 0 then concat(value, '!') when cast(run_id as bigint) % 4 = 1 then null else value end"))
    return store.kv_changes(base, delta, ["submission_id", "run_id"])


@query("b11_error_lines", "event_lines", "select run_id, line_no, line from v_event_lines where contains(line, 'error')")
def _(t):
    return t.event_lines.where(F.col("line").contains("error"))


@query("b12_metadata_list", "kv", "select submission_id, run_id, key, value from v_kv")
def _(t):
    return store.kv_list(t.kv)


@query("d5_count_jobs", "raw_jobs", "select submission_id, count(*) jobs from v_raw_jobs group by 1")
def _(t):
    return jb.count_jobs(t.raw_jobs)


@query("d6_group_rows", "raw_jobs", """with s as (select container, ceil(count(*) / 1000) parts from v_raw_jobs group by 1),
  r as (select container, concat_ws('|', run_id, id, l_partkey, l_suppkey, l_extendedprice::decimal(18,2)) ident, cast(parts as bigint) parts
    from v_raw_jobs join s using (container))
  select container, ('0x' || substr(md5(ident), 1, 8))::bigint % parts part, parts, count(*) n,
    string_agg(ident, ',' order by ident) members from r group by 1, 2, 3""")
def _(t):
    ident = F.concat_ws("|", "run_id", "id", "l_partkey", "l_suppkey", F.col("l_extendedprice").cast("decimal(18,2)"))
    packed = ordered.lists(t.raw_jobs, ["container"], ident, {"member": ident})
    return packed.select("container", "part", "parts", "n", F.array_join("member", ",").alias("members"))


@query("d11_wait_all", "runs", """select case when count(*) = 0 then 'processing'
    when bool_or(status in ('running', 'prepared', 'queued', 'processing')) then 'running' when bool_or(status = 'aborting') then 'aborting'
    when bool_or(status = 'aborted') then 'aborted' when bool_or(status = 'failed') then 'failed'
    when bool_and(status = 'completed') then 'completed' else arg_min(status, o) end status, count(*) n,
    case when bool_or(status = 'aborted') or bool_or(status = 'failed') then 3 else 0 end exit_code
  from (select case when status <> 'completed' then 'failed' else status end status, cast(id as bigint) o from v_runs)""")
def _(t):
    runs = t.runs.selectExpr("id", "case when status <> 'completed' then 'failed' else status end status")
    return sta.collapse_all(runs, F.col("id").cast("bigint"))


@query("d15_milestones", "", """select user_id::varchar submission_id, min(ts) filter (event_type = 'signup') as start,
    min(ts) filter (event_type = 'view') submitWorkflow, min(ts) filter (event_type = 'purchase') copiedOutputs,
    min(ts) filter (event_type = 'click') savedLogs, min(ts) filter (event_type not in ('signup', 'view', 'purchase', 'click')) cleanedUp,
    cast(null as timestamp) createOutputStructure, cast(null as timestamp) saveWorkflow,
    cast(null as timestamp) workflowMovedToFinalState, cast(null as timestamp) savedMetadata
  from events group by 1""")
def _(t):
    return store.milestones(t.spark.sql(PROGRESS.format(src="{e}"), e=t.events))


@query("e1_latest_submission", "runs", "select id from v_runs order by start desc, id limit 1")
def _(t):
    return store.latest_id(t.runs.withColumnRenamed("start", "timestamp"))


@query("e2_existing_ids", "raw_jobs", "select distinct run_id from v_raw_jobs")
def _(t):
    return store.ids(t.raw_jobs, "run_id")


@query("e6_latest_rows", "raw_jobs", """select run_id, id, status, start, l_partkey, l_suppkey, l_extendedprice from v_raw_jobs
  qualify row_number() over (partition by run_id, id order by start desc, l_partkey, l_suppkey, l_extendedprice) = 1""")
def _(t):
    cols = ["run_id", "id", "status", "start", "l_partkey", "l_suppkey", "l_extendedprice"]
    return store.latest_rows(t.raw_jobs.select(*cols), ["run_id", "id"], "start", ["l_partkey", "l_suppkey", "l_extendedprice"])


# --- store maintenance. Base: runs; delta: a changed copy of part of them plus new ones.

DELTA = """select case when o_orderkey % 3 = 0 then concat('n', o_orderkey) else cast(o_orderkey as {s}) end id,
  case when o_orderkey % 5 = 0 then null else cast(o_custkey as {s}) end submission_id,
  case when o_orderkey % 2 = 0 then null else concat('new ', o_orderpriority) end as name,
  case when o_orderkey % 7 < 4 then null else 'failed' end status, o_orderkey seq from {o} where o_orderstatus <> 'F'"""
BASE = """select cast(o_orderkey as {s}) id, case when o_orderkey % 5 = 0 then null else cast(o_custkey as {s}) end submission_id,
  o_orderpriority as name, case o_orderstatus when 'F' then 'completed' when 'O' then 'running' else 'queued' end status,
  o_orderdate as start from {o}"""


def _base(t):
    return t.spark.sql(BASE.format(s="string", o="{o}"), o=t.orders)


def _delta(t):
    return t.spark.sql(DELTA.format(s="string", o="{o}"), o=t.orders)


_B, _D = BASE.format(s="varchar", o="orders"), DELTA.format(s="varchar", o="orders")


@query("f1_upsert", "", f"""with b as ({_B}), d as ({_D})
  select coalesce(d.id, b.id) id, coalesce(d.submission_id, b.submission_id) submission_id, coalesce(d.name, b.name) as name,
    coalesce(d.status, b.status) status, b.start
  from b full outer join d on b.id is not distinct from d.id and b.submission_id is not distinct from d.submission_id""")
def _(t):
    return store.upsert(_base(t), _delta(t).drop("seq"), ("id", "submission_id"))


@query("f1_upsert_repeats", "raw_jobs", """with d as (select run_id, id, arg_max(status, s) filter (status is not null) status,
      arg_max(finish, s) filter (finish is not null) finish
    from (select run_id, id, case when shard = 2 then null else status end status, finish,
      row(start, l_partkey, l_suppkey, l_extendedprice) s from v_raw_jobs where l_partkey % 2 = 0) group by 1, 2),
  b as (select run_id, id, min(status) status, max(finish) finish, count(*) n from v_raw_jobs where l_partkey % 2 = 1 group by 1, 2)
  select coalesce(d.run_id, b.run_id) run_id, coalesce(d.id, b.id) id, coalesce(d.status, b.status) status,
    coalesce(d.finish, b.finish) finish, n from b full outer join d on b.run_id = d.run_id and b.id = d.id""")
def _(t):
    rows = t.raw_jobs
    base = rows.where("l_partkey % 2 = 1").groupBy("run_id", "id").agg(
        F.min("status").alias("status"), F.max("finish").alias("finish"), F.count(F.lit(1)).alias("n"))
    delta = rows.where("l_partkey % 2 = 0").select(
        "run_id", "id", F.when(F.col("shard") != 2, F.col("status")).alias("status"), "finish",
        F.struct("start", "l_partkey", "l_suppkey", "l_extendedprice").alias("seq"))
    return store.upsert(base, delta, ("run_id", "id"), seq="seq")


@query("f1_stored_rounds", "raw_jobs", """with r as (select id, submission_id, run_id, name, case when shard = 2 then null else status end status, start, finish, l_partkey k from v_raw_jobs)
  select id, submission_id, run_id, arg_max(name, row(k, name)) filter (name is not null) as name, arg_max(status, row(k, status)) filter (status is not null) status,
    arg_max(start, row(k, start)) filter (start is not null) start, arg_max(finish, row(k, finish)) filter (finish is not null) finish
  from r group by 1, 2, 3""")
def _(t):
    """Batches arrive out of order, one twice, with compactions in between; the table is the same."""
    root, spec = new_path(t.spark, "store"), SPECS["jobs"]
    status = F.when(F.col("shard") != 2, F.col("status")).alias("status")
    rows = cut(t.raw_jobs.select("id", "submission_id", "run_id", "name", status, "start", "finish", F.col("l_partkey").alias("seq"), (F.col("l_suppkey") % 3).alias("part")))
    batch = [rows.where(F.col("part") == k).drop("part") for k in range(3)]
    store.write(batch[2], root, spec, seq="seq")
    for k in (0, 1, 0):
        store.append(t.spark, root, spec, batch[k], seq="seq")
        store.compact(t.spark, root, spec, whole=k == 1)
    release(rows)
    out = store.read(t.spark, root, spec).select("id", "submission_id", "run_id", "name", "status", "start", "finish")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "finish")})


@query("f2_split_delta", "", f"""with b as ({_B}), d as ({_D})
  select d.id, d.submission_id, d.name, d.status, case when exists (select 1 from b where b.id is not distinct from d.id
    and b.submission_id is not distinct from d.submission_id) then 'update' else 'insert' end change from d""")
def _(t):
    return store.split_delta(_base(t), _delta(t), ["id", "submission_id"]).drop("seq")


@query("f3_change_capture", "runstatus", """with b as (select run_id, arg_max(status, seq) status from v_runstatus where seq % 4 = 0 group by 1 having cast(run_id as bigint) % 3 > 0),
  d as (select run_id, seq, status, lag(status) over (partition by run_id order by seq) before from v_runstatus where seq % 4 <> 0)
  select d.run_id, d.seq, d.status, case when coalesce(before, b.status) is null then 'insert'
    when coalesce(before, b.status) = d.status then 'skip' else 'update' end change from d left join b using (run_id)""")
def _(t):
    rows = t.runstatus
    base = rows.where("seq % 4 = 0").groupBy("run_id").agg(F.max_by("status", "seq").alias("status")).where("cast(run_id as bigint) % 3 > 0")
    delta = rows.where("seq % 4 <> 0").select("run_id", "seq", "status")
    return store.capture_changes(base, delta, ["run_id"], "seq")


@query("f4_kv_replace", "kv runstatus", """select submission_id, run_id, key, arg_max(value, seq) as value from
    (select submission_id, run_id, key, value, -1 seq from v_kv union all
     select cast(o_custkey as varchar), run_id, 'status', case when status = 'queued' then null else status end, seq
       from v_runstatus join orders on cast(o_orderkey as varchar) = run_id)
  where value is not null group by 1, 2, 3""")
def _(t):
    owner = t.orders.selectExpr("cast(o_custkey as string) submission_id", "cast(o_orderkey as string) run_id")
    delta = t.runstatus.join(owner, "run_id").select(
        "submission_id", "run_id", F.lit("status").alias("key"),
        F.when(F.col("status") != "queued", F.col("status")).alias("value"), "seq")
    return store.kv_replace(t.kv.withColumn("seq", F.lit(-1).cast("bigint")), delta, ["submission_id", "run_id"], "seq")


@query("f5_delete_ids", "runs", """select id, submission_id, status from v_runs r where not exists
  (select 1 from events e where cast(e.user_id as varchar) = r.id)""")
def _(t):
    gone = t.events.selectExpr("cast(user_id as string) id")
    return store.delete_ids(t.runs, gone).select("id", "submission_id", "status")


@query("f6_status_transitions", "runstatus", "select run_id, status, max(date) as date from v_runstatus group by 1, 2")
def _(t):
    return store.record_transitions(t.runstatus.where("seq % 2 = 0"), t.runstatus.where("seq % 2 = 1"), ["run_id"])


@query("f7_stamp", "runs", "select id, submission_id, status, timestamp '1999-06-01' last_updated from v_runs")
def _(t):
    return store.stamp(t.runs.select("id", "submission_id", "status"), F.expr(AS_OF))


@query("x1_set_difference", "contigs", """select distinct contig from v_contigs where input in (select cast(o_orderkey as varchar) from orders where o_orderstatus = 'O')
  except select distinct concat('chr', p_size % 7 * 3) from part""")
def _(t):
    open_runs = t.orders.where("o_orderstatus = 'O'").selectExpr("cast(o_orderkey as string) input")
    have = t.contigs.join(open_runs, "input", "left_semi").select("contig")
    return have.distinct().join(t.part.selectExpr("concat('chr', p_size % 7 * 3) contig"), "contig", "left_anti")


@query("x3_union_parents", "jobs", """select submission_id, run_id, coalesce(id, parent) id, parent, status, start, finish, kind from (
    select submission_id, run_id, parent id, null parent, case when bool_or(status = 'running') then 'running' when bool_or(status = 'aborted') then 'aborted'
      when bool_or(status = 'failed') then 'failed' when bool_and(status = 'completed') then 'completed' end status,
      min(start) as start, case when count(finish) = count(*) then max(finish) end finish, 'parent' kind
      from v_jobs where attempt > 1 group by 1, 2, 3
    union all select submission_id, run_id, id, parent, status, start, finish, 'shard' from v_jobs where attempt > 1
    union all select submission_id, run_id, id, parent, status, start, finish, 'plain' from v_jobs where attempt = 1)""")
def _(t):
    cols = ["submission_id", "run_id", "id", "parent", "status", "start", "finish"]
    shards = t.stored_jobs.where("attempt > 1").select(*cols)
    plain = t.stored_jobs.where("attempt = 1").select(*cols)
    return jb.with_parents(shards, plain, F.col("id")).select(*cols, "kind")


@query("h2_h3_h13_path_profile", "", """select case when lower(path) like 'http://%' or lower(path) like 'https://%' then 'http' when lower(path) like 'gs://%' then 'gs'
    when lower(path) like 's3://%' then 's3' else 'local' end scheme,
    nullif(regexp_extract(regexp_replace(path, '^file://', ''), '\\.([^./]+)$', 1), '') extension, count(*) files
  from (select case page_id % 4 when 0 then url when 1 then regexp_replace(url, '^https?://', 'gs://') when 2 then regexp_replace(url, '^https?:', 'file:/')
    else regexp_replace(url, '^https?://', 'S3://') end path from pages) group by 1, 2""")
def _(t):
    files = t.pages.selectExpr(
        "case page_id % 4 when 0 then url when 1 then regexp_replace(url, '^https?://', 'gs://') when 2 then regexp_replace(url, '^https?:', 'file:/') "
        "else regexp_replace(url, '^https?://', 'S3://') end path")
    return inventory.profile(files)


@query("h4_h5_h1_run_durations", "raw_jobs", """select run_id, id, l_partkey, l_suppkey, start, secs, case when secs is null then 'N/A' when secs < 60 then concat(secs, 's')
    when secs < 3600 then concat(secs // 60, 'm:', lpad(cast(secs % 60 as varchar), 2, '0'), 's')
    when secs < 86400 then concat(secs // 3600, 'h:', lpad(cast(secs // 60 % 60 as varchar), 2, '0'), 'm:', lpad(cast(secs % 60 as varchar), 2, '0'), 's')
    else concat(secs // 86400, 'd:', lpad(cast(secs // 3600 % 24 as varchar), 2, '0'), 'h:', lpad(cast(secs // 60 % 60 as varchar), 2, '0'), 'm:', lpad(cast(secs % 60 as varchar), 2, '0'), 's') end duration
  from (select run_id, id, l_partkey, l_suppkey, start, case when status <> 'running' then
    (epoch_us(finish) - epoch_us(start)) // 1000000 * (l_partkey % 100) // 50 end secs from v_raw_jobs)""")
def _(t):
    start = timing.parse_iso(F.date_format("start", "yyyy-MM-dd'T'HH:mm:ssXXX"))
    secs = F.when(F.col("status") != "running", F.floor(F.floor(timing.seconds_between(start, F.col("finish"))) * (F.col("l_partkey") % 100) / 50))
    rows = t.raw_jobs.withColumn("start", F.col("start").cast("timestamp")).withColumn("finish", F.col("finish").cast("timestamp"))
    return rows.withColumn("secs", secs).select(
        "run_id", "id", "l_partkey", "l_suppkey", F.col("start").cast("timestamp_ntz").alias("start"), "secs",
        timing.duration_text(F.col("secs")).alias("duration"))


@query("h6_bucket_usage", "paths", """select regexp_extract(link, '^gs://([A-z0-9-]+)/(.*)', 1) bucket, count(*) objects, cast(sum(size) as bigint) bytes
  from (select regexp_replace(replace(path, '.', '-'), '^https?://', 'gs://') link, size from v_paths) group by 1""")
def _(t):
    files = t.paths.selectExpr("regexp_replace(replace(path, '.', '-'), '^https?://', 'gs://') path", "size")
    return inventory.bucket_usage(files)


@query("t3_clean_numbers", "", """select event_id, case when s >= 0 then s end shard, case when a > 1 then a end attempt from
  (select event_id, try_cast(case when event_id % 6 = 0 then 'x' else cast(event_id % 5 - 2 as varchar) end as int) s, cast(user_id % 4 as int) a from events)""")
def _(t):
    rows = t.events.selectExpr(
        "event_id", "case when event_id % 6 = 0 then 'x' else cast(event_id % 5 - 2 as string) end shard", "cast(user_id % 4 as string) attempt")
    return jb.clean_numbers(rows)

"""Queries: status roll-ups, job trees, reports and the batch twins of the streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.functions import status as st
from flowlens.functions import timing, values
from flowlens.operators import health, jobs as jb
from flowlens.operators import ordered, report, status as sta
from flowlens.operators.lineage import cut
from flowlens.plans.adapter import Tables
from flowlens.plans.registry import query

def as_of():
    return F.expr("timestamp_ntz'2002-01-01 00:00:00'")


AS_OF_SQL = "timestamp '2002-01-01'"


def collapse_sql(status: str, ord_: str) -> str:
    return f"""case when count({status}) = 0 then 'processing'
      when bool_or({status} in ('running', 'prepared', 'queued', 'processing')) then 'running'
      when bool_or({status} = 'aborting') then 'aborting' when bool_or({status} = 'aborted') then 'aborted'
      when bool_or({status} = 'failed') then 'failed' when bool_and({status} = 'completed') then 'completed'
      else arg_min({status}, {ord_}) end"""


def duration_sql(secs: str) -> str:
    def two(x: str) -> str:
        return f"lpad(cast({x} as varchar), 2, '0')"

    return f"""case when {secs} is null then 'N/A' when {secs} < 60 then concat({secs}, 's')
      when {secs} < 3600 then concat({secs} // 60, 'm:', {two(f'{secs} % 60')}, 's')
      when {secs} < 86400 then concat({secs} // 3600, 'h:', {two(f'{secs} // 60 % 60')}, 'm:', {two(f'{secs} % 60')}, 's')
      else concat({secs} // 86400, 'd:', {two(f'{secs} // 3600 % 24')}, 'h:', {two(f'{secs} // 60 % 60')}, 'm:', {two(f'{secs} % 60')}, 's') end"""


@query("c2_attach_parents", "jobs", """select j.submission_id, j.run_id, j.id, j.parent, p.status parent_status,
    case when j.parent is null then 'root' when p.id is not null then 'child' else 'orphan' end place
  from v_jobs j left join v_jobs p on p.submission_id = j.submission_id and p.run_id = j.run_id and p.id = j.parent""")
def _(t: Tables):
    return jb.attach_parents(t.stored_jobs).select("submission_id", "run_id", "id", "parent", "parent_status", "place")


@query("c3_descendants", "jobs", """with recursive d as (select submission_id, run_id, id root, id, 0 depth from v_jobs where parent is null
    union all select d.submission_id, d.run_id, d.root, j.id, d.depth + 1 from d join v_jobs j
      on j.submission_id = d.submission_id and j.run_id = d.run_id and j.parent = d.id)
  select * from d where depth > 0""")
def _(t):
    return jb.descendants(t.stored_jobs, t.stored_jobs.where("parent is null"))


LABELS = """select cast(o_custkey as {s}) submission_id, cast(o_orderkey as {s}) run_id, 'step1' job_id,
  {a}concat('L', o_orderkey % 10), 'M', 'N'{b} labels from {o} where o_orderkey % 2 = 0"""


@query("c4_label_shards", "jobs", f"""with l as ({LABELS.format(s='varchar', a='[', b=']', o='orders')})
  select j.submission_id, j.run_id, j.id, coalesce(l.labels[j.shard + 1], j.name) as name from v_jobs j
  left join (select l.* from l join v_jobs r on r.submission_id = l.submission_id and r.run_id = l.run_id and r.id = l.job_id and r.parent is null) l
    on l.submission_id = j.submission_id and l.run_id = j.run_id and l.job_id = j.parent""")
def _(t):
    labels = t.spark.sql(LABELS.format(s="string", a="array(", b=")", o="{o}"), o=t.orders)
    return jb.label_shards(t.stored_jobs, labels).select("submission_id", "run_id", "id", "name")


@query("d1_shard_roll_up", "raw_jobs", f"""select submission_id, run_id, name, min(start) as start,
    case when count(finish) = count(*) then max(finish) end finish, {collapse_sql('status', 'shard')} status, count(*) jobs
  from v_raw_jobs group by 1, 2, 3""")
def _(t):
    return jb.roll_up_shards(t.raw_jobs, ["submission_id", "run_id", "name"], "shard")


@query("d2_collapse_status", "runstatus", f"""select run_id, date_trunc('hour', date) as hour,
    {collapse_sql("case when status = 'queued' then 'on-hold' when status in ('running', 'processing') and seq % 3 > 0 then 'dry-run' else status end", 'seq')} status
  from v_runstatus group by 1, 2""")
def _(t):
    rows = t.runstatus.withColumn("hour", F.date_trunc("hour", "date")).withColumn("status", F.expr(
        "case when status = 'queued' then 'on-hold' when status in ('running', 'processing') and seq % 3 > 0 then 'dry-run' else status end"))
    return sta.collapse(rows, ["run_id", "hour"], "seq").withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@query("d3_run_timeline", "runstatus", """select run_id, arg_max(status, row(date, seq)) status, min(date) as start,
    min(date) filter (status in ('completed', 'failed', 'aborted', 'dry-run', 'suspended')) finish from v_runstatus group by 1""")
def _(t):
    return sta.timeline(t.runstatus, ["run_id"])


@query("d4_submission_roll_up", "raw_jobs", f"""with r as (select submission_id, run_id, min(start) as start,
      case when count(finish) = count(*) then max(finish) end finish, {collapse_sql('status', 'row(start, id)')} status,
      count(*) jobs, count(*) filter (status = 'failed') failed_jobs from v_raw_jobs group by 1, 2),
  s as (select submission_id, min(start) as start, case when count(finish) = count(*) then max(finish) end finish,
      max(start) last_updated, {collapse_sql('status', 'row(start, run_id)')} status,
      string_agg(distinct status, ', ' order by status) statuses, count(*) runs, cast(sum(jobs) as bigint) jobs,
      cast(sum(failed_jobs) as bigint) failed_jobs from r group by 1),
  d as (select *, cast(round_even((epoch_us(coalesce(finish, {AS_OF_SQL})) - epoch_us(start)) / 1000000, 0) as bigint) as seconds,
      (epoch_us({AS_OF_SQL}) - epoch_us(last_updated)) // 1000000 ago from s)
  select * exclude (ago), {duration_sql('"seconds"')} duration,
    case when ago > 2 then concat({duration_sql('ago')}, ' ago') else 'Just now' end updated from d""")
def _(t):
    runs = report.run_bounds(t.raw_jobs).withColumn("last_updated", F.col("start"))
    return report.roll_up(runs, as_of())


@query("d4_submission_texts", "runs", """with e as (select submission_id, concat('e', id) text from v_runs where status <> 'queued'),
   n as (select distinct submission_id, name as text from v_runs),
   f as (select submission_id, concat('rc ', id) text from v_runs where status = 'running'),
   u as (select 'engine_ids' section, * from e union all select 'names', * from n union all select 'errors', * from f),
   p as (select section, submission_id, ceil(count(*) / 10) parts from u group by 1, 2)
  select submission_id, section, 1 ord, ('0x' || substr(md5(text), 1, 8))::bigint % cast(parts as bigint) part, cast(parts as bigint) parts, count(*) n,
    string_agg(text, ', ' order by text) text from u join p using (section, submission_id) group by all
  union all select cast(c_custkey as varchar), 'errors', 0, 0, 1, 1, concat('GLOBAL: low ', c_mktsegment) from customer where c_acctbal < 0""")
def _(t):
    runs = t.runs.selectExpr(
        "submission_id", "case when status <> 'queued' then concat('e', id) end engine_id", "name",
        "case when status = 'running' then concat('rc ', id) end error")
    subs = t.customer.selectExpr("cast(c_custkey as string) id", "case when c_acctbal < 0 then concat('low ', c_mktsegment) end error")
    return report.texts(subs, runs, size=10)


@query("c1_assemble", "submissions runs raw_jobs runstatus kv", """with o as (select submission_id, max(value) filter (key = 'name') as name,
      max(value) filter (key = 'status') status from v_kv group by 1),
  h as (select s.id submission_id, s.author, s.engine, s.output_dir, o.name, o.status, cast(null as varchar) error, r.id run_id, r.status run_status, r.name run_name
    from v_submissions s left join o on o.submission_id = s.id left join v_runs r on r.submission_id = s.id),
  c as (select 'jobs' section, submission_id, run_id, concat_ws('|', id, status, l_partkey, l_suppkey, l_extendedprice::decimal(18,2)) item from v_raw_jobs
    union all select 'events', r.submission_id, e.run_id, concat_ws('|', e.seq, e.status) from v_runstatus e join v_runs r on r.id = e.run_id),
  p as (select section, submission_id, run_id, ceil(count(*) / 20) parts from c group by 1, 2, 3),
  g as (select submission_id, run_id, section, ('0x' || substr(md5(item), 1, 8))::bigint % cast(parts as bigint) part, cast(parts as bigint) parts, count(*) n,
     string_agg(item, ',' order by item) items from c join p using (section, submission_id, run_id) group by all)
  select * from h left join g using (submission_id, run_id)""")
def _(t):
    head = report.header(t.submissions, t.runs, t.kv)
    item = F.concat_ws("|", "id", "status", "l_partkey", "l_suppkey", F.col("l_extendedprice").cast("decimal(18,2)"))
    owner = t.runs.select("submission_id", F.col("id").alias("run_id"))
    events = t.runstatus.join(owner, "run_id")
    event = F.concat_ws("|", "seq", "status")
    out = report.assemble(head, {"jobs": (t.raw_jobs, item, item), "events": (events, event, event)}, size=20)
    return out.withColumn("items", F.array_join("items", ","))


CHILDREN = {
    "inputs": "select cast(l_orderkey as {s}) run_id, concat('p', l_partkey % 5, '=', max(l_suppkey)) item from {l} group by l_orderkey, l_partkey % 5",
    "outputs": "select cast(l_orderkey as {s}) run_id, concat('o', l_linenumber, ':/out/', min(l_partkey), '.bam') item from {l} where l_linestatus = 'F' group by l_orderkey, l_linenumber",
    "labels": "select distinct cast(l_orderkey as {s}) run_id, concat('L', l_suppkey % 4) item from {l} where l_returnflag = 'A'",
}
RUN_ERRORS = "select cast(o_custkey as {s}) submission_id, cast(o_orderkey as {s}) run_id, 'error' as key, concat('lost ', o_orderkey) as value from {o} where o_totalprice < 20000"


@query("c1_assemble_children", "submissions runs kv", f"""with k as (select submission_id, key, value from v_kv union all
      select submission_id, key, value from ({RUN_ERRORS.format(s='varchar', o='orders')})),
  o as (select submission_id, max(value) filter (key = 'name') as name, max(value) filter (key = 'status') status, max(value) filter (key = 'error') error from k group by 1),
  h as (select s.id submission_id, s.author, s.engine, s.output_dir, o.name, o.status, o.error, r.id run_id, r.status run_status, r.name run_name
    from v_submissions s left join o on o.submission_id = s.id left join v_runs r on r.submission_id = s.id),
  c as (select section, r.submission_id, run_id, item from ({' union all '.join(f"select '{n}' section, run_id, item from ({q.format(s='varchar', l='lineitem')})" for n, q in CHILDREN.items())})
    join v_runs r on r.id = run_id),
  p as (select section, submission_id, run_id, ceil(count(*) / 20) parts from c group by 1, 2, 3),
  g as (select submission_id, run_id, section, ('0x' || substr(md5(item), 1, 8))::bigint % cast(parts as bigint) part, cast(parts as bigint) parts, count(*) n,
     string_agg(item, ',' order by item) items from c join p using (section, submission_id, run_id) group by all)
  select * from h left join g using (submission_id, run_id)""")
def _(t):
    errors = t.spark.sql(RUN_ERRORS.format(s="string", o="{o}"), o=t.orders)
    head = report.header(t.submissions, t.runs, t.kv.unionByName(errors))
    owner = t.runs.select("submission_id", F.col("id").alias("run_id"))
    children = {}
    for name, sql in CHILDREN.items():
        rows = t.spark.sql(sql.format(s="string", l="{l}"), l=t.lineitem).join(owner, "run_id")
        children[name] = (rows, F.col("item"), F.col("item"))
    return report.assemble(head, children, size=20).withColumn("items", F.array_join("items", ","))


POLLS = "select run_id, seq, date, status, cast(date_trunc('week', date) as {t}) last_updated from {r}"


@query("s5_live_board", "runstatus", f"""with recursive p as (select *, row_number() over (partition by run_id order by date, seq) rn from ({POLLS.format(r='v_runstatus', t='timestamp')})),
  b as (select run_id, rn, true due, last_updated shown, 0 skips, status in ('completed', 'failed') done from p where rn = 1
    union all select p.run_id, p.rn, d.due, case when d.due then p.last_updated else b.shown end, case when d.due then 0 else b.skips + 1 end, p.status in ('completed', 'failed')
      from b join p on p.run_id = b.run_id and p.rn = b.rn + 1,
      lateral (select b.done or p.last_updated > b.shown or b.skips > 1 or p.status in ('completed', 'failed') due) d)
  select run_id, seq, status, last_updated from b join p using (run_id, rn) where due""")
def _(t):
    polls = t.spark.sql(POLLS.format(r="{r}", t="timestamp_ntz"), r=t.runstatus)
    return health.live_board(polls, ["date", "seq"], max_skips=1).select("run_id", "seq", "status", "last_updated")


@query("d18_settle_jobs", "raw_jobs runs", """select j.run_id, j.id, j.l_partkey, j.l_suppkey,
    case when j.status <> 'completed' and r.status <> 'completed' then r.status else j.status end status
  from v_raw_jobs j left join v_runs r on r.id = j.run_id""")
def _(t):
    return sta.settle_jobs(t.raw_jobs.select("run_id", "id", "l_partkey", "l_suppkey", "status"), t.runs)


TREE_SQL = """tree as (select submission_id, run_id, id, 0 depth, id path from v_jobs where parent is null
    union all select t.submission_id, t.run_id, j.id, t.depth + 1, concat(t.path, '/', j.id) from tree t join v_jobs j
      on j.submission_id = t.submission_id and j.run_id = t.run_id and j.parent = t.id)"""


@query("e3_report_order", "jobs", f"""with recursive {TREE_SQL.replace("id path from", "id path, [row(0, start is null, start, id)] k from").replace("j.id) from", "j.id), list_append(t.k, row(coalesce(j.shard, 0), j.start is null, j.start, j.id)) from")}
  select submission_id, run_id, id, depth, path, row_number() over (partition by submission_id, run_id order by k) place from tree""")
def _(t):
    # Cut once: slices read it more than once.
    tree = cut(jb.report_order(t.stored_jobs).select(
        "submission_id", "run_id", "id", "depth", F.array_join("path.id", "/").alias("path"), F.col("path").alias("k")))
    rows, slice_by = ordered.slices(tree, ["submission_id", "run_id"], ["k"])
    at = ordered.position(rows, ["submission_id", "run_id"], ["k"], slice_by, "place")
    return at.select("submission_id", "run_id", "id", "depth", "path", F.col("place").cast("bigint").alias("place"))


@query("g22_label_rows", "", """with s as (select cast(l_orderkey as varchar) run_id, cast(o_custkey as varchar) submission_id, concat('step', l_linenumber) step,
      case when l_returnflag = 'R' then concat('p', l_partkey % 5) end labels_from from lineitem join orders on l_orderkey = o_orderkey),
  m as (select cast(o_orderkey as varchar) run_id, cast(o_custkey as varchar) submission_id, concat('p', o_orderkey % 5) as name,
      case when o_orderkey % 3 > 0 then concat(o_orderpriority, '|', o_orderkey) end labels from orders)
  select submission_id, run_id, step job_id, labels from s join m using (submission_id, run_id) where s.labels_from = m.name and labels is not null""")
def _(t):
    steps = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).selectExpr(
        "cast(l_orderkey as string) run_id", "cast(o_custkey as string) submission_id", "concat('step', l_linenumber) step",
        "case when l_returnflag = 'R' then concat('p', l_partkey % 5) end labels_from")
    manifest = t.orders.selectExpr(
        "cast(o_orderkey as string) run_id", "cast(o_custkey as string) submission_id", "concat('p', o_orderkey % 5) name",
        "case when o_orderkey % 3 > 0 then array(o_orderpriority, cast(o_orderkey as string)) end value")
    return jb.label_rows(steps, manifest).withColumn("labels", F.array_join("labels", "|"))


@query("h10_display_names", "jobs", """select run_id, id, concat(name, case when attempt > 1 then concat(' (shard-', shard, ', attempt-', attempt, ')')
    else concat(' (shard-', shard, ')') end) as name from v_jobs""")
def _(t):
    return t.jobs.select("run_id", "id", values.display_name(F.col("name"), F.col("shard"), F.col("attempt")).alias("name"))


REPORT_EXTRA = """*, shard = 0 cached, concat('b', run_id) batchid, case when shard > 1 then 'slurm' end backend,
  cast(shard as {s}) returncode, case when shard = 2 then concat('/err/', id) end stderr, case when shard = 3 then 'boom' end error"""


@query("h11_status_report", "jobs", f"""with recursive x as (select {REPORT_EXTRA.format(s='varchar')} from v_jobs),
  kids as (select submission_id, run_id, parent id, count(*) n from v_jobs where parent is not null group by 1, 2, 3),
  roots as (select submission_id, run_id, count(*) n from v_jobs where parent is null group by 1, 2),
  y as (select x.*, coalesce(k.n, 0) kids, x.status = 'completed' and not (x.parent is null and r.n = 1) folds from x
    left join kids k using (submission_id, run_id, id) left join roots r using (submission_id, run_id)),
  tree as (select y.*, 0 depth from y where parent is null union all
    select y.*, t.depth + 1 from tree t join y on y.submission_id = t.submission_id and y.run_id = t.run_id and y.parent = t.id where not t.folds),
  s as (select *, (epoch_us(coalesce(finish, {AS_OF_SQL})) - epoch_us(start)) // 1000000 secs from tree)
  select submission_id, run_id, id, depth, case status when 'running' then '~' when 'completed' then '✓' when 'failed' then '!' else 'T' end symbol,
    concat(name, ' (shard-', shard, case when attempt > 1 then concat(', attempt-', attempt) else '' end, ')') as name,
    {duration_sql('secs')} duration,
    case when kids > 0 and not folds then '' when status = 'completed' then case when cached then 'from cache: True' else '' end
      when status = 'running' then concat_ws('; ', concat('batchid: ', batchid), 'backend: ' || backend)
      when status = 'failed' then concat_ws('; ', case when returncode <> '0' then concat('rc: ', returncode) end, 'stderr: ' || stderr, 'error: ' || error)
      else '' end details from s""")
def _(t):
    jobs = t.spark.sql(f"select {REPORT_EXTRA.format(s='string')} from {{j}}", j=t.stored_jobs)
    out = report.status_report(jobs, as_of(), brief=True)
    return out.drop("path").withColumn("details", F.array_join("details", "; "))


@query("h12_age_text", "runs", f"""select id, case when ago > 2 then concat({duration_sql('ago')}, ' ago') else 'Just now' end age from
  (select id, (epoch_us({AS_OF_SQL}) - epoch_us(start + (cast(id as bigint) % 90000) * interval '1' second)) // 1000000 ago from v_runs)""")
def _(t):
    at = F.expr("start + make_dt_interval(0, 0, 0, cast(id as bigint) % 90000)")
    return t.runs.select("id", timing.age_text(at, as_of()).alias("age"))


@query("s3_status_changes", "runstatus", """select run_id, seq, date, status, previous, status <> 'processing' notifies from
    (select *, lag(status) over (partition by run_id order by date, seq) previous from v_runstatus)
  where status is distinct from previous""")
def _(t):
    return sta.changes(t.runstatus, ["run_id"]).select("run_id", "seq", "date", "status", "previous", "notifies")


OBSERVED = """select cast(user_id as {s}) submission_id, {day} tick, event_id % 3 job_id, event_type in ('error', 'click', 'view') stuck from {e}"""


@query("s4_health_checks", "", f"""with o as ({OBSERVED.format(s='varchar', day="date_diff('day', timestamp '2024-01-01', ts)", e='events')}),
  m as (select submission_id, tick, job_id, bool_and(stuck) stuck from o group by 1, 2, 3),
  t as (select submission_id, tick, count(*) checked, count(*) filter (stuck) stuck_jobs,
     coalesce(string_agg(job_id, ',' order by job_id) filter (stuck), '') ids from m group by 1, 2),
  u as (select *, stuck_jobs > 0 and stuck_jobs = checked unhealthy from t),
  l as (select *, lag(unhealthy) over w prev, lag(ids) over w prev_ids, lag(checked) over w prev_checked from u window w as (partition by submission_id order by tick))
  select submission_id, tick, checked, stuck_jobs, unhealthy, coalesce(unhealthy and prev and ids = prev_ids and checked = prev_checked, false) abort from l""")
def _(t):
    obs = t.spark.sql(OBSERVED.format(s="string", day="cast(datediff(ts, date'2024-01-01') as bigint)", e="{e}"), e=t.events)
    return health.health_checks(obs)


@query("s6_completions", "runstatus", """select run_id, arg_min(status, row(date, seq)) status, min(date) as date, arg_min(seq, row(date, seq)) seq
  from v_runstatus where status in ('completed', 'failed', 'aborted', 'dry-run', 'suspended', 'execution-ended') group by 1""")
def _(t):
    return health.completions(t.runstatus, ["run_id"])


@query("s7_silences", "runstatus", """select run_id, seq, date last_contact, next_contact, date + interval '600' minute suspended_at, 'suspended' status from
    (select *, lead(date) over (partition by run_id order by date, seq) next_contact from v_runstatus)
  where epoch_us(coalesce(next_contact, timestamp '2024-02-01')) - epoch_us(date) > 36000000000""")
def _(t):
    return health.silences(t.runstatus, ["run_id"], F.expr("timestamp_ntz'2024-02-01 00:00:00'"), minutes=600)


@query("s8_error_streaks", "", """with p as (select cast(user_id as varchar) run_id, event_id seq, case when event_type in ('purchase') then 'ok'
     when event_type in ('error', 'view', 'click') then 'metadata' else 'connection' end outcome from events),
  i as (select *, sum(case when outcome = 'ok' then 1 else 0 end) over (partition by run_id order by seq) island from p),
  c as (select run_id, seq, outcome, cast(sum(case when outcome = 'metadata' then 1 else 0 end) over (partition by run_id, island order by seq) as bigint) errors from i)
  select *, errors > 5 failed from c""")
def _(t):
    polls = t.events.selectExpr(
        "cast(user_id as string) run_id", "event_id seq",
        "case when event_type in ('purchase') then 'ok' when event_type in ('error', 'view', 'click') then 'metadata' else 'connection' end outcome")
    return health.error_streaks(polls, ["run_id"], "metadata", 5)


@query("s9_execution_ended", "runs", "select id, case when status = 'completed' then 'execution-ended' else status end status from v_runs")
def _(t):
    return t.runs.select("id", st.execution_ended(F.col("status")).alias("status"))

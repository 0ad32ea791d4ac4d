"""Store-shaped views over the driver's tables, as DataFrames and as SQL for the twin."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.engine import tune
from flowlens.operators import ordered
from flowlens.operators.lineage import cut

BASE = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

# Bytes: below the first a table is not worth spreading; the second is Spark's usual split.
class Tables:
    """The driver's tables of one folder, and the run-history shapes derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = tune(spark)
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.read(name)
        raise AttributeError(name)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def submissions(self) -> DataFrame:
        return self.customer.selectExpr(
            "cast(c_custkey as string) id", "concat('/out/', c_name) output_dir",
            "lower(c_mktsegment) engine", "c_name author",
        )

    @cached_property
    def runs(self) -> DataFrame:
        return self.orders.selectExpr(
            "cast(o_orderkey as string) id", "cast(o_custkey as string) submission_id",
            "o_orderpriority name", "o_orderdate start",
            "case o_orderstatus when 'F' then 'completed' when 'O' then 'running' else 'queued' end status",
        )

    @cached_property
    def _attempts(self) -> DataFrame:
        """Line items with the repeat number of each (order, line).

        Where no order holds much of the table they are dealt by order, so that numbering and the join
        with the orders share one shuffle; otherwise they are counted slice by slice.
        """
        order = [
            "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount",
            "l_tax", "l_returnflag", "l_linestatus",
        ]
        lines, month = self.read("lineitem"), ordered.time_slice(F.col("l_shipdate"), "MONTH")
        keys = ["l_orderkey", "l_linenumber"]
        if ordered.slices(lines, ["l_orderkey"], order[:3])[1] is not None:
            return ordered.position(lines, keys, order, month, "attempt")
        # A line without a number is no key; such rows are counted by month, as slices leave them.
        lines = lines.repartition("l_orderkey").withColumn("_month", F.when(F.col("l_linenumber").isNull(), month))
        return ordered.position(lines, [*keys, "_month"], order, None, "attempt")

    @cached_property
    def jobs(self) -> DataFrame:
        """Jobs with ids unique inside a run: repeats of a line are later attempts."""
        return self._as_jobs(self._attempts).selectExpr(
            "concat(name, case when attempt > 1 then concat('_attempt-', attempt) else '' end) id",
            "run_id", "submission_id",
            "case when attempt > 1 then name when l_linenumber > 1 then 'step1' end parent",
            "name", "shard", "cast(attempt as int) attempt", "status", "start", "finish", "container",
        )

    @cached_property
    def stored_jobs(self) -> DataFrame:
        """Jobs written once as a table, for operators that read them several times."""
        return cut(self.jobs)

    @cached_property
    def raw_jobs(self) -> DataFrame:
        """The un-keyed job log: the same rows, but an id may repeat inside a run."""
        return self._as_jobs(self.lineitem).selectExpr(
            "name id", "run_id", "submission_id",
            "case when l_linenumber > 1 then 'step1' end parent", "name", "shard", "status", "start",
            "finish", "container", "l_partkey", "l_suppkey", "l_extendedprice",
        )

    def _as_jobs(self, lines: DataFrame) -> DataFrame:
        return lines.join(
            self.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")
        ).selectExpr(
            "*",
            "cast(l_orderkey as string) run_id", "cast(o_custkey as string) submission_id",
            "concat('step', l_linenumber) name", "cast(l_suppkey % 4 as int) shard",
            "case when l_returnflag = 'R' then 'failed' when l_returnflag = 'A' then 'aborted' "
            "when l_linestatus = 'F' then 'completed' else 'running' end status",
            "l_shipdate start",
            "case when not (l_returnflag = 'N' and l_linestatus = 'O') "
            "then l_shipdate + make_dt_interval(0, cast(l_quantity as int)) end finish",
            "concat('quay.io/bio/', 'tool', l_partkey % 50, ':1.', l_partkey % 7) container",
        )

    @cached_property
    def runstatus(self) -> DataFrame:
        return self.events.selectExpr(
            "cast(user_id as string) run_id", "event_id seq", "ts date",
            "case event_type when 'signup' then 'queued' when 'view' then 'processing' "
            "when 'click' then 'running' when 'purchase' then 'completed' else 'failed' end status",
        )

    @cached_property
    def paths(self) -> DataFrame:
        return self.pages.selectExpr(
            "cast(page_id as string) id",
            "split_part(split_part(url, '#', 1), '?', 1) path", "cast(length(html) as bigint) size",
        )

    @cached_property
    def manifest(self) -> DataFrame:
        return self.lineitem.selectExpr(
            "cast(l_orderkey as string) manifest_id", "l_linenumber layer",
            "concat('p', l_partkey % 5) name", "cast(l_suppkey as string) value",
            "l_partkey", "l_suppkey", "l_shipdate",
        )

    @cached_property
    def kv(self) -> DataFrame:
        """Key/value rows per run; a key without a value has no row."""
        return self.orders.selectExpr(
            "cast(o_custkey as string) submission_id", "cast(o_orderkey as string) run_id",
            "stack(3, 'status', o_orderstatus, 'name', nullif(o_orderpriority, '5-LOW'), "
            "'day', cast(cast(o_orderdate as date) as string)) as (key, value)",
        ).where("value is not null")

    @cached_property
    def contigs(self) -> DataFrame:
        return self.lineitem.selectExpr(
            "cast(l_orderkey as string) input", "concat('chr', l_partkey % 30) contig"
        )

    @cached_property
    def document_lines(self) -> DataFrame:
        from flowlens.sources import logs

        return logs.lines_of_text(
            self.documents.selectExpr("cast(doc_id as string) run_id", "text"), "run_id", "text"
        )

    @cached_property
    def event_lines(self) -> DataFrame:
        """A log per user, one line per event: nested workflow and step messages, errors, noise."""
        return self.events.selectExpr(
            "cast(user_id as string) run_id", "event_id line_no",
            "case event_type "
            "when 'signup' then concat('INFO [workflow w', event_id % 3, '] start') "
            "when 'purchase' then 'INFO [workflow ] completed success' "
            "when 'view' then concat('INFO [step s', event_id % 7, '] start') "
            "when 'click' then concat('INFO [step s', event_id % 7, '] completed success') "
            "else concat('  error: exit ', event_id % 5) end line",
        )


# The same shapes as SQL, for the twin queries.
VIEWS = {
    "submissions": """select cast(c_custkey as varchar) id, concat('/out/', c_name) output_dir,
      lower(c_mktsegment) engine, c_name author from customer""",
    "runs": """select cast(o_orderkey as varchar) id, cast(o_custkey as varchar) submission_id,
      o_orderpriority as name, o_orderdate start,
      case o_orderstatus when 'F' then 'completed' when 'O' then 'running' else 'queued' end status from orders""",
    "jobs": """select concat('step', l_linenumber, case when attempt > 1 then concat('_attempt-', attempt) else '' end) id,
      cast(l_orderkey as varchar) run_id, cast(o_custkey as varchar) submission_id,
      case when attempt > 1 then concat('step', l_linenumber) when l_linenumber > 1 then 'step1' end parent,
      concat('step', l_linenumber) as name, cast(l_suppkey % 4 as int) shard, cast(attempt as int) attempt,
      case when l_returnflag = 'R' then 'failed' when l_returnflag = 'A' then 'aborted'
           when l_linestatus = 'F' then 'completed' else 'running' end status,
      l_shipdate start,
      case when not (l_returnflag = 'N' and l_linestatus = 'O')
           then l_shipdate + cast(l_quantity as int) * interval '1' hour end finish,
      concat('quay.io/bio/', 'tool', l_partkey % 50, ':1.', l_partkey % 7) container
      from (select lineitem.*, row_number() over (partition by l_orderkey, l_linenumber
        order by l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax,
        l_returnflag, l_linestatus) attempt from lineitem) l
      join orders on l_orderkey = o_orderkey""",
    "raw_jobs": """select concat('step', l_linenumber) id, cast(l_orderkey as varchar) run_id,
      cast(o_custkey as varchar) submission_id, case when l_linenumber > 1 then 'step1' end parent,
      concat('step', l_linenumber) as name, cast(l_suppkey % 4 as int) shard,
      case when l_returnflag = 'R' then 'failed' when l_returnflag = 'A' then 'aborted'
           when l_linestatus = 'F' then 'completed' else 'running' end status,
      l_shipdate start,
      case when not (l_returnflag = 'N' and l_linestatus = 'O')
           then l_shipdate + cast(l_quantity as int) * interval '1' hour end finish,
      concat('quay.io/bio/', 'tool', l_partkey % 50, ':1.', l_partkey % 7) container,
      l_partkey, l_suppkey, l_extendedprice
      from lineitem join orders on l_orderkey = o_orderkey""",
    "runstatus": """select cast(user_id as varchar) run_id, event_id seq, ts as date,
      case event_type when 'signup' then 'queued' when 'view' then 'processing'
           when 'click' then 'running' when 'purchase' then 'completed' else 'failed' end status from events""",
    "paths": """select cast(page_id as varchar) id,
      split_part(split_part(url, '#', 1), '?', 1) path, cast(length(html) as bigint) size from pages""",
    "manifest": """select cast(l_orderkey as varchar) manifest_id, l_linenumber layer,
      concat('p', l_partkey % 5) as name, cast(l_suppkey as varchar) as value, l_partkey, l_suppkey, l_shipdate
      from lineitem""",
    "kv": """select cast(o_custkey as varchar) submission_id, cast(o_orderkey as varchar) run_id, key, value
      from (select *, unnest(['status', 'name', 'day']) as key,
            unnest([o_orderstatus, nullif(o_orderpriority, '5-LOW'), cast(cast(o_orderdate as date) as varchar)]) as value
            from orders) where value is not null""",
    "contigs": "select cast(l_orderkey as varchar) input, concat('chr', l_partkey % 30) contig from lineitem",
    "document_lines": """select run_id, cast(line_no as bigint) line_no, rtrim(line, chr(9) || chr(11) || chr(12) || chr(13) || ' ') line
      from (select cast(doc_id as varchar) run_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 line_no,
                   unnest(string_split(text, chr(10))) line from documents)
      where rtrim(line, chr(9) || chr(11) || chr(12) || chr(13) || ' ') <> ''""",
    "event_lines": """select cast(user_id as varchar) run_id, event_id line_no,
      case event_type
      when 'signup' then concat('INFO [workflow w', event_id % 3, '] start')
      when 'purchase' then 'INFO [workflow ] completed success'
      when 'view' then concat('INFO [step s', event_id % 7, '] start')
      when 'click' then concat('INFO [step s', event_id % 7, '] completed success')
      else concat('  error: exit ', event_id % 5) end line from events""",
}


def twin(views: str, body: str) -> str:
    """SQL of a twin query: the named views (prefixed `v_`) as CTEs, then the body."""
    ctes = ", ".join(f"v_{v} as ({VIEWS[v]})" for v in views.split())
    if not ctes:
        return body
    lead = body.lstrip()
    if lead.lower().startswith("with recursive"):
        return f"with recursive {ctes}, {lead[len('with recursive'):]}"
    if lead.lower().startswith("with "):
        return f"with {ctes}, {lead[len('with '):]}"
    return f"with {ctes} {body}"

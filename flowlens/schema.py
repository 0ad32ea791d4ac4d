"""Table specifications and the small fixed dimension tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class TableSpec:
    """A store table: its columns (DDL), its keys and its JSON-encoded columns."""

    name: str
    ddl: str
    keys: tuple[str, ...]
    json_cols: tuple[str, ...] = field(default=())

    @property
    def columns(self) -> list[str]:
        return [part.split()[0] for part in split_ddl(self.ddl)]


def split_ddl(ddl: str) -> list[str]:
    parts, depth, cur = [], 0, ""
    for ch in ddl:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            parts.append(cur.strip())
            cur = ""
        else:
            cur += ch
    parts.append(cur.strip())
    return [p for p in parts if p]


SPECS: dict[str, TableSpec] = {
    s.name: s
    for s in (
        TableSpec(
            "tasks",
            "id STRING, output_dir STRING, execution_dir STRING, timestamp TIMESTAMP",
            ("id",),
        ),
        TableSpec(
            "submissions",
            "id STRING, output_dir STRING, exec_dir STRING, author STRING, tags ARRAY<STRING>, "
            "labels ARRAY<STRING>, timestamp TIMESTAMP, engine STRING",
            ("id",),
            ("tags", "labels"),
        ),
        TableSpec(
            "runs",
            "id STRING, submission_id STRING, engine_id STRING, execution_dir STRING, status STRING, "
            "error STRING, labels ARRAY<STRING>, tags ARRAY<STRING>, last_updated TIMESTAMP, name STRING",
            ("id", "submission_id"),
            ("tags", "labels"),
        ),
        TableSpec(
            "runstatus",
            "submission_id STRING, run_id STRING, status STRING, date TIMESTAMP",
            ("submission_id", "run_id", "status"),
        ),
        TableSpec(
            "jobs",
            "id STRING, submission_id STRING, run_id STRING, parent STRING, name STRING, shard INT, "
            "attempt INT, batchid STRING, container STRING, status STRING, start TIMESTAMP, "
            "finish TIMESTAMP, backend STRING, cached BOOLEAN, stdout STRING, stderr STRING, "
            "script STRING, error STRING, returncode STRING, lastupdated TIMESTAMP, workdir STRING, "
            "memory STRING, cpu STRING, analysis STRING",
            ("id", "submission_id", "run_id"),
        ),
        TableSpec(
            "inputs",
            "id STRING, submission_id STRING, run_id STRING, value VARIANT, size BIGINT",
            ("id", "submission_id", "run_id"),
            ("value",),
        ),
        TableSpec(
            "outputs",
            "id STRING, submission_id STRING, run_id STRING, output_name VARIANT, "
            "output_folder ARRAY<STRING>, secondaries ARRAY<STRING>, extension STRING, "
            "is_copyable BOOLEAN, original_path STRING, new_path STRING, timestamp TIMESTAMP, "
            "value VARIANT",
            ("id", "submission_id", "run_id"),
            ("output_name", "output_folder", "secondaries", "value"),
        ),
        TableSpec(
            "joblabels",
            "submission_id STRING, run_id STRING, job_id STRING, labels ARRAY<STRING>",
            ("submission_id", "run_id", "job_id"),
            ("labels",),
        ),
        TableSpec(
            "progress",
            "submission_id STRING, key STRING, timestamp TIMESTAMP",
            ("submission_id", "key"),
        ),
        TableSpec(
            "submission_metadata",
            "submission_id STRING, run_id STRING, key STRING, value STRING",
            ("submission_id", "run_id", "key"),
            ("value",),
        ),
    )
}

#: Run id used when a submission has a single run.
DEFAULT_RUN_ID = "<default>"

# The twelve task statuses and what is known about each.
# status, label, symbol, is_final, notifies, exit_code, color
STATUS_ROWS = [
    ("processing", "Processing", "...", False, False, 0, None),
    ("prepared", "Prepared", ":", False, False, 0, None),
    ("queued", "Queued", " ", False, True, 0, None),
    ("running", "Running", "~", False, True, 0, None),
    ("execution-ended", "Ended execution successfully (finalizing)", "%%", False, False, 0, None),
    ("completed", "Completed", "✓", True, True, 0, None),
    ("failed", "Failed", "!", True, True, 3, "#a63030"),
    ("aborting", "Aborting", "~x", False, False, 3, None),
    ("aborted", "Terminated", "T", True, True, 3, None),
    ("dry-run", "Dry run", "DR", True, False, 0, None),
    ("on-hold", "On hold", "?", False, True, 0, None),
    ("suspended", "Suspended", "II", True, True, 3, None),
]

# Words used by the two engines and the status each stands for.
# The document engine is compared in lower case, the webhook engine exactly.
# ("fail" stands for processing, as the engine emits it before a retry.)
ENGINE_STATUS_ROWS = [
    ("document", "fail", "processing"),
    ("document", "starting", "processing"),
    ("document", "submitted", "queued"),
    ("document", "queuedincromwell", "queued"),
    ("document", "running", "running"),
    ("document", "succeeded", "completed"),
    ("document", "done", "completed"),
    ("document", "failed", "failed"),
    ("document", "aborting", "aborting"),
    ("document", "aborted", "aborted"),
    ("webhook", "COMPLETED", "completed"),
    ("webhook", "RUNNING", "running"),
    ("webhook", "SUBMITTED", "queued"),
    ("webhook", "FAILED", "failed"),
]

# The nine progress milestones.
PROGRESS_KEYS = [
    "start",
    "createOutputStructure",
    "saveWorkflow",
    "submitWorkflow",
    "workflowMovedToFinalState",
    "copiedOutputs",
    "savedMetadata",
    "savedLogs",
    "cleanedUp",
]

FINAL_STATUSES = [r[0] for r in STATUS_ROWS if r[3]]
NOTIFY_STATUSES = [r[0] for r in STATUS_ROWS if r[4]]
#: Statuses that make a collapsed group count as running.
UNFINISHED_STATUSES = ["running", "prepared", "queued", "processing"]


def _values(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """Inline table: a local relation, so the planner knows its (constant) size."""

    def lit(v: object) -> str:
        if v is None:
            return "cast(null as string)"
        if isinstance(v, bool):
            return str(v).lower()
        return repr(v) if isinstance(v, int) else "'" + v.replace("'", "\\'") + "'"

    body = ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)
    return spark.sql(f"select * from values {body} as t({columns})")


def status_dim(spark: SparkSession) -> DataFrame:
    return _values(
        spark, STATUS_ROWS, "status, label, symbol, is_final, notifies, exit_code, color"
    )


def engine_status_dim(spark: SparkSession) -> DataFrame:
    return _values(spark, ENGINE_STATUS_ROWS, "engine, word, status")

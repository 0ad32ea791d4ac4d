"""Status predicates, engine-word mapping and the status collapse aggregate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowlens.schema import (
    ENGINE_STATUS_ROWS,
    FINAL_STATUSES,
    NOTIFY_STATUSES,
    UNFINISHED_STATUSES,
)


def is_final(status: Column) -> Column:
    return status.isin(FINAL_STATUSES)


def notifies(status: Column) -> Column:
    return status.isin(NOTIFY_STATUSES)


def exit_code(status: Column) -> Column:
    return F.when(status.isin("failed", "aborted", "aborting", "suspended"), 3).otherwise(0)


def collapse(status: Column, ord: Column) -> Column:
    """Aggregate: one status for a group of statuses; `ord` settles the first-status fallback.

    Only `bool_or`/`bool_and`/`count`/`min_by`, so it combines map-side.
    """
    known = F.when(status.isNotNull(), ord)
    return (
        F.when(F.count(status) == 0, "processing")
        .when(F.bool_or(status.isin(UNFINISHED_STATUSES)), "running")
        .when(F.bool_or(status == "aborting"), "aborting")
        .when(F.bool_or(status == "aborted"), "aborted")
        .when(F.bool_or(status == "failed"), "failed")
        .when(F.bool_and(status == "completed"), "completed")
        .otherwise(F.min_by(status, known))
    )


def from_engine_word(engine: str, word: Column) -> Column:
    """Status for an engine's own word; the mapping is a constant expression."""
    pairs = [(w, s) for e, w, s in ENGINE_STATUS_ROWS if e == engine]
    key = F.lower(word) if engine == "document" else word
    out = None
    for w, s in pairs:
        out = F.when(key == w, s) if out is None else out.when(key == w, s)
    if engine == "document":
        return F.when(word.isNull(), "processing").otherwise(out.otherwise("failed"))
    return out.otherwise("queued")


def cached_process_status(errored: Column) -> Column:
    """A cached process is complete only when it is explicitly not errored."""
    return F.when(errored == F.lit(False), "completed").otherwise("failed")


def execution_ended(status: Column) -> Column:
    """The engine's own completion is only the end of execution; outputs are still to be placed."""
    return F.when(status == "completed", "execution-ended").otherwise(status)

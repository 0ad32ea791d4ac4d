"""Workflow scopes of a log as stack effects: what a stretch of lines pops and pushes, found with array operations.

An effect is (kept, pushed): how many of the scopes open before the stretch are still open, and the
scopes opened on top of them. Effects compose, so a stretch is reduced before the open scopes change.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

HELD = "line_no long, date timestamp, component string, step string, action string"
EVENTS = "run_id string, line_no long, id string, parent string, name string, status string"
ORDER = ["line_no", "date", "component", "step", "action"]


def stretch(rows: pd.DataFrame, before: list[str]) -> tuple[pd.DataFrame, int, list[str]]:
    """Events of sorted step lines under the open scopes `before` (full texts), and the stretch's effect.

    A workflow start with a name pushes it, a workflow completion pops one scope if any is open and is
    an event under what is left; other starts and completions are events under the latest scope.
    """
    done = (rows["action"] == "completed success").to_numpy()
    rows, done = rows[done | (rows["action"] == "start").to_numpy()], done[done | (rows["action"] == "start").to_numpy()]
    workflow, name = (rows["component"] == "workflow").to_numpy(), rows["step"].fillna("").to_numpy(object)
    named = name != ""
    push = workflow & ~done & named
    emits = named & ~(workflow & ~done)
    total = len(before) + np.cumsum(np.where(push, 1, np.where(workflow & done, -1, 0)))
    depth = total - np.minimum.accumulate(np.minimum(total, 0)) if len(rows) else total
    n = len(rows) + 1
    opened = np.flatnonzero(push)
    opened = opened[np.argsort(depth[opened], kind="stable")]
    marks = depth[opened] * n + opened  # by level, in it by line

    def above(level: np.ndarray, line: np.ndarray) -> np.ndarray:
        """The line that last opened the given level, -1 where it was open before the stretch."""
        at = np.searchsorted(marks, level * n + line, "right") - 1
        here = (at >= 0) & (level > 0)
        here[here] = depth[opened[at[here]]] == level[here]
        return np.where(here, opened[np.maximum(at, 0)] if len(opened) else -1, -1)

    def text(level: int, line: int) -> str | None:
        return scopes[line] if line >= 0 else before[level - 1] if level > 0 else None

    scopes: dict[int, str] = {}
    pushes = np.flatnonzero(push)
    for line, level, up in zip(pushes, depth[pushes] - 1, above(depth[pushes] - 1, pushes), strict=True):
        parent = text(level, up)
        scopes[line] = f"{parent}_{name[line]}" if parent else name[line]
    out = np.flatnonzero(emits)
    parents = [text(level, up) for level, up in zip(depth[out], above(depth[out], out), strict=True)]
    events = pd.DataFrame({
        "line_no": rows["line_no"].to_numpy()[out], "id": [f"{p}_{s}" if p else s for p, s in zip(parents, name[out], strict=True)],
        "parent": parents, "name": name[out], "status": np.where(done[out], "completed", "running"),
    })
    end = int(depth[-1]) if len(rows) else len(before)
    levels = np.arange(1, end + 1)
    last = above(levels, np.full(end, n - 1))
    kept = int((last < 0).sum())
    return events, kept, [scopes[line] for line in last[kept:]]


class Scopes(StatefulProcessor):
    """Per run: lines whose time the watermark has not passed, and the open scopes, both as list state.

    Lines are released in line order once the watermark passed them, so how they are split over
    micro-batches, or shuffled within the lateness, changes nothing. An effect that pops nothing only
    appends. A run without open scopes and held lines leaves no state.
    """

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", HELD)
        self.open = handle.getListState("open", "scope string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = None
        for pdf in rows:
            if len(pdf):
                self.held.appendList(list(pdf[ORDER].astype(object).where(pdf[ORDER].notna(), None).itertuples(index=False, name=None)))
                top = pdf["date"].max()
                last = top if last is None or top > last else last
        if last is not None:
            self.handle.registerTimer(max(last.value // 1_000_000 + 1, timerValues.getCurrentWatermarkInMs() + 1))
        yield from self._release(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._release(key, timerValues.getCurrentWatermarkInMs())

    def _release(self, key, watermark: int) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame(list(self.held.get()), columns=ORDER)
        if held.empty:
            return
        held = held.sort_values("line_no", kind="stable", ignore_index=True)
        waits = (pd.to_datetime(held["date"]).astype("datetime64[ms]").astype("int64") >= watermark).to_numpy()
        free = int(np.argmax(waits)) if waits.any() else len(held)
        if not free:
            return
        rest = held.iloc[free:]
        if len(rest):
            self.held.put(list(rest.itertuples(index=False, name=None)))
        else:
            self.held.clear()
        before = [r[0] for r in self.open.get()]
        events, kept, pushed = stretch(held.iloc[:free], before)
        if kept == len(before):
            if pushed:
                self.open.appendList([(s,) for s in pushed])
        elif kept or pushed:
            self.open.put([(s,) for s in before[:kept] + pushed])
        else:
            self.open.clear()
        if len(events):
            events.insert(0, "run_id", key[0])
            yield events

    def close(self) -> None:
        pass

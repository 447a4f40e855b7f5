"""Keeping an index up to date from a stream of changes.

Changes of a path wait until it has been quiet for the debounce time; then all paths that are due are applied in one
version. The clock is that of arrival, as it is for a person who saves a file several times.
"""

from __future__ import annotations

import os
import time
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from terrane.engine import Engine

DEBOUNCE_MS, ATTEMPTS = 100, 3
#: Of what the watcher remembers for its report the last so many are kept.
LAST = 10_000


def debounced_paths(changes: DataFrame, debounce_ms: int = DEBOUNCE_MS) -> DataFrame:
    """``path, event, first_ms``: a row for each path once it has been quiet; each change starts the wait again.

    State is kept per path between its first change and its row, and no longer.
    """

    def settle(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            event, first = state.get
            state.remove()
            yield pd.DataFrame({"path": [key[0]], "event": [event], "first_ms": [first]})
            return
        events = [e for frame in frames for e in frame["event"]]
        first = state.get[1] if state.exists else int(time.time() * 1000)
        state.update((events[-1], first))
        state.setTimeoutDuration(debounce_ms)
        yield pd.DataFrame({"path": [], "event": [], "first_ms": []})

    return changes.select("path", "event").groupBy("path").applyInPandasWithState(
        settle, "path string, event string, first_ms long", "event string, first_ms long", "append", GroupStateTimeout.ProcessingTimeTimeout
    )


class Watcher:
    """Follows a folder: the scan first, then every change. Changes during the scan are not lost, as the stream's first
    listing reports all that is there."""

    def __init__(self, engine: Engine, root: str, checkpoint: str, debounce_ms: int = DEBOUNCE_MS) -> None:
        self.engine, self.root, self.checkpoint, self.debounce_ms = engine, os.path.abspath(root), checkpoint, debounce_ms
        self.attempts: dict[str, int] = {}
        self.dropped: deque[str] = deque(maxlen=LAST)
        self.dropped_count = 0
        self.applied = 0
        self.freshness_ms: deque[float] = deque(maxlen=LAST)
        self.query = None

    def start(self) -> None:
        self.engine.scan(self.root, skip_unchanged=True)
        options = self.engine.options
        source = self.engine.spark.readStream.format("tree_changes").option("root", self.root).option("all_files", str(options.all_files)).option("database", self.engine.path)
        changes = source.option("include", ",".join(options.include)).option("exclude", ",".join(options.exclude)).load()
        tick = max(25, self.debounce_ms // 2)
        out = debounced_paths(changes, self.debounce_ms).writeStream.foreachBatch(self._apply).option("checkpointLocation", self.checkpoint)
        self.query = out.trigger(processingTime=f"{tick} milliseconds").start()

    def _apply(self, batch: DataFrame, number: int) -> None:
        """All paths that are due in one version. What fails is tried again with the next batch, up to three times."""
        rows = {r["path"]: r["first_ms"] for r in batch.collect()}  # paths that changed within one tick
        due = [*rows, *(p for p in self.attempts if p not in rows)]
        due = self._differing(due)
        if not due:
            return
        try:
            self.engine.sync(due, self.root)
        except Exception:
            for p in due:
                self.attempts[p] = self.attempts.get(p, 0) + 1
                if self.attempts[p] >= ATTEMPTS:
                    del self.attempts[p]
                    self.dropped.append(p)
                    self.dropped_count += 1
            return
        for p in due:
            self.attempts.pop(p, None)
        self.applied += len(due)
        now = time.time() * 1000
        self.freshness_ms.extend(now - f for f in rows.values())

    def _differing(self, paths: list[str]) -> list[str]:
        """The paths of which the index holds another state than the file system; one query for all of them."""
        if not paths:
            return []
        given = self.engine.spark.createDataFrame([(p,) for p in paths], "path string")
        rows = given.join(self.engine.table("files").select("path", "size", "mtime_ns"), "path")
        known = {r["path"]: (r["size"], r["mtime_ns"]) for r in rows.collect()}  # of these paths only
        return [p for p in paths if self._differs(p, known.get(p))]

    @staticmethod
    def _differs(path: str, known: tuple[int, int] | None) -> bool:
        try:
            s = os.lstat(path)
        except OSError:
            return known is not None
        if os.path.isdir(path) and not os.path.islink(path):
            return known is None
        return known != (s.st_size, s.st_mtime_ns)

    def stop(self) -> None:
        if self.query is not None:
            self.query.stop()

"""Timers and counters of stages: a long table (name, seq, seconds, rows, bytes) that the tracker's statistics run on.

Rows and bytes are counted where they pass by, as observed metrics of the action itself, so a stage runs once. Methods
are wrapped in place; wrapping again changes nothing, and a wrapped method that calls another wrapped one of the same
name is counted once, from outside.
"""

from __future__ import annotations

import functools
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SCHEMA = "name string, seq long, seconds double, rows long, bytes long"


class Tracker:
    """Records are on the driver: one for each call, not for each row."""

    def __init__(self, clock: Callable[[], float] = time.perf_counter):
        self.records: list[tuple] = []
        self.open: set[str] = set()
        self.clock = clock

    def _add(self, name: str, seconds: float, rows: int | None = None, size: int | None = None) -> None:
        self.records.append((name, sum(r[0] == name for r in self.records), seconds, rows, size))

    def run(self, name: str, df: DataFrame, action: Callable[[DataFrame], object], size_of: str | None = None):
        """The action's result on df, with its time, its rows and, if a text column is named, that column's bytes."""
        seen = Observation()
        size = F.coalesce(F.sum(F.octet_length(size_of)), F.lit(0)) if size_of else F.lit(0)
        watched = df.observe(seen, F.count(F.lit(1)).alias("rows"), size.cast("long").alias("bytes"))
        begun = self.clock()
        out = action(watched)
        self._add(name, self.clock() - begun, seen.get["rows"], seen.get["bytes"] if size_of else None)
        return out

    def wrap(self, owner: object, method: str, name: str | None = None) -> None:
        """Times every call of owner.method, also those that raise."""
        held = getattr(owner, method)
        if getattr(held, "_tracked_by", None) is self:
            return
        label = name or method

        @functools.wraps(held)
        def timed(*args, **kwargs):
            if label in self.open:
                return held(*args, **kwargs)
            self.open.add(label)
            begun = self.clock()
            try:
                return held(*args, **kwargs)
            finally:
                self.open.discard(label)
                self._add(label, self.clock() - begun)

        timed._tracked_by = self
        timed._held = held
        setattr(owner, method, timed)

    def unwrap(self, owner: object, method: str) -> None:
        held = getattr(owner, method)
        if getattr(held, "_tracked_by", None) is self:
            setattr(owner, method, held._held)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.records, SCHEMA)

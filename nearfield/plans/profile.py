"""Named timers of driver-side steps, nested as their scopes are. What executors do is in Spark's own metrics."""

from __future__ import annotations

import contextlib
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


class Profiler:
    def __init__(self) -> None:
        self.seconds: dict[tuple[str, ...], float] = {}
        self.calls: dict[tuple[str, ...], int] = {}
        self._open: tuple[str, ...] = ()

    @contextlib.contextmanager
    def scope(self, name: str) -> Iterator[None]:
        """Time a block; times under one path of names add up, also where a block fails."""
        outer, self._open = self._open, (*self._open, name)
        path, start = self._open, time.perf_counter()
        self.calls[path] = self.calls.get(path, 0) + 1
        self.seconds.setdefault(path, 0.0)
        try:
            yield
        finally:
            self.seconds[path] += time.perf_counter() - start
            self._open = outer

    def flat(self) -> dict[str, tuple[int, float]]:
        """name: (calls, seconds), wherever it was called from; a scope within one of its own name counts once."""
        out: dict[str, tuple[int, float]] = {}
        for path, calls in self.calls.items():
            n, seconds = out.get(path[-1], (0, 0.0))
            out[path[-1]] = n + calls, seconds + (0.0 if path[-1] in path[:-1] else self.seconds[path])
        return out

    def tree(self) -> str:
        """One line a path, inner ones indented below the outer."""
        return "\n".join(f"{'  ' * (len(p) - 1)}{p[-1]}: {self.seconds[p]:.3f} s, {self.calls[p]} calls" for p in self.calls)

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [("/".join(p), self.calls[p], self.seconds[p]) for p in self.calls]
        return spark.createDataFrame(rows, "path string, calls long, seconds double")

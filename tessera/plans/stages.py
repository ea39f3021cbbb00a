"""Named steps from table to table, with their settings."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame


@dataclass
class Step:
    name: str
    run: Callable[..., DataFrame]
    settings: dict = field(default_factory=dict)


@dataclass
class Plan:
    """Steps in order; `store` keeps each step's table under a folder, so a later run can begin there."""

    steps: list[Step]

    def apply(self, df: DataFrame, settings: dict[str, dict] | None = None, store: str | None = None, cached: bool = False) -> DataFrame:
        """settings: by step name, over the steps' own. cached: tables that are stored already are read, not made."""
        unknown = set(settings or {}) - {s.name for s in self.steps}
        if unknown:
            raise KeyError(f"settings for steps that are not there: {sorted(unknown)}")
        spark = df.sparkSession
        for step in self.steps:
            place = f"{store}/{step.name}" if store else None
            if place and cached:
                try:
                    df = spark.read.parquet(place)
                    continue
                except Exception as error:
                    if "PATH_NOT_FOUND" not in str(error):
                        raise
            df = step.run(df, **(step.settings | (settings or {}).get(step.name, {})))
            if place:
                df.write.mode("overwrite").parquet(place)
                df = spark.read.parquet(place)
        return df


@dataclass
class Retry:
    """Calls again what fails, so many times and with a pause; at last the fallback, or the error.

    A call that takes longer than `seconds` counts as failed; `at_once` calls run side by side in one task.
    """

    attempts: int = 3
    pause: float = 0.0
    seconds: float | None = None
    at_once: int = 3
    fallback: Callable | None = None

    def call(self, fn: Callable, *args):
        error: Exception | None = None
        for k in range(self.attempts):
            if k:
                time.sleep(self.pause)
            try:
                return self._timed(fn, *args)
            except Exception as failed:  # noqa: BLE001
                error = failed
        if self.fallback:
            return self.fallback(*args)
        raise error

    def _timed(self, fn: Callable, *args):
        if self.seconds is None:
            return fn(*args)
        pool = ThreadPoolExecutor(1)
        try:
            return pool.submit(fn, *args).result(self.seconds)
        finally:
            pool.shutdown(wait=False, cancel_futures=True)

    def over(self, df: DataFrame, column: str, fn: Callable[[str], str | None]) -> DataFrame:
        """df with result and error, of a function of one column from outside (a fetch, a model); rows do not fail the job."""

        def one(value):
            try:
                return self.call(fn, value), None
            except Exception as failed:  # noqa: BLE001
                return None, f"{type(failed).__name__}: {failed}"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            with ThreadPoolExecutor(self.at_once) as pool:
                for b in batches:
                    out = list(pool.map(one, b.column(column).to_pylist()))
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array([r for r, _ in out], pa.string()), pa.array([e for _, e in out], pa.string())], [*b.schema.names, "result", "error"])

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        return df.mapInArrow(run, f"{fields}, result string, error string")

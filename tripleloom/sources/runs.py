"""Run folders: one Parquet table for each finished step, and metadata."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Runs:
    """Steps of numbered runs under ``base``; a fresh run is one above the highest, a resumed one continues it."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def existing(self) -> list[int]:
        fs, at = self._fs(self.base)
        if not fs.exists(at):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        return sorted(int(n.removeprefix("run_")) for n in names if n.startswith("run_") and n.removeprefix("run_").isdigit())

    def start(self, resume: bool = False) -> int:
        known = self.existing()
        return (known[-1] if known else 1) if resume else (known[-1] if known else 0) + 1

    def path(self, run: int, step: str) -> str:
        return f"{self.base}/run_{run}/{step}"

    def has(self, run: int, step: str) -> bool:
        fs, at = self._fs(f"{self.path(run, step)}/_SUCCESS")
        return fs.exists(at)

    def save(self, run: int, step: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(run, step))
        return self.load(run, step)

    def load(self, run: int, step: str) -> DataFrame:
        return self.spark.read.parquet(self.path(run, step))

    def step(self, run: int, step: str, make) -> DataFrame:
        """The step's table, made only where it is not there yet."""
        return self.load(run, step) if self.has(run, step) else self.save(run, step, make())

    def save_metadata(self, run: int, metadata: dict) -> None:
        text = json.dumps(metadata, sort_keys=True, default=str, allow_nan=False)
        self.spark.range(1).select(F.lit(text).alias("value")).coalesce(1).write.mode("overwrite").text(self.path(run, "run_metadata"))

    def metadata(self, run: int) -> dict:
        return json.loads("\n".join(r[0] for r in self.spark.read.text(self.path(run, "run_metadata")).collect()))

    def copy_with(self, run: int, changed: dict[str, DataFrame], steps: list[str]) -> int:
        """A new run with some steps changed and the others as they were."""
        new = self.start()
        for step in steps:
            self.save(new, step, changed.get(step) if step in changed else self.load(run, step))
        return new

    def overview(self, steps: list[str]) -> DataFrame:
        """(run, step, n): rows of each finished step of each run, null where a run has no such step."""
        out = self.spark.createDataFrame([], "run int, step string, n long")
        for run in self.existing():
            for step in steps:
                n = self.load(run, step).agg(F.count("*").alias("n")) if self.has(run, step) else self.spark.range(1).select(F.lit(None).cast("long").alias("n"))
                out = out.unionAll(n.select(F.lit(run).alias("run"), F.lit(step).alias("step"), "n"))
        return out

"""Metrics of stages, collected while they run: no stage is counted by a second job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

METRICS = "stage string, n_rows long, n_nulls long, n_chars long"


def measures(column: str) -> list[Column]:
    """Rows, nulls and characters of a column."""
    text = F.col(column).cast("string")
    return [F.count(F.lit(1)).alias("n_rows"), F.count(F.when(text.isNull(), 1)).alias("n_nulls"), F.coalesce(F.sum(F.length(text).cast("long")), F.lit(0)).cast("long").alias("n_chars")]


class Stages:
    """Stages of a batch job, marked where they pass; their metrics are known when the job has run once. A job that runs again isn't counted again."""

    def __init__(self):
        self.seen: dict[str, Observation] = {}

    def mark(self, df: DataFrame, stage: str, column: str) -> DataFrame:
        if stage in self.seen:
            raise ValueError(f"stage {stage} is marked already")
        self.seen[stage] = Observation(stage)
        return df.observe(self.seen[stage], *measures(column))

    def rows(self, spark: SparkSession) -> DataFrame:
        """A row of metrics for each stage. Waits for a job that hasn't run."""
        return spark.createDataFrame([(s, o.get["n_rows"], o.get["n_nulls"], o.get["n_chars"]) for s, o in self.seen.items()], METRICS)


class Progress(StreamingQueryListener):
    """Metrics of a stream's stages, batch by batch: (query, batch, stage, metrics), and the milliseconds that a batch took."""

    def __init__(self):
        self.batches: list[tuple[str, int, str, dict]] = []
        self.took: list[tuple[str, int, int]] = []
        self.ended: list[str] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.took.append((str(p.runId), p.batchId, p.durationMs.get("triggerExecution", 0)))
        for stage, row in p.observedMetrics.items():
            self.batches.append((str(p.runId), p.batchId, stage, row.asDict()))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.append(str(event.runId))

"""Scoring a stream: cleaning replay and model scoring are stateless projections, so the
batch code runs on a streaming frame as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from colonnade.plans.cleaning import CleaningPlan
from colonnade.plans.training import TrainingRun


def score_stream(stream: DataFrame, run: TrainingRun, out: str, checkpoint: str, cleaning: CleaningPlan | None = None, available_now: bool = False) -> StreamingQuery:
    """Append scored rows of every (fold, model) to parquet, exactly once per input row."""
    cleaned = cleaning.transform(stream) if cleaning else stream
    writer = run.score(cleaned).writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(out)

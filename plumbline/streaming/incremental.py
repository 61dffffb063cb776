"""Metrics of a stream: each micro-batch's states are merged into those kept so far."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from plumbline.operators.base import Analyzer
from plumbline.operators.states import FileStateProvider
from plumbline.plans.runner import AnalyzerContext, run_analysis
from plumbline.sources.files import delete, read_text, write_text


def track_stream(stream: DataFrame, analyzers: Iterable[Analyzer], state_path: str, on_metrics: Callable[[int, AnalyzerContext], None] | None = None, checkpoint: str | None = None, **trigger) -> StreamingQuery:
    """Start a query whose every micro-batch updates the metrics of all rows seen.

    A batch's states go to a folder of its own, merged from those of the batch before, and only then is the
    batch recorded: a batch that is run again after a failure starts from the same earlier states.
    """
    analyzers = list(analyzers)

    def update(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = read_text(spark, f"{state_path}/last.txt")
        before = None if last is None or int(last) >= number else FileStateProvider(spark, f"{state_path}/{last}")
        if last is not None and int(last) >= number:
            previous = number - 1
            before = FileStateProvider(spark, f"{state_path}/{previous}") if previous >= 0 else None
        batch.persist()
        try:
            context = run_analysis(batch, analyzers, before, FileStateProvider(spark, f"{state_path}/{number}"))
        finally:
            batch.unpersist()
        write_text(spark, f"{state_path}/last.txt", str(number), True)
        delete(spark, f"{state_path}/{number - 2}")
        if on_metrics is not None:
            on_metrics(number, context)

    writer = stream.writeStream.foreachBatch(update)
    if checkpoint is not None:
        writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()

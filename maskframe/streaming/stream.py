"""Masking of documents as they arrive: the batch transform on a stream, its rejects, and its progress."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..catalog import Catalog
from ..operators.mask import MaskOptions, guard, mask_documents

#: The names that :func:`observed` gives its counts, and the step that each is the outcome of.
STEPS = {"documents": "read", "spans_found": "detect", "spans_kept": "merge", "spans_masked": "mask"}
PROGRESS = "batch_id long, step string, n_in long, n_out long, n_dropped long"


def _counts() -> list:
    return [F.count("*").alias("documents"), F.sum(F.col("stats.spans_pattern") + F.col("stats.spans_ner") + F.col("stats.spans_llm")).alias("spans_found"), F.sum(F.size("detected_spans")).alias("spans_kept"), F.sum(F.size("masked_spans")).alias("spans_masked")]


def observed(df: DataFrame, name: str | Observation = "masking") -> DataFrame:
    """``df`` with counts that listeners (or an Observation) can read for every batch: documents, spans found, kept and masked. No values among them."""
    return df.observe(name, *_counts())


def step_rows(counts: dict[str, int], batch_id: int = 0) -> list[tuple[int, str, int, int, int]]:
    """Observed counts as rows of :data:`PROGRESS`: what went into each step over spans, came out and was dropped."""
    names = [n for n in STEPS if n != "documents"]
    seen = {n: int(counts.get(n) or 0) for n in names}
    return [(batch_id, STEPS[b], seen[a], seen[b], seen[a] - seen[b]) for a, b in zip(names, names[1:], strict=False)]


def observed_steps(spark: SparkSession, seen: Observation) -> DataFrame:
    """The step counts of a batch job that ran over ``observed(df, seen)``, without a second job."""
    return spark.createDataFrame(step_rows(seen.get), PROGRESS)


class Progress(StreamingQueryListener):
    """Keeps the counts of each batch of the streams that it listens to, by the name given to :func:`observed`.

    ``most`` bounds what is kept on the driver, the batches heard of last; hand ``rows()`` to
    a table of your own from time to time where a stream runs on.
    """

    def __init__(self, name: str = "masking", most: int = 10_000) -> None:
        self.name, self.most = name, most
        self.batches: dict[tuple[str, int], dict[str, int]] = {}
        self.ended: dict[str, str | None] = {}
        self.changed = threading.Condition()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        got = event.progress.observedMetrics.get(self.name)
        if got is not None and got["documents"]:
            self.batches[str(event.progress.id), event.progress.batchId] = got.asDict()
            while len(self.batches) > self.most:
                del self.batches[next(iter(self.batches))]

    def onQueryTerminated(self, event) -> None:
        with self.changed:
            self.ended[str(event.id)] = event.exception
            self.changed.notify_all()

    def wait(self, query: StreamingQuery, seconds: float) -> bool:
        """Until the end of a stream was heard of, which comes later than the stream's own end; what it said of its batches has come by then."""
        with self.changed:
            return self.changed.wait_for(lambda: str(query.id) in self.ended, seconds)

    def rows(self, query: StreamingQuery | None = None) -> list[tuple[int, str, int, int, int]]:
        """Step counts by batch, of one stream or of all."""
        own = {k: v for k, v in self.batches.items() if query is None or k[0] == str(query.id)}
        return [r for k in sorted(own) for r in step_rows(own[k], k[1])]

    def table(self, spark: SparkSession, query: StreamingQuery | None = None) -> DataFrame:
        """Step counts, one row a batch and step."""
        return spark.createDataFrame(self.rows(query), PROGRESS)


def mask_stream(stream: DataFrame, catalog: Catalog, path: str, checkpoint: str, options: MaskOptions = MaskOptions(), sink: str = "parquet", once: bool = False) -> StreamingQuery:
    """Mask a stream of documents into files, exactly once by ``checkpoint``; ``once`` stops when the input is used up.

    The transform keeps no state, so nothing waits for late rows and no watermark is needed.
    """
    writer = observed(mask_documents(stream, catalog, options)).writeStream.format(sink).outputMode("append").option("checkpointLocation", checkpoint).option("path", path)
    return (writer.trigger(availableNow=True) if once else writer).start()


def write_batch(catalog: Catalog, path: str, options: MaskOptions = MaskOptions(), between: Callable[[int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """What :func:`mask_with_rejects` does with each batch: masked rows and rejects into a folder each, named by the batch.

    A batch that is done again after a failure replaces its own two folders, whatever of
    them was written before, so nothing is lost or doubled. The batch is read once and kept
    while both are written. ``between`` runs between the two writes.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        judged = guard(batch, options.text, options.max_chars).persist()
        try:
            bad = judged.where("reject_reason IS NOT NULL")
            bad.write.mode("overwrite").parquet(f"{path}/rejects/batch_id={batch_id}")
            if between is not None:
                between(batch_id)
            masked = mask_documents(judged.where("reject_reason IS NULL").drop("reject_reason"), catalog, options)
            masked.write.mode("overwrite").parquet(f"{path}/masked/batch_id={batch_id}")
        finally:
            judged.unpersist()

    return write


def mask_with_rejects(stream: DataFrame, catalog: Catalog, path: str, checkpoint: str, options: MaskOptions = MaskOptions(), once: bool = False, between: Callable[[int], None] | None = None) -> StreamingQuery:
    """Mask a stream into ``path``/masked and what the guard turns away, with the reason, into ``path``/rejects, from one read.

    Both have a column batch_id. Start it again with the same ``checkpoint`` after a failure.
    """
    writer = stream.writeStream.foreachBatch(write_batch(catalog, path, options, between)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def reject_stream(stream: DataFrame, path: str, checkpoint: str, options: MaskOptions = MaskOptions(), once: bool = False) -> StreamingQuery:
    """The documents that :func:`mask_stream` leaves out, with the reason; a stream of its own."""
    bad = guard(stream, options.text, options.max_chars).where("reject_reason IS NOT NULL")
    writer = bad.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", path)
    return (writer.trigger(availableNow=True) if once else writer).start()

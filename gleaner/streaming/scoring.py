"""Scores of arriving documents: each micro-batch is scored against a static model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import tokens
from ..operators import index, scoring


def score_stream(docs: DataFrame, model: DataFrame, sink: str, checkpoint: str, tokenize: Callable[[Column], Column] = tokens.words, threshold: float | None = None) -> StreamingQuery:
    """Appends (doc_id, score, epoch) of a stream of (doc_id, text) to Parquet at ``sink``.

    A document is whole within a batch, so its score needs no state and no watermark.  A batch that is run again
    after a failure writes under the same epoch folder and replaces it, so each document is written once.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        scored = scoring.by_scan(batch, index.term_frequencies(batch, tokenize), model)
        if threshold is not None:
            scored = scored.where(F.col("score") >= threshold)
        scored.write.mode("overwrite").parquet(f"{sink}/epoch={epoch}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()

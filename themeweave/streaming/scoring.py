from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from themeweave.plans.extractor import TopicModel


def score_stream(
    documents: DataFrame, model: TopicModel, write: Callable[[DataFrame, int], None]
) -> DataStreamWriter:
    """Hand ``write`` the scores ``<doc_id, scores>`` of every micro-batch of documents.

    A document's scores depend on that document and the fitted topics only, so no
    state is kept between batches. Start the returned writer as usual.
    """
    return documents.writeStream.foreachBatch(
        lambda batch, batch_id: write(model.topic_scores_nested(batch), batch_id)
    )

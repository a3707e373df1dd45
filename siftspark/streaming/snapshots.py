"""A catalogue kept up from a stream of observations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from siftspark.operators import catalog


def keep_up(observed: DataFrame, base: str, checkpoint: str, key: str, order: tuple[str, ...], then: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Merge every micro-batch of observed into the table published under base: the last row of each key wins.

    Merges are idempotent, so a batch that is run again changes nothing; one checkpoint admits one query. `then` is
    called after a batch is published, for follow-up work on it.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = catalog.current(spark, base)
        rows = batch if before is None else before.unionByName(batch)
        catalog.publish(catalog.latest(rows, key, order), base)
        if then:
            then(batch, number)

    return observed.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drained(query: StreamingQuery) -> None:
    query.awaitTermination()
    if query.exception():
        raise query.exception()

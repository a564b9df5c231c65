"""Streams of addresses: each micro-batch is resolved and written to the cache as one snapshot step."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators import cache as C
from ..settle import release


def convert_stream(requests: DataFrame, read_cache: Callable[[], DataFrame | None], write_cache: Callable[[DataFrame, int], None], write_items: Callable[[DataFrame, int], None], resolver: Callable[[DataFrame], DataFrame], checkpoint: str, embed=None):
    """Starts a query over a stream of (item, text).

    ``write_cache`` gets a batch's upserts and ``write_items`` its items, both with the batch number, so a batch
    that is run again overwrites what it wrote.
    """

    def each(batch: DataFrame, number: int) -> None:
        items, upserts = C.convert(batch, read_cache(), resolver, embed)
        write_items(items, number)
        write_cache(upserts, number)
        release(items)

    return requests.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()

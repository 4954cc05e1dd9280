"""Facts from streams: each micro-batch is loaded and the rules run on what is new.

The rules' semi-naive evaluation makes a batch cost what its new facts imply,
and inserting a fact again changes nothing, so a batch that is replayed after a
failure leaves the same database.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from koine.domain import Domain
from koine.functions.ids import MapId


def ingest(stream: DataFrame, domain: Domain, target: MapId, columns: list[str], value: str | None = None, iterations: int | None = None, then: Callable[[Domain, int], None] | None = None) -> DataStreamWriter:
    """A writer that feeds rows of ``stream`` into ``target`` and runs the rules:
    to saturation, or ``iterations`` times; ``then`` is called after each batch.
    Start it with the trigger and checkpoint of your choice."""

    def batch(rows: DataFrame, number: int) -> None:
        domain.database.load_facts(rows, target, columns, value, keys_later=False)
        if iterations is None:
            domain.saturate()
        else:
            domain.run_rules(iterations)
        if then:
            then(domain, number)

    return stream.writeStream.foreachBatch(batch)

"""Request limits: fixed windows that open with a key's first event."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivum.shipping import ship


def limited(events: DataFrame, key: str, at: str, most: int, window_ms: int) -> DataFrame:
    """Adds ``allowed``. A window opens with the first event of a key and ends
    ``window_ms`` later; the next event opens another. ``at`` is in
    milliseconds. Rows come in order a batch at a time, and only the open
    window of the last key is held, so a hot key needs no memory."""
    ship(events.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        owner, start, seen = None, None, 0
        for batch in batches:
            allowed = []
            for who, when in zip(batch[key], batch[at]):
                if owner != (who,) or when - start > window_ms:
                    owner, start, seen = (who,), when, 0
                seen += 1
                allowed.append(seen <= most)
            yield batch.assign(allowed=allowed)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema) + ", allowed boolean"
    return events.where(F.col(key).isNotNull() & F.col(at).isNotNull()).repartition(key).sortWithinPartitions(key, at).mapInPandas(run, schema)

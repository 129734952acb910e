"""Sequential folds over sorted series: rows stream through a state machine, so memory doesn't grow with a series."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame


def fold(rows: DataFrame, keys: Sequence[str], order: str, start: Callable[[tuple], Callable[[object], list[tuple]]], schema: str) -> DataFrame:
    """Feeds each series, in order, to a machine of its own and returns what the machines emit.

    start(key) gives a function that takes a row and returns output rows. A machine must see its whole series in order,
    so a series is one task's work, but it is read batch by batch from a sort that spills: nothing is collected.
    """
    names = [c.strip().split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, step = None, None
        for batch in batches:
            out: list[tuple] = []
            for row in batch.itertuples(index=False):
                own = tuple(getattr(row, k) for k in keys)
                if own != key:
                    key, step = own, start(own)
                out += step(row)
            yield pd.DataFrame(out, columns=names)

    return rows.repartition(*keys).sortWithinPartitions(*keys, order).mapInPandas(run, schema)

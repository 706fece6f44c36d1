"""Ordered folds: path-dependent operators as one pure step, in batches of bounded memory.

Rows are dealt by key and sorted within partitions; a task streams them in Arrow
batches and carries each key's state from batch to batch, so a long key is never
held at once. The same step serves streaming queries (see ``tidewake.streaming``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame

#: step(state, row) gives the rows to emit; it changes the state in place.
Step = Callable[[Any, Any], list[tuple]]


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], start: Callable[[], Any], step: Step, schema: str, finish: Callable[[Any], list[tuple]] | None = None) -> DataFrame:
    """Keys and what the step (and the finish, at a key's end) emits for its rows in order."""
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    names = keys + [part.split()[0].strip("`") for part in schema.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for frame in frames:
            out: list[tuple] = []
            for row in frame.itertuples(index=False):
                at = tuple(getattr(row, k) for k in keys)
                if at != key:
                    if key is not None and finish:
                        out += [(*key, *x) for x in finish(state)]
                    key, state = at, start()
                out += [(*key, *x) for x in step(state, row)]
            yield pd.DataFrame(out, columns=names)
        if key is not None and finish:
            yield pd.DataFrame([(*key, *x) for x in finish(state)], columns=names)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, f"{kinds}, {schema}")

"""Folds over rows in order, for steps that no window can express.

Rows are dealt by key and sorted within partitions; one pass carries the state of the key at hand.
A key's rows are never collected, its cost is linear, and a task holds one Arrow batch. The rows of
one key stay in one task: their order is the meaning.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def ordered_fold(rows: DataFrame, keys: list[str], order: list[str], fields: list[str], start: Callable[[tuple], Any], step: Callable[[Any, tuple], tuple[Any, tuple]], out: str) -> DataFrame:
    """One row of schema ``out`` for each row: ``step(state, fields)`` gives the next state and the row.

    ``start(fields)`` gives a key's state before its first row, from that row. Rows of equal order
    are taken in the order of their fields.
    """
    schema, n = StructType.fromDDL(out), len(keys)
    arrow = to_arrow_schema(schema)
    columns = [*keys, *dict.fromkeys([*order, *fields])]
    picked = [columns.index(f) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        state: Any = None
        for batch in batches:
            found = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = tuple(row[k] for k in picked)
                if key is None or row[:n] != key:
                    key, state = row[:n], start(own)
                state, made = step(state, own)
                found.append(made)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), arrow, strict=True)] if found else [pa.array([], f.type) for f in arrow], schema=arrow)

    return rows.select(*columns).repartition(*keys).sortWithinPartitions(*keys, *order, *fields).mapInArrow(run, schema)

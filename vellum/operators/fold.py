"""A fold over each key's rows in order, in bounded memory.

Recurrences such as a token bucket can't be window functions. Rows are shuffled by key and
sorted inside tasks by Spark, which spills; a task then streams through them and holds one key's
state at a time, so a key with very many rows costs time in its task, never memory. One key is
one task: a recurrence has no parts that could be worked out apart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame

_TYPES = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}


def keyed_fold(rows: DataFrame, key: str, order: list[Column | str], begin: Callable[[], Any], step: Callable[[Any, tuple], tuple[Any, tuple]], schema: str) -> DataFrame:
    """Run ``state, out = step(state, row)`` over each key's rows; one output row for each input row.

    ``rows`` reach ``step`` as tuples of their columns, with None for null, and ``out`` has the
    columns of ``schema``. A null key is a key.
    """
    fields = pa.schema([(name, _TYPES[kind]) for name, kind in (part.split() for part in schema.split(", "))])
    at = rows.columns.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), None
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[at] != now:
                    now, state = row[at], begin()
                state, made = step(state, row)
                out.append(made)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), fields, strict=True)], schema=fields)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)

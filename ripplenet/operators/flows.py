"""Flows: receipts and payments of a source as rows of one table, so that a task can hold all rows of a source.

A row is a receipt (kind 1), a payment (kind 2) or both (kind 3).  Sources with more than ``MOST`` rows are too many for one
task; their operators have a way that spreads them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

RECEIPT, PAYMENT = 1, 2
#: Rows of a source that one task may hold.
MOST = 1 << 16


def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches that end where a source ends, with the places where their sources begin and end; rows come sorted by the first column."""
    held: list[pa.RecordBatch] = []

    def joined():
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        return whole, np.r_[0, pc.run_end_encode(whole.column(0)).run_ends.to_numpy()]

    for batch in batches:
        if not batch.num_rows:
            continue
        ends = pc.run_end_encode(batch.column(0)).run_ends.to_numpy()
        last = int(ends[-2]) if len(ends) > 1 else 0
        if held and (last or not held[-1].column(0)[-1].equals(batch.column(0)[0])):
            if last:
                held.append(batch.slice(0, last))
            yield joined()
            held = []
        elif last:
            held = [batch.slice(0, last)]
            yield joined()
            held = []
        held.append(batch.slice(last))
    if held:
        yield joined()


def per_source(flows: DataFrame, run: Callable, schema: StructType) -> DataFrame:
    """``run`` over batches of whole sources, in one exchange; flows has the source first.

    The number of tasks is given: by their bytes alone, few and long ones would be made of them.
    """
    source, tasks = flows.columns[0], int(flows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def task(batches):
        for batch, ends in whole(batches):
            yield from run(batch, ends)

    return flows.repartition(tasks, source).sortWithinPartitions(source).mapInArrow(task, schema)


def codes(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Numbers of the values, -1 for null, and the values."""
    found = column.dictionary_encode()
    return found.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def numbers(column: pa.Array) -> np.ndarray:
    """Doubles, NaN for null."""
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False)

"""Functions of the user on blocks of a table: all rows of a block, as arrays, in one call."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def map_blocks(df: DataFrame, function: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], schema: str, block: Column, order: list[str]) -> DataFrame:
    """``function`` on each block, by a table function over the table partitioned by ``block``.

    Rows come in the order of the columns ``order``; the function takes an array a column (nulls of numbers
    are NaN) and gives one for each column of ``schema``, of any common length.  A block is held by one
    task, so blocks are to be of bounded size.
    """
    columns = df.columns

    class Blocks:
        def __init__(self) -> None:
            self.held: list[pa.RecordBatch] = []

        def eval(self, rows: pa.RecordBatch):
            self.held.append(rows)
            return iter(())

        def terminate(self):
            if self.held:
                rows = pa.Table.from_batches(self.held)
                out = function({c: rows.column(c).to_numpy() for c in columns})
                yield pa.table({name: pa.array(values, from_pandas=True) for name, values in out.items()})

    table = df.withColumn("_block", block).asTable().partitionBy("_block").orderBy(*order)
    return F.arrow_udtf(Blocks, returnType=schema)(table)

"""Greedy packing of ordered rows into bins of a limited size.

The next bin begins where the current one has rows and the next row would go
over a limit; a row over the limit by itself has a bin of its own.  The bins of
a group depend on all rows before them.  A task reads its sorted rows as a
stream and keeps the current bin's sums only: memory does not grow with a group,
the sort spills.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..workspace import ship


def greedy_bins(df: DataFrame, groups: Sequence[str], order: Sequence[str | Column], limits: dict[str, float | str], out: str = "bin") -> DataFrame:
    """``df`` with ``out``, the number from 1 of each row's bin in its group.

    ``limits``: the columns whose sums are limited, with their limits, which are
    numbers or columns that hold a row's.  Sizes that are null count as 0.
    """
    ship(df.sparkSession)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.LongType())])

    def run(batches):
        group, number, filled, sums = object(), 0, False, [0] * len(limits)
        for batch in batches:
            keys = zip(*(batch.column(g).to_pylist() for g in groups), strict=True) if groups else [()] * batch.num_rows
            sizes = zip(*([x or 0 for x in batch.column(c).to_pylist()] for c in limits), strict=True)
            most_of = zip(*(batch.column(m).to_pylist() if isinstance(m, str) else [m] * batch.num_rows for m in limits.values()), strict=True)
            bins = []
            for key, size, row_most in zip(keys, sizes, most_of, strict=True):
                if key != group:
                    group, number, filled, sums = key, 1, False, [0] * len(limits)
                if filled and any(s + t > most for s, t, most in zip(sums, size, row_most, strict=True)):
                    number, sums = number + 1, [0] * len(limits)
                sums = [s + t for s, t in zip(sums, size, strict=True)]
                filled = True
                bins.append(number)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bins, pa.int64())], names=[*batch.schema.names, out])

    dealt = df.repartition(*groups) if groups else df.repartition(1)
    return dealt.sortWithinPartitions(*groups, *order).mapInArrow(run, schema)


def fixed_groups(position: Column, size: int) -> Column:
    """Groups of a fixed number of rows, from 0, by a position from 1."""
    return F.floor((position - 1) / size).cast("long")

"""Sequential kernels over keyed series.

Rows are hashed to partitions by key and sorted by key and order, and each partition is streamed
through the kernels in Arrow batches: a new key starts a new kernel.  Memory holds a batch and one
kernel per task, however long a series is, and one shuffle serves any number of kernels.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string


def keyed_fold(df: DataFrame, keys: list[str], order: list[str], make: Callable[[], object], out: str, *, value: str = "v", seconds: str | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """df's keys and order columns with what the kernel of each key returns, row by row.

    make: a new kernel; out: names and types of its results; extra: columns that its step takes besides.  A null or non-finite value is passed
    by: its results are null and the state stays.
    """
    columns = [*dict.fromkeys([*keys, *order, value, *([seconds] if seconds else []), *extra])]
    narrow = df.select(*columns)
    kept = [c for c in columns if c in keys or c in order]
    results: StructType = _parse_datatype_string(out)
    schema = StructType([narrow.schema[c] for c in kept] + results.fields)
    arrow = to_arrow_schema(schema)
    at = {c: i for i, c in enumerate(columns)}
    n_out = len(results.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kernel, empty = None, None, (None,) * n_out
        for b in batches:
            key_cols = [b.column(at[k]).to_pylist() for k in keys]
            values = b.column(at[value]).to_pylist()
            times = b.column(at[seconds]).to_pylist() if seconds else [None] * len(values)
            more = zip(*(b.column(at[c]).to_pylist() for c in extra)) if extra else iter(lambda: (), None)
            rows = []
            for key, x, t, e in zip(zip(*key_cols), values, times, more):
                if key != now:
                    now, kernel = key, make()
                rows.append(empty if x is None or x - x != 0 else kernel.step(x, t, *e))
            cols = [b.column(at[c]) for c in kept]
            cols += [pa.array([r[i] for r in rows], arrow.field(len(kept) + i).type) for i in range(n_out)]
            yield pa.RecordBatch.from_arrays([c.cast(arrow.field(i).type) for i, c in enumerate(cols)], schema=arrow)

    return narrow.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


class Chain:
    """Kernels side by side; their results in a row."""

    def __init__(self, *kernels):
        self.kernels = kernels

    def step(self, x, t=None):
        return tuple(y for k in self.kernels for y in k.step(x, t))


class Normalized:
    """A detector's score, its place among the scores before, and the detector's verdict."""

    def __init__(self, detector, normalizer):
        self.detector, self.normalizer = detector, normalizer

    def step(self, x, t=None):
        score, fired = self.detector.step(x, t)
        return score, self.normalizer.add(score), bool(fired)

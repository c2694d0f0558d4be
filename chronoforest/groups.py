"""Groups that a plain function handles one by one, many small ones in a batch.

Rows are dealt by the group's keys and sorted, so a group's rows follow each other in one task.  They reach the function as
tuples, and what it returns is gathered into batches: thousands of small trees cost little more than their rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Result rows that a task returns at once.
OUT_ROWS = 20_000

#: Rows of groups that a function gets at once, unless one group has more.
IN_ROWS = 5_000

KINDS = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "map<string,string>": pa.map_(pa.string(), pa.string())}


def batch_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    """Tuples as a batch; ``schema``: names and types, of KINDS, as DDL."""
    names, kinds = zip(*(c.rsplit(" ", 1) for c in schema.split(", ")), strict=True)
    columns = zip(*rows, strict=True)
    plain = lambda c, k: [None if v is None else list(v.items()) for v in c] if k.startswith("map") else list(c)
    return pa.RecordBatch.from_arrays([pa.array(plain(c, k), KINDS[k]) for c, k in zip(columns, kinds, strict=True)], names=list(names))


def values_of(column: pa.Array) -> list:
    """A column as a list; plain kinds go through numpy, as to_pylist() makes a scalar of each value first."""
    kind = column.type
    if column.null_count == len(column):
        return [None] * len(column)
    if pa.types.is_string(kind):
        return column.to_numpy(zero_copy_only=False).tolist()
    if not (pa.types.is_integer(kind) or pa.types.is_floating(kind) or pa.types.is_boolean(kind)):
        return column.to_pylist()
    if not column.null_count:
        return column.to_numpy(zero_copy_only=False).tolist()
    out = column.fill_null(False if pa.types.is_boolean(kind) else 0).to_numpy(zero_copy_only=False).tolist()
    for i in column.is_null().to_numpy(zero_copy_only=False).nonzero()[0].tolist():
        out[i] = None
    return out


def map_groups(rows: DataFrame, by: list[str], order: list[str], run: Callable[[list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """What ``run`` makes of each group's rows, in ``order``; a group is held by one task."""
    return map_group_lists(rows, by, order, lambda groups: (row for group in groups for row in run(group)), schema)


def map_group_lists(rows: DataFrame, by: list[str], order: list[str], run: Callable[[list[list[tuple]]], Iterable[tuple]], schema: str) -> DataFrame:
    """map_groups() of a function that takes several groups at once: as many as have IN_ROWS rows."""
    at = [rows.columns.index(c) for c in by]

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        group: list[tuple] = []
        now = None
        for batch in batches:
            for row in zip(*map(values_of, batch.columns), strict=True):
                key = [row[i] for i in at]
                if group and key != now:
                    yield group
                    group = []
                now = key
                group.append(row)
        if group:
            yield group

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list[tuple]]]:
        some, size = [], 0
        for group in groups(batches):
            some.append(group)
            size += len(group)
            if size >= IN_ROWS:
                yield some
                some, size = [], 0
        if some:
            yield some

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for some in lists(batches):
            for row in run(some):
                out.append(row)
                if len(out) >= OUT_ROWS:
                    yield batch_of(out, schema)
                    out = []
        if out:
            yield batch_of(out, schema)

    return rows.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(stream, schema)

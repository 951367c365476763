"""What the operators share: Arrow row mapping, checksums of ids, temporary column names."""

from __future__ import annotations

import ctypes
import ctypes.util
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


_LIBC = ctypes.CDLL(name) if (name := ctypes.util.find_library("c")) else None


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have, in any letter case."""
    taken, name = {c.lower() for c in df.columns}, f"__{stem}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def fold(column: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("")).cast("binary")) % parts


#: Rows of an Arrow batch that are Python objects at one time.
SLICE_ROWS = 256


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of SLICE_ROWS, so that a worker holds few texts as Python strings."""
    for at in range(0, batch.num_rows, SLICE_ROWS):
        yield batch.slice(at, SLICE_ROWS)


def tidy() -> None:
    """Gives freed memory back to the system at a task's end: the worker process lives on for tasks of other kinds."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None and hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def map_rows(df: DataFrame, make: Callable[[], Callable[..., tuple]], schema: str) -> DataFrame:
    """One output row for each row of ``df``, in Arrow batches.

    ``make`` runs once in each task and returns the row function, which takes the row's columns in
    order and returns the output values in the order of ``schema``.
    """
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = make()
        for batch in batches:
            for part in slices(batch):
                made = [row(*values) for values in zip(*(c.to_pylist() for c in part.columns))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values, type=field.type) for values, field in zip(zip(*made), arrow)], schema=arrow
                )
        tidy()

    return df.mapInArrow(run, schema)


def keep_rows(df: DataFrame, column: str, make: Callable[[], Callable[[str | None], bool]]) -> DataFrame:
    """The rows whose ``column`` passes the test that ``make`` returns, with all columns as they are."""
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = make()
        for batch in batches:
            kept = [bool(test(x)) for part in slices(batch) for x in part.column(at).to_pylist()]
            yield batch.filter(pa.array(kept, type=pa.bool_()))
        tidy()

    return df.mapInArrow(run, df.schema)

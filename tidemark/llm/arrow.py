"""Small helpers around ``mapInArrow``: whole texts in, one result row per input row out."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import SLICE_BYTES, Texts, slices

SPARK_TYPES = {
    pa.int64(): "bigint",
    pa.int32(): "int",
    pa.float64(): "double",
    pa.bool_(): "boolean",
    pa.string(): "string",
    pa.binary(): "binary",
    pa.list_(pa.int64()): "array<bigint>",
    pa.list_(pa.int32()): "array<int>",
}


def ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {SPARK_TYPES[f.type]}" for f in schema)


def lean(
    run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], after: Callable[[], None] | None = None
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, at whose end ``after()`` is called and freed memory goes back to
    the system: Python workers outlive their tasks and wait beside those of later steps."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            if after:
                after()
            give_back()

    return task


def give_back() -> None:
    """Return the memory that Arrow and the C library (glibc) keep for reuse."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def per_text(
    df: DataFrame,
    keep: list[str],
    text: str,
    fields: list[tuple[str, pa.DataType]],
    make: Callable[[], Callable[[Texts], dict]],
    limit: int = SLICE_BYTES,
    after: Callable[[], None] | None = None,
) -> DataFrame:
    """Columns ``keep`` plus ``fields`` computed from the whole text of every row.

    ``make()`` runs once in each task and returns the function that maps the texts of a slice to
    one array or list per field. A slice holds about ``limit`` bytes, so the memory of a task
    depends on the slice and the longest single text, not on the partition. ``after()`` runs at
    the end of each task, to let go of what the function holds in its worker.
    """
    names = [f"_k{i}" for i in range(len(keep))]
    inner = pa.schema(fields)
    at = keep.index(text) if text in keep else len(names)
    source = df.select(
        *[df[c].alias(n) for c, n in zip(keep, names)],
        *([df[text].alias("_text")] if at == len(names) else []),
    )
    kept = ", ".join(f"{n} {source.schema[n].dataType.simpleString()}" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            column = batch.column(at)
            for lo, hi, texts in slices(column, limit):
                got = work(texts)
                arrays = [batch.column(i).slice(lo, hi - lo) for i in range(len(names))]
                arrays += [
                    pa.array(got[f.name], f.type) if not isinstance(got[f.name], pa.Array) else got[f.name]
                    for f in inner
                ]
                yield pa.RecordBatch.from_arrays(arrays, [*names, *inner.names])

    out = source.mapInArrow(lean(run, after), ", ".join(x for x in (kept, ddl(inner)) if x))
    return out.select(*[F.col(n).alias(c) for c, n in zip(keep, names)], *inner.names)


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``values[bounds[i]:bounds[i + 1]]`` for every i; 0 for empty ranges."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[bounds[1:]] - total[bounds[:-1]]

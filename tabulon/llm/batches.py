"""Running numpy code over Arrow batches of texts."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernel as K


def trim() -> None:
    """Give freed memory back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # no such function outside glibc
        pass


def map_texts(df: DataFrame, column: str, body: Callable[[], Callable[[list[str | None], pa.RecordBatch], dict | None]], schema: str, chars: int = K.CHUNK_CHARS) -> DataFrame:
    """``df`` through a function of (texts, batch) that returns columns.

    ``body`` runs once a task and returns that function, so models and
    tables load on the executor. Batches are cut by characters first, ``chars`` at a time: tokenisers work faster on more. Columns
    may have other row counts than the batch; they are cast to ``schema``.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()  # workers serve many tasks and stages: what the last one freed goes back to the system first
        each = body()
        for batch in batches:
            texts = batch.column(column).to_pylist()
            for lo, hi in K.chunks([t or "" for t in texts], chars):
                got = each(texts[lo:hi], batch.slice(lo, hi - lo))
                if got is not None:
                    yield pa.RecordBatch.from_arrays([x if isinstance(x := got[f.name], (pa.Array, pa.ChunkedArray)) and x.type == f.type else pa.array(x, f.type) if not isinstance(x, pa.Array) else x.cast(f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)

"""Helpers that several corpus operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import shared_dir, written  # noqa: F401  of all operators here


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release() -> None:
    """Gives what a task has freed back to the machine: its worker lives on, and the next task's share of memory is no larger for it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:  # not on every C library
        trim(0)


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z alone."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold_rows(df: DataFrame, schema: str, one: Callable[[Iterator[dict]], Iterator[tuple]], batch: int = 512) -> DataFrame:
    """mapInArrow over rows: `one` maps an iterator of column lists to an iterator of row tuples; output goes out in bounded batches."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lists() -> Iterator[dict]:
            for b in batches:
                for at in range(0, b.num_rows, batch):
                    part = b.slice(at, batch)
                    yield {n: part.column(k).to_pylist() for k, n in enumerate(part.schema.names)}

        rows: list[tuple] = []
        for row in one(lists()):
            rows.append(row)
            if len(rows) >= batch:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)
        release()

    return df.mapInArrow(run, schema)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as one string; bytes of equal weight stand together, so sorted numbers shrink."""
    raw = b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes() if len(a) else b"" for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unpack(body: bytes, *kinds: str) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8)
    sizes = [np.dtype(k).itemsize for k in kinds]
    n = len(raw) // sum(sizes)
    out, at = [], 0
    for k, s in zip(kinds, sizes):
        out.append(np.ascontiguousarray(raw[at : at + n * s].reshape(s, n).T).reshape(-1).view(k) if n else np.empty(0, k))
        at += n * s
    return out

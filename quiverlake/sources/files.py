"""Small files on whatever store Spark has: manifests, index files."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def put(spark: SparkSession, path: str, data: bytes) -> None:
    """Writes a file in one go: it appears under its name when it is whole."""
    put_parts(spark, path, [data])


def put_parts(spark: SparkSession, path: str, parts: Iterable[bytes | tuple[str, int, int]]) -> None:
    """put() of parts in order, of which only one is held at a time: bytes, or (path, from, length) of another file, which don't go through Python."""
    fs, p = _fs(spark, path)
    tmp = p.suffix(".tmp")
    out = fs.create(tmp, True)
    try:
        for part in parts:
            if isinstance(part, tuple):
                source = _fs(spark, part[0])
                stream = source[0].open(source[1])
                try:
                    stream.seek(part[1])
                    spark._jvm.org.apache.commons.io.IOUtils.copyLarge(stream, out, 0, part[2])
                finally:
                    stream.close()
            else:
                for at in range(0, len(part), 1 << 23):
                    out.write(bytearray(part[at : at + (1 << 23)]))
    finally:
        out.close()
    if fs.exists(p):
        fs.delete(p, False)
    if not fs.rename(tmp, p):
        raise OSError(f"can't write {path}")


def claim(spark: SparkSession, path: str) -> None:
    """Makes an empty file that doesn't exist yet, in one step; OSError if another writer has it."""
    fs, p = _fs(spark, path)
    if not fs.createNewFile(p):
        raise OSError(f"{path} has another writer; load the index again")


def get(spark: SparkSession, path: str) -> bytes:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def head(spark: SparkSession, path: str, n: int) -> tuple[bytes, int]:
    """The first n bytes of a file, or what it has of them, and its length."""
    fs, p = _fs(spark, path)
    size = fs.getFileStatus(p).getLen()
    stream = fs.open(p)
    try:
        return bytes(stream.read() for _ in range(min(n, size))), size
    finally:
        stream.close()


def names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)

"""Vector distances as Column expressions, and what goes with them.

Sums run over the elements in order, in double precision, so results are the
same to the last bit whatever the plan, and as any engine's that folds alike.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.FloatType, T.DoubleType, T.DecimalType, T.IntegerType, T.LongType, T.ShortType, T.ByteType)
#: Spellings of the metrics.
L2_NAMES, IP_NAMES, COSINE_NAMES = ("l2", "l2sq"), ("ip", "inner_product"), ("cosine",)


def doubles(c: Column) -> Column:
    return c.cast("array<double>")


def literal(vector: Sequence[float]) -> Column:
    """A vector as a constant that Catalyst folds into the plan."""
    return F.array(*[F.lit(float(x)) for x in vector]) if len(vector) else F.array().cast("array<double>")


def _fold(a: Column, b: Column, f) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), f), F.lit(0.0), lambda s, x: s + x)


def l2sq(a: Column, b: Column) -> Column:
    """Squared Euclidean distance; null if lengths differ or an element is null."""
    return _fold(a, b, lambda x, y: (x - y) * (x - y))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(l2sq(a, b))


def dot(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: x * y)


def neg_dot(a: Column, b: Column) -> Column:
    """Inner product with its sign turned, so that the nearest comes first in ascending order."""
    return -dot(a, b)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(doubles(a), lambda x: x * x), F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where a norm is zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size)


def metric_name(metric: str) -> str:
    """'l2', 'ip' or 'cosine' for any spelling; ValueError else."""
    m = metric.lower()
    for name, spelled in (("l2", L2_NAMES), ("ip", IP_NAMES), ("cosine", COSINE_NAMES)):
        if m in spelled:
            return name
    raise ValueError(f"Unknown metric '{metric}'")


def ranked(metric: str, a: Column, b: Column) -> tuple[Column, bool]:
    """(value, whether small is near) of a metric: squared L2, raw inner product or cosine similarity."""
    m = metric_name(metric)
    return (l2sq(a, b), True) if m == "l2" else (dot(a, b), False) if m == "ip" else (cosine(a, b), False)


def vector_column(df: DataFrame, error: str) -> str:
    """The first column that is an array of numbers."""
    for f in df.schema.fields:
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, NUMERIC):
            return f.name
    raise ValueError(error)


def checked_vector(vector: Sequence[float] | None) -> list[float]:
    """A query vector as floats; ValueError for null and for null elements."""
    if vector is None or any(x is None for x in vector):
        raise ValueError("query vector must not be NULL")
    return [float(x) for x in vector]


def valid(c: Column, dim: int) -> Column:
    """Vectors of the right length without nulls."""
    return c.isNotNull() & (F.size(c) == dim) & ~F.exists(c, lambda x: x.isNull())

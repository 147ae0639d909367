"""Eight-bit scalar quantisation of vectors, one offset and scale for each dimension."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V


def sq8_params(df: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """(pos, lo, scale): smallest value of each dimension, and the span to the largest, 1 where that is zero. Null vectors don't count."""
    cells = df.where(F.col(vec_col).isNotNull()).select(F.posexplode(V.doubles(F.col(vec_col))).alias("pos", "x"))
    span = F.max("x") - F.min("x")
    return cells.groupBy("pos").agg(F.min("x").alias("lo"), F.when(span == 0, 1.0).otherwise(span).alias("scale"))


def params_arrays(params: DataFrame) -> tuple[list[float], list[float]]:
    """The parameters as two lists; there is one row for each dimension."""
    rows = sorted(params.collect())
    return [r[1] for r in rows], [r[2] for r in rows]


def encode(c: Column, lo: Sequence[float], scale: Sequence[float]) -> Column:
    """Codes 0 to 255 of a vector: the place in the span, rounded half up, values outside cut off."""
    a, s = V.literal(lo), V.literal(scale)
    share = F.zip_with(F.zip_with(V.doubles(c), a, lambda x, m: x - m), s, lambda x, w: x / w * 255)
    return F.transform(share, lambda x: F.least(F.greatest(F.floor(x + 0.5), F.lit(0)), F.lit(255)).cast("smallint"))


def decode(codes: Column, lo: Sequence[float], scale: Sequence[float]) -> Column:
    a, s = V.literal(lo), V.literal(scale)
    return F.zip_with(F.zip_with(codes.cast("array<double>"), s, lambda c, w: c / 255 * w), a, lambda x, m: x + m)


def stored(c: Column, lo: Sequence[float], scale: Sequence[float]) -> Column:
    """Codes in one byte each, as they are stored: less 128."""
    return F.transform(encode(c, lo, scale), lambda x: (x - 128).cast("tinyint"))


def restored(codes: Column, lo: Sequence[float], scale: Sequence[float]) -> Column:
    """The vector that stored() codes stand for."""
    return decode(F.transform(codes, lambda x: x.cast("smallint") + 128), lo, scale)


def sq8_search(df: DataFrame, query: Sequence[float], k: int, *, id_col: str = "vec_id", vec_col: str = "embedding", metric: str = "l2", rerank: int = 0) -> DataFrame:
    """The k rows nearest by decoded codes, with `_distance`. With rerank, that many candidates are taken and ordered by their exact distances."""
    lo, scale = params_arrays(sq8_params(df, vec_col))
    value, near = V.ranked(metric, decode(F.col("_codes"), lo, scale), V.literal(query))
    order = lambda: (F.col("_distance").asc() if near else F.col("_distance").desc(), F.col(id_col).asc())
    rows = df.where(V.valid(F.col(vec_col), len(query))).withColumn("_codes", encode(F.col(vec_col), lo, scale)).withColumn("_distance", value)
    if not rerank:
        return rows.drop("_codes").orderBy(*order()).limit(k)
    some = rows.orderBy(*order()).limit(max(k, rerank)).drop("_codes", "_distance")
    exact, _ = V.ranked(metric, F.col(vec_col), V.literal(query))
    return some.withColumn("_distance", exact).orderBy(*order()).limit(k)

"""Inverted lists: vectors in cells about centroids, and searches of the nearest cells.

Centroids are few (nlist), so they are constants of the plan; vectors are
written by cell, so a search reads only the folders of the cells it probes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V


def stride_sample(df: DataFrame, n: int, *, id_col: str = "vec_id") -> DataFrame:
    """n rows at even strides in the order of ids: those at floor(i * total / n). All rows if n is 0 or not less than their number."""
    total = df.count()
    if n <= 0 or n >= total:
        return df
    # row numbers come from sorted ranges and their sizes, not from one task
    ranged = df.repartitionByRange(F.col(id_col)).withColumn("_part", F.spark_partition_id())
    from ..sources.scratch import written

    ranged = written(ranged, "ranged")
    before, at = [], 0
    for part, size in sorted((r[0], r[1]) for r in ranged.groupBy("_part").count().collect()):
        before.append((part, at))
        at += size
    base = df.sparkSession.createDataFrame(before, "_part int, _base long")
    pos = F.row_number().over(Window.partitionBy("_part").orderBy(id_col)) - 1
    numbered = ranged.withColumn("_own", pos).join(F.broadcast(base), "_part").withColumn("_pos", F.col("_base") + F.col("_own"))
    # _pos is floor(i * total / n) for some i just if the next multiple of n up from _pos * n / total stays below
    i = F.ceil(F.col("_pos") * n / F.lit(total)).cast("long")
    picked = ((i < n) & (F.floor(i * F.lit(total) / n) == F.col("_pos")))
    return numbered.where(picked).drop("_part", "_base", "_own", "_pos")


def k_means(sample: DataFrame, nlist: int, *, vec_col: str = "embedding", id_col: str = "vec_id", rounds: int = 10) -> list[list[float]]:
    """nlist centroids: the first by even strides in the order of ids, then Lloyd's rounds as aggregations. Sums leave each task once a cell."""
    start = stride_sample(sample, nlist, id_col=id_col).orderBy(id_col).limit(nlist)
    cells = [[float(x) for x in r[0]] for r in start.select(vec_col).collect()]
    for _ in range(rounds):
        centres = np.array(cells)

        def sums(batches: Iterator[pa.RecordBatch], centres=centres) -> Iterator[pa.RecordBatch]:
            total, many = np.zeros_like(centres), np.zeros(len(centres), np.int64)
            for b in batches:
                v = b.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, centres.shape[1])
                if len(v):
                    cell = nearest_cell(v, centres)
                    np.add.at(total, cell, v)
                    many += np.bincount(cell, minlength=len(centres))
            some = np.flatnonzero(many)
            yield pa.RecordBatch.from_pydict({"cell": pa.array(some, pa.int32()), "sums": pa.array(total[some].tolist(), pa.list_(pa.float64())), "n": pa.array(many[some], pa.int64())})

        parts = sample.where(V.valid(F.col(vec_col), centres.shape[1])).select(V.doubles(F.col(vec_col))).mapInArrow(sums, "cell int, sums array<double>, n long")
        added = parts.select("cell", "n", F.posexplode("sums")).groupBy("cell", "pos").agg(F.sum("col").alias("s"), F.sum("n").alias("n")).collect()  # nlist x dimensions
        new = [list(c) for c in cells]
        for cell, pos, s, n in added:
            new[cell][pos] = s / n
        if new == cells:
            break
        cells = new
    return cells


def nearest_cell(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Nearest centroid of each row by squared L2 summed in order, the first of equals."""
    from .knn import matrix_distances

    out = np.empty(len(rows), np.int64)
    for at in range(0, len(rows), 8192):
        out[at : at + 8192] = matrix_distances("l2", centres, rows[at : at + 8192]).argmin(0)
    return out


def assign(df: DataFrame, centroids: Sequence[Sequence[float]], *, vec_col: str = "embedding") -> DataFrame:
    """df with `cell`: the nearest centroid's number, the smallest of equals; null vectors have none. One expression with the centroids as constants, no shuffle."""
    c = F.col(vec_col)
    each = F.array(*[F.struct(V.l2sq(c, V.literal(v)).alias("d"), F.lit(k).alias("cell")) for k, v in enumerate(centroids)])
    return df.withColumn("cell", F.when(c.isNotNull(), F.array_min(each)["cell"]))


def assign_fast(df: DataFrame, centroids: Sequence[Sequence[float]], *, vec_col: str = "embedding") -> DataFrame:
    """assign() for many centroids: Arrow batches against the centroid matrix."""
    from pyspark.sql.functions import pandas_udf

    centres = np.array(centroids, np.float64)

    @pandas_udf("int")
    def cell(v):
        import pandas as pd

        out = pd.Series([None] * len(v), dtype="Int32")
        some = v.notna()
        if some.any():
            out[some] = nearest_cell(np.array(v[some].tolist(), np.float64), centres).astype("int32")
        return out

    return df.withColumn("cell", cell(V.doubles(F.col(vec_col))))


def probes(query: Sequence[float], centroids: Sequence[Sequence[float]], nprobe: int) -> list[int]:
    """Numbers of the nprobe (at least one) centroids nearest to a query."""
    from .knn import matrix_distances

    d = matrix_distances("l2", np.array([query], np.float64), np.array(centroids, np.float64))[0]
    return np.argsort(d, kind="stable")[: max(1, nprobe)].tolist()


def ivf_search(celled: DataFrame, query: Sequence[float], k: int, centroids: Sequence[Sequence[float]], *, nprobe: int = 1, metric: str = "l2", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k nearest rows in the probed cells of a table with `cell`; written by cell, other cells aren't read."""
    from .knn import search

    return search(celled, query, k, metric=metric, id_col=id_col, vec_col=vec_col, where=F.col("cell").isin(probes(query, centroids, nprobe)))


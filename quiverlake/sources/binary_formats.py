"""Raw vector files and single-file graph indexes.

A vector file is: count and dimension as unsigned 32-bit integers, then the
floats row by row. A graph file is a header of 32 bytes (the letters DANN,
version, count, dimension, largest degree, number of entry points, metric,
three bytes of padding, build list), the entry points, the vectors and the
adjacency lists, filled up with the largest unsigned integer. All little-endian.
"""

from __future__ import annotations

import itertools
import math
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as G
from . import files
from .scratch import written

#: Fixed values of the graph file's format.
MAGIC, VERSION, NO_NODE, METRICS = b"DANN", 2, 0xFFFFFFFF, ["l2", "ip"]
#: Vectors of the pilot sample that cells are fitted on, at most.
FIT_ROWS = 20_000


def vector_bytes(vectors: np.ndarray) -> bytes:
    return struct.pack("<II", *vectors.shape) + vectors.astype("<f4").tobytes()


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, vector) of a vector file, or of all files of a folder; files are read whole by one task each, row from 0."""
    raw = spark.read.format("binaryFile").load(path).select("path", "content")

    def rows(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for name, data in zip(pdf["path"], pdf["content"]):
                n, dim = header(data)
                for at in range(0, n, 10_000):
                    m = min(10_000, n - at)
                    v = np.frombuffer(data, "<f4", m * dim, 8 + 4 * at * dim).reshape(m, dim)
                    yield pd.DataFrame({"path": name, "row": np.arange(at, at + m), "vector": v.tolist()})

    return raw.mapInPandas(rows, "path string, row long, vector array<float>")


def header(data: bytes, size: int | None = None) -> tuple[int, int]:
    """(count, dimension) of a vector file, or of its first bytes and its size; ValueError as the builder words it."""
    size = len(data) if size is None else size
    if len(data) < 8:
        raise ValueError("Failed to read input header")
    n, dim = struct.unpack("<II", data[:8])
    if not n:
        raise ValueError("Input file has 0 vectors")
    if not dim:
        raise ValueError("Input file has dimension 0")
    if size < 8 + 4 * n * dim:
        raise ValueError(f"Failed to read vectors: expected {8 + 4 * n * dim} bytes, got {size}")
    return n, dim


def graph_head(n: int, dim: int, entries: list[int], p: G.GraphParams) -> bytes:
    """What a graph file has before its vectors."""
    return MAGIC + struct.pack("<IIIIIB3xI", VERSION, n, dim, p.max_degree, len(entries), METRICS.index(p.metric), p.build_complexity) + np.array(entries, "<u4").tobytes()


def parse_graph(data: bytes) -> tuple[np.ndarray, np.ndarray, list[int], G.GraphParams]:
    """(vectors, adjacency, entry points, parameters) of a graph file; ValueError if it is too small, not one, or of another version."""
    if len(data) < 32:
        raise ValueError("file too small")
    if data[:4] != MAGIC:
        raise ValueError("invalid magic bytes")
    version, n, dim, degree, starts, metric, build = struct.unpack("<IIIIIB3xI", data[4:32])
    if version != VERSION:
        raise ValueError(f"unsupported version {version}")
    if len(data) < 32 + 4 * (starts + n * dim + n * degree) or metric >= len(METRICS):
        raise ValueError("file too small")
    entries = np.frombuffer(data, "<u4", starts, 32).astype(int).tolist()
    vectors = np.frombuffer(data, "<f4", n * dim, 32 + 4 * starts).reshape(n, dim)
    lists = np.frombuffer(data, "<u4", n * degree, 32 + 4 * (starts + n * dim)).reshape(n, degree)
    return vectors, np.where(lists == NO_NODE, -1, lists.astype(np.int64)), entries, G.GraphParams(max_degree=degree, build_complexity=build, metric=METRICS[metric])


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    """A graph file as a graph table; ids are places from 0."""
    raw = spark.read.format("binaryFile").load(path).select("content")

    def rows(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for data in pdf["content"]:
                v, adjacency, entries, _ = parse_graph(data)
                yield G.Shard(np.arange(len(v)), v, adjacency, np.array(entries, np.int64)).row(0)

    return raw.mapInPandas(rows, G.SHARDS)


def sample_size(n: int, asked: int = 0) -> int:
    """Vectors of the pilot build: as asked, or the root of n but 1000 at least, never more than n."""
    return min(n, asked if asked > 0 else max(math.isqrt(n), 1000))


def write_vectors(spark: SparkSession, df: DataFrame, path: str, *, id_col: str = "vec_id", vec_col: str = "embedding") -> None:
    """A vector file of df's vectors by id. They are packed in tasks, and the driver holds one task's at a time."""
    n, dim = df.agg(F.count(F.lit(1)), F.max(F.size(vec_col))).first()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(0)
            if column.null_count or len(column.flatten()) != len(column) * dim:
                raise ValueError("vector files hold no nulls, and vectors of one length")
            yield pa.RecordBatch.from_arrays([pa.array([column.flatten().to_numpy(zero_copy_only=False).astype("<f4").tobytes()], pa.binary())], ["data"])

    blocks = df.orderBy(id_col).select(F.col(vec_col).cast("array<float>")).mapInArrow(packed, "data binary")
    files.put_parts(spark, path, itertools.chain([struct.pack("<II", n, dim or 0)], (bytes(r[0]) for r in blocks.toLocalIterator())))


def centres_of(rows: np.ndarray, n: int) -> np.ndarray:
    """n centres of rows, by some rounds of Lloyd's."""
    at = rows[np.arange(n) * len(rows) // n]
    for _ in range(5):
        cell = nearest_cells(rows, at, 1)[:, 0]
        count = np.bincount(cell, minlength=n)
        total = np.zeros_like(at)
        np.add.at(total, cell, rows)
        at = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], at)
    return at


def nearest_cells(rows: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centres of each row, nearest first."""
    far = (centres**2).sum(1) - 2 * rows @ centres.T
    some = np.argpartition(far, n - 1, 1)[:, :n] if n < len(centres) else np.tile(np.arange(len(centres)), (len(rows), 1))
    return np.take_along_axis(some, np.argsort(np.take_along_axis(far, some, 1), 1, kind="stable"), 1)


def merged(row: np.ndarray, lists: np.ndarray, degree: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, adjacency): a row's lists in turns, the first of each, the second of each and so on, without repeats, up to the degree."""
    order = np.argsort(row, kind="stable")
    row, lists = row[order], lists[order]
    own, first = np.unique(row, return_index=True)
    turn = np.arange(len(row)) - first[np.searchsorted(own, row)]
    wide = np.full((len(own), lists.shape[1], int(turn.max(initial=0)) + 1), -1)
    wide[np.searchsorted(own, row), :, turn] = lists
    wide = wide.reshape(len(own), -1)
    for k in range(1, wide.shape[1]):
        wide[(wide[:, :k] == wide[:, k : k + 1]).any(1), k] = -1
    order = np.argsort(wide < 0, 1, kind="stable")[:, :degree]
    out = np.full((len(own), degree), -1, np.int32)
    out[:, : order.shape[1]] = np.take_along_axis(wide, order, 1)
    return own, out


def tied(adjacency: np.ndarray, entry: int) -> np.ndarray:
    """The adjacency, in place, with all nodes in reach of the entry and no list longer.

    A node out of reach gets an edge from one of its neighbours that is reached, or else from one reached lately: in a free
    place, or in that of an edge by which nothing was reached first. Such a place there always is: edges in places are more
    than nodes in reach less one.
    """
    n = len(adjacency)
    by, seen, recent = np.full(n, -1, np.int64), np.zeros(n, bool), []

    def spread(x: int, front: np.ndarray) -> None:
        """Marks what x leads to, and by what."""
        while len(front):
            recent.extend(front.tolist())
            to, first = np.unique(adjacency[front].ravel(), return_index=True)
            fresh = (to >= 0) & ~seen[to]
            to, first = to[fresh], first[fresh]
            by[to], seen[to] = front[first // adjacency.shape[1]], True
            front = to

    def place(y: int) -> int:
        """Where y's list may take an edge, or -1."""
        own = adjacency[y]
        free = np.flatnonzero(own < 0)
        if not len(free):
            free = np.flatnonzero(by[own] != y)[::-1]
        return int(free[0]) if len(free) else -1

    seen[entry] = True
    spread(entry, np.array([entry]))
    x = 0
    while not seen[x:].all():
        x += int(seen[x:].argmin())
        near = adjacency[x][adjacency[x] >= 0]
        for y in near[seen[near]].tolist():
            if (at := place(y)) >= 0:
                break
        else:
            while (at := place(y := recent[-1])) < 0:
                recent.pop()
        adjacency[y, at] = x
        by[x], seen[x] = y, True
        spread(x, np.array([x]))
    return adjacency


def streaming_build(spark: SparkSession, in_path: str, out_path: str, *, metric: str = "l2", max_degree: int = 64, build_complexity: int = 128, alpha: float = 1.2, sample: int = 0) -> DataFrame:
    """Builds the graph file out_path from a vector file, and gives one row: num_vectors, dimension, sample_size.

    The pilot sample's vectors, spread over the file, are the first of every graph, and (FIT_ROWS of them at most) say what
    cells there are. Every vector goes to its two nearest cells. A graph is built of each cell in a task, of a cell of over
    G.SHARD_ROWS vectors several; a vector's two lists are merged. The driver holds the lists, packed, and ties what is out of
    reach. A file of SHARD_ROWS vectors at most is one graph.
    """
    from ..functions.vectors import metric_name

    m = metric_name(metric)
    if m not in METRICS:
        raise ValueError(f"Unknown metric '{metric}'")
    if not files.exists(spark, in_path):
        raise ValueError(f"Failed to open input '{in_path}'")
    n, dim = header(*files.head(spark, in_path, 8))
    p = G.GraphParams(max_degree=max_degree, build_complexity=build_complexity, alpha=alpha, metric=m)
    first, step = sample_size(n, sample), G.SHARD_ROWS

    def dealt(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for data in pdf["content"]:
                for at in range(0, n, 1000):
                    yield pd.DataFrame({"at": [at], "data": [data[8 + 4 * at * dim : 8 + 4 * min(n, at + 1000) * dim]]})

    raw = spark.read.format("binaryFile").load(in_path).select("content").mapInPandas(dealt, "at long, data binary")
    blocks = written(raw.repartition(-(-n // step)), "blocks") if n > step else raw
    vectors = lambda data: np.frombuffer(data, "<f4").reshape(-1, dim)
    pilots = lambda row: -(-row * first // n) * n // first == row  # whether row is k * n // first of some k
    centres, base, pieces, parts = None, None, None, 1
    if n > step:
        fit = np.unique(np.arange(min(first, FIT_ROWS)) * first // min(first, FIT_ROWS)) * n // first

        def fitted(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in pdfs:
                for at, data in zip(pdf["at"], pdf["data"]):
                    v = vectors(data)
                    own = fit[(fit >= at) & (fit < at + len(v))]
                    if len(own):
                        yield pd.DataFrame({"at": [at], "data": [v[own - at].tobytes()]})

        some = np.concatenate([vectors(r["data"]) for r in sorted(blocks.mapInPandas(fitted, "at long, data binary").collect(), key=lambda r: r["at"])])
        centres = centres_of(some.astype(np.float64), min(len(some), -(-4 * n // step)))

        def counted(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(len(centres), np.int64)
            for pdf in pdfs:
                for data in pdf["data"]:
                    total += np.bincount(nearest_cells(vectors(data).astype(np.float64), centres, 2).ravel(), minlength=len(centres))
            yield pd.DataFrame({"cell": np.arange(len(centres)), "n": total})

        count = np.zeros(len(centres), np.int64)
        for cell, k in blocks.mapInPandas(counted, "cell int, n long").groupBy("cell").agg(F.sum("n")).collect():
            count[cell] = k
        pieces = np.maximum(1, -(-count // step))
        base, parts = np.cumsum(pieces) - pieces, int(pieces.sum())

    def placed(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for at, data in zip(pdf["at"], pdf["data"]):
                v = vectors(data)
                row = np.arange(at, at + len(v))
                cells = nearest_cells(v.astype(np.float64), centres, 2) if centres is not None else np.zeros((len(v), 1), np.int64)
                part = base[cells] + (row * 0x9E3779B1 % (1 << 32) >> 8)[:, None] % pieces[cells] if centres is not None else cells
                packed = [x.tobytes() for x in v]
                for k in range(part.shape[1]):
                    yield pd.DataFrame({"part": part[:, k].astype(np.int32), "row": row, "data": packed})

    def made(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = list(pdfs)
        pdf = pd.concat(got) if got else pd.DataFrame({"part": []})
        for _, own in pdf.groupby("part"):  # one, as a rule
            row = own["row"].to_numpy(np.int64)
            order = np.lexsort((row, ~pilots(row)))
            row, v = row[order], vectors(b"".join(own["data"])).astype(np.float64)[order]
            edges = G.build(v, p)[:, : p.max_degree]
            lists = np.full((len(row), p.max_degree), -1, np.int32)
            lists[:, : edges.shape[1]] = np.where(edges >= 0, row[np.maximum(edges, 0)], -1)
            yield pd.DataFrame({"row": row, "list": [x.tobytes() for x in lists]})

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        row, lists = merged(pdf["row"].to_numpy(np.int64), np.frombuffer(b"".join(pdf["list"]), np.int32).reshape(len(pdf), -1), p.max_degree)
        return pd.DataFrame({"at": [int(row[0])], "data": [lists.tobytes()]})

    lists = written(blocks.mapInPandas(placed, "part int, row long, data binary").repartitionById(parts, "part").mapInPandas(made, "row long, list binary"), "lists")
    whole = lists.withColumn("_b", F.floor(F.col("row") / 20_000)).groupBy("_b").applyInPandas(joined, "at long, data binary")
    adjacency = np.full((n, p.max_degree), -1, np.int32)
    for r in whole.toLocalIterator():
        part = np.frombuffer(r["data"], np.int32).reshape(-1, p.max_degree)
        adjacency[r["at"] : r["at"] + len(part)] = part
    tied(adjacency, 0)
    edges = (adjacency[at : at + 100_000].astype("<i4").tobytes() for at in range(0, n, 100_000))  # -1 is the largest unsigned integer
    files.put_parts(spark, out_path, itertools.chain([graph_head(n, dim, [0], p), (in_path, 8, 4 * n * dim)], edges))
    return spark.createDataFrame([(n, dim, first)], "num_vectors int, dimension int, sample_size int")

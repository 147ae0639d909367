"""Exact nearest-neighbour operators over DataFrames: single, batch, join, filtered, range, paged, diverse.

A single query is a fold in the projection under orderBy().limit(), which runs
as partial top-k in every task. Many queries go to the tasks as one matrix,
whose size is checked; each task keeps its best k a query, so what is shuffled
doesn't grow with the table. Larger sets of queries run in blocks of that size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors as V

#: Elements of the query matrix that a task holds at once; queries beyond run in further blocks.
BLOCK_ELEMENTS = 4_000_000


def search(df: DataFrame, query: Sequence[float], k: int, *, metric: str = "l2", id_col: str = "vec_id", vec_col: str | None = None, where: Column | str | None = None, offset: int = 0) -> DataFrame:
    """The k rows nearest to a query with `_distance`, nearest first, ties by id. Filters go to the scan. Vectors that are null or of another length match nothing; k <= 0 gives no rows."""
    vec = vec_col or V.vector_column(df, "search: table must have a numeric array column")
    rows = df if where is None else df.where(where)
    value, near = V.ranked(metric, F.col(vec), V.literal(query))
    rows = rows.where(V.valid(F.col(vec), len(query))).withColumn("_distance", value).where("_distance is not null")
    order = F.col("_distance").asc() if near else F.col("_distance").desc()
    found = rows.orderBy(order, F.col(id_col).asc())
    return (found.offset(offset) if offset else found).limit(max(0, k))


def vector_distances(df: DataFrame, query: Sequence[float], *, metric: str = "l2", on_invalid: str = "zero") -> DataFrame:
    """df with `_distance` to the query: squared L2, or the negated inner product for 'ip'. A null or wrong-length vector counts as the zero vector, or gives null with on_invalid='null'."""
    vec = V.vector_column(df, "vector_distances: input table must have a numeric LIST or ARRAY column")
    q = V.literal(query)
    measure = V.neg_dot if metric.lower() in V.IP_NAMES else V.l2sq
    other = measure(F.array_repeat(F.lit(0.0), len(query)), q) if on_invalid == "zero" else F.lit(None).cast("double")
    whole = F.coalesce(V.valid(F.col(vec), len(query)), F.lit(False))
    return df.withColumn("_distance", F.when(whole, measure(F.col(vec), q)).otherwise(other))


def range_search(df: DataFrame, query: Sequence[float], radius: float, *, inner_radius: float | None = None, max_returned: int | None = None, metric: str = "l2", id_col: str = "vec_id", vec_col: str | None = None) -> DataFrame:
    """All rows with `_distance` at most radius, and more than inner_radius; the nearest max_returned of them if that is set. For similarities, at least radius and less than inner_radius."""
    vec = vec_col or V.vector_column(df, "range_search: table must have a numeric array column")
    value, near = V.ranked(metric, F.col(vec), V.literal(query))
    rows = df.where(V.valid(F.col(vec), len(query))).withColumn("_distance", value)
    d = F.col("_distance")
    rows = rows.where(d <= radius if near else d >= radius)
    if inner_radius is not None:
        rows = rows.where(d > inner_radius if near else d < inner_radius)
    if max_returned is not None:
        rows = rows.orderBy(d.asc() if near else d.desc(), F.col(id_col)).limit(max_returned)
    return rows


def paged_search(df: DataFrame, query: Sequence[float], page_size: int, *, after: tuple[float, int] | None = None, metric: str = "l2", id_col: str = "vec_id", vec_col: str | None = None) -> DataFrame:
    """The next page_size rows after the (distance, id) that ended the last page. Pages neither overlap nor skip, and no state is kept."""
    if page_size <= 0:
        raise ValueError("page_size must be positive")
    vec = vec_col or V.vector_column(df, "paged_search: table must have a numeric array column")
    value, near = V.ranked(metric, F.col(vec), V.literal(query))
    rows = df.where(V.valid(F.col(vec), len(query))).withColumn("_distance", value).where("_distance is not null")
    d, i = F.col("_distance"), F.col(id_col)
    if after is not None:
        rows = rows.where(((d > after[0]) if near else (d < after[0])) | ((d == after[0]) & (i > after[1])))
    return rows.orderBy(d.asc() if near else d.desc(), i).limit(page_size)


def diverse_search(df: DataFrame, query: Sequence[float], k: int, attr: str, per_attr: int, *, metric: str = "l2", id_col: str = "vec_id", vec_col: str | None = None) -> DataFrame:
    """The k nearest rows of which at most per_attr share a value of attr. Only the nearest of each value leave their task before the ranks are taken."""
    vec = vec_col or V.vector_column(df, "diverse_search: table must have a numeric array column")
    value, near = V.ranked(metric, F.col(vec), V.literal(query))
    rows = df.where(V.valid(F.col(vec), len(query))).withColumn("_distance", value).where("_distance is not null")
    order = [F.col("_distance").asc() if near else F.col("_distance").desc(), F.col(id_col).asc()]
    rank = F.row_number().over(Window.partitionBy(attr).orderBy(*order))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= per_attr).drop("_rank").orderBy(*order).limit(k)


def matrix_distances(metric: str, queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """(queries, rows) values, summed over the elements in order as the Column folds do."""
    out = np.zeros((len(queries), len(rows)))
    for d in range(queries.shape[1]):
        a, b = queries[:, d, None], rows[None, :, d]
        out += (b - a) * (b - a) if metric == "l2" else b * a
    if metric == "cosine":
        sq, sr = np.zeros(len(queries)), np.zeros(len(rows))
        for d in range(queries.shape[1]):
            sq, sr = sq + queries[:, d] * queries[:, d], sr + rows[:, d] * rows[:, d]
        with np.errstate(divide="ignore", invalid="ignore"):
            out = out / (np.sqrt(sr)[None, :] * np.sqrt(sq)[:, None])
    return out


def pair_values(metric: str, queries: np.ndarray, which: np.ndarray, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The values of matrix_distances for pairs alone: queries[which[i]] and rows[at[i]]."""
    out, sq, sr = np.zeros(len(at)), np.zeros(len(at)), np.zeros(len(at))
    for d in range(queries.shape[1]):
        a, b = queries[which, d], rows[at, d]
        out += (b - a) * (b - a) if metric == "l2" else b * a
        if metric == "cosine":
            sq, sr = sq + a * a, sr + b * b
    if metric == "cosine":
        with np.errstate(divide="ignore", invalid="ignore"):
            out = out / (np.sqrt(sr) * np.sqrt(sq))
    return out


def approximate(metric: str, queries: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values by norms and a matrix product, small is near, NaN for what has no value; a bound for each query on how far they are from matrix_distances)."""
    unit = 8 * (queries.shape[1] + 2) * np.finfo(np.float64).eps
    with np.errstate(all="ignore"):
        dot = queries @ rows.T
        sq, sr = np.einsum("ij,ij->i", queries, queries), np.einsum("ij,ij->i", rows, rows)
        if metric == "l2":
            out, bound = sq[:, None] + sr[None, :] - 2 * dot, unit * (sq + sr.max(initial=0.0))
        elif metric == "ip":
            out, bound = -dot, unit * np.sqrt(sq * sr.max(initial=0.0))
        else:
            out, bound = -dot / (np.sqrt(sr)[None, :] * np.sqrt(sq)[:, None]), np.full(len(queries), unit)
        if metric != "cosine" and not np.isfinite(out).all() or metric == "cosine" and not (np.isfinite(sq).all() and np.isfinite(sr).all()):
            exact = matrix_distances(metric, queries, rows)
            return (exact if metric == "l2" else -exact), np.zeros(len(queries))
    return out, bound


def _numbered(queries: list[tuple[int, Sequence[float]]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, numbers, matrix) of the queries without nulls, in blocks of BLOCK_ELEMENTS."""
    by_dim: dict[int, list[tuple[int, list[float]]]] = {}
    for i, q in queries:
        if q is not None and all(x is not None for x in q):
            by_dim.setdefault(len(q), []).append((i, [float(x) for x in q]))
    for dim, own in by_dim.items():
        step = max(1, BLOCK_ELEMENTS // max(1, dim))
        for at in range(0, len(own), step):
            part = own[at : at + step]
            yield dim, np.array([i for i, _ in part]), np.array([q for _, q in part], np.float64).reshape(len(part), dim)


def _blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[list, np.ndarray]]:
    """(ids, matrix) of Arrow batches of ids and vectors, up to 4096 rows at a time."""
    for b in batches:
        for lo in range(0, b.num_rows, 4096):
            s = b.slice(lo, 4096)
            yield s.column(0).to_pylist(), s.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def nearest_pairs(queries: list[tuple[int, Sequence[float]]], df: DataFrame, k: int, *, metric: str = "l2", id_col: str = "vec_id", vec_col: str | None = None) -> DataFrame:
    """(query_idx, id, _distance, _rank): each query's k nearest rows, ranked from 1, ties by id.

    Norms and a matrix product choose candidates with room for their rounding,
    and candidates' values are summed in order, so results are those of search().
    Queries that are null, hold nulls or have another length than a row match
    nothing, and so do rows without a value, as zero vectors under cosine. Tasks
    hand on their own best k only.
    """
    m, vec = V.metric_name(metric), vec_col or V.vector_column(df, "table must have a numeric array column")
    kind = df.schema[id_col].dataType.simpleString()
    out_schema = T._parse_datatype_string(f"query_idx long, id {kind}, _distance double")
    found = None
    for dim, numbers, matrix in _numbered(queries) if k > 0 else ():

        def best(batches: Iterator[pa.RecordBatch], numbers=numbers, matrix=matrix) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_schema

            schema = to_arrow_schema(out_schema)
            held: list[list[tuple]] = [[] for _ in numbers]
            for ids, rows in _blocks(batches, matrix.shape[1]):
                for qa in range(0, len(numbers), 256):
                    values, bounds = approximate(m, matrix[qa : qa + 256], rows)
                    for j, (v, bound) in enumerate(zip(values, bounds.tolist()), qa):
                        some = np.flatnonzero(v <= (held[j][-1][0] + bound if len(held[j]) >= k else np.inf))
                        if len(some) > k:
                            some = some[v[some] <= np.partition(v[some], k - 1)[k - 1] + 2 * bound]
                        if len(some):
                            exact = matrix_distances(m, matrix[j : j + 1], rows[some])[0]
                            key = exact if m == "l2" else -exact
                            held[j] = sorted([*held[j], *zip(key.tolist(), (ids[x] for x in some.tolist()))])[:k]
            for j, i in enumerate(numbers.tolist()):
                if held[j]:
                    d = np.array([r[0] for r in held[j]])
                    yield pa.RecordBatch.from_arrays([pa.array([i] * len(d), schema.field(0).type), pa.array([r[1] for r in held[j]], schema.field(1).type), pa.array(d if m == "l2" else -d, schema.field(2).type)], schema=schema)

        rows = df.where(V.valid(F.col(vec), dim)).select(F.col(id_col), V.doubles(F.col(vec)).alias("_v"))
        one = rows.mapInArrow(best, out_schema)
        found = one if found is None else found.unionByName(one)
    if found is None:
        return df.sparkSession.createDataFrame([], f"query_idx long, id {kind}, _distance double, _rank int")
    near = F.col("_distance").asc() if m == "l2" else F.col("_distance").desc()
    rank = F.row_number().over(Window.partitionBy("query_idx").orderBy(near, F.col("id").asc()))
    return found.withColumn("_rank", rank).where(F.col("_rank") <= k)


def range_pairs(queries: list[tuple[int, Sequence[float]]], df: DataFrame, radius: float, *, metric: str = "l2", id_col: str = "vec_id", vec_col: str | None = None) -> DataFrame:
    """(query_idx, id, _distance): all rows at most radius from each query, for similarities at least radius. Only pairs within it ever leave a batch."""
    m, vec = V.metric_name(metric), vec_col or V.vector_column(df, "table must have a numeric array column")
    kind = df.schema[id_col].dataType.simpleString()
    out_schema = T._parse_datatype_string(f"query_idx long, id {kind}, _distance double")
    edge = radius if m == "l2" else -radius
    found = df.sparkSession.createDataFrame([], out_schema)
    for dim, numbers, matrix in _numbered(queries):

        def within(batches: Iterator[pa.RecordBatch], numbers=numbers, matrix=matrix) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_schema

            schema = to_arrow_schema(out_schema)
            for ids, rows in _blocks(batches, matrix.shape[1]):
                for qa in range(0, len(numbers), 256):
                    values, bounds = approximate(m, matrix[qa : qa + 256], rows)
                    for j, (v, bound) in enumerate(zip(values, bounds.tolist()), qa):
                        some = np.flatnonzero(v <= edge + bound)
                        if len(some):
                            exact = matrix_distances(m, matrix[j : j + 1], rows[some])[0]
                            hit = np.flatnonzero(exact <= radius if m == "l2" else exact >= radius)
                            yield pa.RecordBatch.from_arrays([pa.array([int(numbers[j])] * len(hit), schema.field(0).type), pa.array([ids[some[x]] for x in hit.tolist()], schema.field(1).type), pa.array(exact[hit], schema.field(2).type)], schema=schema)

        rows = df.where(V.valid(F.col(vec), dim)).select(F.col(id_col), V.doubles(F.col(vec)).alias("_v"))
        found = found.unionByName(rows.mapInArrow(within, out_schema))
    return found


def pair_distances(pairs: DataFrame, queries: DataFrame, df: DataFrame, *, metric: str = "l2", query_col: str = "query_idx", query_vec: str = "query", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """pairs(query_col, id_col) with the `_distance` of each given row to its given query; pairs whose row or query is unknown are left out, invalid vectors give null."""
    a, b = F.col("__v"), F.col("__q")
    value, _ = V.ranked(metric, a, b)
    rows = pairs.join(df.select(F.col(id_col), F.col(vec_col).alias("__v")), id_col).join(queries.select(F.col(query_col), F.col(query_vec).alias("__q")), query_col)
    whole = F.coalesce(V.valid(a, F.size(b)) & ~F.exists(b, lambda x: x.isNull()), F.lit(False))
    return rows.select(*pairs.columns, F.when(whole, value).alias("_distance"))


def pairs_by_blocks(rows: Iterator[tuple], width: int, run: Callable[[list], DataFrame]) -> DataFrame | None:
    """run() over a query table's rows in blocks of BLOCK_ELEMENTS; beyond the first block results are written before the next is gathered."""
    from ..sources.scratch import written

    step, out, block = max(1, BLOCK_ELEMENTS // max(1, width)), None, []

    def add(last: bool) -> None:
        nonlocal out, block
        if block:
            found = run(block)
            found = found if last and out is None else written(found, "pairs")
            out, block = found if out is None else out.unionByName(found), []

    for r in rows:
        block.append((r[0], r[1]))
        if len(block) >= step:
            add(False)
    add(True)
    return out


def search_batch(df: DataFrame, queries: Sequence[Sequence[float]], k: int, *, metric: str = "l2", id_col: str = "vec_id", vec_col: str | None = None) -> DataFrame:
    """query_idx (the query's place in the list, from 0), all columns of df and `_distance`: each query's k nearest. No queries give no rows; k <= 0 is an error."""
    if k <= 0:
        raise ValueError("Invalid nq/dimension/k")
    pairs = nearest_pairs(list(enumerate(queries)), df, k, metric=metric, id_col=id_col, vec_col=vec_col)
    return fetched(pairs, df, id_col)


def fetched(pairs: DataFrame, df: DataFrame, id_col: str) -> DataFrame:
    """Pairs with all columns of df: found ids are few, and columns are read after the search."""
    hits = pairs.select("query_idx", F.col("id").alias("__id"), "_distance")
    return hits.join(df, F.col("__id") == df[id_col]).select(F.col("query_idx").cast("int").alias("query_idx"), *[df[c] for c in df.columns], "_distance")


def search_table(queries: DataFrame, df: DataFrame, k: int, *, table: str = "base", metric: str = "l2", id_col: str = "vec_id", vec_col: str | None = None) -> DataFrame:
    """For every row of `queries`, its columns with the columns of its k nearest rows of df and `_distance`.

    The query vector is the first numeric array column. Columns of df whose name
    the queries have too are called <table>_<name>. Queries are numbered and go
    through the search in blocks, however many they are.
    """
    return joined_search(queries, df, id_col, table, lambda rows: nearest_pairs(rows, df, k, metric=metric, id_col=id_col, vec_col=vec_col))


def joined_search(queries: DataFrame, df: DataFrame, id_col: str, table: str, run: Callable[[list], DataFrame]) -> DataFrame:
    """search_table() by any search of numbered queries."""
    vec = V.vector_column(queries, "ann_search_table: input table must have a numeric LIST or ARRAY column for queries")
    from ..sources.scratch import written

    numbered = written(queries.withColumn("__q", F.monotonically_increasing_id()), "queries")  # numbers must be the same for the search and for the join
    width = numbered.agg(F.max(F.size(vec))).first()[0] or 1
    pairs = pairs_by_blocks(numbered.select("__q", vec).toLocalIterator(), width, run)
    if pairs is None:
        pairs = run([])
    taken = set(queries.columns)
    names = {c: f"{table}_{c}" if c in taken else c for c in df.columns}
    base = df.select(F.col(id_col).alias("__id"), *[F.col(c).alias(names[c]) for c in df.columns])
    hits = pairs.select(F.col("query_idx").alias("__q"), F.col("id").alias("__id"), "_distance")
    return hits.join(base, "__id").join(numbered, "__q").select(*queries.columns, *names.values(), "_distance")

"""From "order by distance, limit k" to an index search, where that gives the same rows at less cost.

The rules are the ones a user can check in explain(): one ascending distance
(or descending similarity) key, a limit, no filter, an index on the column
whose metric fits and that has just the table's rows, enough rows, and a small
enough share of them asked for.
Everything else runs exactly, as a partial top-k over the scan.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.sqlfuncs import arguments
from ..sources.catalog import Catalog, Index

#: Function names, the metric each orders by, and whether small is near. Fixed values.
FUNCTIONS = {
    "array_distance": ("l2", True),
    "list_distance": ("l2", True),
    "array_inner_product": ("ip", False),
    "list_inner_product": ("ip", False),
    "array_cosine_similarity": ("cosine", False),
    "list_cosine_similarity": ("cosine", False),
}
#: Rows a table needs, and the share of them that may be asked for: graphs, other indexes. Fixed values.
LEAST_ROWS, GRAPH_SHARE, OTHER_SHARE = 50, 0.3, 0.1
#: Session option: candidates fetched for each row asked for.
OVERFETCH = "spark.quiverlake.ann_overfetch_multiplier"


def distance(function: str, a: Column, b: Column) -> Column:
    """A distance function by its SQL name, exact."""
    name = function.lower()
    if name not in FUNCTIONS:
        raise ValueError(f"unknown distance function {function}")
    kind = FUNCTIONS[name][0]
    return V.l2(a, b) if kind == "l2" else V.dot(a, b) if kind == "ip" else V.cosine(a, b)


@dataclass
class Plan:
    """What was decided: the rows, the index if one is used, and why not if none is."""

    rows: DataFrame
    index: Index | None
    why: str

    def explain(self) -> str:
        if self.index is None:
            return f"EXACT_TOP_K ({self.why})"
        o = self.index.options
        kind = "graph" if self.index.is_graph else o.type
        return f"ANN_INDEX_SCAN (index={self.index.m.name}, {self.why}, engine={self.index.m.engine}, type={kind}, nprobe={o.nprobe}, mode={o.mode})"


def order_by_distance(catalog: Catalog, df: DataFrame, table: str, function: str, vec_col: str, query: Sequence[float], *, limit: int | None, offset: int = 0, ascending: bool = True, where: Column | str | None = None, id_col: str = "vec_id", then: Sequence[Column] = (), name: str = "distance") -> Plan:
    """df with the function's true value as `name`, ordered by it and then by `then` or the id, with limit and offset."""
    metric, near = FUNCTIONS[function.lower()]
    value = distance(function, F.col(vec_col), V.literal(query))

    def exact(rows: DataFrame) -> DataFrame:
        rows = rows if where is None else rows.where(where)
        key = F.col(name).asc_nulls_last() if ascending else F.col(name).desc_nulls_last()
        out = rows.withColumn(name, value).orderBy(key, *(then or [F.col(id_col)]))
        out = out.offset(offset) if offset else out
        return out if limit is None else out.limit(limit)

    def no(why: str) -> Plan:
        return Plan(exact(df), None, why)

    if limit is None:
        return no("no limit")
    if ascending != near:
        return no("wrong direction")
    if then:
        return no("several keys")
    if where is not None:
        return no("filter")
    fits = [i for i in catalog.indexes() if i.m.table == table and i.m.vec_col == vec_col and i.metric == metric]
    if not fits:
        return no("no index with this metric")
    index, wanted = fits[0], limit + offset
    n = index.m.n_vectors
    if n < LEAST_ROWS:
        return no(f"fewer than {LEAST_ROWS} rows")
    if wanted > n * (GRAPH_SHARE if index.is_graph else OTHER_SHARE):
        return no("too large a share of the rows")
    if not index.covers(df):
        return no("the index doesn't have just the table's rows")
    more = max(1, int(df.sparkSession.conf.get(OVERFETCH, "3"))) if index.is_graph or index.options.type != "Flat" or index.quantized else 1
    hits = index.pairs([(0, query)], min(n, wanted * more))
    ids = hits.select(F.col("id").alias("__id"))
    found = ids.join(df, F.col("__id") == df[id_col]).drop("__id")
    return Plan(exact(found), index, f"k={wanted}")


QUERY = re.compile(
    r"^\s*select\s+(?P<what>.+?)\s+from\s+(?P<table>\w+)\s+order\s+by\s+(?P<fn>\w+)\s*\(\s*(?P<col>\w+)\s*,\s*(?:array\s*\(|\[)(?P<vec>[^)\]]*)[)\]]\s*(?:::[\w\[\]]+)?\s*\)\s*(?P<way>asc|desc)?\s+limit\s+(?P<k>\d+)(?:\s+offset\s+(?P<o>\d+))?\s*;?\s*$",
    re.I | re.S,
)


def sql(catalog: Catalog, text: str, *, id_col: str = "vec_id") -> Plan:
    """A statement of the shape SELECT .. FROM t ORDER BY f(column, vector) LIMIT k [OFFSET o] through order_by_distance; any other through Spark SQL as it is."""
    spark = catalog.spark
    m = QUERY.match(text)
    if not m or m["fn"].lower() not in FUNCTIONS:
        return Plan(spark.sql(text), None, "not an order by distance")
    table = spark.table(m["table"])
    plan = order_by_distance(catalog, table, m["table"], m["fn"], m["col"], [float(x) for x in m["vec"].split(",")], limit=int(m["k"]), offset=int(m["o"] or 0), ascending=(m["way"] or "asc").lower() == "asc", id_col=id_col, name="__d")
    return Plan(plan.rows.selectExpr(*arguments(m["what"])) if m["what"].strip() != "*" else plan.rows.drop("__d"), plan.index, plan.why)

"""Registered vector-search queries and the SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import sqlfuncs
from ..functions import vectors as V
from ..operators import graph, hybrid, ivf, knn, quantize
from ..sources import binary_formats, files
from ..sources.catalog import Catalog, gpu_info
from ..sources.scratch import shared_dir, written
from ..streaming.appender import append_stream
from . import planner

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Words searched for in the text queries; the English ones that are frequent in documents.
TEXT = "the with this"
#: Rows whose ids are divisible by this are the queries of searches for many.
EACH = 100


def query(name: str, sql: str | None = None):
    """Registers a query, and its SQL where there is one."""

    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = " ".join(sql.split())
        return f

    return put


def rows(spark: SparkSession, sf_dir: str, name: str = "embeddings") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    return [float(x) for x in rows(spark, sf_dir).where(F.col("vec_id") == vec_id).select("embedding").first()[0]]


def scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of different lengths, so that the metrics rank differently."""
    return rows(spark, sf_dir).withColumn("embedding", F.transform(V.doubles(F.col("embedding")), lambda x: x * (F.col("label") + 1)))


def catalog(spark: SparkSession) -> Catalog:
    return Catalog(spark, shared_dir(spark))


def flat(spark: SparkSession, sf_dir: str, **options):
    return catalog(spark).create_index(rows(spark, sf_dir), "idx", "embeddings", "embedding", "vec_id", "FAISS", **options)


def fold(a: str, b: str, kind: str) -> str:
    term = "(p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)" if kind == "l2" else "p[1]::DOUBLE * p[2]::DOUBLE"
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: {term}))"


L2 = fold("embedding", "qv", "l2")
DOT = fold("embedding", "qv", "ip")
COS = f"{DOT} / (sqrt({fold('embedding', 'embedding', 'ip')}) * sqrt({fold('qv', 'qv', 'ip')}))"
Q0 = "q AS (SELECT embedding AS qv FROM embeddings WHERE vec_id = 0)"
SCALED = "s AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE * (label + 1)) AS embedding FROM embeddings)"
MANY = f"q AS (SELECT vec_id AS qid, embedding AS qv FROM embeddings WHERE vec_id % {EACH} = 0)"


def top(value: str, way: str = "", k: int = 10, source: str = "embeddings", more: str = "", extra: str = "") -> str:
    return f"WITH {Q0}{extra} SELECT vec_id, label, {value} AS d FROM {source}, q {more} ORDER BY d {way}, vec_id LIMIT {k}"


def out(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumnRenamed("_distance", "d").select(*(columns or ("vec_id", "label", "d")))


# metrics


@query("knn_l2sq_top10", top(L2))
def _(spark, sf):
    return out(knn.search(rows(spark, sf), vector(spark, sf), 10))


@query("knn_l2_top10", top(f"sqrt({L2})"))
def _(spark, sf):
    return out(knn.search(rows(spark, sf), vector(spark, sf), 10).withColumn("_distance", F.sqrt("_distance")))


@query("knn_ip_top10", top(DOT, "DESC", source="s", extra=", " + SCALED))
def _(spark, sf):
    return out(knn.search(scaled(spark, sf), vector(spark, sf), 10, metric="ip"))


@query("knn_neg_ip_top10", top(f"-({DOT})", source="s", extra=", " + SCALED))
def _(spark, sf):
    return out(knn.vector_distances(scaled(spark, sf), vector(spark, sf), metric="ip").orderBy("_distance", "vec_id").limit(10))


@query("knn_cosine_top10", top(COS, "DESC", source="s", extra=", " + SCALED))
def _(spark, sf):
    return out(knn.search(scaled(spark, sf), vector(spark, sf), 10, metric="cosine"))


@query("vector_norms", f"SELECT vec_id, sqrt({fold('embedding', 'embedding', 'ip')}) AS norm FROM embeddings")
def _(spark, sf):
    return rows(spark, sf).select("vec_id", V.norm(F.col("embedding")).alias("norm"))


# index searches


@query("ann_search_rows", top(L2, k=5))
def _(spark, sf):
    return out(flat(spark, sf).search(vector(spark, sf), 5))


@query("ann_search_oversample", top(L2, k=6))
def _(spark, sf):
    return out(flat(spark, sf).search(vector(spark, sf), 2, oversample=3))


@query("ann_search_k_gt_n", f"WITH {Q0} SELECT vec_id, label, {L2} AS d FROM embeddings, q")
def _(spark, sf):
    return out(flat(spark, sf).search(vector(spark, sf), 1_000_000))


@query("index_scan_flat", f"WITH {Q0} SELECT vec_id AS row_id, ({L2})::FLOAT AS distance FROM embeddings, q ORDER BY {L2}, vec_id LIMIT 10")
def _(spark, sf):
    return flat(spark, sf).scan(vector(spark, sf), 10)


@query("index_scan_join", f"WITH {Q0}, s AS (SELECT vec_id AS row_id, {L2} AS d FROM embeddings, q ORDER BY d, vec_id LIMIT 20) SELECT label, count(*) AS n, min(row_id) AS first_id FROM s JOIN embeddings ON row_id = vec_id GROUP BY label")
def _(spark, sf):
    e = rows(spark, sf)
    hits = flat(spark, sf).scan(vector(spark, sf), 20)
    return hits.join(e, hits["row_id"] == e["vec_id"]).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first_id"))


@query("index_scan_ip", f"WITH {Q0} SELECT vec_id AS row_id, ({DOT})::FLOAT AS distance FROM embeddings, q ORDER BY {DOT} DESC, vec_id LIMIT 10")
def _(spark, sf):
    return flat(spark, sf, metric="IP").scan(vector(spark, sf), 10)


RANKED = f"r AS (SELECT qid, vec_id, label, {L2} AS d, row_number() OVER (PARTITION BY qid ORDER BY {L2}, vec_id) AS rk FROM embeddings, q)"


@query("ann_search_batch", f"WITH {MANY}, {RANKED} SELECT (qid // {EACH})::INTEGER AS query_idx, vec_id, label, d FROM r WHERE rk <= 10")
def _(spark, sf):
    many = [r[1] for r in sorted(rows(spark, sf).where(F.col("vec_id") % EACH == 0).select("vec_id", "embedding").collect())]
    return out(flat(spark, sf).search_batch(many, 10), "query_idx", "vec_id", "label", "d")


@query("ann_search_table", f"WITH {MANY}, {RANKED} SELECT qid, vec_id, label, d FROM r WHERE rk <= 3")
def _(spark, sf):
    many = rows(spark, sf).where(F.col("vec_id") % EACH == 0).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))
    return out(flat(spark, sf).search_table(many, 3), "qid", "vec_id", "label", "d")


@query("ann_search_table_collision", f"WITH {MANY}, {RANKED} SELECT qid AS vec_id, vec_id AS embeddings_vec_id, label AS embeddings_label, d FROM r WHERE rk <= 2")
def _(spark, sf):
    many = rows(spark, sf).where(F.col("vec_id") % EACH == 0).select("vec_id", "label", "embedding")
    return out(knn.search_table(many, rows(spark, sf), 2, table="embeddings"), "vec_id", "embeddings_vec_id", "embeddings_label", "d")


@query("knn_cosine_batch", f"WITH q AS (SELECT vec_id AS qid, embedding AS qv FROM embeddings WHERE vec_id % {EACH} = 0), {SCALED}, r AS (SELECT qid, vec_id, {COS} AS d, row_number() OVER (PARTITION BY qid ORDER BY {COS} DESC, vec_id) AS rk FROM s, q) SELECT qid, vec_id, d FROM r WHERE rk <= 5")
def _(spark, sf):
    many = [(r[0], r[1]) for r in rows(spark, sf).where(F.col("vec_id") % EACH == 0).select("vec_id", "embedding").collect()]
    found = knn.nearest_pairs(many, scaled(spark, sf), 5, metric="cosine")
    return found.select(F.col("query_idx").alias("qid"), F.col("id").alias("vec_id"), F.col("_distance").alias("d"))


@query("knn_cosine_zero_rows", f"WITH {MANY}, z AS (SELECT vec_id, CASE WHEN vec_id % 50 = 0 THEN embedding ELSE list_transform(embedding, lambda x: 0.0::FLOAT) END AS embedding FROM embeddings), r AS (SELECT qid, vec_id, {COS} AS d, row_number() OVER (PARTITION BY qid ORDER BY {COS} DESC, vec_id) AS rk FROM z, q WHERE vec_id % 50 = 0) SELECT qid, vec_id, d FROM r WHERE rk <= 5")
def _(spark, sf):
    e = rows(spark, sf)
    many = [(r[0], r[1]) for r in e.where(F.col("vec_id") % EACH == 0).select("vec_id", "embedding").collect()]
    mostly = e.withColumn("embedding", F.when(F.col("vec_id") % 50 == 0, F.col("embedding")).otherwise(F.transform("embedding", lambda x: F.lit(0.0).cast("float"))))
    return knn.nearest_pairs(many, mostly, 5, metric="cosine").select(F.col("query_idx").alias("qid"), F.col("id").alias("vec_id"), F.col("_distance").alias("d"))


@query("knn_lateral", f"WITH {MANY}, {RANKED} SELECT qid, vec_id, d FROM r WHERE rk <= 2")
def _(spark, sf):
    e = rows(spark, sf)
    many = e.where(F.col("vec_id") % EACH == 0).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))
    return out(knn.search_table(many, e, 2), "qid", "vec_id", "d")


@query("pair_distances", f"SELECT b.vec_id, a.vec_id AS query_idx, {fold('b.embedding', 'a.embedding', 'l2')} AS d FROM embeddings b JOIN embeddings a ON a.vec_id = b.vec_id // 7")
def _(spark, sf):
    e = rows(spark, sf)
    pairs = e.select("vec_id", F.floor(F.col("vec_id") / 7).cast("long").alias("query_idx"))
    return out(knn.pair_distances(pairs, e.select(F.col("vec_id").alias("query_idx"), F.col("embedding").alias("query")), e), "vec_id", "query_idx", "d")


@query("knn_bad_dim_empty", "SELECT vec_id, label, 0.0::DOUBLE AS d FROM embeddings WHERE false")
def _(spark, sf):
    return out(flat(spark, sf).search([1.0, 0.0], 5))


# one-shot distances


@query("vector_distances_l2", f"WITH {Q0} SELECT vec_id, {L2} AS d FROM embeddings, q")
def _(spark, sf):
    return out(knn.vector_distances(rows(spark, sf), vector(spark, sf)), "vec_id", "d")


@query("vector_distances_ip", f"WITH {Q0} SELECT vec_id, -({DOT}) AS d FROM embeddings, q")
def _(spark, sf):
    return out(knn.vector_distances(rows(spark, sf), vector(spark, sf), metric="inner_product"), "vec_id", "d")


@query(
    "vector_distances_invalid",
    f"WITH {Q0}, b AS (SELECT vec_id, CASE WHEN label = 0 THEN NULL WHEN label = 1 THEN embedding[1:3] ELSE embedding END AS v FROM embeddings) SELECT vec_id, CASE WHEN v IS NULL OR len(v) <> len(qv) THEN {fold('qv', 'list_transform(qv, lambda x: 0.0::DOUBLE)', 'l2')} ELSE {fold('v', 'qv', 'l2')} END AS d FROM b, q",
)
def _(spark, sf):
    broken = rows(spark, sf).select("vec_id", F.when(F.col("label") == 0, None).when(F.col("label") == 1, F.slice("embedding", 1, 3)).otherwise(F.col("embedding")).alias("v"))
    return out(knn.vector_distances(broken, vector(spark, sf)), "vec_id", "d")


@query("vector_distances_sql", f"WITH {Q0} SELECT vec_id, {L2} AS d FROM embeddings, q")
def _(spark, sf):
    rows(spark, sf).createOrReplaceTempView("distance_base")
    q = ", ".join(f"{x!r}D" for x in vector(spark, sf))
    return sqlfuncs.ann_sql(catalog(spark), f"SELECT vec_id, _distance AS d FROM vector_distances(TABLE(distance_base), [{q}], 'l2')")


# filters, ranges, pages


@query("filtered_knn_label", top(L2, more="WHERE label = 3"))
def _(spark, sf):
    return out(knn.search(rows(spark, sf), vector(spark, sf), 10, where="label = 3"))


@query("range_search", f"WITH {Q0} SELECT vec_id, label, {L2} AS d FROM embeddings, q WHERE {L2} <= 1.9")
def _(spark, sf):
    return out(knn.range_search(rows(spark, sf), vector(spark, sf), 1.9))


@query("range_search_annulus", f"WITH {Q0} SELECT vec_id, label, {L2} AS d FROM embeddings, q WHERE {L2} <= 1.9 AND {L2} > 1.5")
def _(spark, sf):
    return out(knn.range_search(rows(spark, sf), vector(spark, sf), 1.9, inner_radius=1.5))


@query("range_search_max", f"WITH {Q0} SELECT vec_id, label, {L2} AS d FROM embeddings, q WHERE {L2} <= 1.9 ORDER BY d, vec_id LIMIT 7")
def _(spark, sf):
    return out(knn.range_search(rows(spark, sf), vector(spark, sf), 1.9, max_returned=7))


@query("paged_search_page2", f"WITH {Q0} SELECT vec_id, label, {L2} AS d FROM embeddings, q ORDER BY d, vec_id LIMIT 10 OFFSET 10")
def _(spark, sf):
    first = knn.paged_search(rows(spark, sf), vector(spark, sf), 10).orderBy(F.col("_distance").desc(), F.col("vec_id").desc()).first()
    return out(knn.paged_search(rows(spark, sf), vector(spark, sf), 10, after=(first["_distance"], first["vec_id"])))


@query("diverse_search", f"WITH {Q0}, r AS (SELECT vec_id, label, {L2} AS d, row_number() OVER (PARTITION BY label ORDER BY {L2}, vec_id) AS rk FROM embeddings, q) SELECT vec_id, label, d FROM r WHERE rk <= 2 ORDER BY d, vec_id LIMIT 10")
def _(spark, sf):
    return out(knn.diverse_search(rows(spark, sf), vector(spark, sf), 10, "label", 2))


# order by distance


def ordered(spark, sf, **how):
    c = catalog(spark)
    c.create_index(rows(spark, sf), "idx", "embeddings", "embedding", "vec_id", "FAISS")
    return planner.order_by_distance(c, rows(spark, sf), "embeddings", how.pop("function", "array_distance"), "embedding", vector(spark, sf), **how)


@query("order_by_rewrite", top(f"sqrt({L2})", k=5))
def _(spark, sf):
    plan = ordered(spark, sf, limit=5)
    assert plan.index is not None, plan.why
    return plan.rows.select("vec_id", "label", F.col("distance").alias("d"))


@query("order_by_offset", f"WITH {Q0} SELECT vec_id, label, sqrt({L2}) AS d FROM embeddings, q ORDER BY d, vec_id LIMIT 5 OFFSET 7")
def _(spark, sf):
    return ordered(spark, sf, limit=5, offset=7).rows.select("vec_id", "label", F.col("distance").alias("d"))


@query("order_by_desc_no_rewrite", f"WITH {Q0} SELECT vec_id, label, sqrt({L2}) AS d FROM embeddings, q ORDER BY d DESC, vec_id LIMIT 5")
def _(spark, sf):
    plan = ordered(spark, sf, limit=5, ascending=False)
    assert plan.index is None
    return plan.rows.select("vec_id", "label", F.col("distance").alias("d"))


@query("order_by_multi_key", f"WITH {Q0} SELECT vec_id, label, sqrt({L2}) AS d FROM embeddings, q ORDER BY d, label, vec_id LIMIT 5")
def _(spark, sf):
    plan = ordered(spark, sf, limit=5, then=[F.col("label"), F.col("vec_id")])
    assert plan.index is None
    return plan.rows.select("vec_id", "label", F.col("distance").alias("d"))


@query("order_by_sql_text", top(f"sqrt({L2})", k=5))
def _(spark, sf):
    c = catalog(spark)
    c.create_index(rows(spark, sf), "idx", "planned_base", "embedding", "vec_id", "FAISS")
    rows(spark, sf).createOrReplaceTempView("planned_base")
    q = ", ".join(repr(x) for x in vector(spark, sf))
    plan = planner.sql(c, f"SELECT vec_id, label, __d AS d FROM planned_base ORDER BY array_distance(embedding, array({q})) LIMIT 5")
    assert plan.index is not None, plan.why
    return plan.rows


@query("order_by_stale_index", top(f"sqrt({L2})", k=5))
def _(spark, sf):
    c, e = catalog(spark), rows(spark, sf)
    c.create_index(e.where("vec_id >= 5"), "idx", "embeddings", "embedding", "vec_id", "FAISS")
    plan = planner.order_by_distance(c, e, "embeddings", "array_distance", "embedding", vector(spark, sf), limit=5)
    assert plan.index is None
    return plan.rows.select("vec_id", "label", F.col("distance").alias("d"))


@query("ann_sql_literals", "SELECT 'foo [bar] ann_search(x)' AS said, 'a [b]' AS also, count(*) AS n FROM (SELECT 1 FROM embeddings LIMIT 3)")
def _(spark, sf):
    c = catalog(spark)
    c.create_index(rows(spark, sf), "idx", "literal_base", "embedding", "vec_id", "FAISS")
    rows(spark, sf).createOrReplaceTempView("literal_base")
    q = ", ".join(f"{x!r}D" for x in vector(spark, sf))
    return sqlfuncs.ann_sql(c, f"SELECT 'foo [bar] ann_search(x)' AS said, 'a [b]' AS also, count(*) AS n FROM ann_search('literal_base', 'idx', [{q}], 3)")


@query("ann_sql_call", top(L2, k=4))
def _(spark, sf):
    c = catalog(spark)
    c.create_index(rows(spark, sf), "idx", "called_base", "embedding", "vec_id", "FAISS")
    rows(spark, sf).createOrReplaceTempView("called_base")
    q = ", ".join(f"{x!r}D" for x in vector(spark, sf))
    return sqlfuncs.ann_sql(c, f"SELECT vec_id, label, _distance AS d FROM ann_search('called_base', 'idx', [{q}], 2, oversample := 2)")


# life of an index


@query("delete_tombstones", top(L2, more="WHERE label <> 0"))
def _(spark, sf):
    index = flat(spark, sf).delete(rows(spark, sf).where("label = 0").select("vec_id"))
    return out(index.search(vector(spark, sf), 10))


@query("delete_tombstones_batch", f"WITH {MANY}, r AS (SELECT qid, vec_id, {L2} AS d, row_number() OVER (PARTITION BY qid ORDER BY {L2}, vec_id) AS rk FROM embeddings, q WHERE label <> 0) SELECT qid, vec_id, d FROM r WHERE rk <= 3")
def _(spark, sf):
    index = flat(spark, sf).delete(rows(spark, sf).where("label = 0").select("vec_id"))
    many = rows(spark, sf).where(F.col("vec_id") % EACH == 0).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))
    return out(index.search_table(many, 3), "qid", "vec_id", "d")


@query("insert_then_search", top(L2))
def _(spark, sf):
    e = rows(spark, sf)
    index = catalog(spark).create_index(e.where("label < 5"), "idx", "embeddings", "embedding", "vec_id", "FAISS").append(e.where("label >= 5"))
    index.base = e
    return out(index.search(vector(spark, sf), 10))


@query("vacuum_relabel", "SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS label FROM embeddings WHERE label <> 4")
def _(spark, sf):
    index = flat(spark, sf).delete(rows(spark, sf).where("label = 4").select("vec_id")).vacuum()
    return index.live().select(F.col("id").alias("vec_id"), "label")


@query("merge_indexes", top(L2))
def _(spark, sf):
    e, c = rows(spark, sf), catalog(spark)
    a = c.create_index(e.where("label % 2 = 0"), "a", "embeddings", "embedding", "vec_id", "FAISS")
    b = c.create_index(e.where("label % 2 = 1"), "b", "embeddings", "embedding", "vec_id", "FAISS")
    a.merge(b).base = e
    return out(a.search(vector(spark, sf), 10))


@query("persist_reload", top(L2, more="WHERE label <> 2"))
def _(spark, sf):
    index = flat(spark, sf).delete(rows(spark, sf).where("label = 2").select("vec_id"))
    again = Catalog(spark, index.root).load_index("embeddings", "idx", rows(spark, sf))
    return out(again.search(vector(spark, sf), 10))


@query("ann_list", "SELECT * FROM (VALUES ('a', 'FAISS', 'embeddings'), ('b', 'FAISS', 'embeddings')) t(name, engine, table_name)")
def _(spark, sf):
    c = catalog(spark)
    for name in ("a", "b"):
        c.create_index(rows(spark, sf), name, "embeddings", "embedding", "vec_id", "FAISS")
    return c.ann_list()


@query("ann_index_info", "SELECT 'idx' AS name, 'FAISS' AS engine, 'embeddings' AS table_name, count(*) AS num_vectors, count(*) FILTER (WHERE label = 1) AS num_deleted, true AS has_memory, false AS quantized FROM embeddings")
def _(spark, sf):
    index = flat(spark, sf).delete(rows(spark, sf).where("label = 1").select("vec_id"))
    return Catalog(spark, index.root).ann_index_info().withColumn("has_memory", F.col("memory_bytes") > 0).drop("memory_bytes")


@query("drop_index", "SELECT * FROM (VALUES ('b', 'FAISS', 'embeddings')) t(name, engine, table_name)")
def _(spark, sf):
    c = catalog(spark)
    for name in ("a", "b"):
        c.create_index(rows(spark, sf), name, "embeddings", "embedding", "vec_id", "FAISS")
    c.drop_index("embeddings", "a")
    return c.ann_list()


@query("gpu_info", "SELECT false AS available, 'No GPU backend available' AS device")
def _(spark, sf):
    return gpu_info(spark)


@query("streaming_append", top(L2))
def _(spark, sf):
    e = rows(spark, sf)
    index = catalog(spark).create_index(e.where("false"), "idx", "embeddings", "embedding", "vec_id", "FAISS")
    path = shared_dir(spark)
    for part in ("label < 3", "label >= 3"):
        e.where(part).write.mode("append").parquet(f"{path}/in")
    stream = append_stream(spark.readStream.schema(e.schema).parquet(f"{path}/in"), index, f"{path}/checkpoint")
    stream.awaitTermination()
    index.base = e
    return out(index.search(vector(spark, sf), 10))


# quantisation

LO = "p AS (SELECT pos, min(x) AS lo, CASE WHEN max(x) = min(x) THEN 1.0 ELSE max(x) - min(x) END AS scale FROM (SELECT unnest(range(len(embedding))) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY pos)"
CELL = "c AS (SELECT vec_id, label, pos, least(greatest(floor((x - lo) / scale * 255 + 0.5), 0), 255) AS code, lo, scale FROM (SELECT vec_id, label, unnest(range(len(embedding))) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings) e JOIN p USING (pos))"


@query("sq8_params", f"WITH {LO} SELECT pos::INTEGER AS pos, lo, scale::DOUBLE AS scale FROM p")
def _(spark, sf):
    return quantize.sq8_params(rows(spark, sf))


@query("sq8_codes", f"WITH {LO}, {CELL} SELECT vec_id, pos::INTEGER AS pos, code::SMALLINT AS code FROM c")
def _(spark, sf):
    e = rows(spark, sf)
    lo, scale = quantize.params_arrays(quantize.sq8_params(e))
    return e.select("vec_id", F.posexplode(quantize.encode(F.col("embedding"), lo, scale)).alias("pos", "code"))


@query(
    "sq8_search",
    f"WITH {LO}, {CELL}, v AS (SELECT vec_id, label, list(code::DOUBLE / 255 * scale + lo ORDER BY pos) AS embedding FROM c GROUP BY vec_id, label), {Q0} SELECT vec_id, label, {L2} AS d FROM v, q ORDER BY d, vec_id LIMIT 10",
)
def _(spark, sf):
    return out(quantize.sq8_search(rows(spark, sf), vector(spark, sf), 10))


@query("sq8_rerank", top(L2, k=5))
def _(spark, sf):
    return out(quantize.sq8_search(rows(spark, sf), vector(spark, sf), 5, rerank=100))


def coded(where: str = "") -> str:
    return f"WITH {LO}, {CELL}, v AS (SELECT vec_id, label, list(code::DOUBLE / 255 * scale + lo ORDER BY pos) AS embedding FROM c GROUP BY vec_id, label), {Q0} SELECT vec_id, label, {L2} AS d FROM v, q {where} ORDER BY d, vec_id LIMIT 10"


@query("sq8_index_flat", coded("WHERE label <> 2"))
def _(spark, sf):
    """Codes are what is stored, through deletion, vacuum and reload."""
    index = flat(spark, sf, description="SQ8").delete(rows(spark, sf).where("label = 2").select("vec_id")).vacuum()
    again = Catalog(spark, index.root).load_index("embeddings", "idx", rows(spark, sf))
    assert "codes" in again._read(again.m.segments, "").columns
    return out(again.search(vector(spark, sf), 10))


@query("sq8_index_ivf", coded())
def _(spark, sf):
    return out(flat(spark, sf, description="IVF8,SQ8", nprobe=8, train_sample=200).search(vector(spark, sf), 10))


@query("sq8_index_graph", coded("WHERE label <> 2"))
def _(spark, sf):
    e = rows(spark, sf)
    index = catalog(spark).create_index(e, "idx", "embeddings", "embedding", "vec_id", "DISKANN", max_degree=24, build_complexity=48, quantization="sq8")
    index.delete(e.where("label = 2").select("vec_id")).consolidate()
    again = Catalog(spark, index.root).load_index("embeddings", "idx", e)
    return out(again.search(vector(spark, sf), 10, search_complexity=1_000_000))


# inverted lists

STRIDE = "st AS (SELECT embedding, row_number() OVER (ORDER BY vec_id) - 1 AS cell FROM (SELECT e.*, row_number() OVER (ORDER BY vec_id) - 1 AS pos, count(*) OVER () AS n FROM embeddings e) WHERE pos IN (SELECT (i * n2) // 16 FROM range(16) t(i), (SELECT count(*) AS n2 FROM embeddings)))"
ASSIGN = f"a AS (SELECT vec_id, label, embedding, cell FROM (SELECT e.vec_id, e.label, e.embedding, st.cell, row_number() OVER (PARTITION BY e.vec_id ORDER BY {fold('e.embedding', 'st.embedding', 'l2')}, st.cell) AS rk FROM embeddings e, st) WHERE rk = 1)"


def celled(spark, sf):
    e = rows(spark, sf)
    centroids = [[float(x) for x in r[1]] for r in sorted(ivf.stride_sample(e, 16).select("vec_id", "embedding").collect())]
    return ivf.assign(e, centroids), centroids


@query("ivf_stride_sample", "SELECT vec_id FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS pos FROM embeddings) WHERE pos IN (SELECT (i * n) // 16 FROM range(16) t(i), (SELECT count(*) AS n FROM embeddings))")
def _(spark, sf):
    return ivf.stride_sample(rows(spark, sf), 16).select("vec_id")


@query("ivf_assign", f"WITH {STRIDE}, {ASSIGN} SELECT vec_id, cell::INTEGER AS cell FROM a")
def _(spark, sf):
    return celled(spark, sf)[0].select("vec_id", "cell")


@query(
    "ivf_search_nprobe1",
    f"WITH {STRIDE}, {ASSIGN}, {Q0}, pr AS (SELECT cell FROM st, q ORDER BY {fold('embedding', 'qv', 'l2')}, cell LIMIT 1) SELECT vec_id, label, {L2} AS d FROM a, q WHERE cell IN (SELECT cell FROM pr) ORDER BY d, vec_id LIMIT 5",
)
def _(spark, sf):
    cells, centroids = celled(spark, sf)
    path = shared_dir(spark) + "/cells"
    cells.write.partitionBy("cell").parquet(path)  # other cells' folders aren't read
    return out(ivf.ivf_search(spark.read.parquet(path), vector(spark, sf), 5, centroids, nprobe=1))


@query("ivf_search_all_cells", top(L2))
def _(spark, sf):
    index = flat(spark, sf, description="IVF8,Flat", nprobe=8, train_sample=200)
    return out(index.search(vector(spark, sf), 10))


# text and fusion

BM25 = f"""w AS (SELECT unnest(['the', 'with', 'this']) AS t, unnest([1, 2, 3]) AS o), tok AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '([\\p{{L}}\\p{{N}}]+)', 1) AS ts FROM documents),
st AS (SELECT count(*)::DOUBLE AS n, avg(len(ts)) AS mean FROM tok), tf AS (SELECT doc_id, len(ts) AS l, t, o, len(list_filter(ts, lambda x: x = t)) AS tf FROM tok, w),
df AS (SELECT t, count(*) FILTER (WHERE tf > 0)::DOUBLE AS df FROM tf GROUP BY t),
sc AS (SELECT doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * l / mean)) ORDER BY o), 6) AS score FROM tf JOIN df USING (t), st GROUP BY doc_id HAVING max(tf) > 0),
bm AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rk FROM sc)"""
NEAR = f"vr AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY {L2}, vec_id) AS rk FROM embeddings, q)"


def rrf(a: float, b: float) -> str:
    return f"""WITH {Q0}, {BM25}, {NEAR}, f AS (SELECT doc_id, coalesce(b.rk, 0)::INTEGER AS bm25_rank, coalesce(v.rk, 0)::INTEGER AS vector_rank FROM (SELECT * FROM bm WHERE rk <= 50) b FULL OUTER JOIN (SELECT * FROM vr WHERE rk <= 50) v USING (doc_id)),
    s AS (SELECT doc_id, bm25_rank, vector_rank, (CASE WHEN bm25_rank > 0 THEN {a}::DOUBLE / (60.0::DOUBLE + bm25_rank) ELSE 0 END) + (CASE WHEN vector_rank > 0 THEN {b}::DOUBLE / (60.0::DOUBLE + vector_rank) ELSE 0 END) AS rrf FROM f)
    SELECT doc_id, lang, bm25_rank, vector_rank, round(rrf, 9) AS rrf_score FROM (SELECT * FROM s ORDER BY rrf DESC, doc_id LIMIT 20) JOIN documents USING (doc_id)"""


def blended(spark, sf, text=TEXT, **weights):
    found = hybrid.hybrid_search(rows(spark, sf, "documents"), rows(spark, sf), vector(spark, sf), text, **weights)
    return found.select("doc_id", "lang", F.col("_bm25_rank").alias("bm25_rank"), F.col("_vector_rank").alias("vector_rank"), F.round("_rrf_score", 9).alias("rrf_score"))


@query("bm25_topn", f"WITH {BM25} SELECT doc_id, rk::INTEGER AS rk FROM bm WHERE rk <= 50")
def _(spark, sf):
    found = hybrid.bm25_top(rows(spark, sf, "documents"), TEXT, 60).withColumn("score", F.round("score", 6))
    return found.select(F.col("id").alias("doc_id"), F.row_number().over(Window.orderBy(F.col("score").desc(), "id")).alias("rk")).where("rk <= 50")


@query("hybrid_rrf", rrf(0.3, 0.7))
def _(spark, sf):
    return blended(spark, sf)


@query("hybrid_weights", rrf(0.8, 0.2))
def _(spark, sf):
    return blended(spark, sf, bm25_weight=0.8, vector_weight=0.2)


BOTH = "(SELECT vec_id AS doc_id FROM embeddings)"


@query("hybrid_index_search", rrf(0.3, 0.7).replace("AS ts FROM documents", f"AS ts FROM documents SEMI JOIN {BOTH} USING (doc_id)").replace("FROM embeddings, q)", "FROM embeddings, q WHERE vec_id IN (SELECT doc_id FROM documents))"))
def _(spark, sf):
    """The SQL call: text columns as named, vectors by the walk of the graph index."""
    base = rows(spark, sf, "documents").join(rows(spark, sf).select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id")
    base.createOrReplaceTempView("hybrid_base")
    c = catalog(spark)
    c.create_index(base.select("doc_id", "embedding"), "idx", "hybrid_base", "embedding", "doc_id", "DISKANN", max_degree=24, build_complexity=48)
    q = ", ".join(f"{x!r}D" for x in vector(spark, sf))
    found = sqlfuncs.ann_sql(c, f"SELECT * FROM hybrid_search('hybrid_base', 'idx', 'embedding', 'doc_id', [{q}], '{TEXT}', text_columns := ['text'], search_complexity := 1000000)")
    return found.select("doc_id", "lang", F.col("_bm25_rank").alias("bm25_rank"), F.col("_vector_rank").alias("vector_rank"), F.round("_rrf_score", 9).alias("rrf_score"))


@query("hybrid_vector_only", f"WITH {Q0}, {NEAR} SELECT doc_id, lang, 0 AS bm25_rank, rk::INTEGER AS vector_rank, round(0.7::DOUBLE / (60.0::DOUBLE + rk), 9) AS rrf_score FROM vr JOIN documents USING (doc_id) WHERE rk <= 20")
def _(spark, sf):
    return blended(spark, sf, text="???")


# graphs

PARAMS = graph.GraphParams(max_degree=24, build_complexity=48)


def graphed(spark, sf, **how):
    return written(graph.build_graph(rows(spark, sf), PARAMS, **how), "graph")


@query("graph_search_exhaustive", top(L2))
def _(spark, sf):
    hits = graph.graph_search(graphed(spark, sf), [(0, vector(spark, sf))], 10, search_complexity=1_000_000, params=PARAMS)
    return hits.join(rows(spark, sf), F.col("id") == F.col("vec_id")).select("vec_id", "label", F.col("_distance").alias("d"))


@query("graph_index_search", top(L2, more="WHERE label <> 5"))
def _(spark, sf):
    e = rows(spark, sf)
    index = catalog(spark).create_index(e, "idx", "embeddings", "embedding", "vec_id", "DISKANN", max_degree=24, build_complexity=48, metric="l2")
    index.delete(e.where("label = 5").select("vec_id"))
    return out(index.search(vector(spark, sf), 10, search_complexity=1_000_000))


@query("graph_readded_ids", f"WITH {Q0}, n AS (SELECT vec_id, label, CASE WHEN label = 5 THEN list_transform(embedding, lambda x: -x) ELSE embedding END AS embedding FROM embeddings) SELECT vec_id, label, {L2} AS d FROM n, q ORDER BY d, vec_id LIMIT 10")
def _(spark, sf):
    """Deleted ids that come back with other vectors are found by the new ones alone."""
    e = rows(spark, sf)
    index = catalog(spark).create_index(e, "idx", "embeddings", "embedding", "vec_id", "DISKANN", max_degree=24, build_complexity=48)
    index.delete(e.where("label = 5").select("vec_id"))
    index.append(e.where("label = 5").withColumn("embedding", F.transform("embedding", lambda x: -x)))
    return out(index.search(vector(spark, sf), 10, search_complexity=1_000_000))


@query("diskann_index_scan", f"WITH {Q0} SELECT vec_id AS row_id, ({L2})::FLOAT AS distance FROM embeddings, q ORDER BY {L2}, vec_id LIMIT 10")
def _(spark, sf):
    c = catalog(spark)
    rows(spark, sf).createOrReplaceTempView("scanned_base")
    for name, engine in (("graph", "DISKANN"), ("flat", "FAISS")):
        c.create_index(rows(spark, sf), name, "scanned_base", "embedding", "vec_id", engine, max_degree=24, build_complexity=48)
    q = ", ".join(f"{x!r}D" for x in vector(spark, sf))
    try:
        sqlfuncs.ann_sql(c, f"SELECT * FROM diskann_index_scan('scanned_base', 'flat', [{q}], 10)")
    except ValueError as e:
        assert "is not a DiskANN index" in str(e)
    else:
        raise AssertionError("a FAISS index was scanned as a graph")
    return sqlfuncs.ann_sql(c, f"SELECT * FROM diskann_index_scan('scanned_base', 'graph', [{q}], 10, search_complexity := 1000000)")


def walked(spark, sf, found):
    many = [(r[0], r[1]) for r in rows(spark, sf).where(F.col("vec_id") % EACH == 0).select("vec_id", "embedding").collect()]
    got = graph.recall(found(many), knn.nearest_pairs(many, rows(spark, sf), 10))
    return got.select((F.col("recall") >= 0.9).alias("enough"), "pairs")


PAIRS = f"SELECT true AS enough, 10 * count(*) AS pairs FROM embeddings WHERE vec_id % {EACH} = 0"


@query("recall_at_10", PAIRS)
def _(spark, sf):
    """Walks at the default list, in lock-step, find nine tenths of the exact pairs at least."""
    return walked(spark, sf, lambda many: graph.graph_search(graphed(spark, sf), many, 10, params=PARAMS))


@query("recall_after_consolidation", PAIRS)
def _(spark, sf):
    """The same after rows that were in the graph have been taken out of it in place."""
    e = rows(spark, sf)
    more = e.unionByName(e.where("vec_id % 4 = 1").withColumn("vec_id", F.col("vec_id") + 10_000_000))
    g = written(graph.build_graph(more, PARAMS), "graph")
    left = written(graph.drop_deleted(g, more.where("vec_id >= 10000000").select("vec_id"), PARAMS), "left")
    return walked(spark, sf, lambda many: graph.graph_search(left, many, 10, params=PARAMS))


@query("recall_by_starts", "SELECT start, true AS enough FROM (VALUES ('medoid'), ('random'), ('sample'), ('latin'), ('layers')) t(start)")
def _(spark, sf):
    from dataclasses import replace

    many = [(r[0], r[1]) for r in rows(spark, sf).where(F.col("vec_id") % EACH == 0).select("vec_id", "embedding").collect()]
    exact, got = written(knn.nearest_pairs(many, rows(spark, sf), 10), "exact"), None  # once, not for each kind
    for kind in ("medoid", "random", "sample", "latin", "layers"):
        p = replace(PARAMS, layers=True) if kind == "layers" else replace(PARAMS, start=kind, starts=4)
        g = written(graph.build_graph(rows(spark, sf), p), "graph")
        one = graph.recall(graph.graph_search(g, many, 10, params=p), exact).select(F.lit(kind).alias("start"), (F.col("recall") >= 0.9).alias("enough"))
        got = one if got is None else got.unionByName(one)
    return got


@query("graph_filtered_search", f"SELECT true AS enough, true AS filtered, count(*) AS pairs FROM (WITH {MANY} SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY {L2}, vec_id) AS rk FROM embeddings, q WHERE label = 3) WHERE rk <= 5")
def _(spark, sf):
    """Walks that see only the rows of a label."""
    e = rows(spark, sf)
    many = [(r[0], r[1]) for r in e.where(F.col("vec_id") % EACH == 0).select("vec_id", "embedding").collect()]
    found = written(graph.graph_search(graphed(spark, sf, attr_col="label"), many, 5, params=PARAMS, attr=3), "found")
    labels = found.join(e, F.col("id") == F.col("vec_id")).agg(F.bool_and(F.col("label") == 3).alias("filtered"))
    got = graph.recall(found, knn.nearest_pairs(many, e.where("label = 3"), 5))
    return got.crossJoin(labels).select((F.col("recall") >= 0.9).alias("enough"), "filtered", "pairs")  # one row each


@query("graph_degree_stats", "SELECT count(*) AS nodes, true AS bounded, true AS linked FROM embeddings")
def _(spark, sf):
    """Nodes, whether none is over the degree but by the edge that keeps one reachable, and whether all have one."""
    s = graph.degree_stats(graphed(spark, sf))
    return s.select("nodes", (F.col("max_degree") <= PARAMS.max_degree + 2).alias("bounded"), (F.col("min_degree") >= 1).alias("linked"))


@query("graph_reachable", "SELECT count(*) AS nodes, count(*) AS reached FROM embeddings")
def _(spark, sf):
    return graph.reachable(graphed(spark, sf)).agg(F.sum("nodes").alias("nodes"), F.sum("reached").alias("reached"))


@query("hnsw_alias_search", top(L2))
def _(spark, sf):
    index = flat(spark, sf, description="HNSW12", build_complexity=48)
    return out(index.search(vector(spark, sf), 10, search_complexity=1_000_000))


@query(
    "medoid",
    f"WITH m AS (SELECT pos, (sum(x::DECIMAL(38, 18)) / count(*))::DOUBLE AS m FROM (SELECT unnest(range(len(embedding))) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY pos), q AS (SELECT list(m ORDER BY pos) AS qv FROM m) SELECT vec_id, label FROM embeddings, q ORDER BY {L2}, vec_id LIMIT 1",
)
def _(spark, sf):
    return graph.medoid(rows(spark, sf)).select("vec_id", "label")


# files


def vector_file(spark, sf) -> str:
    path = shared_dir(spark) + "/vectors.bin"
    binary_formats.write_vectors(spark, rows(spark, sf), path)
    return path


@query("read_vector_file", f"WITH {Q0} SELECT vec_id, {L2} AS d FROM embeddings, q")
def _(spark, sf):
    v = binary_formats.read_vectors(spark, vector_file(spark, sf)).select(F.col("row").alias("vec_id"), "vector")
    return out(knn.vector_distances(v, vector(spark, sf)), "vec_id", "d")


@query("streaming_build", "SELECT count(*)::INTEGER AS num_vectors, 64::INTEGER AS dimension, least(count(*), greatest(floor(sqrt(count(*))), 1000))::INTEGER AS sample_size FROM embeddings")
def _(spark, sf):
    return binary_formats.streaming_build(spark, vector_file(spark, sf), shared_dir(spark) + "/graph.dann", max_degree=16, build_complexity=24)


@query("graph_file_search", top(L2))
def _(spark, sf):
    path = shared_dir(spark) + "/graph.dann"
    binary_formats.streaming_build(spark, vector_file(spark, sf), path, max_degree=16, build_complexity=24).collect()
    hits = graph.graph_search(binary_formats.read_graph(spark, path), [(0, vector(spark, sf))], 10, search_complexity=1_000_000)
    return hits.join(rows(spark, sf), F.col("id") == F.col("vec_id")).select("vec_id", "label", F.col("_distance").alias("d"))


# the host's operators around a search


@query("knn_label_vote", f"WITH {MANY}, {RANKED}, v AS (SELECT qid, label, count(*) AS n, row_number() OVER (PARTITION BY qid ORDER BY count(*) DESC, label) AS vr FROM r WHERE rk BETWEEN 2 AND 16 GROUP BY qid, label) SELECT qid, label, n FROM v WHERE vr = 1")
def _(spark, sf):
    e = rows(spark, sf)
    many = [(r[0], r[1]) for r in e.where(F.col("vec_id") % EACH == 0).select("vec_id", "embedding").collect()]
    hits = knn.nearest_pairs(many, e, 16).where("_rank >= 2").join(e, F.col("id") == F.col("vec_id"))
    votes = hits.groupBy(F.col("query_idx").alias("qid"), "label").agg(F.count(F.lit(1)).alias("n"))
    best = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("n").desc(), "label"))
    return votes.withColumn("_r", best).where("_r = 1").drop("_r")


@query("range_join_queries", f"WITH {MANY} SELECT qid, vec_id, {L2} AS d FROM embeddings, q WHERE {L2} <= 1.5 AND qid <> vec_id")
def _(spark, sf):
    e = rows(spark, sf)
    many = [(r[0], r[1]) for r in e.where(F.col("vec_id") % EACH == 0).select("vec_id", "embedding").collect()]
    near = knn.range_pairs(many, e, 1.5).where("query_idx <> id")
    return near.select(F.col("query_idx").alias("qid"), F.col("id").alias("vec_id"), F.col("_distance").alias("d"))


@query("knn_events_topk", f"WITH {Q0}, s AS (SELECT vec_id, {L2} AS d FROM embeddings, q ORDER BY d, vec_id LIMIT 50) SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events JOIN s ON user_id = vec_id GROUP BY event_type")
def _(spark, sf):
    near = knn.search(rows(spark, sf), vector(spark, sf), 50).select("vec_id")
    ev = rows(spark, sf, "events")
    return ev.join(near, ev["user_id"] == near["vec_id"]).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))

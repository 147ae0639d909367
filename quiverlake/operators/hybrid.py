"""BM25 ranking, and its fusion with vector ranking by reciprocal ranks.

Only the query's words are counted, inside the row, and the counts are kept:
a corpus is read and taken apart once. Document frequencies, the mean length and
the scores under a partial top-k come from the counts.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Textbook parameters, and the constant of reciprocal rank fusion.
K1, B, RRF = 1.2, 0.75, 60
#: Hits whose documents are asked for by a list of ids.
LISTED = 1000
#: Runs of letters and digits of any script.
TOKEN = r"([\p{L}\p{N}]+)"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(1))


def query_terms(query: str) -> list[str]:
    """The distinct tokens of a query, in order."""
    return list(dict.fromkeys(re.findall(r"[^\W_]+", query.lower())))


def times(words: Column, term: str) -> Column:
    """How often a term is among words."""
    return F.size(F.filter(words, lambda x: x == F.lit(term)))


def bm25_top(docs: DataFrame, query: str, n: int, *, id_col: str = "doc_id", text_col: str | Column = "text") -> DataFrame:
    """(id, score, rank): the n documents of the best BM25 score among those that hold a word of the query, ties by id. Null texts are empty documents."""
    from ..sources.scratch import written

    terms = query_terms(query)
    rows = docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col) if isinstance(text_col, str) else text_col).alias("_t"))
    counted = rows.select("id", F.size("_t").alias("_len"), *[times(F.col("_t"), t).alias(f"_tf{k}") for k, t in enumerate(terms)])
    if not terms:
        return counted.select("id", F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    counted = written(counted, "counts")  # else each filter and sum would take the texts apart anew
    stats = counted.agg(F.count(F.lit(1)), F.avg("_len"), *[F.sum((F.col(f"_tf{k}") > 0).cast("long")) for k in range(len(terms))]).first()
    total, mean = stats[0], stats[1] or 1.0
    score = F.lit(0.0)
    for k in range(len(terms)):
        df, tf = stats[2 + k] or 0, F.col(f"_tf{k}")
        idf = F.log((F.lit(float(total)) - df + 0.5) / (F.lit(float(df)) + 0.5) + 1)
        score = score + idf * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * F.col("_len") / F.lit(float(mean))))
    some = F.greatest(*[F.col(f"_tf{k}") for k in range(len(terms))], F.lit(0)) > 0
    from pyspark.sql import Window

    top = counted.where(some).select("id", F.round(score, 9).alias("score")).orderBy(F.col("score").desc(), "id").limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "id")))  # n rows


def fused(bm25: DataFrame | None, vector: DataFrame | None, *, bm25_weight: float = 0.3, vector_weight: float = 0.7) -> DataFrame:
    """(id, _rrf_score, _bm25_rank, _vector_rank) of two rankings (id, rank); rank 0 says that the ranking lacks the id."""
    some = (bm25 if bm25 is not None else vector).select("id", "rank")
    a = some.withColumnRenamed("rank", "a") if bm25 is not None else some.select("id", F.lit(None).cast("int").alias("a")).limit(0)
    b = vector.select("id", F.col("rank").alias("b")) if vector is not None else some.select("id", F.lit(None).cast("int").alias("b")).limit(0)
    both = a.join(b, "id", "full_outer").fillna(0, ["a", "b"])
    part = lambda c, w: F.when(F.col(c) > 0, F.lit(float(w)) / (F.lit(float(RRF)) + F.col(c))).otherwise(0.0)
    return both.select("id", (part("a", bm25_weight) + part("b", vector_weight)).alias("_rrf_score"), F.col("a").cast("int").alias("_bm25_rank"), F.col("b").cast("int").alias("_vector_rank"))


def hybrid_search(docs: DataFrame, vectors: DataFrame | None, query_vec: Sequence[float], query_text: str, *, k: int = 20, bm25_weight: float = 0.3, vector_weight: float = 0.7, bm25_candidates: int = 50, vector_candidates: int = 50, id_col: str = "doc_id", text_col: str | Column = "text", vec_id_col: str = "vec_id", vec_col: str = "embedding", metric: str = "l2", near: DataFrame | None = None) -> DataFrame:
    """docs' columns with `_rrf_score`, `_bm25_rank`, `_vector_rank`: the k best of both rankings together, ties by id. A text without tokens leaves the vector ranking alone. near(id, rank): a vector ranking found elsewhere, as by an index."""
    from pyspark.sql import Window

    from ..sources.scratch import written
    from .knn import search

    if near is None:
        near = search(vectors, query_vec, vector_candidates, metric=metric, id_col=vec_id_col, vec_col=vec_col).select(F.col(vec_id_col).alias("id"), "_distance")
        order = F.col("_distance").asc() if metric.lower().startswith("l2") else F.col("_distance").desc()
        near = near.withColumn("rank", F.row_number().over(Window.orderBy(order, "id")))  # vector_candidates rows
    ranked = near.select("id", "rank")
    words = bm25_top(docs, query_text, bm25_candidates, id_col=id_col, text_col=text_col) if query_terms(query_text) else None
    best = fused(words, ranked, bm25_weight=bm25_weight, vector_weight=vector_weight).orderBy(F.col("_rrf_score").desc(), "id").limit(k)
    hits = written(best.withColumnRenamed("id", "__id"), "hits")
    if k <= LISTED:  # as literals they go to the scans, also to those below docs' own joins
        docs = docs.where(F.col(id_col).isin([r[0] for r in hits.select("__id").collect()]))
    return docs.join(F.broadcast(hits), F.col("__id") == docs[id_col]).drop("__id")

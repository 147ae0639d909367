"""The SQL surface: distance functions, a table function on TABLE arguments, and calls of the index functions in FROM."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, DoubleType, Row, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from . import vectors as V

#: Bodies of the scalar functions, as Spark expressions that Catalyst inlines. Fixed values.
DOT = "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"
SCALARS = {
    "distance": "sqrt(aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x))",
    "inner_product": DOT,
    "negative_inner_product": f"-{DOT}",
    "cosine_similarity": f"{DOT} / (sqrt(aggregate(transform(a, x -> x * x), 0D, (s, x) -> s + x)) * sqrt(aggregate(transform(b, x -> x * x), 0D, (s, x) -> s + x)))",
}


@udtf
class VectorDistances:
    """vector_distances(TABLE(...), query, metric): the input's columns and `_distance`; the input keeps its partitions."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, query: AnalyzeArgument, metric: AnalyzeArgument) -> AnalyzeResult:
        schema = StructType(list(rows.dataType.fields))
        if not any(isinstance(f.dataType, ArrayType) and isinstance(f.dataType.elementType, V.NUMERIC) for f in schema.fields):
            raise Exception("vector_distances: input table must have a numeric LIST or ARRAY column")
        return AnalyzeResult(schema.add("_distance", DoubleType()))

    def eval(self, row: Row, query: list, metric: str):
        vec = next(v for v in row if isinstance(v, list))
        good = vec is not None and len(vec) == len(query) and all(x is not None for x in vec)
        vec = [float(x) for x in vec] if good else [0.0] * len(query)
        total = 0.0
        for x, y in zip(vec, query):
            total += x * float(y) if metric.lower() in V.IP_NAMES else (x - float(y)) * (x - float(y))
        yield (*row, -total if metric.lower() in V.IP_NAMES else total)


def register(spark: SparkSession) -> None:
    """Makes array_distance, list_distance and their like, and vector_distances, callable in Spark SQL."""
    for family in ("array", "list"):
        for name, body in SCALARS.items():
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {family}_{name}(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN {body}")
    spark.udtf.register("vector_distances", VectorDistances)


CALLS = ("ann_search_batch", "ann_search_table", "ann_search", "diskann_index_scan", "faiss_index_scan", "hybrid_search", "ann_list", "ann_index_info", "faiss_gpu_info", "diskann_streaming_build", "vector_distances")


def arguments(text: str) -> list[str]:
    """Arguments at the top level of a call."""
    out, depth, quote, last = [], 0, "", 0
    for k, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c == "," and not depth:
            out.append(text[last:k].strip())
            last = k + 1
    rest = text[last:].strip()
    return [*out, rest] if rest else out


def plain(text: str) -> str:
    """The text with the insides of its string literals and quoted names blanked out, place for place."""
    return re.sub(r"'(?:[^'\\]|\\.|'')*'|\"[^\"]*\"|`[^`]*`", lambda m: m[0][0] + " " * (len(m[0]) - 2) + m[0][-1], text)


def closing(text: str, start: int, name: str) -> int:
    """The place after the parenthesis that closes the one before `start`."""
    depth = 1
    for k, c in enumerate(plain(text)[start:], start):
        depth += (c == "(") - (c == ")")
        if not depth:
            return k + 1
    raise ValueError(f"{name}: unbalanced parentheses")


def bracketed(expression: str) -> str:
    """[..] written as array(..), but not inside string literals."""
    bare = plain(expression)
    return "".join({"[": "array(", "]": ")"}.get(b, c) for b, c in zip(bare, expression))


def ann_sql(catalog, text: str) -> DataFrame:
    """A statement whose FROM may call the index functions; each call becomes a view of its result and the rest is Spark's."""
    from ..operators import knn
    from ..operators.hybrid import hybrid_search
    from ..sources import binary_formats
    from ..sources.catalog import gpu_info

    spark = catalog.spark
    number = 0
    while m := re.search(r"\b(" + "|".join(CALLS) + r")\s*\(", plain(text), re.I):
        k = closing(text, m.end(), m[1])
        places, named = [], {}
        for a in arguments(text[m.end() : k - 1]):
            if n := re.match(r"(\w+)\s*(?::=|=>)\s*(.*)", a, re.S):
                named[n[1].lower()] = n[2]
            else:
                places.append(a)

        def value(a: str):
            return spark.sql(f"SELECT {bracketed(a)} AS v").first()[0]

        def rows(a: str) -> DataFrame:
            a = re.sub(r"^TABLE\b", "", a, flags=re.I).strip()
            while a.startswith("(") and closing(a, 1, m[1]) == len(a):
                a = a[1:-1].strip()
            return spark.table(a) if re.fullmatch(r"[\w.]+", a) else spark.sql(a)

        fn, kw = m[1].lower(), {n: value(v) for n, v in named.items()}
        if fn == "ann_search_table":
            args = [value(a) for a in places[1:]]
            out = catalog.load_index(args[0], args[1], spark.table(args[0])).search_table(rows(places[0]), args[2], **kw)
        elif fn == "vector_distances":
            args = [value(a) for a in places[1:]]
            out = knn.vector_distances(rows(places[0]), V.checked_vector(args[0]), metric=args[1] if len(args) > 1 else kw.pop("metric", "l2"), **kw)
        else:
            args = [value(a) for a in places]
            if fn in ("ann_list", "ann_index_info"):
                out = getattr(catalog, fn)()
            elif fn == "faiss_gpu_info":
                out = gpu_info(spark)
            elif fn == "diskann_streaming_build":
                out = binary_formats.streaming_build(spark, *args, **{("sample" if n == "sample_size" else n): v for n, v in kw.items()})
            elif fn == "hybrid_search":
                base = spark.table(args[0])
                index = catalog.load_index(args[0], args[1], base, engine="DISKANN")
                wide = kw.pop("search_complexity", 0)
                near = index.pairs([(0, V.checked_vector(args[4]))], kw.get("vector_candidates", 50), search_complexity=wide)
                words = kw.pop("text_columns", None) or [f.name for f in base.schema.fields if f.dataType.simpleString() == "string"]
                words = [words] if isinstance(words, str) else words
                text_col = F.concat_ws(" ", *words) if words else F.lit("")
                out = hybrid_search(base, None, args[4], args[5], id_col=args[3], text_col=text_col, near=near.select("id", F.col("_rank").alias("rank")), **kw)
            else:
                engine = "FAISS" if fn.startswith("faiss") else "DISKANN" if fn.startswith("diskann") else None
                index = catalog.load_index(args[0], args[1], spark.table(args[0]), engine=engine)
                call = {"ann_search": index.search, "ann_search_batch": index.search_batch}.get(fn, index.scan)
                query = [V.checked_vector(q) for q in args[2]] if fn == "ann_search_batch" else V.checked_vector(args[2])
                out = call(query, args[3], **kw)
        number += 1
        out.createOrReplaceTempView(view := f"_ann_call_{number}")
        text = f"{text[: m.start()]}{view}{text[k:]}"
    return spark.sql(text)

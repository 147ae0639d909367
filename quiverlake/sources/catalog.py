"""Vector indexes as Parquet segments under small manifests, and their catalogue.

An index is a folder <root>/<table>/<name>. Numbered manifests name its
segments, tombstones and options; the newest one counts, so a change is seen
whole or not at all, and a reader of an older one keeps its files until the
next vacuum. Vectors live in segments of (label, id, vector), by cell for
inverted lists, and as graph rows for graphs.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors as V
from ..operators import graph as G
from ..operators import ivf, knn, quantize
from . import files
from .scratch import written

#: Version of the storage; a manifest of another one isn't read.
STORAGE = 2
ENGINES = ("DISKANN", "FAISS")


def ids_mark(ids: Column) -> Column:
    """What tells sets of ids apart, whatever their order, and can be taken apart again: the exclusive or of their hashes."""
    return F.coalesce(F.bit_xor(F.xxhash64(ids.cast("long"))), F.lit(0).cast("long"))


@dataclass
class Options:
    """What CREATE INDEX takes. Unknown keys are ignored, as by the engines; unknown values of known keys are errors."""

    metric: str = "L2"
    max_degree: int = 64
    build_complexity: int = 128
    alpha: float = 1.2
    quantization: str = ""
    type: str = "Flat"
    hnsw_m: int = 32
    ivf_nlist: int = 100
    nprobe: int = 1
    train_sample: int = 0
    description: str = ""
    mode: str = "auto"

    @staticmethod
    def of(engine: str, given: dict) -> Options:
        o = Options(**{k: v for k, v in given.items() if k in Options.__dataclass_fields__})
        V.metric_name(o.metric)
        if "gpu" in given and "mode" not in given:
            o.mode = "gpu" if given["gpu"] else "cpu"
        o.mode = o.mode.lower()
        if o.mode not in ("cpu", "gpu", "auto"):
            raise ValueError(f"Invalid mode '{o.mode}': expected 'cpu', 'gpu', or 'auto'")
        if engine == "FAISS" and o.mode == "gpu":
            raise ValueError("mode='gpu' requested but no GPU backend available")
        if engine == "FAISS" and o.description:
            o.parse_description()
        o.nprobe = max(1, o.nprobe)
        o.type = {"hnsw": "HNSW", "ivfflat": "IVFFlat"}.get(o.type.lower(), "Flat")
        return o

    def parse_description(self) -> None:
        """Factory strings: Flat, IVF<n>,Flat, HNSW<m>, SQ8 and IVF<n>,SQ8."""
        import re

        m = re.fullmatch(r"(?:IVF(\d+),)?(Flat|SQ8)|HNSW(\d+)(?:,Flat)?", self.description)
        if not m:
            raise ValueError(f"could not parse index string {self.description}")
        if m[3]:
            self.type, self.hnsw_m = "HNSW", int(m[3])
        else:
            self.type = "IVFFlat" if m[1] else "Flat"
            self.ivf_nlist = int(m[1] or self.ivf_nlist)
            self.quantization = "sq8" if m[2] == "SQ8" else ""


@dataclass
class Manifest:
    name: str
    table: str
    engine: str
    vec_col: str
    id_col: str
    dim: int
    options: dict
    segments: list[str] = field(default_factory=list)
    tombstones: list[str] = field(default_factory=list)
    n_vectors: int = 0
    n_skipped: int = 0
    centroids: list[list[float]] = field(default_factory=list)
    sq8: list[list[float]] = field(default_factory=list)
    n_deleted: int = 0
    ids_mark: int = 0
    storage: int = STORAGE
    version: int = 0


class Index:
    """A handle on an index. `base` is the table it was made from, for searches that return its columns."""

    def __init__(self, spark: SparkSession, root: str, manifest: Manifest, base: DataFrame | None = None) -> None:
        self.spark, self.root, self.m, self.base = spark, root, manifest, base
        self.options = Options(**manifest.options)

    @property
    def path(self) -> str:
        return f"{self.root}/{self.m.table}/{self.m.name}"

    @property
    def is_graph(self) -> bool:
        return self.m.engine == "DISKANN" or self.options.type == "HNSW"

    @property
    def metric(self) -> str:
        return V.metric_name(self.options.metric)

    @property
    def quantized(self) -> bool:
        return self.options.quantization.lower() == "sq8"

    # storage

    def _commit(self) -> None:
        self.m.version += 1
        files.claim(self.spark, f"{self.path}/claim-{self.m.version:08d}")
        files.put(self.spark, f"{self.path}/manifest-{self.m.version:08d}.json", json.dumps(asdict(self.m)).encode())

    def _segment(self, df: DataFrame, kind: str = "segment") -> str:
        name = f"{kind}-{uuid.uuid4().hex}"
        out = df.write
        if kind == "segment" and "cell" in df.columns:
            out = df.repartition("cell").write.partitionBy("cell")
        out.parquet(f"{self.path}/{name}")
        return name

    def _read(self, names: list[str], schema: str) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.path}/{n}" for n in names]
        if "cell int" not in schema:
            return self.spark.read.parquet(*paths)  # one scan, however many segments
        out = self.spark.read.parquet(paths[0])
        for p in paths[1:]:  # folders by cell can't be read together
            out = out.unionByName(self.spark.read.parquet(p))
        return out

    def _schema(self) -> str:
        if self.is_graph:
            return G.SHARDS
        return "label long, id long, " + ("codes array<tinyint>" if self.quantized else "vector array<float>") + (", cell int" if self.options.type == "IVFFlat" else "")

    def dead(self) -> DataFrame:
        """(shard, label) of what was deleted; shard is 0 but in graphs."""
        return self._read(self.m.tombstones, "shard int, label long")

    def places(self) -> DataFrame:
        """(shard, label, id) of all vectors, deleted ones too."""
        rows = self._read(self.m.segments, self._schema())
        if self.is_graph:
            return rows.select("shard", F.posexplode("ids").alias("label", "id")).select("shard", F.col("label").cast("long").alias("label"), "id")
        return rows.select(F.lit(0).alias("shard"), "label", "id")

    def present(self) -> DataFrame:
        """(shard, label, id) of all but the deleted vectors."""
        return self.places().join(self.dead().distinct(), ["shard", "label"], "left_anti") if self.m.tombstones else self.places()

    def live(self) -> DataFrame:
        """(label, id, vector) and shard or cell of all but the deleted rows, which are taken out before any search counts to k. Vectors of codes are what the codes say."""
        rows = self._read(self.m.segments, self._schema())
        rows = G.rows_of(rows) if self.is_graph else rows
        if self.m.tombstones:
            dead = self.dead() if self.is_graph else self.dead().select("label")
            rows = rows.join(dead.distinct(), dead.columns, "left_anti")
        if self.quantized and not self.is_graph:
            vector = quantize.restored(F.col("codes"), *self.m.sq8) if self.m.sq8 else F.col("codes").cast("array<double>")
            rows = rows.withColumn("vector", vector).drop("codes")
        return rows

    def _rows(self, df: DataFrame) -> tuple[DataFrame, int]:
        """(id, vector) of the rows to index, and how many null vectors were left out. A wrong length is an error."""
        some = df.select(F.col(self.m.id_col).cast("long").alias("id"), F.col(self.m.vec_col).cast("array<float>").alias("vector"))
        c = some.agg(F.count(F.lit(1)), F.sum(F.col("vector").isNull().cast("long")), F.max(F.size("vector")), F.min(F.when(F.col("vector").isNotNull(), F.size("vector"))), F.count_distinct("id"), ids_mark(F.col("id"))).first()
        if c[0] and self.m.dim == 0:
            self.m.dim = c[2]
        if (c[2] or self.m.dim) != self.m.dim and (c[2] or -1) >= 0 or c[3] is not None and c[3] != self.m.dim:
            raise ValueError(f"vector dimension mismatch: index has {self.m.dim}")
        if c[4] != c[0]:
            raise ValueError(f"{self.m.id_col} must be unique")
        self._apart(some)
        self.m.ids_mark ^= c[5]
        return some.where("vector is not null"), c[1] or 0

    def _apart(self, rows: DataFrame) -> None:
        """An error if the index holds one of these ids already."""
        if self.m.n_vectors > self.m.n_deleted:
            if not self.present().join(rows.select("id"), "id", "left_semi").isEmpty():
                raise ValueError(f"{self.m.id_col} must be unique: the index has some of these rows already")

    def covers(self, df: DataFrame) -> bool:
        """Whether the index was told of just the rows that df has now, by their number and ids; vectors that changed under their id aren't noticed."""
        n, mark = df.agg(F.count(F.lit(1)), ids_mark(F.col(self.m.id_col))).first()
        return n == self.m.n_vectors - self.m.n_deleted + self.m.n_skipped and mark == self.m.ids_mark

    def add(self, df: DataFrame) -> Index:
        """Appends the rows of df as a new segment; cells are those of the trained centroids."""
        rows, skipped = self._rows(df)
        rows = written(rows, "rows")
        n = rows.count()
        if n:
            self._add(rows, n)
        self.m.n_skipped += skipped
        self._commit()
        return self

    append = add

    def _add(self, rows: DataFrame, n: int) -> None:
        o = self.options
        if self.quantized and not self.m.sq8:
            self.m.sq8 = list(quantize.params_arrays(quantize.sq8_params(rows, "vector")))
        sq8 = tuple(self.m.sq8) if self.quantized else None
        if self.is_graph:
            first = int(self._read(self.m.segments, self._schema()).agg(F.max("shard")).first()[0] or 0) + 1 if self.m.segments else 0
            made = G.build_graph(rows, self.graph_params(), id_col="id", vec_col="vector", sq8=sq8)
            self.m.segments.append(self._segment(made.withColumn("shard", F.col("shard") + first)))
        else:
            if o.type == "IVFFlat" and not self.m.centroids:
                sample = ivf.stride_sample(rows, o.train_sample, id_col="id")
                self.m.centroids = ivf.k_means(sample, min(o.ivf_nlist, n), vec_col="vector", id_col="id")
            ranged = written(rows.repartitionByRange("id").withColumn("_p", F.spark_partition_id()), "ranged")
            start, base = self.m.n_vectors, []
            for part, size in sorted((r[0], r[1]) for r in ranged.groupBy("_p").count().collect()):
                base.append((part, start))
                start += size
            place = F.row_number().over(Window.partitionBy("_p").orderBy("id")) - 1
            labelled = ranged.withColumn("_o", place).join(F.broadcast(self.spark.createDataFrame(base, "_p int, _b long")), "_p").select((F.col("_b") + F.col("_o")).alias("label"), "id", "vector")
            if o.type == "IVFFlat":
                labelled = ivf.assign_fast(labelled, self.m.centroids, vec_col="vector")
            if sq8:
                labelled = labelled.withColumn("codes", quantize.stored(F.col("vector"), *sq8)).drop("vector")
            self.m.segments.append(self._segment(labelled))
        self.m.n_vectors += n

    def delete(self, ids: DataFrame) -> Index:
        """Marks the rows of these ids (first column) deleted; unknown ids are ignored. Vectors count until vacuum."""
        gone = ids.select(F.col(ids.columns[0]).cast("long").alias("id")).distinct()
        marks = written(self.present().join(gone, "id", "left_semi").select(F.col("shard").cast("int"), F.col("label").cast("long"), "id"), "marks")
        n, mark = marks.agg(F.count(F.lit(1)), ids_mark(F.col("id"))).first()
        if n:
            self.m.tombstones.append(self._segment(marks.drop("id"), "tombstones"))
            self.m.n_deleted += n
            self.m.ids_mark ^= mark
        self._commit()
        return self

    def consolidate(self) -> Index:
        """Takes deleted vectors out of the graphs in place: their neighbours are reconnected, nothing else is built anew. Other indexes are vacuumed."""
        if not self.is_graph:
            return self.vacuum()
        if self.m.tombstones:
            gone = self.places().join(self.dead().distinct(), ["shard", "label"], "left_semi")
            rows = self._read(self.m.segments, self._schema())
            # an id that was deleted and added again is another place
            lost = gone.groupBy("shard").agg(F.collect_list("label").alias("_gone"))
            left = G.without(rows, lost, self.graph_params())
            old = [*self.m.segments, *self.m.tombstones]
            self.m.segments, self.m.tombstones = [self._segment(left)], []
            self.m.n_vectors, self.m.n_deleted = self.m.n_vectors - self.m.n_deleted, 0
            self._commit()
            for name in old:
                files.remove(self.spark, f"{self.path}/{name}")
        return self

    def vacuum(self) -> Index:
        """Rebuilds without deleted rows, labels anew in the old order, cells trained again, codes kept as they are; older files go."""
        rows = written(self.live().select("id", F.col("vector").cast("array<double>" if self.quantized else "array<float>").alias("vector")), "kept")
        old = [*self.m.segments, *self.m.tombstones]
        self.m.segments, self.m.tombstones, self.m.n_vectors, self.m.n_deleted, self.m.centroids = [], [], 0, 0, []
        n = rows.count()
        if n:
            self._add(rows, n)
        self._commit()
        for name in old:
            files.remove(self.spark, f"{self.path}/{name}")
        return self

    def merge(self, other: Index) -> Index:
        """Adds the other index's live vectors; ids that both have are an error, and nothing is added."""
        rows = written(other.live().select("id", F.col("vector").cast("array<float>").alias("vector")), "merged")
        self._apart(rows)
        n, mark = rows.agg(F.count(F.lit(1)), ids_mark(F.col("id"))).first()
        self.m.ids_mark ^= mark
        if n:
            self._add(rows, n)
        self._commit()
        return self

    def checkpoint(self) -> Index:
        self._commit()
        return self

    def graph_params(self) -> G.GraphParams:
        o = self.options
        return G.GraphParams(max_degree=o.hnsw_m * 2 if self.m.engine == "FAISS" else o.max_degree, build_complexity=o.build_complexity, alpha=o.alpha, metric=self.metric, layers=self.m.engine == "FAISS")

    # search

    def pairs(self, queries: list[tuple[int, Sequence[float] | None]], k: int, *, search_complexity: int = 0) -> DataFrame:
        """(query_idx, id, _distance, _rank). Queries of another length than the index's, or null, find nothing."""
        good = [(i, q) for i, q in queries if q is not None and len(q) == self.m.dim]
        empty = "query_idx long, id long, _distance double, _rank int"
        if k <= 0 or not good or not self.m.n_vectors:
            return self.spark.createDataFrame([], empty)
        if self.is_graph:
            dead = self.dead().distinct() if self.m.n_deleted else None
            more = dead.groupBy("shard").count().agg(F.max("count")).first()[0] if self.m.n_deleted else 0
            found = G.hits(self._read(self.m.segments, self._schema()), good, k + more, search_complexity=search_complexity, params=self.graph_params())
            found = found if dead is None else found.join(dead, ["shard", "label"], "left_anti")
            return G.best(found, k, self.metric)
        rows = self.live()
        by: dict[tuple, list] = {}
        for i, q in good:
            # each query sees the cells it probes; queries that probe the same cells go together
            cells = sorted(ivf.probes(q, self.m.centroids, self.options.nprobe)) if self.options.type == "IVFFlat" else ()
            by.setdefault(tuple(cells), []).append((i, q))
        out = None
        for cells, own in by.items():
            some = rows.where(F.col("cell").isin(*cells)) if cells else rows
            if len(own) == 1:
                one = self._one(own[0][0], own[0][1], some, k)
            else:
                one = knn.nearest_pairs(own, some, k, metric=self.metric, id_col="id", vec_col="vector")
            out = one if out is None else out.unionByName(one)
        return out

    def _one(self, number: int, query: Sequence[float], rows: DataFrame, k: int) -> DataFrame:
        """pairs() of one query, as a partial top-k over the scan."""
        near = F.col("_distance").asc() if self.metric == "l2" else F.col("_distance").desc()
        found = knn.search(rows.select("id", "vector"), query, k, metric=self.metric, id_col="id", vec_col="vector")
        rank = F.row_number().over(Window.partitionBy("query_idx").orderBy(near, "id"))
        return found.select(F.lit(number).cast("long").alias("query_idx"), "id", "_distance").withColumn("_rank", rank)

    def scan(self, query: Sequence[float], k: int, *, search_complexity: int = 0) -> DataFrame:
        """(row_id, distance), nearest first: the raw index scan."""
        return self.pairs([(0, query)], k, search_complexity=search_complexity).orderBy("_rank").select(F.col("id").alias("row_id"), F.col("_distance").cast("float").alias("distance"))

    def _base(self) -> DataFrame:
        if self.base is None:
            self.base = self.spark.table(self.m.table)
        return self.base

    def search(self, query: Sequence[float], k: int, *, search_complexity: int = 0, oversample: int = 1) -> DataFrame:
        """All columns of the table and `_distance`: k * oversample rows, nearest first."""
        hits = self.pairs([(0, query)], k * max(1, oversample), search_complexity=search_complexity)
        order = F.col("_distance").desc() if self.metric == "cosine" or (self.metric == "ip" and not self.is_graph) else F.col("_distance").asc()
        return knn.fetched(hits, self._base(), self.m.id_col).drop("query_idx").orderBy(order, self.m.id_col)

    def search_batch(self, queries: Sequence[Sequence[float]], k: int, *, search_complexity: int = 0) -> DataFrame:
        if k <= 0:
            raise ValueError("Invalid nq/dimension/k")
        return knn.fetched(self.pairs(list(enumerate(queries)), k, search_complexity=search_complexity), self._base(), self.m.id_col)

    def search_table(self, queries: DataFrame, k: int, *, search_complexity: int = 0) -> DataFrame:
        return knn.joined_search(queries, self._base(), self.m.id_col, self.m.table, lambda rows: self.pairs(rows, k, search_complexity=search_complexity))

    def info(self) -> tuple:
        n, m = self.m.n_vectors, self.m
        memory = 16 * n + (1 if self.quantized else 4) * n * m.dim + (4 * n * self.graph_params().max_degree if self.is_graph else 0)
        return m.name, m.engine, m.table, n, m.n_deleted, max(1, memory), self.quantized


class Catalog:
    """All indexes below a folder."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def create_index(self, df: DataFrame, name: str, table: str, columns: str | Sequence[str], id_col: str, engine: str, *, if_not_exists: bool = False, unique: bool = False, **options) -> Index:
        """Builds and stores an index. The name is looked up before anything is built."""
        engine = engine.upper()
        if engine not in ENGINES:
            raise ValueError(f"Unknown index type: {engine}")
        if unique:
            raise ValueError(f"{engine} indexes do not support unique/primary key constraints")
        cols = [columns] if isinstance(columns, str) else list(columns)
        if len(cols) != 1:
            raise ValueError(f"{engine} index requires exactly one column")
        kind = df.schema[cols[0]].dataType
        if not (isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.FloatType, T.DoubleType))):
            raise ValueError(f"{engine} index column must be FLOAT[N] (fixed-size array)")
        if files.names(self.spark, f"{self.root}/{table}/{name}"):
            if if_not_exists:
                return self.load_index(table, name, df)
            raise ValueError(f'Index with name "{name}" already exists!')
        index = Index(self.spark, self.root, Manifest(name, table, engine, cols[0], id_col, 0, asdict(Options.of(engine, options))), df)
        return index.add(df)

    def load_index(self, table: str, name: str, base: DataFrame | None = None, *, engine: str | None = None) -> Index:
        """The index as its newest manifest has it."""
        path = f"{self.root}/{table}/{name}"
        kept = [n for n in files.names(self.spark, path) if n.startswith("manifest-") and n.endswith(".json")]
        if not kept:
            raise ValueError(f"ANN index '{name}' not found on table '{table}'")
        raw = json.loads(files.get(self.spark, f"{path}/{kept[-1]}"))
        if raw.get("storage") != STORAGE:
            raise ValueError(f"index storage version mismatch: found {raw.get('storage')}, expected {STORAGE}. Drop and recreate the index.")
        if engine and raw["engine"] != engine:
            raise ValueError(f"{engine} index '{name}' not found on table '{table}'" if engine == "FAISS" else f"Index '{name}' is not a DiskANN index")
        return Index(self.spark, self.root, Manifest(**raw), base)

    def drop_index(self, table: str, name: str, *, if_exists: bool = False) -> None:
        if not files.names(self.spark, f"{self.root}/{table}/{name}") and not if_exists:
            raise ValueError(f"ANN index '{name}' not found on table '{table}'")
        files.remove(self.spark, f"{self.root}/{table}/{name}")

    def drop_table_indexes(self, table: str) -> None:
        files.remove(self.spark, f"{self.root}/{table}")

    def indexes(self) -> list[Index]:
        return [self.load_index(t, n) for t in files.names(self.spark, self.root) for n in files.names(self.spark, f"{self.root}/{t}")]

    def ann_list(self) -> DataFrame:
        return self.spark.createDataFrame([(i.m.name, i.m.engine, i.m.table) for i in self.indexes()], "name string, engine string, table_name string")

    def ann_index_info(self) -> DataFrame:
        return self.spark.createDataFrame([i.info() for i in self.indexes()], "name string, engine string, table_name string, num_vectors long, num_deleted long, memory_bytes long, quantized boolean")


def gpu_info(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(False, "No GPU backend available")], "available boolean, device string")

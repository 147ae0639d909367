"""Distances, searches and the planner against the golden rows and the SQL of the registered queries."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quiverlake.functions import sqlfuncs
from quiverlake.functions import vectors as V
from quiverlake.operators import graph, hybrid, ivf, knn, quantize
from quiverlake.plans import catalogue, planner
from quiverlake.sources import binary_formats, files
from quiverlake.sources.catalog import STORAGE, Catalog, Options, gpu_info
from quiverlake.sources.scratch import shared_dir

# Rows, orders and messages that a user of such indexes relies on.
AXES = [(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [0.0, 0.0, 1.0])]
DOCS5 = [*AXES, (4, [0.5, 0.5, 0.0]), (5, [0.0, 0.5, 0.5])]
TEN = [(1, [1, 0, 0]), (2, [0, 1, 0]), (3, [0, 0, 1]), (4, [0.5, 0.5, 0]), (5, [0, 0.5, 0.5]), (6, [0.5, 0, 0.5]), (7, [0.9, 0.1, 0]), (8, [0, 0.9, 0.1]), (9, [0.1, 0, 0.9]), (10, [0.3, 0.3, 0.3])]
IVF10 = [(1, [1, 0, 0]), (2, [0.9, 0.1, 0]), (3, [0, 1, 0]), (4, [0, 0.9, 0.1]), (5, [0, 0, 1]), (6, [0.1, 0, 0.9]), (7, [0.5, 0.5, 0]), (8, [0, 0.5, 0.5]), (9, [0.5, 0, 0.5]), (10, [0.33, 0.33, 0.34])]


def frame(spark, rows, name="embedding"):
    return spark.createDataFrame([(i, [float(x) for x in v] if v is not None else None) for i, v in rows], f"id int, {name} array<float>")


def made(spark, rows, engine="FAISS", **options):
    return Catalog(spark, shared_dir(spark)).create_index(frame(spark, rows), "idx", "docs", "embedding", "id", engine, **options)


def pairs(df):
    return [(r["id"], round(r["_distance"], 6)) for r in df.select("id", "_distance").collect()]


@pytest.mark.parametrize("engine", ["FAISS", "DISKANN"])
def test_golden_search(spark, engine):
    index = made(spark, AXES, engine)
    assert pairs(index.search([1, 0, 0], 3)) == [(1, 0.0), (2, 2.0), (3, 2.0)]
    assert pairs(index.search([1, 0, 0], 99)) == [(1, 0.0), (2, 2.0), (3, 2.0)]
    assert index.search([1, 0], 3).count() == 0 and index.search([1, 0, 0], 0).count() == 0
    assert [tuple(r) for r in index.scan([1, 0, 0], 1).collect()] == [(1, 0.0)]


def test_golden_batch_and_table(spark):
    index = made(spark, DOCS5)
    got = {(r.query_idx, r.id, round(r["_distance"], 6)) for r in index.search_batch([[1, 0, 0], [0, 1, 0]], 2).collect()}
    assert got == {(0, 1, 0.0), (0, 4, 0.5), (1, 2, 0.0), (1, 4, 0.5)}
    with pytest.raises(ValueError, match="Invalid nq"):
        index.search_batch([[1, 0, 0]], 0)
    queries = spark.createDataFrame([("near_x", [1.0, 0.0, 0.0], 7), ("none", None, 8)], "name string, q array<double>, id int")
    got = index.search_table(queries, 2)
    assert got.columns == ["name", "q", "id", "docs_id", "embedding", "_distance"]
    assert sorted((r.name, r.id, r.docs_id, r["_distance"]) for r in got.collect()) == [("near_x", 7, 1, 0.0), ("near_x", 7, 4, 0.5)]
    with pytest.raises(ValueError, match="numeric LIST or ARRAY"):
        index.search_table(spark.createDataFrame([("a",)], "x string"), 1)
    assert made(spark, DOCS5).search([1, 0, 0], 2, oversample=3).count() == 5


def test_metrics(spark):
    ip = made(spark, [*AXES, (4, [0.7, 0.7, 0])], metric="IP")
    assert pairs(ip.search([1, 0, 0], 1)) == [(1, 1.0)]
    negated = made(spark, [*AXES, (4, [0.7, 0.7, 0])], "DISKANN", metric="inner_product")
    assert pairs(negated.search([1, 0, 0], 1)) == [(1, -1.0)]
    with pytest.raises(ValueError, match="Unknown metric 'x'"):
        Options.of("DISKANN", {"metric": "x"})
    rows = frame(spark, [(1, [3, 4, 0]), (2, [0, 0, 0])])
    assert rows.select(V.norm(F.col("embedding"))).first()[0] == 5
    assert rows.where("id = 2").select(V.cosine(F.col("embedding"), V.literal([1, 0, 0]))).first()[0] is None


def test_ties_duplicates_and_one_dimension(spark):
    one = made(spark, [(1, [1]), (2, [5]), (3, [3])])
    assert pairs(one.search([2], 2)) == [(1, 1.0), (3, 1.0)]
    twins = made(spark, [(1, [1, 0, 0]), (2, [1, 0, 0]), (3, [1, 0, 0]), (4, [0, 1, 0])], "DISKANN")
    assert [d < 0.01 for _, d in pairs(twins.search([1, 0, 0], 4))] == [True, True, True, False]


@pytest.mark.parametrize("engine", ["FAISS", "DISKANN"])
def test_life_of_an_index(spark, engine):
    index = made(spark, TEN, engine)
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id int")
    near = lambda q, k=1: [i for i, _ in pairs(index.search(q, k))]
    index.delete(ids(1, 99))
    assert near([1, 0, 0]) == [7]
    index.delete(ids(2, 3))
    assert near([0, 1, 0]) == [8] and len(near([0, 1, 0], 99)) == 7
    assert index.info()[3:5] == (10, 3)
    index.vacuum()
    assert index.info()[3:5] == (7, 0) and near([0, 1, 0]) == [8]
    again = Catalog(spark, index.root).load_index("docs", "idx", index.base)
    assert pairs(again.search([1, 0, 0], 3)) == pairs(index.search([1, 0, 0], 3))
    index.delete(ids(*range(1, 11)))
    assert near([0, 1, 0], 5) == []
    more = frame(spark, [(11, [0, 1, 0]), (12, [1, 0, 0])])
    index.append(more).base = index.base.union(more)
    assert near([0, 1, 0]) == [11]
    with pytest.raises(ValueError, match="dimension"):
        index.append(frame(spark, [(13, [1, 2])]))


def test_merge_and_nulls(spark):
    c = Catalog(spark, shared_dir(spark))
    a = c.create_index(frame(spark, [(1, [1, 0, 0]), (2, None)]), "a", "docs", "embedding", "id", "FAISS")
    b = c.create_index(frame(spark, [(3, [0, 1, 0]), (4, [0, 0, 1])]), "b", "docs", "embedding", "id", "FAISS")
    assert a.m.n_skipped == 1 and a.m.n_vectors == 1
    a.merge(b)
    assert a.live().count() == 3
    assert [tuple(r) for r in c.ann_list().collect()] == [("a", "FAISS", "docs"), ("b", "FAISS", "docs")]
    info = {r.name: r for r in c.ann_index_info().collect()}
    assert info["a"].num_vectors == 3 and info["a"].memory_bytes > 0 and not info["a"].quantized
    c.drop_index("docs", "a")
    assert c.ann_list().count() == 1
    c.drop_table_indexes("docs")
    assert c.ann_list().count() == 0


def test_errors(spark):
    c, df = Catalog(spark, shared_dir(spark)), frame(spark, AXES)
    c.create_index(df, "idx", "docs", "embedding", "id", "FAISS")
    with pytest.raises(ValueError, match='Index with name "idx" already exists!'):
        c.create_index(df, "idx", "docs", "embedding", "id", "FAISS")
    assert c.create_index(df, "idx", "docs", "embedding", "id", "FAISS", if_not_exists=True).m.n_vectors == 3
    for bad, said in (({"unique": True}, "unique/primary key"), ({"mode": "tpu"}, "expected 'cpu', 'gpu', or 'auto'"), ({"mode": "gpu"}, "no GPU backend available"), ({"description": "PQ4"}, "could not parse")):
        with pytest.raises(ValueError, match=said):
            c.create_index(df, "x", "docs", "embedding", "id", "FAISS", **bad)
    with pytest.raises(ValueError, match="exactly one column"):
        c.create_index(df, "x", "docs", ["id", "embedding"], "id", "DISKANN")
    with pytest.raises(ValueError, match=r"must be FLOAT\[N\]"):
        c.create_index(df, "x", "docs", "id", "id", "DISKANN")
    with pytest.raises(ValueError, match="ANN index 'x' not found on table 'docs'"):
        c.load_index("docs", "x")
    with pytest.raises(ValueError, match="is not a DiskANN index"):
        c.load_index("docs", "idx", engine="DISKANN")
    path = f"{c.root}/docs/idx/manifest-00000009.json"
    files.put(spark, path, files.get(spark, f"{c.root}/docs/idx/manifest-00000001.json").replace(f'"storage": {STORAGE}'.encode(), b'"storage": 7'))
    with pytest.raises(ValueError, match="storage version mismatch: found 7"):
        c.load_index("docs", "idx")
    assert tuple(gpu_info(spark).first()) == (False, "No GPU backend available")


def test_cells_codes_and_factory(spark):
    index = made(spark, IVF10, type="IVFFlat", ivf_nlist=2, nprobe=2, train_sample=5)
    assert [i for i, _ in pairs(index.search([1, 0, 0], 3))] == [1, 2, 7]
    coded = made(spark, IVF10, description="IVF3,SQ8", nprobe=3)
    assert coded.quantized and [i for i, _ in pairs(coded.search([1, 0, 0], 2))] == [1, 2]
    assert made(spark, IVF10, description="HNSW16").options.hnsw_m == 16
    df = frame(spark, [(1, [0, 5]), (2, [1, 5]), (3, [0.5, 5])])
    lo, scale = quantize.params_arrays(quantize.sq8_params(df))
    assert (lo, scale) == ([0.0, 5.0], [1.0, 1.0])
    assert [r[0] for r in df.select(quantize.encode(F.col("embedding"), lo, scale)).collect()] == [[0, 0], [255, 0], [128, 0]]
    assert [r[0] for r in ivf.stride_sample(frame(spark, IVF10), 3, id_col="id").select("id").orderBy("id").collect()] == [1, 4, 7]


def test_distances_of_invalid_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, [None, 1.0])], "id int, v array<float>")
    assert [r["_distance"] for r in knn.vector_distances(df, [3.0, 4.0]).orderBy("id").collect()] == [20.0, 25.0, 25.0, 25.0]
    assert [r["_distance"] for r in knn.vector_distances(df, [3.0, 4.0], on_invalid="null").orderBy("id").collect()] == [20.0, None, None, None]
    assert knn.search(df, [3.0, 4.0], 9, id_col="id").count() == 1


def test_recall_of_a_graph(spark):
    rng = np.random.default_rng(7)
    v = rng.random((400, 8), np.float32)
    df = frame(spark, list(enumerate(v.tolist())))
    p = graph.GraphParams(max_degree=16, build_complexity=32)
    g = graph.build_graph(df, p, id_col="id", shards=2).cache()
    queries = [(k, rng.random(8).tolist()) for k in range(20)]
    found, exact = graph.graph_search(g, queries, 10, params=p), knn.nearest_pairs(queries, df, 10, id_col="id")
    assert graph.recall(found, exact).first()[0] >= 0.9
    assert graph.degree_stats(g).first().max_degree <= 17
    assert all(r.nodes == r.reached for r in graph.reachable(g).collect())
    gone = spark.createDataFrame([(k,) for k in range(50)], "id long")
    left = graph.drop_deleted(g, gone)
    rows = graph.rows_of(left)
    assert rows.count() == 350 and rows.where("id < 50").count() == 0
    assert all(r.nodes == r.reached for r in graph.reachable(left).collect())


def test_batch_is_the_single_search(spark):
    rng = np.random.default_rng(3)
    df = frame(spark, [(k, rng.integers(0, 3, 4).tolist()) for k in range(300)])  # many ties
    queries = [rng.integers(0, 3, 4).astype(float).tolist() for _ in range(6)]
    for metric in ("l2", "ip", "cosine"):
        got = knn.nearest_pairs([*enumerate(queries), (90, None), (91, [1.0])], df, 7, metric=metric, id_col="id").collect()
        for k, q in enumerate(queries):
            want = [(r.id, r["_distance"]) for r in knn.search(df, q, 7, metric=metric, id_col="id").collect()]
            assert [(r.id, r["_distance"]) for r in sorted((r for r in got if r.query_idx == k), key=lambda r: r["_rank"])] == want
        assert not [r for r in got if r.query_idx >= 90]


def test_planner_gates(spark):
    c = Catalog(spark, shared_dir(spark))
    rng = np.random.default_rng(5)
    df = frame(spark, [(k, v) for k, v in enumerate(rng.random((100, 3)).tolist())])
    c.create_index(df, "idx", "docs", "embedding", "id", "FAISS", metric="L2")
    ask = lambda f="array_distance", **how: planner.order_by_distance(c, df, "docs", f, "embedding", [0.1, 0.2, 0.3], id_col="id", **how)
    used = ask(limit=5)
    assert used.index is not None and "ANN_INDEX_SCAN (index=idx, k=5, engine=FAISS, type=Flat, nprobe=1, mode=auto)" in used.explain()
    exact = ask(limit=5, where=F.lit(True))
    assert exact.index is None and exact.why == "filter"
    assert [tuple(r) for r in used.rows.collect()] == [tuple(r) for r in exact.rows.collect()]
    assert ask(limit=11).why == "too large a share of the rows" and ask(limit=None).why == "no limit"
    assert ask("array_inner_product", limit=5, ascending=False).why == "no index with this metric"
    assert ask("array_cosine_similarity", limit=5).why == "wrong direction"
    assert ask(limit=5, offset=6).why == "too large a share of the rows"
    assert math.isclose(used.rows.first()["distance"], math.dist(used.rows.first()["embedding"], [0.1, 0.2, 0.3]), rel_tol=1e-6)


def test_files(spark):
    path = shared_dir(spark)
    v = np.random.default_rng(1).random((120, 5), np.float32)
    files.put(spark, f"{path}/v.bin", binary_formats.vector_bytes(v))
    assert [r.vector for r in binary_formats.read_vectors(spark, f"{path}/v.bin").orderBy("row").collect()] == v.tolist()
    assert tuple(binary_formats.streaming_build(spark, f"{path}/v.bin", f"{path}/g", max_degree=8, build_complexity=16).first()) == (120, 5, 120)
    g = binary_formats.read_graph(spark, f"{path}/g")
    hit = graph.graph_search(g, [(0, v[17].tolist())], 1, search_complexity=500).first()
    assert (hit.id, hit["_distance"]) == (17, 0.0)
    for data, said in ((b"DANN", "too small"), (b"X" * 40, "magic"), (b"DANN\x09" + b"\0" * 40, "unsupported version")):
        with pytest.raises(ValueError, match=said):
            binary_formats.parse_graph(data)
    for name, data, said in (("a", b"\1", "input header"), ("b", b"\0" * 8, "0 vectors"), ("c", b"\1\0\0\0\0\0\0\0", "dimension 0")):
        files.put(spark, f"{path}/{name}", data)
        with pytest.raises(ValueError, match=said):
            binary_formats.streaming_build(spark, f"{path}/{name}", f"{path}/out")
    with pytest.raises(ValueError, match="Failed to open input"):
        binary_formats.streaming_build(spark, f"{path}/missing", f"{path}/out")
    assert [binary_formats.sample_size(n) for n in (10, 2000, 4_000_000)] == [10, 1000, 2000]


def test_walks_over_all_nodes_are_linear():
    """A list of all nodes, or nearly all, isn't sorted at each step."""
    import time

    rng, n = np.random.default_rng(2), 60_000
    v, ring = rng.random((n, 2)), np.stack([(np.arange(n) + 1) % n, rng.integers(0, n, n)], 1)
    s, began = graph.Shard(np.arange(n), v, ring, np.array([0])), time.time()
    (whole,) = s.search(v[:1], 10**6, "l2")
    assert sorted(whole.tolist()) == list(range(n))
    most = graph.best_first(v, ring, [0], v[0], n - 1, "l2")
    assert len(most) == n - 1 and most == sorted(most) and most[0] == (0.0, 0)
    assert time.time() - began < 15


def test_a_file_reaches_all_its_vectors(spark):
    """Edges over the largest degree aren't in the file; what they led to is reached without them. Copies have their edges from one place."""
    path, rng = shared_dir(spark), np.random.default_rng(4)
    v = np.concatenate([rng.random((200, 16), np.float32), np.full((100, 16), 0.5, np.float32)])
    files.put(spark, f"{path}/v.bin", binary_formats.vector_bytes(v))
    binary_formats.streaming_build(spark, f"{path}/v.bin", f"{path}/g", max_degree=4, build_complexity=8)
    vectors, adjacency, entries, p = binary_formats.parse_graph(files.get(spark, f"{path}/g"))
    assert (vectors == v).all() and adjacency.shape == (300, 4) and p.max_degree == 4
    assert graph.reached(adjacency, np.array(entries)).all()


def test_graph_files_of_many_cells(spark, monkeypatch):
    """A file of more vectors than a shard holds is built by cells, whose graphs are merged into one that walks find their way in."""
    monkeypatch.setattr(graph, "SHARD_ROWS", 80)
    path, v = shared_dir(spark), np.random.default_rng(6).random((600, 6), np.float32)
    binary_formats.write_vectors(spark, frame(spark, reversed(list(enumerate(v.tolist())))), f"{path}/v.bin", id_col="id")
    assert files.get(spark, f"{path}/v.bin") == binary_formats.vector_bytes(v)
    got = binary_formats.streaming_build(spark, f"{path}/v.bin", f"{path}/g", max_degree=8, build_complexity=16, sample=90)
    assert tuple(got.first()) == (600, 6, 90)
    vectors, adjacency, entries, p = binary_formats.parse_graph(files.get(spark, f"{path}/g"))
    assert (vectors == v).all() and graph.reached(adjacency, np.array(entries)).all()
    queries = [(k, v[k].tolist()) for k in range(0, 600, 20)]
    found = graph.graph_search(binary_formats.read_graph(spark, f"{path}/g"), queries, 10, search_complexity=60, params=p)
    assert graph.recall(found, knn.nearest_pairs(queries, frame(spark, list(enumerate(v.tolist()))), 10, id_col="id")).first()[0] >= 0.9


def test_lists_are_merged_in_turns_and_tied():
    row, got = binary_formats.merged(np.array([7, 5, 7]), np.array([[1, 2, 3], [4, -1, -1], [2, 9, -1]]), 4)
    assert row.tolist() == [5, 7] and got.tolist() == [[4, -1, -1, -1], [1, 2, 9, 3]]
    far = np.array([[1], [0], [3], [2], [4]])  # three parts that know nothing of each other, no place free
    assert graph.reached(binary_formats.tied(far, 0), np.array([0])).all() and far.shape == (5, 1)


def test_neighbours_of_many_nodes_are_those_of_each(monkeypatch):
    """Lists pruned in lock-step over a table of distances are those pruned alone from the vectors."""
    v, rng = np.random.default_rng(8).normal(size=(120, 6)), np.random.default_rng(9)
    v[40:50] = v[40]  # copies
    for metric in ("l2", "ip", "cosine"):
        p = graph.GraphParams(max_degree=6, build_complexity=20, metric=metric)
        near_of, nodes = graph.between(v, metric), np.arange(30, 60)
        pools = [rng.integers(0, 120, 40) for _ in nodes]
        many = graph.prune(near_of, nodes, np.repeat(np.arange(30), 40), np.concatenate(pools), p)
        monkeypatch.setattr(graph, "TABLE_ROWS", 0)
        direct = graph.between(v, metric)
        assert [graph.prune(direct, nodes[k : k + 1], np.zeros(40, int), x, p)[0].tolist() for k, x in enumerate(pools)] == many.tolist()
        monkeypatch.undo()
    p = graph.GraphParams(max_degree=2)
    line = np.array([[0.0], [1.0], [2.0], [-1.0]])  # 1 stands before 2
    assert graph.prune(graph.between(line, "l2"), np.array([0]), np.zeros(4, int), np.arange(4), p).tolist() == [[1, 3]]


def test_each_shard_is_built_in_a_task_of_its_own(spark):
    """Dealt by a hash of the shard, one task would build several after each other while others have none."""
    df = frame(spark, list(enumerate(np.random.default_rng(3).random((300, 4)).tolist())))
    g = graph.build_graph(df, graph.GraphParams(max_degree=4, build_complexity=8), id_col="id", shards=7)
    assert g.groupBy(F.spark_partition_id().alias("task")).count().where("count = 1").count() == 7


def test_hits_of_many_queries_are_those_of_each(spark, monkeypatch):
    """Exact distances are taken for many queries' hits together, in the order of the folds."""
    rng = np.random.default_rng(5)
    v, q = rng.normal(size=(90, 5)), rng.normal(size=(4, 5))
    which, at = np.repeat(np.arange(4), 90), np.tile(np.arange(90), 4)
    for metric in ("l2", "ip", "cosine"):
        assert knn.pair_values(metric, q, which, v, at).tolist() == knn.matrix_distances(metric, q, v).ravel().tolist()
        p = graph.GraphParams(max_degree=8, build_complexity=16, metric=metric)
        g = graph.build_graph(frame(spark, list(enumerate(v.tolist()))), p, id_col="id", shards=2).cache()
        rows = lambda df: sorted(tuple(r) for r in df.collect())
        many = rows(graph.graph_search(g, [(7 * k, x.tolist()) for k, x in enumerate(q)], 3, search_complexity=90, params=p))
        assert len(many) == 12 and many == sorted(r for k, x in enumerate(q) for r in rows(graph.graph_search(g, [(7 * k, x.tolist())], 3, search_complexity=90, params=p)))
        g.unpersist()


def test_hybrid(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, "red red dog"), (3, "blue"), (4, None)], "doc_id long, text string")
    assert [(r.id, r.rank) for r in hybrid.bm25_top(docs, "Red!", 9).orderBy("rank").collect()] == [(2, 1), (1, 2)]
    vecs = spark.createDataFrame([(1, [1.0, 0.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = {r.doc_id: (round(r["_rrf_score"], 6), r["_bm25_rank"], r["_vector_rank"]) for r in hybrid.hybrid_search(docs, vecs, [0.0, 1.0], "red").collect()}
    assert got == {1: (round(0.3 / 62 + 0.7 / 62, 6), 2, 2), 2: (round(0.3 / 61, 6), 1, 0), 3: (round(0.7 / 61, 6), 0, 1)}
    assert hybrid.hybrid_search(docs, vecs, [0.0, 1.0], "").count() == 2


def test_texts_are_taken_apart_once(spark):
    """A ranking reads counts; no plan of it has the words' expression in it still, so no filter is pushed to the texts."""
    docs = spark.createDataFrame([(1, "red fox"), (2, "red red dog"), (3, "blue")], "doc_id long, text string")
    seen = spark.sparkContext.accumulator(0)

    def same(pdfs):
        for pdf in pdfs:
            seen.add(len(pdf))
            yield pdf

    top = hybrid.bm25_top(docs.mapInPandas(same, docs.schema), "red dog", 5)
    assert [r.id for r in top.orderBy("rank").collect()] == [2, 1] and seen.value == 3
    assert "regexp" not in top._jdf.queryExecution().optimizedPlan().toString()
    many = hybrid.hybrid_search(docs, spark.createDataFrame([(3, [1.0])], "vec_id long, embedding array<float>"), [1.0], "red", k=5000)
    assert sorted(r.doc_id for r in many.collect()) == [1, 2, 3]


def test_sql_surface(spark):
    sqlfuncs.register(spark)
    assert spark.sql("SELECT array_distance(array(0D, 0D), array(3D, 4D)) AS d").first().d == 5
    assert spark.sql("SELECT list_inner_product(array(1D, 2D), array(3D, 4D)) AS d").first().d == 11
    c = Catalog(spark, shared_dir(spark))
    frame(spark, DOCS5).createOrReplaceTempView("sql_docs")
    c.create_index(spark.table("sql_docs"), "idx", "sql_docs", "embedding", "id", "FAISS")
    got = sqlfuncs.ann_sql(c, "SELECT id, _distance FROM ann_search('sql_docs', 'idx', [1.0, 0.0, 0.0], 2) ORDER BY id").collect()
    assert [tuple(r) for r in got] == [(1, 0.0), (4, 0.5)]
    got = sqlfuncs.ann_sql(c, "SELECT count(*) AS n FROM ann_search_table((SELECT array(1.0D, 0D, 0D) AS q UNION ALL SELECT array(0D, 1D, 0D)), 'sql_docs', 'idx', 2)")
    assert got.first().n == 4
    assert sqlfuncs.ann_sql(c, "SELECT name FROM ann_list()").first().name == "idx"


def test_literals_are_left_alone():
    assert sqlfuncs.bracketed("['a[b]', \"c[\", [1]]") == "array('a[b]', \"c[\", array(1))"
    assert sqlfuncs.plain("x('a(''b')") == "x('     ')"
    with pytest.raises(ValueError, match="unbalanced"):
        sqlfuncs.closing("f(a, '(', (b", 2, "f")


def test_null_queries_are_errors(spark):
    c = Catalog(spark, shared_dir(spark))
    frame(spark, DOCS5).createOrReplaceTempView("null_docs")
    c.create_index(spark.table("null_docs"), "idx", "null_docs", "embedding", "id", "FAISS")
    with pytest.raises(ValueError, match="must not be NULL"):
        sqlfuncs.ann_sql(c, "SELECT * FROM ann_search('null_docs', 'idx', [1.0, NULL, 0.0], 2)")


def test_ids_stay_unique_and_writers_apart(spark):
    c = Catalog(spark, shared_dir(spark))
    a = c.create_index(frame(spark, AXES), "a", "docs", "embedding", "id", "FAISS")
    b = c.create_index(frame(spark, DOCS5), "b", "docs", "embedding", "id", "FAISS")
    for clash in (lambda: a.merge(b), lambda: a.append(frame(spark, DOCS5[2:]))):
        with pytest.raises(ValueError, match="must be unique"):
            clash()
    assert c.load_index("docs", "a").m.n_vectors == 3
    one, other = (c.load_index("docs", "a", frame(spark, AXES)) for _ in range(2))
    one.delete(frame(spark, AXES[:1]))
    with pytest.raises(OSError, match="another writer"):
        other.delete(frame(spark, AXES[1:2]))
    assert not one.covers(frame(spark, AXES)) and one.covers(frame(spark, AXES[1:]))


def test_cells_of_many_segments(spark):
    index = made(spark, IVF10[:4], type="IVFFlat", ivf_nlist=2, nprobe=2)
    for r in IVF10[4:]:
        index.append(frame(spark, [r]))
    index.base = frame(spark, IVF10)
    index.delete(frame(spark, IVF10[1:2])).delete(frame(spark, IVF10[6:7]))
    assert len(index.m.segments) == 7 and sorted(i for i, _ in pairs(index.search([1, 0, 0], 99))) == [1, 3, 4, 5, 6, 8, 9, 10]


def test_streams_into_graphs(spark):
    from quiverlake.streaming.appender import append_stream

    index, path = made(spark, AXES, "DISKANN"), shared_dir(spark)
    index.delete(frame(spark, AXES[:1]))
    frame(spark, DOCS5).write.parquet(f"{path}/in")  # two of these the index has, one was deleted
    for _ in range(2):
        append_stream(spark.readStream.schema(frame(spark, AXES).schema).parquet(f"{path}/in"), index, f"{path}/at{_}").awaitTermination()
    index.base = frame(spark, DOCS5)
    assert sorted(pairs(index.search([1, 0, 0], 9))) == [(1, 0.0), (2, 2.0), (3, 2.0), (4, 0.5), (5, 1.5)]


def test_batches_with_zero_rows(spark):
    rows = [(k, [0.0, 0.0]) for k in range(4000)] + [(4000 + k, [1.0, float(k)]) for k in range(5)]
    got = knn.nearest_pairs([(0, [1.0, 0.0]), (1, [0.0, 0.0])], frame(spark, rows), 10, metric="cosine", id_col="id")
    assert sorted((r.query_idx, r.id) for r in got.collect()) == [(0, 4000 + k) for k in range(5)]


def test_values_chosen_by_products_are_exact(spark):
    """Large offsets cancel in norms and products; the results are still those of the fold."""
    rng = np.random.default_rng(1)
    rows = [(k, (1e4 + rng.random(6) * 1e-3).tolist()) for k in range(3000)]
    df = spark.createDataFrame(rows, "id int, embedding array<double>")
    q = (1e4 + rng.random(6) * 1e-3).tolist()
    for metric in ("l2", "ip", "cosine"):
        batch = knn.nearest_pairs([(0, q)], df, 9, metric=metric, id_col="id").orderBy("_rank").collect()
        assert [(r.id, r["_distance"]) for r in batch] == [(r.id, r["_distance"]) for r in knn.search(df, q, 9, metric=metric, id_col="id").collect()]


NAMES = [n for n in catalogue.ORACLE]


@pytest.fixture(scope="module")
def duck():
    import glob
    import os

    c = duckdb.connect()
    for p in glob.glob("/root/testdata/sf0.001/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, duck, name):
    got, want = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001").toPandas(), duck.sql(catalogue.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted(tuple(repr(float(x)) if isinstance(x, (float, np.floating)) else str(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False))
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

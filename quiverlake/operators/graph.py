"""Proximity graphs, one for each shard of vectors: build, search, filter, remove, statistics.

A shard is one row: ids, vectors or their eight-bit codes, edges and entry points
packed together. It is searched where it is read, whole, so a search moves the
queries and the hits and never the index. Shards are dealt by a hash of the id
and sized so that one fits a worker: their number grows with the table, not
their size. Walks of many queries go in lock-step, as matrices.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V

#: Rows of a shard, about; queries that walk a shard together.
SHARD_ROWS, TOGETHER = 5_000, 256
#: Vectors whose distances are kept as a table while their graph is built (4 bytes a pair).
TABLE_ROWS = 8_000
#: Hits of a shard whose exact distances are taken together, about.
HELD = 50_000


@dataclass(frozen=True)
class GraphParams:
    """What a graph is built by. Defaults: degree 64, list of 128, prune factor 1.2, slack 1.3, pool of 750.

    minibatch: vectors that are inserted together, each a candidate of the others.
    retries: how often a search for neighbours that finds fewer than the degree is
    repeated with twice the list. start: where walks begin, see start_points().
    layers: thinned graphs above, one vector in max_degree / 2 of the one below, that lead to the entry point.
    saturate: pruned lists are filled up to the degree with the nearest that were left out.
    """

    max_degree: int = 64
    build_complexity: int = 128
    alpha: float = 1.2
    slack: float = 1.3
    pool: int = 750
    metric: str = "l2"
    minibatch: int = 32
    retries: int = 1
    start: str = "first"
    starts: int = 1
    layers: bool = False
    saturate: bool = False


def _near(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distances (small is near) between the last axes of two arrays that broadcast."""
    if metric == "l2":
        d = a - b
        return np.einsum("...j,...j->...", d, d)
    dot = np.einsum("...j,...j->...", a, b)
    if metric == "cosine":
        return 1 - dot / (np.sqrt(np.einsum("...j,...j->...", a, a) * np.einsum("...j,...j->...", b, b)) + 1e-30)
    return -dot


def best_first(vectors: np.ndarray, adjacency: np.ndarray, entries: Sequence[int], q: np.ndarray, size: int, metric: str, allowed: np.ndarray | None = None) -> list[tuple[float, int]]:
    """At most `size` results, nearest first, of one query's walk from the entry points.

    The nearest open candidate is expanded until the list is full and no open
    candidate is nearer than its last member. With `allowed` (a flag for each
    vector), results and candidates are allowed vectors alone: a neighbour that
    isn't is replaced by its own neighbours that are.
    """
    seen = np.zeros(len(vectors), bool)

    def scored(nodes: np.ndarray) -> list[tuple[float, int]]:
        seen[nodes] = True
        return list(zip(_near(vectors[nodes], q, metric).tolist(), nodes.tolist()))

    heap = scored(np.unique(np.array(entries)))
    result = [(-d, -x) for d, x in sorted(x for x in heap if allowed is None or allowed[x[1]])[:size]]  # a heap, the last member first
    heapq.heapify(result)
    heapq.heapify(heap)
    while heap:
        dist, node = heapq.heappop(heap)
        if len(result) >= size and dist > -result[0][0]:
            break
        near = adjacency[node]
        near = near[near >= 0]
        if allowed is not None:
            other = near[~allowed[near] & ~seen[near]]
            seen[other] = True
            two = adjacency[other].ravel()
            near = np.unique(np.concatenate([near[allowed[near]], two[(two >= 0) & allowed[two]]]))
            if not len(near) and not result:  # nothing allowed in reach yet: walk on over what there is
                near = other
                seen[other] = False
        fresh = scored(near[~seen[near]])
        bar = -result[0][0] if len(result) >= size else np.inf
        for item in fresh:
            if item[0] < bar:
                heapq.heappush(heap, item)
                if allowed is None or allowed[item[1]]:
                    (heapq.heappush if len(result) < size else heapq.heappushpop)(result, (-item[0], -item[1]))
    return sorted((-d, -x) for d, x in result)


def walk_many(vectors: np.ndarray, adjacency: np.ndarray, entries: np.ndarray, queries: np.ndarray, size: int, metric: str, near_of: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """(nodes, distances, steps) of all queries' walks in lock-step: a row of `size` results each, nearest first, -1 and infinity beyond what was found.

    entries has a row of entry points for each query. In a step every query that
    isn't done expands its nearest open candidate; steps are (queries, nodes, distances).
    near_of: distances of queries (by number) and nodes, where they are known.
    """
    near_of = near_of or (lambda q, x: _near(vectors[x], queries[q], metric))
    nq, rows = len(queries), np.arange(len(queries))
    width = max(size, entries.shape[1])
    seen = np.zeros((nq, len(vectors)), bool)
    node, dist, open_ = np.full((nq, width), -1), np.full((nq, width), np.inf), np.zeros((nq, width), bool)
    m = entries.shape[1]
    node[:, :m], open_[:, :m] = entries, True
    dist[:, :m] = near_of(np.arange(nq)[:, None], entries)
    np.put_along_axis(seen, entries, True, 1)
    order = np.argsort(dist, 1, kind="stable")
    node, dist, open_ = (np.take_along_axis(x, order, 1)[:, :size] for x in (node, dist, open_))
    steps = []
    while len(rows):
        rows = rows[open_[rows].any(1)]
        if not len(rows):
            break
        at = open_[rows].argmax(1)
        here = node[rows, at]
        open_[rows, at] = False
        steps.append((rows, here, dist[rows, at]))
        near = adjacency[here]
        fresh = near >= 0
        fresh &= ~seen[rows[:, None], np.maximum(near, 0)]
        r, c = np.nonzero(fresh)
        if not len(r):
            continue
        to = near[r, c]
        seen[rows[r], to] = True
        place = np.arange(len(r)) - np.searchsorted(r, r)
        shape = (len(rows), int(place.max()) + 1)
        d, new, own = np.full(shape, np.inf), np.full(shape, -1), np.arange(len(rows))[:, None]
        d[r, place], new[r, place] = near_of(rows[r], to), to
        all_d = np.concatenate([dist[rows], d], 1)
        take = np.argsort(all_d, 1, kind="stable")[:, :size]
        dist[rows] = all_d[own, take]
        node[rows] = np.concatenate([node[rows], new], 1)[own, take]
        open_[rows] = np.concatenate([open_[rows], new >= 0], 1)[own, take]
    return node, dist, steps


def between(vectors: np.ndarray, metric: str) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Distances between nodes, by their numbers (arrays that broadcast). Those of a shard are looked up in a table of all, made by matrix products;
    as only their ratios count, vectors are scaled, and moved for L2. What cancels in the products is computed from the differences."""
    n = len(vectors)
    if n <= TABLE_ROWS:
        v = vectors - vectors.mean(0) if metric == "l2" and n else vectors
        v = v / (np.abs(v).max(initial=0.0) or 1.0)
        table, sq = np.empty((n, n), np.float32), np.einsum("ij,ij->i", v, v)
        for lo in range(0, n, 512):
            some = v[lo : lo + 512] @ v.T
            if metric == "l2":
                both = sq[lo : lo + 512, None] + sq
                some = both - 2 * some
                a, b = np.nonzero(some <= 1e-9 * both)
                for at in range(0, len(a), 1 << 16):
                    x, y = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
                    some[x, y] = _near(v[lo + x], v[y], metric)
            else:
                some = 1 - some / (np.sqrt(sq[lo : lo + 512, None] * sq) + 1e-30) if metric == "cosine" else -some
            table[lo : lo + 512] = some
        if np.isfinite(table).all():
            return lambda a, b: table[a, b]
    return lambda a, b: _near(vectors[a], vectors[b], metric)


def prune(near_of: Callable[[np.ndarray, np.ndarray], np.ndarray], nodes: np.ndarray, row: np.ndarray, pool: np.ndarray, p: GraphParams) -> np.ndarray:
    """Neighbours of many nodes out of their pools, a row of max_degree for each node, -1 beyond the last: nearest first, none that a kept one occludes; the bar rises to alpha in steps while there is room.

    pool[i] may become a neighbour of nodes[row[i]]. All nodes go in lock-step, a neighbour each in a step.
    """
    out = np.full((len(nodes), p.max_degree), -1)
    span = int(pool.max(initial=0)) + 1
    row, pool = np.divmod(np.unique(row * span + pool), span)
    other = pool != nodes[row]
    row, pool = row[other], pool[other]
    dist = near_of(nodes[row], pool)
    order = np.lexsort((dist, row))
    row, pool, dist = row[order], pool[order], dist[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    inside = place < p.pool
    row, pool, dist, place = row[inside], pool[inside], dist[inside], place[inside]
    if not len(row):
        return out
    shape = (len(nodes), int(place.max()) + 1)
    ids, far, free = np.zeros(shape, np.int64), np.zeros(shape), np.zeros(shape, bool)
    ids[row, place], far[row, place], free[row, place] = pool, dist, True
    occlusion, taken, kept, cols = np.zeros(shape), np.zeros(shape, bool), np.zeros(len(nodes), np.int64), np.arange(shape[1])
    bar = 1.0
    while True:
        at = np.flatnonzero(kept < p.max_degree)
        while len(at):
            open_ = free[at] & (occlusion[at] <= bar)
            k = open_.argmax(1)
            more = open_[np.arange(len(at)), k]
            at, k = at[more], k[more]
            if not len(at):
                break
            free[at, k], taken[at, k] = False, True
            kept[at] += 1
            apart = near_of(ids[at, k][:, None], ids[at])  # within a row of the table each
            if p.metric == "ip":
                new = np.where(apart < bar * far[at], bar + 0.01, 0.0)
            else:
                with np.errstate(divide="ignore", invalid="ignore"):
                    new = np.where(apart > 0, far[at] / apart, np.inf)
            occlusion[at] = np.where(cols > k[:, None], np.maximum(occlusion[at], new), occlusion[at])
            at = at[kept[at] < p.max_degree]
        if bar >= p.alpha or (kept >= p.max_degree).all():
            break
        bar = min(p.alpha, bar * min(p.alpha, 1.2)) if p.alpha > 1 else p.alpha
    if p.saturate:
        taken |= free & (np.cumsum(free, 1) <= (p.max_degree - kept)[:, None])
    r, c = np.nonzero(taken)
    out[r, np.arange(len(r)) - np.searchsorted(r, r)] = ids[r, c]
    return out


def start_points(vectors: np.ndarray, kind: str, n: int = 1, seed: int = 0) -> np.ndarray:
    """Nodes where walks begin: 'first', 'medoid', n of a 'sample', or those nearest to n 'random' directions of the mean length or to a 'latin' hypercube's points."""
    n, rng = max(1, min(n, len(vectors))), np.random.default_rng(seed)
    if kind == "first":
        return np.arange(n)
    if kind == "sample":
        return np.sort(rng.choice(len(vectors), n, replace=False))
    if kind == "medoid":
        points = vectors.mean(0, keepdims=True)
    elif kind == "random":
        points = rng.normal(size=(n, vectors.shape[1]))
        points *= np.sqrt((vectors**2).sum(1)).mean() / np.maximum(np.sqrt((points**2).sum(1, keepdims=True)), 1e-30)
    elif kind == "latin":
        lo, hi = vectors.min(0), vectors.max(0)
        cell = np.stack([rng.permutation(n) for _ in range(vectors.shape[1])], 1)
        points = lo + (cell + rng.random(cell.shape)) / n * (hi - lo)
    else:
        raise ValueError(f"Unknown start '{kind}'")
    return np.unique([int(_near(vectors, x, "l2").argmin()) for x in points])


def build(vectors: np.ndarray, p: GraphParams, entries: Sequence[int] = (0,)) -> np.ndarray:
    """Adjacency (a row of neighbours for each vector, -1 beyond the last) of a graph whose walks begin at the entry points.

    Vectors are inserted in batches that grow with the graph up to minibatch; a
    batch's members are candidates of each other. Every node stays reachable: one
    that pruning has cut off is tied to a node that is reached.
    """
    n = len(vectors)
    room = max(1, int(p.max_degree * p.slack))
    adjacency = np.full((n, room + 1), -1)
    entries = np.unique(np.array(entries, np.int64))
    order = np.concatenate([entries, np.setdiff1d(np.arange(n), entries)])
    near_of = between(vectors, p.metric)

    def put(nodes: np.ndarray, row: np.ndarray, pool: np.ndarray) -> None:
        adjacency[nodes] = -1
        adjacency[nodes, : p.max_degree] = prune(near_of, nodes, row, pool, p)

    def cut(nodes: np.ndarray) -> None:
        """Prunes the lists of these nodes."""
        row, place = np.nonzero(adjacency[nodes] >= 0)
        put(nodes, row, adjacency[nodes[row], place])

    for x in entries:
        own = entries[entries != x]
        if len(own) > room:
            put(np.array([x]), np.zeros(len(own), np.int64), own)
        else:
            adjacency[x, : len(own)] = own
    done = len(entries)
    while done < n:
        batch = order[done : done + max(1, min(p.minibatch, done // 4))]
        size = p.build_complexity
        for _ in range(1 + p.retries):
            _, _, steps = walk_many(vectors, adjacency, np.tile(entries, (len(batch), 1)), vectors[batch], size, p.metric, lambda q, x, batch=batch: near_of(batch[q], x))
            who, met = np.concatenate([s[0] for s in steps]), np.concatenate([s[1] for s in steps])
            if np.bincount(who, minlength=len(batch)).min() >= min(p.max_degree, done):
                break
            size *= 2
        m = len(batch)
        put(batch, np.concatenate([who, np.repeat(np.arange(m), m)]), np.concatenate([met, np.tile(batch, m)]))
        row, place = np.nonzero(adjacency[batch] >= 0)
        new, to = batch[row], adjacency[batch[row], place]
        other = ~(adjacency[to] == new[:, None]).any(1)
        order_ = np.lexsort((new[other], to[other]))
        new, to = new[other][order_], to[other][order_]
        place = (adjacency[to] >= 0).sum(1) + np.arange(len(to)) - np.searchsorted(to, to)
        full = np.unique(to[place >= room])
        over = np.isin(to, full)
        adjacency[to[~over], place[~over]] = new[~over]
        if len(full):
            row, place = np.nonzero(adjacency[full] >= 0)
            put(full, np.concatenate([row, np.searchsorted(full, to[over])]), np.concatenate([adjacency[full[row], place], new[over]]))
        done += m
    cut(np.flatnonzero((adjacency >= 0).sum(1) > p.max_degree))
    return connected(adjacency, entries)


def reached(adjacency: np.ndarray, entries: np.ndarray, seen: np.ndarray | None = None) -> np.ndarray:
    """Flags of the nodes that the entry points lead to; added to `seen`, where that is given, and not beyond it."""
    seen, front = np.zeros(len(adjacency), bool) if seen is None else seen, np.asarray(entries)
    seen[front] = True
    while len(front):
        front = np.unique(adjacency[front])
        front = front[(front >= 0)]
        front = front[~seen[front]]
        seen[front] = True
    return seen


def connected(adjacency: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """The adjacency with an edge more to each node that no walk would reach."""
    seen, x = reached(adjacency, entries), 0
    while not seen.all():
        x += int(seen[x:].argmin())  # all before it are reached
        from_ = x - 1 if x else int(np.flatnonzero(seen)[-1])
        free = np.flatnonzero(adjacency[from_] < 0)
        if not len(free):
            adjacency = np.concatenate([adjacency, np.full((len(adjacency), 1), -1)], 1)
            free = [adjacency.shape[1] - 1]
        adjacency[from_, free[0]] = x
        reached(adjacency, np.array([x]), seen)
    return adjacency[:, : max(1, int((adjacency >= 0).sum(1).max(initial=0)))]


@dataclass
class Shard:
    """One graph. `vectors` are float64; with `codes` they are what the codes say, and only the codes are stored."""

    ids: np.ndarray
    vectors: np.ndarray
    adjacency: np.ndarray
    entries: np.ndarray
    attr: np.ndarray | None = None
    codes: np.ndarray | None = None
    lo: np.ndarray | None = None
    scale: np.ndarray | None = None
    above: list[tuple[np.ndarray, np.ndarray]] | None = None

    @staticmethod
    def made(ids: np.ndarray, vectors: np.ndarray, p: GraphParams, attr: np.ndarray | None = None, sq8: tuple | None = None) -> Shard:
        """A graph of vectors in the order given. sq8: (lo, scale) by which vectors are stored."""
        entries = start_points(vectors, p.start, p.starts)
        s = Shard(ids, vectors, build(vectors, p, entries), entries, attr)
        if p.layers:
            s.above, nodes, thin = [], np.arange(len(ids)), replace(p, layers=False, start="first", starts=1)
            rng = np.random.default_rng(len(ids))
            while len(nodes) > max(2, p.max_degree):
                nodes = np.sort(rng.choice(nodes, max(1, len(nodes) // max(2, p.max_degree // 2)), replace=False))
                s.above.insert(0, (nodes, build(vectors[nodes], thin)))
        if sq8:
            s.lo, s.scale = (np.array(x, np.float64) for x in sq8)
            s.codes = np.clip(np.floor((vectors - s.lo) / s.scale * 255 + 0.5), 0, 255).astype(np.uint8)
        return s

    def pack(self) -> bytes:
        out, flat = io.BytesIO(), {}
        for name in ("attr", "codes", "lo", "scale"):
            if (v := getattr(self, name)) is not None:
                flat[name] = v
        if self.codes is None:
            flat["vectors"] = self.vectors.astype(np.float32)
        for k, (nodes, adjacency) in enumerate(self.above or []):
            flat |= {f"nodes{k}": nodes.astype(np.int32), f"edges{k}": adjacency.astype(np.int32)}
        np.savez(out, adjacency=self.adjacency.astype(np.int32), entries=self.entries.astype(np.int32), layers=np.int64(-1 if self.above is None else len(self.above)), **flat)
        return out.getvalue()

    @staticmethod
    def open(ids: np.ndarray, body: bytes) -> Shard:
        with np.load(io.BytesIO(body), allow_pickle=False) as f:
            get = lambda n: f[n] if n in f else None
            codes, lo, scale = get("codes"), get("lo"), get("scale")
            vectors = f["vectors"].astype(np.float64) if codes is None else codes / 255.0 * scale + lo
            n = int(f["layers"])
            above = None if n < 0 else [(f[f"nodes{k}"].astype(np.int64), f[f"edges{k}"].astype(np.int64)) for k in range(n)]
            return Shard(np.asarray(ids, np.int64), vectors, f["adjacency"].astype(np.int64), f["entries"].astype(np.int64), get("attr"), codes, lo, scale, above)

    def row(self, shard: int) -> pd.DataFrame:
        return pd.DataFrame({"shard": [shard], "ids": [self.ids.tolist()], "body": [self.pack()]})

    def begin(self, queries: np.ndarray, metric: str) -> np.ndarray:
        """Entry points for each query: the shard's, or where the layers above lead."""
        if not self.above:
            return np.tile(self.entries, (len(queries), 1))
        at = np.zeros((len(queries), 1), np.int64)
        for k, (nodes, adjacency) in enumerate(self.above):
            near = walk_many(self.vectors[nodes], adjacency, at, queries, min(8, len(nodes)), metric)[0][:, :1]
            found = nodes[near]
            at = np.searchsorted(self.above[k + 1][0], found) if k + 1 < len(self.above) else found
        return at

    def search(self, queries: np.ndarray, size: int, metric: str, allowed: np.ndarray | None = None) -> Iterator[np.ndarray]:
        """The labels that each query's walk ends with."""
        size = min(size, len(self.ids))
        for lo in range(0, len(queries), TOGETHER):
            some = queries[lo : lo + TOGETHER]
            start = self.begin(some, metric)
            if size == len(self.ids) and allowed is None:  # such walks end with all that they reach
                ends = {tuple(e): np.flatnonzero(reached(self.adjacency, e)) for e in np.unique(start, axis=0)}
                yield from (ends[tuple(e)] for e in start)
            elif len(some) == 1 or size >= 1000 or allowed is not None:
                for q, e in zip(some, start):
                    yield np.array([x for _, x in best_first(self.vectors, self.adjacency, e.tolist(), q, size, metric, allowed)], np.int64)
            else:
                for nodes in walk_many(self.vectors, self.adjacency, start, some, size, metric)[0]:
                    yield nodes[nodes >= 0]

    def without(self, labels: np.ndarray, p: GraphParams) -> Shard:
        """The graph without some nodes: those that had edges to them get their neighbours in exchange, pruned anew; labels close up."""
        gone = np.zeros(len(self.ids), bool)
        gone[labels] = True
        kept = np.flatnonzero(~gone)
        adjacency = np.full((len(self.ids), max(self.adjacency.shape[1], p.max_degree)), -1)
        torn: list[tuple[int, list[int]]] = []
        for x in kept.tolist():
            own = self.adjacency[x][self.adjacency[x] >= 0]
            todo, met = own[gone[own]], set()
            if len(todo):
                pool = own[~gone[own]].tolist()
                while len(todo):  # a removed neighbour's removed neighbours stand for it in turn
                    met.update(todo.tolist())
                    two = self.adjacency[todo].ravel()
                    two = np.unique(two[two >= 0])
                    pool += two[~gone[two]].tolist()
                    todo = np.array([y for y in two[gone[two]].tolist() if y not in met], np.int64) if not pool else np.empty(0, np.int64)
                torn.append((x, pool))
            else:
                adjacency[x, : len(own)] = own
        near_of = between(self.vectors, p.metric) if torn else None
        for lo in range(0, len(torn), TOGETHER):
            some = torn[lo : lo + TOGETHER]
            row = np.repeat(np.arange(len(some)), [len(pool) for _, pool in some])
            nodes = np.array([x for x, _ in some])
            adjacency[nodes, : p.max_degree] = prune(near_of, nodes, row, np.array([y for _, pool in some for y in pool], np.int64), p)
        place = np.cumsum(~gone) - 1
        small = adjacency[kept]
        small = np.where(small >= 0, place[np.maximum(small, 0)], -1)
        entries = place[self.entries[~gone[self.entries]]]
        if not len(entries) and len(kept):
            entries = start_points(self.vectors[kept], "medoid")
        pick = lambda a: None if a is None else a[kept]
        return Shard(self.ids[kept], self.vectors[kept], connected(small, entries), entries, pick(self.attr), pick(self.codes), self.lo, self.scale)


#: A graph table: a row for each shard. And what it says, a row for each vector.
SHARDS = "shard int, ids array<long>, body binary"
GRAPH = "shard int, label int, id long, vector array<float>, neighbors array<int>, entry boolean"


def each(shards: DataFrame, one: Callable[[int, Shard], pd.DataFrame | None], schema: str) -> DataFrame:
    """What `one` makes of each shard, where the shard is read."""

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for shard, ids, body in zip(pdf["shard"], pdf["ids"], pdf["body"]):
                made = one(int(shard), Shard.open(ids, body))
                if made is not None and len(made):
                    yield made

    return shards.select("shard", "ids", "body").mapInPandas(run, schema)


def build_graph(df: DataFrame, params: GraphParams, *, id_col: str = "vec_id", vec_col: str = "embedding", shards: int | None = None, attr_col: str | None = None, sq8: tuple | None = None) -> DataFrame:
    """A graph table of df's vectors, in each shard by id. Null vectors are left out. attr_col: an integer that searches may filter by. sq8: (lo, scale), to store codes in place of floats."""
    attr = F.col(attr_col).cast("long") if attr_col else F.lit(None).cast("long")
    rows = df.where(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>").alias("vector"), attr.alias("attr"))
    shards = shards or max(1, -(-rows.count() // SHARD_ROWS))

    def made(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = list(pdfs)
        for shard, pdf in pd.concat(got).groupby("shard") if got else ():  # one, as a rule
            pdf = pdf.sort_values("id", kind="stable")
            vectors = np.array(pdf["vector"].tolist(), np.float32).astype(np.float64)
            attrs = pdf["attr"].fillna(np.iinfo(np.int64).min).to_numpy(np.int64) if attr_col else None
            yield Shard.made(pdf["id"].to_numpy(np.int64), vectors, params, attrs, sq8).row(int(shard))

    # a task each: dealt by a hash of the shard, some tasks would have several and others none
    return rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")).repartitionById(shards, "shard").mapInPandas(made, SHARDS)


def rows_of(shards: DataFrame) -> DataFrame:
    """A row for each vector: shard, label (the place in its shard), id, vector, neighbors (labels), entry."""

    def one(shard: int, s: Shard) -> pd.DataFrame:
        n = np.arange(len(s.ids))
        return pd.DataFrame({"shard": shard, "label": n, "id": s.ids, "vector": s.vectors.astype(np.float32).tolist(), "neighbors": [a[a >= 0].tolist() for a in s.adjacency], "entry": np.isin(n, s.entries)})

    return each(shards, one, GRAPH)


def hits(shards: DataFrame, queries: list[tuple[int, Sequence[float]]], k: int, *, search_complexity: int = 0, params: GraphParams | None = None, attr: int | None = None) -> DataFrame:
    """(query_idx, id, _distance, shard, label): the k nearest that the walk of each shard finds, by exact distance. Queries of another length find nothing. attr: only vectors with this attribute."""
    p = params or GraphParams()
    size = max(k, search_complexity if search_complexity > 0 else p.build_complexity)
    good = [(i, np.array(q, np.float64)) for i, q in queries if q is not None and all(x is not None for x in q)]

    def one(shard: int, s: Shard) -> pd.DataFrame | None:
        from .knn import pair_values

        own = [(i, q) for i, q in good if len(q) == s.vectors.shape[1]]
        if not own or not len(s.ids):
            return None
        allowed = None if attr is None else s.attr == attr if s.attr is not None else np.zeros(len(s.ids), bool)
        numbers, matrix = np.array([i for i, _ in own], np.int64), np.array([q for _, q in own])
        out, held = [], []

        def flush() -> None:
            which, at = (np.concatenate(x) for x in zip(*held))
            held.clear()
            exact = pair_values(p.metric, matrix, which, s.vectors, at)
            near = exact if p.metric == "l2" else -exact
            order = np.lexsort((s.ids[at], near, which))
            order = order[np.arange(len(order)) - np.searchsorted(which[order], which[order]) < k]
            which, at = which[order], at[order]
            out.append(pd.DataFrame({"query_idx": numbers[which], "id": s.ids[at], "_distance": (exact if p.metric != "ip" else near)[order], "shard": shard, "label": at}))

        for j, at in enumerate(s.search(matrix, size, p.metric, allowed)):
            held.append((np.full(len(at), j), at))
            if sum(len(x) for _, x in held) >= HELD or len(held) == TOGETHER:
                flush()
        if held:
            flush()
        return pd.concat(out)

    return each(shards, one, "query_idx long, id long, _distance double, shard int, label int")


def best(found: DataFrame, k: int, metric: str) -> DataFrame:
    """(query_idx, id, _distance, _rank): each query's k best hits, ties by id."""
    near = F.col("_distance").desc() if metric == "cosine" else F.col("_distance").asc()
    rank = F.row_number().over(Window.partitionBy("query_idx").orderBy(near, "id"))
    return found.withColumn("_rank", rank).where(F.col("_rank") <= k).select("query_idx", "id", "_distance", "_rank")


def graph_search(shards: DataFrame, queries: list[tuple[int, Sequence[float]]], k: int, *, search_complexity: int = 0, params: GraphParams | None = None, attr: int | None = None) -> DataFrame:
    """(query_idx, id, _distance, _rank): the k nearest that the walks of all shards find, by exact distance, ties by id. Queries of another length find nothing."""
    p = params or GraphParams()
    return best(hits(shards, queries, k, search_complexity=search_complexity, params=p, attr=attr), k, p.metric)


def degree_stats(shards: DataFrame) -> DataFrame:
    """One row: nodes, largest, mean and smallest degree, and nodes of degree under two."""

    def one(shard: int, s: Shard) -> pd.DataFrame:
        d = (s.adjacency >= 0).sum(1)
        return pd.DataFrame({"n": [len(d)], "most": [int(d.max(initial=0))], "total": [int(d.sum())], "least": [int(d.min(initial=1 << 30))], "few": [int((d < 2).sum())]})

    per = each(shards, one, "n long, most int, total long, least int, few long")
    return per.agg(F.sum("n").alias("nodes"), F.max("most").alias("max_degree"), (F.sum("total") / F.sum("n")).alias("avg_degree"), F.min("least").alias("min_degree"), F.sum("few").alias("less_than_two"))


def edges_of(shards: DataFrame) -> DataFrame:
    return rows_of(shards).select("shard", F.col("label").alias("src"), F.explode("neighbors").alias("dst"))


def reachable(shards: DataFrame) -> DataFrame:
    """(shard, nodes, reached): how many nodes each shard's entry points lead to."""
    return each(shards, lambda shard, s: pd.DataFrame({"shard": [shard], "nodes": [len(s.ids)], "reached": [int(reached(s.adjacency, s.entries).sum())]}), "shard int, nodes long, reached long")


def drop_deleted(shards: DataFrame, deleted: DataFrame, params: GraphParams | None = None) -> DataFrame:
    """The graph table without the ids in the first column of `deleted`: neighbours of removed vectors are reconnected, shards that lose none stay as they are, and empty ones go."""
    ids = shards.select("shard", F.posexplode("ids").alias("label", "id"))
    gone = ids.join(deleted.select(F.col(deleted.columns[0]).cast("long").alias("id")).distinct(), "id").groupBy("shard").agg(F.collect_list("label").alias("_gone"))  # a shard's labels are bounded
    return without(shards, gone, params or GraphParams())


def without(shards: DataFrame, gone: DataFrame, p: GraphParams) -> DataFrame:
    """The graph table without the labels in gone(shard, _gone)."""

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for shard, ids, body, labels in zip(pdf["shard"], pdf["ids"], pdf["body"], pdf["_gone"]):
                if labels is None:
                    yield pd.DataFrame({"shard": [shard], "ids": [ids], "body": [body]})
                elif len(labels) < len(ids):
                    yield Shard.open(ids, body).without(np.array(labels, np.int64), p).row(int(shard))

    return shards.join(gone, "shard", "left").select("shard", "ids", "body", "_gone").mapInPandas(run, SHARDS)


def medoid(df: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The row nearest to the mean of all vectors, with `_distance`: means are sums by place, one row a dimension."""
    from .knn import search

    cells = df.where(F.col(vec_col).isNotNull()).select(F.posexplode(V.doubles(F.col(vec_col))).alias("pos", "x")).groupBy("pos").agg(F.avg(F.col("x").cast("decimal(38,18)")).cast("double").alias("m"))
    return search(df, [r[1] for r in sorted(cells.collect())], 1, id_col=id_col, vec_col=vec_col)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: the share of exact (query_idx, id) pairs that were found."""
    hit = exact.select("query_idx", "id").join(found.select("query_idx", "id").distinct().withColumn("_hit", F.lit(1)), ["query_idx", "id"], "left")
    return hit.agg((F.sum(F.coalesce("_hit", F.lit(0))) / F.count(F.lit(1))).alias("recall"), F.count(F.lit(1)).alias("pairs"))

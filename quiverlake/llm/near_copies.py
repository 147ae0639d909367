"""Exact Jaccard similarity of five-word shingles over candidate pairs, and MinHash bands that bring near copies together.

SimHash balls of two bits reach few of the pairs at a similarity of 0.8, so texts
that share one of BANDS values of ROWS minimum hashes each are candidates as well.
Every link is verified on the whole sets of shingles. A value's texts are first held
against two of them only, the smallest and the one that meets most others. Texts that
these links leave apart from the bulk of a value are then held against all others of
it, in blocks of bounded size whose overlaps are products of incidence matrices: no
pair is passed over, and no table of pairs is ever made.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_rows, release, written
from .components import components

#: Words of a shingle, and similarity from which texts are near copies.
SHINGLE, ALIKE = 5, 0.8
#: Bands and minimum hashes of a band: a pair at 0.8 shares one with a probability of 0.9996.
BANDS, ROWS = 20, 5
#: Texts, and bytes of their sets, on a side of a block, about; shingles of an incidence matrix at a time.
CELL_NODES, CELL_BYTES, COLUMNS = 256, 4_000_000, 4096
#: Factor of the rolling hash, and those of the minimum hashes. Any odd numbers do.
FACTOR = np.uint64(0x9E3779B97F4A7C15)
FACTORS = np.random.default_rng(5).integers(1, 1 << 63, (BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)
MASKS = np.random.default_rng(8).integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64)


def shingles(words: list[bytes]) -> np.ndarray:
    """Distinct hashes of the shingles, sorted; of fewer words than a shingle's the one of the whole."""
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    h = np.zeros(len(w) - SHINGLE + 1, np.uint64)
    for k in range(SHINGLE):
        h = h * FACTOR + w[k : k + len(h)]
    return np.unique(h ^ h >> np.uint64(29))


def bands(grams: np.ndarray) -> list[int]:
    """A signed long for each band, none without shingles."""
    if not len(grams):
        return []
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(grams), 4096):
        h = (grams[at : at + 4096] ^ MASKS) * FACTORS
        least = np.minimum(least, h.min(1))
    value = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        value = (value ^ least[k::ROWS]) * FACTOR
        value ^= value >> np.uint64(32)
    return value.view(np.int64).tolist()


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def split(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def sets(texts: DataFrame) -> DataFrame:
    """(node, grams) for (doc_id, text): the packed set of shingles."""

    def run(batches):
        for b in batches:
            for doc_id, text in zip(b["doc_id"], b["text"]):
                yield doc_id, shingles(split(text)).tobytes()

    return fold_rows(texts, "node long, grams binary", run)


def alike(pairs: DataFrame, grams: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are at ALIKE or above."""

    def run(batches):
        for batch in batches:
            for a, b, left, right in zip(*(batch[c] for c in ("a", "b", "left", "right"))):
                if similarity(np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)) >= ALIKE:
                    yield a, b

    with_b = pairs.join(grams.select(F.col("node").alias("b"), F.col("grams").alias("right")), "b")
    both = with_b.join(grams.select(F.col("node").alias("a"), F.col("grams").alias("left")), "a")
    return fold_rows(both.select("a", "b", "left", "right"), "a long, b long", run, 64)


def meetings(nodes: DataFrame) -> DataFrame:
    """(value, node, low, top) for nodes(node, bands): the values that several nodes share, with the smallest of them and the one that meets most others."""
    member = nodes.select("node", F.explode(F.array_distinct("bands")).alias("value"))
    shared = member.groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("low")).where("n > 1")
    member = written(member.join(shared, "value"), "members")
    met = member.groupBy("node").agg(F.sum("n").alias("met"))
    top = member.join(met, "node").groupBy("value").agg(F.max(F.struct("met", -F.col("node"))).alias("most"))
    return member.join(top, "value").select("value", "node", "low", (-F.col("most.col2")).alias("top"))


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets on the left with all on the right."""
    out = np.zeros((len(left), len(right)), np.float32)
    grams = np.concatenate([*left, *right])
    order = np.argsort(grams, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], np.diff(grams[order]) > 0])) if len(grams) else np.empty(0, np.int64)
    column = np.empty(len(grams), np.int64)
    column[order] = np.repeat(np.arange(len(first)), np.diff(np.concatenate([first, [len(grams)]])))
    n = sum(map(len, left))
    row_l, row_r = (np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (left, right))
    here = (np.bincount(column[:n], minlength=len(first)) > 0) & (np.bincount(column[n:], minlength=len(first)) > 0)
    number = np.cumsum(here) - 1
    keep_l, keep_r = here[column[:n]], here[column[n:]]
    row_l, col_l, row_r, col_r = row_l[keep_l], number[column[:n][keep_l]], row_r[keep_r], number[column[n:][keep_r]]
    by_l, by_r = np.argsort(col_l, kind="stable"), np.argsort(col_r, kind="stable")
    for at in range(0, int(here.sum()), COLUMNS):
        a, b = np.zeros((len(left), COLUMNS), np.float32), np.zeros((len(right), COLUMNS), np.float32)
        for m, row, col, by in ((a, row_l, col_l, by_l), (b, row_r, col_r, by_r)):
            part = by[slice(*np.searchsorted(col[by], [at, at + COLUMNS]))]
            m[row[part], col[part] - at] = 1
        out += a @ b.T
    return out


def joined(cell: list[tuple]) -> Iterator[tuple[int, int]]:
    """Links that join up the components (node, root, side, grams) of a cell: those of all pairs of its sides at ALIKE or above."""
    sides = [[c for c in cell if c[2] == s] for s in (0, 1)]
    if not all(sides):
        return
    left, right = ([np.frombuffer(c[3], np.uint64) for c in s] for s in sides)
    both = overlaps(left, right)
    size_l, size_r = (np.array([len(x) for x in s], np.float64) for s in (left, right))
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            x = up
        return x

    for i, j in zip(*np.nonzero(both / (size_l[:, None] + size_r - both) >= ALIKE)):
        a, b = find(sides[0][i][1]), find(sides[1][j][1])
        if a != b:
            parent[a] = b
            yield sides[0][i][0], sides[1][j][0]


def rest_of(met: DataFrame, found: DataFrame, grams: DataFrame) -> DataFrame:
    """Links among the texts that meet at a value and that `found` (node, root) leaves apart.

    At each value all texts outside its most frequent component are held against
    all texts of it. Both sides go in blocks of CELL_NODES texts or CELL_BYTES of
    sets about, each block of one side with each of the other.
    """
    placed = met.join(found, "node", "left").select("value", "node", F.coalesce("root", "node").alias("root"))
    kinds = placed.groupBy("value", "root").agg(F.count(F.lit(1)).alias("n"))
    bulk = kinds.groupBy("value").agg(F.max(F.struct("n", "root")).alias("most"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("value", F.col("most.root").alias("bulk"))
    sized = placed.join(bulk, "value").join(grams.select("node", F.octet_length("grams").alias("size")), "node")
    sized = written(sized.select("value", "node", "root", "size", (F.col("root") != F.col("bulk")).alias("odd")), "apart")

    def blocks(odd):
        many, bytes_ = F.count(F.when(odd, 1)), F.coalesce(F.sum(F.when(odd, F.col("size"))), F.lit(0))
        return F.ceil(F.greatest(many / CELL_NODES, bytes_ / CELL_BYTES)).cast("int")

    counts = sized.groupBy("value").agg(blocks(F.col("odd")).alias("rows"), blocks(F.lit(True)).alias("cols"))
    at = sized.join(counts, "value")
    own = F.xxhash64("node")
    down = at.where("odd").select("value", "node", "root", F.lit(0).alias("side"), F.pmod(own, F.col("rows")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("j"))
    across = at.select("value", "node", "root", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("i"), F.pmod(own, F.col("cols")).cast("int").alias("j"))
    cells = down.unionByName(across).join(grams, "node").select("value", "i", "j", "side", "node", "root", "grams")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        for _, cell in groupby(rows, key=lambda r: r[:3]):
            if links := list(joined([(r[4], r[5], r[3], r[6]) for r in cell])):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links)], schema=schema)
        release()

    return cells.repartition("value", "i", "j").sortWithinPartitions("value", "i", "j").mapInArrow(run, "a long, b long")


def verified(nodes: DataFrame, texts: DataFrame, others: DataFrame) -> DataFrame:
    """(node, root) of the components over all links at ALIKE or above between nodes(node, bands) that share a value, and between the pairs others(a, b).

    texts(doc_id, text) has the nodes' texts. Nodes without a link aren't among the rows.
    """
    met = written(meetings(nodes), "met")
    stars = met.select(F.explode(F.array("low", "top")).alias("a"), F.col("node").alias("b")).unionByName(others.select("a", "b")).where("a <> b")
    stars = written(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "stars")
    named = met.select(F.col("node").alias("doc_id")).union(stars.select("a")).union(stars.select("b")).distinct()
    grams = written(sets(texts.select("doc_id", "text").join(named, "doc_id", "left_semi")).dropDuplicates(["node"]), "sets")
    links = written(alike(stars, grams), "links")
    return components(links.unionByName(rest_of(met, components(links), grams)))

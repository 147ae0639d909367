"""Near-duplicates by SimHash and meet-in-the-middle balls.

Two fingerprints at most 2r bits apart have a common value at most r bits from
each. So every distinct fingerprint emits its whole ball of radius r, the
values are shuffled, and fingerprints that meet are verified. All that meet at
one value are within 2r of each other, and no more than a ball's size can, so
a meeting place links its members to their smallest and no group is unbounded.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import near_copies
from .common import fold_rows, table, written
from .components import components

#: Words of a shingle, the hash's seed, and bits in which linked fingerprints may differ.
SHINGLE, SEED, BITS = 3, 42, 2


def fingerprint(text: str | None, width: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits: bit k is set if it is set in over half the XXH64 values of the text's shingles, repeats included. Without words 0."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32).tolist()
    starts = [0, *(e + 1 for e in ends)]
    ends.append(len(joined))
    digest = xxhash.xxh64_intdigest
    n = len(words) - width + 1
    total = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        h = np.array([digest(joined[a:b], seed) for a, b in zip(starts[at : min(n, at + (1 << 16))], ends[at + width - 1 :])], ">u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) for each document; fp is the fingerprint as a signed long. Null and empty texts give 0."""

    def run(batches):
        for b in batches:
            for doc_id, text in zip(b["doc_id"], b["text"]):
                f = fingerprint(text, width)
                yield doc_id, f - (1 << 64) if f >> 63 else f

    return fold_rows(docs.select("doc_id", "text"), "doc_id long, fp long", run)


def ball(radius: int) -> list[int]:
    """All masks of at most `radius` bits, as signed longs."""
    masks = [sum(1 << k for k in bits) for r in range(radius + 1) for bits in combinations(range(64), r)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(nodes: DataFrame, bits: int = BITS) -> DataFrame:
    """(a, b) between the smallest node and the others at each value that balls of radius bits / 2 share; nodes(node, fp) has distinct fingerprints.

    The links' components are those of all pairs at most `bits` (an even number) apart.
    """
    if bits % 2:
        raise ValueError("balls of half the radius need an even number of bits")
    masks = F.array(*[F.lit(m).cast("long") for m in ball(bits // 2)])
    met = nodes.select("node", "fp", F.explode(masks).alias("mask")).select("node", "fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("value"))
    first = F.min(F.struct("node", "fp")).over(Window.partitionBy("value"))
    pairs = met.withColumn("first", first).where("node <> first.node")
    return pairs.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("first.fp"))) <= bits).select(F.col("node").alias("a"), F.col("first.node").alias("b"))


def near_duplicates(docs: DataFrame, width: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable over links of fingerprints at most `bits` apart).

    Documents of one fingerprint are one node, named by their smallest doc_id,
    so copies cost nothing after that. Texts without words have fingerprint 0
    and are linked with each other; rows without a doc_id come out with a null
    component_id; repeated rows come out as often; a long text is counted in parts;
    no documents, no rows; other columns are ignored.
    """
    prints = written(fingerprints(docs, width), "prints")
    nodes = prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node"))
    nodes = written(nodes, "nodes")
    roots = components(links(nodes, bits))
    owned = nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return prints.join(owned, "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def folded(grams: np.ndarray) -> int:
    """Fingerprint, as a signed long, of a set of 64-bit hashes; 0 of none."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(grams), 1 << 16):
        total += np.unpackbits(grams[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, np.int64)
    return int.from_bytes(np.packbits(2 * total > len(grams)).tobytes(), "big", signed=True)


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, key, fp, bands) for each document, of its set of five-word shingles; texts of the same words, in any case of A-Z, have the same key."""

    def run(batches):
        for b in batches:
            for doc_id, text in zip(b["doc_id"], b["text"]):
                words = near_copies.split(text)
                grams = near_copies.shingles(words)
                yield doc_id, xxhash.xxh3_128_digest(b" ".join(words)), folded(grams), near_copies.bands(grams)

    return fold_rows(docs.select("doc_id", "text"), "doc_id long, key binary, fp long, bands array<long>", run)


def verified_duplicates(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """(doc_id, root) for each row with a doc_id: the smallest doc_id reachable over texts that are equal, or alike.

    Alike are texts whose sets of five-word shingles have a similarity of 0.8 or
    more. Candidates are the texts of one fingerprint, the fingerprints whose
    balls meet, and the texts of one MinHash band, as balls of a size that can be
    shuffled reach few pairs at 0.8; every link is verified on the whole sets. Texts
    without words are equal; repeated rows come out as often; no documents, no
    rows; other columns are ignored; a long text is a larger set.
    """
    prints = written(sketches(docs.where("doc_id is not null")), "sketches")
    nodes = written(prints.groupBy("key").agg(F.min("doc_id").alias("node"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "nodes")
    hubs = written(nodes.groupBy("fp").agg(F.min("node").alias("node")), "prints")
    same = nodes.join(hubs.select("fp", F.col("node").alias("hub")), "fp").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    roots = near_copies.verified(nodes.select("node", "bands"), docs, same.unionByName(links(hubs, bits)))
    owned = nodes.join(roots, "node", "left").select("key", F.coalesce("root", "node").alias("root"))
    return prints.select("doc_id", "key").join(owned, "key").select("doc_id", "root")


def keep_one(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """docs without the near-duplicates: of each component of verified_duplicates the smallest doc_id stays, with all its rows if it is repeated; rows without a doc_id stay."""
    gone = verified_duplicates(docs, bits).where("doc_id <> root").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of three-word shingles and their components at two bits, of all documents; odd rows as near_duplicates says."""
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op1_simhash": op1_simhash}
ORACLE: dict = {}

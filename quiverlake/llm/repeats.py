"""Exact repeats of at least a given number of words, removed wherever a smaller document has them.

Fixed-block anchors: the non-overlapping blocks of every document (a bit over
half the least repeat's length, so that each repeat holds a whole one) are
indexed, and every rolling window of that size probes the index. Only
stretches around hits are looked at again: there the windows of full length
are compared by 96-bit hashes, and adjoining ones make up the maximal repeats.

Documents are dealt once to chunks. What chunks and buckets of hashes tell
each other goes in packed, sorted, distinct hashes, not in rows, so a passage
that a third of all documents share counts once a chunk, and the index is never
in one place. Answers go back to the chunk they concern.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from .common import pack, release, table, unpack

#: Words of the least repeat that is removed.
LEAST = 13
#: Characters of a chunk and distinct hashes of a bucket, about; fewest chunks and buckets.
CHUNK_CHARS, BUCKET_HASHES, FEWEST = 2_000_000, 2_000_000, 256
#: Odd factors of the rolling hashes, and of the last mixing. Any odd numbers do.
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
MIX = np.uint64(0xFF51AFD7ED558CCD)
NONE = np.iinfo(np.int64).max

MESSAGE = StructType([StructField("bucket", IntegerType()), StructField("chunk", IntegerType()), StructField("body", BinaryType())])


def rolling(words: np.ndarray, size: int, factor: int) -> np.ndarray:
    """Hashes of all windows of `size` word hashes."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    f, out = np.uint64(factor), np.zeros(n, np.uint64)
    for k in range(size):
        out = out * f + words[k : k + n]
    out ^= out >> np.uint64(32)
    out *= MIX
    return out ^ out >> np.uint64(29)


class Chunk:
    """The documents of a chunk as one array of word hashes. Rows without id are left out of it."""

    def __init__(self, left: pa.Table, least: int) -> None:
        self.ids = left.column("doc_id").to_pylist()
        self.words = [(t or "").encode().split() for t in left.column("text").to_pylist()]
        digest = xxhash.xxh3_64_intdigest
        counted = [0 if i is None else len(w) for i, w in zip(self.ids, self.words)]
        total = sum(counted)
        self.hashes = np.fromiter((digest(x) for i, w in zip(self.ids, self.words) if i is not None for x in w), np.uint64, total)
        self.ends = np.cumsum(counted)
        self.starts = self.ends - counted
        self.doc = np.repeat(np.array([NONE if i is None else i for i in self.ids], np.int64), counted)
        self.left = np.repeat(self.ends, counted) - np.arange(total)  # words from here to the document's end
        self.place = np.arange(total) - np.repeat(self.starts, counted)
        self.least, self.block = least, (least + 1) // 2

    def blocks(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all windows of a block's size, and which of them lie within one document."""
        h = rolling(self.hashes, self.block, FACTORS[0])
        return h, self.left[: len(h)] >= self.block

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Both hashes (64 and 32 bits) of all windows of full size, and which of them lie within one document."""
        a, b = rolling(self.hashes, self.least, FACTORS[1]), rolling(self.hashes, self.least, FACTORS[2]) & np.uint64(0xFFFFFFFF)
        return a, b, self.left[: len(a)] >= self.least


def steps(values: np.ndarray) -> np.ndarray:
    """The first of sorted numbers, then the differences: small numbers pack well."""
    return np.concatenate([values[:1], np.diff(values)])


def opened(body: bytes, *kinds: str) -> list[np.ndarray]:
    """The arrays of a message."""
    first, *rest = unpack(body, *kinds)
    return [np.cumsum(first, dtype=first.dtype), *rest]


def messages(bucket: np.ndarray, bodies: list[np.ndarray], chunk: int, buckets: int) -> pa.Table:
    """One message for each bucket that has entries; entries must be sorted by bucket. A body is the arrays' parts in turn, the first, which is sorted, as steps."""
    at = np.searchsorted(bucket, np.arange(buckets + 1))
    some = np.flatnonzero(np.diff(at))
    return pa.table(
        {"bucket": pa.array(some, pa.int32()), "chunk": pa.array(np.full(len(some), chunk), pa.int32()), "body": pa.array([pack(*(steps(x[at[k] : at[k + 1]]) if n == 0 else x[at[k] : at[k + 1]] for n, x in enumerate(bodies))) for k in some.tolist()], pa.binary())},
        schema=to_arrow_schema(MESSAGE),
    )


def joined(tables: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(tables) if tables else to_arrow_schema(MESSAGE).empty_table()


def probe_messages(buckets: int, least: int, tag: str):
    """Chunk -> for each bucket the distinct block hashes (32 bits below the bucket's), and for each two flags: begins an indexed block; occurs twice here."""
    bits = np.uint64(buckets.bit_length() - 1)

    def run(left: pa.Table) -> pa.Table:
        c = Chunk(left, least)
        h, inside = c.blocks()
        anchor = (c.place[: len(h)] % c.block == 0)[inside]
        h = h[inside]
        order = np.argsort(h, kind="stable")
        h, anchor = h[order] >> (np.uint64(32) - bits), anchor[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
        flags = np.maximum.reduceat(anchor.astype(np.uint8), first) if len(first) else np.empty(0, np.uint8)
        flags = flags | (np.diff(np.concatenate([first, [len(h)]])) > 1).astype(np.uint8) << 1 if len(first) else flags
        h = h[first]
        return messages((h >> np.uint64(32)).astype(np.int64), [h.astype(np.uint32), flags], left.column(tag)[0].as_py(), buckets)

    return run


def probe_hits(group: pa.Table) -> pa.Table:
    """Bucket -> for each chunk its block hashes that are indexed somewhere and occur in more than one place."""
    if not group.num_rows:
        return to_arrow_schema(MESSAGE).empty_table()
    chunks, bodies = group.column("chunk").to_pylist(), group.column("body").to_pylist()
    values, flags = zip(*(opened(b, "<u4", "u1") for b in bodies))
    every = np.concatenate(values)
    order = np.argsort(every, kind="stable")
    every, flag = every[order], np.concatenate(flags)[order]
    first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
    many = np.diff(np.concatenate([first, [len(every)]])) > 1
    seen = np.bitwise_or.reduceat(flag, first)
    hits = every[first][((seen & 1) > 0) & (many | ((seen & 2) > 0))]
    bucket = group.column("bucket")[0].as_py()
    out = []
    for c, v in zip(chunks, values):
        own = v[np.isin(v, hits, assume_unique=True)] if len(hits) else v[:0]
        if len(own):
            out.append((bucket, c, pack(steps(own))))
    return pa.table([pa.array(x, f.type) for x, f in zip(zip(*out), to_arrow_schema(MESSAGE))], schema=to_arrow_schema(MESSAGE)) if out else to_arrow_schema(MESSAGE).empty_table()


def window_messages(buckets: int, least: int, tag: str):
    """Chunk and its hits -> for each bucket the distinct full windows about hits, as two hashes and the smallest document."""
    bits = np.uint64(buckets.bit_length() - 1)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return to_arrow_schema(MESSAGE).empty_table()
        release()
        c = Chunk(left, least)
        h, inside = c.blocks()
        known = np.sort(np.concatenate([opened(b, "<u4")[0].astype(np.uint64) | np.uint64(k) << np.uint64(32) for k, b in zip(right.column("bucket").to_pylist(), right.column("body").to_pylist())]))
        hit = np.zeros(len(h), bool)
        hit[inside] = np.isin(h[inside] >> (np.uint64(32) - bits), known)
        a, b, whole = c.windows()
        near = np.concatenate([[0], np.cumsum(hit)])
        n = len(a)
        look = whole & (near[np.arange(n) + least - c.block + 1] > near[:n])
        a, b, doc = a[look], b[look], c.doc[:n][look]
        order = np.lexsort((doc, b, a))
        a, b, doc = a[order], b[order], doc[order]
        first = np.ones(len(a), bool)
        first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        a, b, doc = a[first], b[first], doc[first]
        return messages((a >> (np.uint64(64) - bits)).astype(np.int64), [a, b.astype(np.uint32), doc], left.column(tag)[0].as_py(), buckets)

    return run


def window_owners(group: pa.Table) -> pa.Table:
    """Bucket -> for each chunk its windows that a smaller document of another chunk has, with the smallest of all documents."""
    if not group.num_rows:
        return to_arrow_schema(MESSAGE).empty_table()
    chunks, bodies = group.column("chunk").to_pylist(), group.column("body").to_pylist()
    parts = [opened(x, "<u8", "<u4", "<i8") for x in bodies]
    size = [len(p[0]) for p in parts]
    a, b, doc = (np.concatenate([p[k] for p in parts]) for k in range(3))
    order = np.lexsort((doc, b, a))
    first = np.ones(len(a), bool)
    first[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    owner = np.empty(len(a), np.int64)
    owner[order] = doc[order][first][np.cumsum(first) - 1]
    bucket, out, at = group.column("bucket")[0].as_py(), [], 0
    for c, n in zip(chunks, size):
        own = slice(at, at + n)
        less = owner[own] < doc[own]
        if less.any():
            out.append((bucket, c, pack(steps(a[own][less]), b[own][less], owner[own][less])))
        at += n
    return pa.table([pa.array(x, f.type) for x, f in zip(zip(*out), to_arrow_schema(MESSAGE))], schema=to_arrow_schema(MESSAGE)) if out else to_arrow_schema(MESSAGE).empty_table()


def removal(schema: pa.Schema, least: int):
    """Chunk and the windows that others own -> its rows with the number of words, of removed ones, and the words that stay."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return schema.empty_table()
        release()
        c = Chunk(left, least)
        a, b, whole = c.windows()
        n = len(a)
        gone = np.zeros(len(c.hashes) + 1, np.int64)
        at = np.flatnonzero(whole)
        if len(at):
            # the smallest document here that has the window
            order = at[np.lexsort((c.doc[at], b[at], a[at]))]
            first = np.ones(len(order), bool)
            first[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
            group = np.cumsum(first) - 1
            owner = c.doc[order][first]
            if right.num_rows:
                parts = [opened(x, "<u8", "<u4", "<i8") for x in right.column("body").to_pylist()]
                ra, rb, ro = (np.concatenate([p[k] for p in parts]) for k in range(3))
                by = np.lexsort((rb, ra))
                ra, rb, ro = ra[by], rb[by], ro[by]
                ua, ub = a[order][first], b[order][first]
                lo, hi = np.searchsorted(ra, ua, "left"), np.searchsorted(ra, ua, "right")
                for step in range(int((hi - lo).max(initial=0))):  # more than one only where first hashes collide
                    k = np.minimum(lo + step, len(ra) - 1)
                    same = (lo + step < hi) & (rb[k] == ub)
                    owner = np.where(same, np.minimum(owner, ro[k]), owner)
            covered = order[owner[group] < c.doc[order]]
            np.add.at(gone, covered, 1)
            np.add.at(gone, covered + least, -1)
        away = np.cumsum(gone)[:-1] > 0
        count, removed, kept = [], [], []
        for k, words in enumerate(c.words):
            count.append(len(words))
            m = away[c.starts[k] : c.ends[k]]
            removed.append(int(m.sum()))
            kept.append((b" ".join([w for w, x in zip(words, m.tolist()) if not x]) if removed[-1] else b" ".join(words)).decode())
        out = left.select(schema.names[:-3])
        for values in (count, removed, kept):
            field = schema.field(out.num_columns)
            out = out.append_column(field, pa.array(values, field.type))
        return out.cast(schema)

    return run


def power_of_two(x: float) -> int:
    return 1 << max(0, int(np.ceil(np.log2(max(1.0, x)))))


def remove_repeats(docs: DataFrame, least: int = LEAST, columns: list[str] | None = None) -> DataFrame:
    """docs (or `columns` of them) with n_words, n_removed and kept: the words left, joined by one space, after each word is removed that a window of `least` words covers whose sequence a document with a smaller doc_id has too.

    Windows are judged on the input. Words are runs of other bytes than the six
    ASCII white spaces; a null or empty text has none and keeps none. Rows
    without doc_id neither remove nor lose words; rows of one doc_id don't remove
    each other's. Repeated rows come out as often; a long text is in one chunk, which
    is then larger; no documents, no rows. All other columns pass through; those named like the three new
    ones keep their names, and the new ones then begin with two underscores.
    """
    size = docs.agg(F.sum(F.length("text")).alias("c"), F.count(F.lit(1)).alias("n")).first()
    chars = size["c"] or 0
    chunks = max(FEWEST, power_of_two(chars / CHUNK_CHARS))
    buckets = max(FEWEST, power_of_two(chars / 6 / BUCKET_HASHES))
    tag = "__chunk"
    while tag in docs.columns:
        tag += "_"
    dealt = docs.select("*", F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(chunks)).cast("int").alias(tag))
    by_chunk = lambda: dealt.groupBy(tag)
    probes = by_chunk().applyInArrow(probe_messages(buckets, least, tag), MESSAGE)
    hits = probes.groupBy("bucket").applyInArrow(probe_hits, MESSAGE)
    windows = by_chunk().cogroup(hits.groupBy("chunk")).applyInArrow(window_messages(buckets, least, tag), MESSAGE)
    owners = windows.groupBy("bucket").applyInArrow(window_owners, MESSAGE)
    through = docs.columns if columns is None else columns
    taken = set(through)
    fresh = [StructField("__" + n if n in taken else n, t) for n, t in (("n_words", LongType()), ("n_removed", LongType()), ("kept", StringType()))]
    out = StructType([*(docs.schema[c] for c in through), *fresh])
    return by_chunk().cogroup(owners.groupBy("chunk")).applyInArrow(removal(to_arrow_schema(out), least), out)


def without_repeats(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """docs with the repeats cut out of their texts, and n_chars, where there is one, counted anew; texts without repeats stay as they are, and texts of repeats alone go."""
    made = remove_repeats(docs, least)
    words, removed, kept = made.columns[-3:]
    text = F.when(F.col(removed) > 0, F.col(kept)).otherwise(F.col("text"))
    cut = made.where((F.col(removed) == 0) | (F.col(removed) < F.col(words))).withColumn("text", text)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return cut.select(*docs.columns)


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words kept and removed of every document, by windows of 13 words; odd rows as remove_repeats says."""
    made = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), columns=["doc_id"])
    return made.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


QUERIES = {"op2_repeats": op2_repeats}
ORACLE = {
    "op2_repeats": r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    w AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d)),
    o AS (SELECT s, min(doc_id) AS owner FROM w GROUP BY s),
    c AS (SELECT DISTINCT doc_id, i + k AS i FROM w JOIN o USING (s), range(13) t(k) WHERE owner < doc_id),
    x AS (SELECT d.doc_id, i, w FROM (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM d) d),
    k AS (SELECT x.doc_id, string_agg(w, ' ' ORDER BY x.i) AS kept FROM x ANTI JOIN c ON x.doc_id = c.doc_id AND x.i = c.i GROUP BY x.doc_id),
    n AS (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id)
    SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN k ON d.doc_id = k.doc_id
    """
}

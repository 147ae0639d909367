"""Bigram language model in Elias-Fano tries, and its scores of documents.

A pass over the training documents counts words. Then
documents are dealt to chunks, and each chunk sends every bucket of hashes the
distinct pairs it holds, with its training counts. A bucket's pairs make a
trie: contexts, monotone pointers to their successors, and successors relative
to their context, all Elias-Fano coded, with the pairs' probabilities in 16
bits. The chunk's pairs are looked up there and the answers go back, in the
order they came. A context's successors are spread over several buckets, so a
frequent word is in no one place. The model grows with the corpus and is never
gathered anywhere.
"""

from __future__ import annotations

import math
import mmap
import os
import struct
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from .common import pack, release, table, unpack, written

#: Characters of a chunk, and of text for a bucket, about; fewest chunks and buckets; buckets that share a context.
CHUNK_CHARS, BUCKET_CHARS, FEWEST, SPREAD = 4_000_000, 4_000_000, 256, 16
#: Steps of a stored probability to the factor two; hashes of the signs for a text's begin and end.
STEPS, BEGIN, END = 1024, np.uint64(0x1B873593CC9E2D51), np.uint64(0x38495AB5ED558CCD)
#: Questions to a trie at a time.
QUESTIONS = 100_000
#: In place of a chunk, where a bucket tells how often its contexts' successors are new.
NOVEL = -1
MESSAGE = StructType([StructField("bucket", IntegerType()), StructField("chunk", IntegerType()), StructField("body", BinaryType())])
COUNTED = StructType([StructField("bucket", IntegerType()), StructField("body", BinaryType()), StructField("first", LongType()), StructField("second", LongType())])


def held_out(doc_id):
    """Rows that the model isn't trained on; those without an id among them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(True))


#: For each byte its number of ones, and the place of its k-th one.
ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)
PLACE = np.array([([k for k in range(8) if b >> k & 1] + [8] * 8)[:8] for b in range(256)], np.uint8)


class EliasFano:
    """A monotone sequence in about 2 + log2(largest / n) bits a value, read where it lies: nothing is unpacked.

    Low bits stand packed; high parts are ones in a bit vector, each as many
    zeros after the start as it counts, with the number of ones before every 64
    bits beside it. `select` finds values, `seek` searches them, both for whole
    arrays of questions: the zeros tell which values share a high part, and only
    the low bits of these are compared.
    """

    def __init__(self, buffer, at: int = 0) -> None:
        self.n, self.low, lows, words, self.top = struct.unpack_from("<QQQQQ", buffer, at)
        at += 40
        self._lows = np.ndarray((lows - 7,), "<u8", buffer, at, (1,))
        self._high = np.frombuffer(buffer, np.uint8, 8 * words, at + lows).reshape(-1, 8)
        self._ones = np.frombuffer(buffer, "<u4", words, at + lows + 8 * words)
        self._zeros = 64 * np.arange(words) - self._ones
        self.end = at + lows + 12 * words

    @staticmethod
    def coded(values: np.ndarray) -> bytes:
        n, v = len(values), values.astype(np.uint64)
        low = min(56, max(0, (int(v[-1]) // n).bit_length() - 1)) if n else 0
        bits = (v[:, None] >> np.arange(low, dtype=np.uint64) & np.uint64(1)).astype(np.uint8)
        lows = np.packbits(bits.reshape(-1), bitorder="little").tobytes() + bytes(8)
        high = (v >> np.uint64(low)).astype(np.int64)
        top = int(high[-1]) if n else 0
        words = (n + top + 2 + 63) // 64  # a zero after the last value, at least
        flags = np.zeros(64 * words, np.uint8)
        flags[high + np.arange(n)] = 1
        ones = np.concatenate([[0], np.cumsum(flags.reshape(-1, 64).sum(1, dtype=np.int64))[:-1]]).astype("<u4")
        return struct.pack("<QQQQQ", n, low, len(lows), words, top) + lows + np.packbits(flags, bitorder="little").tobytes() + ones.tobytes()

    @staticmethod
    def _within(octets: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Places of the k-th ones in rows of eight bytes."""
        rows, many = np.arange(len(k)), ONES[octets]
        upto = np.cumsum(many, 1, dtype=np.uint8)
        at = np.minimum((upto <= k[:, None]).sum(1), 7)
        return 8 * at + PLACE[octets[rows, at], np.minimum(k - (upto[rows, at] - many[rows, at].astype(np.int64)), 7)]

    def _lows_of(self, k: np.ndarray) -> np.ndarray:
        bit = k.astype(np.int64) * self.low
        return self._lows[bit >> 3] >> (bit & 7).astype(np.uint64) & np.uint64((1 << self.low) - 1)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The k-th values."""
        k = k.astype(np.int64)
        word = np.searchsorted(self._ones, k, "right") - 1
        place = 64 * word + self._within(self._high[word], k - self._ones[word])
        return (place - k).astype(np.uint64) << np.uint64(self.low) | self._lows_of(k)

    def _upto(self, high: np.ndarray) -> np.ndarray:
        """How many values have at most this high part: the ones before the zero of that number."""
        word = np.searchsorted(self._zeros, high, "right") - 1
        return 64 * word + self._within(~self._high[word], high - self._zeros[word]) - high

    def seek(self, wanted: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Places of `wanted` in [lo, hi) each, -1 where it isn't there."""
        out = np.full(len(wanted), -1, np.int64)
        if not self.n or not len(wanted):
            return out
        high, low = (wanted >> np.uint64(self.low)).astype(np.int64), wanted & np.uint64((1 << self.low) - 1)
        inside = np.flatnonzero((high <= self.top) & (lo < hi))
        high, low = high[inside], low[inside]
        a = np.maximum(lo[inside], np.where(high > 0, self._upto(np.maximum(high - 1, 0)), 0))
        b = z = np.minimum(hi[inside], self._upto(high))
        while len(open_ := np.flatnonzero(a < b)):
            mid = (a[open_] + b[open_]) // 2
            less = self._lows_of(mid) < low[open_]
            a[open_[less]] = mid[less] + 1
            b = b.copy() if b is z else b
            b[open_[~less]] = mid[~less]
        some = np.flatnonzero(a < z)
        found = some[self._lows_of(a[some]) == low[some]]
        out[inside[found]] = a[found]
        return out


class PairTrie:
    """Two levels: contexts, and each context's successors with quantised probabilities. Opened on any buffer, a mapped file too; a question is
    a context, its pointers, and a search of the successors between these alone."""

    def __init__(self, buffer) -> None:
        self.contexts = EliasFano(buffer)
        self.pointers = EliasFano(buffer, self.contexts.end)
        self.successors = EliasFano(buffer, self.pointers.end)
        self.codes = np.frombuffer(buffer, "<u2", self.successors.n, self.successors.end)

    @staticmethod
    def coded(context: np.ndarray, word: np.ndarray, count: np.ndarray, total: int) -> bytes:
        """A trie of pairs sorted by context and word, as a string. Probabilities are those of the pairs among `total` tokens."""
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(context) else np.empty(0, np.int64)
        number = np.repeat(np.arange(len(first), dtype=np.uint64), np.diff(np.concatenate([first, [len(context)]])))
        codes = 65535 - np.rint(STEPS * np.log2(max(total, 1) / count)).astype(np.int64)
        parts = [EliasFano.coded(context[first]), EliasFano.coded(np.concatenate([first, [len(context)]])), EliasFano.coded(number << np.uint64(32) | word.astype(np.uint64))]
        return b"".join([*parts, np.clip(codes, 1, 65535).astype("<u2").tobytes()])

    def look_up(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Codes of pairs, 0 for those that never occur."""
        n = len(context)
        at = self.contexts.seek(context.astype(np.uint64), np.zeros(n, np.int64), np.full(n, self.contexts.n))
        out = np.zeros(n, np.uint16)
        some = np.flatnonzero(at >= 0)
        lo, hi = self.pointers.select(at[some]).astype(np.int64), self.pointers.select(at[some] + 1).astype(np.int64)
        place = self.successors.seek(at[some].astype(np.uint64) << np.uint64(32) | word[some].astype(np.uint64), lo, hi)
        out[some[place >= 0]] = self.codes[place[place >= 0]]
        return out


@contextmanager
def mapped(data: bytes) -> Iterator[mmap.mmap]:
    """Data as a mapped file that has no place in any folder."""
    if not hasattr(os, "memfd_create"):
        with mmap.mmap(-1, len(data)) as m:
            m[:] = data
            yield m
        return
    f = os.memfd_create("trie")
    try:
        with os.fdopen(f, "wb", closefd=False) as out:
            out.write(data)
        with mmap.mmap(f, len(data), access=mmap.ACCESS_READ) as m:
            yield m
    finally:
        os.close(f)


def probability(codes: np.ndarray) -> np.ndarray:
    """What a code says: a pair's share of all training tokens; 0 for code 0."""
    return np.where(codes > 0, np.exp2((codes.astype(np.float64) - 65535) / STEPS), 0.0)


def hashed(text: str | None) -> list[int]:
    return [xxhash.xxh3_64_intdigest(w) for w in (text or "").encode().lower().split()]


def counted(values: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, sorted, and their counts or sums of weights."""
    if weights is None:
        v, n = np.unique(values, return_counts=True)
        return v, n.astype(np.uint64)
    order = np.argsort(values, kind="stable")
    v = values[order]
    first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])) if len(v) else np.empty(0, np.int64)
    return v[first], np.add.reduceat(weights[order].astype(np.uint64), first) if len(first) else np.empty(0, np.uint64)


def cut(bucket: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """Parts of arrays sorted by bucket."""
    at = np.searchsorted(bucket, np.arange(buckets + 1))
    for k in np.flatnonzero(np.diff(at)).tolist():
        yield k, slice(int(at[k]), int(at[k + 1]))


def power_of_two(x: float) -> int:
    return 1 << max(0, math.ceil(math.log2(max(1.0, x))))


def word_counts(docs: DataFrame, buckets: int) -> DataFrame:
    """Training counts of words by bucket of their hashes."""
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    schema = to_arrow_schema(COUNTED)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                texts = whole.column(0).slice(at, 2048).to_pylist()
                words = [hashed(t) for t in texts]
                n = sum(map(len, words)) + len(words)
                now = np.fromiter((h for w in words for h in (*w, int(END))), np.uint64, n)
                values, many = counted(np.concatenate([now, np.full(len(words), BEGIN)]))
                rows = [(k, pack(values[s], many[s]), 0, 0) for k, s in cut((values >> shift).astype(np.int64), buckets)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def merge(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        parts = [unpack(b, "<u8", "<u8") for b in group.column("body").to_pylist()]
        values, many = counted(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        real = values != BEGIN
        row = (bucket, pack(values, many), int(many[real].sum()), int(real.sum()))  # tokens and words
        return pa.table([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

    return docs.where(~held_out(F.col("doc_id"))).select("text").mapInArrow(count, COUNTED).groupBy("bucket").applyInArrow(merge, COUNTED)


class Chunk:
    """A chunk's documents as word hashes: each document's words and its end, each with the word before."""

    def __init__(self, left: pa.Table, words: int, pairs: int) -> None:
        self.ids, self.held = left.column("doc_id").to_pylist(), left.column("__held").to_pylist()
        docs = [hashed(t) for t in left.column("text").to_pylist()]
        self.sizes = np.array([len(d) + 1 for d in docs], np.int64)
        self.now = np.fromiter((h for d in docs for h in (*d, int(END))), np.uint64, int(self.sizes.sum()))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.before = np.concatenate([self.now[:1], self.now[:-1]])
        self.before[self.starts] = BEGIN
        self.train = np.repeat(~np.array(self.held, bool), self.sizes)
        self._words, self._pairs = words, pairs

    def distinct_words(self) -> tuple[np.ndarray, np.ndarray]:
        values = np.unique(np.concatenate([self.now, [BEGIN]]))
        return (values >> np.uint64(64 - (self._words.bit_length() - 1))).astype(np.int64), values

    def distinct_pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bucket, pair, training count) of the distinct pairs in order, and each token's place among them."""
        pair = (self.before & np.uint64(0xFFFFFFFF)) << np.uint64(32) | self.now >> np.uint64(8) & np.uint64(0xFFFFFFFF)
        bucket = (((self.before >> np.uint64(40)) + (self.now & np.uint64(SPREAD - 1))) % np.uint64(self._pairs)).astype(np.int64)
        order = np.lexsort((pair, bucket))
        p, b = pair[order], bucket[order]
        new = np.ones(len(p), bool)
        new[1:] = (p[1:] != p[:-1]) | (b[1:] != b[:-1])
        first = np.flatnonzero(new)
        place = np.empty(len(p), np.int64)
        place[order] = np.cumsum(new) - 1
        return b[first], p[first], np.add.reduceat(self.train[order].astype(np.int64), first), place


def questions(words: int, pairs: int):
    """Chunk -> its distinct words for each word bucket, its distinct pairs with counts for each pair bucket."""

    def run(left: pa.Table) -> pa.Table:
        c = Chunk(left, words, pairs)
        chunk, rows = left.column("__chunk")[0].as_py(), []
        bucket, values = c.distinct_words()
        rows += [(k, chunk, pack(values[s])) for k, s in cut(bucket, words)]
        bucket, pair, count, _ = c.distinct_pairs()
        steps = pair.copy()
        for k, s in cut(bucket, pairs):
            steps[s][1:] = np.diff(pair[s])
            rows.append((words + k, chunk, pack(steps[s], count[s].astype("<u4"))))
        return pa.table([pa.array(x, f.type) for x, f in zip(zip(*rows), to_arrow_schema(MESSAGE))], schema=to_arrow_schema(MESSAGE))

    return run


def answers(words: int, total: int):
    """Bucket, and its words' counts -> for each chunk the counts of its words, or the codes of its pairs, in the order they came."""
    schema = to_arrow_schema(MESSAGE)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return schema.empty_table()
        bucket, chunks, bodies = left.column("bucket")[0].as_py(), left.column("chunk").to_pylist(), left.column("body").to_pylist()
        out = []
        if bucket < words:
            known, many = unpack(right.column("body")[0].as_py(), "<u8", "<u8") if right.num_rows else (np.empty(0, np.uint64),) * 2
            for body in bodies:
                (v,) = unpack(body, "<u8")
                got = np.zeros(len(v), np.uint64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, v), len(known) - 1)
                    got = np.where(known[at] == v, many[at], np.uint64(0))
                out.append(pack(got))
        else:
            asked = [unpack(b, "<u8", "<u4") for b in bodies]
            pair = np.concatenate([np.cumsum(steps, dtype=np.uint64) for steps, _ in asked])
            ends = np.cumsum([len(steps) for steps, _ in asked])
            values, place = np.unique(pair, return_inverse=True)
            many = np.bincount(place, np.concatenate([c for _, c in asked]), len(values))
            del pair
            seen = many > 0
            known, count = values[seen], many[seen]
            with mapped(PairTrie.coded(known >> np.uint64(32), known & np.uint64(0xFFFFFFFF), count, total)) as level:
                trie = PairTrie(level)
                code = np.concatenate([trie.look_up(v >> np.uint64(32), v & np.uint64(0xFFFFFFFF)) for v in np.array_split(values, -(-len(values) // QUESTIONS))])
                del trie
            out = [pack(code[p]) for p in np.split(place, ends[:-1])]
            context, owner = np.unique(known >> np.uint64(32), return_inverse=True)
            met = [pack(context, np.bincount(owner, count == 1, len(context)).astype("<u8"), np.bincount(owner, count, len(context)).astype("<u8"))]
            release()
            out, chunks = out + met, [*chunks, NOVEL]
        return pa.table([pa.array(x, f.type) for x, f in zip(([bucket] * len(out), chunks, out), schema)], schema=schema)

    return run


def novelty(told: DataFrame) -> DataFrame:
    """(bits, new, met) over the corpus: successors that a context has but once and all successors, by bits of the context's other occurrences."""
    schema, sums = to_arrow_schema(MESSAGE), "bits int, new long, met long"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, body in zip(batch.column("bucket").to_pylist(), batch.column("body").to_pylist()):
                context, single, many = unpack(body, "<u8", "<u8", "<u8")
                part = (context % np.uint64(FEWEST)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                rows = [(k, bucket, pack(*(x[order][s] for x in (context, single, many)))) for k, s in cut(part[order], FEWEST)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def add(group: pa.Table) -> pa.Table:
        parts = [unpack(b, "<u8", "<u8", "<u8") for b in group.column("body").to_pylist()]
        context, single, many = (np.concatenate(x) for x in zip(*parts))
        _, new = counted(context, single)
        _, met = counted(context, many)
        bits = np.frexp((met - np.uint64(1)).astype(np.float64))[1]
        kinds = np.unique(bits).tolist()
        return pa.table({"bits": pa.array(kinds, pa.int32()), "new": pa.array([int(new[bits == k].sum()) for k in kinds], pa.int64()), "met": pa.array([int(met[bits == k].sum()) for k in kinds], pa.int64())})

    dealt = told.where(F.col("chunk") == NOVEL).mapInArrow(deal, MESSAGE)
    return dealt.groupBy("bucket").applyInArrow(add, sums).groupBy("bits").agg(F.sum("new").alias("new"), F.sum("met").alias("met"))


def scores(schema: pa.Schema, words: int, pairs: int, total: int, vocabulary: int, fresh: list[float]):
    """Chunk and its answers -> a row for each document. fresh: by bits of a context's count, the share of the model that goes to single words."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return schema.empty_table()
        c = Chunk(left, words, pairs)
        got = dict(zip(right.column("bucket").to_pylist(), right.column("body").to_pylist()))
        bucket, values = c.distinct_words()
        count = np.zeros(len(values), np.uint64)
        for k, s in cut(bucket, words):
            (count[s],) = unpack(got[k], "<u8")
        count = count.astype(np.float64)
        now, before = count[np.searchsorted(values, c.now)], count[np.searchsorted(values, c.before)]
        bucket, pair, _, place = c.distinct_pairs()
        code = np.zeros(len(pair), np.uint16)
        for k, s in cut(bucket, pairs):
            (code[s],) = unpack(got[words + k], "<u2")
        single = (now + 1) / (total + vocabulary + 1)
        share = np.array(fresh)[np.minimum(np.frexp(before)[1], len(fresh) - 1)]
        paired = np.minimum(probability(code)[place] * max(total, 1) / np.maximum(before, 1), 1.0)
        mixed = np.where(before > 0, share * single + (1 - share) * paired, single)
        per = lambda x: np.add.reduceat(x, c.starts)
        rows = [c.ids, c.held, c.sizes, per((now > 0).astype(np.int64)), np.full(len(c.ids), total), per(np.log10(single)), per(np.log10(mixed))]
        return pa.table([pa.array(x, f.type) for x, f in zip(rows, schema)], schema=schema)

    return run


OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def lm_scores(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, learning from the rows that aren't held out.

    A pair's probability mixes its training share with its word's (add-one) share; the word's
    part is the rate at which contexts of like count met new successors in training,
    over all documents. Null and empty texts have the end alone; rows without an
    id are scored but not learnt from; repeated rows count each; a long text is in
    one chunk, which is then larger; other columns are ignored; no documents, no rows.
    """
    from pyspark.sql.types import _parse_datatype_string

    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    chunks, words = max(FEWEST, power_of_two(chars / CHUNK_CHARS)), max(FEWEST, power_of_two(chars / BUCKET_CHARS / 8))
    pairs = max(FEWEST, power_of_two(chars / BUCKET_CHARS))
    store = written(word_counts(docs, words), "words")
    sums = store.where("bucket >= 0").agg(F.sum("first"), F.sum("second")).first()
    total, vocabulary = sums[0] or 0, sums[1] or 0
    out = _parse_datatype_string(OUT)
    dealt = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("__held"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int").alias("__chunk"))
    asked = dealt.groupBy("__chunk").applyInArrow(questions(words, pairs), MESSAGE)
    known = store.where("bucket >= 0").select("bucket", "body")
    told = written(asked.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(answers(words, total), MESSAGE), "told")
    rate = {r.bits: r.new / r.met for r in novelty(told).collect()}  # one row for each bit
    fresh, last = [1.0], 1.0
    for k in range(1, max(rate, default=0) + 1):
        last = min(last, max(0.01, min(0.99, rate.get(k, last))))
        fresh.append(last)
    told = told.where(F.col("chunk") != NOVEL)
    return dealt.groupBy("__chunk").cogroup(told.groupBy("chunk")).applyInArrow(scores(to_arrow_schema(out), words, pairs, total, vocabulary, fresh), out)


def op6_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document by a model of those that aren't held out; odd rows as lm_scores says."""
    return lm_scores(table(spark, sf_dir, "documents"))


QUERIES = {"op6_ngram_lm": op6_ngram_lm}
ORACLE: dict = {}

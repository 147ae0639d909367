"""Benchmark passages in training documents: word pairs as seeds, then local alignment.

Every word pair of every item is a seed, frequent or not. An alignment of M equal
words in r unbroken runs holds M - r pairs of the item and scores M - (r - 1) at
most, so one that scores S holds S - 1 of the item's pairs. Stretches of a document
with fewer can't reach the share asked for and are left out, which loses nothing;
all others are aligned with the item by Smith-Waterman over words, and the best
score as a share of a perfect copy's decides.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold_rows, table

#: Words of a seed; words below which an item counts only whole; share of a perfect score from which a passage counts as the item's.
SEED, GRAM, SCORE = 2, 3, 0.5
#: Characters of benchmark text that go to the executors at once; larger benchmarks are taken in blocks.
BLOCK_CHARS = 8_000_000
#: Gain of an equal word, loss of a different one and of a gap.
MATCH, MISMATCH, GAP = 1, -1, -1
#: Cells of an alignment that are kept at once.
CELLS = 1 << 24
WORDS = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return WORDS.findall((text or "").lower())


class Items:
    """Benchmark items as word numbers, with their n-grams; words that no item has are -1."""

    def __init__(self, rows: list[tuple[int, str | None]], gram: int = GRAM) -> None:
        self.vocabulary: dict[str, int] = {}
        self.ids: list[int] = []
        self.words: list[np.ndarray] = []
        for item_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
            w = words_of(text)
            if w:
                self.ids.append(item_id)
                self.words.append(np.array([self.vocabulary.setdefault(x, len(self.vocabulary)) for x in w], np.int64))
        self.base = len(self.vocabulary) + 2
        if self.base**SEED > 2**62:
            raise ValueError("benchmark block with too many words for its seeds")
        places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, w in enumerate(self.words):
            for at, key in enumerate(self.keys(w, min(SEED, len(w))).tolist()):
                places[key].append((k, at))
        self.grams = np.array(sorted(places), np.int64)
        self.sizes = sorted({min(SEED, len(w)) for w in self.words})
        #: Items and places of gram g are those from first[g] to first[g + 1].
        self.first = np.cumsum([0, *(len(places[g]) for g in self.grams.tolist())])
        self.item, self.at = np.array([x for g in self.grams.tolist() for x in places[g]], np.int64).reshape(-1, 2).T
        self.least = np.array([len(w) if len(w) < gram else 0 for w in self.words], np.int64)

    def keys(self, w: np.ndarray, size: int) -> np.ndarray:
        """Keys of the n-grams of word numbers, -1 where a word is unknown."""
        if len(w) < size:
            return np.empty(0, np.int64)
        key = np.zeros(len(w) - size + 1, np.int64)
        good = np.ones(len(key), bool)
        for k in range(size):
            part = w[k : k + len(key)]
            key = key * self.base + part + 1
            good &= part >= 0
        key[~good] = -1
        return key

    def numbered(self, text: str | None) -> np.ndarray:
        got, w = self.vocabulary.get, words_of(text)
        return np.fromiter((got(x, -1) for x in w), np.int64, len(w))

    def goals(self, score: float) -> np.ndarray:
        """Scores from which an alignment counts, by item."""
        return np.maximum(np.array([score * MATCH * len(w) for w in self.words]), MATCH * self.least)

    def hits(self, w: np.ndarray, need: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """(place in the document, place in the item) of the seeds of each item that has `need` of its own, by item, in the document."""
        found, gram = [], []
        for n in self.sizes:
            key = self.keys(w, n)
            g = np.minimum(np.searchsorted(self.grams, key), len(self.grams) - 1)
            here = np.flatnonzero(self.grams[g] == key)
            found.append(here)
            gram.append(g[here])
        place, g = np.concatenate(found), np.concatenate(gram)

        def spread(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Each gram's places in items, and which gram they are of."""
            many = self.first[g + 1] - self.first[g]
            of = np.repeat(np.arange(len(g)), many)
            return np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many) + self.first[g][of], of

        slot, _ = spread(np.unique(g))
        enough = np.bincount(self.item[slot], minlength=len(need)) >= need
        out: dict[int, list[tuple[int, int]]] = defaultdict(list)
        if enough.any():
            slot, of = spread(g)
            mine = enough[self.item[slot]]
            for k, p, at in zip(self.item[slot[mine]].tolist(), place[of[mine]].tolist(), self.at[slot[mine]].tolist()):
                out[k].append((p, at))
        return out


def next_row(up: np.ndarray, doc: np.ndarray, word: int, ahead: np.ndarray) -> np.ndarray:
    """Scores of the alignments that end at an item's word and each place of a stretch, from those of the word before; not cut off at zero by gaps."""
    best = np.maximum(up + GAP, 0)
    best[1:] = np.maximum(best[1:], up[:-1] + np.where(doc == word, MATCH, MISMATCH))
    return np.maximum.accumulate(best + ahead) - ahead  # gaps in the item, the dearest first


def align(doc: np.ndarray, item: np.ndarray) -> tuple[int, int, int]:
    """(best score, first word, word after the last) of the best local alignment of an item in a stretch of a document; of equals the one that ends first.

    Up to CELLS cells the scores are kept and walked back. Beyond, two rows at a
    time are, once to find the end and once backwards from there to find the
    start, the nearest that gives the score, so memory stays in proportion to the stretch.
    """
    n = len(doc)
    ahead = -GAP * np.arange(n + 1, dtype=np.int32)
    if (len(item) + 1) * (n + 1) > CELLS:
        top, end = ending(doc, item)
        if not top:
            return 0, 0, 0
        back = np.ascontiguousarray(doc[:end][::-1])
        _, length = ending(back, item[::-1], top)
        return top, end - length, end
    rows = np.zeros((len(item) + 1, n + 1), np.int32)
    for i, w in enumerate(item, 1):
        rows[i] = next_row(rows[i - 1], doc, w, ahead)
    top = int(rows.max())
    if not top:
        return 0, 0, 0
    j, i = min((int(j), int(i)) for i, j in zip(*np.nonzero(rows == top)))
    end = j
    while rows[i, j] > 0:
        here = rows[i, j]
        if here == rows[i - 1, j - 1] + (MATCH if doc[j - 1] == item[i - 1] else MISMATCH):
            i, j = i - 1, j - 1
        elif here == rows[i - 1, j] + GAP:
            i -= 1
        else:
            j -= 1
    return top, j, end


def ending(doc: np.ndarray, item: np.ndarray, goal: int | None = None) -> tuple[int, int]:
    """(best score, the first place where an alignment of it ends), by two rows. With a goal, the first place where one of that score ends that begins at the stretch's begin, wherever it starts in the item."""
    n = len(doc)
    ahead = -GAP * np.arange(n + 1, dtype=np.int32)
    low = np.int32(-(1 << 29))
    row = np.zeros(n + 1, np.int32)
    if goal is not None:
        row[1:] = GAP * np.arange(1, n + 1)
    top, end = 0, n
    for w in item:
        if goal is None:
            row = next_row(row, doc, w, ahead)
        else:
            best = np.maximum(row + GAP, low)
            best[0] = 0  # the alignment may start at any word of the item, but at the stretch's begin alone
            best[1:] = np.maximum(best[1:], row[:-1] + np.where(doc == w, MATCH, MISMATCH))
            row = np.maximum.accumulate(best + ahead) - ahead
        most = int(row.max())
        if goal is None and most >= top:
            at = int(row.argmax())
            end = at if most > top else min(end, at)
            top = most
        elif goal is not None and most >= goal:
            end = min(end, int(np.argmax(row >= goal)))
    return top, end


def stretches(hits: list[tuple[int, int]], length: int, size: int, need: int) -> list[tuple[int, int]]:
    """Parts of a document that copies of an item of `length` words about the hits could cover; overlapping ones are one, those with under `need` of the item's places left out."""
    out: list[tuple[int, int, set[int]]] = []
    slack = length // 2 + 1
    for p, at in sorted((p - at, at) for p, at in hits):
        a, b = max(0, p - slack), min(size, p + length + slack)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b), out[-1][2] | {at} if at not in out[-1][2] else out[-1][2])
        else:
            out.append((a, b, {at}))
    return [(a, b) for a, b, held in out if len(held) >= need]


def blocks_of(benchmark: DataFrame) -> list[DataFrame]:
    """The benchmark in parts of about BLOCK_CHARS characters, whole items each."""
    chars = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    n = chars // BLOCK_CHARS + 1
    if n == 1:
        return [benchmark]
    return [benchmark.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k) for k in range(n)]


def contaminations(docs: DataFrame, benchmark: DataFrame, score: float = SCORE, gram: int = GRAM) -> DataFrame:
    """(doc_id, item_id, score, first_word, end_word) for each document and item that it holds a copy of, exact or edited.

    score is the best alignment's as a share of a perfect copy's; the words are
    those of the best place, counted from 0, the end excluded. Null and empty
    texts on either side match nothing, empty tables give no rows, repeated rows
    count each, other columns are ignored. Words are runs of letters and digits,
    lower-cased. An item of under `gram` words counts only whole. At SCORE and above
    the rows are those of aligning all pairs; where score times an item's length is
    one or less, a pair that shares no two words in a row isn't found.
    """
    out = None
    for block in blocks_of(benchmark):
        items = Items([(r[0], r[1]) for r in block.select("item_id", "text").collect()], gram)
        if items.ids:
            goals = items.goals(score)
            need = np.maximum(1, np.ceil(goals / MATCH - 1e-9).astype(np.int64) - 1)

            def run(batches, items=items, goals=goals, need=need):
                for b in batches:
                    for doc_id, text in zip(b["doc_id"], b["text"]):
                        w = items.numbered(text)
                        for k, near in sorted(items.hits(w, need).items()):
                            item = items.words[k]
                            best = (0, 0, 0)
                            for a, z in stretches(near, len(item), len(w), need[k]):
                                for lo in range(a, z, 4096):  # long stretches in overlapping parts, so memory stays bounded
                                    s, i, j = align(w[lo : min(z, lo + 4096 + 4 * len(item))], item)
                                    best = max(best, (s, -(lo + i), lo + j))
                            if best[0] and best[0] >= goals[k]:
                                yield doc_id, items.ids[k], best[0] / (MATCH * len(item)), -best[1], best[2]

            found = fold_rows(docs.select("doc_id", "text"), "doc_id long, item_id long, score double, first_word long, end_word long", run)
            out = found if out is None else out.unionByName(found)
    if out is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, score double, first_word long, end_word long")
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, score: float = SCORE) -> DataFrame:
    """docs without those that hold a copy of a benchmark item; rows without a doc_id stay, and all columns."""
    gone = contaminations(docs, benchmark, score).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that it holds a copy of; odd rows as contaminations says."""
    return contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op3_decontaminate": op3_decontaminate}
ORACLE: dict = {}

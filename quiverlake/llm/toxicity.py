"""Toxicity scores from a counterfactually regularised linear classifier.

A text is the bag of its words and of their first letters, hashed into a fixed
number of features. Weights are fitted on a bounded sample of labelled rows by
proximal gradient steps. For each labelled sentence that names a group,
copies are made in which the name is swapped for another group's; the squared
change of the score under the swap is added to the loss, so that naming a
group moves no score. L1 shrinkage sets the weights of words without bearing
to zero, so long neutral texts gather no score.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold_rows, table

#: Labelled rows that the fit uses at most: those of the smallest hashes of their ids.
FIT_ROWS = 5000
#: Standard errors by which a feature's share must differ between the labels.
SCREEN = 3.0
#: Hashed features, letters of the word beginnings, gradient steps, shrinkage, weight of the counterfactual term.
FEATURES, BEGINNINGS, STEPS, SHRINK, FAIRNESS = 1 << 18, (3, 4, 5), 300, 2e-4, 1.0
#: A score from which a text counts as toxic.
THRESHOLD = 0.3
#: Group names that are swapped for each other, by kind and language. Fixed values.
GROUPS = [
    "women men girls boys".split(),
    "woman man girl boy".split(),
    "muslims christians jews hindus buddhists atheists catholics".split(),
    "muslim christian jewish hindu buddhist atheist catholic".split(),
    "black white asian african european latino arab indian mexican chinese".split(),
    "gay lesbian straight bisexual transgender queer".split(),
    "immigrants refugees foreigners natives".split(),
    "femmes hommes filles garçons".split(),
    "musulmans chrétiens juifs athées".split(),
    "frauen männer mädchen jungen".split(),
    "muslime christen juden atheisten".split(),
    "mujeres hombres niñas niños".split(),
    "musulmanes cristianos judíos ateos".split(),
]
WORDS = re.compile(r"\w+")


def word_features(word: str) -> list[int]:
    """Hashed features of one lower-cased word: itself and its beginnings."""
    names = ["=" + word] + ["^" + word[:k] for k in BEGINNINGS if len(word) > k]
    return [zlib.crc32(n.encode()) % FEATURES for n in names]


def bag(text: str | None) -> Counter:
    return Counter(WORDS.findall((text or "").lower()))


class Model:
    """Weights and bias; `score` gives 0 to 1."""

    def __init__(self, weights: np.ndarray, bias: float) -> None:
        self.weights, self.bias = weights, bias
        self._known: dict[str, float] = {}

    def word(self, w: str) -> float:
        got = self._known.get(w)
        if got is None:
            if len(self._known) > 200_000:
                self._known.clear()
            got = self._known[w] = float(sum(self.weights[k] for k in word_features(w)))
        return got

    def score(self, text: str | None) -> float:
        """Sum over the whole text; an empty or null text scores the bias alone."""
        known = self._known.get
        total = 0.0
        for w in WORDS.findall((text or "").lower()):
            x = known(w)
            total += self.word(w) if x is None else x
        z = max(-60.0, min(60.0, self.bias + total))
        return 1 / (1 + math.exp(-z))

    def __getstate__(self) -> dict:
        at = np.flatnonzero(self.weights)
        return {"at": at, "w": self.weights[at], "n": len(self.weights), "bias": self.bias}

    def __setstate__(self, s: dict) -> None:
        self.weights = np.zeros(s["n"])
        self.weights[s["at"]] = s["w"]
        self.bias, self._known = s["bias"], {}


def swaps(words: Counter) -> list[tuple[str, str]]:
    """(name in the text, the name that stands in for it): the next of its kind, for each name met."""
    return [(g[k], g[(k + 1) % len(g)]) for g in GROUPS for k in range(len(g)) if g[k] in words]


def counted(text: str | None) -> tuple[bytes, bytes, bytes, bytes, bytes]:
    """A text's features (32-bit integers) and their counts (floats); and how many entries each group name in it has that swapping it changes, and these, alike. At most FEATURES entries each, however long the text."""

    def features(counts: list[tuple[str, float]]) -> Counter:
        out: Counter = Counter()
        for w, n in counts:
            for k in word_features(w):
                out[k] += n
        return out

    b = bag(text)
    own = features(list(b.items()))
    pairs = [features([(a, float(b[a])), (z, -float(b[a]))]) for a, z in swaps(b)]
    packed = lambda kind, values: np.array(values, kind).tobytes()
    return packed("<i4", list(own)), packed("<f4", list(own.values())), packed("<i4", [len(p) for p in pairs]), packed("<i4", [k for p in pairs for k in p]), packed("<f4", [n for p in pairs for n in p.values()])


def fit(rows: list[tuple[str | None, int]], shrink: float = SHRINK, fairness: float = FAIRNESS, steps: int = STEPS) -> Model:
    """A model from (text, label) rows, see fit_counts()."""
    return fit_counts([(counted(t), y) for t, y in rows], shrink, fairness, steps)


def fit_counts(rows: list[tuple[tuple, int]], shrink: float = SHRINK, fairness: float = FAIRNESS, steps: int = STEPS) -> Model:
    """A model from (counted(text), label) rows. No rows, or rows of one label alone, give that label's constant (0.5 x the threshold for none)."""
    labels = np.array([1.0 if y else 0.0 for _, y in rows])
    if not len(rows) or labels.min() == labels.max():
        share = (labels.sum() + 0.3) / (len(labels) + 2)
        return Model(np.zeros(FEATURES), math.log(share / (1 - share)))

    opened = lambda k, kind: [np.frombuffer(x[k], kind) for x, _ in rows]
    joined = lambda parts, kind: np.concatenate([np.empty(0, kind), *parts])
    features, swap_sizes = opened(0, "<i4"), joined(opened(2, "<i4"), "<i4")
    r, c, v = np.repeat(np.arange(len(rows), dtype=np.int32), [len(x) for x in features]), joined(features, "<i4"), joined(opened(1, "<f4"), "<f4")
    # only features whose share differs between the labels by more than chance are fitted
    total = np.bincount(c, minlength=FEATURES)
    toxic = np.bincount(c, labels[r], FEATURES)
    ones, zeros = labels.sum(), len(labels) - labels.sum()
    share = np.clip(total / len(labels), 1e-9, 1 - 1e-9)
    z = (toxic / ones - (total - toxic) / zeros) / np.sqrt(share * (1 - share) * (1 / ones + 1 / zeros))
    keep = ((np.abs(z) > SCREEN) & (total >= 3))[c]
    r, c, v = r[keep], c[keep], v[keep]
    used = np.unique(c)
    sr, sc, sv = np.repeat(np.arange(len(swap_sizes), dtype=np.int32), swap_sizes), joined(opened(3, "<i4"), "<i4"), joined(opened(4, "<f4"), "<f4")
    place = np.full(FEATURES, -1)
    place[used] = np.arange(len(used))
    c = place[c]
    keep = place[sc] >= 0 if len(sc) else np.zeros(0, bool)
    sr, sc, sv = sr[keep], place[sc[keep]] if len(sc) else sc, sv[keep]

    n = len(rows)
    positive = labels.mean()
    scale = np.sqrt(np.bincount(c, v * v, len(used)) / n) + 1e-9  # steps in units of each feature's size
    vs = v / scale[c]
    ss = sv / scale[sc] if len(sc) else sv
    weight, bias = np.zeros(len(used)), math.log(positive / (1 - positive))
    momentum, velocity, mb, vb = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    for t in range(1, steps + 1):
        z = np.clip(np.bincount(r, vs * weight[c], n) + bias, -30, 30)
        p = 1 / (1 + np.exp(-z))
        err = (p - labels) / n
        g = np.bincount(c, vs * err[r], len(used))
        if len(sr):
            change = np.bincount(sr, ss * weight[sc], len(swap_sizes))
            g += 2 * fairness / n * np.bincount(sc, ss * change[sr], len(used))
        gb = err.sum()
        momentum, velocity = 0.9 * momentum + 0.1 * g, 0.99 * velocity + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate = 0.05 / (1 + t / 100)
        step = rate / (np.sqrt(velocity / (1 - 0.99**t)) + 3e-4)
        weight = weight - step * momentum / (1 - 0.9**t)
        weight = np.sign(weight) * np.maximum(np.abs(weight) - step * shrink, 0)
        bias -= rate * (mb / (1 - 0.9**t)) / (math.sqrt(vb / (1 - 0.99**t)) + 1e-4)
    full = np.zeros(FEATURES)
    full[used] = weight / scale
    return Model(full, float(bias))


def held_out(doc_id):
    """Rows that the model isn't trained on; those without an id among them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def learn(docs: DataFrame, labels: DataFrame, bound: int = FIT_ROWS) -> Model:
    """Fits on at most `bound` labelled rows, none of them held out; whole texts are counted in tasks, so at most bound x FEATURES counts are gathered.

    Labelled ids without a document are ignored, null labels too; of repeated ids
    the largest label and the first text in order count; a null text counts as
    empty. Without rows the model is a constant.
    """
    rows = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = F.broadcast(rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound))
    texts = docs.select("doc_id", "text").join(some, "doc_id").groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.first("toxic").alias("toxic"))

    def run(batches):
        for b in batches:
            for doc_id, text, toxic in zip(b["doc_id"], b["text"], b["toxic"]):
                yield doc_id, int(toxic), *counted(text)

    got = fold_rows(texts, "doc_id long, toxic int, features binary, counts binary, sizes binary, swapped binary, changes binary", run, 64).collect()
    return fit_counts([(tuple(r)[2:], r[1]) for r in sorted(got, key=lambda r: r[0])])


def toxicity_scores(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted. Null texts score as empty ones, equal texts alike, long ones whole; rows without an id count as
    held out; repeated rows come out as often; other columns are ignored; no documents, no rows."""

    def run(batches):
        for b in batches:
            for doc_id, out, text in zip(b["doc_id"], b["held_out"], b["text"]):
                s = model.score(text)
                yield doc_id, out, s, int(s >= threshold)

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return fold_rows(rows, "doc_id long, held_out boolean, score double, predicted int", run)


def keep_civil(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that the model calls toxic; all columns stay as they are."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("double")
    def score(texts):
        return texts.map(model.score)

    return docs.where(score(F.coalesce(F.col("text"), F.lit(""))) < threshold)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document by a model of labelled rows that aren't held out; odd rows as learn and toxicity_scores say."""
    docs = table(spark, sf_dir, "documents")
    return toxicity_scores(docs, learn(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op8_toxicity": op8_toxicity}
ORACLE: dict = {}

"""URL filtering by host rules and by mined association rules.

Explicit rules come first. For a url that none of them fits, rules mined by
FP-growth decide: every labelled url is a transaction of its tokens and its
label, frequent token sets are mined on the cluster, and those that imply a
label with enough support and confidence are kept. Each token's conditional base
is grown by itself; tokens that stand in just the same labelled urls are grown as
one, as any of them makes the same rules. A url is matched through an
inverted index from token to rules: a rule fires once as many of its tokens
have been met as it has.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, fold_rows, release, table, written

#: The contract's rules: verdict, host with path.
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
#: A token set must hold in this share of the labelled urls, and imply its label in this share of those that hold it.
MIN_SUPPORT, MIN_CONFIDENCE = 0.005, 0.6


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url, both empty for null or where `://` is missing."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: Iterable[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as written, and its verdict; null where none fits."""
    name = verdict = None
    for say, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        h, _, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        name = F.when(fits, rule) if name is None else name.when(fits, rule)
        verdict = F.when(fits, say) if verdict is None else verdict.when(fits, say)
    if name is None:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return name, verdict


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """All distinct tokens: scheme, each host label by its place from the end, each folder by its depth and by itself, last segment, suffix, each query name, fragment."""
    whole = F.coalesce(url, F.lit(""))
    labels = F.reverse(F.split(host, r"\."))
    folders = F.filter(F.split(F.regexp_extract(path, r"(?s)^/(.*)/", 1), "/"), lambda x: x != "")
    names = F.regexp_extract_all(F.regexp_extract(whole, r"\?([^#]*)", 1), F.lit(r"(?:^|&)([^=&]+)"), F.lit(1))
    ends = F.array(
        F.concat(F.lit("scheme="), F.lower(F.regexp_extract(whole, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))),
        F.concat(F.lit("last="), F.regexp_extract(path, r"([^/]*)$", 1)),
        F.concat(F.lit("suffix="), F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})$", 1)),
        F.when(F.instr(whole, "#") > 0, F.lit("fragment")).otherwise(F.lit("whole")),
    )
    parts = [
        ends,
        F.transform(labels, lambda x, k: F.concat(F.lit("host"), k.cast("string"), F.lit("="), x)),
        F.transform(folders, lambda x, k: F.concat(F.lit("folder"), k.cast("string"), F.lit("="), x)),
        F.transform(folders, lambda x: F.concat(F.lit("folder="), x)),
        F.transform(names, lambda x: F.concat(F.lit("query="), x)),
    ]
    return F.array_distinct(F.concat(*parts))


def frequent_tokens(labelled: DataFrame, least: float) -> list[list[str]]:
    """Tokens that stand in `least` rows of one label or more, those that stand in just the same rows as one class; the most frequent class first."""
    marked = labelled.withColumn("_row", F.xxhash64(F.monotonically_increasing_id(), "tokens"))
    counts = marked.select("label", "_row", F.explode("tokens").alias("token")).groupBy("token", "label").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("_row").alias("mark"))
    per = counts.groupBy("token").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.bit_xor("mark").alias("mark"))
    same: dict[tuple, list[str]] = {}
    for r in per.where(F.col("most") >= least).select("token", "n", "mark").collect():  # at most tokens of a url / min_support rows
        same.setdefault((r["n"], r["mark"]), []).append(r["token"])
    return [sorted(c) for _, c in sorted(same.items(), key=lambda x: (-x[0][0], min(x[1])))]


def free_sets(last: int, at: np.ndarray, classes: np.ndarray, labels: np.ndarray, weights: np.ndarray, n_labels: int, least: float, min_confidence: float) -> list[tuple[list[int], int, float]]:
    """Rules (classes, label, confidence) of all sets whose rarest class is `last`, from its conditional base.

    The base's row k, weights[k] urls of labels[k], holds the classes[j] with
    at[j] = k, all more frequent (smaller) than `last`. Sets grow by ever smaller
    classes, each set's base projected from the one before. A set isn't grown
    when a part of it stands in just the same rows or all its rows have one
    label: any larger one would say no more than that part. A set speaks for the
    label that most of its rows have; it is given where no part that holds
    `last` says as much.
    """
    grown: dict[tuple, tuple[float, list[float]]] = {}  # count, and by label the most confidence of a rule among its parts and itself
    given: list[tuple[list[int], int, float]] = []

    def look(own: tuple, counts: list[float]) -> bool:
        """Whether the set is to be grown."""
        total, most, best = sum(counts), max(counts), [0.0] * n_labels
        for j in range(1, len(own)):
            part = grown.get(own[:j] + own[j + 1 :])
            if part is None or part[0] == total:
                return False
            best = [max(x) for x in zip(best, part[1])]
        label = counts.index(most)
        confidence = most / total
        if confidence >= min_confidence and confidence > best[label]:
            given.append((sorted(own), label, confidence))
            best[label] = confidence
        if most == total:
            return False
        grown[own] = total, best
        return True

    counts = np.bincount(labels, weights, n_labels).tolist()
    if max(counts) < least or not look((last,), counts):
        return given
    here = np.zeros(len(labels), bool)
    todo = [((last,), at, classes)]
    while todo:
        own, at, classes = todo.pop()
        if len(own) > 1:  # the base of the set before: rows that hold the class met last, and what they hold below it
            rows = at[classes == own[-1]]
            here[rows] = True
            held = here[at] & (classes < own[-1])
            here[rows] = False
            at, classes = at[held], classes[held]
        if not len(at):
            continue
        by = np.bincount(classes.astype(np.int64) * n_labels + labels[at], weights[at], own[-1] * n_labels).reshape(-1, n_labels)
        more = [c for c in np.flatnonzero(by.max(1) >= least).tolist() if look((*own, c), by[c].tolist())]
        if len(more) > 1:
            useful = np.zeros(len(by), bool)
            useful[more] = True
            held = useful[classes]
            at, classes = at[held], classes[held]
            todo += [((*own, c), at, classes) for c in reversed(more[1:])]  # smaller ones first, so that a set's parts come before it
    return given


def shortest(rules: Iterable[tuple[list[int], int, float]]) -> list[tuple[list[int], int, float]]:
    """The rules that say more than each rule of the same label that is part of them."""
    top: dict = {}  # class -> (confidence by label of the rule that ends here, deeper classes)

    def said(below: dict, items: list[int], start: int, label: int, confidence: float) -> bool:
        for j in range(start, len(items)):
            node = below.get(items[j])
            if node is not None and (node[0].get(label, 0.0) >= confidence or said(node[1], items, j + 1, label, confidence)):
                return True
        return False

    kept = []
    for items, label, confidence in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        if not said(top, items, 0, label, confidence):
            kept.append((items, label, confidence))
            below = top
            for item in items:
                node = below.setdefault(item, ({}, {}))
                below = node[1]
            node[0][label] = confidence
    return kept


def mine_classes(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> tuple[list[tuple[list[str], str, float]], list[list[str]]]:
    """mine()'s rules with one token for each class of tokens that stand in just the same rows, and the classes, that token first."""
    if labelled.isEmpty():
        return [], []
    labelled = written(labelled.select(F.array_distinct("tokens").alias("tokens"), "label"), "labelled")
    total = sorted(labelled.groupBy("label").count().collect())  # a row for each label
    names, least = [r[0] for r in total], min_support * sum(r[1] for r in total)
    classes = frequent_tokens(labelled, least)
    number = {t: k for k, c in enumerate(classes) for t in c}
    label_number = {x: k for k, x in enumerate(names)}

    def numbers(batches):
        for b in batches:
            for tokens, label in zip(b["tokens"], b["label"]):
                yield sorted({number[t] for t in tokens if t in number}), label_number[label]

    def grow(base: pa.Table) -> pa.Table:
        before = base.column("before").combine_chunks()
        at = np.repeat(np.arange(len(before)), pc.list_value_length(before).to_numpy(zero_copy_only=False))
        labels, weights = (base.column(x).to_numpy() for x in ("label", "n"))
        found = free_sets(base.column("last")[0].as_py(), at, before.flatten().to_numpy(), labels, weights.astype(float), len(names), least, min_confidence)
        release()
        return pa.table(dict(zip(("items", "label", "confidence"), map(pa.array, zip(*found), out.types))) if found else out.empty_table(), out)

    out = pa.schema([("items", pa.list_(pa.int32())), ("label", pa.int32()), ("confidence", pa.float64())])
    rows = fold_rows(labelled, "items array<int>, label int", numbers, 4096).groupBy("items", "label").agg(F.count(F.lit(1)).alias("n"))
    ends = rows.select("items", "label", "n", F.posexplode("items").alias("at", "last"))
    bases = ends.groupBy("last", F.slice("items", F.lit(1), F.col("at")).alias("before"), "label").agg(F.sum("n").alias("n"))
    found = bases.groupBy("last").applyInArrow(grow, "items array<int>, label int, confidence double").collect()
    return [([classes[k][0] for k in items], names[label], c) for items, label, c in shortest((list(r[0]), r[1], r[2]) for r in found)], classes


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> list[tuple[list[str], str, float]]:
    """Association rules (tokens, label, confidence) from a table of `tokens` and `label`.

    All frequent sets of all tokens are looked at, of any length. Rules that say
    no more than a shorter one of the same label are dropped; a set speaks for
    its most frequent label only. An empty table gives none.
    """
    rules, classes = mine_classes(labelled, min_support, min_confidence)
    alike = {c[0]: c for c in classes}
    return [(sorted(x), label, c) for items, label, c in rules for x in product(*(alike[i] for i in items))]


def mined_verdict(rows: DataFrame, rules: list[tuple[list[str], str, float]], default: str, classes: Iterable[list[str]] = ()) -> DataFrame:
    """(page_id, url, host, path, rule, said, tokens) -> the same with `mined`: the label of the most confident rule whose tokens all occur, then of the longest; the default where none does.

    Any token of a class counts as its first.
    """
    first = {t: c[0] for c in classes for t in c}
    index: dict[str, list[int]] = {}
    for k, (items, _, _) in enumerate(rules):
        for item in items:
            index.setdefault(item, []).append(k)
    size = [len(r[0]) for r in rules]
    rank = [(r[2], len(r[0]), r[1]) for r in rules]

    def judge(batches):
        seen: dict[frozenset, str] = {}
        for b in batches:
            for row in zip(b["page_id"], b["host"], b["path"], b["rule"], b["said"], b["tokens"]):
                key = frozenset(x for t in row[5] if (x := first.get(t, t)) in index)
                if key not in seen:
                    if len(seen) > 50_000:
                        seen.clear()
                    met: dict[int, int] = {}
                    for t in key:
                        for k in index[t]:
                            met[k] = met.get(k, 0) + 1
                    fired = [rank[k] for k, n in met.items() if n == size[k]]
                    seen[key] = max(fired)[2] if fired else default
                yield (*row[:4], row[4] or seen[key])

    return fold_rows(rows, "page_id long, host string, path string, rule string, verdict string", judge, 4096)


def judge_urls(pages: DataFrame, rules: Iterable[tuple[str, str]] = RULES, default: str = "allow", min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """page_id, host, path, rule and verdict for every row of pages(page_id, url).

    The urls that a rule fits are the labelled ones: from their verdicts the
    association rules are mined which judge all others. Null urls and urls
    without `://` have empty host and path and are judged like any other; rows
    that occur twice come out twice; an empty table gives an empty result;
    other columns are ignored.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, said = fitting_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), said.alias("said"), url_tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens"))
    mined, classes = mine_classes(rows.where("said is not null").select("tokens", F.col("said").alias("label")), min_support, min_confidence)
    said = rows.where("said is not null").select("page_id", "host", "path", "rule", F.col("said").alias("verdict"))
    return said.unionByName(mined_verdict(rows.where("said is null"), mined, default, classes))


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's url; odd rows as judge_urls says."""
    return judge_urls(table(spark, sf_dir, "pages"))


QUERIES = {"op9_url_rules": op9_url_rules}
ORACLE: dict = {}

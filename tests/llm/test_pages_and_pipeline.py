"""Operators on pages, and the pipeline."""

import html
import itertools
import math
import random
import re

import numpy as np

from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from quiverlake.llm import page_text, url_rules

from . import test_text_operators as plain
from .conftest import documents

SF = "/root/testdata/sf0.001"


# urls


def test_all_parts_of_a_url_are_tokens(spark):
    from pyspark.sql import functions as F

    url = "HTTPS://a.b.c.d.example.com/one/two/three/four/end.html?x=1&yy=2&z#f"
    df = spark.createDataFrame([(url,), (None,), ("nothing",)], "url string")
    host, path = url_rules.host_and_path(F.col("url"))
    rows = df.select("url", host.alias("h"), path.alias("p")).select(url_rules.url_tokens(F.col("url"), F.col("h"), F.col("p"))).collect()
    assert {"scheme=https", "host0=com", "host5=a", "folder3=four", "folder=two", "last=end.html", "suffix=html", "query=x", "query=yy", "query=z", "fragment"} <= set(rows[0][0])
    assert len(rows[0][0]) == 21 and all(None not in r[0] for r in rows)


def test_mined_verdicts_are_brute_force(spark):
    """Rules by counting all token sets of all labelled urls, and the verdicts that follow."""
    import itertools

    rng = random.Random(6)
    rows = []
    for k in range(400):
        label = rng.choice(["allow", "block"])
        tokens = {f"{c}{rng.randrange(3)}" for c in "abc"} | ({"bad"} if label == "block" and rng.random() < 0.8 else {"good"} if rng.random() < 0.5 else set())
        rows.append((sorted(tokens), label))
    n, count, hold = len(rows), {}, {}
    for tokens, label in rows:
        for size in range(1, len(tokens) + 1):
            for x in itertools.combinations(tokens, size):
                count[x] = count.get(x, 0) + 1
                hold[x, label] = hold.get((x, label), 0) + 1
    want = {}
    for (x, label), c in sorted(hold.items(), key=lambda r: (len(r[0][0]), -r[1] / count[r[0][0]], r[0][0])):
        if c >= 0.02 * n and c / count[x] >= 0.6:
            if not any(set(y) < set(x) and want[y][0] == label and want[y][1] >= c / count[x] for y in want) and (x not in want or want[x][1] < c / count[x]):
                want[x] = (label, c / count[x])
    got = url_rules.mine(spark.createDataFrame(rows, "tokens array<string>, label string"), 0.02, 0.6)
    assert {tuple(i): (label, round(c, 9)) for i, label, c in got} == {x: (label, round(c, 9)) for x, (label, c) in want.items()} and len(want) > 5
    urls = spark.createDataFrame([(k, "h", "p", None, None, t) for k, (t, _) in enumerate(rows)], "page_id long, host string, path string, rule string, said string, tokens array<string>")
    for r in url_rules.mined_verdict(urls, got, "allow").collect():
        fired = [(c, len(x), label) for x, (label, c) in want.items() if set(x) <= set(rows[r.page_id][0])]
        assert r.verdict == (max(fired)[2] if fired else "allow")


def plain_judge(url):
    url = url or ""
    if "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host, path = re.match(r"([^/?#]*)([^?#]*)", rest, re.S).groups()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for say, rule in url_rules.RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = (say, rule)
    return host, path, best and best[1], best and best[0]


ODD_URLS = [None, "", "no scheme", "http://", "HTTP://A.Example.COM/en/7x?q#f", "https://example.net/de/8", "x://notnet/de/", "x://net/de/?a=/en/", "x://net?/de/", "a://b://com/en/", "http://com/en", "http://ÄB.org/es/\n"]


def test_url_rules_are_brute_force(spark):
    urls = [r[0] for r in spark.read.parquet(f"{SF}/pages.parquet").select("url").collect()] + ODD_URLS + ["https://example.com/en/7"] * 3
    pages = spark.createDataFrame([(k, u, "x", "y") for k, u in enumerate(urls)], "page_id long, url string, rule string, host string")
    got = sorted(url_rules.judge_urls(pages).collect())
    assert len(got) == len(urls)
    for r in got:
        host, path, rule, say = plain_judge(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == say if say else r.verdict in ("allow", "block")
    assert url_rules.judge_urls(pages.where("false")).count() == 0
    assert {r.verdict for r in url_rules.judge_urls(pages.where("url is null")).collect()} == {"allow"}


def test_mined_rules_meet_support_and_confidence(spark):
    data = [(["a", "b"], "block")] * 30 + [(["a", "c"], "allow")] * 30 + [(["b", "c"], "block")] * 10 + [(["d"], "allow")]
    df = spark.createDataFrame(data, "tokens array<string>, label string")
    rules = url_rules.mine(df, 0.05, 0.8)
    for items, label, confidence in rules:
        own = [x for t, x in data if set(items) <= set(t)]
        assert own.count(label) / len(own) == confidence >= 0.8 and own.count(label) / len(data) >= 0.05
    assert {tuple(i): x for i, x, _ in rules}[("b",)] == "block"
    assert not any("d" in i for i, _, _ in rules)
    assert url_rules.mine(df.where("false")) == []


def plain_rules(rows, support, confidence):
    """Rules by counting all token sets of all rows: (set, label) -> confidence, those that say no more than a part of them left out."""
    hold = {}
    for tokens, label in rows:
        for size in range(1, len(tokens) + 1):
            for x in itertools.combinations(sorted(tokens), size):
                hold.setdefault(x, {}).setdefault(label, 0)
                hold[x][label] += 1
    want = {}
    for x in sorted(hold, key=lambda x: (len(x), x)):
        for label, c in hold[x].items():
            if c >= support * len(rows) and c / sum(hold[x].values()) >= confidence:
                parts = (y for size in range(1, len(x)) for y in itertools.combinations(x, size))
                if not any(y in want and want[y][0] == label and want[y][1] >= c / sum(hold[x].values()) for y in parts):
                    want[x] = label, c / sum(hold[x].values())
    return want


def test_rules_are_made_of_all_tokens_of_a_url(spark):
    """More tokens a url than ten, the decisive ones in pairs only, and tokens that always come together."""
    rng = random.Random(3)
    rows = []
    for _ in range(150):
        tokens = {f"{c}{rng.randrange(2)}" for c in "abcdefghi"} | {f"r{rng.randrange(9)}", "all"}
        label = "block" if ("a0" in tokens) == ("b0" in tokens) or rng.random() < 0.1 else "allow"
        tokens |= {"twin1", "twin2"} if rng.random() < (0.5 if label == "block" else 0.2) else set()
        rows.append((sorted(tokens), label))
    want = plain_rules(rows, 0.1, 0.6)
    assert {("twin1",), ("twin2",), ("a0", "b0"), ("a1", "b0")} <= set(want) and max(map(len, want)) > 3
    df = spark.createDataFrame(rows, "tokens array<string>, label string")
    got = url_rules.mine(df, 0.1, 0.6)
    assert len(got) == len(want) and {tuple(i): (label, round(c, 9)) for i, label, c in got} == {x: (label, round(c, 9)) for x, (label, c) in want.items()}
    others = [[t for t in tokens if rng.random() < 0.5] for tokens, _ in rows] + [["twin1"], ["twin2"], ["x"], []]
    urls = spark.createDataFrame([(k, "h", "p", None, None, t) for k, t in enumerate(others)], "page_id long, host string, path string, rule string, said string, tokens array<string>")
    rules, classes = url_rules.mine_classes(df, 0.1, 0.6)
    assert ["twin1", "twin2"] in classes
    for r in url_rules.mined_verdict(urls, rules, "none", classes).collect():
        fired = [(c, len(x), label) for x, (label, c) in want.items() if set(x) <= set(others[r.page_id])]
        assert r.verdict == (max(fired)[2] if fired else "none")


def test_folders_about_a_line_break_are_tokens(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("http://a.com/x\ny/z/w",)], "url string")
    host, path = url_rules.host_and_path(F.col("url"))
    tokens = df.select("url", host.alias("h"), path.alias("p")).select(url_rules.url_tokens(F.col("url"), F.col("h"), F.col("p"))).first()[0]
    assert {"folder0=x\ny", "folder1=z", "last=w"} <= set(tokens)


def test_verdicts_of_given_pages_are_brute_force(spark):
    """Of all urls that no rule fits, by all token sets of those that one fits."""
    from pyspark.sql import functions as F

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url")
    host, path = url_rules.host_and_path(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("h"), path.alias("p")).select("page_id", "url", url_rules.url_tokens(F.col("url"), F.col("h"), F.col("p")).alias("tokens")).collect()
    said = {r.page_id: plain_judge(r.url)[3] for r in rows}
    labelled = [(r.tokens, said[r.page_id]) for r in rows if said[r.page_id]]
    often = {t for t in {t for x, _ in labelled for t in x} if sum(t in x for x, _ in labelled) >= 0.05 * len(labelled)}
    want = plain_rules([([t for t in x if t in often], label) for x, label in labelled], 0.05, 0.6)
    for r in url_rules.judge_urls(pages, min_support=0.05).collect():
        tokens = next(x.tokens for x in rows if x.page_id == r.page_id)
        fired = [(c, len(x), label) for x, (label, c) in want.items() if set(x) <= set(tokens)]
        assert r.verdict == (said[r.page_id] or (max(fired)[2] if fired else "allow"))


def test_long_urls_are_mined(spark):
    """A hundred names in nearly all urls: 2**100 sets, few that say more than their parts."""
    names = [f"query=n{k}" for k in range(100)]
    rows = [([*names, "x"], "block")] * 60 + [([*names, "y"], "allow")] * 60 + [([*names[:50], "x"], "block")] * 20
    rules = {tuple(i): (label, c) for i, label, c in url_rules.mine(spark.createDataFrame(rows, "tokens array<string>, label string"), 0.05, 0.8)}
    assert rules == {("x",): ("block", 1.0), ("y",): ("allow", 1.0)}


# main text


def test_marginals_are_exact():
    """Sum-product against the sum over all labelings."""
    import random

    rng = random.Random(4)
    for size in (1, 2, 5, 9):
        nodes = [page_text.Node("x", -1, [])] + [page_text.Node("x", rng.randrange(k), []) for k in range(1, size)]
        own = [rng.gauss(0, 1.5) for _ in nodes]
        edges = [tuple(rng.gauss(0, 1) for _ in range(4)) for _ in nodes]
        total, one, pair = 0.0, [0.0] * size, [[0.0] * 4 for _ in nodes]
        for labels in itertools.product((0, 1), repeat=size):
            w = math.exp(sum(o for o, x in zip(own, labels) if x) + sum(edges[k][2 * labels[nodes[k].up] + labels[k]] for k in range(1, size)))
            total += w
            for k, x in enumerate(labels):
                one[k] += w * x
                if k:
                    pair[k][2 * labels[nodes[k].up] + x] += w
        p, pairs = page_text.marginals(nodes, own, edges)
        assert all(abs(a / total - b) < 1e-9 for a, b in zip(one, p))
        assert all(abs(a / total - b) < 1e-9 for k in range(1, size) for a, b in zip(pair[k], pairs[k]))


def template_truth(page):
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", p.replace("<b>", ""))).split()) for p in re.split(r"</?(?:p|h1)>", body)]
    return "\n\n".join(p for p in parts if p)


def test_main_text_of_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    truth = {r.page_id: template_truth(r.html) for r in pages.collect()}
    got = page_text.main_text(pages).collect()
    assert {r.page_id: r.text for r in got} == truth and all(r.n_chars == len(r.text) for r in got)


def test_held_out_layouts():
    model, wrong, n = page_text.trained(), 0, 0
    for nodes, labels in page_text.labelled_pages(80, 12345):
        p, _ = page_text.marginals(nodes, *model.potentials(nodes))
        for k, x in enumerate(nodes):
            if x.tag == "#":
                n += 1
                wrong += (p[k] >= 0.5) != labels[k]
    assert wrong / n < 0.02


def test_parser():
    texts = lambda s: [n.text for n in page_text.parse(s) if n.tag == "#"]
    assert texts("<p>a<b>b</b> &amp; c<br>d<p>e<!-- x --><script>var p='</p>'</script>f<div>g</div>") == ["ab & c d", "e f", "g"]
    assert texts("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>") == ["a", "b", "c", "d"]
    assert texts("<head><title>t</title></head><body><style>x<y</style>a<form>b<textarea>c</textarea></form>") == ["a", "b"]
    assert texts("") == [] and texts("<") in ([], ["<"])
    # end tags that HTML lets a page leave out, and hidden elements that aren't closed
    assert texts("<html><head><title>x</title><p>article<p>more") == ["article", "more"]
    assert texts("<head><meta a=b>bare text<p>p") == ["bare text", "p"]
    assert texts("<head><noscript><link></noscript><style>a</style></head>x") == ["x"]
    assert texts("<div><svg><path></div><p>after</p>") == ["after"]
    assert texts("<div>a<noscript><div>b</div>c</noscript>d</div>") == ["ad"]
    assert texts("<div><select><option>b</div>c") == ["c"]
    assert texts('<p title="a>b">c</p><p title="un>closed>d') != []


def test_deep_pages_keep_their_tree():
    nodes = page_text.parse("<div>" * 20_000 + "<p>x" * 20_000 + "</div>" * 20_000 + "y")
    deep = next(n for n in nodes if n.tag == "#")
    steps = 0
    while deep.up >= 0:
        deep, steps = nodes[deep.up], steps + 1
    assert steps == 20_002 and nodes[-1].text == "y" and nodes[-1].up == 0


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet=st.sampled_from("<>/ abp!-=\"'&;scriptdv\n"), max_size=60))
def test_any_page_is_read(page):
    page_text.trained().text(page)


def test_main_text_odd(spark):
    deep = "<div>" * 5_000 + "<p>deep down it goes on and on.</p>"
    rows = [(1, "u", None), (2, None, ""), (3, "u", deep), (4, "u", "<article><p>" + "Word. " * 50_000 + "</p></article>"), (4, "u", "x"), (None, "u", "&nbsp;&lt;")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, text string")
    got = page_text.main_text(df).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    by = {(r.page_id, r.n_chars) for r in got}
    assert (1, 0) in by and (2, 0) in by and (4, 6 * 50_000 - 1) in by
    assert page_text.main_text(df.where("false")).count() == 0


# pipeline


def run_stages(spark, docs, sf):
    from quiverlake.llm.common import written

    out = []
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf), name)
        out.append((name, docs))
    return out


def test_pipeline_is_brute_force(spark):
    from quiverlake.llm import bpe_text, decontaminate, toxicity

    table = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text for r in table.collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    stages = run_stages(spark, table, SF)
    model = toxicity.learn(table, labels)
    rows = {i: t for i, t in rows.items() if model.score(t) < 0.3}
    assert set(rows) == {r.doc_id for r in stages[0][1].collect()}
    kept, _ = plain_near_copies(sorted(rows.items()))
    rows = {i: t for i, t in rows.items() if i in kept}
    assert set(rows) == {r.doc_id for r in stages[1][1].collect()}
    cut = plain.plain_repeats(list(rows.items()))
    rows = {i: cut[i][2] if cut[i][1] else t for i, t in rows.items() if not cut[i][1] or cut[i][1] < cut[i][0]}
    assert rows == {r.doc_id: r.text for r in stages[2][1].collect()}
    bench = [(r.item_id, decontaminate.words_of(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {r.doc_id for r in stages[3][1].collect()}
    whole = {i for i, t in rows.items() if any(" ".join(w) in " ".join(decontaminate.words_of(t)) for _, w in bench if w)}
    assert whole and not whole & got
    for i in sorted(set(rows) - got):
        assert max(plain.plain_align(decontaminate.words_of(rows[i]), w) / len(w) for _, w in bench) >= 0.5
    lib = plain.library_cached(bpe_text.default_vocabulary())
    assert {r.doc_id: r.n_tokens for r in stages[4][1].collect()} == {i: len(lib.encode(rows[i], add_special_tokens=False).ids) for i in got}
    for _, df in stages[:4]:
        assert df.columns == table.columns


def plain_near_copies(held):
    """(what one document of each component keeps, links of different texts) for sorted (id, text): five-word shingles, a similarity of 0.8 or more."""

    def grams(text):
        w = (text or "").encode().lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    held = [(i, grams(t)) for i, t in held]
    root = {i: i for i, _ in held}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    linked = 0
    for k, (a, x) in enumerate(held):
        for b, y in held[:k]:
            if x == y or min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and len(x & y) >= 0.8 * len(x | y):
                linked += x != y
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i for i, _ in held if find(i) == i}, linked


def test_near_copies_are_brute_force(spark):
    """Stage 2 keeps the smallest of each component of exact five-word similarity at 0.8 or more."""
    rng = random.Random(12)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    for k, (_, text) in enumerate(rows[:60]):  # copies on both sides of 0.8
        w = text.split()
        for x in rng.sample(range(len(w)), max(1, int(len(w) * rng.choice([0.005, 0.015, 0.03, 0.05])))):
            w[x] = f"changed{x}"
        rows += [(10_000 + k, " ".join(w)), (20_000 + k, " ".join(w[3:]))]
    rows += [(30_000 + k, f"one two three four five six seven {'x' * k}") for k in range(4)] + [(40_000, "one two"), (40_001, "ONE  two")]
    kept = {r.doc_id for r in corpus_pipeline.STAGES[1][1](spark, documents(spark, rows), SF).select("doc_id").collect()}
    want, linked = plain_near_copies(sorted(rows))
    assert linked > 40 and kept == want


def test_large_groups_of_near_copies_lose_no_link(spark):
    """700 copies of one text, edited so much that a fifth is no copy of it, against all pairs."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    rows = [(1, " ".join(base))]
    for k in range(700):
        w = list(base)
        for x in rng.sample(range(150), rng.choice([1, 2, 3, 4, 5, 6])):
            w[x] = rng.choice(base)
        rows.append((2 + k, " ".join(w)))
    kept = {r.doc_id for r in corpus_pipeline.STAGES[1][1](spark, documents(spark, rows), SF).select("doc_id").collect()}
    want, _ = plain_near_copies(rows)
    assert 1 < len(want) < 500 and want <= kept and len(kept - want) <= 0.02 * len(want)


def test_overlaps_are_intersections():
    from quiverlake.llm.near_copies import overlaps

    rng = random.Random(4)
    sides = [[np.unique(np.array([rng.randrange(9000) for _ in range(rng.randrange(3000))], np.uint64)) for _ in range(n)] for n in (7, 12)]
    assert overlaps(*sides).tolist() == [[len(np.intersect1d(x, y)) for y in sides[1]] for x in sides[0]]


def test_pipeline_odd(spark, odd, nothing, tmp_path):
    for stage, (name, df) in zip(corpus_pipeline.STAGES, run_stages(spark, odd[0], SF)):
        assert df.count() > 0
    for name, df in run_stages(spark, nothing, SF):
        assert df.count() == 0
    table = spark.read.parquet(f"{SF}/documents.parquet")
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, run_stages(spark, table, SF)[-1][1].collect()))

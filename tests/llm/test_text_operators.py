"""Operators on documents, against brute force, on odd tables and on none."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from quiverlake.llm import bpe_text, decontaminate, gif_media, ngram_lm, repeats, simhash, token_files, toxicity

from .conftest import documents

SF = "/root/testdata/sf0.001"


def docs_of(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def same_rows(df, rows):
    assert sorted(str(r[0]) for r in df.select("doc_id").collect()) == sorted(str(i) for i, _ in rows)


# near-duplicates


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def plain_components(prints, bits=2):
    parent = {i: i for i in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(prints)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if (prints[a] ^ prints[b]).bit_count() <= bits:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_is_brute_force(spark):
    rows = [(r[0], r[1]) for r in docs_of(spark).select("doc_id", "text").collect()]
    rng = random.Random(3)
    for k, (_, text) in enumerate(rows[:40]):  # near copies
        w = text.split()
        w[rng.randrange(len(w))] = "changed"
        rows.append((10_000 + k, " ".join(w)))
    prints = {i: plain_fingerprint(t) for i, t in rows}
    roots = plain_components(prints)
    got = simhash.near_duplicates(documents(spark, rows)).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(i, f"{prints[i]:016x}", roots[i]) for i in prints}
    assert len(got) == len(rows)


def test_simhash_chains_are_one_component(spark):
    chain = [(k, (1 << k) - 1) for k in range(60)]
    nodes = spark.createDataFrame([(k, f - (1 << 64) if f >> 63 else f) for k, f in chain], "node long, fp long")
    from quiverlake.llm.components import components

    for task_edges in (10, 1_000_000):
        got = [(r.node, r.root) for r in components(simhash.links(nodes), task_edges).collect()]
        assert sorted(got) == [(k, 0) for k, _ in chain]


def test_hubs_and_trees_are_components(spark, monkeypatch):
    from quiverlake.llm import components as c

    rng = random.Random(8)
    edges = [(500, k) for k in range(60)] + [(700 + k, 600 + rng.randrange(100 + k)) for k in range(100)] + [(10, 900), (901, 900), (None, 3), (5, 5)]
    root = {x: x for e in edges for x in e if None not in e and e[0] != e[1]}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    df = spark.createDataFrame(edges, "a long, b long")
    for hubs in (3, 5000):
        monkeypatch.setattr(c, "HUBS", hubs)
        assert sorted((r.node, r.root) for r in c.components(df, 20).collect()) == sorted((x, find(x)) for x in root)


def test_simhash_odd(odd, nothing):
    df, rows = odd
    got = simhash.near_duplicates(df)
    same_rows(got, rows)
    by = {r.doc_id: r for r in got.collect()}
    assert by[1].component_id == by[2].component_id == by[3].component_id == 1 and by[1].fingerprint == "0" * 16
    assert by[4].component_id == by[5].component_id == 4 and by[7].component_id == 6 and by[None].component_id is None
    assert simhash.near_duplicates(nothing).count() == 0
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r[0] for r in kept.where("doc_id is not null").select("doc_id").collect()) == [1, 4, 6, 8, 9]
    assert kept.where("doc_id is null").count() == 2


# repeats


def plain_repeats(rows, least=13):
    words = {i: (t or "").encode().split() for i, t in rows}
    owner, out = {}, {}
    for i in sorted(words):
        for k in range(len(words[i]) - least + 1):
            owner.setdefault(b" ".join(words[i][k : k + least]), i)
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - least + 1):
            if owner[b" ".join(w[k : k + least])] < i:
                gone[k : k + least] = [True] * least
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), kept.decode())
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_are_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice("abc") + str(rng.randrange(6)) for _ in range(rng.randint(8, 40))) for _ in range(12)]
    rows = [(k, rng.choice([" ", "\n", "  "]).join(rng.choice(pool) if rng.random() < 0.6 else f"u{rng.random()}" for _ in range(rng.randint(0, 9)))) for k in range(80)]
    got = {r.doc_id: (r.n_words, r.n_removed, r["__kept"]) for r in repeats.remove_repeats(documents(spark, rows)).collect()}
    assert got == plain_repeats(rows)


def test_repeats_odd(spark, odd, nothing):
    df, rows = odd
    got = repeats.remove_repeats(df)
    same_rows(got, rows)
    assert got.columns == [*df.columns, "n_words", "n_removed", "__kept"]
    by = {r.doc_id: r for r in got.collect()}
    assert by[5].n_removed == by[5].n_words == by[4].n_words == 80_000 and by[4].n_removed == 0
    assert by[9].n_removed == 0 and by[1].n_words == 0
    assert repeats.remove_repeats(nothing).count() == 0
    cut = repeats.without_repeats(df)
    assert cut.columns == df.columns and 5 not in [r[0] for r in cut.select("doc_id").collect()]
    assert cut.where("doc_id = 3").first().text == "  \n\t "


def test_repeats_sql(spark):
    import duckdb

    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    want = sorted(c.sql(repeats.ORACLE["op2_repeats"]).fetchall())
    df = repeats.op2_repeats(spark, SF)
    names = [d[0] for d in c.sql(repeats.ORACLE["op2_repeats"]).description]
    assert sorted(tuple(r) for r in df.select(*names).collect()) == want


# decontamination


def test_long_items_align_in_two_rows(monkeypatch):
    """Beyond CELLS the score and the end are the same, and the words from the start to the end hold that score."""
    rng = random.Random(5)
    for _ in range(60):
        item = np.array([rng.randrange(6) for _ in range(rng.randrange(1, 14))])
        doc = np.array([rng.randrange(7) - 1 for _ in range(rng.randrange(30))], np.int64)
        whole = decontaminate.align(doc, item)
        monkeypatch.setattr(decontaminate, "CELLS", 0)
        got = decontaminate.align(doc, item)
        monkeypatch.undo()
        assert (got[0], got[2]) == (whole[0], whole[2]) or not got[0] == whole[0] == 0
        if got[0]:
            assert got[1] >= whole[1] and decontaminate.align(doc[got[1] : got[2]], item)[0] == got[0]


def plain_align(doc, item):
    best, h = 0, [[0] * (len(doc) + 1) for _ in range(len(item) + 1)]
    for i in range(1, len(item) + 1):
        for j in range(1, len(doc) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (1 if item[i - 1] == doc[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=25), st.lists(st.integers(0, 4), min_size=1, max_size=12))
def test_alignment_is_brute_force(doc, item):
    score, a, z = decontaminate.align(np.array(doc), np.array(item))
    assert score == plain_align(doc, item)
    if score:
        assert plain_align(doc[a:z], item) == score


def test_decontamination_finds_planted_copies(spark):
    rng = random.Random(5)
    bench = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = [" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(200)) for _ in range(30)]
    rows, want = [(k, t) for k, t in enumerate(clean)], set()
    for k, (item, text) in enumerate(bench[:12]):
        w = text.split()
        for x in range(5, len(w), 9):  # every ninth word is another
            w[x] = "other"
        rows.append((100 + k, clean[k] + " " + (text if k % 2 else " ".join(w)).upper() + " " + clean[k + 1]))
        want.add((100 + k, item))
    b = spark.createDataFrame([*bench, (9_000, None), (9_001, "")], "item_id long, text string")
    got = decontaminate.contaminations(documents(spark, rows), b).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    for r in got:
        assert r.first_word >= 200 and r.score >= 0.5
    kept = decontaminate.keep_clean(documents(spark, rows), b)
    assert sorted(r[0] for r in kept.select("doc_id").collect()) == list(range(30))


@pytest.mark.parametrize("edited", [0.15, 0.2, 0.25, 0.3])
def test_decontamination_is_alignment_of_all_pairs(spark, edited):
    """Edited copies, some of items that are whole elsewhere, and copies with a word put in after every other."""
    rng = random.Random(int(edited * 100))
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(300)]
    bench = [(k, [rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 8, *range(20, 60)]))]) for k in range(40)]
    rows = []
    for k, words in bench:
        copy = []
        for at, w in enumerate(words):
            kind = rng.randrange(3) if rng.random() < edited else 3
            copy += [[], ["new" + w], [w, "more"], [w]][kind] if k % 10 else [w, "more"] if at % 2 else [w]
        around = [[rng.choice(vocabulary) for _ in range(rng.randrange(30))] for _ in range(2)]
        rows.append((k, " ".join(around[0] + copy + around[1])))
    rows += [(100 + k, " ".join(w)) for k, w in bench[::4]]
    b = spark.createDataFrame([(k, " ".join(w)) for k, w in bench], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.contaminations(documents(spark, rows), b).collect()}
    scores = {(i, k): plain_align(t.split(), w) / len(w) for i, t in rows for k, w in bench}
    want = {pair: s for pair, s in scores.items() if s >= 0.5}
    assert got == pytest.approx(want) and len(want) > 30


def test_decontamination_odd(spark, odd, nothing):
    df, rows = odd
    b = spark.createDataFrame([(1, "one"), (2, "a b c d e f"), (3, None), (4, "a b c d e f")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminations(df, b).collect()}
    assert got == {(6, 1), (7, 1), (9, 2), (9, 4)}
    assert decontaminate.contaminations(nothing, b).count() == 0
    assert decontaminate.contaminations(df, b.where("false")).count() == 0
    blocks = decontaminate.BLOCK_CHARS
    try:
        decontaminate.BLOCK_CHARS = 6
        assert {(r.doc_id, r.item_id) for r in decontaminate.contaminations(df, b).collect()} == got
    finally:
        decontaminate.BLOCK_CHARS = blocks


# subwords and token files


def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


ODD_TEXTS = ["", "a", "Hello  wORLD's é日本<|endoftext|> x 12\u0301 \u0301a İΣΣ ΑΣ b\x85c\x1cd\tz don't 'S <|ENDOFTEXT|> <|startoftext|><|", "\x00\x01 \ufeff a\u200bb 😀👍🏽 1234 ½ ñ n\u0303 it's'' 'sa'll a1b2..c ÀÉÎÕÜßÿ×÷ªº", " two  spaces \n\n x\ty ", "x\u3000y\u2028z\u180ew"]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("aAbé ß\n\t'sdtre0129.,!İΣς日\u0301\u00a0\u2028<|>endoftext"), max_size=40))
def test_bpe_is_the_library(text):
    path = bpe_text.default_vocabulary()
    c, lib = bpe_text.codec(path), library_cached(path)
    e = lib.encode(text, add_special_tokens=False)
    assert c.digest(text) == (len(e.ids), " ".join(map(str, e.ids)), lib.decode(e.ids, skip_special_tokens=False))
    assert c.encode(text) == e.ids


_LIBS = {}


def library_cached(path):
    if path not in _LIBS:
        _LIBS[path] = library(path)
    return _LIBS[path]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("aAbé ß\n\t'sdtre0129.,!日\u0301\u00a0\u2028\u180e<|>endoftext"), max_size=40))
def test_pieces_are_the_library(text):
    path = token_files.default_vocabulary()
    got = np.frombuffer(token_files.encoder(path).encode(text), "<u4").tolist()
    assert got == library_cached(path).encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aAbé ß\n\t'sdtre0129.,!日×÷ÿÃ\x00\u00a0<|>endoftext"), max_size=60), max_size=9))
def test_pieces_of_many_texts_are_the_library(texts):
    path = token_files.default_vocabulary()
    got = [np.frombuffer(x, "<u4").tolist() for x in token_files.encoder(path).encode_many(texts)]
    assert got == [e.ids for e in library_cached(path).encode_batch(texts, add_special_tokens=False)]


def test_pieces_of_documents_are_the_library():
    import pyarrow.parquet as pq

    path = token_files.default_vocabulary()
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()]
    texts += ["x" * 5000 + " y", " ".join("ab" * k for k in range(90)), "é" * 70 + " " + "a1!" * 30, *ODD_TEXTS]
    got = [np.frombuffer(x, "<u4").tolist() for x in token_files.encoder(path).encode_many(texts)]
    assert got == [e.ids for e in library_cached(path).encode_batch(texts, add_special_tokens=False)]


def test_pieces_are_forgotten_and_replaced(monkeypatch):
    import pyarrow.parquet as pq

    path = token_files.default_vocabulary()
    monkeypatch.setattr(token_files, "SLOTS", 6)
    monkeypatch.setattr(token_files, "STORE", 300)
    small = token_files.PieceEncoder(path)
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()][:60]
    want = [e.ids for e in library_cached(path).encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):
        got = [np.frombuffer(x, "<u4").tolist() for k in range(0, len(texts), 4) for x in small.encode_many(texts[k : k + 4])]
        assert got == want


def test_bpe_query(spark, odd, nothing):
    df, rows = odd
    lib = library_cached(bpe_text.default_vocabulary())
    rows = [*rows, *enumerate(ODD_TEXTS, 100)]
    got = bpe_text.bpe_digests(documents(spark, rows), bpe_text.default_vocabulary())
    want = []
    for i, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert bpe_text.bpe_digests(nothing, bpe_text.default_vocabulary()).count() == 0
    assert bpe_text.bpe_tokens(df, bpe_text.default_vocabulary()).where("doc_id = 6").first().token_ids == lib.encode("one", add_special_tokens=False).ids


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5), max_size=60), max_size=8), st.data())
def test_shards_come_back(lists, data):
    ids = [np.array(x, "<u4").tobytes() for x in lists]
    s = token_files.Shard(token_files.write_shard([None if k == 1 else k for k in range(len(ids))], ids))
    assert s.all().astype("<u4").tobytes() == b"".join(ids)
    for k, x in enumerate(lists):
        a = data.draw(st.integers(0, len(x)))
        b = data.draw(st.integers(a, len(x)))
        assert s.document(k, a, b).tolist() == x[a:b]


def test_repair_shrinks_what_repeats():
    ids = np.array(list(range(50)) * 400, np.int64)
    seq, rules, _, _ = token_files.repair(ids, np.array([len(ids)]))
    assert len(seq) + 2 * len(rules) < len(ids) / 20


def test_repair_is_near_one_pair_at_a_time():
    import pyarrow.parquet as pq

    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()]
    ids = np.concatenate([np.frombuffer(x, "<u4") for x in token_files.encoder(token_files.default_vocabulary()).encode_many(texts[:40])]).astype(np.int64)[:20_000]
    seq, rules, _, _ = token_files.repair(ids, np.array([len(ids)]))
    plain, made, symbol = ids.tolist(), 0, int(ids.max()) + 1
    while True:
        pairs = Counter(zip(plain, plain[1:]))
        best = max(pairs, key=lambda p: (pairs[p], p), default=None)
        if best is None or pairs[best] < token_files.RARE:
            break
        out, k = [], 0
        while k < len(plain):
            hit = k + 1 < len(plain) and (plain[k], plain[k + 1]) == best
            out.append(symbol if hit else plain[k])
            k += 1 + hit
        plain, made, symbol = out, made + 1, symbol + 1
    assert made > 200 and len(seq) + 2 * len(rules) <= 1.03 * (len(plain) + 2 * made)


def test_token_files(spark, odd, nothing):
    df, rows = odd
    lib = library_cached(token_files.default_vocabulary())
    from quiverlake.llm.common import shared_dir

    path = shared_dir(spark) + "/t.parquet"
    token_files.write_token_files(df, token_files.default_vocabulary(), path, shard_ids=50)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.token_file_digests(token_files.read_token_files(spark, path)).collect())
    assert [r[1] for r in got] == sorted([i for i, _ in rows], key=lambda i: (i is not None, i or 0))
    at, texts = 0, {i: t for i, t in rows if i is not None}
    for start, i, n, crc in got:
        assert start == at
        at += n
        if i is not None:
            ids = [*lib.encode(texts[i] or "", add_special_tokens=False).ids, 0]
            assert (n, crc) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    path = shared_dir(spark) + "/none.parquet"
    token_files.write_token_files(nothing, token_files.default_vocabulary(), path)
    assert token_files.token_file_digests(token_files.read_token_files(spark, path)).count() == 0


# language model


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**60), max_size=50), st.lists(st.integers(0, 2**60), max_size=10))
def test_elias_fano(values, others):
    v = np.array(sorted(set(values)), np.uint64)
    e = ngram_lm.EliasFano(ngram_lm.EliasFano.coded(v))
    assert (e.select(np.arange(len(v))) == v).all()
    ask = np.array([*values, *others], np.uint64)
    place = {int(x): k for k, x in enumerate(v)}
    got = e.seek(ask, np.zeros(len(ask), np.int64), np.full(len(ask), len(v)))
    assert got.tolist() == [place.get(int(x), -1) for x in ask]


def test_pair_trie_in_a_mapped_file(tmp_path):
    import mmap

    pairs = sorted({(a * 7919 % 97, b * 104729 % 89) for a in range(60) for b in range(9)})
    c, w = (np.array(x, np.uint64) for x in zip(*pairs))
    n = np.arange(1, len(pairs) + 1, dtype=np.float64)
    (tmp_path / "t").write_bytes(ngram_lm.PairTrie.coded(c, w, n, 10_000))
    with open(tmp_path / "t", "rb") as f:
        trie = ngram_lm.PairTrie(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
        got = ngram_lm.probability(trie.look_up(c, w))
        assert np.allclose(got, n / 10_000, rtol=1e-3)
        assert (trie.look_up(c, w + np.uint64(1000)) == 0).all() and (trie.look_up(c + np.uint64(1000), w) == 0).all()


def plain_lm(rows):
    words = [(i, [*(w.decode() for w in (t or "").encode().lower().split()), "\0"]) for i, t in rows]
    held = [i is None or zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    one = Counter(w for (_, ws), h in zip(words, held) if not h for w in ws)
    two = Counter(p for (_, ws), h in zip(words, held) if not h for p in zip(["\1", *ws], ws))
    n, v = sum(one.values()), len(one)
    return words, held, one, two, n, v


def test_lm_base_and_counts(spark, odd):
    rows = [(r[0], r[1]) for r in docs_of(spark).select("doc_id", "text").collect()] + odd[1]
    words, held, one, two, n, v = plain_lm(rows)
    got = ngram_lm.lm_scores(documents(spark, rows)).collect()
    want = sorted((str(i), h, len(w), sum(one[x] > 0 for x in w), n, round(sum(math.log10((one[x] + 1) / (n + v + 1)) for x in w), 4)) for (i, w), h in zip(words, held))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    out = [r for r in got if r.held_out and r.doc_id is not None]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_lm_probabilities_sum_to_one(spark):
    """Over all continuations of one context the model's probabilities are a distribution."""
    train = [(k, t) for k, t in enumerate(["a b", "a b", "a c", "b a", "c c a"] * 4) if zlib.crc32(str(k).encode()) % 7 != 2]
    texts = ["z", *(f"z {x}" for x in "abc"), *(f"z {a} {x}" for a in "abc" for x in "abcz")]
    probe = [k for k in range(5_000, 6_000) if zlib.crc32(str(k).encode()) % 7 == 2][: len(texts)]
    rows = [*train, *zip(probe, texts)]
    scored = {r.doc_id: r for r in ngram_lm.lm_scores(documents(spark, rows)).collect()}
    _, _, one, _, n, v = plain_lm(rows)
    assert scored[probe[0]].train_tokens == n
    p = {t: 10 ** scored[k].score for k, t in zip(probe, texts)}
    # after a word that training lacks, the next one has its single probability, so all others can be taken apart
    single = {x: (one[x] + 1) / (n + v + 1) for x in ["a", "b", "c", "\0"]}
    begins = p["z"] / single["\0"]
    ends = {a: p[f"z {a}"] / (begins * single[a]) for a in "abc"}
    for a in "abc":
        after = {x: p[f"z {a} {x}"] / (begins * single[a] * ends[x]) for x in "abc"} | {"z": p[f"z {a} z"] / (begins * single[a] * single["\0"])}
        assert abs(sum(after.values()) + ends[a] - 1) < 2e-3  # 1024 steps to the factor two


def test_lm_novelty_is_of_the_corpus(spark):
    """Scores are those of rates counted over all documents, however the rows are dealt."""
    rng = random.Random(4)
    rows = [(k, " ".join(f"w{int(rng.paretovariate(0.6)) % 300}" for _ in range(5))) for k in range(5_000)]
    words, held, one, two, n, v = plain_lm(rows)
    one["\1"] = held.count(False)
    met, new = Counter(), Counter()
    for (a, _), c in two.items():
        new[(one[a] - 1).bit_length()] += c == 1
    for a, c in one.items():
        met[(c - 1).bit_length()] += c if a != "\0" else 0
    fresh = [1.0]
    for k in range(1, max(met) + 1):
        fresh.append(min(fresh[-1], max(0.01, min(0.99, new[k] / met[k]))) if met[k] else fresh[-1])

    def score(ws):
        out = 0.0
        for a, b in zip(["\1", *ws], ws):
            single, share = (one[b] + 1) / (n + v + 1), fresh[min(one[a].bit_length(), len(fresh) - 1)]
            out += math.log10(share * single + (1 - share) * two[a, b] / one[a] if one[a] else single)
        return out

    got = {r.doc_id: r.score for r in ngram_lm.lm_scores(documents(spark, rows)).collect()}
    assert got == pytest.approx({i: score(ws) for i, ws in words}, rel=2e-3)


def test_lm_odd(spark, odd, nothing):
    assert ngram_lm.lm_scores(nothing).count() == 0
    held = documents(spark, [(k, "x y") for k in range(30) if zlib.crc32(str(k).encode()) % 7 == 2])
    assert all(r.base_score == 0 and r.train_tokens == 0 and r.n_known == 0 for r in ngram_lm.lm_scores(held).collect())


# toxicity


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.op8_toxicity(spark, sf).join(labels, "doc_id").collect()
    out = [r for r in got if r.held_out]
    right = sum(r.predicted == r.toxic for r in out)
    assert right / len(out) > 0.9
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3) for r in got)
    model = toxicity.learn(docs, labels)
    assert toxicity.keep_civil(docs, model).columns == docs.columns


def test_swapped_names_move_no_score():
    rng = random.Random(2)
    common = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(400):
        bad = k % 4 == 0
        w = [rng.choice(common) for _ in range(20)] + (["scum", "idiot"] if bad else [])
        if rng.random() < (0.8 if bad else 0.1):  # a group named mostly in toxic rows
            w.append("muslims")
        elif rng.random() < 0.3:
            w.append("christians")
        rows.append((" ".join(w), int(bad)))
    plain, fair = toxicity.fit(rows, fairness=0.0), toxicity.fit(rows, fairness=50.0)
    text = " ".join(common[:20])
    gap = lambda m: abs(m.score(text + " muslims") - m.score(text + " christians"))
    assert gap(fair) < gap(plain) and gap(fair) < 0.02
    assert fair.score(text + " scum idiot") > 0.3


def plain_toxicity(rows, fairness):
    """The same penalised likelihood, one whole matrix of counts and the same steps, texts read word by word."""
    names = sorted({f for t, _ in rows for w in toxicity.WORDS.findall(t.lower()) for f in toxicity.word_features(w)})
    col = {f: k for k, f in enumerate(names)}

    def vector(words):
        out = np.zeros(len(names))
        for w, n in words:
            for f in toxicity.word_features(w):
                if f in col:
                    out[col[f]] += n
        return out

    bags = [Counter(toxicity.WORDS.findall(t.lower())) for t, _ in rows]
    x, y = np.array([vector(b.items()) for b in bags]), np.array([float(l) for _, l in rows])
    moved = []
    for b in bags:
        for g in toxicity.GROUPS:
            for k, name in enumerate(g):
                if b[name]:
                    moved.append(vector([(name, b[name]), (g[(k + 1) % len(g)], -b[name])]))
    met, n = (x > 0).sum(0), len(rows)
    there = ((x > 0) * y[:, None]).sum(0)
    z = (there / y.sum() - (met - there) / (n - y.sum())) / np.sqrt(met / n * (1 - np.clip(met / n, 0, 1 - 1e-9)) * (1 / y.sum() + 1 / (n - y.sum())))
    keep = (abs(z) > toxicity.SCREEN) & (met >= 3)
    x, swap = x[:, keep], np.array(moved)[:, keep]
    size = np.sqrt((x**2).mean(0)) + 1e-9
    x, swap = x / size, swap / size
    weight, bias = np.zeros(x.shape[1]), math.log(y.mean() / (1 - y.mean()))
    m, v, mb, vb = 0 * weight, 0 * weight, 0.0, 0.0
    for t in range(1, toxicity.STEPS + 1):
        err = (1 / (1 + np.exp(-(x @ weight + bias))) - y) / n
        g = x.T @ err + 2 * fairness / n * swap.T @ (swap @ weight)
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g**2, 0.9 * mb + 0.1 * err.sum(), 0.99 * vb + 0.01 * err.sum() ** 2
        rate = 0.05 / (1 + t / 100)
        step = rate / (np.sqrt(v / (1 - 0.99**t)) + 3e-4)
        weight = weight - step * m / (1 - 0.9**t)
        weight = np.sign(weight) * np.maximum(abs(weight) - step * toxicity.SHRINK, 0)
        bias -= rate * (mb / (1 - 0.9**t)) / (math.sqrt(vb / (1 - 0.99**t)) + 1e-4)
    full = dict(zip(np.array(names)[keep].tolist(), (weight / size).tolist()))
    return lambda t: 1 / (1 + math.exp(-bias - sum(full.get(f, 0.0) for w in toxicity.WORDS.findall(t.lower()) for f in toxicity.word_features(w))))


def test_toxicity_is_brute_force(spark):
    """Scores of a fit on the cluster are those of a plain one, on rows that it saw and others."""
    rng = random.Random(21)
    rows = []
    for k in range(300):
        bad = rng.random() < 0.4
        w = [f"w{rng.randrange(80)}" for _ in range(rng.randrange(3, 30))] + rng.choices(["awful", "idiot", "scum"], k=2) * bad
        rows.append((k, " ".join(w + rng.choices(["muslims", "christians", "Women", "juifs"], k=rng.randrange(2 + bad))), int(bad)))
    df = documents(spark, [(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, 0, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    model = toxicity.learn(df, labels)
    plain = plain_toxicity([(t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 4 != 2], toxicity.FAIRNESS)
    got = {r.doc_id: r.score for r in toxicity.toxicity_scores(df, model).collect()}
    assert all(abs(got[i] - plain(t)) < 1e-4 for i, t, _ in rows) and np.ptp(list(got.values())) > 0.5


def test_toxicity_odd(spark, odd, nothing):
    df, rows = odd
    labels = spark.createDataFrame([(6, 0, 1), (9, 1, 0), (77, 0, 1), (8, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.learn(df, labels)
    got = toxicity.toxicity_scores(df, model)
    same_rows(got, rows)
    assert all(0 <= r.score <= 1 for r in got.collect())
    by = {r.doc_id: r.score for r in got.collect()}
    assert by[1] == by[2] and by[6] == by[7]
    none = toxicity.learn(nothing, labels.where("false"))
    assert toxicity.toxicity_scores(nothing, none).count() == 0 and 0 < none.score("x") < 0.3


# GIF


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=3000), st.integers(1, 4))
def test_gif_round_trip(data, times):
    payload = gif_media.payload_of((data * times).decode("latin-1"))[1]
    _, _, frames = gif_media.read_gif(gif_media.write_gif(payload))
    assert b"".join(f.samples for f in frames) == payload


def test_gif_headers_allot_nothing(spark):
    huge = b"GIF89a" + (65535).to_bytes(2, "little") * 2 + bytes(3)
    frame = gif_media.write_gif(b"x" * 64)
    at = frame.index(b"\x2c", 13 + 3 * 256)
    wide = frame[: at + 5] + (65535).to_bytes(2, "little") * 2 + frame[at + 9 :]
    df = spark.createDataFrame([(1, bytearray(huge)), (2, bytearray(wide)), (3, bytearray(frame)), (4, None)], "doc_id long, gif binary")
    assert [r.doc_id for r in gif_media.gif_frames(df).collect()] == [3]


def test_gif_long_payload_takes_frames():
    payload = bytes(random.Random(1).randrange(256) for _ in range(1 << 12)) * 300
    w, h, frames = gif_media.read_gif(gif_media.write_gif(payload), screens=False)
    assert len(frames) == 2 and b"".join(f.samples for f in frames) == payload and frames[1].start == 10


def gif(frames, palette=((255, 0, 0), (0, 255, 0), (0, 0, 255), (0, 0, 0)), size=(2, 2)):
    """frames: (box, samples, delay, disposal, transparent index or None, interlaced)"""
    out = b"GIF89a" + bytes([size[0], 0, size[1], 0, 0x81, 0, 0]) + bytes(v for c in palette for v in c)
    for (x, y, w, h), px, delay, disposal, clear, lace in frames:
        out += b"\x21\xf9\x04" + bytes([disposal << 2 | (clear is not None), delay, 0, clear or 0, 0])
        codes = [4, *(c for p in px for c in (p, 4)), 5]  # a clear code after each keeps three bits
        bits = sum(c << 3 * k for k, c in enumerate(codes))
        body = bits.to_bytes(len(codes) * 3 // 8 + 1, "little")
        out += b"\x2c" + bytes([x, 0, y, 0, w, 0, h, 0, 0x40 if lace else 0, 2, len(body)]) + body + b"\0"
    return out + b";"


def test_gif_rules():
    data = gif([((0, 0, 2, 2), [0, 1, 2, 3], 5, 1, None, False), ((1, 0, 1, 2), [2, 1], 7, 2, 1, False), ((0, 0, 1, 1), [1], 9, 3, None, False), ((1, 1, 1, 1), [0], 1, 0, None, False)])
    w, h, f = gif_media.read_gif(data)
    red, green, blue, black = (255, 0, 0, 255), (0, 255, 0, 255), (0, 0, 255, 255), (0, 0, 0, 255)
    see = lambda k: [tuple(int(v) for v in p) for p in f[k].screen.reshape(-1, 4)]
    assert (w, h, [x.start for x in f], [x.duration for x in f]) == (2, 2, [0, 5, 12, 21], [5, 7, 9, 1])
    assert see(0) == [red, green, blue, black]
    assert see(1) == [red, blue, blue, black]  # the transparent sample leaves what is there
    assert see(2) == [green, (0, 0, 0, 0), blue, (0, 0, 0, 0)]  # the second's box is cleared
    assert see(3) == [red, (0, 0, 0, 0), blue, red]  # the third is taken back
    assert gif_media.histogram(f[0].screen).sum() == 4 and gif_media.histogram(f[2].screen).sum() == 2
    _, _, laced = gif_media.read_gif(gif([((0, 0, 1, 9), [0, 1, 2, 3, 0, 1, 2, 3, 0], 0, 0, None, True)], size=(1, 9)))
    order = [0, 8, 4, 2, 6, 1, 3, 5, 7]
    rows = laced[0].screen.reshape(-1, 4)
    assert [tuple(int(v) for v in rows[y]) for y in order] == [[red, green, blue, black][k % 4] for k in range(9)]


def test_gif_broken():
    for data in (b"", b"GIF89a", b"PNG" * 9):
        with pytest.raises(ValueError):
            gif_media.read_gif(data)
    whole = gif_media.write_gif(b"abc".ljust(64, b"\0"))
    for n in range(13, len(whole)):
        gif_media.read_gif(whole[:n])


def test_gif_query(spark, odd, nothing):
    df, rows = odd
    got = gif_media.stored_payloads(df).collect()
    assert len(got) == len(rows)
    texts = {i: t or "" for i, t in rows if i is not None}
    for r in got:
        if r.doc_id is not None:
            raw = texts[r.doc_id].encode()
            p = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    by = {r.doc_id: r[1:] for r in got}
    assert by[4] == by[5] and by[1] == by[2]
    assert gif_media.stored_payloads(nothing).count() == 0
    media = spark.createDataFrame([(1, bytearray(gif([((0, 0, 2, 2), [0, 1, 2, 3], 5, 1, None, False)]))), (2, None), (3, bytearray(b"x"))], "doc_id long, gif binary")
    frames = gif_media.gif_frames(media).collect()
    assert [(r.doc_id, r.frame, r.duration_cs, sum(r.histogram)) for r in frames] == [(1, 0, 5, 4)]

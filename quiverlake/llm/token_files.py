"""Token-id files, compressed by Re-Pair grammars.

Documents are dealt by ranges of their ids and encoded; runs of documents
make shards. In a shard the frequent neighbouring pairs are replaced by
nonterminals, round by round from the most frequent down, until no pair is
frequent. A shard's file holds the rules, the length each nonterminal expands
to, the reduced sequence in as many bytes as its largest symbol needs, and where
each document begins in it, so any document or range of ids is decoded alone.
Files are binary values of a Parquet table in the shared folder: every store
that Spark writes can hold them.
"""

from __future__ import annotations

import json
import re
import struct
import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe_text import byte_signs
from .common import fold_rows, shared_dir, table

#: Ids of a shard at least, if its partition has them; a pair this rare stays; the id that ends each document.
SHARD_IDS, RARE, END = 1 << 18, 4, 0
#: Characters that are encoded together, about; bytes of a piece that is compared as numbers, and of a word that merges with others at once.
TEXT_CHARS, WIDE, LONG = 4_000_000, 24, 60
#: Bits of the number of pieces whose ids a worker keeps, and their ids at most. A matter of memory, never of results.
SLOTS, STORE = 19, 4_000_000
#: Signs that are no white space in any library: a lone space or line feed between two of them is where the splitter always cuts.
SAFE = "!-~\u00a1-\u167f"
CUT = re.compile(f"(?<=[{SAFE}])(?=[ \n][{SAFE}])")
REGULAR = re.compile(f"\n?[{SAFE}](?:.*[{SAFE}])?", re.S)
#: Pieces of visible ASCII and the letters of Latin-1, the splitter's rule on them, and the signs that stand for their bytes. Fixed values.
PLAIN = re.compile(r"[ \n]?[!-~À-ÖØ-öø-ÿ]+")
PLAIN_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[!-/:-@\[-`{-~]+|\n")
#: Kinds of bytes: letters, digits, other visible signs but apostrophes, and second bytes of Latin-1 letters.
KINDS = np.zeros(256, np.int8)
KINDS[33:127], KINDS[48:58], KINDS[39] = 3, 2, 0
KINDS[65:91] = KINDS[97:123] = 1
KINDS[0x80:0xC0], KINDS[[0x97, 0xB7]] = 4, 0
#: A round takes pairs down to the most frequent one's count by this; an odd factor that scatters pairs over a round's table.
SPAN, HASH = 16, np.int64(0x1E3779B97F4A7C15)
MAGIC = b"QRPG2\0\0\0"


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each run, one run after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


class Merges:
    """Byte-level merges of many words side by side: each round merges every word's first pair of least rank, until no word has a pair."""

    NONE = 1 << 40

    def __init__(self, model: dict) -> None:
        ids, signs = model["vocab"], byte_signs()
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.bytes = np.array([ids.get(signs[b], -1) for b in range(256)], np.int64)
        key = np.array([ids[a] << 32 | ids[b] for a, b in pairs] or [-1], np.int64)
        order = np.argsort(key, kind="stable")
        first = np.concatenate([[True], np.diff(key[order]) > 0])  # of a pair that stands twice the smaller rank
        self.key, self.rank = key[order][first], order[first]
        self.into = np.array([ids[a + b] for a, b in pairs] or [-1], np.int64)
        one, two = np.divmod(np.arange(1 << 16), 256)
        self._bytes = self.ranks(self.bytes[one], self.bytes[two])

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], self.NONE)

    def words(self, data: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, one after the other, number of ids of each) of words of n bytes each that stand side by side in data; none is empty."""
        sym = self.bytes[data]
        word, start = np.arange(len(n)), np.cumsum(n) - n
        size = np.zeros(len(n), np.int64)
        if not len(n):
            return sym, size
        ready: list[tuple[np.ndarray, np.ndarray]] = []
        rank = np.full(len(sym), self.NONE)
        rank[:-1] = self._bytes[data[:-1].astype(np.int64) << 8 | data[1:]]
        rank[start + n - 1] = self.NONE  # a word's last symbol has no pair
        while len(word):
            best = np.minimum.reduceat(rank, start)
            done = best == self.NONE
            if done.any():
                size[word[done]] = n[done]
                ready.append((word[done], sym[spread(start[done], n[done])]))
                left = spread(start[~done], n[~done])
                sym, rank, best, word, n = sym[left], rank[left], best[~done], word[~done], n[~done]
                start = np.cumsum(n) - n
                if not len(word):
                    break
            of = np.repeat(np.arange(len(n)), n)
            hit = np.flatnonzero(rank == best[of])
            owner = of[hit]
            hit = hit[np.concatenate([[True], owner[1:] != owner[:-1]])]  # the first of each word
            sym[hit] = self.into[best]
            stay = np.ones(len(sym), bool)
            stay[hit + 1] = False
            last = rank[hit + 1] == self.NONE
            last &= hit + 2 == start + n  # the merged symbol is its word's last now
            sym, rank = sym[stay], rank[stay]
            n = n - 1
            start = np.cumsum(n) - n
            at = hit - np.arange(len(hit))  # one symbol has gone from each word before
            after = at[~last]
            rank[at[last]] = self.NONE
            rank[after] = self.ranks(sym[after], sym[after + 1])
            before = at[at > start] - 1
            rank[before] = self.ranks(sym[before], sym[before + 1])
        flat = np.empty(int(size.sum()), np.int64)
        begin = np.cumsum(size) - size
        for w, ids in ready:
            flat[spread(begin[w], size[w])] = ids
        return flat, size


class PieceEncoder:
    """Ids as little-endian unsigned 32-bit integers, as the tokenizers library gives them for whole texts.

    A text is cut where the splitter always cuts. The distinct pieces of many
    texts are encoded once, words of visible ASCII and Latin-1 letters by Merges and
    all else by the library, and each text's ids are put together from them.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self._own = Tokenizer.from_file(path)
        self._own.no_padding()
        self._own.no_truncation()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        rule, model = spec["pre_tokenizer"] or {}, spec["model"]
        self._plain = spec["normalizer"] is None and rule.get("type") == "ByteLevel" and rule["use_regex"] and not rule["add_prefix_space"]
        self._plain &= model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        self._merges = Merges(model) if self._plain else None
        self._plain &= self._merges is not None and bool((self._merges.bytes >= 0).all())
        # pieces met lately: their bytes and size, and where their ids are
        self._keys = [np.zeros(1 << SLOTS, np.uint64) for _ in range(WIDE // 8 + 1)]
        self._begin, self._size = np.zeros(1 << SLOTS, np.int32), np.zeros(1 << SLOTS, np.int32)
        self._store, self._used = np.zeros(STORE, np.int32), 0
        self._special = [t.content for t in self._own.get_added_tokens_decoder().values()]

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int64) for e in self._own.encode_batch_fast(texts, add_special_tokens=False)]

    def _visible(self, raw: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which pieces are of visible ASCII without apostrophes and of Latin-1 letters alone, ids of these with a space before, number of ids of each)."""
        data = raw[spread(starts, size)]
        kind = KINDS[data]
        first = np.cumsum(size) - size
        lead, tail = data == 0xC3, kind == 4
        pair = np.zeros(len(data), bool)
        pair[1:] = lead[:-1]
        bad = (kind == 0) & ~lead | (lead & ~np.concatenate([tail[1:], [False]])) | (tail & ~pair)
        good = np.bincount(np.repeat(np.arange(len(size)), size), bad, len(size)) == 0
        left = np.repeat(good, size)
        data, kind, size = data[left], np.where(kind[left] >= 4, 1, kind[left]), size[good]
        kind[data == 0xC3] = 1
        # words are runs of a kind, and a piece's first one has the space
        at = np.cumsum(size) - size
        new = np.concatenate([[True], kind[1:] != kind[:-1]]) if len(kind) else np.zeros(0, bool)
        new[at] = True
        spaced = np.full(len(data) + len(at), 32, np.uint8)
        spaced[np.arange(len(data)) + np.repeat(np.arange(1, len(at) + 1), size)] = data
        begin = np.flatnonzero(new)
        owner = np.searchsorted(at, begin, "right") - 1
        begin = begin + owner + (begin != at[owner])  # in spaced, the space itself for a first word
        ids, many = self._merges.words(spaced, np.diff(np.concatenate([begin, [len(spaced)]])))
        return good, ids, np.bincount(owner, many, len(at)).astype(np.int64)

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, one after the other, number of ids of each)."""
        number: dict[bytes, int] = {}
        of, many, other = [], [], []
        for k, p in enumerate(pieces):
            if self._plain and len(p) <= LONG and PLAIN.fullmatch(p):
                words = PLAIN_WORDS.findall(p)
                many.append(len(words))
                of += [number.setdefault(w.encode(), len(number)) for w in words]
            else:
                many.append(1)
                of.append(-1)
                other.append(k)
        flat, size = self._merges.words(np.frombuffer(b"".join(number), np.uint8), np.array([len(w) for w in number], np.int64)) if number else (np.empty(0, np.int64),) * 2
        apart = self._ids([pieces[k] for k in other])
        index = np.array(of, np.int64)
        index[index < 0] = len(size) + np.arange(len(other))
        flat = np.concatenate([flat, *apart])
        size = np.concatenate([size, np.array([len(x) for x in apart], np.int64)])
        begin = np.cumsum(size) - size
        total = np.bincount(np.repeat(np.arange(len(pieces)), many), size[index], len(pieces)).astype(np.int64)
        return flat[spread(begin[index], size[index])], total

    @staticmethod
    def _distinct(raw: bytes, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """For each place of up to WIDE bytes the place of an equal one, the same for all that are equal, -1 for longer and empty ones; its bytes and size as numbers; and a hash of these."""
        data = raw + bytes(WIDE)
        eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
        mask = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
        keys = [eight[starts + at] & mask[np.clip(size - at, 0, 8)] for at in range(0, WIDE, 8)]
        keys.append(size.astype(np.uint64))
        mixed = keys[0] * np.uint64(0x9E3779B97F4A7C15)
        for k in keys[1:]:
            mixed = (mixed ^ mixed >> np.uint64(29) ^ k) * np.uint64(0xBF58476D1CE4E5B9)
        hashed = mixed.copy()
        out = np.full(len(starts), -1, np.int64)
        todo = np.flatnonzero((size > 0) & (size <= WIDE))
        bits = (4 * len(todo) + 1).bit_length()
        table = np.empty(1 << bits, np.int64)
        while len(todo):  # a slot stands for one of its pieces; another that falls into it waits for the next round
            slot = mixed[todo] >> np.uint64(64 - bits)
            table[slot] = todo
            first = table[slot]
            same = np.logical_and.reduce([k[first] == k[todo] for k in keys])
            out[todo[same]] = first[same]
            todo = todo[~same]
            mixed[todo] = (mixed[todo] ^ mixed[todo] >> np.uint64(31)) * np.uint64(0x94D049BB133111EB) + np.uint64(1)
        return out, keys, hashed

    def _known(self, keys: list[np.ndarray], hashed: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the pieces at `own` are kept from earlier texts, their slots)."""
        slot = (hashed[own] >> np.uint64(64 - SLOTS)).astype(np.int64)
        return np.logical_and.reduce([k[slot] == new[own] for k, new in zip(self._keys, keys)]), slot

    def _keep(self, keys: list[np.ndarray], own: np.ndarray, slot: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        """Keeps the ids of pieces, each in place of what was in its slot; when the room is used up all are forgotten."""
        if self._used + len(ids) > len(self._store):
            self._keys[-1][:] = 0
            self._used = 0
        if len(ids) <= len(self._store):
            for k, new in zip(self._keys, keys):
                k[slot] = new[own]
            self._begin[slot], self._size[slot] = self._used + np.cumsum(size) - size, size
            self._store[self._used : self._used + len(ids)] = ids
            self._used += len(ids)

    def encode_many(self, texts: list[str]) -> list[bytes]:
        pieces: dict[str, int] = {}
        row: list[np.ndarray | None] = [None] * len(texts)
        put = lambda p: pieces.setdefault(p, len(pieces))
        some = []
        for k, t in enumerate(texts):
            if any(s in t for s in self._special):
                continue
            head, _, tail = (cut := t.replace("\n", " \n")).partition(" ")
            if tail and head and REGULAR.fullmatch(head[-1]):
                some.append((k, head, cut[len(head) + 1 :]))
            else:
                row[k] = np.array([-2 - put(p) for p in CUT.split(t)] if t else [], np.int64)
        flat, begin, size = (np.empty(0, np.int64) for _ in range(3))
        if some:
            raw = " ".join(x[2] for x in some).encode()
            space = np.flatnonzero(np.frombuffer(raw, np.uint8) == 32)
            starts, ends = np.concatenate([[0], space + 1]), np.concatenate([space, [len(raw)]])
            same, keys, hashed = self._distinct(raw, starts, ends - starts)
            own = np.flatnonzero(same == np.arange(len(same)))
            good, slot = self._known(keys, hashed, own)
            held, new = np.flatnonzero(good), np.flatnonzero(~good)
            flat, begin, size = self._store[: self._used], self._begin[slot[held]], self._size[slot[held]]
            place = held
            if self._plain and len(new):
                fit, ids, many = self._visible(np.frombuffer(raw, np.uint8), starts[own[new]], (ends - starts)[own[new]])
                good[new[fit]] = True
                place = np.concatenate([held, new[fit]])
                flat, begin, size = np.concatenate([flat, ids]), np.concatenate([begin, len(flat) + np.cumsum(many) - many]), np.concatenate([size, many])
                self._keep(keys, own[new[fit]], slot[new[fit]], ids, many)
            # places of pieces in the end: those whose ids are here, then the others, counted down from -2; -1 for what can't be cut there
            index = np.full(len(starts), -1, np.int64)
            index[own[place]] = np.arange(len(place))
            for at in [*own[~good].tolist(), *np.flatnonzero((same < 0) & (ends > starts)).tolist()]:
                p = raw[starts[at] : ends[at]].decode()
                if REGULAR.fullmatch(p):
                    index[at] = -2 - put(p if p[0] == "\n" else " " + p)
            short = same >= 0
            index[short] = index[same[short]]
            after = np.cumsum([x[2].count(" ") + 1 for x in some])
            for (k, head, _), a, z in zip(some, [0, *after.tolist()], after.tolist()):
                if (index[a:z] == -1).any():
                    row[k] = np.array([-2 - put(p) for p in CUT.split(texts[k])], np.int64)
                else:
                    row[k] = np.concatenate([[-2 - put(head)], index[a:z]])
        here, (ids, many) = len(size), self._pieces(list(pieces))
        flat, begin, size = np.concatenate([flat, ids]), np.concatenate([begin, len(flat) + np.cumsum(many) - many]), np.concatenate([size, many])
        order = np.concatenate([r for r in row if r is not None] or [np.empty(0, np.int64)]).astype(np.int64)
        order = np.where(order < 0, here - 2 - order, order)
        ids = flat[spread(begin[order], size[order])].astype("<u4").tobytes()
        upto, out, at, i = np.concatenate([[0], np.cumsum(size[order])]), [], 0, 0
        for k, r in enumerate(row):
            if r is None:
                out.append(self._ids([texts[k]])[0].astype("<u4").tobytes())
            else:
                out.append(ids[4 * at : 4 * (at := int(upto[(i := i + len(r))]))])
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    if path not in _ENCODERS:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def encoded(e: PieceEncoder, batches):
    """(doc_id, ids) of all rows, encoded some TEXT_CHARS characters at a time."""
    ids, texts, chars = [], [], 0
    for b in batches:
        for doc_id, text in zip(b["doc_id"], b["text"]):
            ids.append(doc_id)
            texts.append(text or "")
            chars += len(texts[-1])
            if chars >= TEXT_CHARS:
                yield from zip(ids, e.encode_many(texts))
                ids, texts, chars = [], [], 0
    yield from zip(ids, e.encode_many(texts))


def repair(ids: np.ndarray, ends: np.ndarray, rare: int = RARE) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(sequence, rules as (left, right), places in the sequence after each document, first nonterminal) of ids whose documents end after `ends`.

    No pair reaches over a document's end. A round takes the pairs at least a
    SPAN-th as frequent as the most frequent one; of overlapping places every
    second one is replaced. A pair's count never rises after its symbols are
    there, so only places of frequent pairs and those beside new symbols are
    looked at again.
    """
    seq = ids.astype(np.int32)
    last = np.zeros(len(seq), bool)
    last[ends - 1] = True
    first = symbols = int(seq.max(initial=0)) + 1
    rules: list[np.ndarray] = []
    factor = HASH
    some = np.flatnonzero(~last[:-1])
    while len(some):
        pair = seq[some].astype(np.int64) << 32 | seq[some + 1]
        room = 1 << max(10, min(22, (len(some) // 2).bit_length() + 1))
        bin_ = pair * factor >> np.int64(40) & np.int64(room - 1)
        # a bin stands for one of its pairs; another that falls into it waits for a later round
        bins = np.zeros(room, np.int64)
        bins[bin_] = pair
        own = bins[bin_] == pair
        counts = np.bincount(bin_[own], minlength=room)
        count = np.where(own, counts[bin_], 0)
        top = int(count.max())
        if top < rare:
            some, factor = some[~own], np.int64(int(factor) * int(HASH) % (1 << 62) | 1)
            continue
        take = count >= max(rare, top // SPAN)
        place, used = some[take], bin_[take]
        # in a run of neighbouring places only every second one can be taken
        begin = np.ones(len(place), bool)
        begin[1:] = np.diff(place) > 1
        offset = np.arange(len(place)) - np.maximum.accumulate(np.where(begin, np.arange(len(place)), 0))
        place, used = place[offset % 2 == 0], used[offset % 2 == 0]
        met = np.zeros(room, bool)
        met[used] = True
        chosen = np.flatnonzero(met)
        counts[chosen] = np.arange(len(chosen))
        rules.append(np.stack([bins[chosen] >> 32, bins[chosen] & 0xFFFFFFFF], 1))
        seq[place] = symbols + counts[used]
        symbols += len(chosen)
        last[place] = last[place + 1]
        stay, look = np.ones(len(seq), bool), np.zeros(len(seq), bool)
        stay[place + 1] = False
        look[some[~own | (count >= rare)]] = True
        look[place] = True
        look[np.maximum(place - 1, 0)] = True
        seq, last, look = seq[stay], last[stay], look[stay]
        some = np.flatnonzero(look[:-1] & ~last[:-1])
    return seq, np.concatenate(rules) if rules else np.empty((0, 2), np.int64), np.flatnonzero(last) + 1, first


def packed(values: np.ndarray, width: int) -> bytes:
    """Numbers in `width` bytes each."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].tobytes()


def unpacked(data: bytes, width: int, start: int, stop: int) -> np.ndarray:
    """values[start:stop] of packed()."""
    out = np.zeros((stop - start, 4), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, (stop - start) * width, start * width).reshape(-1, width)
    return out.reshape(-1).view("<u4").astype(np.int64)


def write_shard(doc_ids: list[int | None], ids: list[bytes]) -> bytes:
    """A shard's file: documents in the order given, each a string of ids."""
    sizes = np.array([len(x) // 4 for x in ids], np.int64)
    flat = np.frombuffer(b"".join(ids), "<u4")
    full = sizes > 0
    ends = np.cumsum(sizes)
    seq, rules, after, first = repair(flat, ends[full])
    tops = np.zeros(len(ids) + 1, np.int64)
    begun = np.zeros(len(ids), np.int64)
    begun[full] = np.diff(np.concatenate([[0], after]))
    tops[1:] = np.cumsum(begun)
    lengths = np.ones(first + len(rules), np.int64)
    for k, (a, b) in enumerate(rules.tolist()):
        lengths[first + k] = lengths[a] + lengths[b]
    width = max(1, -(-int(seq.max(initial=0)).bit_length() // 8))
    known = np.array([0 if d is None else d for d in doc_ids], "<i8")
    null = np.array([d is None for d in doc_ids], np.uint8)
    head = MAGIC + struct.pack("<QQQQQQ", len(ids), len(flat), len(rules), first, len(seq), width)
    return b"".join([head, known.tobytes(), null.tobytes(), sizes.astype("<u4").tobytes(), tops.astype("<u8").tobytes(), rules.astype("<u4").tobytes(), lengths[first:].astype("<u4").tobytes(), packed(seq, width)])


class Shard:
    """A shard's file, opened; nothing is expanded before it is asked for."""

    def __init__(self, data: bytes) -> None:
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        n, self.n_ids, r, self.first, self.n_top, self.width = struct.unpack("<QQQQQQ", data[8:56])
        at = 56

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            a = np.frombuffer(data, kind, count, at)
            at += a.nbytes
            return a

        known, null = take("<i8", n), take("u1", n)
        self.doc_ids = [None if z else int(d) for d, z in zip(known, null)]
        self.sizes, self.tops = take("<u4", n).astype(np.int64), take("<u8", n + 1).astype(np.int64)
        self.rules = take("<u4", 2 * r).reshape(-1, 2).astype(np.int64)
        self.lengths = take("<u4", r).astype(np.int64)
        self._body = data[at:]

    def _expanded(self, seq: np.ndarray) -> np.ndarray:
        while len(where := np.flatnonzero(seq >= self.first)):
            wide = np.ones(len(seq), np.int64)
            wide[where] = 2
            to = np.cumsum(wide) - wide
            out = np.empty(int(wide.sum()), np.int64)
            out[to] = seq
            rule = self.rules[seq[where] - self.first]
            out[to[where]], out[to[where] + 1] = rule[:, 0], rule[:, 1]
            seq = out
        return seq

    def all(self) -> np.ndarray:
        """All ids: rules are expanded once, then every symbol copies its expansion."""
        seq = unpacked(self._body, self.width, 0, self.n_top)
        flat = np.concatenate([np.arange(self.first), self._expanded(self.rules.reshape(-1))])
        size = np.concatenate([np.ones(self.first, np.int64), self.lengths])
        begin = np.cumsum(size) - size
        n = size[seq]
        return flat[np.repeat(begin[seq] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]

    def document(self, k: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids start..stop of the k-th document; only the symbols that cover them are expanded."""
        seq = unpacked(self._body, self.width, int(self.tops[k]), int(self.tops[k + 1]))
        size = np.ones(len(seq), np.int64)
        big = seq >= self.first
        size[big] = self.lengths[seq[big] - self.first]
        after = np.cumsum(size)
        stop = int(self.sizes[k]) if stop is None else min(stop, int(self.sizes[k]))
        if start >= stop:
            return np.empty(0, np.int64)
        a, b = int(np.searchsorted(after, start, "right")), int(np.searchsorted(after, stop, "left"))
        before = int(after[a - 1]) if a else 0
        return self._expanded(seq[a : b + 1])[start - before : stop - before]


def write_token_files(docs: DataFrame, vocabulary: str, path: str, end: int | None = END, shard_ids: int = SHARD_IDS) -> None:
    """Writes the token files of all documents to `path`, in ascending order of doc_id (nulls first), a table of part, shard, n_ids and file.

    A null text counts as empty and has the end id alone; repeated doc_ids stay
    side by side; other columns are ignored; no documents, no files.
    """
    tail = b"" if end is None else struct.pack("<I", end)

    def run(batches):
        e = encoder(vocabulary)
        part = TaskContext.get().partitionId()
        ids, parts, size, shard = [], [], 0, 0
        for doc_id, got in encoded(e, batches):
            ids.append(doc_id)
            parts.append(got + tail)
            size += len(parts[-1]) // 4
            if size >= shard_ids:
                yield part, shard, size, write_shard(ids, parts)
                ids, parts, size, shard = [], [], 0, shard + 1
        if ids:
            yield part, shard, size, write_shard(ids, parts)

    rows = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    fold_rows(rows, "part int, shard int, n_ids long, file binary", run, 16).write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(part, shard, offset, file): the files with the number of ids that all earlier ones hold. Sums go up by part, so no task sees all shards."""
    files = spark.read.parquet(path)
    sums = files.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()  # a row for each partition written
    before, total = [], 0
    for r in sums:
        before.append((r[0], total))
        total += r[1]
    base = spark.createDataFrame(before, "part int, base long")
    inside = files.select("part", "shard", "n_ids").withColumn("own", F.sum("n_ids").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_ids"))
    at = inside.join(base, "part").select("part", "shard", (F.col("base") + F.col("own")).alias("offset"))
    return files.join(at, ["part", "shard"]).select("part", "shard", "offset", "file")


def token_file_digests(files: DataFrame) -> DataFrame:
    """Per document of read_token_files: doc_id, start, n_tokens, ids_crc32."""

    def run(batches):
        for b in batches:
            for offset, data in zip(b["offset"], b["file"]):
                s = Shard(data)
                flat = s.all().astype("<u4").tobytes()
                at = 0
                for doc_id, n in zip(s.doc_ids, s.sizes.tolist()):
                    yield doc_id, offset + at, n, zlib.crc32(flat[4 * at : 4 * (at + n)])
                    at += n

    return fold_rows(files.select("offset", "file"), "doc_id long, start long, n_tokens long, ids_crc32 long", run, 4)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places, sizes and checksums of every document, read back from the files it was written to; odd rows as write_token_files says."""
    path = shared_dir(spark) + "/tokens.parquet"
    write_token_files(table(spark, sf_dir, "documents"), default_vocabulary(), path)
    return token_file_digests(read_token_files(spark, path))


QUERIES = {"op7_token_files": op7_token_files}
ORACLE: dict = {}

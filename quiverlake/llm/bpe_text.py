"""Byte-pair encoding by merge ranks, and decoding from vocabulary strings.

A word is a doubly linked list of symbols. A heap holds (rank, position) of
every neighbouring pair that has a merge; the smallest is taken off, entries
whose symbols have changed since are skipped, and the merged symbol's two new
pairs go on. Normalising and splitting into words follow the vocabulary
file's own rules. Pieces between plain spaces are independent of each other
there, so each worker keeps the encoding of the pieces it met lately.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re

from pyspark.sql import DataFrame, SparkSession

from .common import fold_rows, table

#: The splitter of such vocabularies on pieces of visible ASCII and the letters of Latin-1, which its normaliser only lower-cases. Fixed value.
PLAIN_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")


def byte_signs() -> dict[int, str]:
    """The sign that byte-level vocabularies write for each byte: itself where it is visible in Latin-1, else the next one from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = (256 + k for k in range(256))
    return {b: chr(b) if b in seen else chr(next(other)) for b in range(256)}


#: From a character of such a piece to the signs of its bytes.
SIGNS = {c: "".join(byte_signs()[b] for b in chr(c).encode()) for c in range(128, 256)}
#: Pieces whose encoding a worker keeps; beyond it the older half is dropped. A matter of memory, never of results.
KEEP = 300_000


class BpeCodec:
    """Encodes and decodes as the vocabulary file says: whole texts, special tokens in a text recognised, none added."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        own = Tokenizer.from_file(path)
        self._clean = own.normalizer.normalize_str if own.normalizer else str
        self._split = own.pre_tokenizer.pre_tokenize_str
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {(a, b): k for k, (a, b) in reversed(list(enumerate(pairs)))}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in self.ids.items()} | {i: s for s, i in self.special.items()}
        self._cut = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self._mark = [s[:2] for s in self.special]
        rules = [p.get("pattern", {}).get("Regex") for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
        self._plain = rules[:1] == [r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"]
        self._new: dict[str, tuple[int, str, str]] = {}
        self._old: dict[str, tuple[int, str, str]] = {}

    def word(self, symbols: str) -> list[int]:
        """Ids of one word of the splitter. Symbols that the vocabulary lacks are dropped, as no unknown token is set."""
        sym: list[str | None] = list(symbols)
        if not sym:
            return []
        sym[-1] += self.end
        whole = self.ids.get(symbols + self.end) if len(sym) == 1 else None
        if whole is not None:
            return [whole]
        ids, ranks = self.ids, self.ranks
        sym = [s for s in sym if s in ids]
        n = len(sym)
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k, sym[k], sym[k + 1]) for k in range(n - 1) if (r := ranks.get((sym[k], sym[k + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, a, b = heapq.heappop(heap)
            j = right[k]
            if sym[k] != a or j >= n or sym[j] != b:
                continue  # stale: one of the two has been merged since
            sym[k], sym[j] = a + b, None
            j = right[k] = right[j]
            if j < n:
                left[j] = k
                if (r := ranks.get((sym[k], sym[j]))) is not None:
                    heapq.heappush(heap, (r, k, sym[k], sym[j]))
            if (i := left[k]) >= 0 and (r := ranks.get((sym[i], sym[k]))) is not None:
                heapq.heappush(heap, (r, i, sym[i], sym[k]))
        return [ids[s] for s in sym if s is not None]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part in self._cut.split(text) if self._cut else [text]:
            if part in self.special:
                out.append(self.special[part])
            else:
                for w, _ in self._split(self._clean(part)):
                    out += self.word(w)
        return out

    def decode(self, ids) -> str:
        """The vocabulary strings, joined as the file says: it sets no decoder, so by one space."""
        return " ".join(self.strings[i] for i in ids)

    def _piece(self, piece: str) -> tuple[int, str, str]:
        """(ids, their decimals, their strings) of a piece without spaces; the last two end in a space."""
        got = self._old.get(piece)
        if got is None:
            if self._plain and PLAIN.fullmatch(piece):
                words = PLAIN_WORDS.findall(piece.lower())
                if not piece.isascii():
                    words = [w.translate(SIGNS) for w in words]
            else:
                words = [w for w, _ in self._split(self._clean(piece))]
            ids = [i for w in words for i in self.word(w)]
            got = (len(ids), "".join(f"{i} " for i in ids), "".join(f"{self.strings[i]} " for i in ids))
        if len(self._new) >= KEEP // 2:
            self._old, self._new = self._new, {}
        self._new[piece] = got
        return got

    def digest(self, text: str) -> tuple[int, str, str]:
        """(number of ids, the ids' decimals joined by one space, decode(encode(text))) of a text of any length."""
        if self._cut and any(m in text for m in self._mark) and self._cut.search(text):
            ids = self.encode(text)
            return len(ids), " ".join(map(str, ids)), self.decode(ids)
        n, said, back = 0, [], []
        for piece in text.replace("\n", " ").split(" "):
            if piece:
                got = self._new.get(piece) or self._piece(piece)
                n += got[0]
                said.append(got[1])
                back.append(got[2])
        return n, "".join(said)[:-1], "".join(back)[:-1]


_CODECS: dict[str, BpeCodec] = {}


def codec(path: str) -> BpeCodec:
    """One codec for each worker and file."""
    if path not in _CODECS:
        _CODECS[path] = BpeCodec(path)
    return _CODECS[path]


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def bpe_digests(docs: DataFrame, path: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256. A null text counts as empty; equal rows come out as often as they occur; long texts are encoded whole; no documents, no rows; other columns are ignored."""

    def run(batches):
        c = codec(path)
        for b in batches:
            for doc_id, text in zip(b["doc_id"], b["text"]):
                n, said, back = c.digest(text or "")
                yield doc_id, n, sha(said), sha(back)

    return fold_rows(docs.select("doc_id", "text"), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", run)


def bpe_tokens(docs: DataFrame, path: str) -> DataFrame:
    """Per document: doc_id, token_ids, decoded. Nulls, repeats and other columns as in bpe_digests."""

    def run(batches):
        c = codec(path)
        for b in batches:
            for doc_id, text in zip(b["doc_id"], b["text"]):
                _, said, back = c.digest(text or "")
                yield doc_id, [int(i) for i in said.split()], back

    return fold_rows(docs.select("doc_id", "text"), "doc_id long, token_ids array<int>, decoded string", run)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document and of what they decode to; odd rows as bpe_digests says."""
    return bpe_digests(table(spark, sf_dir, "documents"), default_vocabulary())


QUERIES = {"op4_bpe": op4_bpe}
ORACLE: dict = {}

"""Exact byte-pair encoding by dynamic programming over prefixes, and decoding.

For every prefix of a word, the last token of the prefix's encoding is unique. The
candidates are the tokens that are suffixes of the prefix; an automaton over the whole
vocabulary lists them in one pass, longest first. A candidate is the one if its start is
the word's start, or if it may follow the last token of the prefix before it: the
pair is compatible when byte-pair merging never merges across their boundary. Each prefix
stores that token; following the stored tokens back from the end gives the ids.

Nulls and odd cases: null or empty text gives no ids and an empty decoded text; a null
doc_id stays null; repeated rows are encoded each by itself; an empty table gives no row;
columns besides doc_id and text are ignored. A very long text is a block of its own, and a task
needs some 60 bytes for each of its characters.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from graphmill.llm import text as tx
from graphmill.llm.op1_packing import text_lists
from graphmill.llm.tokens import Cache, word_level_spans

WORD_LEVEL = "word_bpe_49k.json"
_NEVER = 1 << 60


def byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, the rest from U+0100 on."""
    printable = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    out = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [out[b] for b in range(256)]


class PrefixEncoder:
    """Encodes single words; a word's symbols are its bytes, the last one in its end-of-word form if the vocabulary has one."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], suffix: str | None):
        import ahocorasick

        self.suffix = suffix
        size = max(vocabulary.values()) + 1
        self.rank, self.left, self.right = [-1] * size, [0] * size, [0] * size
        self.length = [0] * size
        self.merged: dict[int, int] = {}
        spelled: dict[int, str] = {}
        for b, c in enumerate(byte_symbols()):
            for form, symbol in ((c, chr(b)), (c + suffix, chr(256 + b)) if suffix else (c, chr(b))):
                if form in vocabulary:
                    spelled[vocabulary[form]] = symbol
        self.memo: dict[int, bool] = {}
        for r, (a, b) in enumerate(merges):
            x, y, t = vocabulary[a], vocabulary[b], vocabulary[a + b]
            self.merged.setdefault(x << 20 | y, r)
            if self.rank[t] < 0 and t not in spelled and x in spelled and y in spelled:
                self.rank[t], self.left[t], self.right[t] = r, x, y
                spelled[t] = spelled[x] + spelled[y]
        self.automaton = ahocorasick.Automaton()
        for t, s in spelled.items():
            self.length[t] = len(s)
            # a token that merging never makes from its own symbols is in no encoding
            if self.rank[t] < 0 or not self._crossed(self.left[t], self.right[t], self.rank[t]):
                self.automaton.add_word(s, t)
        self.automaton.make_automaton()

    def _crossed(self, a: int, b: int, before: int = _NEVER) -> bool:
        """Does merging join something over the boundary of a and b, earlier than the rank given?

        Goes back in time: undoes the later of the two tokens' last merges, and looks each
        time whether the parts that meet at the boundary would have merged while both stood
        there. Of equal merges the left one comes first.
        """
        rank, merged = self.rank, self.merged
        a_until = b_until = before
        while True:
            r = merged.get(a << 20 | b)
            if r is not None and r < a_until and r <= b_until and r != before:
                return True
            if rank[a] > rank[b]:
                a_until = rank[a]
                a = self.right[a]
            elif rank[b] >= 0:
                b_until = rank[b]
                b = self.left[b]
            else:
                return False

    def compatible(self, a: int, b: int) -> bool:
        key = a << 20 | b
        known = self.memo.get(key)
        if known is None:
            if len(self.memo) > 2_000_000:
                self.memo.clear()
            known = self.memo[key] = not self._crossed(a, b)
        return known

    def encode(self, word: str) -> list[int]:
        raw = word.encode("utf-8", "surrogatepass").decode("latin-1")
        if not raw:
            return []
        if self.suffix:
            raw = raw[:-1] + chr(256 + ord(raw[-1]))
        last, length, memo = [-1] * len(raw), self.length, self.memo
        for end, token in self.automaton.iter(raw):
            if last[end] >= 0:
                continue
            before = end - length[token]
            if before < 0:
                last[end] = token
            elif (p := last[before]) >= 0:
                ok = memo.get(p << 20 | token)
                if self.compatible(p, token) if ok is None else ok:
                    last[end] = token
        out, at = [], len(raw) - 1
        while at >= 0:
            out.append(last[at])
            at -= length[last[at]]
        return out[::-1]


class Codec:
    """Whole texts under the word-level vocabulary at path."""

    def __init__(self, path: str, entries: int = 400_000):
        from tokenizers import Tokenizer

        data = json.load(open(path, encoding="utf-8"))
        model = data["model"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.word = PrefixEncoder(model["vocab"], pairs, model.get("end_of_word_suffix"))
        self.token = {i: t for t, i in model["vocab"].items()}
        self.special = {x["content"]: x["id"] for x in data["added_tokens"]}
        self.token |= {i: t for t, i in self.special.items()}
        self.normalizer = Tokenizer.from_file(path).normalizer
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.cache = Cache(self._add, entries)
        self._empty()

    def _empty(self) -> None:
        self.cache.clear()
        self.cache.size = 0
        self.ids: list[str] = []
        self.tokens: list[str] = []
        self.counts: list[int] = []

    def _add(self, words: list[str]) -> None:
        for w in words:
            ids = self.word.encode(w)
            self.ids.append(" ".join(map(str, ids)))
            self.tokens.append(" ".join([self.token[i] for i in ids]))
            self.counts.append(len(ids))

    def normal(self, text: str) -> str:
        """NFC and lower case; below U+0300 nothing composes and str.lower agrees with the library."""
        return text.lower() if text.isascii() or max(text) < "̀" else self.normalizer.normalize_str(text)

    def _plain(self, texts: list[str]) -> list[tuple[list[str], list[str], int]]:
        """(ids of each word, tokens of each word, number of ids) of texts without special strings."""
        if self.cache.full():
            self._empty()
        texts = [self.normal(t) for t in texts]
        c, offs = tx.codes(texts)
        s, e = word_level_spans(c, offs)
        if not len(s):
            return [([], [], 0)] * len(texts)
        number = self.cache.look(c, s, e, "".join(texts)).tolist()
        at = np.searchsorted(s, offs).tolist()
        out = []
        for lo, hi in zip(at, at[1:]):
            own = number[lo:hi]
            out.append(([self.ids[i] for i in own], [self.tokens[i] for i in own], sum([self.counts[i] for i in own])))
        return out

    def strings(self, texts: list[str]) -> list[tuple[str, str, int]]:
        """(ids joined by spaces, decoded text, number of ids) of each text."""
        odd = {i for i, t in enumerate(texts) if "<|" in t and self.split and self.split.search(t)}
        out = [(" ".join(a), " ".join(b), n) for a, b, n in self._plain(["" if i in odd else t for i, t in enumerate(texts)])]
        for i in odd:
            ids, tokens, n = [], [], 0
            for part in self.split.split(texts[i]):
                if part in self.special:
                    ids, tokens, n = [*ids, str(self.special[part])], [*tokens, part], n + 1
                elif part:
                    a, b, k = self._plain([part])[0]
                    ids, tokens, n = ids + a, tokens + b, n + k
            out[i] = " ".join(ids), " ".join(tokens), n
        return out

    def decode(self, ids: list[int]) -> str:
        """The library's decode without a decoder: tokens joined by spaces."""
        return " ".join([self.token[i] for i in ids])


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_decode(docs: DataFrame, path: str | None = None, digests: bool = False) -> DataFrame:
    """doc_id, n_tokens, and ids (array) and decoded (string), or with digests their SHA-256 in lowercase hex.

    One scan and one Arrow pass without a shuffle.
    """
    path = path or public_tokenizers.path(WORD_LEVEL)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rest = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"

    def sha(s: str) -> str:
        return hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for lo, hi, texts in text_lists(batch):
                got = c.strings(texts)
                columns = [batch.column("doc_id").slice(lo, hi - lo), pa.array([n for _, _, n in got], pa.int64())]
                if digests:
                    columns += [pa.array([sha(a) for a, _, _ in got], pa.string()), pa.array([sha(b) for _, b, _ in got], pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    columns += [pa.array([[int(x) for x in a.split()] for a, _, _ in got], pa.list_(pa.int32())), pa.array([b for _, b, _ in got], pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, n_tokens long, {rest}")

"""Packing without crossing documents: each document's ids are cut into pieces of power-of-two length.

A document of n ids gives n div L pieces of the longest length L and one piece for each set
bit of the rest, longest first. Pieces of equal length form a bucket; a training batch is
drawn from one bucket, so a sequence is one piece, holds one document and needs no padding.

Nulls and odd cases: null or empty text is the end mark alone; a null doc_id stays null;
repeated rows are packed each by itself; an empty table gives no piece; columns besides doc_id and
text are ignored. A very long text gives many pieces; it is a block of its own, and a task needs
some 60 bytes for each of its characters.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.llm import text as tx
from graphmill.llm.tokens import Cache, byte_level_spans

LONGEST = 1024
END_ID = 0
BYTE_LEVEL = "byte_bpe_50k.json"
#: Strings that the vocabulary treats as one special id; texts with them go to the library whole.
SPECIAL = "<|endoftext|>"


class Encoder:
    """Ids of whole texts under the byte-level vocabulary at path."""

    def __init__(self, path: str, entries: int = 1_000_000):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.cache = Cache(self._add, entries)
        self._empty()

    def _empty(self) -> None:
        self.cache.clear()
        self.cache.size = 0
        self.pool = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.start, self.length = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _add(self, strings: list[str]) -> None:
        for lo in range(0, len(strings), 20_000):
            self._add_some([x.ids for x in self.library.encode_batch_fast(strings[lo : lo + 20_000], add_special_tokens=False)], self.cache.size + lo)

    def _add_some(self, ids: list[list[int]], at: int) -> None:
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        total = int(lengths.sum())
        while self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while at + len(ids) > len(self.start):
            self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
        self.length[at : at + len(ids)] = lengths
        self.start[at : at + len(ids)] = self.used + np.cumsum(lengths) - lengths
        self.pool[self.used : self.used + total] = [i for x in ids for i in x]
        self.used += total

    def _tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the pre-tokens of all texts, and where each text's start."""
        if self.cache.full():
            self._empty()
        c, offs = tx.codes(texts)
        s, e = byte_level_spans(c, offs)
        if not len(s):
            return s, np.zeros(len(texts) + 1, np.int64)
        number = self.cache.look(c, s, e, "".join(texts))
        return number, np.searchsorted(s, offs)

    def counts(self, texts: list[str]) -> np.ndarray:
        """Number of ids of each text."""
        number, at = self._tokens(["" if SPECIAL in t else t for t in texts])
        sums = np.zeros(len(number) + 1, np.int64)
        np.cumsum(self.length[number], out=sums[1:])
        out = sums[at[1:]] - sums[at[:-1]]
        for i, t in enumerate(texts):
            if SPECIAL in t:
                out[i] = len(self.library.encode(t, add_special_tokens=False).ids)
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's start."""
        number, at = self._tokens(["" if SPECIAL in t else t for t in texts])
        lengths = self.length[number]
        flat = self.pool[tx.ragged(self.start[number], lengths)]
        sums = np.zeros(len(number) + 1, np.int64)
        np.cumsum(lengths, out=sums[1:])
        offs = sums[at]
        odd = [i for i, t in enumerate(texts) if SPECIAL in t]
        if odd:
            parts = [flat[offs[i] : offs[i + 1]] for i in range(len(texts))]
            for i in odd:
                parts[i] = np.array(self.library.encode(texts[i], add_special_tokens=False).ids, np.uint32)
            offs = np.zeros(len(texts) + 1, np.int64)
            np.cumsum([len(p) for p in parts], out=offs[1:])
            flat = np.concatenate(parts) if parts else flat
        return flat, offs


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def binary_pieces(n: int, longest: int = LONGEST) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids, longest first."""
    out, at = [], 0
    while n - at >= longest:
        out.append((at, longest))
        at += longest
    bit = longest >> 1
    while bit:
        if (n - at) & bit:
            out.append((at, bit))
            at += bit
        bit >>= 1
    return out


def text_lists(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[int, int, list[str]]]:
    """Row ranges of a batch with their texts (null: empty), in blocks of bounded size."""
    col = batch.column(column)
    _, offs = tx.utf8(col)
    for lo, hi in tx.blocks(np.diff(offs)):
        yield lo, hi, [t or "" for t in col.slice(lo, hi - lo).to_pylist()]


def pack_power_of_two(docs: DataFrame, path: str | None = None, longest: int = LONGEST, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, ids, sequence_id, offset.

    The plan is one scan with one Arrow pass and no shuffle: length is the bucket, so
    write_buckets() needs none either. sequence_id numbers the pieces of each task, which is
    stable under retries because a task always reads the same rows in the same order.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    path = path or public_tokenizers.path(BYTE_LEVEL)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + (", ids array<int>" if with_ids else "")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for lo, hi, texts in text_lists(batch):
                flat, offs = enc.encode(texts)
                doc, start, length, crc, total, ids = [], [], [], [], [], []
                for i in range(hi - lo):
                    own = np.append(flat[offs[i] : offs[i + 1]], np.uint32(end_id)).astype("<u4")
                    raw = memoryview(own.tobytes())
                    for at, size in binary_pieces(len(own), longest):
                        doc.append(lo + i)
                        start.append(at)
                        length.append(size)
                        crc.append(zlib.crc32(raw[4 * at : 4 * (at + size)]))
                        total.append(len(own))
                        if with_ids:
                            ids.append(own[at : at + size].astype(np.int32))
                columns = [batch.column("doc_id").take(pa.array(doc, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32()), pa.array(np.concatenate(ids), pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    out = docs.select("doc_id", "text").mapInArrow(work, schema)
    return out.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """One folder per length, so that a reader can draw each batch from sequences of one length."""
    pieces.withColumn("bucket", F.col("length")).write.partitionBy("bucket").parquet(path)

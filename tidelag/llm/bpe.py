"""Byte-level BPE over a whole corpus with a public vocabulary.

The vocabulary file (base64 token and rank a line) is a parameter. It is sent to the executors where the driver can
read it, else it must be readable at that path on each of them.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelag.shared import quoted, ship

FOLDER = "/opt/tokenizers"
BYTE_BPE_50K = f"{FOLDER}/byte_bpe_50k.tiktoken"

#: Fixed value: the pattern that splits a text before any merge, as the vocabulary defines it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Pieces whose ids a worker remembers; the memory is emptied when full.
REMEMBERED, LONGEST_REMEMBERED = 1 << 18, 64


class Encoder:
    """Encodes and decodes with the merge ranks of one vocabulary file."""

    def __init__(self, path: str = BYTE_BPE_50K):
        with open(path, "rb") as f:
            self.ids = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.tokens = {i: t for t, i in self.ids.items()}
        # two tokens that merge give a token of a known id, which is the rank of the merge too
        self.pieces = regex.compile(PATTERN).findall
        self.known: dict[str, list[int]] = {}
        self.pairs: dict[tuple[int, int], int] = {}

    def _pair(self, a: int, b: int) -> int:
        """Id of the token that two tokens merge to, or -1."""
        r = self.pairs.get((a, b))
        if r is None:
            r = self.ids.get(self.tokens[a] + self.tokens[b], -1)
            if len(self.pairs) >= REMEMBERED:
                self.pairs.clear()
            self.pairs[a, b] = r
        return r

    def piece(self, data: bytes) -> list[int]:
        """Ids of one piece: merges by rank, leftmost first, over a doubly linked list of symbols."""
        ids, n = self.ids, len(data)
        sym = [ids[data[i : i + 1]] for i in range(n)]
        if n == 1:
            return sym
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        pair = self._pair
        heap = [(r, i, sym[i], sym[i + 1]) for i in range(n - 1) if (r := pair(sym[i], sym[i + 1])) >= 0]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if sym[i] != a or j < 0 or sym[j] != b:
                continue  # stale: one of the two has merged since
            sym[i], sym[j] = r, -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if (q := pair(r, sym[k])) >= 0:
                    heapq.heappush(heap, (q, i, r, sym[k]))
            h = before[i]
            if h >= 0 and (q := pair(sym[h], r)) >= 0:
                heapq.heappush(heap, (q, h, sym[h], r))
        return [s for s in sym if s >= 0]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text, without special tokens (their strings are ordinary text); null and '' give no ids."""
        if not text:
            return []
        out: list[int] = []
        known = self.known
        for p in self.pieces(text):
            got = known.get(p)
            if got is None:
                got = self.piece(p.encode("utf-8", "surrogatepass"))
                if len(p) <= LONGEST_REMEMBERED:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[p] = got
            out += got
        return out

    def decode(self, ids: Iterable[int] | None) -> str:
        """Text of the ids, by joining their strings; bytes that are no UTF-8 give U+FFFD."""
        tokens = self.tokens
        return b"".join(tokens[int(i)] for i in ids if i is not None).decode("utf-8", "replace") if ids is not None else ""


_encoders: dict[str, Encoder] = {}
_sent: set[tuple[str, str]] = set()


def encoder(path: str = BYTE_BPE_50K) -> Encoder:
    """The encoder of a file, read once in a process."""
    path = os.fspath(path)
    if path not in _encoders:
        near = SparkFiles.get(os.path.basename(path)) if SparkFiles._root_directory else ""
        _encoders[path] = Encoder(near if os.path.exists(near) else path)
    return _encoders[path]


def sent(df: DataFrame, path: str) -> str:
    """Sends this package and the vocabulary file to the executors; returns the path."""
    ship(df.sparkSession)
    path = os.path.abspath(os.fspath(path))
    sc = df.sparkSession.sparkContext
    if (sc.applicationId, path) not in _sent and os.path.exists(path):
        _sent.add((sc.applicationId, path))
        sc.addFile(path)
    return path


def encoded(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = BYTE_BPE_50K) -> DataFrame:
    """``key`` and ``ids`` (ARRAY<INT>) of every row; null and empty texts have an empty array.

    No shuffle; rows with a repeated or null key are kept as they are. Texts are encoded whole.
    """
    path = sent(df, path)
    rows = df.select(quoted(key).alias("k"), quoted(text).cast("string").alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            each = [e.encode(x) for x in b.column("x").to_pylist()]
            ends = np.zeros(len(each) + 1, np.int32)
            np.cumsum([len(x) for x in each], out=ends[1:])
            flat = pa.array(np.fromiter((i for x in each for i in x), np.int32, int(ends[-1])))
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.ListArray.from_arrays(pa.array(ends), flat)], names=["k", "ids"])

    return rows.mapInArrow(run, f"k {rows.schema['k'].dataType.simpleString()}, ids array<int>").select(F.col("k").alias(key), "ids")


def token_counts(df: DataFrame, keep: list[str], text: str = "text", path: str = BYTE_BPE_50K) -> DataFrame:
    """The columns ``keep`` and ``n_tokens`` (BIGINT) of every row; null and empty texts have 0."""
    path = sent(df, path)
    names = [f"k{i}" for i in range(len(keep))]
    rows = df.select(*(quoted(c).alias(a) for a, c in zip(names, keep)), quoted(text).cast("string").alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            n = pa.array([len(e.encode(x)) for x in b.column("x").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(a) for a in names), n], names=[*names, "n"])

    schema = ", ".join(f"{a} {rows.schema[a].dataType.simpleString()}" for a in names) + ", n bigint"
    return rows.mapInArrow(run, schema).select(*(F.col(a).alias(c) for a, c in zip(names, keep)), F.col("n").alias("n_tokens"))


def decoded(df: DataFrame, key: str = "doc_id", ids: str = "ids", path: str = BYTE_BPE_50K) -> DataFrame:
    """``key`` and ``text`` of every row of ids; a null or empty array gives the empty text."""
    path = sent(df, path)
    rows = df.select(quoted(key).alias("k"), quoted(ids).cast("array<int>").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array([e.decode(x) for x in b.column("ids").to_pylist()], pa.string())], names=["k", "text"])

    return rows.mapInArrow(run, f"k {rows.schema['k'].dataType.simpleString()}, text string").select(F.col("k").alias(key), "text")

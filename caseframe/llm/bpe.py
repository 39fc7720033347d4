"""Encoding of a whole corpus with a public byte-level BPE vocabulary.

A piece of text starts as single bytes. A segment tree over the byte positions holds, for each live position, the rank of
the pair it forms with its live right neighbour, and in each inner node the least rank below it; going down to the left
first gives the leftmost pair of least rank. A merge changes three leaves, so it costs a logarithmic number of updates and
a piece of n bytes O(n log n), however long it is. Pieces recur, so a worker keeps those it has encoded, up to a bound.

Null and empty texts have the empty list.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from caseframe.operators.parallel import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the vocabulary's texts are cut into pieces.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KEPT_PIECES = 200_000
KEPT_BYTES = 64
NONE = 1 << 30


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary: bytes of each token and its rank, which is its id."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Encoder:
    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks, self.kept, self.pieces = ranks, {}, regex.compile(PIECES)

    def piece(self, raw: bytes) -> list[int]:
        """The ids of one piece."""
        n, ranks = len(raw), self.ranks
        if n == 1:
            return [ranks[raw]]
        width = 1 << (n - 1).bit_length()
        part: list[bytes] = [raw[i : i + 1] for i in range(n)]
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [NONE] * (2 * width)
        for i in range(n - 1):
            tree[width + i] = ranks.get(raw[i : i + 2], NONE)
        for i in range(width - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a <= b else b

        def put(at: int, rank: int) -> None:
            at += width
            tree[at] = rank
            at >>= 1
            while at:
                a, b = tree[2 * at], tree[2 * at + 1]
                least = a if a <= b else b
                if tree[at] == least:
                    break
                tree[at] = least
                at >>= 1

        while (least := tree[1]) != NONE:
            at = 1
            while at < width:
                at *= 2
                if tree[at] != least:
                    at += 1
            i = at - width
            j = right[i]
            part[i] += part[j]
            part[j] = b""
            put(j, NONE)
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                put(i, ranks.get(part[i] + part[k], NONE))
            else:
                put(i, NONE)
            if (h := left[i]) >= 0:
                put(h, ranks.get(part[h] + part[i], NONE))
        return [ranks[p] for p in part if p]

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if not text:
            return out
        kept = self.kept
        for m in self.pieces.finditer(text):
            p = m.group()
            ids = kept.get(p)
            if ids is None:
                ids = self.piece(p.encode("utf-8"))
                if len(p) <= KEPT_BYTES:
                    if len(kept) >= KEPT_PIECES:
                        kept.clear()
                    kept[p] = ids
            out += ids
        return out


_encoders: dict[int, Encoder] = {}


def _made(shared) -> Encoder:  # noqa: ANN001
    """One encoder for each worker and vocabulary."""
    key, ranks = shared.value
    if _encoders.get(key) is None:
        _encoders[key] = Encoder(ranks)
    return _encoders[key]


def share(df: DataFrame, path: str):  # noqa: ANN201
    """The vocabulary read once on the driver and broadcast; it is a fixed file of under 1 MB."""
    ranks = read_ranks(path)
    return df.sparkSession.sparkContext.broadcast((hash((path, len(ranks))), ranks))


def token_ids(df: DataFrame, key: str, text: str, path: str = VOCABULARY) -> DataFrame:
    """(key, ids): the ids of each row's whole text, without special tokens."""
    shared = share(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _made(shared)
        for batch in batches:
            for rows in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                lists = [enc.encode(t) for t in rows.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, lists)], dtype=np.int32)
                flat = np.fromiter((i for x in lists for i in x), dtype=np.int32, count=int(ends[-1]))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=[key, "ids"])

    return spread(df.select(key, text)).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, ids array<int>")


def token_counts(df: DataFrame, key: str, text: str, path: str = VOCABULARY) -> DataFrame:
    """(key, tokens): only the number of ids, so that nothing larger than a number leaves the worker."""
    shared = share(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _made(shared)
        for batch in batches:
            counts = [len(enc.encode(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=[key, "tokens"])

    return spread(df.select(key, text)).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, tokens long")

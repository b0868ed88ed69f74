"""Encoding of a corpus with a public byte-level BPE tokenizer.

Part boundaries and the ranks of adjacent pairs of a word lie in two short
contiguous arrays: the least rank is found by scanning, its boundary deleted
and the two neighbouring ranks refreshed. That beats a heap on the short
pieces that texts consist of; a long piece, for which repeated scanning would
be quadratic, is merged through a heap with the same result.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the tokenizer's pattern for pieces.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG = 128
CACHED_PIECES = 100_000
ROWS_OUT = 256
_NONE = 1 << 60


def load_ranks(path: str = DEFAULT_RANKS) -> dict[bytes, int]:
    """Token bytes to rank, which is also the id, of a ranks file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_short(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece by scanning contiguous boundary and rank arrays."""
    get = ranks.get
    bounds = list(range(len(piece) + 1))
    rank = [get(piece[i : i + 2], _NONE) for i in range(len(piece) - 1)]
    while rank and (least := min(rank)) != _NONE:
        i = rank.index(least)
        del bounds[i + 1]
        del rank[i]
        if i < len(rank):
            rank[i] = get(piece[bounds[i] : bounds[i + 2]], _NONE)
        if i:
            rank[i - 1] = get(piece[bounds[i - 1] : bounds[i + 1]], _NONE)
    return [ranks[piece[a:b]] for a, b in zip(bounds, bounds[1:], strict=False)]


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same ids for a long piece, through a heap of pairs."""
    n = len(piece)
    end = list(range(1, n + 1))  # where the part that starts here ends; 0: no part starts here
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        middle = end[i]
        if not middle or middle >= n or end[middle] != stop:
            continue  # one of the two parts has changed since
        end[i], end[middle] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (p := before[i]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
            heapq.heappush(heap, (r, p, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Pieces(dict):
    """Piece of a text to its ids; keeps those of short pieces, up to CACHED_PIECES of them."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode("utf-8", "replace")
        whole = self.ranks.get(raw)
        if whole is not None:
            ids = (whole,)
        else:
            ids = tuple((merge_short if len(raw) <= LONG else merge_long)(raw, self.ranks))
        if len(raw) <= LONG:
            if len(self) >= CACHED_PIECES:
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    """Encodes texts."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        self.pattern = regex.compile(pattern)
        self.pieces = Pieces(ranks)

    def encode(self, text: str | None) -> array:
        """Ids of a text without special tokens; none for an empty or null text."""
        return array("i", chain.from_iterable(map(self.pieces.__getitem__, self.pattern.findall(text)))) if text else array("i")

    def count(self, text: str | None) -> int:
        """The number of a text's ids."""
        return sum(map(len, map(self.pieces.__getitem__, self.pattern.findall(text)))) if text else 0


def _ranks_everywhere(df: DataFrame, path: str):
    """The vocabulary, about a megabyte, read once and sent to all executors."""
    return df.sparkSession.sparkContext.broadcast(load_ranks(path))


def encode(df: DataFrame, key: str, text: str, path: str = DEFAULT_RANKS) -> DataFrame:
    """key, ids (array<int>) of every row; an empty or null text has an empty list."""
    ranks = _ranks_everywhere(df, path)
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks.value)
        for b in batches:
            for start in range(0, b.num_rows, ROWS_OUT):
                part = b.slice(start, ROWS_OUT)
                flat, offsets = array("i"), [0]
                for t in part.column(1).to_pylist():
                    flat.extend(encoder.encode(t))
                    offsets.append(len(flat))
                ids = pa.ListArray.from_arrays(pa.array(np.array(offsets, np.int32)), pa.array(np.frombuffer(flat, np.int32) if flat else np.array([], np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=[key, "ids"])

    return df.select(F.col(f"`{key}`"), F.col(f"`{text}`").alias("text")).mapInArrow(run, f"`{key}` {kind.simpleString()}, ids array<int>")


def count_tokens(df: DataFrame, key: str, text: str, path: str = DEFAULT_RANKS) -> DataFrame:
    """key, n_tokens of every row; 0 for an empty or null text."""
    ranks = _ranks_everywhere(df, path)
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks.value)
        for b in batches:
            n = np.fromiter(map(encoder.count, b.column(1).to_pylist()), np.int64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n)], names=[key, "n_tokens"])

    return df.select(F.col(f"`{key}`"), F.col(f"`{text}`").alias("text")).mapInArrow(run, f"`{key}` {kind.simpleString()}, n_tokens long")

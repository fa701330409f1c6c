"""Token counts by byte-pair merging with a heap and a linked list."""

from __future__ import annotations

import base64
import heapq
import uuid
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame

#: Vocabulary as lines of "base64 rank"; read on the driver, sent to the workers (its size is that of the file).
RANKS_PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How byte-level BPE splits a text before merging.
SPLIT = r"""'(?:[sdmtr]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MAX_RANKS_BYTES = 64 << 20
_state: dict[str, PieceCounts] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        data = f.read(MAX_RANKS_BYTES + 1)
    if len(data) > MAX_RANKS_BYTES:
        raise ValueError(f"{path} has more than {MAX_RANKS_BYTES} bytes: too large to send to every worker")
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


def merge_count(piece: bytes, ranks: dict[bytes, int]) -> int:
    """How many merges byte-pair merging makes in piece.

    The symbols are a linked list over the byte positions at which they start. A heap holds every adjacent pair
    that has a rank; an entry is stale when its span is no longer two neighbours. Each of the at most n-1 merges
    adds two entries at most, so the cost is O(n log n) for pieces of any length."""
    n = len(piece)
    if n < 2:
        return 0
    if piece in ranks:
        return n - 1
    end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    get = ranks.get
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    merges = 0
    while heap:
        _, i, stop = pop(heap)
        j = after[i]
        if j >= n or end[j] != stop:
            continue
        merges += 1
        end[i] = stop
        after[i] = k = after[j]
        after[j] = n + 1  # dead
        end[j] = -1
        if k < n:
            before[k] = i
            if (r := get(piece[i : end[k]])) is not None:
                push(heap, (r, i, end[k]))
        if (h := before[i]) >= 0 and (r := get(piece[h:stop])) is not None:
            push(heap, (r, h, stop))
    return merges


class PieceCounts(dict):
    """Merges by piece. Pieces recur, so each is merged once a worker while it is kept; the table is emptied at
    `most` entries, which changes no count. Long pieces are not kept."""

    def __init__(self, ranks: dict[bytes, int], most: int = 400_000):
        super().__init__()
        self.ranks, self.most = ranks, most

    def __missing__(self, piece: str) -> int:
        m = merge_count(piece.encode("utf-8", "surrogatepass"), self.ranks)
        if len(piece) <= 40:
            if len(self) >= self.most:
                self.clear()
            self[piece] = m
        return m


def piece_counts(key: str, ranks: Broadcast) -> PieceCounts:
    """The worker's table of the pass named key."""
    if key not in _state:
        _state.clear()
        _state[key] = PieceCounts(ranks.value)
    return _state[key]


def count_merges(text: str, counts: PieceCounts, split) -> int:
    return sum(map(counts.__getitem__, split(text)))


def token_counts(docs: DataFrame, ranks_path: str = RANKS_PATH) -> DataFrame:
    """(doc_id, n_symbols, n_merges, n_tokens) for every row of docs; n_tokens = n_symbols - n_merges.

    n_symbols is the number of UTF-8 bytes. A null text has nulls in all three; an empty one zeros. Rows that
    repeat and null doc_ids each have a row of their own. Only doc_id and text are read, so other columns
    can't clash. No identifiers are made. Narrow: no shuffle."""
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(read_ranks(ranks_path))
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, split = piece_counts(key, ranks), regex.compile(SPLIT).findall
        for b in batches:
            symbols, merges, tokens = [], [], []
            for text in b.column(1):
                text = text.as_py()
                if text is None:
                    symbols.append(None)
                    merges.append(None)
                    tokens.append(None)
                else:
                    n, m = len(text.encode("utf-8", "surrogatepass")), count_merges(text, counts, split)
                    symbols.append(n)
                    merges.append(m)
                    tokens.append(n - m)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), *(pa.array(x, pa.int64()) for x in (symbols, merges, tokens))],
                ["doc_id", "n_symbols", "n_merges", "n_tokens"],
            )

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_symbols long, n_merges long, n_tokens long"
    )

"""Packing of tokenised documents into sequences by Karmarkar-Karp differencing.

Documents are tokenised where they lie, and every task packs its own rows, so
nothing is shuffled. A document gives whole sequences while it has CAPACITY
tokens left; its rest is cut into near-equal pieces of at most PIECE tokens.
Each GROUP of pieces is spread over the least number of windows that could hold
them by multiway differencing: partial partitions with the largest imbalance
are merged, the fullest windows of one with the emptiest of the other. The
windows come out near-equal. If one exceeds the capacity, the number of windows
rises and the group is spread anew.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelspark.llm.byte_bpe import ByteBpe
from funnelspark.llm.common import small_batches

CAPACITY = 2048
PIECE = 512
GROUP = 4096
#: Pieces handed on at once.
EMIT = 512
END = 1


def difference(sizes: list[int], windows: int) -> list[list[int]]:
    """Spread sizes over windows with near-equal sums; the places of the sizes in each window.

    A partial partition is a list of (sum over its least window, members), the
    fullest first; windows it hasn't reached yet are left out.
    """
    heap = [(-size, i, [(size, [i])]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        _, _, one = heapq.heappop(heap)
        _, _, two = heapq.heappop(heap)
        # window i of one meets window (windows - 1 - i) of two, counted from the fullest
        alone = windows - len(two)
        merged = one[:alone] + two[: windows - len(one)]
        for (s, members), (t, others) in zip(one[alone:], reversed(two)):
            members.extend(others)
            merged.append((s + t, members))
        merged.sort(key=lambda w: -w[0])
        if len(merged) == windows:
            least = merged[-1][0]
            merged = [(s - least, members) for s, members in merged]
            spread = merged[0][0]
        else:
            spread = merged[0][0]
        heapq.heappush(heap, (-spread, serial, merged))
        serial += 1
    return [members for _, members in heap[0][2]] if heap else []


def windows_of(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """As few near-equal windows as differencing finds without exceeding the capacity."""
    total = sum(sizes)
    windows = max(1, -(-total // capacity))
    while sizes:
        found = difference(sizes, windows)
        fullest = max(sum(sizes[i] for i in members) for members in found)
        if fullest <= capacity:
            return found
        # as many windows as it takes if the imbalance stays as it is, one more at least
        over = fullest - total / windows
        windows = max(windows + 1, int(total / max(capacity - over, 1)))
    return []


def _pieces(tokens: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document."""
    out = [(s, CAPACITY) for s in range(0, tokens - CAPACITY + 1, CAPACITY)]
    start = len(out) * CAPACITY
    rest = tokens - start
    parts = -(-rest // PIECE)
    edges = [start + rest * j // parts for j in range(parts + 1)] if parts else [start]
    return out + [(a, b - a) for a, b in zip(edges, edges[1:])]


SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()),
    ("sequence_id", pa.int64()), ("offset", pa.int64()),
])


def _emit(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), SCHEMA)], schema=SCHEMA)


def pack(docs: DataFrame, tokenizer: str | None = None, ranks: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    Null and empty texts are the end token alone. Rows that share a doc_id, or
    have none, are documents of their own. Extra columns are ignored; no rows
    give no pieces. Pieces of a sequence follow each other without gaps.
    """
    import public_tokenizers

    vocabulary = tokenizer or public_tokenizers.path("byte_bpe_50k.json"), ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe.of(*vocabulary)
        context = TaskContext.get()
        sequence = (context.partitionId() if context else 0) << 33
        waiting: list[tuple] = []
        done: list[tuple] = []

        def settle() -> None:
            nonlocal sequence, waiting
            for members in windows_of([p[2] for p in waiting]):
                at = 0
                for i in sorted(members):
                    done.append((*waiting[i], sequence, at))
                    at += waiting[i][2]
                sequence += 1
            waiting = []

        for batch in small_batches(batches, "text"):
            keys = batch.column("doc_id").to_pylist()
            for key, ids in zip(keys, bpe.encode(batch.column("text"), END)):
                n = len(ids)
                for start, length in _pieces(n):
                    piece = (key, start, length, ids[start : start + length].tobytes(), n)
                    if length == CAPACITY:
                        done.append((*piece, sequence, 0))
                        sequence += 1
                    else:
                        waiting.append(piece)
                if len(waiting) >= GROUP:
                    settle()
                while len(done) >= EMIT:
                    yield _emit(done[:EMIT])
                    del done[:EMIT]
        settle()
        for at in range(0, len(done), EMIT):
            yield _emit(done[at : at + EMIT])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")

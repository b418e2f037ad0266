"""Best-fit packing of tokenised documents into sequences, by the sum-of-squares rule.

The rule keeps, per residual gap g, the number N(g) of open sequences that have g free tokens, and places each piece
where the sum of N(g)^2 becomes smallest. That keeps the open gaps spread out, so that a fitting one is likely at hand
for what comes next.

Pieces are dealt at random to shards of about `pieces_per_shard`, each packed on its own: one task holds a shard's
lengths and nothing else, whatever the table's size, and a shard wastes a few sequences at most.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import tokenizer
from tessera.llm.common import written

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ticket long"


def place(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """The sequences, as lists of indices into lengths, that the sum-of-squares rule makes when it takes the pieces
    from the longest to the shortest. Ties go to the tightest gap, then to a new sequence."""
    count = np.zeros(capacity + 1, dtype=np.int64)
    bins: list[list[int]] = []
    with_gap: dict[int, list[int]] = defaultdict(list)
    for at in np.argsort(-lengths, kind="stable"):
        size = int(lengths[at])
        if size == capacity:
            bins.append([at])
            continue
        here, left = count[size:capacity], count[: capacity - size]
        change = np.where(here > 0, 2 * (left - here) + 2, np.iinfo(np.int64).max)
        if here[0]:
            change[0] = 1 - 2 * here[0]  # the gap closes: nothing is counted at 0
        best = int(change.argmin())
        if here[best] and change[best] <= 2 * count[capacity - size] + 1:
            gap = size + best
            which = with_gap[gap].pop()
            bins[which].append(at)
            count[gap] -= 1
        else:
            gap, which = capacity, len(bins)
            bins.append([at])
        gap -= size
        if gap:
            count[gap] += 1
            with_gap[gap].append(which)
    return bins


def pack(lengths: np.ndarray, capacity: int, rounds: int = 3) -> list[list[int]]:
    """place(), then again over the pieces of what stayed open, as long as that saves sequences."""
    bins = place(lengths, capacity)
    for _ in range(rounds):
        full, again = [], []
        for b in bins:
            (full if int(lengths[b].sum()) == capacity else again).append(b)
        pieces = np.array([i for b in again for i in b], dtype=np.int64)
        if len(again) < 2:
            break
        repacked = place(lengths[pieces], capacity)
        if len(repacked) >= len(again):
            break
        bins = full + [pieces[b].tolist() for b in repacked]
    return bins


def cut(length: int, capacity: int) -> Iterator[tuple[int, int]]:
    """(start, end) of each piece; when more than one, all but the first are full."""
    start, end = 0, length % capacity or min(length, capacity)
    while start < length:
        yield start, end
        start, end = end, end + capacity


def tokenise(docs: DataFrame, capacity: int, end_id: int, vocabulary: str) -> DataFrame:
    """A row per piece of each document. ticket: a number that differs between repeated rows of a task."""

    def run(batches):
        encoding, ticket = tokenizer.byte_bpe(vocabulary), 0
        for batch in batches:
            out = defaultdict(list)
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(tokenizer.encode(encoding, text.as_py() or ""), end_id).astype("<u4")
                for piece, (start, end) in enumerate(cut(len(ids), capacity)):
                    ticket += 1
                    for name, value in (("doc_id", doc_id), ("piece", piece), ("start", start), ("length", end - start), ("ids_crc32", zlib.crc32(ids[start:end].tobytes())), ("ticket", ticket)):
                        out[name].append(value)
            kinds = {"piece": pa.int32()}
            if out:
                yield pa.RecordBatch.from_pydict({k: pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def best_fit_packing(docs: DataFrame, capacity: int = 2048, end_id: int = 0, vocabulary: str | None = None, pieces_per_shard: int = 25_000) -> DataFrame:
    """Packs each row of docs(doc_id, text) into sequences of at most `capacity` tokens.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset, a row per piece; `sequence_id` and `offset`
    say where the piece lies. A null text counts as empty and is its end token alone; a null doc_id stays null; a
    repeated row is packed as often as it comes; other columns of docs are not looked at; an empty table gives no row.
    Very long documents are cut at `capacity`, the remainder first.
    """
    pieces = written(tokenise(docs, capacity, end_id, vocabulary or tokenizer.vocabulary()), "pieces")
    shards = max(1, math.ceil(pieces.count() / pieces_per_shard))

    def run(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["doc_id", "piece", "ids_crc32", "ticket"], ignore_index=True)
        lengths = shard["length"].to_numpy()
        sequence, offset = np.zeros(len(shard), dtype=np.int64), np.zeros(len(shard), dtype=np.int64)
        for number, members in enumerate(pack(lengths, capacity)):
            sequence[members] = number
            offset[members] = np.cumsum(lengths[members]) - lengths[members]
        return shard.assign(sequence_id=sequence * shards + shard["shard"], offset=offset)[OUT]

    OUT = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "ticket"), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")

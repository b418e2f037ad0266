"""N-gram Jaccard self-join by rare-first prefixes.

All n-grams get one order: those in few documents first, by hash, then the frequent ones by the number of documents. If two
sets are linked, the first of their elements in that order, as many as a link can do without and one more, have one in
common. So a set meets others on the n-grams of its prefix only, and those are rare. Pairs that met alone are dropped where
their lengths, the positions of the n-gram they met by (what precedes and what follows it in both is the most they can
share) or bounds of their parts' differences (the suffix filter) rule a link out. Each pair left is verified once on
full sets. Groups of near copies meet in large buckets, where members are verified against one leader and against each
other only where that leaves a link between two components possible; `near_dup` describes and proves that part.

The numbers of documents are counted over all of them, exactly up to hashes cut to 44 bits: tasks hand on their sorted
hashes as byte planes of differences, a few bytes each, by range of the hash. Only the most frequent n-grams, a number
fixed by a parameter, are sent to all tasks as they are. The others that are not rare leave their level of frequency in two
tables of a byte a slot, of a fixed size, at slots of their hash; an n-gram counts as frequent as the lower of its two
slots says, so the frequent ones stay out of prefixes however many there are. Whatever that order is, it loses no link.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, text_or_empty, written
from tessera.llm.near_dup import _Hashes, grouped, shingle_set, signature

#: Bits of a hash by which documents are counted; n-grams in at most so many documents are rare without being counted apart.
BITS, RARE = 44, 8
#: N-grams sent to all tasks at most: 12 bytes each.
MOST = 1 << 20
#: Bits of a slot of the two tables of levels, and of a place in a piece of one: 8 MB each, in pieces of 64 KB.
SLOT_BITS, PIECE_BITS = 23, 16
#: Shingles that a task counts before it hands them on.
HELD = 3_000_000


def packed(values: np.ndarray) -> bytes:
    """Non-negative integers by byte planes, the lowest first, as many as the largest needs."""
    planes = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :planes].T.tobytes()


def unpacked(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    planes = np.frombuffer(data, np.uint8).reshape(-1, n)
    out[:, : len(planes)] = planes.T
    return out.view("<u8").reshape(-1).astype(np.int64)


def cut(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64)


def counted(texts: DataFrame, size: int, ranges: int) -> DataFrame:
    """(key, docs): the cut hashes of shingles that more than RARE rows of texts(text) have, and how many."""

    def tally(batches) -> Iterator[pa.RecordBatch]:
        memo, held, n = _Hashes(), [], 0

        def out():
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            ends = np.searchsorted(keys, np.arange(ranges + 1) * ((1 << BITS) // ranges + 1))
            rows = [(r, b - a, int(keys[a]), packed(np.diff(keys[a:b], prepend=keys[a])), packed(counts[a:b])) for r, (a, b) in enumerate(zip(ends, ends[1:])) if b > a]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["range", "n", "first", "steps", "counts"])

        for batch in batches:
            for text in batch.column(0):
                held.append(cut(shingle_set(text.as_py(), size, memo)))
                n += len(held[-1])
                if n > HELD:
                    yield out()
                    held, n = [], 0
        if n:
            yield out()

    def add(batches) -> Iterator[pa.RecordBatch]:
        at, keys, counts = None, [], []

        def out():
            found, where = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(where, np.concatenate(counts)).astype(np.int64)
            some = total > RARE
            return pa.RecordBatch.from_arrays([pa.array(found[some]), pa.array(total[some])], ["key", "docs"])

        for batch in batches:
            for r, n, first, steps, times in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if r != at and keys:
                    yield out()
                    keys, counts = [], []
                at = r
                keys.append(first + np.cumsum(unpacked(steps, n)))
                counts.append(unpacked(times, n))
        if keys:
            yield out()

    parts = texts.mapInArrow(tally, "range int, n long, first long, steps binary, counts binary")
    return parts.repartition(ranges, "range").sortWithinPartitions("range").mapInArrow(add, "key long, docs long")


def frequent(texts: DataFrame, size: int, most: int = MOST) -> tuple[np.ndarray, np.ndarray]:
    """The cut hashes of the most frequent shingles, at most `most` of them and sorted, and their numbers of documents."""
    return order(texts, size, most)[:2]


def order(texts: DataFrame, size: int, most: int = MOST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """frequent(), and the levels() of the others that more than RARE rows have."""
    found = written(counted(texts, size, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "frequent")
    level = F.floor(8 * F.log2("docs"))
    left, least = most, math.inf
    for r in sorted(found.groupBy(level.alias("level")).count().collect(), key=lambda r: -r.level):  # 8 levels for each doubling
        left -= r["count"]
        if left < 0:
            break
        least = r.level
    rest = levels(found.filter(level < least) if least < math.inf else found)
    table = found.filter(level >= least).toArrow() if least < math.inf else None
    discard(found)
    if table is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), rest
    keys, docs = table.column("key").to_numpy(), table.column("docs").to_numpy()
    at = np.argsort(keys)
    return keys[at], docs[at], rest


def slots(keys: np.ndarray, bits: int) -> np.ndarray:
    """Both slots of cut hashes: of their lowest bits in the first table, of their highest in the second."""
    return np.stack([keys & ((1 << bits) - 1), (1 << bits) + (keys >> (BITS - bits))])


def levels(rows: DataFrame) -> np.ndarray:
    """Both tables end to end: the greatest level, eight for each doubling, of the rows(key, docs) at a slot, 0 without one."""
    bits, piece = SLOT_BITS, 1 << PIECE_BITS
    low, high = (F.col("key").bitwiseAND(F.lit((1 << bits) - 1)), F.lit(1 << bits) + F.shiftright("key", BITS - bits))
    spread = rows.select(F.least(F.floor(8 * F.log2("docs")), F.lit(255)).cast("int").alias("level"), F.explode(F.array(low, high)).alias("slot"))
    spread = spread.select(F.shiftright("slot", PIECE_BITS).cast("int").alias("piece"), F.col("slot").bitwiseAND(F.lit(piece - 1)).cast("int").alias("at"), "level")

    def lay(batches) -> Iterator[pa.RecordBatch]:
        laid: dict[int, np.ndarray] = {}  # at most both tables
        for batch in batches:
            which, at, level = (c.to_numpy() for c in batch.columns)
            for k in np.unique(which).tolist():
                np.maximum.at(laid.setdefault(k, np.zeros(piece, np.uint8)), at[which == k], level[which == k].astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array(laid, pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in laid.values()], pa.binary())], ["piece", "levels"])

    out = np.zeros(2 << bits, np.uint8)
    for r in spread.repartition("piece").mapInArrow(lay, "piece int, levels binary").toLocalIterator():  # of a fixed size
        x = np.frombuffer(zlib.decompress(r["levels"]), np.uint8)[: len(out)]
        out[r["piece"] * piece : r["piece"] * piece + len(x)] = x
    return out


def prefix(elements: np.ndarray, keys: np.ndarray, docs: np.ndarray, percent: int, rest: np.ndarray | None = None) -> np.ndarray:
    """The first of a set's elements in the common order: one more than a linked set can lack."""
    own = cut(elements)
    at = np.minimum(np.searchsorted(keys, own), max(len(keys) - 1, 0))
    other = np.zeros(len(own), np.int64)
    if rest is not None:
        other = (2 ** (rest[slots(own, (len(rest) // 2).bit_length() - 1)].min(axis=0) / 8)).astype(np.int64)
    rank = np.where(keys[at] == own, docs[at], other) if len(keys) else other
    return elements[np.lexsort((elements, rank))[: len(elements) + percent * -len(elements) // 100 + 1]]


def prefixed(docs: DataFrame, size: int, percent: int, most: int = MOST) -> DataFrame:
    """(doc_id, n, set_key, buckets, text_hash, signature) per row: set_key names the set, buckets holds its prefix in order;
    these and the signature are null for an empty set."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("string").alias("text"))
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(order(rows.select("text"), size, most))

    def run(batches) -> Iterator[pa.RecordBatch]:
        memo, (keys, counts, rest) = _Hashes(), sent.value
        for batch in batches:
            ns, names, firsts, signs = [], [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), size, memo)
                ns.append(len(s))
                names.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                firsts.append(prefix(s, keys, counts, percent, rest).view(np.int64) if len(s) else None)
                signs.append(signature(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ns, pa.int64()), pa.array(names, pa.binary()), pa.array(firsts, pa.list_(pa.int64())), batch.column(2), pa.array(signs, pa.binary())], ["doc_id", "n", "set_key", "buckets", "text_hash", "signature"])

    return rows.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, "doc_id long, n long, set_key binary, buckets array<long>, text_hash long, signature binary")


def jaccard_join(docs: DataFrame, size: int = 5, percent: int = 80, most: int = MOST) -> DataFrame:
    """Links the rows of docs(doc_id, text) whose sets of `size`-word shingles have a Jaccard similarity of `percent` / 100
    or more: every link is found.

    Returns doc_id, n_shingles and component_id, the least doc_id reachable by links, a row per input row. A null text
    counts as empty; an empty set is linked with nothing; of fewer words than `size` the sequence of all is the one
    shingle; a row is joined by its own text, so rows that share a doc_id but not a text may be in groups of their own; a
    row whose doc_id is null is linked with nothing and has a null component_id; other columns are not looked at; an
    empty table gives no row.
    """
    found = grouped(written(prefixed(docs, size, percent, most), "prefixes"), docs, size, percent, ordered=True)
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))

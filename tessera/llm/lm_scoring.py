"""Language-model scores by online logistic context mixing.

A word is coded as a 12-bit hash bucket, bit by bit, and then as itself within the bucket, where it has the smoothed share
of its training count. Four predictors give a logit for each bit: the training words under the same bits so far; the
same after the same word, and after the same two words, both from hashed tables; and the word that followed the same
four words in another training document. A gate, made of how much the last three know, selects the weights that mix the
logits. Weights start from FIRST and are learned online in each document, block of words by block and gate by gate, by
the gradient of its own coding cost. So the score of a document depends on no other scored document, and all that is
learned from the corpus (counts, tables, continuations) is learned from every training document.

The two hashed tables have a fixed size; tasks count into tables of their own, which are added up slot by slot in pieces.
What grows with the corpus is joined, not sent to tasks: counts of rarer words, and continuations. A document is cut at
its "anchors", which are its first four words and those four words in a row whose hash says so, one in `SPARSE`: an anchor
gives the codes of all words up to the next one, so each word behind the first four is in a continuation. Of the documents
with an anchor the least and the greatest predict, so that a document is never predicted by itself.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, text_or_empty, written
from tessera.llm.token_counts import most_frequent

BITS = 12
SLOTS = 1 << 21
#: Bits of a word whose slots lie side by side, 1 << TOGETHER of them, so that a word touches few places of a table.
TOGETHER = 4
SHIFT = 32 - 21 + TOGETHER
PIECE = 1 << 17
END = "\n"
START = 0x51ED270B
#: Words of an anchor, and words a part that anchors cut has in the mean.
ANCHOR, SPARSE = 4, 40
#: Right words in a row from which on an anchor counts as sure.
SURE = 4
#: Words that a task codes at a time, that it counts at a time (each counting touches the whole tables once), and whose
#: slots it computes at a time.
AT_A_TIME, COUNTED_AT_A_TIME, HASHED_AT_A_TIME = 200_000, 250_000, 20_000
#: A logit of the tables is a number of 1 / SCALE, up to MOST of them; two low bits hold the level of confidence: 0 never
#: seen, 1 up to three times, 2 more.
SCALE, MOST = 256, 2047
LEVELS = 3
GATES = LEVELS**3
#: First weights: of the words alone, after one, after two, of the anchor, and of 1.
FIRST = (0.5, 0.3, 0.35, 2.5, 0.0)
RATE, MOST_STEP = 0.02, 10.0
COUNTED = 400_000


def tokens(text: str) -> list[bytes]:
    """Words, A-Z lower-cased, and the end."""
    return [*text.encode().lower().split(), END.encode()]


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word, 42)
        return found

    def of(self, documents: list[list[bytes]]) -> np.ndarray:
        """The hashes of the words of documents laid end to end."""
        return np.fromiter(map(self.__getitem__, chain.from_iterable(documents)), np.uint64, sum(map(len, documents)))


def bucket(word: Column) -> Column:
    """The hash bucket of a word, as tasks compute it."""
    return F.xxhash64(word).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")


def contexts(hashes: np.ndarray, lengths: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, hash of the word before, hash of the two before) as uint32, for documents laid end to end."""
    codes = (hashes & np.uint64((1 << BITS) - 1)).astype(np.uint32)
    words = (hashes >> np.uint64(32)).astype(np.uint32)
    first = np.zeros(len(words), dtype=bool)
    starts = np.cumsum([0, *lengths[:-1]])
    first[starts] = True
    one = np.empty_like(words)
    one[1:], one[0] = words[:-1], START
    one[first] = START
    two = np.empty_like(one)
    two[1:], two[0] = one[:-1], START
    two[first] = START
    one = one * np.uint32(0x9E3779B1) ^ np.uint32(0x7F4A7C15)
    return codes, one, (two * np.uint32(0x85EBCA6B) + np.uint32(0x27D4EB2F)) ^ (one * np.uint32(0xC2B2AE35))


def anchors(hashes: np.ndarray, lengths: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, place where an anchor ends, place where the part behind it ends, hash of the anchor) for documents laid
    end to end; places are among all words."""
    n = len(hashes) - ANCHOR
    if n <= 0:
        return (*[np.zeros(0, np.int64)] * 3, np.zeros(0, np.uint64))
    mixed = hashes[:n].copy()
    for k in range(1, ANCHOR):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + hashes[k : n + k]
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    mixed ^= mixed >> np.uint64(31)
    owner, ends = np.repeat(np.arange(len(lengths)), lengths), np.cumsum(lengths)
    chosen = mixed % np.uint64(SPARSE) == 0
    starts = ends - lengths
    chosen[starts[starts < n]] = True
    at = np.flatnonzero(chosen)
    at = at[at + ANCHOR < ends[owner[at]]]  # a document's last word has nothing after it
    mine, place = owner[at], at + ANCHOR - 1
    last = ends[mine] - 1
    last[:-1] = np.where(mine[1:] == mine[:-1], place[1:], last[:-1])
    return mine, place, last, mixed[at]


def predicted(codes: np.ndarray, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(code that an anchor predicts, or -1; how sure it is: 0 none, 1, 2) for each word of a document. found: place, 4
    bytes, and codes, 2 bytes each. An anchor's codes are followed up to and with the first that is wrong."""
    guess, sure = np.full(len(codes), -1, dtype=np.int32), np.zeros(len(codes), dtype=np.int8)
    for place, ahead in sorted((int.from_bytes(x[:4], "little"), x[4:]) for x in found):
        ahead = np.frombuffer(ahead, dtype="<u2")[: len(codes) - place - 1].astype(np.int32)
        here = slice(place + 1, place + 1 + len(ahead))
        wrong = np.flatnonzero(ahead != codes[here])
        n = int(wrong[0]) + 1 if len(wrong) else len(ahead)
        here = slice(place + 1, place + 1 + n)
        sure[here] = np.maximum(sure[here], 1 + (np.arange(n) >= SURE))
        guess[here] = ahead[:n]
    return guess, sure


def _spread() -> np.ndarray:
    out = np.zeros(1 << BITS, dtype=np.uint32)
    for node in range(1, 1 << BITS):
        inside = (node.bit_length() - 1) % TOGETHER
        out[node] = ((node >> inside) * 0x9E3779B1 & 0xFFFFFFFF) >> TOGETHER << TOGETHER | 1 << inside | node & (1 << inside) - 1
    return out


SPREAD = _spread()


def spread(node: np.ndarray) -> np.ndarray:
    """What slots() takes for a node, the same for all contexts: in the low bits its place among those side by side."""
    return SPREAD.take(node, mode="clip")


def slots(context: np.ndarray, spread_node: np.ndarray) -> np.ndarray:
    low = np.uint32((1 << TOGETHER) - 1)
    x = (context ^ (spread_node & ~low)) * np.uint32(0x2C1B3C6D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x297A2D39)
    x >>= np.uint32(SHIFT)
    return (x << np.uint32(TOGETHER)) | (spread_node & low)


def nodes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, bit), a row per bit: the bits so far behind a leading 1, and the bit that follows."""
    j = np.arange(BITS, dtype=np.uint32)[:, None]
    return (np.uint32(1) << j) | (codes[None, :] >> (np.uint32(BITS) - j)), (codes[None, :] >> (np.uint32(BITS - 1) - j)) & np.uint32(1)


def _grouped(batches, columns: int, most: int) -> Iterator[list[tuple]]:
    """Rows of batches in groups of about `most` words, the tokens of the last column made."""
    held: list[tuple] = []
    size = 0
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns[: columns - 1]], batch.column(columns - 1), strict=True):
            held.append((*row[:-1], tokens(row[-1].as_py())))
            size += len(held[-1][-1])
            if size > most:
                yield held
                held, size = [], 0
    if held:
        yield held


def word_counts(training: DataFrame) -> DataFrame:
    """(token, n) over training(text)."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in counts], pa.string()), pa.array(counts.values(), pa.int64())], ["token", "n"])

        for batch in batches:
            for text in batch.column(0):
                counts.update(tokens(text.as_py()))
                if len(counts) > COUNTED:
                    yield out()
                    counts.clear()
        yield out()

    return training.select("text").mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


PARTS = "anchor long, doc long, training boolean, place binary, ahead binary"


def tables_and_anchors(rows: DataFrame) -> DataFrame:
    """From one look at rows(doc, training, text): each document's anchors, and pieces of the context tables that the
    training documents of a task make (doc: which piece, ahead: its counts; no anchor)."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        memo, total = _Hashes(), np.zeros((2, 2 * SLOTS), dtype=np.int64)
        for rows in _grouped(batches, 3, COUNTED_AT_A_TIME):
            lengths = np.array([len(words) for *_, words in rows])
            hashes = memo.of([words for *_, words in rows])
            names, *found = contexts(hashes, lengths.tolist())
            _add(total, np.repeat(np.array([training for _, training, _ in rows]), lengths), names, found)
            codes = names.astype("<u2").tobytes()
            owner, places, ends, anchor = anchors(hashes, lengths.tolist())
            there = places - (np.cumsum(lengths) - lengths)[owner]
            yield _batch(
                anchor.view(np.int64), [rows[k][0] for k in owner.tolist()], [rows[k][1] for k in owner.tolist()],
                [x.to_bytes(4, "little") for x in there.tolist()], [codes[2 * x + 2 : 2 * y + 2] for x, y in zip(places.tolist(), ends.tolist(), strict=True)])
        flat = total.reshape(-1)
        for k in range(0, len(flat), PIECE):
            if flat[k : k + PIECE].any():
                yield _batch([None], [k // PIECE], [True], [None], [zlib.compress(flat[k : k + PIECE].tobytes(), 1)])

    def _batch(*columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()), strict=True)], ["anchor", "doc", "training", "place", "ahead"])

    def _add(total: np.ndarray, training: np.ndarray, codes: np.ndarray, found: list[np.ndarray]) -> None:
        codes, found = codes[training], [x[training] for x in found]
        place = np.empty((BITS, len(codes)), dtype=np.uint32)
        for k, context in enumerate(found):
            for low in range(0, len(codes), HASHED_AT_A_TIME):
                here = slice(low, low + HASHED_AT_A_TIME)
                node, bit = nodes(codes[here])
                place[:, here] = (slots(context[None, here], spread(node)) << np.uint32(1)) | bit
            total[k] += np.bincount(place.T.reshape(-1), minlength=2 * SLOTS)

    return written(rows.select("doc", "training", "text").mapInArrow(run, PARTS), "anchors")


def context_tables(parts: DataFrame) -> np.ndarray:
    """Counts of zeros and ones per slot of both contexts, shape (2, SLOTS, 2), from tables_and_anchors()."""

    def add(batches) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}  # of the pieces that this task has, at most the whole table
        for batch in batches:
            for piece, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                new = np.frombuffer(zlib.decompress(counts.as_py()), dtype=np.int64)
                sums[piece] = sums[piece] + new if piece in sums else new
        for piece, counts in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([zlib.compress(counts.tobytes(), 1)], pa.binary())], ["piece", "counts"])

    n = 4 * SLOTS // PIECE
    pieces = parts.filter("anchor is null").select(F.col("doc").cast("int").alias("piece"), F.col("ahead").alias("counts"))
    out = np.zeros(4 * SLOTS, dtype=np.int64)
    for row in pieces.repartition(n, "piece").mapInArrow(add, "piece int, counts binary").toLocalIterator():  # the table's size is fixed
        out[row["piece"] * PIECE : (row["piece"] + 1) * PIECE] += np.frombuffer(zlib.decompress(row["counts"]), dtype=np.int64)
    return out.reshape(2, SLOTS, 2)


def packed(counts: np.ndarray) -> np.ndarray:
    """A table's cells: logit and level of confidence of each slot, from its counts of zeros and ones."""
    n = counts.sum(axis=-1)
    p = (counts[..., 1] + 0.3) / (n + 0.6)
    logit = np.clip(np.rint(np.log(p / (1 - p)) * SCALE), -MOST, MOST).astype(np.int16)
    return (logit << 2) | ((n > 0).astype(np.int16) + (n > 3))


def continuations(rows: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """(doc, found): what other training documents say of rows(doc, training, text), for predicted(). Documents without
    a common anchor are not in it. parts: tables_and_anchors() of the rows, where there is one already."""
    own = tables_and_anchors(rows) if parts is None else parts
    every = own.filter("anchor is not null")
    one = F.struct("doc", "ahead")
    known = every.filter("training").groupBy("anchor").agg(F.min(one).alias("low"), F.max(one).alias("high"))
    other = F.when(F.col("low.doc") != F.col("doc"), F.col("low.ahead")).when(F.col("high.doc") != F.col("doc"), F.col("high.ahead"))
    found = every.select("anchor", "doc", "place").join(known, "anchor").select("doc", F.concat("place", other).alias("one")).filter("one is not null")
    out = written(found.groupBy("doc").agg(F.collect_set("one").alias("found")), "continuations")
    discard(own)
    return out


def blocks(place: np.ndarray) -> np.ndarray:
    """The block of words that a place in a document belongs to: of 16 words, later of 64, then of 256."""
    return np.where(place < 256, place // 16, np.where(place < 1024, 16 + (place - 256) // 64, 28 + (place - 1024) // 256))


def mix(codes: np.ndarray, found: list[np.ndarray], guess: np.ndarray, sure: np.ndarray, lengths: list[int], model: dict, weights: np.ndarray) -> np.ndarray:
    """log2 of the probability of each document's codes. Arrays are bits by words, in blocks of words of all documents.
    weights(input, gate): what each document starts from."""
    documents = np.repeat(np.arange(len(lengths)), lengths)
    block = blocks(np.arange(len(codes)) - np.repeat(np.cumsum([0, *lengths[:-1]]), lengths))
    w = np.tile(weights, (1, len(lengths)))
    out, ones = np.zeros(len(lengths)), np.float32(1)
    column = np.empty(len(lengths), dtype=np.intp)  # of a document's weights: the longest first, so that a block's are in front
    column[np.argsort(-np.asarray(lengths), kind="stable")] = np.arange(len(lengths)) * GATES
    order = np.argsort(block, kind="stable")
    bounds = np.concatenate([[0], np.cumsum(np.bincount(block))]) if len(codes) else [0]
    for low, high in zip(bounds[:-1], bounds[1:], strict=True):
        at = order[low:high]
        owner = documents[at]
        node, bit = nodes(codes[at])
        told = np.flatnonzero(guess[at] >= 0)
        guessed, guessed_bit = nodes(guess[at[told]].astype(np.uint32))
        right = guessed == node[:, told]
        inputs = [model["logit0"].take(node, mode="clip")]
        node = spread(node)
        gate = np.zeros(node.shape, dtype=np.intp)
        for k, context in enumerate(found):
            cell = model["cells"][k].take(slots(context[at][None, :], node), mode="clip")
            inputs.append((cell >> 2).astype(np.float32) * np.float32(1 / SCALE))
            gate *= LEVELS
            gate += cell & 3
        gate *= LEVELS
        gate[:, told] += np.where(right, sure[at[told]][None, :], 0)
        gate += column[owner][None, :]
        z = w[4].take(gate, mode="clip")
        for i, x in enumerate(inputs):
            z += w[i].take(gate, mode="clip") * x
        anchored, gate_told = np.where(right, guessed_bit.astype(np.float32) * 2 - 1, np.float32(0)), gate[:, told]
        z[:, told] += w[3].take(gate_told) * anchored
        sign = bit.astype(np.float32) * 2 - 1
        t = np.exp(np.minimum(-sign * z, 20))
        starts = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1])
        used = len(starts) * GATES
        out[owner[starts]] -= np.add.reduceat(np.log2(1 + t).sum(axis=0, dtype=np.float64), starts)
        error, flat = sign * t / (ones + t), gate.reshape(-1)
        steps = [np.bincount(flat, weights=(error * x).reshape(-1), minlength=used) for x in inputs]
        steps.append(np.bincount(gate_told.reshape(-1), weights=(error[:, told] * anchored).reshape(-1), minlength=used))
        steps.append(np.bincount(flat, weights=error.reshape(-1), minlength=used))
        for i, step in enumerate(steps):
            w[i, :used] += (RATE * np.clip(step, -MOST_STEP, MOST_STEP)).astype(np.float32)
    return out


def lm_scores(docs: DataFrame, is_training: Column, frequent: int = 131_072, longest: int = 64) -> DataFrame:
    """Scores each row of docs(doc_id, text) by a model learned from the rows where is_training is true.

    Returns doc_id, training, n_tokens, n_known, train_tokens, base_score (smoothed unigrams, log10), score (the mixed
    model, log10) and bits_per_byte, a row per input row. A null text counts as empty, which is its end alone; a null
    is_training counts as true; repeated rows keep a row each and count as often in training; other columns are not
    looked at; an empty table gives no row. `frequent`, `longest`: entries of the table that goes to every task and the
    bytes of each, at most; the rest is joined. All statistics are of all training documents.
    """
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long"), F.coalesce(is_training, F.lit(True)).alias("training"), text_or_empty().cast("string").alias("text"))
    training = base.filter("training").select("doc_id", "text")
    counts = written(word_counts(training), "word-counts")
    per_bucket = counts.groupBy(bucket(F.col("token")).alias("bucket")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("distinct")).collect()  # a row per bucket
    in_bucket, distinct = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for row in per_bucket:
        in_bucket[row["bucket"]], distinct[row["bucket"]] = row["n"], row["distinct"]
    total, kinds = int(in_bucket.sum()), int(distinct.sum())
    known = most_frequent(counts, frequent, longest).select("token", "n").toArrow()
    rows = base.withColumn("doc", F.xxhash64("doc_id", "text"))
    parts_of_tables = tables_and_anchors(rows)
    table = context_tables(parts_of_tables)
    order0 = np.full(1 << BITS, 0.5)
    level = in_bucket
    for depth in range(BITS - 1, -1, -1):
        pairs = level.reshape(-1, 2)
        order0[1 << depth : 2 << depth] = (pairs[:, 1] + 0.4) / (pairs.sum(axis=1) + 0.8)
        level = pairs.sum(axis=1)
    mixing = {"logit0": np.log(order0 / (1 - order0)).astype(np.float32), "cells": [packed(t) for t in table]}
    shared = spark.sparkContext.broadcast({
        "counts": {w.encode(): n for w, n in zip(known["token"].to_pylist(), known["n"].to_pylist(), strict=True)},
        "mixing": mixing, "weights": np.repeat(np.array(FIRST, dtype=np.float32)[:, None], GATES, axis=1), "within": np.log10(in_bucket + 0.5 * (distinct + 1)),
    })
    rows = rows.join(continuations(rows, parts_of_tables), "doc", "left").select("doc_id", "training", "found", "text")

    def run(batches) -> Iterator[pa.RecordBatch]:
        memo, row = _Hashes(), TaskContext.get().partitionId() << 40
        count, mixing, within, weights = (shared.value[k] for k in ("counts", "mixing", "within", "weights"))
        names = ["row", "doc_id", "training", "n_bytes", "n_tokens", "n_known", "log_counts", "log_rest", "token", "n"]
        types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.string(), pa.int64()]
        for rows in _grouped(batches, 4, AT_A_TIME):
            lengths = [len(words) for *_, words in rows]
            codes, *found = contexts(memo.of([words for *_, words in rows]), lengths)
            guess, sure = np.full(len(codes), -1, dtype=np.int32), np.zeros(len(codes), dtype=np.int8)
            starts = np.cumsum([0, *lengths])
            for k, (_, _, more, _) in enumerate(rows):
                if more:
                    here = slice(starts[k], starts[k + 1])
                    guess[here], sure[here] = predicted(codes[here], more)
            bits = mix(codes, found, guess, sure, lengths, mixing, weights)
            rest = np.add.reduceat(within[codes], starts[:-1])
            out: list[tuple] = []
            for k, (doc_id, training_row, _, words) in enumerate(rows):
                row += 1
                n_known, logs = 0, 0.0
                for word, times in Counter(words).items():
                    if (c := count.get(word)) is not None:
                        n_known += times
                        logs += times * math.log10(c + 0.5)
                    else:
                        out.append((row, None, None, None, None, None, None, None, word.decode(), times))
                out.append((row, doc_id, training_row, sum(map(len, words)) + len(words) - 1, len(words), n_known, logs, bits[k] * math.log10(2) - rest[k], None, None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    parts = written(rows.mapInArrow(run, "row long, doc_id long, training boolean, n_bytes long, n_tokens long, n_known long, log_counts double, log_rest double, token string, n long"), "lm-parts")
    rare = parts.filter("token is not null").select("row", "token", F.col("n").alias("times")).join(counts, "token", "left")
    c = F.coalesce("n", F.lit(0))
    rare = rare.select("row", F.when(c > 0, F.col("times")).otherwise(0).alias("n_known"), (F.col("times") * F.log10(c + 0.5)).alias("log_counts"))
    whole = parts.filter("token is null").drop("token", "n").unionByName(rare, allowMissingColumns=True).groupBy("row").agg(
        *[F.max(x).alias(x) for x in ("doc_id", "training", "n_bytes", "n_tokens", "log_rest")], F.sum("n_known").alias("n_known"), F.sum("log_counts").alias("log_counts"))
    score = F.col("log_counts") + F.col("log_rest")
    return whole.select(
        "doc_id", "training", "n_tokens", F.col("n_known").cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("log_counts") - F.col("n_tokens") * math.log10(total + 0.5 * (kinds + 1))).alias("base_score"), score.alias("score"),
        (-score * math.log2(10) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )

"""Vector code compression: product quantisation whose nearest entries are found in vantage-point trees.

Each part position has a codebook, and a tree over its entries. A node's vantage entry splits the rest into near and
far halves and knows the least and greatest distance of each half to it. A search keeps the best squared distance so far
and enters a half unless the triangle inequality says that all of it is farther. Distances are compared as integers:
the halves' bounds and the query's distance are square roots rounded to the safe side, a half that could only tie is
entered too, and what is found is the squared distance in integers, ties to the lower index. Batches of vectors
descend together. Codebooks are a fixed number of integers, so only they and their sums meet at the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written

PARTS, ENTRIES, TURNS, SCALE = 16, 64, 2, 256
#: Integer components are below this in absolute value, so that squared distances of 2^9 of them fit 64 bits.
LARGEST = 1 << 26
#: Rows that descend together; entries of a leaf; salts of a label.
AT_A_TIME, LEAF, SALTS = 4096, 4, 16


@dataclass(frozen=True)
class Node:
    """entries: the vantage entry alone, or a leaf's. halves: (least, greatest distance to the vantage entry, node), the
    first rounded down, the second up."""

    entries: list[int]
    halves: tuple = ()


def _isqrt(x: np.ndarray) -> np.ndarray:
    """floor(sqrt(x)) of integers below 2^63."""
    r = np.sqrt(x.astype(np.float64)).astype(np.int64)
    r -= (r > 0) & (r * r > x)
    return r + ((r + 1) * (r + 1) <= x)


def _squared(x: np.ndarray, entry: np.ndarray) -> np.ndarray:
    d = x - entry
    return (d * d).sum(axis=1)


def tree(codebook: np.ndarray, members: list[int] | None = None) -> Node:
    """The vantage-point tree over a codebook's entries: the vantage entry is the one farthest from the first of the node's."""
    members = list(range(len(codebook))) if members is None else members
    if len(members) <= LEAF:
        return Node(members)
    at = members[int(_squared(codebook[members], codebook[members[0]]).argmax())]
    rest = [m for m in members if m != at]
    d = _squared(codebook[rest], codebook[at])
    order = np.argsort(d, kind="stable")
    low, high = _isqrt(d), _isqrt(np.maximum(d, 1) - 1) + (d > 0)
    halves = [h for h in (order[: len(order) // 2], order[len(order) // 2 :]) if len(h)]
    return Node([at], tuple((int(low[h].min()), int(high[h].max()), tree(codebook, [rest[i] for i in h])) for h in halves))


def nearest(x: np.ndarray, codebook: np.ndarray, root: Node) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x the index of its nearest entry and the squared distance to it."""
    best, which = np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), len(codebook))

    def visit(node: Node, rows: np.ndarray) -> None:
        for e in node.entries:
            d = _squared(x[rows], codebook[e])
            better = (d < best[rows]) | (d == best[rows]) & (e < which[rows])
            best[rows[better]], which[rows[better]] = d[better], e
        if not node.halves:
            return
        below = _isqrt(d)  # the distance to the vantage entry is in [below, above]
        above = below + (below * below < d)

        def enter(half, some: np.ndarray) -> None:
            low, high, inner = half
            least = np.maximum(np.maximum(below[some] - high, low - above[some]), 0)
            going = some[least * least <= best[rows[some]]]
            if len(going):
                visit(inner, rows[going])

        every = np.arange(len(rows))
        if len(node.halves) == 1:
            return enter(node.halves[0], every)
        near_first = below * 2 <= node.halves[0][1] + node.halves[1][0]
        for turn in (0, 1):  # the likelier half first
            for half, some in ((turn, every[near_first]), (1 - turn, every[~near_first])):
                if len(some):
                    enter(node.halves[half], some)

    for i in range(0, len(x), AT_A_TIME):
        visit(root, np.arange(i, min(i + AT_A_TIME, len(x))))
    return which, best


def vectors_of(batch: pa.RecordBatch, column: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(the kept rows of a batch, their integer components): without null vectors, null, non-finite or too large components,
    or lengths that aren't `length`."""
    lists = batch.column(column)
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(np.nan_to_num(lengths, nan=-1).astype(np.int64) == length)
    values = pc.list_flatten(lists.take(pa.array(rows))).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), length)
    good = (np.abs(values) * SCALE < LARGEST).all(axis=1)  # false for NaN
    return rows[good], np.floor(values[good] * SCALE).astype(np.int64)


def first_vectors(rows: DataFrame, parts: int, entries: int) -> list[list[float]]:
    """The vectors of the `entries` smallest ids of usable rows, ascending; of rows that share an id, the least vector. The
    first of them sets the length that the others must have."""
    embedding = F.col("embedding")
    fine = F.forall(embedding, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) * SCALE < LARGEST))
    some = rows.filter(F.col("vec_id").isNotNull() & embedding.isNotNull() & (F.size(embedding) > 0) & (F.size(embedding) % parts == 0)).filter(fine)
    first = some.orderBy("vec_id", "embedding").limit(1).collect()
    if not first:
        return []
    some, out = some.filter(F.size(embedding) == len(first[0].embedding)), {}
    found = some
    while len(out) < entries and (rows := found.orderBy("vec_id", "embedding").limit(entries).collect()):  # again only where ids repeat
        for r in rows:
            out.setdefault(r.vec_id, r.embedding)
        found = some.filter(F.col("vec_id") > rows[-1].vec_id)
    return list(out.values())[:entries]


def _cut(x: np.ndarray, parts: int) -> np.ndarray:
    """(part, row, position)"""
    return x.reshape(len(x), parts, -1).transpose(1, 0, 2)


def averaged(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after each entry is replaced by the floored mean of the parts that it is nearest to; others stay. Tasks
    hand on a sum for each component."""
    trees, (parts, entries, width) = [tree(b) for b in books], books.shape

    def run(batches) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for part, x in enumerate(_cut(vectors_of(batch, 0, parts * width)[1], parts)):
                which, _ = nearest(x, books[part], trees[part])
                np.add.at(sums[part], which, x)
                counts[part] += np.bincount(which, minlength=entries)
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry]), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    found = rows.select("embedding").mapInArrow(run, "part int, entry int, n long, sums array<long>")
    each = found.select("part", "entry", "n", F.posexplode("sums").alias("position", "sum"))
    totals = each.groupBy("part", "entry", "position").agg(F.sum("n").alias("n"), F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum"))
    out = books.copy()
    for r in totals.collect():  # entries x components of a vector, at most
        out[r.part, r.entry, r.position] = int(r["sum"]) // r.n
    return out


def trained(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, turns: int = TURNS) -> np.ndarray | None:
    """The codebooks (part, entry, position) after `turns` rounds over all usable rows of rows(vec_id, embedding); None if
    there is none."""
    first = first_vectors(rows, parts, entries)
    if not first:
        return None
    books = _cut(np.floor(np.array(first, np.float64) * SCALE).astype(np.int64), parts)
    for _ in range(turns):
        books = averaged(rows, books)
    return books


def encoded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, codes (an index per part) and error of the usable rows of rows(vec_id, embedding, label)."""
    trees, parts, width = [tree(b) for b in books], len(books), books.shape[2]
    types = rows.schema

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, x = vectors_of(batch, 2, parts * width)
            found = [nearest(p, b, t) for p, b, t in zip(_cut(x, parts), books, trees, strict=True)]
            codes = np.stack([f[0] for f in found], axis=1).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(kept) + 1) * parts, pa.int32()), pa.array(codes.reshape(-1)))
            error = np.sum([f[1] for f in found], axis=0, dtype=np.int64) if len(kept) else np.zeros(0, np.int64)
            at = pa.array(kept)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), lists, pa.array(error)], ["vec_id", "label", "codes", "error"])

    kinds = ", ".join(f"{c} {types[c].dataType.simpleString()}" for c in ("vec_id", "label"))
    return rows.select("vec_id", "label", "embedding").mapInArrow(run, f"{kinds}, codes array<int>, error long")


def decoded(codes: DataFrame, books: np.ndarray) -> DataFrame:
    """codes(vec_id, codes, ...) with `approximation`, the integer vector of the codes' entries."""
    parts = [F.array(*[F.array(*[F.lit(int(v)) for v in entry]) for entry in book]) for book in books]
    return codes.withColumn("approximation", F.flatten(F.array(*[F.get(p, F.get("codes", i)) for i, p in enumerate(parts)])))


def as_text(books: np.ndarray) -> str:
    return ",".join(map(str, books.reshape(-1).tolist()))


def vector_codes(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, turns: int = TURNS) -> DataFrame:
    """Compresses rows(vec_id, embedding, label) to an index per part, after learning a codebook for each part position.

    Returns vec_id, code (two hex digits per part), error, label_error, codebooks_sha256 for each usable row. Not usable are
    rows whose vector is null or empty, holds null, non-finite components or such of 2^18 or more in absolute value, has a
    length that isn't a multiple of `parts`, or another length than the usable vector of least vec_id. Rows without vec_id
    are encoded, but start no entry; of rows that repeat a vec_id, the least vector starts one; repeated rows keep a row
    each; null labels are one label; fewer ids than entries make fewer entries; other columns are not looked at; without
    usable rows that have an id there is no row.
    """
    if not 0 < entries <= 256:
        raise ValueError("an index has two hex digits: 1 to 256 entries")
    rows = rows.select("vec_id", "label", "embedding")
    books = trained(rows, parts, entries, turns)
    if books is None:
        return rows.limit(0).select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    found = written(encoded(rows, books), "vector-codes")
    label = F.struct(F.col("label").isNull().alias("none"), F.coalesce(F.col("label").cast("string"), F.lit("")).alias("name"))
    salts = F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")
    totals = found.groupBy(label.alias("of")).agg(F.sum("error").alias("label_error")).withColumn("salt", F.explode(salts))
    salted = found.withColumns({"of": label, "salt": F.pmod(F.xxhash64("vec_id", "codes"), F.lit(SALTS))})
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    digest = hashlib.sha256(as_text(books).encode()).hexdigest()
    return salted.join(totals, ["of", "salt"]).select("vec_id", code.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))

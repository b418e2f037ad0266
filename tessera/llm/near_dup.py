"""Near-duplicate detection: fast similarity sketches, banding, exact verification, components.

The sketch throws a set's hashes into t bins. Round i < t hashes each element to a bin of its own; round t + j sends
all to bin j, so every bin fills after 2 t rounds at most and, for sets of more than about t log t elements, after one or
two. A bin keeps its least (round, value). Two sets agree in a bin with the probability of their Jaccard similarity,
with the concentration that independent coordinates would have.

Bands of bins deal the distinct sets to buckets. A bucket's members are not paired with each other. They are compared,
on full sets, with a leader, and links join components. For every pair that is linked but was not compared, one of two
things then holds, both of which the comparisons with the leader L tell:

* some element outside L is in both: they meet again in the bucket (L, element), for which a member lists just as many
  of its elements outside L, in one order for all, as a link needs it to;
* or all they share lies in L: then each shares enough with L for a link, and they meet again in a bucket of L.

Only members of different components are compared there, and only if their sizes and the parities of their elements'
hashes, which give a lower bound of the difference of two sets, leave room for a link. So no link between components is
lost, while a group of near copies costs little more than a comparison per member.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, text_or_empty, written
from tessera.llm.components import connected_components

#: Chance that a pair exactly at the threshold shares no bucket.
MISS = 2e-7
#: Set elements that a task sketches at a time, and that it remembers while it compares.
AT_A_TIME, REMEMBERED = 400_000, 2_000_000
#: Members of a bucket of prefix elements up to which all pairs of it are tried.
SMALL = 16
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


class _Hashes(dict):
    """64-bit hashes of words, remembered; emptied before it grows large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser over x and seed."""
    x = x ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str, size: int, memo: _Hashes) -> np.ndarray:
    """The distinct hashes of `size` successive words, A-Z lower-cased, sorted; of fewer words, of all as one."""
    hashes = np.array([memo[w] for w in text.encode().lower().split()], dtype=np.uint64)
    if not len(hashes):
        return hashes
    size = min(size, len(hashes))
    out = _mix(hashes[: len(hashes) - size + 1], size)
    for k in range(1, size):
        out = _mix(out ^ hashes[k : len(hashes) - size + 1 + k], k)
    return np.unique(out)


def sketches(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """A row of `bins` values per set, none of which is empty."""
    out = np.full((len(sets), bins), FULL, dtype=np.uint64)
    flat, items = out.reshape(-1), np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    lacking, open_sets = np.zeros(len(sets), dtype=bool), np.unique(owner)
    for i in range(2 * bins):
        if not len(items):
            break
        value = _mix(items, i + 1)
        at = ((value >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32) if i < bins else np.uint64(i - bins)
        np.minimum.at(flat, owner * bins + at.astype(np.int64), (np.uint64(i) << np.uint64(48)) | (value & np.uint64(0xFFFFFFFFFFFF)))
        open_sets = open_sets[(out[open_sets] == FULL).any(axis=1)]
        lacking[:] = False
        lacking[open_sets] = True
        left = lacking[owner]
        items, owner = items[left], owner[left]
    return out


def banding(percent: int) -> tuple[int, int]:
    """(bands, rows in each) at which a pair of that similarity is missed with a chance of MISS."""
    rows = 6 if percent >= 85 else 5 if percent >= 75 else 4
    return math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** rows)), rows


def sketched(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(doc_id, n, set_key, buckets, text_hash) per row; set_key names the set, buckets its bands; both null for an empty
    set."""
    bands, rows = banding(percent)

    def run(batches) -> Iterator[pa.RecordBatch]:
        memo = _Hashes()

        def rest(ids, sets, hashes):
            found = sketches(sets, bands * rows).reshape(len(sets), bands, rows)
            keys = _mix(found[:, :, 0], 1) ^ np.arange(bands, dtype=np.uint64)
            for k in range(1, rows):
                keys = _mix(keys ^ found[:, :, k], k + 1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * bands, pa.int32()), pa.array(keys.reshape(-1).view(np.int64)), mask=pa.array([not len(s) for s in sets]))
            names = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(names, pa.binary()), lists, pa.array(hashes, pa.int64())], ["doc_id", "n", "set_key", "buckets", "text_hash"])

        for batch in batches:
            ids, sets, hashes, held = [], [], [], 0
            for doc_id, text, text_hash in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                ids.append(doc_id)
                hashes.append(text_hash)
                sets.append(shingle_set(text.as_py(), size, memo))
                held += len(sets[-1])
                if held > AT_A_TIME:
                    yield rest(ids, sets, hashes)
                    ids, sets, hashes, held = [], [], [], 0
            if ids:
                yield rest(ids, sets, hashes)

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().cast("string").alias("text"), F.xxhash64("text").alias("text_hash")).mapInArrow(run, "doc_id long, n long, set_key binary, buckets array<long>, text_hash long")


def size_classes(n: int, percent: int) -> list[int]:
    """One or two classes of a set's size; two sets of which one has `percent` / 100 of the other's size share one."""
    x = int(math.log(n) / (math.log(100 / percent) + 1e-6))
    return sorted({x // 2, (x + 1) // 2})


def parities(elements: np.ndarray, size_class: int, percent: int) -> np.ndarray:
    """For each of a class's fixed number of bits whether an odd number of elements hash to it, in 64-bit words. Two sets
    differ in at least as many elements as in bits."""
    largest = (100 / percent) ** (2 * size_class + 2)
    bits = 1 << max(6, math.ceil(math.log2(2 * largest)))
    odd = np.bincount((_mix(elements, 9) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def signature(elements: np.ndarray) -> bytes:
    """Parities of a set on its own: twice as many bits as it has elements, or up to four times, 2^16 at most."""
    bits = 1 << min(16, max(6, (2 * len(elements) - 1).bit_length()))
    return np.packbits((np.bincount((_mix(elements, 9) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def odd(x: bytes, y: bytes) -> int:
    """In how many bits two signatures differ, the longer one folded to the shorter one's bits: no more than the elements
    that are in one of the sets only."""
    a, b = (np.frombuffer(s, np.uint64) for s in sorted((x, y), key=len))
    return int(np.bitwise_count(a ^ np.bitwise_xor.reduce(b.reshape(-1, len(a)))).sum())


def roomy(pairs: DataFrame, signs: DataFrame, percent: int) -> DataFrame:
    """pairs(a, b, alone) without those alone whose sizes or signatures, of signs(node, n, signature), leave no room for a link:
    that takes a few hundred bytes of each, where a comparison takes both texts."""
    of = lambda x: signs.select(F.col("node").alias(x), F.col("n").alias(f"{x}_n"), F.col("signature").alias(f"{x}_sign"))

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(*[batch.column(k).to_pylist() for k in range(2, 6)], strict=True)
            fits = [100 * min(n, m) >= percent * max(n, m) and odd(x, y) <= n + m - 2 * -(-percent * (n + m) // (100 + percent)) for n, m, x, y in both]
            yield batch.select(["a", "b"]).filter(pa.array(fits, pa.bool_()))

    met = pairs.filter("alone").select("a", "b").join(of("b"), "b").join(of("a"), "a").select("a", "b", "a_n", "b_n", "a_sign", "b_sign")
    return met.mapInArrow(run, "a long, b long").withColumn("alone", F.lit(True)).unionByName(pairs.filter("not alone"))


def _sets(size: int):
    """of(node, text): its set, remembered while there is room."""
    memo, kept, held = _Hashes(), {}, 0

    def of(node: int, text: str) -> np.ndarray:
        nonlocal held
        if node not in kept:
            if held > REMEMBERED:
                kept.clear()
                held = 0
            kept[node] = shingle_set(text, size, memo)
            held += len(kept[node])
        return kept[node]

    return of


def least_difference(x: np.ndarray, y: np.ndarray, depth: int = 3) -> int:
    """A lower bound of how many elements are in one of two sorted sets only: both are cut at an element of y, and the parts'
    sizes, or bounds of their own, add up."""
    if not depth or len(x) < 2 or len(y) < 2:
        return abs(len(x) - len(y))
    at = len(y) // 2
    cut = int(np.searchsorted(x, y[at]))
    return least_difference(x[:cut], y[:at], depth - 1) + least_difference(x[cut:], y[at:], depth - 1)


def compared(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """pairs(a, b, alone) with `linked`, and for those that no others meet (not `alone`), a row for each size class of a
    with n (a's size), most (the greatest size of a set that can be linked with a by what a shares with b), and `buckets`,
    where a meets the others that were compared with b, those which it can be linked with: one for each of as many of a's
    elements outside b, in ascending order, as a link needs one of. `inside`: the bucket for those that share with a
    nothing but elements of b; null if a has too few of them."""
    left = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    right = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    rows = pairs.select("a", "b", "alone").join(left, "b").join(right, "a").select("a", "b", "text_a", "text_b", "alone")

    def run(batches) -> Iterator[pa.RecordBatch]:
        of = _sets(size)
        for batch in batches:
            out: list[tuple] = []
            for a, b, text_a, text_b, alone in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), batch.column(4).to_pylist(), strict=True):
                x, y = of(a, text_a.as_py()), of(b, text_b.as_py())
                if alone and least_difference(x, y) > len(x) + len(y) - 2 * -(-percent * (len(x) + len(y)) // (100 + percent)):
                    continue
                shares = y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x
                shared = int(shares.sum())
                linked = 100 * shared >= percent * (len(x) + len(y) - shared)
                if alone:
                    out.append((a, b, linked, None, None, None, None, None))
                    continue
                others, need = x[~shares], -(-percent * len(x) // 100)
                others = others[: len(others) - max(1, need - shared) + 1]
                name = _mix(np.array([b], np.int64).view(np.uint64), 7)
                most = shared * (100 + percent) // percent - len(x)
                for c in size_classes(len(x), percent):
                    inside = int(_mix(name, 1000 + c).view(np.int64)[0]) if 100 * most >= percent * len(x) else None
                    out.append((a, b, linked, c, len(x), most, inside, _mix(others ^ name, 100 + c).view(np.int64)))
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out, strict=True) if out else [[]] * 8, kinds, strict=True)], ["a", "b", "linked", "class", "n", "most", "inside", "buckets"])

    return rows.mapInArrow(run, "a long, b long, linked boolean, class int, n long, most long, inside long, buckets array<long>")


def led(rows: DataFrame) -> DataFrame:
    """(a, b, alone): each member a of rows(bucket, node, size) with its bucket's leader b, the member that shares most buckets
    with others; ties go to the least node. alone: no bucket of both has a third member."""
    central = rows.groupBy("node").agg(F.sum("size").alias("weight"))
    ranked = rows.select("bucket", "node", "size").join(central, "node")
    leaders = ranked.groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("node")).alias("minus"))).alias("top")).select("bucket", (-F.col("top.minus")).alias("leader"))
    met = ranked.join(leaders, "bucket").filter("node <> leader")
    return met.groupBy(F.col("node").alias("a"), F.col("leader").alias("b")).agg((F.max("size") == 2).alias("alone"))


def together(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): the pairs that meet in a bucket of rows(bucket, node, n, position), elements of prefixes in an order common to
    all sets, and that could be linked: by their lengths, by what can come before and after each element they met by, and
    by how many they met by, with which all of one's elements after its prefix may at best be shared besides. rows holds
    every bucket of both, or a linked pair may be left out."""
    left, right = (rows.select("bucket", *[F.col(c).alias(f"{side}_{c}") for c in ("node", "n", "position")]) for side in "ab")
    met = left.join(right, "bucket").filter("a_node < b_node").filter(100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n"))
    most = F.least("a_position", "b_position") + F.least(F.col("a_n") - F.col("a_position"), F.col("b_n") - F.col("b_position"))
    need = percent * (F.col("a_n") + F.col("b_n"))
    found = met.groupBy(F.col("a_node").alias("a"), F.col("b_node").alias("b")).agg(F.count(F.lit(1)).alias("shared"), F.min(most).alias("most"), *[F.any_value(f"{x}_n").alias(f"{x}_n") for x in "ab"])
    after = lambda n: F.floor((percent * F.col(n) + 99) / 100) - 1  # noqa: E731  a prefix leaves so many
    reach = F.least(F.col("most"), F.col("shared") + F.greatest(after("a_n"), after("b_n")))
    return found.filter((100 + percent) * reach >= need).select("a", "b")


def candidates(rows: DataFrame, percent: int, ordered: bool) -> DataFrame:
    """(a, b, alone): the pairs to compare of rows(bucket, node, size, n, position). Where buckets are elements in order, the
    members of small ones are all paired, and of larger ones compared with a leader; that is as many pairs a row at most.
    A pair that larger buckets bring together is left to them."""
    if not ordered:
        return led(rows)
    large = led(rows.filter(F.col("size") > SMALL)).withColumn("alone", F.lit(False))
    either = large.select("a", "b").unionByName(large.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return together(rows.filter(F.col("size") <= SMALL), percent).join(either, ["a", "b"], "left_anti").withColumn("alone", F.lit(True)).unionByName(large)


def left_over(found: DataFrame, labels: DataFrame, texts: DataFrame, size: int, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """(a, b): pairs of different components that met in a bucket of compared() and that sizes and parities allow a link;
    and the tables that it stands on."""
    outside = found.select(F.explode("buckets").alias("bucket"), F.col("a").alias("node"), "class", "n", F.lit(None).cast("long").alias("most"))
    inside = found.filter("inside is not null").select(F.col("inside").alias("bucket"), F.col("a").alias("node"), "class", "n", "most")
    rows = outside.unionByName(inside).join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = rows.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("bucket")
    met = written(rows.join(several, "bucket"), "met")

    def bits(batches) -> Iterator[pa.RecordBatch]:
        of = _sets(size)
        for batch in batches:
            found = [parities(of(node, text.as_py()), c, percent) for node, c, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int64()))], ["node", "class", "bits"])

    signs = met.select("node", "class").distinct().join(texts, "node").select("node", "class", "text").mapInArrow(bits, "node long, class int, bits array<long>")
    signed = written(met.join(signs, ["node", "class"]), "signed")
    other = signed.select("bucket", *[F.col(c).alias(f"other_{c}") for c in ("node", "n", "most", "component", "bits")])
    both = F.col("n") + F.col("other_n")
    apart = F.aggregate(F.zip_with("bits", "other_bits", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    fits = (F.col("node") < F.col("other_node")) & (F.col("component") != F.col("other_component"))
    fits = fits & (100 * F.least("n", "other_n") >= percent * F.greatest("n", "other_n")) & F.coalesce((F.col("n") <= F.col("other_most")) & (F.col("other_n") <= F.col("most")), F.lit(True))
    fits = fits & (apart <= both - 2 * F.ceil(percent * both / (100 + percent)))
    return signed.join(other, "bucket").filter(fits).select(F.col("node").alias("a"), F.col("other_node").alias("b"), F.lit(True).alias("alone")).distinct(), [met, signed]


def relabelled(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """labels(node, component) after more links(a, b): a table of the nodes that have any."""
    if labels is None:
        return written(connected_components(links), "labels")
    end = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
    edges = links.join(end("a"), "a", "left").join(end("b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")).filter("a <> b")
    merged = written(connected_components(edges), "merged")
    moved = labels.join(merged.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return written(moved.unionByName(merged.join(labels.select("node"), "node", "left_anti")), "labels")


def components(classes: DataFrame, names: DataFrame, docs: DataFrame, size: int, percent: int, ordered: bool) -> DataFrame:
    """(node, component) of the sets of classes(node, n, buckets), a written table that is discarded, that are linked with
    others; names(node, n, doc_id, text_hash, and where ordered signature): the text of a set is that of any row of that
    doc_id and text_hash. ordered: buckets are elements in an order common to all sets.

    Each step is a table before the next one begins, so that its shuffle files are gone, and only sets of pairs that are
    left take their texts along."""
    rows = classes.select("node", "n", F.posexplode("buckets").alias("position", "bucket"))
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    rows = written(rows.join(shared, "bucket"), "buckets")
    discard(classes)
    pairs = written(candidates(rows, percent, ordered), "pairs")
    discard(rows)
    if ordered:
        met, pairs = pairs, written(roomy(pairs, names, percent), "roomy-pairs")
        discard(met)
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    some = names.select("node", "doc_id", "text_hash").join(nodes, "node")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    texts = written(texts.join(some, ["doc_id", "text_hash"]).select("node", "text").dropDuplicates(["node"]), "near-texts")
    found = written(compared(pairs, texts, size, percent), "compared")
    discard(pairs)
    first = relabelled(None, found.filter("linked").select("a", "b").distinct())
    pairs, used = left_over(found, first, texts, size, percent)
    more = written(compared(pairs, texts, size, percent).filter("linked").select("a", "b"), "links")
    labels = relabelled(first, more)
    discard(texts, found, first, more, *used)
    return labels


def grouped(all_rows: DataFrame, docs: DataFrame, size: int, percent: int, ordered: bool = False) -> DataFrame:
    """all_rows(doc_id, n, set_key, buckets, text_hash, and where ordered signature), a written table that is discarded,
    with `component`, without buckets: the least doc_id of the rows whose sets are linked with the row's. Null for an
    empty set or a null doc_id. A set is a node of its own, whatever the ids of its rows."""
    named = all_rows.filter("set_key is not null and doc_id is not null")
    first = named.groupBy("set_key").agg(F.min("doc_id").alias("least"))
    rows = named.join(first, "set_key").filter("doc_id = least").dropDuplicates(["set_key"]).drop("least")
    classes = written(rows.withColumn("node", F.monotonically_increasing_id()), "classes")
    names = written(classes.drop("buckets"), "names")
    plain = written(all_rows.select("doc_id", "n", "set_key", "text_hash"), "rows")
    discard(all_rows)
    found = components(classes, names, docs, size, percent, ordered)
    labels = names.select("set_key", "doc_id", "node").join(found, "node", "left").select("set_key", "doc_id", F.coalesce("component", "node").alias("of"))
    least = labels.groupBy("of").agg(F.min("doc_id").alias("component"))
    labels = written(labels.join(least, "of").select("set_key", "component"), "set-labels")
    discard(names, found)
    out = plain.join(labels, "set_key", "left")
    return out.withColumn("component", F.when(F.col("doc_id").isNotNull(), F.col("component")))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Groups the rows of docs(doc_id, text) whose sets of `size`-word shingles have a Jaccard similarity of `percent` /
    100 or more, directly or over others.

    Returns doc_id, n_shingles, component_id (the least doc_id of the group), kept (doc_id = component_id) and text_hash
    (xxhash64 of text), a row per input row. A null text counts as empty; an empty set is linked with nothing; a row is
    grouped by its own text, so rows that share a doc_id but not a text may be in groups of their own; a row whose doc_id
    is null is linked with nothing, has a null component_id and is kept; other columns are not looked at; an empty table
    gives no row.
    """
    found = grouped(written(sketched(docs, size, percent), "sketches"), docs, size, percent)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"), "text_hash")

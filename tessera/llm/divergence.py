"""Source divergence audit: how each source's use of words departs from its language's and from every other source's.

Terms are counted per (language, source), task by task first. Shares are smoothed and kept as whole billionths, so all
arithmetic is exact. Two groups' divergence is a sum over every term of the language, most of which neither has, so it is
built from what is there: all terms at both groups' shares of an absent term (the baseline), plus a correction for each
distinct share of one group against the other's baseline, plus a correction for each term that both have. Terms of a
group that exceed the language are ranked by radix selection: histograms over the values' bits, ten at a time, find the
value of the kth, and ties there are settled by the bytes of the terms, one differing byte at a time.
"""

from __future__ import annotations

import os.path
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import discard, written

#: Terms, over all groups, that a task counts before it hands them on; bytes of a text that are split at a time.
HELD, PIECE = 400_000, 1 << 20
#: Sums of pairs that a task holds before it hands them on, and sources of a term that meet the others at a time.
PAIRS, ABREAST = 1_000_000, 512
#: Values are below 2^30: three rounds of ten bits.
ROUNDS = (20, 10, 0)
SALTS = 16
GROUP = ["lang", "source"]

#: What is no part of a term becomes a space, A-Z become a-z.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def term_lists(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text, in lists of about PIECE bytes of text."""
    folded, at = text.translate(FOLD), 0
    while at < len(folded):
        end = folded.find(b" ", at + PIECE)
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and rows that have the term; a null term with zeros for each group, so
    that groups without terms occur. Nulls of docs(lang, source, text) count as ''."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        occurrences: dict[tuple, Counter] = {}
        rows: dict[tuple, Counter] = {}

        def out():
            for group, counts in occurrences.items():
                terms, there = [*counts], rows[group]
                columns = [pa.array([group[0]] * len(terms), pa.string()), pa.array([group[1]] * len(terms), pa.string()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(counts.values(), pa.int64()), pa.array([there[t] for t in terms], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])
            occurrences.clear()
            rows.clear()

        known: set[tuple] = set()
        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                group = (lang, source)
                if group not in occurrences:
                    occurrences[group], rows[group] = Counter(), Counter()
                if group not in known:
                    known.add(group)
                    yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([source]), pa.array([None], pa.string()), pa.array([0]), pa.array([0])], ["lang", "source", "term", "n", "docs"])
                distinct: set[bytes] = set()
                for terms in term_lists(text.as_py().encode()):
                    occurrences[group].update(terms)
                    distinct.update(terms)
                rows[group].update(distinct)
                if sum(map(len, occurrences.values())) > HELD:
                    yield from out()
        yield from out()

    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    parts = docs.select(empty("lang"), empty("source"), empty("text")).mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return parts.groupBy(*GROUP, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (n + 2) / (total + 2 terms)), null without terms."""
    of = F.when(terms > 0, total + 2 * terms).cast("decimal(20,0)")
    return F.call_function("div", (n + 2).cast("decimal(20,0)") * F.lit(1_000_000_000).cast("decimal(10,0)"), of) + 1


def apart(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q))"""
    return F.call_function("div", (p - q) * (p - q), p + q)


def shared_corrections(rows: DataFrame) -> DataFrame:
    """(lang, source, other, value): over the terms that both groups of a language have, how far the divergence departs
    from the sum of the two one-sided ones, once per pair in any order. rows(lang, term, source, p, absent). Tasks hold the
    terms of their part in order and hand on sums, so pairs are not rows before they are summed."""

    def f(p, q):
        return (p - q) * (p - q) // (p + q)

    def run(batches) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[dict, dict]] = {}  # by language: numbers of sources, sums by pair of numbers
        size = 0
        held: list = []  # the rows of one term
        at = None

        def out():
            for lang, (numbers, pairs) in sums.items():
                names = [*numbers]
                keys = np.fromiter(pairs, np.int64, len(pairs))
                ends = [pa.array([names[k] for k in side], pa.string()) for side in (keys >> 32, keys & 0xFFFFFFFF)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), *ends, pa.array(pairs.values(), pa.int64())], ["lang", "source", "other", "value"])
            sums.clear()

        def settle():
            nonlocal size
            if len(held) < 2:
                return
            numbers, pairs = sums.setdefault(at[0], ({}, {}))
            k = np.array([numbers.setdefault(s, len(numbers)) for s, _, _ in held])
            by = np.argsort(k)
            k, p, p0 = k[by], np.array([x[1] for x in held])[by], np.array([x[2] for x in held])[by]
            size -= len(pairs)
            for i in range(0, len(k), ABREAST):
                a, a0 = p[i : i + ABREAST, None], p0[i : i + ABREAST, None]
                found = f(a, p[None]) - f(a, p0[None]) - f(a0, p[None]) + f(a0, p0[None])
                first, second = np.nonzero(k[i : i + ABREAST, None] < k[None])
                for key, value in zip(((k[i + first] << 32) | k[second]).tolist(), found[first, second].tolist(), strict=True):
                    pairs[key] = pairs.get(key, 0) + value
            size += len(pairs)

        for batch in batches:
            for lang, term, source, p, absent in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (lang, term) != at:
                    settle()
                    held.clear()
                    at = (lang, term)
                    if size > PAIRS:
                        yield from out()
                        size = 0
                held.append((source, p, absent))
        settle()
        yield from out()

    dealt = rows.select("lang", "term", "source", "p", "absent").repartition("lang", "term").sortWithinPartitions("lang", "term")
    return dealt.mapInArrow(run, "lang string, source string, other string, value long").groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))


def divergences(groups: DataFrame, rows: DataFrame) -> DataFrame:
    """(lang, source, item, value): every ordered pair of different groups of a language, and the sum over all its terms
    of apart(). groups(lang, source, absent, terms), rows(lang, source, term, p, absent)."""
    salted = groups.withColumn("salt", F.pmod(F.xxhash64("source"), F.lit(SALTS)))
    other = groups.select("lang", F.col("source").alias("item"), F.col("absent").alias("other_absent"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")).alias("salt"))
    pairs = written(salted.join(other, ["lang", "salt"]).filter("source <> item").select("lang", "source", "item", "absent", "other_absent", "terms"), "pairs")
    shares = rows.groupBy(*GROUP, "p").agg(F.count(F.lit(1)).alias("times"))
    p, q0, p0 = F.col("p"), F.col("other_absent"), F.col("absent")
    one_sided = pairs.join(shares, GROUP).groupBy("lang", "source", "item").agg(F.sum(F.col("times") * (apart(p, q0) - apart(p0, q0))).alias("value"))
    both = shared_corrections(rows)
    base = pairs.select("lang", "source", "item", F.coalesce(F.col("terms") * apart(p0, q0), F.lit(0)).alias("value"))
    turned = lambda df, a, b: df.select("lang", F.col(b).alias("source"), F.col(a).alias("item"), "value")
    parts = base.unionByName(one_sided).unionByName(turned(one_sided, "source", "item")).unionByName(both.withColumnRenamed("other", "item")).unionByName(turned(both, "source", "other"))
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def kth(hist: DataFrame, key: str, descending: bool) -> DataFrame:
    """The bucket in which each group's `need`th row lies, of hist(lang, source, need, key, rows): (lang, source, key, rows,
    need), need being what is still wanted of the bucket. No row for a group that has too few. A group has no more buckets
    than a round of bits, or a byte, tells apart."""
    by = Window.partitionBy(*GROUP).orderBy(F.col(key).desc() if descending else F.col(key)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = hist.withColumn("to", F.sum("rows").over(by))
    return reached.filter("to >= need and to - rows < need").select(*GROUP, key, "rows", (F.col("need") - F.col("to") + F.col("rows")).alias("need"))


def top_terms(rated: DataFrame, most: int) -> DataFrame:
    """The `most` rows of each group of rated(lang, source, term, value) of greatest value, ties by the UTF-8 bytes of the
    term ascending; a term is in a group once."""
    bound = None
    for shift in ROUNDS:
        if bound is None:
            at = rated.withColumn("need", F.lit(most).cast("long"))
        else:
            at = rated.join(bound.withColumnRenamed("bucket", "above"), GROUP).filter(F.shiftright("value", shift + 10) == F.col("above"))
        hist = at.groupBy(*GROUP, "need", F.shiftright("value", shift).alias("bucket")).agg(F.count(F.lit(1)).alias("rows"))
        bound = written(kth(hist, "bucket", True), "radix")
    threshold = bound.select(*GROUP, F.col("bucket").alias("least"), "rows", "need")
    placed = rated.join(threshold, GROUP, "left")
    chosen = [placed.filter("least is null or value > least or value = least and rows = need").select(*GROUP, "term", "value")]
    ties = written(placed.filter("value = least and rows > need").select(*GROUP, "term", "value", "need"), "ties")
    while not ties.isEmpty():
        ends = ties.groupBy(*GROUP).agg(F.min("term").alias("low"), F.max("term").alias("high"))
        byte = F.substring(F.encode("term", "utf-8"), F.col("skip") + 1, F.lit(1))
        at = ties.join(common_bytes(ends), GROUP).withColumn("byte", byte)
        hist = at.groupBy(*GROUP, "need", "byte").agg(F.count(F.lit(1)).alias("rows"))
        bound = kth(hist, "byte", False).withColumnRenamed("byte", "last").withColumnRenamed("need", "wanted")
        cut = written(at.join(bound, GROUP), "ties-cut")
        chosen.append(cut.filter("byte < last or byte = last and rows = wanted").select(*GROUP, "term", "value"))
        ties = written(cut.filter("byte = last and rows > wanted").select(*GROUP, "term", "value", F.col("wanted").alias("need")), "ties")
    out = chosen[0]
    for more in chosen[1:]:
        out = out.unionByName(more)
    return out


def common_bytes(ends: DataFrame) -> DataFrame:
    """(lang, source, skip): how many bytes the least and the greatest term of each group, and so all between, begin with."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            skip = [len(os.path.commonprefix([low.encode(), high.encode()])) for low, high in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(skip, pa.int32())], ["lang", "source", "skip"])

    return ends.select(*GROUP, "low", "high").mapInArrow(run, "lang string, source string, skip int")


def source_divergence(docs: DataFrame, least_docs: int = 10, most_terms: int = 10) -> DataFrame:
    """Audits docs(lang, source, text): each language keeps the terms in at least `least_docs` of its rows.

    Returns lang, source, part, item, value, rank. Part `pair`: item is each other source of the language, value the
    divergence over all kept terms. Part `term`: item is one of the `most_terms` kept terms by which the source most
    exceeds its language, value its part of the divergence. Ranks are from 1 per group and part, by value descending,
    then by the bytes of item. Null lang, source and text count as ''; a repeated row counts each time; a language without
    kept terms has pairs of value 0; a source alone in its language has none; other columns are not looked at; an empty
    table gives no row.
    """
    counts = written(counted(docs), "term-counts")
    kept = counts.filter("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("there")).filter(F.col("there") >= least_docs).select("lang", "term", "lang_n")
    found = written(counts.filter("term is not null").join(kept, ["lang", "term"]).select(*GROUP, "term", "n", "lang_n"), "kept-terms")
    by_lang = found.groupBy("lang", "term").agg(F.first("lang_n").alias("lang_n")).groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"))
    totals = found.groupBy(*GROUP).agg(F.sum("n").alias("total"))
    every = counts.filter("term is null").select(*GROUP).join(totals, GROUP, "left").join(by_lang, "lang", "left")
    every = every.select(*GROUP, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "terms", "lang_total")])
    groups = written(every.withColumn("absent", share(F.lit(0), F.col("total"), F.col("terms"))), "groups")
    shares = found.join(groups, GROUP).withColumn("p", share(F.col("n"), F.col("total"), F.col("terms"))).withColumn("q", share(F.col("lang_n"), F.col("lang_total"), F.col("terms")))
    rows = written(shares.select(*GROUP, "term", "p", "q", "absent"), "shares")
    rated = rows.filter("p > q").select(*GROUP, "term", apart(F.col("p"), F.col("q")).alias("value"))
    pairs = divergences(groups, rows).select(*GROUP, F.lit("pair").alias("part"), "item", "value")
    terms = top_terms(rated, most_terms).select(*GROUP, F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    discard(counts, found)
    rank = F.row_number().over(Window.partitionBy(*GROUP, "part").orderBy(F.col("value").desc(), "item"))
    return pairs.unionByName(terms).withColumn("rank", rank)

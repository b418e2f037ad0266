"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every shingle hash below a fixed fraction of the hash range, so sketches of any two texts can be merged
or intersected, however unequal their lengths. The fraction steps down by halves with the number of shingles, to 1/16 for
the longest texts: a short text keeps all its hashes, and a sketch says which fraction it holds. Two sketches are
compared, or merged, in the part of the range that both hold in full, the smaller fraction of the two. All is done with
DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import let, text_or_empty, words

SHINGLE = 5
#: Texts of up to KEPT distinct shingles keep all hashes, of twice as many one in two, and so on to one in 2^COARSEST.
KEPT, COARSEST = 256, 4


def shingle_hashes(word_array: Column, size: int = SHINGLE) -> Column:
    """63-bit hashes of the windows of `size` words; of fewer words, one hash of them all; of none, none."""

    def windows(h: Column) -> Column:
        last = F.greatest(F.size(h) - size, F.lit(0))
        return F.when(F.size(h) > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.shiftrightunsigned(F.xxhash64(F.slice(h, i + 1, size)), 1))).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(word_array, lambda w: F.xxhash64(w)), windows)


def level(hashes: Column) -> Column:
    """How often the fraction is halved for a text of these distinct hashes."""
    n = F.size(hashes)
    return sum((F.when(n > KEPT << k, 1).otherwise(0) for k in range(COARSEST)), F.lit(0))


def under(hashes: Column, at: Column) -> Column:
    """The hashes in the lowest 1 / 2^at of the range."""
    threshold = F.call_function("shiftright", F.lit((1 << 63) - 1), at)
    return F.filter(hashes, lambda x: x <= threshold)


def sketch(hashes: Column) -> Column:
    """(level, hashes): of distinct hashes those in the fraction that their number asks for, sorted."""
    return F.struct(level(hashes).alias("level"), F.array_sort(under(hashes, level(hashes))).alias("hashes"))


def as_text(found: Column) -> Column:
    """A sketch as its level, a colon and 16 hex digits a hash."""
    return F.concat(found["level"].cast("string"), F.lit(":"), F.array_join(F.transform(found["hashes"], lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), ""))


def distinct_shingles(text: Column, size: int = SHINGLE) -> Column:
    return F.array_distinct(shingle_hashes(words(text), size))


def containment(a: Column, b: Column) -> Column:
    """Of the smaller set of distinct hashes in the larger, 0 to 1; of two empty ones 1, of an empty and another 0."""
    least = F.least(F.size(a), F.size(b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when(least == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / least)


def common(a: Column, b: Column) -> tuple[Column, Column]:
    """The hashes of two sketches in the part of the range that both hold in full."""
    coarser = F.greatest(a["level"], b["level"])
    return under(a["hashes"], coarser), under(b["hashes"], coarser)


def likeness(a: Column, b: Column) -> Column:
    """The containment of the text with fewer shingles in the other, estimated from two sketches: 0 to 1. Exact where both
    hold all hashes; 0 where one has no hash in the part that both hold, unless neither text has any at all."""
    x, y = common(a, b)
    return containment(x, y) * F.when((F.size(x) == 0) & (F.size(y) == 0) & (F.size(a["hashes"]) + F.size(b["hashes"]) > 0), 0.0).otherwise(1.0)


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id and fingerprint (a sketch: level, hashes) of each row of docs(doc_id, text); a null text counts as empty."""
    return docs.select("doc_id", distinct_shingles(text_or_empty(), size).alias("all")).select("doc_id", sketch(F.col("all")).alias("fingerprint"))


def merged(parts: DataFrame, key: str) -> DataFrame:
    """(key, fingerprint) from the sketches of its parts: all their hashes in the smallest fraction of a part, which is the
    sketch at that fraction of their shingles together. Hashes are made distinct before they meet."""
    coarsest = parts.groupBy(key).agg(F.max("fingerprint.level").alias("level"))
    rows = parts.select(key, F.explode_outer("fingerprint.hashes").alias("hash")).distinct()
    met = rows.groupBy(key).agg(F.array_sort(F.collect_list("hash")).alias("hashes")).withColumnRenamed(key, "of")
    found = coarsest.join(met, coarsest[key].eqNullSafe(met["of"]))
    return found.select(key, F.struct("level", under(F.col("hashes"), F.col("level")).alias("hashes")).alias("fingerprint"))


def _range_of(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most value: a binary search."""
    if not bounds:
        return F.lit(0)
    known = F.array(*[F.lit(b).cast("long") for b in bounds])
    steps = [1 << k for k in range(len(bounds).bit_length() - 1, -1, -1)]
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda at, s: at + F.when(F.coalesce(F.get(known, at + s - 1) <= value, F.lit(False)), s).otherwise(0))


def with_next(docs: DataFrame, *carried: str, per_range: int = 2000) -> DataFrame:
    """docs(doc_id, ...) with next_<c> for each carried column: its value in the row that follows by descending doc_id;
    the first follows the last. Null ids come last, ties go by the carried columns; one row alone follows itself.

    Rows are dealt by ranges of doc_id of about `per_range` rows (at most 16,384 ranges, larger ones beyond), whose
    bounds are quantiles.
    The first row of a range also goes to the range before it, so that one shuffle of the rows is enough.
    """
    docs = docs.select(F.col("doc_id").cast("long"), *carried)
    ranges = max(1, min(16_384, docs.select("doc_id").count() // per_range))
    found = docs.stat.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 1 / (4 * ranges)) if ranges > 1 else []
    place = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(_range_of(F.col("doc_id"), sorted({int(x) for x in found})))
    rows = docs.withColumn("place", place)
    tops = dict(rows.groupBy("place").agg(F.max("doc_id")).collect())  # a row per range
    order = sorted(tops, reverse=True)
    if not order:
        return docs.withColumns({f"next_{c}": F.lit(None).cast(docs.schema[c].dataType) for c in carried})
    first = F.create_map(*[x for p in order for x in (F.lit(p), F.lit(tops[p]).cast("long"))])
    before = F.create_map(*[x for k, p in enumerate(order) for x in (F.lit(p), F.lit(order[k - 1]))])
    again = rows.filter(F.element_at(first, F.col("place")).eqNullSafe(F.col("doc_id"))).withColumns({"place": F.element_at(before, F.col("place")), "again": F.lit(True)})
    both = rows.withColumn("again", F.lit(False)).unionByName(again)
    by = Window.partitionBy("place").orderBy("again", F.col("doc_id").desc_nulls_last(), *carried)
    return both.withColumns({f"next_{c}": F.lead(c).over(by) for c in carried}).filter(~F.col("again")).drop("place", "again")


def edited_fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """Fingerprints each row of docs(doc_id, text) and its edit, whose second half comes from the next document.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, a row per input
    row; near_* are containments estimated from the sketches (see likeness). A null text counts as empty, which has an
    empty fingerprint; of fewer than `size` words the sequence of all is the one shingle; repeated rows follow one
    another; other columns are not looked at; an empty table gives no row.
    """
    base = docs.select("doc_id", text_or_empty().alias("text"))
    met = with_next(base, "text").withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substr("next_text", F.lit(1), half))
    texts = {"own": F.col("text"), "changed": F.col("edited"), "after": F.col("next_text")}
    done = met.withColumn("edited", edited)
    # columns of their own, not one lambda: Catalyst compiles sets of hashes only outside lambdas, and they box else
    done = done.withColumns({c: distinct_shingles(t, size) for c, t in texts.items()})
    done = done.select("doc_id", "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"), *[sketch(F.col(c)).alias(c) for c in texts])
    return done.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("own")).alias("fingerprint"), as_text(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("after")).alias("near_next"),
    )

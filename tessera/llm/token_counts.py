"""Token counts without ids: the pieces of each distinct pre-token are counted once and joined to how often each
document has it.

A pre-token is encoded on its own, so a text's count is the sum over its pre-tokens. The join has two parts. Pre-tokens
that the corpus has most often, at most `broadcast_entries` of at most `broadcast_bytes` each, go to every task as a
table of that proven size; they are nearly all occurrences. The others, each of them rare, meet their counts in a
shuffle join, where a document adds only its few such rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import tokenizer
from tessera.llm.common import written

#: Distinct pre-tokens that a task holds before it passes its counts on.
HELD = 400_000


@lru_cache(maxsize=1)
def _splitter():
    import regex

    return regex.compile(tokenizer.SPLIT).findall


def pre_tokens(text: str) -> list[str]:
    """The pieces that no merge crosses; the special token's string is one of them."""
    find = _splitter()
    if tokenizer.END_OF_TEXT not in text:
        return find(text)
    first, *rest = text.split(tokenizer.END_OF_TEXT)
    out = find(first)
    for part in rest:
        out.append(tokenizer.END_OF_TEXT)
        out += find(part)
    return out


def _pairs(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["token", "n"])


def frequencies(docs: DataFrame) -> DataFrame:
    """(token, n): how often the corpus has each pre-token."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                counts.update(pre_tokens(text.as_py() or ""))
                if len(counts) > HELD:
                    yield _pairs(counts)
                    counts = Counter()
        yield _pairs(counts)

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


def count_pieces(distinct: DataFrame, vocabulary: str) -> DataFrame:
    """(token, n, pieces): each distinct pre-token is encoded here, once."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        encoding = tokenizer.byte_bpe(vocabulary)
        for batch in batches:
            pieces = [len(tokenizer.encode(encoding, t)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pieces, pa.int32())], ["token", "n", "pieces"])

    return distinct.select("token", "n").mapInArrow(run, "token string, n long, pieces int")


def most_frequent(counted: DataFrame, entries: int, longest: int) -> DataFrame:
    """The rows of at least the count that no more than `entries` rows of at most `longest` bytes have; found from a
    histogram of at most 512 steps, an eighth of a doubling each."""
    step = F.floor(F.log2("n") * 8)
    short = counted.filter(F.octet_length("token") <= longest)
    room, lowest = entries, None
    for row in sorted(short.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):
        room -= row["count"]
        if room < 0:
            break
        lowest = row["step"]
    return short.filter(step >= lowest) if lowest is not None else short.limit(0)


def token_counts(docs: DataFrame, limit: int = 512, vocabulary: str | None = None, broadcast_entries: int = 131_072, broadcast_bytes: int = 64) -> DataFrame:
    """Counts the tokens of each row of docs(doc_id, text).

    Returns doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit), a row per input row. A null text counts as empty:
    0 bytes, 0 tokens. Repeated rows and null ids keep a row each. A very long pre-token is encoded like any other.
    Other columns of docs are not looked at; an empty table gives no row.
    """
    vocabulary = vocabulary or tokenizer.vocabulary()
    counted = written(count_pieces(frequencies(docs), vocabulary), "pre-tokens")
    frequent = most_frequent(counted, broadcast_entries, broadcast_bytes).select("token", "pieces").toArrow()
    known = docs.sparkSession.sparkContext.broadcast(dict(zip(frequent["token"].to_pylist(), frequent["pieces"].to_pylist(), strict=True)))

    def run(batches) -> Iterator[pa.RecordBatch]:
        pieces, row = known.value.get, TaskContext.get().partitionId() << 40
        for batch in batches:
            rows, ids, sizes, sums = [], [], [], []
            rare_rows, rare_tokens, rare_n = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text, total, row = text.as_py() or "", 0, row + 1
                for token, n in Counter(pre_tokens(text)).items():
                    if (k := pieces(token)) is not None:
                        total += n * k
                    else:
                        rare_rows.append(row)
                        rare_tokens.append(token)
                        rare_n.append(n)
                rows.append(row)
                ids.append(doc_id)
                sizes.append(len(text.encode()))
                sums.append(total)
            none = [None] * len(rare_rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows + rare_rows, pa.int64()), pa.array(ids + none, pa.int64()), pa.array(sizes + none, pa.int64()), pa.array(sums + none, pa.int64()), pa.array([None] * len(rows) + rare_tokens, pa.string()), pa.array([None] * len(rows) + rare_n, pa.int64())],
                ["row", "doc_id", "n_bytes", "n_tokens", "token", "n"],
            )

    parts = written(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "row long, doc_id long, n_bytes long, n_tokens long, token string, n long"), "document-pre-tokens")
    rare = parts.filter("token is not null").select("row", "token", "n").join(counted.select("token", "pieces"), "token")
    sums = parts.filter("token is null").select("row", "doc_id", "n_bytes", "n_tokens").unionByName(rare.select("row", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("n_bytes"), (F.col("n") * F.col("pieces")).alias("n_tokens")))
    whole = sums.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("n_tokens").alias("n_tokens"))
    return whole.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

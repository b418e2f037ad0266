"""Toxicity scores from a weighted lexicon, matched by an Aho-Corasick automaton over folded text.

Folding lower-cases, strips accents, turns look-alike letters of other scripts into Latin ones and digits into the
letters they stand for. The lexicon is learned from labelled rows: words, and beginnings of words, that toxic documents
have much more often than others; of those only as many as are needed to cover the toxic documents, so that words that
merely stand beside a toxic one stay out. Hits inside exception phrases do not count. The weight of a document's hits,
as it is and per word, enters a logistic model fitted on the same rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import text_or_empty, written

# Letters of Cyrillic and Greek that look like Latin ones, and signs that stand for letters.
LOOK_ALIKE = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ѡ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ɑ": "a", "ɡ": "g", "ʟ": "l", "ѵ": "v", "ӏ": "l",
}
STANDS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "€": "e"}
#: Phrases in which a word of the lexicon is no insult.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "rodeo clown", "circus clown", "sore loser", "pond scum", "idiot proof")

TABLE = str.maketrans(LOOK_ALIKE | STANDS_FOR)
LETTERS = re.compile(r"[^\W\d_]+")
EDGE = "\x01"
PREFIXES = (4, 5, 6, 7, 8)
#: A beginning of words counts in a text that has it this often, and in this share of its words, at least.
LEAST_TIMES, LEAST_SHARE = 2, 0.01


def folded_words(text: str) -> list[str]:
    low = text.lower()
    if not low.isascii():
        low = "".join(c for c in unicodedata.normalize("NFKD", low) if not unicodedata.combining(c))
    return LETTERS.findall(low.translate(TABLE))


def dense(times: int, n_words: int) -> bool:
    return times >= LEAST_TIMES and times >= LEAST_SHARE * n_words


def features(words: list[str]) -> set[str]:
    """Patterns that a text has: each word between edges, and after an edge the beginnings of words that are dense."""
    counts = Counter(words)
    out = {f"{EDGE}{w}{EDGE}" for w in counts}
    for n in PREFIXES:
        starts: Counter = Counter()
        for w, times in counts.items():
            if len(w) >= n:
                starts[w[:n]] += times
        out |= {EDGE + start for start, times in starts.items() if dense(times, len(words))}
    return out


@dataclass(frozen=True)
class Model:
    """weights: by pattern. exceptions: folded phrases. beta: of 1, the summed weight (log), and the weight per word."""

    weights: dict[str, float]
    exceptions: tuple[str, ...]
    beta: tuple[float, float, float]


def automaton(patterns: dict[str, float]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for pattern, weight in patterns.items():
        found.add_word(pattern, (pattern, weight))
    if patterns:
        found.make_automaton()
    return found


def hit_weight(words: list[str], lexicon, exceptions) -> float:
    """The sum over words of the greatest weight of a pattern there; words inside an exception phrase weigh nothing, nor
    do beginnings of words that are not dense in the text."""
    line = EDGE + EDGE.join(words) + EDGE
    places: dict[str, list[int]] = {}
    weights: dict[str, float] = {}
    for end, (pattern, weight) in lexicon.iter(line) if len(lexicon) else ():
        places.setdefault(pattern, []).append(end - len(pattern) + 1)  # of the edge before the word
        weights[pattern] = weight
    if places and len(exceptions):
        begins, ends = [], []  # of stretches of exception phrases, in order
        for begin, end in sorted((end - len(phrase) + 1, end) for end, (phrase, _) in exceptions.iter(line)):
            if ends and begin < ends[-1]:
                ends[-1] = max(ends[-1], end)
            else:
                begins.append(begin)
                ends.append(end)
        outside = lambda s: (k := bisect_right(begins, s)) == 0 or s >= ends[k - 1]
        for pattern, starts in places.items():
            places[pattern] = [s for s in starts if outside(s)]
    best: dict[int, float] = {}
    for pattern, starts in places.items():
        if pattern.endswith(EDGE) or dense(len(starts), len(words)):
            for start in starts:
                best[start] = max(best.get(start, 0.0), weights[pattern])
    return sum(best.values())


def _inputs(weight: float, n_words: int) -> tuple[float, float, float]:
    return 1.0, math.log1p(weight), min(weight / max(n_words, 1), 1.0)


def _phrases(exceptions: tuple[str, ...]) -> dict[str, float]:
    return {EDGE + EDGE.join(folded_words(p)) + EDGE: 0.0 for p in exceptions}


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> tuple[float, ...]:
    """Newton's method with a ridge."""
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1]), x.T @ (y - p) - ridge * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(b) for b in beta)


def train(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000, most_entries: int = 2_000, least_docs: int = 4, least_weight: float = 2.5, common_share: float = 0.02, common_weight: float = 4.0, exceptions: tuple[str, ...] = EXCEPTIONS) -> Model:
    """Learns from labels(doc_id, toxic), of which the `most_rows` with the least hash of doc_id are taken, and their
    docs(doc_id, text). least_docs, least_weight: toxic documents that have a pattern, and its log-odds, at least. A
    pattern of common_weight that this share of the toxic documents has is taken whether others cover them or not."""
    sample = labels.filter("doc_id is not null and toxic is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(most_rows)
    rows = written(docs.select(F.col("doc_id"), text_or_empty().alias("text")).join(F.broadcast(sample), "doc_id").select("text", "toxic").distinct(), "toxicity-sample")

    def count(batches) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                seen[toxic > 0].update(features(folded_words(text.as_py())))
        for toxic in (0, 1):
            yield pa.RecordBatch.from_arrays([pa.array(seen[toxic].keys(), pa.string()), pa.array([toxic] * len(seen[toxic]), pa.int32()), pa.array(seen[toxic].values(), pa.int64())], ["pattern", "toxic", "n"])

    sizes = {r["toxic"] > 0: r["count"] for r in rows.groupBy("toxic").count().collect()}
    bad, good = sizes.get(True, 0), sizes.get(False, 0)
    counts = rows.mapInArrow(count, "pattern string, toxic int, n long").groupBy("pattern").agg(F.sum(F.when(F.col("toxic") > 0, F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("toxic") > 0, 0).otherwise(F.col("n"))).alias("good"))
    weight = F.log((F.col("bad") + 0.5) / (bad + 1.0)) - F.log((F.col("good") + 0.5) / (good + 1.0))
    strong = counts.withColumn("weight", weight).filter((F.col("bad") >= least_docs) & (F.col("weight") >= least_weight))
    found = {r["pattern"]: r["weight"] for r in strong.collect()}  # most_rows bounds them

    def matched(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [sorted(features(folded_words(t.as_py())) & found.keys()) for t, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True) if toxic > 0]
            yield pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.string()))], ["patterns"])

    covered = [set(r["patterns"]) for r in rows.mapInArrow(matched, "patterns array<string>").collect()]
    often = Counter(p for d in covered for p in d)
    common = [p for p in found if often[p] >= max(least_docs, common_share * bad) and found[p] >= common_weight]
    weights = {p: found[p] for p in cover(covered, found, most_entries, least_docs, common)}
    lexicon, benign = weights, _phrases(exceptions)

    def measure(batches) -> Iterator[pa.RecordBatch]:
        a, b = automaton(lexicon), automaton(benign)
        for batch in batches:
            x = [_inputs(hit_weight(w, a, b), len(w)) for w in (folded_words(t.as_py()) for t in batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array([v[1] for v in x], pa.float64()), pa.array([v[2] for v in x], pa.float64()), batch.column(1)], ["log_weight", "density", "toxic"])

    table = rows.mapInArrow(measure, "log_weight double, density double, toxic int").toPandas()
    table = table.sort_values(["toxic", "log_weight", "density"])  # sums don't depend on the tasks' order
    x = np.column_stack([np.ones(len(table)), table["log_weight"], table["density"]])
    return Model(weights, exceptions, fit_logistic(x, (table["toxic"] > 0).to_numpy(float)))


def cover(documents: list[set[str]], weights: dict[str, float], most: int, least: int, taken: list[str] = ()) -> list[str]:
    """Patterns, each the one that covers most of the documents left; ties go to the greater weight, then by name. Ends
    when none covers `least` of them. Those of `taken` come in any case, but for beginnings within one another, of which
    the first by count and weight stays."""
    often = Counter(p for d in documents for p in d)
    rank = lambda p: (-often[p] * weights[p], -weights[p], p)
    chosen: list[str] = []
    for p in sorted(taken, key=rank)[:most]:
        if p.endswith(EDGE) or not any(p.startswith(q) or q.startswith(p) for q in chosen if not q.endswith(EDGE)):
            chosen.append(p)
    left = [d for d in documents if not d.intersection(chosen)]
    while len(chosen) < most:
        counts = Counter(p for d in left for p in d)
        best = max(counts, key=lambda p: (counts[p] * weights[p], weights[p], p), default=None)
        if best is None or counts[best] < least:
            break
        chosen.append(best)
        left = [d for d in left if best not in d]
    return chosen


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """Scores each row of docs(doc_id, text): doc_id, score (0 to 1), predicted (1 if score >= 0.5, else 0), hits (the
    summed weight). A null text counts as empty and has no hits; repeated rows and null ids keep a row each; other
    columns are not looked at; an empty table gives no row. A text is read as a whole, whatever its length."""
    weights, phrases, beta = model.weights, _phrases(model.exceptions), model.beta

    def run(batches) -> Iterator[pa.RecordBatch]:
        a, b = automaton(weights), automaton(phrases)
        for batch in batches:
            hits, scores = [], []
            for text in batch.column(1):
                words = folded_words(text.as_py())
                hits.append(hit_weight(words, a, b))
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, sum(u * v for u, v in zip(beta, _inputs(hits[-1], len(words)), strict=True)))))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(hits, pa.float64())], ["doc_id", "score", "predicted", "hits"])

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, predicted int, hits double")


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that toxicity doesn't predict toxic, with all their columns, whatever their names. A null text
    counts as empty; repeated rows and null ids are judged a row each; an empty table gives no row."""
    weights, phrases, beta = model.weights, _phrases(model.exceptions), model.beta
    at = docs.columns.index("text")

    def run(batches) -> Iterator[pa.RecordBatch]:
        a, b = automaton(weights), automaton(phrases)
        for batch in batches:
            keep = []
            for text in batch.column(at):
                words = folded_words(text.as_py() or "")
                z = sum(u * v for u, v in zip(beta, _inputs(hit_weight(words, a, b), len(words)), strict=True))
                keep.append(z < 0)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

"""Quality rules: repeats and symbols per document, and how far its characters and common words lie from its language.

A language reference is two histograms over all documents of a `lang`: character classes, and common words, which are
those that make up at least `share` of the language's words (so there are at most 1 / share of them). A document is
compared with each reference by the Jensen-Shannon distance, base 2, and its nearest reference counts. The language it
is labelled with only says whether words tell anything: where that has no reference with common words (too few
documents, or a script without spaces), those of other languages don't count against it. Everything is DataFrame
functions on the columns of the row itself; the references are the only aggregates. The driver holds those of
`most_languages` languages at a time, of a size that `share` bounds; where there are more languages, the measured rows
meet them in rounds, all of them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import batched

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, let, text_or_empty, written

WINDOW = 8
CLASSES = ("upper", "digit", "symbol", "mark", "space", "other")


@dataclass(frozen=True)
class Rules:
    """min_words, max_repeat_percent: the base rule. class_words, word_words: fewer words than that, and the distance
    of character classes, or of common words, does not count. class_distance, word_distance: more than that fails.
    share: what part of a language's words a reference word makes up at least. least_documents: of how many documents a
    reference is built at least, whatever other languages there are. most_languages: the languages whose references a
    round compares; every language of enough documents gets its round."""

    min_words: int = 20
    max_repeat_percent: int = 30
    class_words: int = 40
    word_words: int = 60
    class_distance: float = 0.25
    word_distance: float = 0.32
    share: float = 0.005
    least_documents: int = 10
    most_languages: int = 100


@dataclass(frozen=True)
class Reference:
    lang: str | None
    classes: list[float]
    words: list[str]
    shares: list[float]


def split_words(text: Column) -> Column:
    """common.words, by one split at single spaces."""
    return F.array_remove(F.split(F.regexp_replace(text, r"[\x09-\x0D]", " "), " "), "")


def repeated_words(word_array: Column) -> Column:
    """How many words lie in windows of eight that the text has twice or more.

    Windows are compared by a 64-bit hash of their words' hashes. Only texts with a repeated window pay for sorting.
    """
    hashes = F.transform(word_array, lambda w: F.xxhash64(w))

    def windows(h: Column) -> Column:
        last = F.size(h) - WINDOW
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(F.slice(h, i + 1, WINDOW)))).otherwise(F.array().cast("array<bigint>"))

    def covered(starts: Column) -> Column:
        step = F.transform(starts, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, k + 1) - p, F.lit(WINDOW))))
        return F.aggregate(step, F.lit(0).cast("long"), lambda a, x: a + x)

    def repeats(ranked: Column) -> Column:
        same = lambda j, k: F.coalesce(F.get(ranked, j)["h"] == F.get(ranked, k)["h"], F.lit(False))
        starts = F.transform(F.filter(F.transform(ranked, lambda x, j: F.struct(x["i"].alias("i"), (same(j, j - 1) | same(j, j + 1)).alias("twice"))), lambda x: x["twice"]), lambda x: x["i"])
        return let(F.array_sort(starts), covered)

    def count(w: Column) -> Column:
        ranked = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(let(ranked, repeats))

    return let(let(hashes, windows), count)


def measured(docs: DataFrame, *carried: str) -> DataFrame:
    """Of docs(doc_id, lang, text) and the carried columns: the base measurements, `classes` (counts by CLASSES) and
    `low` (lower-case words)."""
    text = F.col("text")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    count = lambda source, drop: F.length(F.regexp_replace(source, drop, "")).cast("long")
    a = docs.withColumns({"word_array": split_words(text), "lines": lines, "odd": F.regexp_replace(text, r"[\p{Ll}\x20]+", "")})
    a = a.withColumn("pairs", let(F.transform("word_array", lambda w: F.xxhash64(w)), lambda h: F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + 1)))))
    fours = F.transform("pairs", lambda x, i: F.xxhash64(x, F.get("pairs", i + 2)))
    # a window of eight that comes twice has five windows of four that do
    may_repeat = F.size("word_array") - F.size(F.array_distinct(fours)) >= 5
    b = a.withColumns({
        "n_words": F.size("word_array").cast("long"),
        "word_chars": F.length(F.array_join("word_array", "")).cast("long"),
        "n_symbols": count(F.col("odd"), r"[^#*$%&|<>]+"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "n_repeat_words": F.when(may_repeat, repeated_words(F.col("word_array"))).otherwise(F.lit(0).cast("long")),
        "upper": count(F.col("odd"), r"\P{Lu}+"),
        "digit": count(F.col("odd"), r"\P{Nd}+"),
        "mark": count(F.col("odd"), r"[^.,;:!?'\"()\-]+"),
        "n_chars_here": F.length(text).cast("long"),
        "low": F.transform("word_array", lambda w: F.lower(w)),
    })
    space = F.col("n_chars_here") - F.col("word_chars")
    seen = [F.col("upper"), F.col("digit"), F.col("n_symbols"), F.col("mark"), space]
    other = F.col("n_chars_here") - sum(seen, F.lit(0))
    return b.withColumn("classes", F.array(*seen, other)).select("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars_here", "classes", "low", *carried)


def _of(lang: str | None) -> Column:
    return F.col("lang").eqNullSafe(F.lit(lang).cast("string"))


def _among(langs: list[str | None]) -> Column:
    return F.when(F.col("lang").isNull(), F.lit(None in langs)).otherwise(F.col("lang").isin([x for x in langs if x is not None]))


def languages(docs: DataFrame, rules: Rules) -> DataFrame:
    """(lang, name, docs): the languages of at least `rules.least_documents` documents that have words; name is never null."""
    found = docs.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]")).groupBy("lang").agg(F.count(F.lit(1)).alias("docs"))
    return found.filter(F.col("docs") >= rules.least_documents).withColumn("name", F.coalesce(F.concat(F.lit("1"), "lang"), F.lit("0")))


def _rounds(every: DataFrame, rules: Rules) -> Iterator[list[str | None]]:
    """The languages, those of most documents first, as many at a time as the driver may hold."""
    rest = every
    while found := rest.orderBy(F.desc("docs"), "name").limit(rules.most_languages).collect():
        yield [r["lang"] for r in found]
        docs, name = found[-1]["docs"], found[-1]["name"]
        rest = every.filter((F.col("docs") < docs) | ((F.col("docs") == docs) & (F.col("name") > name)))


def counted_words(docs: DataFrame, every: DataFrame) -> DataFrame:
    """(lang, word, count) over the documents of the languages in `every`."""
    named = docs.withColumn("name", F.coalesce(F.concat(F.lit("1"), "lang"), F.lit("0"))).join(every.select("name"), "name", "left_semi")
    return named.select("lang", F.explode(split_words(F.lower("text"))).alias("word")).groupBy("lang", "word").count()


def common_words(word_counts: DataFrame, langs: list[str | None], rules: Rules) -> dict[str | None, list[tuple[str, float]]]:
    """The words of each of langs that make up at least `rules.share` of its words, and their shares."""
    counts = word_counts.filter(_among(langs))
    totals = {r["lang"]: r["words"] for r in counts.groupBy("lang").agg(F.sum("count").alias("words")).collect()}
    total = F.coalesce(F.lit(None).cast("long"), *[F.when(_of(lang), F.lit(n).cast("long")) for lang, n in totals.items()])
    rows = counts.withColumn("share", F.col("count") / total).filter(F.col("count") >= rules.share * total).collect()  # at most 1 / share a language
    out: dict = {lang: [] for lang in langs}
    for x in rows:
        out[x["lang"]].append((x["word"], x["share"]))
    return {lang: sorted(top, key=lambda x: (-x[1], x[0])) for lang, top in out.items()}


def known_of(found: DataFrame, top: dict[str | None, list[tuple[str, float]]]) -> list[Reference]:
    """The references of the languages in `top`, of measured rows and the languages' common words."""
    mine = found.filter(_among(list(top)) & (F.col("n_words") > 0))
    shares = mine.groupBy("lang").agg(*[F.avg(F.col("classes")[k] / F.col("n_chars_here")).alias(c) for k, c in enumerate(CLASSES[:-1])])
    out = []
    for r in sorted(shares.collect(), key=lambda r: (r["lang"] is None, r["lang"])):
        classes, words = [r[c] for c in CLASSES[:-1]], top[r["lang"]]
        out.append(Reference(r["lang"], [*classes, 1 - sum(classes)], [w for w, _ in words], [s for _, s in words]))
    return out


def references(docs: DataFrame, rules: Rules) -> list[Reference]:
    """One per language of at least `rules.least_documents` documents that have words, from all of them."""
    every = written(languages(docs, rules), "quality-languages")
    word_counts = written(counted_words(docs, every), "quality-words")
    found = measured(docs.withColumn("doc_id", F.lit(0)))
    out = [r for langs in _rounds(every, rules) for r in known_of(found, common_words(word_counts, langs, rules))]
    discard(every, word_counts)
    return out


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon, base 2, of two arrays of shares."""
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    terms = F.zip_with(p, q, lambda x, y: part(x, (x + y) / 2) + part(y, (x + y) / 2))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2))


def _literal(values, kind: str) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>")


def _with_counts(found: DataFrame, every: Iterable[str]) -> DataFrame:
    """found with `counts`: how often the row has each word of `every` that it has."""
    every = sorted(set(every))
    hits = F.array_sort(F.filter("low", lambda w: w.isin(every))) if every else F.array().cast("array<string>")
    a = found.withColumn("hits", hits).withColumn("distinct_hits", F.array_distinct("hits"))
    starts = F.transform("distinct_hits", lambda w: F.array_position("hits", w))
    ends = lambda s: F.transform(s, lambda p, k: F.coalesce(F.get(s, k + 1), F.size("hits") + F.lit(1)) - p)
    return a.withColumn("counts", F.map_from_arrays("distinct_hits", let(starts, ends))).drop("hits", "distinct_hits")


#: What the rounds of references leave on a row: the least distances so far, and whether its language has a reference
#: with words.
NEAREST = ("class_distance", "nearest_words", "told")


def _unmet(found: DataFrame) -> DataFrame:
    return found.withColumns({"class_distance": F.lit(None).cast("double"), "nearest_words": F.lit(None).cast("double"), "told": F.lit(False)})


def _nearer(found: DataFrame, known: list[Reference]) -> DataFrame:
    """found, which has the `counts` of known's words, with NEAREST brought to what known says too."""
    if not known:
        return found
    b = found.withColumn("class_shares", F.transform("classes", lambda c: c / F.greatest(F.col("n_chars_here"), F.lit(1))))
    by_class = [distance(F.col("class_shares"), _literal(r.classes, "double")) for r in known]
    by_word = []
    for r in known:
        if r.words:
            mine = F.transform(_literal(r.words, "string"), lambda w: F.coalesce(F.element_at("counts", w), F.lit(0)) / F.greatest(F.col("n_words"), F.lit(1)))
            whole = let(mine, lambda p: F.concat(p, F.array(F.lit(1.0) - F.aggregate(p, F.lit(0.0), lambda x, y: x + y))))
            by_word.append(distance(whole, _literal([*r.shares, 1 - sum(r.shares)], "double")))
    told = F.col("told") | _among([r.lang for r in known if r.words])
    return b.withColumns({"class_distance": F.least("class_distance", *by_class), "nearest_words": F.least("nearest_words", *by_word) if by_word else F.col("nearest_words"), "told": told}).drop("class_shares")


def _met(found: DataFrame) -> DataFrame:
    return found.withColumn("word_distance", F.when(F.col("told"), F.col("nearest_words")))


def distances(found: DataFrame, known: list[Reference], rules: Rules) -> DataFrame:
    """found with class_distance and word_distance: the least over the references; null where there is none. A document
    has a word_distance only if its own language has a reference with words."""
    found, last = _unmet(found), None
    for k, some in enumerate(batched(known, rules.most_languages)):
        if k:
            met = written(found.drop("counts"), "quality-measured")
            if last is not None:
                discard(last)
            found = last = met
        found = _nearer(_with_counts(found, [w for r in some for w in r.words]), list(some))
    return _met(found)


def compared(base: DataFrame, rules: Rules, *carried: str) -> DataFrame:
    """distances() of the rows of base and the references that they make. Texts are read twice, once to count words and
    once to measure rows; classes are averaged over the measured rows."""
    every = written(languages(base, rules), "quality-languages")
    word_counts = written(counted_words(base, every), "quality-words")
    rounds = _rounds(every, rules)
    found, langs = _unmet(measured(base, *carried)), next(rounds, [])
    while True:
        following = next(rounds, None)
        top = common_words(word_counts, langs, rules) if langs else {}
        counted = _with_counts(found, [w for words in top.values() for w, _ in words])
        rows = written(counted if following else counted.drop("low"), "quality-measured")
        if hasattr(found, "written_to"):
            discard(found)
        found = _nearer(rows, known_of(rows, top) if top else [])
        if not following:
            discard(every, word_counts)
            return _met(found)
        found, langs = written(found.drop("counts"), "quality-measured"), following
        discard(rows)


def quality_rules(docs: DataFrame, rules: Rules = Rules(), known: list[Reference] | None = None) -> DataFrame:
    """Measures each row of docs(doc_id, lang, text) and says whether to keep it.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, class_distance,
    word_distance, a row per input row. A null text counts as empty, has no words and fails the base rule; a null lang
    is a language of its own among the references; repeated rows are measured as often as they come; other columns
    are not looked at; an empty table gives no row, and without a reference only the base rule decides; word_distance is
    null, and decides nothing, where the row's lang has no reference with words. `known` gives
    references of an earlier run.
    """
    return judged(_inputs(docs), rules, known).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance")


def kept_documents(docs: DataFrame, rules: Rules = Rules(), known: list[Reference] | None = None) -> DataFrame:
    """The rows of docs that quality_rules keeps, with all their columns, whatever their names; no join, a row carries
    its own. Null texts go, as they fail the base rule; repeated rows are judged a row each; an empty table gives no
    row."""
    whole = _inputs(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole_row"))
    # not a filter: Catalyst would move it below and copy what "kept" is computed from into it, many times over
    kept = judged(whole, rules, known, "whole_row").select(F.explode(F.when(F.col("kept"), F.array("whole_row"))).alias("whole_row"))
    return kept.select(*[F.col("whole_row").getField(c).alias(c) for c in docs.columns])


def _inputs(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), text_or_empty().cast("string").alias("text"), *more)


def judged(base: DataFrame, rules: Rules, known: list[Reference] | None, *carried: str) -> DataFrame:
    found = compared(base, rules, *carried) if known is None else distances(measured(base, *carried), known, rules)
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    odd_classes = (F.col("n_words") >= rules.class_words) & (F.col("class_distance") > rules.class_distance)
    odd_words = (F.col("n_words") >= rules.word_words) & (F.col("word_distance") > rules.word_distance)
    kept = ~failed & ~F.coalesce(odd_classes, F.lit(False)) & ~F.coalesce(odd_words, F.lit(False))
    return found.withColumns({"base_failed": failed, "kept": kept})

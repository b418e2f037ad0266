"""Secret scans with a trigram inverted index.

Each rule's regular expression yields a Boolean query over trigrams, by the calculus of code search: which trigrams
every match must hold. The index has, for each trigram that some query names, the documents whose folded text has it.
Posting lists are intersected per clause, and only the candidates' texts are scanned by that rule. A rule whose
expression has no mandatory trigram scans every text. All of it is DataFrame functions; the queries are derived on the
driver, from the rules alone.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import let, text_or_empty

#: Sets of strings larger than this, or sets with longer strings, are not kept exact.
MOST, LONGEST = 64, 24


@dataclass(frozen=True)
class Rule:
    """kind: the name in results. pattern: in the dialect that Java and Python share. group, least: matches whose group
    is shorter than `least` code points are dropped. any_case: letters match in either case."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    any_case: bool = False


#: The base kinds first, in the order in which they are listed at equal starts. access and hex repeat their class as
#: often as the least length asks: a run that is too short holds no later match, so the matches are the same.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=12, any_case=True),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + MORE

# ---- queries: None is "any text"; else a set of clauses (one must hold), each a set of trigrams (all must be there)

Query = frozenset | None


def _both(a: Query, b: Query) -> Query:
    if a is None or b is None:
        return b if a is None else a
    return _lean(frozenset(x | y for x in a for y in b))


def _either(a: Query, b: Query) -> Query:
    return None if a is None or b is None else _lean(a | b)


def _lean(clauses: frozenset) -> frozenset:
    """Without clauses that another one implies."""
    return frozenset(c for c in clauses if not any(d < c for d in clauses))


def _of_strings(strings: frozenset) -> Query:
    """One of these strings is there whole."""
    if not strings or min(map(len, strings)) < 3:
        return None
    return _lean(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings))


@dataclass(frozen=True)
class _Part:
    """exact: all strings that a part matches, if few; else prefix and suffix: the ends of a match are among these."""

    exact: frozenset | None
    prefix: frozenset
    suffix: frozenset
    query: Query = None


_ANY = _Part(None, frozenset({""}), frozenset({""}))


def _cut(p: _Part) -> _Part:
    """An exact set that has grown large turns into its trigrams and its ends."""
    if p.exact is not None and (len(p.exact) > MOST or max(map(len, p.exact), default=0) > LONGEST):
        return _Part(None, frozenset(s[:2] for s in p.exact), frozenset(s[-2:] for s in p.exact), _both(p.query, _of_strings(p.exact)))
    return p


def _then(a: _Part, b: _Part) -> _Part:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= 16 * MOST:
        return _cut(_Part(frozenset(x + y for x, y in product(a.exact, b.exact)), frozenset(), frozenset(), _both(a.query, b.query)))
    ends = lambda p, side: p.exact if p.exact is not None else side
    left, right = ends(a, a.suffix), ends(b, b.prefix)
    across = frozenset(x + y for x, y in product(left, right)) if len(left) * len(right) <= 16 * MOST else frozenset({""})
    query = _both(_both(a.query, b.query), _of_strings(across))
    keep = lambda strings: strings if len(strings) <= MOST else frozenset({""})
    prefix = frozenset(x + y for x, y in product(a.exact, b.prefix)) if a.exact is not None and b.exact is None else a.prefix
    suffix = frozenset(x + y for x, y in product(a.suffix, b.exact)) if b.exact is not None and a.exact is None else b.suffix
    if a.exact is not None and b.exact is not None:
        prefix, suffix = a.exact, b.exact
    whole = lambda p: _both(p.query, _of_strings(p.exact)) if p.exact is not None else p.query
    return _Part(None, keep(prefix), keep(suffix), _both(query, _both(whole(a), whole(b))))


def _or(a: _Part, b: _Part) -> _Part:
    if a.exact is not None and b.exact is not None:
        return _cut(_Part(a.exact | b.exact, frozenset(), frozenset(), _either(a.query, b.query) if a.query or b.query else None))
    whole = lambda p: _both(p.query, _of_strings(p.exact)) if p.exact is not None else p.query
    side = lambda p, x: p.exact if p.exact is not None else x
    return _Part(None, side(a, a.prefix) | side(b, b.prefix), side(a, a.suffix) | side(b, b.suffix), _either(whole(a), whole(b)))


def _class(items) -> frozenset | None:
    out: set[str] = set()
    for op, value in items:
        if op is sre.LITERAL:
            out.add(chr(value).lower())
        elif op is sre.RANGE and value[1] - value[0] < MOST:
            out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return frozenset(out) if len(out) <= 8 else None


def _walk(tree) -> _Part:
    done = _Part(frozenset({""}), frozenset(), frozenset())
    for op, value in tree:
        if op is sre.LITERAL:
            part = _Part(frozenset({chr(value).lower()}), frozenset(), frozenset())
        elif op is sre.IN and (strings := _class(value)):
            part = _Part(strings, frozenset(), frozenset())
        elif op is sre.SUBPATTERN:
            part = _walk(value[-1])
        elif op is sre.BRANCH:
            part = reduce(_or, map(_walk, value[1]))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, inner = value
            once = _walk(inner)
            if (low, high) == (0, 1) and once.exact is not None:
                part = _or(_Part(frozenset({""}), frozenset(), frozenset()), once)
            elif low == 0:
                part = _ANY
            else:
                part = reduce(_then, [once] * min(low, 4))
                if high != low or low > 4:
                    part = _then(part, _ANY)
        elif op is sre.AT:
            continue
        else:
            part = _ANY
        done = _then(done, part)
    return done


def trigram_query(rule: Rule) -> Query:
    """The clauses of lower-case trigrams of which every match has all of one; None: the rule has to scan fully."""
    found = _walk(sre_parser.parse(rule.pattern))
    return _both(found.query, _of_strings(found.exact)) if found.exact is not None else found.query


# ---- the index and its use


def postings(docs: DataFrame, trigrams: list[str] | None = None) -> DataFrame:
    """(trigram, doc_key): which of docs(doc_key, text) have which trigram of ASCII-folded text. `trigrams`: the lists
    to build, those that queries name; None builds every one."""
    inner = "|".join(re_quote(t) for t in sorted(trigrams)) if trigrams is not None else "(?s:.{3})"
    found = F.regexp_extract_all(F.lower("text"), F.lit(f"(?=({inner}))"), F.lit(1))
    return docs.select("doc_key", F.explode(F.array_distinct(found)).alias("trigram"))


def re_quote(text: str) -> str:
    """text as a literal of Java's regular expressions."""
    return "".join(c if c.isalnum() else f"\\x{{{ord(c):x}}}" for c in text)


def candidates(index: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """(doc_key, kinds): the rules whose query the document's postings satisfy. Posting lists are joined to the clauses
    that name their trigram, a few rows, and a document is in a clause's intersection if it is in as many lists as
    the clause has. Rows that share a doc_key are in a list once each, so such a document may be a candidate too many,
    which verifying shows, but never one too few."""
    clauses = [(kind, number, sorted(c)) for kind, q in queries.items() if q is not None for number, c in enumerate(sorted(q, key=sorted))]
    rows = [(t, f"{kind} {number}", kind, len(c)) for kind, number, c in clauses for t in c]
    spark = index.sparkSession
    wanted = spark.createDataFrame(rows, "trigram string, clause string, kind string, size long")
    hits = index.join(F.broadcast(wanted), "trigram").groupBy("doc_key", "clause", "kind", "size").count().filter("count >= size")
    return hits.groupBy("doc_key").agg(F.collect_set("kind").alias("kinds"))


#: Values of a running() block.
BLOCK = 256


def running(values: Column, join) -> Column:
    """The running sums, or with F.greatest the running maxima, of an array of ints. A fold copies its result at each
    value, so it goes over blocks, and then over the blocks' last values."""

    def fold(array: Column) -> Column:
        last = lambda done: F.get(done, F.size(done) - 1)
        return F.aggregate(array, F.array().cast("array<int>"), lambda done, v: F.concat(done, F.array(F.coalesce(join(last(done), v), v))))

    def put(within: Column) -> Column:
        ends = fold(F.transform(within, lambda w: F.get(w, F.size(w) - 1)))
        return let(ends, lambda e: F.flatten(F.transform(within, lambda w, i: F.transform(w, lambda v: F.coalesce(join(F.get(e, i - 1), v), v)))))

    def blocks(array: Column) -> Column:
        n = F.ceil(F.size(array) / BLOCK).cast("int")
        parts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: fold(F.slice(array, i * BLOCK + 1, BLOCK)))
        return F.when(n > 0, let(parts, put)).otherwise(F.array().cast("array<int>"))

    return let(values, blocks)


def plus(a: Column, b: Column) -> Column:
    return a + b


def most(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def spans_of(text: Column, rule: Rule, number: int) -> Column:
    """The rule's leftmost non-overlapping matches as an array of (start, number, end), in code points: the lengths of
    the texts between matches and of the matches, summed up."""
    pattern = f"(?i){rule.pattern}" if rule.any_case else rule.pattern
    whole = F.lit(f"(?:{pattern})")
    matches = F.regexp_extract_all(text, whole, F.lit(0))
    groups = F.regexp_extract_all(text, whole, F.lit(rule.group))
    between = F.split(text, f"(?:{pattern})", -1)

    def placed(found: Column) -> Column:
        lengths = found["lengths"]
        span = lambda end, k: F.struct((end - F.get(lengths, k)).alias("start"), F.lit(number).alias("number"), end.alias("end"), F.get(found["sizes"], k).alias("size"))
        ends = running(F.transform(lengths, lambda n, k: F.get(found["gaps"], k) + n), plus)
        return F.transform(F.filter(F.transform(ends, span), lambda s: s["size"] >= rule.least), lambda s: F.struct(s["start"].alias("start"), s["number"].alias("number"), s["end"].alias("end")))

    length = lambda strings: F.transform(strings, lambda s: F.length(s))
    none = F.array().cast("array<struct<start:int,number:int,end:int>>")
    return F.when(text.rlike(f"(?:{pattern})"), let(F.struct(length(between).alias("gaps"), length(matches).alias("lengths"), length(groups).alias("sizes")), placed)).otherwise(none)


def scanned(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs(doc_key, text, ...) with `spans`: an array of (start, number, end) over all rules, sorted, number being the
    rule's place in rules. doc_key has to be not null, and the same only in rows of the same text."""
    queries = {r.kind: trigram_query(r) for r in rules}
    indexed = [(n, r) for n, r in enumerate(rules) if queries[r.kind] is not None]
    open_ = [(n, r) for n, r in enumerate(rules) if queries[r.kind] is None]
    text = F.col("text")
    kinds = "array<struct<start:int,number:int,end:int>>"
    out = docs
    if indexed:
        named = sorted({t for q in queries.values() if q is not None for c in q for t in c})
        found = candidates(postings(docs.select("doc_key", "text"), named), queries)
        verify = F.concat(*[F.when(F.array_contains("kinds", r.kind), spans_of(text, r, n)).otherwise(F.array().cast(kinds)) for n, r in indexed])
        verified = docs.select("doc_key", "text").join(found, "doc_key").select("doc_key", verify.alias("verified")).groupBy("doc_key").agg(F.first("verified").alias("verified"))
        out = out.join(verified.filter(F.size("verified") > 0), "doc_key", "left")
    else:
        out = out.withColumn("verified", F.lit(None).cast(kinds))
    everywhere = F.concat(*[spans_of(text, r, n) for n, r in open_]) if open_ else F.array().cast(kinds)
    return out.withColumn("spans", F.sort_array(F.concat(everywhere, F.coalesce("verified", F.array().cast(kinds))))).drop("verified")


def keyed(docs: DataFrame) -> DataFrame:
    """docs with doc_key, from doc_id and text: the same in repeated rows, which have the same spans."""
    has = F.col("doc_id").isNotNull()
    return docs.withColumn("doc_key", F.struct(F.coalesce(F.col("doc_id"), F.lit(0)).cast("long").alias("id"), F.xxhash64(has, F.col("text")).alias("hash")))


def listed(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["number"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Finds the rules' matches in each row of docs(doc_id, text).

    Returns doc_id and `spans`, an array of (start, number, end) sorted by start, then rule, then end; a row per input
    row. A null text counts as empty; repeated rows and null ids keep a row each; other columns are not looked at; an
    empty table gives no row.
    """
    base = keyed(docs.select("doc_id", text_or_empty().alias("text")))
    return scanned(base, rules).select("doc_id", "spans")


def redacted(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mask: str = "[SECRET]") -> DataFrame:
    """docs with each run of overlapping spans in text replaced by mask, and n_chars set anew; texts without spans, and
    null texts, stay as they are. All columns of docs come back, in their order, whatever their names; repeated rows
    and null ids keep a row each; an empty table gives no row."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole_row"), F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("string").alias("text"))
    found = scanned(keyed(whole), rules)

    def merge(spans: Column) -> Column:
        """Runs of overlapping spans: one begins where a span starts after all before it have ended."""

        def runs(reach: Column) -> Column:
            firsts = F.filter(F.transform(spans, lambda s, k: F.when((k == 0) | (s["start"] >= F.get(reach, k - 1)), k)), lambda k: k.isNotNull())
            last = lambda f, k: F.coalesce(F.get(f, k + 1), F.size(spans)) - 1
            return let(firsts, lambda f: F.transform(f, lambda at, k: F.struct(F.get(spans, at)["start"].alias("start"), F.get(reach, last(f, k)).alias("end"))))

        return let(running(F.transform(spans, lambda s: s["end"]), most), runs)

    def masked(runs: Column) -> Column:
        n = F.size(runs)
        start = lambda k: F.when(k == 0, 0).otherwise(F.get(runs, k - 1)["end"])
        stop = lambda k: F.when(k == n, F.length("text")).otherwise(F.get(runs, k)["start"])
        return F.array_join(F.transform(F.sequence(F.lit(0), n), lambda k: F.substr("text", start(k) + 1, stop(k) - start(k))), mask)

    some, row = F.size("spans") > 0, F.col("whole_row")
    out = found.withColumn("masked", F.when(some, let(merge(F.col("spans")), masked)))
    values = {"text": F.when(some, F.col("masked")).otherwise(row["text"])}
    if "n_chars" in docs.columns:
        values["n_chars"] = F.when(some, F.length("masked")).otherwise(row["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return out.select(*[values.get(c, row.getField(c)).alias(c) for c in docs.columns])

"""The divergence audit against a version that goes over every term of every pair of groups."""

import random
import re
from collections import Counter, defaultdict

import pytest

from tessera.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, value long, item string, term string, n long, rank int, part string"


def force(rows, least_docs, most):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))) for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        there = Counter(t for d in own for t in set(d[2]))
        kept = sorted(t for t, n in there.items() if n >= least_docs)
        counts = defaultdict(Counter)
        for _, source, terms in own:
            counts[source].update(t for t in terms if there[t] >= least_docs)
        total = sum(counts.values(), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        apart = lambda p, q: (p - q) ** 2 // (p + q)
        of, whole = {s: share(c) for s, c in counts.items()}, share(total)
        for s in of:
            pairs = [(sum(apart(of[s][t], of[o][t]) for t in kept), o) for o in of if o != s]
            terms = [(apart(of[s][t], whole[t]), t) for t in kept if counts[s][t] and of[s][t] > whole[t]]
            for part, found, limit in (("pair", pairs, None), ("term", terms, most)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(found[:limit], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    common = [f"w{'abcdefghij'[k % 10]}{'xyz' * (k // 10)}" for k in range(40)]
    tied = ["long" * 500 + x for x in ("", "a", "b", "ba", "ca", "é", "漢", "z", "zz")] + ["q", "qq", "é", "😀"]  # in equally many rows of one source
    out = []
    for k in range(120):
        lang, source = rng.choice(["en", "en", "fr"]), rng.choice(["hot", "hot", "web", "é", "Z"])
        text = " ".join(rng.choice(common).upper() if rng.random() < 0.3 else rng.choice(common) for _ in range(rng.randrange(60)))
        out.append((k, text, lang, source))
    out += [(200 + k, " 7 ".join(tied), "en", "tied") for k in range(4)]
    out += [(300, None, "en", "silent"), (301, "", None, None), (302, "1 2 @ [", None, "x"), (303, "lonely words", "xx", "only"), (None, "null id", "en", None), (304, "word " * 300_000, "fr", "web"), (None, "null id", "en", None)]
    return out + out[:20]


def test_divergence(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "i", "t", 2, 3, "p") for r in rows], SCHEMA).repartition(5)
    found = divergence.source_divergence(docs, least_docs=4, most_terms=5)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    want = force(rows, 4, 5)
    assert sorted(map(tuple, found.collect())) == want
    assert any(w[1] == "tied" and w[2] == "term" for w in want)
    assert divergence.source_divergence(docs.limit(0)).count() == 0


def test_parts_of_a_task_change_nothing(spark, rows, monkeypatch):
    """Terms and pairs handed on in small parts, and texts split at every few bytes."""
    docs = spark.createDataFrame([(*r, 1, "i", "t", 2, 3, "p") for r in rows], SCHEMA).repartition(2)
    for name, value in (("HELD", 5), ("PIECE", 10), ("PAIRS", 3), ("ABREAST", 2)):
        monkeypatch.setattr(divergence, name, value)
    assert sorted(map(tuple, divergence.source_divergence(docs, 4, 5).collect())) == force(rows, 4, 5)


def test_pieces_hold_every_term():
    text = ("ab  Cd\n" * 100 + "é" * 50 + "x").encode()
    assert [t for part in divergence.term_lists(text) for t in part] == [b"ab", b"cd"] * 100 + [("é" * 50 + "x").encode()]

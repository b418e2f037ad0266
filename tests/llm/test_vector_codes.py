"""Vector codes against every distance, in Python's integers."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from tessera.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error int, n int, sums string, salt int"


def force(rows, parts, entries, turns):
    fine = lambda v: v and len(v) % parts == 0 and all(x is not None and math.isfinite(x) and abs(x) < 2**18 for x in v)
    usable = [r for r in rows if fine(r[1])]
    named = sorted((r for r in usable if r[0] is not None), key=lambda r: (r[0], r[1]))
    usable = [r for r in usable if len(r[1]) == len(named[0][1])]
    cut = lambda v: [tuple(math.floor(x * 256) for x in v[i : i + len(v) // parts]) for i in range(0, len(v), len(v) // parts)]
    first = {}
    for r in sorted((r for r in usable if r[0] is not None), key=lambda r: (r[0], r[1])):
        first.setdefault(r[0], cut(r[1]))
    books = [[x[p] for x in [*first.values()][:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(turns):
        met = defaultdict(list)
        for r in usable:
            for p, x in enumerate(cut(r[1])):
                met[p, near(x, books[p])[1]].append(x)
        for (p, k), xs in met.items():
            books[p][k] = tuple(sum(c) // len(xs) for c in zip(*xs))
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    found = [(r[0], r[2], [near(x, books[p]) for p, x in enumerate(cut(r[1]))]) for r in usable]
    errors = defaultdict(int)
    for _, label, n in found:
        errors[label] += sum(d for d, _ in n)
    return sorted(((i, "".join(f"{k:02x}" for _, k in n), sum(d for d, _ in n), errors[label], digest) for i, label, n in found), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    f32 = lambda x: float(np.float32(x))
    out = [(i, [f32(rng.gauss(0, 0.1) if rng.random() < 0.7 else rng.choice((-0.5, 0.25))) for _ in range(8)], rng.choice((0, 1, None))) for i in range(-20, 130)]
    out += [(500, None, 1), (501, [], 1), (502, [0.5] * 7 + [None], 1), (503, [0.5] * 7 + [math.nan], 1), (504, [math.inf] * 8, 2), (505, [1e30] * 8, 2), (506, [0.5] * 12, 3), (507, [0.1] * 7, 3)]
    out += [(None, [f32(0.3)] * 8, None), (508, [200_000.0] * 8, 7), (508, [-200_000.0] * 8, 7), (-20, [f32(0.2)] * 8, 0), (-20, [f32(-0.9)] * 8, 0)]
    return out + out[:30]


@pytest.mark.parametrize("parts, entries, turns", [(4, 16, 2), (2, 64, 3), (8, 256, 0), (1, 1, 1)])
def test_vector_codes(spark, rows, parts, entries, turns):
    table = spark.createDataFrame([(*r, "c", 1, 2, "s", 3) for r in rows], SCHEMA).repartition(4)
    found = vector_codes.vector_codes(table, parts, entries, turns)
    assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, found.collect()), key=str) == force(rows, parts, entries, turns)


def test_nothing_usable(spark):
    for rows in ([], [(1, None, 1), (None, [0.5] * 8, 1)]):
        assert vector_codes.vector_codes(spark.createDataFrame([(*r, "c", 1, 2, "s", 3) for r in rows], SCHEMA), 4).count() == 0


def test_search_is_exact_and_visits_few():
    """Small integers make many ties; a search must still prune."""
    rng = np.random.default_rng(1)
    for width, spread in ((1, 4), (4, 3), (4, 100), (16, 60)):
        book = rng.integers(-spread, spread, (64, width))
        x = rng.integers(-spread, spread, (3000, width))
        d = ((x[:, None] - book[None]) ** 2).sum(axis=2)
        which, best = vector_codes.nearest(x, book, vector_codes.tree(book))
        assert (which == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
    seen, whole = 0, vector_codes._squared

    def counting(a, b):
        nonlocal seen
        seen += len(a)
        return whole(a, b)

    book = rng.integers(-200, 200, (64, 2))
    root, x = vector_codes.tree(book), rng.integers(-200, 200, (2000, 2))
    vector_codes._squared = counting
    try:
        vector_codes.nearest(x, book, root)
    finally:
        vector_codes._squared = whole
    assert seen < 0.5 * 64 * len(x)


def test_roots_round_to_the_safe_side():
    for x in [0, 1, 2, 3, 4, 2**52 - 1, 2**52, (2**29 - 1) ** 2 - 1, (2**29 - 1) ** 2, 2**59]:
        assert vector_codes._isqrt(np.array([x]))[0] == math.isqrt(x)


def test_decoding_gives_the_entries(spark, rows):
    table = spark.createDataFrame([r for r in rows], "vec_id long, embedding array<float>, label int")
    books = vector_codes.trained(table, 4, 16, 2)
    found = vector_codes.decoded(vector_codes.encoded(table, books), books).join(table.filter("vec_id between 0 and 99").distinct(), "vec_id").collect()
    assert len(found) > 90
    for r in found:
        assert r.error == sum((math.floor(x * 256) - a) ** 2 for x, a in zip(r.embedding, r.approximation))

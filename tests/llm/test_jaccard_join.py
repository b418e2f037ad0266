"""The Jaccard join against all pairs, its filters against what they bound, and repeated ids."""

import random

import numpy as np
import pytest

from tessera.llm import jaccard_join, near_dup

SCHEMA = "doc_id long, text string, n long, component string, buckets string, position int, node string"


def by_force(rows, size, percent):
    """component by (doc_id, text): rows are nodes by their sets."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i, t or ""] = frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()
    distinct = [s for s in {s for (i, _), s in sets.items() if i is not None} if s]
    parent = {s: s for s in distinct}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(distinct):
        for b in distinct[:k]:
            if 100 * len(a & b) >= percent * len(a | b):
                parent[find(a)] = find(b)
    least = {}
    for (i, _), s in sets.items():
        if s and i is not None:
            least[find(s)] = min(i, least.get(find(s), i))
    return {(i, t): (len(s), None if i is None else least[find(s)] if s else i) for (i, t), s in sets.items()}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("aeinort") for _ in range(rng.randint(1, 6)))
    text = lambda n: [word() for _ in range(n)]
    passage, out = text(60), []
    for group in range(6):  # near copies, of very different lengths, all with one passage
        base = text(rng.choice((5, 20, 80, 300))) + passage
        for k in range(rng.choice((2, 9, 30))):
            w = list(base)
            for _ in range(rng.randrange(1 + len(w) // 30)):
                w[rng.randrange(len(w))] = word() + str(k)
            out.append((100 * group + k, " ".join(w[: rng.randint(len(w) * 4 // 5, len(w))])))
    out += [(700 + k, " ".join(text(rng.choice((1, 2, 4, 5, 6, 50))) + (passage if k % 3 else []))) for k in range(40)]
    out += [(800, None), (801, ""), (802, " \n\x0b "), (803, "one"), (804, "ONE"), (805, "one two"), (806, " ".join(text(20_000))), (807, " ".join(["again"] * 500)), (808, "again " * 7), (None, "one"), (None, None)]
    return out + out[:25]


@pytest.mark.parametrize("size, percent, most", [(5, 80, 1 << 20), (5, 80, 0), (3, 60, 40), (1, 50, 1 << 20)])
def test_join(spark, rows, size, percent, most):
    docs = spark.createDataFrame([(*r, 1, "c", "b", 2, "n") for r in rows], SCHEMA).repartition(3)
    found = jaccard_join.jaccard_join(docs, size, percent, most)
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    want = by_force(rows, size, percent)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(((i, *want[i, t or ""]) for i, t in rows), key=str)
    assert len({want[k] for k in want}) < len(want)
    assert jaccard_join.jaccard_join(docs.limit(0), size, percent).count() == 0


def test_rows_of_one_id_with_two_texts(spark, rows):
    """A link isn't lost where another text has the same id."""
    a, b = rows[0][1].split() * 3, rows[200][1].split() * 3 if len(rows) > 200 else "x y z".split() * 40
    b = [f"q{w}{k % 50}" for k, w in enumerate(b)]
    table = [(5, " ".join(a)), (5, " ".join(b)), (6, " ".join([*a, "end"])), (7, " ".join([*b, "end"])), (4, "lone " * 30)]
    table += [(i, f"w{i} " + " ".join(a)) for i in (9, 9)] + [(9, " ".join(b))]
    docs = spark.createDataFrame(table, "doc_id long, text string")
    want = sorted(((i, *by_force(table, 5, 80)[i, t]) for i, t in table), key=str)
    assert sorted(map(tuple, jaccard_join.jaccard_join(docs).collect()), key=str) == want
    found = near_dup.near_duplicates(docs, 5, 80).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str) == want
    assert {(r.doc_id, r.kept) for r in found} == {(5, True), (6, False), (7, False), (4, True), (9, False)}


def test_frequent_shingles_are_counted_over_all_rows(spark, rows, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HELD", 1000)
    docs = spark.createDataFrame([(t or "",) for _, t in rows], "text string").repartition(4)
    counts = {}
    for _, t in rows:
        for key in jaccard_join.cut(near_dup.shingle_set(t or "", 5, near_dup._Hashes())).tolist():
            counts[key] = counts.get(key, 0) + 1
    want = {k: n for k, n in counts.items() if n > jaccard_join.RARE}
    keys, found = jaccard_join.frequent(docs, 5)
    assert want and dict(zip(keys.tolist(), found.tolist())) == want and (np.diff(keys) > 0).all()
    few, found = jaccard_join.frequent(docs, 5, 60)
    assert len(few) <= 60 and all(n > max((want[k] for k in want.keys() - set(few.tolist())), default=0) for n in found)


def test_prefixes_of_linked_sets_meet():
    rng = np.random.default_rng(4)
    pool = np.unique(rng.integers(0, 2**63, 400, dtype=np.uint64))
    keys = np.sort(jaccard_join.cut(rng.choice(pool, 100, replace=False)))
    docs = rng.integers(9, 60, len(keys))
    linked = 0
    for _ in range(600):
        a = np.unique(rng.choice(pool, rng.integers(1, 60)))
        b = np.unique(np.concatenate([rng.choice(a, rng.integers(1, len(a) + 1), replace=False), rng.choice(pool, rng.integers(0, 8))]))
        shared = len(np.intersect1d(a, b))
        assert near_dup.least_difference(a, b) <= len(a) + len(b) - 2 * shared
        if 100 * shared >= 80 * (len(a) + len(b) - shared):
            linked += 1
            x, y = (jaccard_join.prefix(s, keys, docs, 80) for s in (a, b))
            assert len(np.intersect1d(x, y)) + max(len(a) - len(x), len(b) - len(y)) >= shared and len(np.intersect1d(x, y))
    assert linked > 60


def test_pairs_without_room_are_not_compared(spark):
    """No comparison where positions, sizes or the number of elements met by rule a link out."""
    schema = "bucket long, node long, n long, position int"
    pairs = lambda rows: {tuple(r) for r in near_dup.together(spark.createDataFrame(rows, schema), 80).collect()}
    met = lambda n, m, *at: pairs([x for k, (i, j) in enumerate(at) for x in ((k, 10, n, i), (k, 11, m, j))])
    assert met(10, 10, (0, 0), (1, 1)) == {(10, 11)}
    assert met(10, 10, (0, 0)) == set()  # a prefix is 3 of 10: 1 met by and 7 after it are too few of 20 elements
    assert met(10, 10, (0, 1), (1, 2)) == {(10, 11)}  # nine can be shared of eleven
    assert met(10, 10, (0, 0), (0, 2)) == set()  # eight of twelve
    assert met(10, 12, (0, 0), (1, 1)) == {(10, 11)} and met(10, 13, (0, 0), (1, 1), (2, 2)) == set()
    assert met(5, 5, (0, 0), (1, 1)) == {(10, 11)} and met(1, 1, (0, 0)) == {(10, 11)}


@pytest.mark.parametrize("small", [0, 2, 1000])
def test_bucket_sizes_change_nothing(spark, rows, monkeypatch, small):
    monkeypatch.setattr(near_dup, "SMALL", small)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = by_force(rows, 5, 80)
    assert sorted(map(tuple, jaccard_join.jaccard_join(docs).collect()), key=str) == sorted(((i, *want[i, t or ""]) for i, t in rows), key=str)


def test_packing_of_integers():
    rng = np.random.default_rng(2)
    for x in (np.array([0]), np.array([255, 256]), rng.integers(0, 1 << 44, 100)):
        assert (jaccard_join.unpacked(jaccard_join.packed(x), len(x)) == x).all()


def test_frequent_shingles_beyond_the_table_stay_out_of_prefixes(spark):
    """however few of them are sent to all tasks as they are."""
    common = [" ".join(f"c{g}{k}" for k in range(40)) for g in range(30)]
    docs = spark.createDataFrame([(i, f"{common[i % 30]} " + " ".join(f"d{i}x{k}" for k in range(40))) for i in range(600)], "doc_id long, text string").repartition(3)
    keys, _, rest = jaccard_join.order(docs.select("text"), 5, 0)
    assert not len(keys) and rest.any()
    buckets = [x for r in jaccard_join.prefixed(docs, 5, 80, 0).collect() for x in r.buckets]
    assert len(buckets) == len(set(buckets)) > 600


def test_pairs_without_room_take_no_texts_along(spark):
    """signatures bound the difference of two sets, of any sizes, and pairs that they rule out are dropped."""
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (1, 3, 30, 31, 400, 2000)]
    sets += [np.unique(np.concatenate([s[len(s) // 9 :], rng.integers(0, 1 << 63, 2, dtype=np.uint64)])) for s in sets]
    signs = [near_dup.signature(s) for s in sets]
    pairs = [(i, j) for j in range(len(sets)) for i in range(j)]
    for i, j in pairs:
        assert near_dup.odd(signs[i], signs[j]) <= len(np.setxor1d(sets[i], sets[j]))
    rows = spark.createDataFrame([(i, j, True) for i, j in pairs] + [(0, 5, False)], "a long, b long, alone boolean")
    table = spark.createDataFrame([(i, len(s), bytearray(x)) for i, (s, x) in enumerate(zip(sets, signs))], "node long, n long, signature binary")
    found = {(r.a, r.b) for r in near_dup.roomy(rows, table, 80).collect()}
    linked = {(i, j) for i, j in pairs if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))}
    assert linked and linked <= found - {(0, 5)} and len(found) < len(pairs) / 2 and (0, 5) in found

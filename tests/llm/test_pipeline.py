"""corpus_pipeline against a brute-force version, on documents with planted copies, toxic words, secrets, nulls, repeated
rows and clashing columns."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, doc_key string, kept int, _text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(21)
    common = ["alpha", "beta", "gamma", "delta", "of", "the", "and", "to", "in", "is"]
    prose = lambda n=60: " ".join(rng.choice(common) if rng.random() < 0.6 else "".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(n))
    texts = {k: prose() for k in range(60)}
    for k in range(0, 60, 6):
        texts[k] += " zzvile zzvile" if k < 54 else " ZZV1LE zzvi1e"
    texts |= {70: None, 71: "", 72: "too short", 73: " ".join(["one two three four five six seven eight nine"] * 6)}
    texts |= {80: texts[1], 81: texts[1] + " extra", 82: texts[2].upper(), 83: texts[3] + " token=abcdefghijklmnop end"}
    texts |= {90: prose(3000)}
    out = [(i, t) for i, t in texts.items()]
    return [*out, (4, texts[4]), (None, prose()), (None, "short")]


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    path = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), "s", "k", 1, "t") for i, t in rows], SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages_against_brute_force(spark, rows, folder):
    from tokenizers import Tokenizer

    from tessera.llm import quality, secrets, tokenizer, toxicity
    from tessera.llm.packing import cut

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality rules", "toxicity", "near duplicates", "secret scan", "best-fit packing"]
    key = lambda r: (str(r[0]), str(r[1]))

    kept = stages["quality rules"](spark, docs, folder)
    assert kept.columns == docs.columns
    distances = {r.doc_id: (r.class_distance, r.word_distance) for r in quality.quality_rules(docs).collect()}

    def good(i, t):
        w = WORD.findall(t or "")
        c = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        twice = {k + j for k in range(len(w) - 7) if c[tuple(w[k : k + 8])] > 1 for j in range(8)}
        odd = len(w) >= 40 and distances[i][0] > 0.25 or len(w) >= 60 and (distances[i][1] or 0) > 0.32
        return len(w) >= 20 and 100 * len(twice) <= 30 * len(w) and not odd

    left = [(i, t) for i, t in rows if good(i, t)]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=key) == sorted(left, key=key)
    assert {70, 71, 72, 73}.isdisjoint(i for i, _ in left) and len(left) > 50

    clean = stages["toxicity"](spark, kept, folder)
    left = [(i, t) for i, t in left if "zzvile" not in " ".join(toxicity.folded_words(t))]
    assert sorted(((r.doc_id, r.text) for r in clean.collect()), key=key) == sorted(left, key=key)

    def shingles(t):
        w = t.encode().lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}

    sets = {i: shingles(t) for i, t in left if i is not None}
    group = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    group[a] = group[b] = min(group[a], group[b])
        break
    first = stages["near duplicates"](spark, clean, folder)
    left = [(i, t) for i, t in dict.fromkeys(left) if i is None or group[i] == i]
    assert first.columns == docs.columns and sorted(((r.doc_id, r.text) for r in first.collect()), key=key) == sorted(left, key=key)
    assert {80, 81, 82, 83}.isdisjoint(i for i, _ in left)

    masked = stages["secret scan"](spark, first, folder)
    assert masked.columns == docs.columns
    left = [(i, re.sub(r"token=[a-z]+", "[SECRET]", t)) for i, t in left]
    assert sorted(((r.doc_id, r.text) for r in masked.collect()), key=key) == sorted(left, key=key)

    library = Tokenizer.from_file(tokenizer.vocabulary("byte_bpe_50k.json"))
    want = Counter()
    for i, t in left:
        ids = [*library.encode(t, add_special_tokens=False).ids, 0]
        for piece, (a, b) in enumerate(cut(len(ids), 2048)):
            want[i, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, folder).collect()) == want


def test_one_row_of_an_id_stays(spark):
    rng = random.Random(3)
    text = lambda: " ".join(str(rng.randrange(10**6)) for _ in range(30))
    a, b = text(), text()
    docs = spark.createDataFrame([(1, a, "x"), (1, b, "y"), (2, a, "z"), (2, a, "z"), (3, None, "n"), (3, None, "n"), (None, a, "q"), (None, None, "q")], "doc_id long, text string, id string")
    got = [tuple(r) for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()]
    again = [tuple(r) for r in corpus_pipeline.near_duplicate_stage(spark, docs.repartition(5), "").collect()]
    assert sorted(got, key=str) == sorted(again, key=str)
    assert [r[0] for r in sorted(got, key=str) if r[0] is not None] == [1, 3] and sum(r[0] is None for r in got) == 2


def test_no_secret_is_left_where_every_row_comes_twice(spark, rows, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    text = "password = hunter2hunter2x and the " + " ".join(t for _, t in rows if t)[:400] + " AKIA" + "Z" * 18
    more = docs.filter("doc_id = 1").limit(1).drop("doc_id", "text")
    for i in ("500", "null"):
        docs = docs.unionByName(more.selectExpr(f"cast({i} as bigint) as doc_id", f"'{text}' as text", "*"))
    out = dict(corpus_pipeline.STAGES)["secret scan"](spark, docs.unionByName(docs), folder)
    found = [r.text for r in out.collect() if r.text]
    assert sum("[SECRET] and the" in t for t in found) == 4
    assert not any("hunter2" in t or "AKIA" in t or "token=abcdefgh" in t for t in found)


def test_empty_tables(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

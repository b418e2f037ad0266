"""Cases that once went wrong: long texts, clashing names, merging, repeated ids."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tessera.llm import secrets, toxicity
from tessera.llm.common import shared_dir


def test_spans_take_linear_time(spark):
    n = 128_000
    runs = [f"{k:016x}" for k in range(n)]
    df = spark.createDataFrame([(1, " ".join(runs))], "doc_id long, text string")
    began = time.time()
    assert df.select(F.size(secrets.spans_of(F.col("text"), secrets.BASE[2], 2))).collect()[0][0] == n
    assert time.time() - began < 10
    found = secrets.secret_scan(df).collect()[0].spans
    assert [tuple(s) for s in found] == [(17 * k, 2, 17 * k + 16) for k in range(n)]


@pytest.mark.parametrize("join, force", [(secrets.plus, lambda x: [sum(x[: k + 1]) for k in range(len(x))]), (secrets.most, lambda x: [max(x[: k + 1]) for k in range(len(x))])])
def test_running(spark, join, force):
    rng = random.Random(1)
    lists = [[rng.randrange(100) for _ in range(n)] for n in (0, 1, 255, 256, 257, 1000)]
    got = spark.createDataFrame([(x,) for x in lists], "x array<int>").coalesce(1).select(secrets.running(F.col("x"), join)).collect()
    assert [r[0] for r in got] == [force(x) for x in lists]


def test_redaction_by_force_and_clashing_columns(spark):
    rng = random.Random(2)
    bits = ["token=", "password: ", "AKIA" + "B" * 16, "0123456789abcdef", "abcdefabcdef0123456", "eyJaaaaaaaaaa.eyJbbbbbbbbbb.cccccccccc", " ", "\n", "é", "plain words", "ghp_" + "a" * 40]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(30))) for _ in range(80)]
    clashing = ("doc_key", "_new", "_text", "verified", "spans", "whole_row", "masked", "kinds", "a.b")
    schema = "doc_id long, text string, n_chars int, " + ", ".join(f"`{c}` string" for c in clashing)
    rows = [(None if k == 7 else k % 60, None if k == 8 else t, -1, *(f"{c}{k}" for c in clashing)) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, schema)
    out = secrets.redacted(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes

    def force(text):
        held = [False] * len(text)
        edges = set()
        for r in secrets.RULES:
            for m in re.finditer(r.pattern, text, re.A | (re.I if r.any_case else 0)):
                if len(m[r.group]) >= r.least:
                    held[m.start() : m.end()] = [True] * (m.end() - m.start())
                    edges.add((m.start(), m.end()))
        parts, at = [], 0
        while at < len(text):
            if not held[at]:
                parts.append(text[at])
                at += 1
                continue
            reach = at
            while True:
                more = max([e for s, e in edges if s == at or at <= s < reach], default=reach)
                if more <= reach:
                    break
                reach = more
            parts.append("[SECRET]")
            at = reach
        return "".join(parts)

    want = sorted(((i, None if t is None else force(t), -1 if t is None or force(t) == t else len(force(t)), *rest) for i, t, _, *rest in rows), key=str)
    assert sorted(map(tuple, out.collect()), key=str) == want
    assert secrets.redacted(docs.limit(0)).count() == 0


def test_secrets_of_repeated_rows(spark):
    """Every row of a text with secrets gives its spans, under one id, under several and under none."""
    secret = "password = hunter2hunter2x AKIA" + "Z" * 18 + " ghp_" + "q" * 40 + " eyJaaaaaaaaaa.eyJbbbbbbbbbb.cccccccccc -----BEGIN RSA PRIVATE KEY-----"
    rows = [(1, secret), (2, secret), (2, secret), (2, secret), (None, secret), (None, secret), (3, "clean"), (3, "clean")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = secrets.secret_scan(docs).collect()
    kinds = [sorted({secrets.RULES[s.number].kind for s in r.spans}) for r in found]
    assert sorted(map(str, kinds)) == sorted(map(str, [["access", "assign", "github", "jwt", "private_key"]] * 6 + [[]] * 2))
    texts = [r.text for r in secrets.redacted(docs).collect()]
    assert len(texts) == 8 and set(texts) == {"clean", "[SECRET] [SECRET] [SECRET] [SECRET] [SECRET]"}


def test_scores_do_not_depend_on_partitions_where_ids_repeat(spark):
    from tessera.llm.lm_scoring import lm_scores

    rng = random.Random(7)
    rows = [(k % 40, " ".join(rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(rng.randrange(5, 80)))) for k in range(240)]
    rows += [(None, rows[0][1]), (None, rows[0][1]), rows[3], (77, "long " * 60_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    score = lambda df: sorted(((r.doc_id, r.n_tokens, round(r.base_score, 6), round(r.score, 6)) for r in lm_scores(df, F.coalesce(F.col("doc_id") % 5 != 1, F.lit(True))).collect()), key=str)
    assert score(docs.repartition(2)) == score(docs.repartition(7))


def test_toxicity_by_force(spark):
    """Hits, exceptions and scores against a matcher that tries every pattern at every word."""
    rng = random.Random(5)
    vocabulary = ["idiot", "trash", "can", "clown", "fish", "moron", "moronic", "nice", "day", "tr4sh", "ІDIOT", "IDI0T", "sore", "loser"]
    rows = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(40)))) for k in range(60)] + [(100, None), (None, "idiot"), (5, "clown fish clown"), (5, "clown fish clown")]
    model = toxicity.Model({"\x01idiot\x01": 4.0, "\x01trash\x01": 3.0, "\x01clown\x01": 2.0, "\x01loser\x01": 2.0, "\x01moro": 5.0}, toxicity.EXCEPTIONS, (-2.0, 1.0, 3.0))
    docs = spark.createDataFrame([(i, t, 9, "x") for i, t in rows], "doc_id long, text string, score int, hits string")

    def force(text):
        w = toxicity.folded_words(text or "")
        free = [True] * len(w)
        for phrase in toxicity.EXCEPTIONS:
            p = phrase.split()
            for k in range(len(w)):
                if w[k : k + len(p)] == p:
                    free[k : k + len(p)] = [False] * len(p)
        starts = sum(f and x.startswith("moro") for x, f in zip(w, free))
        total = 0.0
        for x, f in zip(w, free):
            options = [v for p, v in model.weights.items() if f and (p == f"\x01{x}\x01" or (p == "\x01moro" and x.startswith("moro") and starts >= 2 and starts >= 0.01 * len(w)))]
            total += max(options, default=0.0)
        return total

    import math

    got = sorted(((r.doc_id, r.hits, r.predicted, round(r.score, 9)) for r in toxicity.toxicity(docs, model).collect()), key=str)
    want = []
    for i, t in rows:
        hits, n = force(t), len(toxicity.folded_words(t or ""))
        score = 1 / (1 + math.exp(-(-2.0 + math.log1p(hits) + 3.0 * min(hits / max(n, 1), 1.0))))
        want.append((i, hits, int(score >= 0.5), round(score, 9)))
    assert got == sorted(want, key=str)
    clean = sorted((i, t) for (i, t), w in zip(rows, want) if i is not None and not w[2] and t is not None)
    assert sorted((r.doc_id, r.text) for r in toxicity.without_toxic(docs, model).filter("doc_id is not null and text is not null").collect()) == clean


def test_exceptions_in_a_long_text_take_linear_time():
    a, b = toxicity.automaton({"\x01trash\x01": 5.0}), toxicity.automaton(toxicity._phrases(("trash can",)))
    words = toxicity.folded_words("trash can trash " * 100_000)
    began = time.time()
    assert toxicity.hit_weight(words, a, b) == 500_000.0
    assert time.time() - began < 10


def test_no_own_folder_on_a_cluster():
    class Conf:
        def get(self, key, default):
            return default

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())


def test_captures_are_found_by_search(spark, tmp_path):
    """Every capture by (key, page_id), with a URL that most captures have, nulls, repeated rows and a very long page."""
    from tessera.llm import warc

    rows = [(k if k % 50 else None, "http://hot.org/" if k % 3 else f"http://{k % 7}.é.org/{k}", f"page {k % 11}" * 3, "x") for k in range(400)]
    rows += [(7, "http://hot.org/", "again", "x"), (7, "http://hot.org/", "again", "x"), (900, None, "long " * 400_000, "x"), (901, "http://none.org", None, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, first_key string").repartition(4)
    made = warc.write_archive(pages, f"file://{tmp_path}/w", lines_per_block=9)
    columns = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to")
    want = sorted(map(tuple, warc.read_captures(made.directory).select(*columns).collect()), key=str)
    assert len(want) == len(rows) and made.directory.count() > 30
    assert sorted(map(tuple, warc.look_up(made.index, made).select(*columns).collect()), key=str) == want
    some = spark.createDataFrame([("org,hot)/", 7), ("org,absent)/", 1), ("org,hot)/", 7), ("org,hot)/", 10**9)], "key string, page_id long")
    assert sorted(r.payload_bytes for r in warc.look_up(some, made).collect()) == [5, 5, 18]

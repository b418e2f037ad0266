"""Each operator against a brute-force version on a small table with nulls, empty and long texts, repeated rows, ties and
clashing columns; and on an empty table."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import fingerprints, lm_scoring, near_dup, packing, quality, secrets, sentencepiece_codec, token_counts, tokenizer, toxicity, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, length int, piece string, row string, kinds string, n long"


def words_of(rng, n):
    return " ".join("".join(rng.choice("aeinorst") for _ in range(rng.randint(1, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    texts = {i: words_of(rng, rng.choice((1, 3, 9, 60, 200))) for i in range(40)}
    base = words_of(rng, 120)
    for k in range(8):
        w = base.split()
        for _ in range(k):
            w[rng.randrange(len(w))] = f"edit{k}"
        texts[100 + k] = " ".join(w)
    texts |= {200: None, 201: "", 202: " \n\t ", 203: base, 204: base.upper(), 205: words_of(rng, 6000), 206: "é—漢字 " * 30 + "<|endoftext|> x", 207: "\n".join([words_of(rng, 12)] * 5), 208: "😀" * 50}
    texts[209] = 'Password: "abcdEFGH12345" token=short AKIA' + "A" * 16 + " " + "0123456789abcdef" * 2 + " token=passwd: abcdefghijklmnop\n-----BEGIN RSA PRIVATE KEY-----"
    out = [(i, t) for i, t in texts.items()]
    return [*out, (203, base), (None, "only a null id")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0, 0, "p", "r", "k", 0) for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer.vocabulary("byte_bpe_50k.json"))


def test_tokens_are_the_librarys():
    found, encoding = library(), tokenizer.byte_bpe(tokenizer.vocabulary())
    rng = random.Random(1)
    points = [c for c in range(0x3000) if not 0xD800 <= c < 0xE000] + [rng.randrange(0x3000, 0xD800) for _ in range(3000)] + [rng.randrange(0xE000, 0x110000) for _ in range(5000)]
    for k in range(0, len(points), 400):
        text = "".join(f"a{chr(c)}{chr(c)}1 {chr(c)} {chr(c)}a\n" for c in points[k : k + 400])
        assert found.encode(text, add_special_tokens=False).ids == tokenizer.encode(encoding, text).tolist()
        parts = token_counts.pre_tokens(text)
        assert "".join(parts) == text and sum(len(tokenizer.encode(encoding, p)) for p in parts) == len(tokenizer.encode(encoding, text))


def test_packing(docs, rows, empty):
    found, got = library(), packing.best_fit_packing(docs, pieces_per_shard=40).collect()
    want = Counter()
    for i, t in rows:
        ids = [*found.encode(t or "", add_special_tokens=False).ids, 0]
        for piece, (a, b) in enumerate(packing.cut(len(ids), 2048)):
            want[i, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for members in by.values():
        end = 0
        for offset, length in sorted(members):
            assert offset == end
            end += length
        assert end <= 2048
    assert packing.best_fit_packing(empty).count() == 0


def test_packing_is_tight():
    lengths = np.random.default_rng(0).integers(1, 700, 4000)
    bins = packing.pack(lengths, 2048)
    assert sorted(i for b in bins for i in b) == list(range(4000))
    assert len(bins) <= 1.01 * math.ceil(lengths.sum() / 2048)
    assert [list(packing.cut(n, 8)) for n in (1, 8, 17)] == [[(0, 1)], [(0, 8)], [(0, 1), (1, 9), (9, 17)]]


def test_placement_rule():
    """Every placement has the least sum of squares of all that were possible."""
    lengths, capacity = np.random.default_rng(1).integers(1, 20, 60), 20
    order = np.argsort(-lengths, kind="stable")
    where = {i: k for k, b in enumerate(packing.place(lengths, capacity)) for i in b}
    gaps: dict[int, int] = {}
    cost = lambda g: sum(n * n for x, n in Counter(g.values()).items() if x)
    for i in order:
        options = [cost(gaps | {k: g - lengths[i]}) for k, g in gaps.items() if g >= lengths[i]] + [cost(gaps | {-1: capacity - lengths[i]})]
        gaps[where[i]] = gaps.get(where[i], capacity) - lengths[i]
        assert cost(gaps) == min(options)


def test_token_counts(docs, rows, empty):
    found = library()
    want = Counter((i, len((t or "").encode()), n := len(found.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t in rows)
    for entries in (131_072, 5, 0):
        assert Counter(map(tuple, token_counts.token_counts(docs, broadcast_entries=entries).collect())) == want
    assert token_counts.token_counts(empty).count() == 0


def spans(text):
    out = []
    for n, r in enumerate(secrets.RULES):
        for m in re.finditer(r.pattern, text, re.A | (re.I if r.any_case else 0)):
            if len(m[r.group]) >= r.least:
                out.append((m.start(), n, m.end()))
    return sorted(out)


def test_secrets(docs, rows, empty):
    got = Counter((r.doc_id, tuple(map(tuple, r.spans))) for r in secrets.secret_scan(docs).collect())
    assert got == Counter((i, tuple(spans(t or ""))) for i, t in rows)
    assert {n for _, s in got for _, n, _ in s} >= {0, 1, 2, 3}
    assert secrets.secret_scan(empty).count() == 0


def test_trigram_queries():
    q = secrets.trigram_query(secrets.Rule("x", "abc(d|ef)+g?[xy]zz+"))
    assert q is not None and all({"abc"} <= c for c in q)
    assert secrets.trigram_query(secrets.BASE[2]) is None
    rng = random.Random(2)
    for rule in secrets.RULES:
        q = secrets.trigram_query(rule)
        for text in (spans.__doc__ or "", "token = abcdefghijklmn", "API_KEY:'aaaaaaaaaaaaaa", "AKIA" + "B" * 20, "-----BEGIN PRIVATE KEY-----", "ghp_" + "a" * 40, words_of(rng, 30)):
            if q is not None and re.search(rule.pattern, text, re.I):
                assert any(all(t in text.lower() for t in c) for c in q)


def test_redaction(docs, rows, spark):
    got = {r.doc_id: r for r in secrets.redacted(docs).collect()}
    assert got[200].text is None and got[201].text == "" and "AKIA" not in got[209].text and got[209].text.startswith("[SECRET]")
    assert got[209].n_chars == len(got[209].text) and got[0].text == dict(rows)[0]
    assert secrets.redacted(docs).columns == docs.columns


def test_quality(docs, rows, empty):
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.quality_rules(docs).collect())
    want = Counter()
    for i, t in rows:
        t = t or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        c = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        twice = {k + j for k in range(len(w) - 7) if c[tuple(w[k : k + 8])] > 1 for j in range(8)}
        want[i, len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(twice), len(w) < 20 or 100 * len(twice) > 30 * len(w)] += 1
    assert got == want
    assert quality.quality_rules(empty).count() == 0
    assert quality.kept_documents(docs).columns == docs.columns


def test_distance(spark):
    p, q = (0.5, 0.5, 0.0), (0.25, 0.25, 0.5)
    m = [(a + b) / 2 for a, b in zip(p, q)]
    want = math.sqrt(sum(x * math.log2(x / y) for z in (p, q) for x, y in zip(z, m) if x) / 2)
    lit = lambda v: F.array(*map(F.lit, v))
    assert spark.range(1).select(quality.distance(lit(p), lit(q))).collect()[0][0] == pytest.approx(want)


def components_by_force(rows, size, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        s = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
        sets[i] = s
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = [i for i in sets if i is not None and sets[i]]
    for a in ids:
        for b in ids:
            if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), None if i is None else find(i)) for i in sets}


@pytest.mark.parametrize("size, percent", [(3, 85), (5, 80)])
def test_near_duplicates(docs, rows, size, percent):
    got = near_dup.near_duplicates(docs, size, percent).collect()
    want = components_by_force(rows, size, percent)
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id is None or r.doc_id == r.component_id)


def test_near_duplicates_in_one_large_group(spark):
    """Variants of one text, most of which aren't linked with its centre, lose no link."""
    rng = random.Random(5)
    base = words_of(rng, 110).split()
    rows = []
    for i in range(260):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = words_of(rng, 1) + str(rng.randrange(30))
        rows.append((i, " ".join(w)))
        if i % 9 == 0:
            rows.append((1000 + i, " ".join([*w[:-2], "other", "end"])))
        if i % 17 == 0:
            rows.append((2000 + i, " ".join(w[: rng.randint(80, 108)])))
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    want = components_by_force(rows, 3, 85)
    assert all(r.component_id == want[r.doc_id][1] for r in got)


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    sets = [pool[:1], pool[:3], pool[:1000], pool[100:1100]]
    s = near_dup.sketches([np.unique(x) for x in sets], 192)
    assert (s != near_dup.FULL).all()
    assert abs((s[2] == s[3]).mean() - 900 / 1100) < 0.12


def test_fingerprints(docs, rows, empty):
    unique = sorted({(i, t or "") for i, t in rows if i is not None}, reverse=True)
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(docs.filter("doc_id is not null").dropDuplicates(["doc_id"])).collect()}

    def sketch(t):
        w = [xxhash.xxh64_intdigest(x.encode(), 42) for x in WORD.findall(t)]
        out = []
        for k in range(max(1, len(w) - 4) if w else 0):
            s = 42
            for x in w[k : k + 5]:
                s = xxhash.xxh64_intdigest(x.to_bytes(8, "little"), s)
            out.append(s >> 1)
        level = sum(len(set(out)) > 256 << k for k in range(4))
        return f"{level}:" + "".join(f"{x:016x}" for x in sorted({x for x in out if x < 1 << 63 - level}))

    for k, (i, t) in enumerate(unique):
        after, half = unique[(k + 1) % len(unique)][1], len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (sketch(t), sketch(edited))
    assert fingerprints.edited_fingerprints(empty).count() == 0 and fingerprints.edited_fingerprints(docs).count() == len(rows)


def test_merged_sketches_are_the_whole(spark):
    rng = random.Random(8)
    parts = {0: [words_of(rng, n) for n in (400, 3000, 20)], 1: [words_of(rng, 30) for _ in range(4)], 2: ["", "a"], 3: [None], None: [words_of(rng, 700)]}
    df = spark.createDataFrame([(k, p) for k, ps in parts.items() for p in ps], "doc_id long, text string")
    every = {}
    for r in df.withColumn("h", fingerprints.distinct_shingles(fingerprints.text_or_empty())).collect():
        every.setdefault(r.doc_id, []).append(set(r.h))
    got = {r.doc_id: r.fingerprint for r in fingerprints.merged(fingerprints.fingerprints(df), "doc_id").collect()}
    for k, sets in every.items():
        level = max(sum(len(s) > 256 << i for i in range(4)) for s in sets)
        assert got[k].level == level and got[k].hashes == sorted(x for x in set().union(*sets) if x < 1 << 63 - level)
    assert got[0].level == 4 and got[1].level == 0


def test_warc(spark, tmp_path):
    urls = ["http://www.a.org/x?y=1#z", "https://a.org:8443/", "http://b.example.com/p q", None, "no url", "http://[bad/"]
    rows = [(i, urls[i % 6], f"<p>é {i % 4}</p>" * (i % 3), "x", 1) for i in range(40)] + [(40, "http://a.org/n", None, "x", 1), (7, "http://a.org/again", "<p>é 3</p>", "x", 1), (None, "http://n.org/", "n", "x", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, key string, size long")
    made = warc.write_archive(pages, f"file://{tmp_path}/w", lines_per_block=7)
    got = Counter(map(tuple, warc.read_captures(made.directory).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()))
    top = {}
    for i, _, html, *_ in rows:
        top[html or ""] = max(top.get(html or "", -1), -1 if i is None else i)
    want = Counter()
    for i, _, html, *_ in rows:
        b = (html or "").encode()
        first = i is None or top[html or ""] == i
        want[i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if first else "revisit", None if first else top[html or ""]] += 1
    assert got == want
    directory = warc.Directory([r.asDict() for r in made.directory.collect()])
    assert len(directory.blocks) > 3
    for i, url, html, *_ in rows[:12]:
        assert any(c[0] == i and (c[6] is None or c[6] == (html or "").encode()) for c in directory.captures(url or ""))
    assert directory.captures("http://absent.org/") == []
    assert warc.read_captures(warc.write_archive(pages.limit(0), f"file://{tmp_path}/e").directory).count() == 0


def test_url_keys():
    assert warc.url_key("HTTPS://user@www.Example.com:443/A?b=c#d") == "com,example)/A?b=c"
    assert warc.url_key("http://x.org") == "org,x)/" and warc.url_key(None) == ""


def test_toxicity(spark, empty):
    rng = random.Random(4)
    rows = []
    for i in range(240):
        w = words_of(rng, 40).split()
        toxic = i % 5 == 0
        if toxic:
            w.insert(rng.randrange(40), rng.choice(("zzidiot", "zzidi0t", "ZZІDIOT")))
        rows.append((i, " ".join(w), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df.select("doc_id", "text"), df.filter("doc_id < 160").select("doc_id", "toxic"))
    got = {r.doc_id: r for r in toxicity.toxicity(df, model).collect()}
    assert all(got[i].predicted == y for i, _, y in rows if i >= 160)
    assert all(0 <= r.score <= 1 for r in got.values())
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "zzidiot"), (1, None)], "doc_id long, text string")
    assert toxicity.toxicity(odd, model).count() == 4 and toxicity.toxicity(empty, model).count() == 0
    assert toxicity.without_toxic(odd, model).count() == 3
    untrained = toxicity.train(empty, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.toxicity(odd, untrained).count() == 4


def test_exception_phrases():
    a, b = toxicity.automaton({"\x01trash\x01": 5.0}), toxicity.automaton(toxicity._phrases(("trash can",)))
    w = toxicity.folded_words
    assert toxicity.hit_weight(w("you tr4sh"), a, b) == 5.0 and toxicity.hit_weight(w("the trash can"), a, b) == 0.0
    assert toxicity.hit_weight(w("trash trash can"), a, b) == 5.0


def test_lm_base_scores(docs, rows, empty):
    got = Counter((r.doc_id, r.training, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in lm_scoring.lm_scores(docs, F.pmod("doc_id", F.lit(3)) != 1, frequent=10).collect())
    toks = [(i, i is None or i % 3 != 1, (t or "").encode().lower().split() + ["end"]) for i, t in rows]
    c = Counter(w for _, training, ws in toks if training for w in ws)
    n, d = sum(c.values()), sum(c.values()) + 0.5 * (len(c) + 1)
    assert got == Counter((i, training, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.5) / d) for w in ws), 6)) for i, training, ws in toks)
    assert lm_scoring.lm_scores(empty, F.lit(True)).count() == 0


def test_lm_learns_order(spark):
    rng = random.Random(6)
    chain = [words_of(rng, 1) + str(i) for i in range(30)]
    text = lambda k: " ".join(chain[(k + i) % 30] for i in range(60))
    df = spark.createDataFrame([(i, text(i)) for i in range(40)], "doc_id long, text string")
    got = lm_scoring.lm_scores(df, F.col("doc_id") % 4 != 1).collect()
    assert all(r.score > r.base_score and r.score < 0 for r in got if not r.training)


def test_sentencepiece(docs, rows, empty):
    path = tokenizer.vocabulary("piece_bpe_32k.model")
    v = sentencepiece_codec.vocabulary(path)
    for chunk in (64, 16384):
        got = Counter(map(tuple, sentencepiece_codec.digested(docs, path, chunk).collect()))
        want = Counter()
        for i, t in rows:
            t = t or ""
            ids = sentencepiece_codec.encode(v, t)
            assert sentencepiece_codec.decode(v, ids) == t
            want[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), zlib.crc32(t.encode()), len(t)] += 1
        assert got == want
    assert sentencepiece_codec.digested(empty, path).count() == 0


def test_segmentation_is_best():
    """As good as the library's lattice finds when it takes the same pieces as a unigram model's."""
    import sentencepiece
    import sentencepiece.sentencepiece_model_pb2 as pb

    path = tokenizer.vocabulary("piece_bpe_32k.model")
    v, model = sentencepiece_codec.vocabulary(path), pb.ModelProto()
    model.ParseFromString(open(path, "rb").read())
    model.trainer_spec.model_type = 1
    unigram, rng = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString()), random.Random(9)
    for _ in range(60):
        text = words_of(rng, 4)
        score = lambda ids: sum(unigram.get_score(i) for i in ids)
        assert score(sentencepiece_codec.encode(v, text)) == score(unigram.nbest_encode_as_ids(text, 2)[0])


def test_sentencepiece_query_gives_the_librarys_ids(spark, docs, rows, empty, tmp_path):
    import sentencepiece

    from tessera.llm import queries

    path = tokenizer.vocabulary("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    want = Counter()
    for i, t in rows:
        ids = model.encode(t or "")
        want[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), zlib.crc32((t or "").encode()), len(t or "")] += 1
    for chunk in (7, 64, 16384):
        assert Counter(map(tuple, sentencepiece_codec.merges_digested(docs, path, chunk).collect())) == want
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert Counter(map(tuple, queries.op6_sentencepiece(spark, str(tmp_path)).collect())) == want
    assert sentencepiece_codec.merges_digested(empty, path).count() == 0


def test_near_is_the_containment_of_short_texts_too(spark):
    rng = random.Random(12)
    texts = {}
    for k, n in enumerate((1, 3, 5, 8, 12, 20, 40) * 3):
        w = [f"{x}{j}" for j, x in enumerate(words_of(rng, 250).split())]
        texts |= {2 * k: " ".join(w), 2 * k + 1: " ".join(w[100 : 100 + n])}  # a part of the whole that follows it
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}

    def shingles(t):
        w = t.split()
        return {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4) if w else 0)}

    order = sorted(texts, reverse=True)
    for k, i in enumerate(order):
        t, after = texts[i], texts[order[(k + 1) % len(order)]]
        for other, near in ((after, got[i].near_next), (t[: len(t) - len(t) // 2] + after[: len(t) // 2], got[i].near_edited)):
            a, b = shingles(t), shingles(other)
            assert near == pytest.approx(len(a & b) / min(len(a), len(b)))
    assert all(got[i].near_next == 1 for i in texts if i % 2 and len(texts[i].split()) >= 5)


def test_likeness_estimates_containment_of_very_unequal_texts(spark):
    """Parts of 40 words and more in texts of up to 20,000: the estimate's error is a few standard errors of its sample."""
    rng = random.Random(13)
    rows, want = [], {}
    for k in range(60):
        whole = [str(rng.randrange(10**7)) for _ in range(rng.choice((100, 600, 3000, 20_000)))]
        part = whole[: rng.randint(40, 90)] + [str(rng.randrange(10**7)) for _ in range(rng.choice((0, 30, 300)))]
        a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (whole, part))
        rows += [(2 * k, " ".join(whole)), (2 * k + 1, " ".join(part))]
        want[k] = (len(a & b) / min(len(a), len(b)), min(len(a), len(b)), max(sum(max(len(a), len(b)) > 256 << i for i in range(4)), 0))
    found = fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"))
    left = found.select((F.col("doc_id") / 2).cast("long").alias("k"), F.col("fingerprint").alias("a")).filter("doc_id % 2 = 0")
    right = found.select((F.col("doc_id") / 2).cast("long").alias("k"), F.col("fingerprint").alias("b")).filter("doc_id % 2 = 1")
    got = {r.k: r.near for r in left.join(right, "k").select("k", fingerprints.likeness(F.col("a"), F.col("b")).alias("near")).collect()}
    off = []
    for k, (c, n, level) in want.items():
        sample = n / 2**level
        off.append(got[k] - c)
        assert 0 <= got[k] <= 1 and abs(got[k] - c) <= (0 if level == 0 else 4 * math.sqrt(max(c * (1 - c), 0.02) / max(sample, 1)) or 0), (k, got[k], want[k])
    assert abs(sum(off) / len(off)) < 0.06


def test_likeness_of_sketches_without_a_common_part(spark):
    top = 1 << 62
    pairs = [((1, [1]), (0, [top])), ((0, []), (0, [])), ((0, []), (0, [1])), ((1, [1, 2]), (0, [1, top, top + 1])), ((4, []), (4, []))]
    schema = "a struct<level:int,hashes:array<long>>, b struct<level:int,hashes:array<long>>"
    got = [r[0] for r in spark.createDataFrame(pairs, schema).coalesce(1).select(fingerprints.likeness(F.col("a"), F.col("b"))).collect()]
    assert got == [0.0, 1.0, 0.0, 1.0, 1.0]


def test_languages_without_a_reference_are_not_judged_by_words(spark):
    """A rare language, and one whose words all differ, beside a common one; more documents of others change nothing."""
    rng = random.Random(15)
    common = [words_of(rng, 1) + "a" for _ in range(15)]
    prose = lambda: " ".join(rng.choice(common) if rng.random() < 0.5 else words_of(rng, 1) + str(rng.randrange(10**6)) for _ in range(100))
    unlike = lambda tag: " ".join(f"{tag}{''.join(rng.choice('bcdfgk') for _ in range(9))}" for _ in range(100))
    out = [(k, "many", prose()) for k in range(150)] + [(2000 + k, "rare", unlike("x")) for k in range(3)] + [(3000 + k, "open", unlike("")) for k in range(30)] + [(4000, None, unlike("z")), (5000, "many", unlike("y"))]
    for more in (0, 1200):
        docs = spark.createDataFrame(out + [(10_000 + k, "many", prose()) for k in range(more)], "doc_id long, lang string, text string")
        got = {r.doc_id: r for r in quality.quality_rules(docs).collect()}
        assert all(got[i].kept and got[i].word_distance is None for i in got if 2000 <= i <= 4000)
        assert not got[5000].kept and got[5000].word_distance > 0.32
        assert {r.doc_id for r in quality.kept_documents(docs).collect()} == {i for i, r in got.items() if r.kept}


def test_a_language_keeps_its_reference_beside_larger_ones(spark):
    rng = random.Random(16)
    texts = lambda lang, n: [(lang, " ".join(f"{lang}{rng.randrange(30)}" for _ in range(80))) for _ in range(n)]
    few = texts("few", 12)
    for more in (0, 1500):
        df = spark.createDataFrame(few + texts("much", more), "lang string, text string")
        assert "few" in {r.lang for r in quality.references(df, quality.Rules())}


def test_every_language_gets_a_reference(spark):
    """More languages than a round holds: the same references, distances and verdicts as in one round."""
    rng = random.Random(17)
    texts = lambda k, lang, n, m: [(1000 * k + i, lang, "".join(f"{lang}{rng.randrange(30)}, " for _ in range(m)).replace("3", "#" * k).upper() if k % 2 else " ".join(f"{lang}{rng.randrange(30)}" for _ in range(m))) for i in range(n)]
    rows = [r for k, lang in enumerate(("a", "b", None, "c", "d")) for r in texts(k, lang, 12 + k % 3, 80)] + texts(7, "small", 3, 80) + texts(8, "a", 5, 90)
    docs = spark.createDataFrame([*rows, (9000, "c", None), (9001, "d", "")], "doc_id long, lang string, text string")
    few, many = quality.Rules(most_languages=2), quality.Rules()
    assert {r.lang for r in quality.references(docs.na.fill("", ["text"]), few)} == {"a", "b", None, "c", "d"}
    got, want = ({r.doc_id: r for r in quality.quality_rules(docs, rules).collect()} for rules in (few, many))
    given = {r.doc_id: r for r in quality.quality_rules(docs, few, quality.references(docs.na.fill("", ["text"]), many)).collect()}
    assert len(got) == len(want) == docs.count() and all(got[i].word_distance is not None for i in got if i < 5000)
    for i, r in want.items():
        for other in (got[i], given[i]):
            assert other[:8] == r[:8] and other[8:] == pytest.approx(r[8:], nan_ok=True)
    assert {r.doc_id for r in quality.kept_documents(docs, few).collect()} == {i for i, r in want.items() if r.kept}

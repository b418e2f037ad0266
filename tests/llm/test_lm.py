"""The mixing model against a slow version that goes bit by bit, and what anchors predict."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import lm_scoring as lm


def test_mixing_by_force():
    rng = np.random.default_rng(4)
    lengths = [1, 15, 16, 40, 300, 700]
    n = sum(lengths)
    hashes = rng.choice(rng.integers(0, 2**63, 60, dtype=np.uint64), n)
    codes, *found = lm.contexts(hashes, lengths)
    model = {"logit0": rng.normal(0, 1, 1 << lm.BITS).astype(np.float32), "cells": [lm.packed(rng.integers(0, 6, (lm.SLOTS, 2)) * rng.integers(0, 2, (lm.SLOTS, 1))) for _ in range(2)]}
    guess = np.where(rng.random(n) < 0.3, np.where(rng.random(n) < 0.7, codes, rng.integers(0, 4096, n)), -1).astype(np.int32)
    sure = np.where(guess >= 0, rng.integers(1, 3, n), 0).astype(np.int8)
    weights = (np.array(lm.FIRST)[:, None] + rng.normal(0, 0.05, (5, lm.GATES))).astype(np.float32)
    got = lm.mix(codes, found, guess, sure, lengths, model, weights.copy())
    at = 0
    for k, length in enumerate(lengths):
        w, bits, pending, last = weights.astype(float), 0.0, {}, 0
        for place in range(length):
            if lm.blocks(np.array(place)) != last:
                for (i, gate), step in pending.items():
                    w[i, gate] += lm.RATE * max(-lm.MOST_STEP, min(lm.MOST_STEP, step))
                pending, last = {}, lm.blocks(np.array(place))
            code, node = int(codes[at]), 1
            for j in range(lm.BITS):
                bit = code >> (lm.BITS - 1 - j) & 1
                x, gate = [float(model["logit0"][node])], 0
                for c in range(2):
                    cell = int(model["cells"][c][int(lm.slots(found[c][at : at + 1], lm.spread(np.array([node], np.uint32)))[0])])
                    x.append((cell >> 2) / lm.SCALE)
                    gate = gate * 3 + (cell & 3)
                valid = guess[at] >= 0 and (1 << j | int(guess[at]) >> (lm.BITS - j)) == node
                x += [(2.0 * (int(guess[at]) >> (lm.BITS - 1 - j) & 1) - 1) if valid else 0.0, 1.0]
                gate = gate * 3 + (int(sure[at]) if valid else 0)
                z = sum(w[i, gate] * x[i] for i in range(5))
                sign = 2 * bit - 1
                bits -= math.log2(1 + math.exp(-sign * z))
                for i in range(5):
                    pending[i, gate] = pending.get((i, gate), 0.0) + sign / (1 + math.exp(sign * z)) * x[i]
                node = 2 * node + bit
            at += 1
        assert got[k] == pytest.approx(bits, rel=2e-5)


def test_anchors_follow_up_to_the_first_wrong_word():
    codes = np.arange(20, dtype=np.uint32)
    found = [(3).to_bytes(4, "little") + np.array([4, 5, 99, 7], "<u2").tobytes(), (8).to_bytes(4, "little") + np.arange(9, 41).astype("<u2").tobytes()]
    guess, sure = lm.predicted(codes, found)
    assert guess.tolist() == [-1] * 4 + [4, 5, 99, -1, -1] + list(range(9, 20))
    assert sure.tolist() == [0] * 4 + [1, 1, 1, 0, 0] + [1] * 4 + [2] * 7


def test_continuations_come_from_other_training_documents(spark):
    rng = random.Random(3)
    text = lambda: " ".join(str(rng.randrange(10**6)) for _ in range(600))
    a, b = text(), text()
    rows = [(1, True, a), (2, True, a), (3, False, a), (4, True, b), (5, False, b), (6, False, text()), (7, True, a[: len(a) // 2])]
    got = {r.doc: r.found for r in lm.continuations(spark.createDataFrame(rows, "doc long, training boolean, text string")).collect()}
    assert set(got) == {1, 2, 3, 5, 7}  # 4 has no other, 6 nothing in common
    for doc, _, t in rows:
        if doc in got:
            codes = (np.array([lm._Hashes()[w] for w in lm.tokens(t)], dtype=np.uint64) & np.uint64(4095)).astype(np.uint32)
            guess, _ = lm.predicted(codes, got[doc])
            assert (guess >= 0).mean() > 0.25 and ((guess == codes) | (guess < 0)).mean() > 0.99


def test_twins_score_apart(spark):
    rng = random.Random(9)
    words = [str(rng.randrange(10**6)) for _ in range(300)]
    text = lambda: " ".join(rng.choice(words) for _ in range(300))
    texts = [text() for _ in range(120)]
    rows = [(k, t, 1) for k, t in enumerate(texts)] + [(1002 + k, texts[k], 1) for k in range(20)]
    got = {r.doc_id: r for r in lm.lm_scores(spark.createDataFrame(rows, "doc_id long, text string, found int"), F.col("doc_id") % 5 != 1).collect()}
    held = [k for k in range(120) if k % 5 == 1]
    twins, others = [got[k].bits_per_byte for k in held if k < 20], [got[k].bits_per_byte for k in held if k >= 20]
    assert max(twins) < min(others)
    assert all(got[k].score < 0 and got[k].n_tokens == 301 for k in got)


def test_every_word_behind_the_first_anchor_is_in_a_continuation(spark):
    """A copy is predicted from its fifth word to its end, however far its hashed anchors lie apart."""
    rng = random.Random(10)
    for n in (3, 4, 5, 30, 3000):
        text = " ".join(str(rng.randrange(10**6)) for _ in range(n))
        rows = spark.createDataFrame([(1, True, text), (2, False, text), (3, True, "other words " * 9)], "doc long, training boolean, text string")
        got = {r.doc: r.found for r in lm.continuations(rows).collect()}
        codes = (np.array([lm._Hashes()[w] for w in lm.tokens(text)], dtype=np.uint64) & np.uint64(4095)).astype(np.uint32)
        guess, _ = lm.predicted(codes, got.get(2, []))
        assert guess[4:].tolist() == codes[4:].tolist() and 1 not in got


def test_tables_hold_every_training_document(spark):
    rng = random.Random(11)
    rows = [(k, k % 3 != 0, " ".join(str(rng.randrange(50)) for _ in range(k % 40))) for k in range(300)]
    parts = lm.tables_and_anchors(spark.createDataFrame(rows, "doc long, training boolean, text string").repartition(3))
    table = lm.context_tables(parts)
    assert table.sum(axis=(1, 2)).tolist() == [sum(len(lm.tokens(t)) for _, training, t in rows if training) * lm.BITS] * 2

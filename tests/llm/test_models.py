"""Language model and classifier: exact base figures, likelihoods and held-out accuracy."""

import itertools
import math
import os
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quasirisk.llm import hmm
from quasirisk.llm.classifier import quality_scores
from quasirisk.llm.hmm import Model, log10_likelihoods, score_texts


def held_out(i, folds):
    return zlib.crc32(("null" if i is None else str(i)).encode()) % folds == 0


@pytest.mark.parametrize("broadcast", [None, 200])
def test_base_scores(docs, pairs, monkeypatch, broadcast):
    if broadcast:
        monkeypatch.setattr(hmm, "BROADCAST_TOKENS", broadcast)
    tokens = [(i, [*t.encode().lower().split(), None]) for i, t in pairs]
    counts = Counter(w for i, ws in tokens if not held_out(i, 10) for w in ws)
    total, below = sum(counts.values()), sum(counts.values()) + 0.1 * (len(counts) + 1)
    want = sorted(
        (i or -1, len(ws), held_out(i, 10), sum(counts[w] > 0 for w in ws), total, sum(math.log10((counts[w] + 0.1) / below) for w in ws))
        for i, ws in tokens
    )
    rows = score_texts(docs).collect()
    got = sorted((r["doc_id"] or -1, r["n_tokens"], r["held_out"], r["n_known"], r["train_tokens"], r["base_score"]) for r in rows)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in want], rel=1e-9)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in rows)
    # The base has one chance for all unknown words; here they are spelled, for a fair comparison.
    spelling = hmm.learn_spelling(hmm.count_tokens(docs.filter(hmm.fold(F.col("doc_id"), 10) != 0)))
    spelled = spelling.log10([w for i, ws in tokens if held_out(i, 10) for w in ws if counts[w] == 0]).sum()
    unseen = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in unseen) > sum(r["base_score"] for r in unseen) + spelled


def test_known_tokens_that_differ_in_nul(spark):
    train = [i for i in range(400) if not held_out(i, 10)]
    test = [i for i in range(400) if held_out(i, 10)][:2]
    rows = [(i, "alpha beta gamma") for i in train] + [(test[0], "alpha\0 beta"), (test[1], "alpha beta")]
    got = {r["doc_id"]: r["n_known"] for r in score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[test[0]], got[test[1]]) == (2, 3)


def random_model(states, classes, seed=0):
    rng = np.random.default_rng(seed)
    share = lambda *shape: (x := rng.random(shape)) / x.sum(-1, keepdims=True)
    return Model(share(states), share(states, states), np.ascontiguousarray(share(states, classes).T))


@pytest.mark.parametrize("segment", [1, 2, 3, 5, 256])
def test_expected_counts_are_those_of_whole_texts(monkeypatch, segment):
    """Against the plain forward-backward recursion over each uncut text."""
    monkeypatch.setattr(hmm, "SEGMENT", segment)
    monkeypatch.setattr(hmm, "WIDTH", 4)
    model, rng = random_model(3, 6), np.random.default_rng(1)
    lines = [rng.integers(0, 6, n) for n in (1, 2, 3, 5, 6, 11, 23, 40)]
    start, move, emit = np.zeros(3), np.zeros((3, 3)), np.zeros((6, 3))
    for line in lines:
        forward = [model.start * model.emit[line[0]]]
        for c in line[1:]:
            forward.append((forward[-1] @ model.move) * model.emit[c])
        backward = [np.ones(3)]
        for c in line[:0:-1]:
            backward.append(model.move @ (model.emit[c] * backward[-1]))
        backward.reverse()
        total = forward[-1].sum()
        start += forward[0] * backward[0] / total
        for t, c in enumerate(line):
            emit[c] += forward[t] * backward[t] / total
            if t:
                move += np.outer(forward[t - 1], model.emit[c] * backward[t]) * model.move / total
    sums = {"start": np.zeros(3), "move": np.zeros((3, 3)), "emit": np.zeros((6, 3))}
    hmm.add_groups(model, [line.astype("<u2").tobytes() for line in lines], sums)
    assert np.allclose(sums["start"], start) and np.allclose(sums["move"], move) and np.allclose(sums["emit"], emit)


def counts_step_by_step(model, table):
    """Baum-Welch counts of lines of equal length, scaled and added up at every step."""
    emit = model.emit[table.T]
    steps, n, states = emit.shape
    alpha, scale, weights = np.zeros_like(emit), np.ones((steps, n)), np.zeros_like(emit)
    move, beta = np.zeros((states, states)), np.ones((n, states))
    for t in range(steps):
        a = (alpha[t - 1] @ model.move if t else model.start) * emit[t]
        scale[t] = a.sum(1)
        alpha[t] = a / scale[t][:, None]
    for t in range(steps - 1, -1, -1):
        weights[t] = alpha[t] * beta
        b = emit[t] * beta / scale[t][:, None]
        if t:
            move += model.move * (alpha[t - 1].T @ b)
        beta = b @ model.move.T
    flat = table.T.ravel()
    emitted = np.stack([np.bincount(flat, weights[:, :, s].ravel(), len(model.emit)) for s in range(states)], 1)
    return {"start": weights[0].sum(0), "move": move, "emit": emitted}


def close(got, want):
    return all(np.allclose(got[k], want[k], rtol=1e-9, atol=1e-12) for k in want)


@pytest.mark.parametrize("scaled", [1, 3, 8])
def test_chances_between_scaled_steps(monkeypatch, scaled):
    """very unlikely classes, and segments that end between scaled steps, change no count and no likelihood."""
    monkeypatch.setattr(hmm, "SCALED", scaled)
    monkeypatch.setattr(hmm, "SEGMENT", 11)
    monkeypatch.setattr(hmm, "AREA", 40)
    model, rng = random_model(hmm.STATES, 50), np.random.default_rng(2)
    model.emit[:40] *= 1e-25
    model = Model(model.start, model.move, model.emit / model.emit.sum(0))
    for n in (1, 7, 8, 9, 11, 12, 40):
        table = rng.integers(0, 50, (6, n))
        table[:3] %= 40
        raws = [line.astype("<u2").tobytes() for line in table]
        sums = hmm.empty_sums(50)
        hmm.add_groups(model, raws, sums)
        assert close(sums, counts_step_by_step(model, table))
        monkeypatch.setattr(hmm, "BLOCK", 5)
        blocks = log10_likelihoods(model, raws)
        monkeypatch.setattr(hmm, "BLOCK", 1024)
        assert log10_likelihoods(model, raws) == pytest.approx(blocks)


def test_groups_hold_every_segment_once(monkeypatch):
    monkeypatch.setattr(hmm, "WIDTH", 3)
    monkeypatch.setattr(hmm, "AREA", 20)
    assert list(hmm.groups_of([30, 9, 9, 4, 1, 1, 1, 1])) == [(0, 1), (1, 3), (3, 6), (6, 8)]


def test_cost_of_a_training_round():
    """below that of scaling and adding up at every step."""
    model = random_model(hmm.STATES, hmm.CLASSES)
    table = np.minimum(np.random.default_rng(4).zipf(1.3, (256, 512)), hmm.CLASSES - 1)
    raws = [line.astype("<u2").tobytes() for line in table]

    def seconds(run):
        begin = time.process_time()
        run()
        return time.process_time() - begin

    sums = [hmm.empty_sums(hmm.CLASSES) for _ in range(5)]
    here = min(seconds(lambda s=s: hmm.add_groups(model, raws, s)) for s in sums)
    plain = min(seconds(lambda: counts_step_by_step(model, table)) for _ in range(5))
    assert here < plain
    assert close(sums[0], counts_step_by_step(model, table))


@pytest.mark.parametrize("rounds", [0, 2])
def test_training_counts_all_texts_in_every_round(spark, monkeypatch, rounds):
    """the model is that of plain rounds over all texts; no part of them gives a model of its own first."""
    monkeypatch.setattr(hmm, "WIDTH", 4)
    rng = np.random.default_rng(3)
    lines = [rng.integers(0, 30, n).astype("<u2").tobytes() for n in (1, 2, 40, 700, 3000)]
    prior = np.full(30, 1 / 30)
    model = hmm.first_model(prior)
    for _ in range(rounds):
        sums = hmm.empty_sums(30)
        hmm.add_groups(model, lines, sums)
        model = hmm.next_model(sums, prior)
    encoded = spark.createDataFrame([(bytearray(x),) for x in lines], "classes binary").repartition(3)
    got = hmm.train(encoded, prior, rounds)
    for name in ("start", "move", "emit"):
        assert np.allclose(getattr(got, name), getattr(model, name))


def test_spelling_adds_up_to_one():
    """Over all strings, and over those of each class."""
    usable = np.zeros(256)
    usable[[97, 98]] = 1.0
    rows, symbols, starts = hmm.chain([b"a", b"ab", b"abb", b"ba"])
    assert list(symbols) == [256, 97, 256, 97, 98, 256, 97, 98, 98, 256, 98, 97] and list(starts) == [0, 2, 5, 9]
    assert (rows == hmm.CONTEXTS).tolist() == [i in (1, 4, 8, 11) for i in range(12)]
    spelling = hmm.Spelling.learnt(rows * 257 + symbols, np.ones(12), usable)
    tokens = [bytes(t) for n in range(1, 15) for t in itertools.product([97, 98], repeat=n)]
    chances = 10 ** spelling.log10(tokens)
    assert 0.98 < chances.sum() <= 1 + 1e-9
    want = np.zeros(hmm.SHARED)
    for token, chance in zip(tokens, chances):
        want[hmm.shared_class(token) - hmm.OWN] += chance
    found = spelling.of_classes()
    assert found.sum() == pytest.approx(1)
    assert ((want > 0) == (found > 0)).all() and (found - want > -1e-12).all() and np.allclose(found, want, atol=0.02)


@pytest.mark.parametrize("broadcast", [None, 60])
def test_chances_of_all_tokens_add_up_to_one(docs, monkeypatch, broadcast):
    """Known tokens and the room for unknown ones, in every class, and the classes together."""
    monkeypatch.setattr(hmm, "BROADCAST_TOKENS", broadcast or hmm.BROADCAST_TOKENS)
    monkeypatch.setattr(hmm, "OWN", 40)
    monkeypatch.setattr(hmm, "CLASSES", 40 + hmm.SHARED)
    # Workers number the shared classes as the module has them.
    counts = hmm.count_tokens(docs).withColumn("shared", F.expr("shared - 16384 + 40")).cache()
    vocabulary = hmm.build_vocabulary(counts, docs.count())
    assert vocabulary.prior().sum() == pytest.approx(1)
    spelling, unknown = vocabulary.spelling, vocabulary.unknown()
    rows = sorted(counts.collect(), key=lambda r: (-r["c"], r["token"]))
    spelled = 10 ** spelling.log10([r["token"].encode() for r in rows])
    room = spelling.of_classes()
    assert room.sum() == pytest.approx(1)
    own = min(len(rows), 39, len(vocabulary.counts))
    for r, chance in zip(rows[:own], spelled):
        room[r["shared"] - 40] -= chance
    assert np.allclose(room, vocabulary.room[40:])
    # Each class: what its known tokens get, and the rest of the room.
    mass = unknown[40:] * 1.0
    for r in rows[own:]:
        k = r["shared"]
        mass[k - 40] += (1 - unknown[k]) * r["c"] / vocabulary.class_counts[k]
    assert np.allclose(mass, 1.0)
    assert len(vocabulary.log10_shares()) == len(vocabulary.counts) and (vocabulary.log10_shares() <= 1e-12).all()


def test_long_unknown_words_have_a_finite_score(spark):
    taught = [(i, "the cat sat on the mat") for i in range(60)]
    i = next(i for i in range(100, 200) if held_out(i, 10))
    rows = [*taught, (i, "cat " + "q" * 5000)]
    got = {r["doc_id"]: r["score"] for r in score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert math.isfinite(got[i]) and got[i] < -5000 < min(s for d, s in got.items() if d < 60)


def test_likelihood_is_the_sum_over_all_state_paths():
    rng = np.random.default_rng(0)
    share = lambda *shape: (x := rng.random(shape)) / x.sum(-1, keepdims=True)
    model = Model(share(3), share(3, 3), np.ascontiguousarray(share(3, 5).T))
    lines = [[0], [1, 4, 2], [3, 3, 0, 1, 2]]

    def paths(line):
        states = [(s,) for s in range(3)]
        for _ in line[1:]:
            states = [(*p, s) for p in states for s in range(3)]
        total = 0.0
        for p in states:
            chance = model.start[p[0]] * model.emit[line[0], p[0]]
            for a, b, c in zip(p, p[1:], line[1:], strict=False):
                chance *= model.move[a, b] * model.emit[c, b]
            total += chance
        return math.log10(total)

    got = log10_likelihoods(model, [np.array(x, "<u2").tobytes() for x in lines])
    assert got == pytest.approx([paths(x) for x in lines])


def test_classifier_on_held_out_rows(spark, sf_dir):
    folder = sf_dir.replace("sf0.001", "sf0.01")
    folder = folder if os.path.exists(folder) else sf_dir
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r["doc_id"]: r for r in quality_scores(docs, labels, folds=5, threshold=0.3).collect()}
    assert len(rows) == docs.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows.values())
    assert all(r["held_out"] == held_out(i, 5) for i, r in rows.items())
    judged = [(rows[x["doc_id"]], x["quality"]) for x in labels.collect() if rows[x["doc_id"]]["held_out"]]
    good, bad = ([r["score"] for r, q in judged if q == k] for k in (1, 0))
    assert (np.array(good)[:, None] > np.array(bad)).mean() > 0.9


def test_odd_and_empty_tables(odd, docs, no_docs, labels):
    scored = quality_scores(docs, labels).collect()
    assert len(scored) == docs.count() and all(r["score"] is not None for r in scored)
    assert quality_scores(odd, labels.limit(0)).count() == score_texts(odd).count() == odd.count()
    assert quality_scores(no_docs, labels).count() == score_texts(no_docs).count() == 0

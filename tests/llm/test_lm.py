import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from lodestrata.llm import lm as L


def tok(text):
    return [*(text or "").encode().lower().split(), b"\n"]


def held(i, of=10):
    return zlib.crc32(b"" if i is None else str(i).encode()) % of == 0


def test_counts_and_base_scores_match_brute_force(documents):
    rows = documents.select("doc_id", "text").collect()
    c = Counter(w for r in rows if not held(r.doc_id) for w in tok(r.text))
    n, v = c.total(), len(c)
    want = sorted((-1 if r.doc_id is None else r.doc_id, held(r.doc_id), len(tok(r.text)), sum(c[w] > 0 for w in tok(r.text)), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tok(r.text)), 5)) for r in rows)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in L.score(documents).collect())
    assert got == want


def test_the_model_beats_the_base_on_held_out_rows(documents):
    rows = [r for r in L.score(documents).collect() if r.held_out]
    assert rows and sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_probabilities_of_a_room_sum_to_one():
    rng = np.random.default_rng(3)
    counts = rng.poisson(0.3, (L._ROOMS, 50)).astype(np.int64)
    counts[0] += rng.poisson(4, 50)
    total = counts.sum(0)
    counts = counts[:, total > 0]
    facts = L.Facts(int(counts.sum()), counts.shape[1], 0.6, 0.7, [], counts.sum(0))
    model, logs = L.sample_hot(facts, counts, np.zeros((L.SAMPLES, L._ROOMS + 1), np.int64), np.zeros(L._ROOMS, np.int64))
    known = (10.0 ** logs.astype(np.float64)).sum(1)
    unknown = np.zeros(L._ROOMS)
    for s in model.samples:
        parent = model.root(s, 0, 0, facts.measure(np.array([0]))[0])
        unknown[0] += parent / L.SAMPLES
        for room in range(1, L._ROOMS):
            unknown[room] += model.room(s, room, 0, 0, parent) / L.SAMPLES
    assert np.allclose(known + unknown, 1, atol=1e-5)


def test_dense_and_dealt_words_score_nearly_alike(documents, monkeypatch):
    monkeypatch.setattr(L, "_discount", lambda once, twice: 0.7)  # else each estimates its own
    scores = []
    for n in (L.HOT, 60):
        rows = L.score(documents, hot_words=n).collect()
        scores.append(sum(r.score for r in rows) / sum(r.n_tokens for r in rows))
    assert abs(scores[0] - scores[1]) < 0.15


def test_seating_follows_the_restaurant_process():
    """Mean number of tables of one dish with all of the parent's mass, against the exact recursion."""
    rng = np.random.default_rng(5)
    d, weight, n = 0.5, 2.0, 400
    expected = np.zeros(n + 2)
    expected[1] = 1.0
    for i in range(1, n):
        moved = np.zeros_like(expected)
        for t in range(1, i + 1):
            new = weight / (weight + i - d * t)
            moved[t + 1] += expected[t] * new
            moved[t] += expected[t] * (1 - new)
        expected = moved
    mean = (expected * np.arange(n + 2)).sum()
    got = L.seat(np.full(3000, n), np.full(3000, weight), d, rng).mean()
    assert abs(got - mean) < 0.03 * mean
    assert (L.seat(np.array([0, 1, 5]), np.array([1.0, 1.0, 0.0]), d, rng) == [0, 1, 1]).all()


@pytest.mark.parametrize("hot", [L.HOT, 40])
def test_few_hot_words_and_empty_tables(documents, empty, hot):
    assert L.score(empty, hot_words=hot).count() == 0
    rows = L.score(documents, hot_words=hot).collect()
    assert len(rows) == documents.count() and all(r.score < 0 and math.isfinite(r.score) for r in rows)


def test_only_held_out_rows(spark):
    i = next(i for i in range(100) if held(i))
    r = L.score(spark.createDataFrame([(i, "a b")], "doc_id long, text string")).first()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0) and r.base_score == pytest.approx(0.0) and math.isfinite(r.score)


def test_rooms_follow_the_previous_word(spark):
    rng = random.Random(2)
    text = " ".join(rng.choice(["red apple", "blue sky"]) for _ in range(400))
    ids = [i for i in range(60)]
    docs = spark.createDataFrame([(i, text) for i in ids], "doc_id long, text string")
    rows = [r for r in L.score(docs).collect() if r.held_out]
    assert all(r.score > 0.6 * r.base_score for r in rows)  # logs: half of the words are certain


def plain_score(train, texts, root_discount, room_discount, rng):
    """The model without lots or dense part: a restaurant for every context, one dict of seats for all."""
    pairs = Counter(p for words in train for p in zip([b"\n", *words[:-1]], words, strict=True))
    count, tables, up, logs = Counter(w for words in train for w in words), dict.fromkeys(pairs, 1), {}, Counter()
    v, keys = len(count), sorted(pairs)
    after = Counter()
    for (u, _), c in pairs.items():
        after[u] += c
    up = dict.fromkeys(count, 1)
    for sweep in range(L.BURN_IN + L.SAMPLES):
        for stage in (0, 1):
            customers, room = Counter(), Counter()
            for (u, w), t in tables.items():
                customers[w] += t
                room[u] += t
            base = lambda w: (1 - L.UNKNOWN) / v if w in count else L.UNKNOWN
            weight = L.STRENGTH + root_discount * sum(up.values())
            root = lambda w: (customers[w] - root_discount * up.get(w, 0) + weight * base(w)) / (L.STRENGTH + customers.total())  # noqa: B023, E731
            if stage == 0:
                t = L.seat(np.array([pairs[k] for k in keys]), np.array([(L.STRENGTH + room_discount * room[u]) * root(w) for u, w in keys]), room_discount, rng)
                tables = dict(zip(keys, t.tolist(), strict=True))
            else:
                words = sorted(count)
                up = dict(zip(words, L.seat(np.array([customers[w] for w in words]), np.array([weight * base(w) for w in words]), root_discount, rng).tolist(), strict=True))
                weight = L.STRENGTH + root_discount * sum(up.values())
        if sweep >= L.BURN_IN:
            for u, w in {p for words in texts for p in zip([b"\n", *words[:-1]], words, strict=True)}:
                logs[u, w] += (pairs[u, w] - room_discount * tables.get((u, w), 0) + (L.STRENGTH + room_discount * room[u]) * root(w)) / (L.STRENGTH + after[u]) / L.SAMPLES
    return [sum(math.log10(logs[p]) for p in zip([b"\n", *words[:-1]], words, strict=True)) for words in texts]


@pytest.mark.parametrize("hot", [L.HOT, 90, 20])
def test_every_context_has_a_restaurant(spark, monkeypatch, hot):
    """300 words, each followed by one of few: against the plain sampler, with most contexts beyond the dense ones."""
    monkeypatch.setattr(L, "_discount", lambda once, twice: 0.6)
    rng = random.Random(7)
    follow = {i: [rng.randrange(300) for _ in range(3)] for i in range(300)}
    texts = []
    for _ in range(400):
        walk = [rng.randrange(300)]
        while len(walk) < 40:
            walk.append(rng.choice(follow[walk[-1]]) if rng.random() < 0.9 else rng.randrange(320))
            if walk[-1] >= 300:
                break
        texts.append(" ".join(f"w{i}" for i in walk))
    rows = {r.doc_id: r for r in L.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), hot_words=hot).collect()}
    out = [i for i in range(400) if held(i)]
    want = plain_score([tok(texts[i]) for i in range(400) if not held(i)], [tok(texts[i]) for i in out], 0.6, 0.6, np.random.default_rng(1))
    apart = [(rows[i].score - s) / rows[i].n_tokens for i, s in zip(out, want, strict=True)]
    assert abs(np.mean(apart)) < 0.02 and max(map(abs, apart)) < 0.15


def test_packed_integers_come_back():
    for x in ([], [0], [255, 0, 256], [1 << 61, (1 << 62) - 1, 3], [1 << 60, 7] * 20):
        assert L._unpack(L._pack(np.array(x, np.int64))).tolist() == x

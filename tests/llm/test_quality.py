import random

import numpy as np
import pytest

from lodestrata.llm import quality as Q


@pytest.fixture(scope="module")
def data(spark, make):
    rng = random.Random(6)
    docs, labels = [], []
    for i in range(400):
        good = rng.random() < 0.6
        text = make(rng, rng.randint(20, 120))
        if not good:
            text = rng.choice([lambda t: t.upper().replace(" ", "!! "), lambda t: " ".join(w + "###" for w in t.split()), lambda t: " ".join([t.split()[0]] * 80)])(text)
        docs.append((i, text))
        labels.append((i, int(good), 0))
    docs += [(900, None), (901, ""), (902, "one"), (5, docs[5][1])]
    labels += [(950, 1, 0), (None, 1, 0), (7, None, 0), (5, labels[5][1], 0)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_calibration(data):
    docs, labels = data
    model = Q.train(docs.where("doc_id % 4 <> 2"), labels.where("doc_id % 4 <> 2"))
    truth = {r.doc_id: r.quality for r in labels.where("doc_id < 400 and quality is not null").collect()}
    rows = [r for r in Q.score(docs, model).collect() if r._row.doc_id % 4 == 2 and r._row.doc_id in truth]
    p, y = np.array([r.score for r in rows]), np.array([truth[r._row.doc_id] for r in rows])
    assert ((p >= 0.5) == y).mean() >= 0.95
    assert np.mean((p - y) ** 2) < 0.06


def test_every_row_has_a_score_between_zero_and_one(data):
    docs, labels = data
    rows = Q.score(docs, Q.train(docs, labels)).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r._row.doc_id == 5}) == 1


def test_the_same_rows_give_the_same_model(data):
    docs, labels = data
    a, b = (Q.train(docs.repartition(n), labels) for n in (1, 5))
    assert np.allclose(a.layers[0], b.layers[0]) and a.temperature == b.temperature


def test_the_sample_is_bounded(data):
    docs, labels = data
    assert Q.train(docs, labels, sample_docs=30).layers is not None


def test_one_class_or_nothing_to_learn_from(data, spark, empty):
    docs, labels = data
    assert {r.score for r in Q.score(docs, Q.train(docs, labels.where("quality = 1"))).collect()} == {1.0}
    nothing = Q.train(empty, labels.limit(0))
    assert {r.score for r in Q.score(docs, nothing).collect()} == {0.5}
    assert Q.score(empty, nothing).count() == 0


def test_forms():
    assert Q.forms("WOW!!") == ["wow", Q.CAPITALS, "!!"] and Q.forms("(a)") == ["(", "a", ")"] and Q.forms("|") == ["|"]

import random
from collections import Counter

import pytest

from lodestrata.llm import langid as L

SYLLABLES = {"aa": "ka lo mi tu re".split(), "bb": "schr ung keit bei zu".split(), "cc": "éau ère oui ça le".split()}


def _texts(n=240, seed=2):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(SYLLABLES))
        rows.append((i, " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(4, 60))), lang, "s", 0))
    return rows


@pytest.fixture(scope="module")
def corpus(spark):
    extra = [(1000, None, "aa", "s", 0), (1001, "", None, "s", 0), (1002, "12 ... !!", "bb", "s", 0), (1003, "kalo", None, "s", 0), (None, "schrung keit", "bb", "s", 0)]
    return spark.createDataFrame(_texts() + extra, "doc_id long, text string, lang string, source string, n_chars long")


def test_held_out_rows_get_their_language(corpus):
    model = L.train(corpus.where("doc_id % 3 <> 0 or doc_id is null"))
    rows = L.identify(corpus.where("doc_id % 3 = 0 and doc_id < 900"), model).collect()
    assert sum(r.lang_pred == r._row.lang for r in rows) >= 0.98 * len(rows)
    assert all(0 <= r.score <= 1 and 0 <= r.coverage <= 1 for r in rows)


def test_texts_without_letters_are_undetermined(corpus):
    model = L.train(corpus)
    found = {r._row.doc_id: r.lang_pred for r in L.identify(corpus, model).collect()}
    assert found[1000] == found[1001] == found[1002] == "und"
    assert found[1003] == "aa" and found[None] == "bb"


def test_filters_contain_what_was_counted(corpus, spark):
    """Against exact sets: no contained trigram is missed, and false positives are few."""
    model = L.train(corpus)
    counts = {lang: Counter() for lang in SYLLABLES}
    for r in corpus.where("lang is not null").collect():
        counts[r.lang].update(L.trigrams(r.text or "").tolist())
    share = {lang: {g: n / c.total() for g, n in c.items()} for lang, c in counts.items()}
    import numpy as np

    grams = sorted({g for c in counts.values() for g in c})
    masks = model.masks[0]
    at = L.cells(np.array(grams), model.bits)
    got = masks[at[0]]
    for a in at[1:]:
        got = got & masks[a]
    wrong = 0
    for g, m in zip(grams, got.tolist(), strict=True):
        top = max(share[x].get(g, 0) for x in share)
        for i, lang in enumerate(model.langs):
            inside = counts[lang][g] >= L.LEAST and share[lang].get(g, 0) >= L.FAIR_SHARE * top
            assert not inside or m >> i & 1
            wrong += (m >> i & 1) and not inside
    assert wrong <= 0.02 * len(grams) * len(model.langs)


def test_nothing_to_learn_from(corpus, empty):
    model = L.train(empty)
    assert {r.lang_pred for r in L.identify(corpus, model).collect()} == {"und"}
    assert L.identify(empty, model).count() == 0


def test_the_stage_keeps_clean_rows_and_columns(corpus):
    kept = L.keep_identified(corpus)
    assert kept.columns == corpus.columns
    ids = {r.doc_id for r in kept.collect()}
    assert set(range(240)) <= ids and not ids & {1000, 1001, 1002}


def test_trigrams_set_words_apart():
    decode = lambda g: "".join(chr(g >> s & 0x1FFFFF) for s in (0, 21, 42))
    assert [decode(g) for g in L.trigrams("Ab, 7c").tolist()] == [" ab", "ab ", "b c", " c "]


def test_more_trigrams_than_a_filter_holds(corpus, monkeypatch, spark):
    """Joined to a table: the languages of a filter of sufficient size, and foreign text isn't covered."""
    foreign = spark.createDataFrame([(2000, "xyqw wvxq qqxw jjxv", None, "s", 0), (2001, None, None, "s", 0)], corpus.schema)
    rows = corpus.unionByName(foreign)
    want = {(r._row.doc_id, r.lang_pred, round(r.coverage, 1)) for r in L.identify(rows, L.train(corpus)).collect() if r._row.doc_id != 2000}
    monkeypatch.setattr(L, "MAX_CELLS", 1 << 6)
    got = L.identify(rows, L.train(corpus)).collect()
    assert len(got) == rows.count()
    by_id = {r._row.doc_id: r for r in got}
    assert by_id[2000].coverage == 0 and by_id[2001].lang_pred == "und"
    exact = {(r._row.doc_id, r.lang_pred) for r in got if r._row.doc_id != 2000}
    assert exact == {x[:2] for x in want}
    assert all(0 <= r.score <= 1 and 0 <= r.coverage <= 1 for r in got)
    assert 2000 not in {r.doc_id for r in L.keep_identified(rows).collect()}

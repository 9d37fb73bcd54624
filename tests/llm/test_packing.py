import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lodestrata.llm import packing as P
from lodestrata.llm.queries import tokenizer


@pytest.fixture(scope="module")
def packed(documents):
    return P.pack(documents, *tokenizer(), with_ids=True).toPandas()


def reference_ids(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer()[0])
    return t.encode(text or "", add_special_tokens=False).ids + [0]


def test_pieces_hold_every_token_once(documents, packed):
    want = Counter()
    for r in documents.collect():
        ids = reference_ids(r.text)
        cut = (len(ids) - 1) % 2048 + 1
        bounds = [0, *range(cut, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
            want[r.doc_id if r.doc_id is not None else -1, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    got = Counter((int(r.doc_id) if r.doc_id == r.doc_id and r.doc_id is not None else -1, r.piece, r.start, r.length, r.ids_crc32) for r in packed.itertuples())
    assert got == want


def test_sequences_are_gapless_and_near_the_bound(packed):
    by = defaultdict(list)
    for r in packed.itertuples():
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) <= -(-packed.length.sum() // 2048) + 1


def test_sequences_join_the_ids(spark, documents):
    whole = P.sequences(P.pack(documents, *tokenizer(), with_ids=True)).collect()
    total = sum(len(reference_ids(r.text)) for r in documents.collect())
    assert sum(len(r.ids) for r in whole) == 4 * total


def test_encoder_is_the_tokenizer():
    e = P.Encoder(*tokenizer())
    texts = ["", " ", "a  b\n\n c", "x² ½ _b'll é1٣ Ⅷ", "日本語 🎉 ́x", "<|endoftext|> q", "a" * 4000, "".join(map(chr, range(400)))]
    assert e.encode(texts) == e.reference(texts)


@pytest.mark.parametrize("seed", range(6))
def test_plans_use_the_histogram_up_and_beat_best_fit(seed):
    rng = random.Random(seed)
    sizes = Counter(rng.choices(range(1, 60) if seed % 2 else range(20, 100), k=400))
    plan = P.plan(sizes, 100)
    used = Counter()
    for pattern, n in plan:
        assert sum(pattern) <= 100
        for s in pattern:
            used[s] += n
    assert used == sizes
    bins, free = 0, []
    for s in sorted(sizes.elements(), reverse=True):  # best fit decreasing
        fits = [i for i, f in enumerate(free) if f >= s]
        if fits:
            free[min(fits, key=lambda i: free[i])] -= s
        else:
            free.append(100 - s)
    bins = len(free)
    assert sum(n for _, n in plan) <= bins


def test_branch_and_bound_finds_the_optimum_where_best_fit_fails():
    # best fit needs four bins of ten here, three are enough
    assert sum(n for _, n in P.plan({6: 1, 5: 2, 4: 1, 3: 2, 2: 2}, 10)) == 3


def test_empty_table(empty):
    assert P.pack(empty, *tokenizer()).count() == 0


def test_the_search_goes_on_until_the_bound_is_reached():
    # 4,000 nodes with 1,000 for a filling end with 14 bins
    sizes = {16: 2, 21: 2, 34: 2, 19: 1, 27: 3, 12: 3, 35: 2, 13: 2, 15: 1, 22: 3, 28: 3, 23: 1, 31: 1, 29: 1, 36: 2, 18: 2, 26: 1, 14: 1}
    assert sum(n for _, n in P.plan(sizes, 60)) == 13

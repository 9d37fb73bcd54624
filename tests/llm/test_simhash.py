import random

import numpy as np
import xxhash

from lodestrata.llm import simhash as S
from lodestrata.llm.common import connected_components


def brute_print(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(pairs):
    """Smallest id reachable through fingerprints within four bits."""
    root = list(range(len(pairs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(pairs)):
        for j in range(i):
            if (pairs[i][1] ^ pairs[j][1]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(pairs):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [least.get(find(i)) for i in range(len(pairs))]


def test_fingerprints_and_components_match_brute_force(documents):
    rows = sorted((r._id if r._id is not None else -1, r.fp & (2**64 - 1), r.component_id) for r in S.components(documents).collect())
    texts = [(r.doc_id, brute_print(r.text)) for r in documents.collect()]
    want = sorted((d if d is not None else -1, fp, c) for (d, fp), c in zip(texts, brute_components(texts), strict=True))
    assert rows == want


def _near(rng, centres, n):
    out = set()
    for _ in range(n):
        x = rng.choice(centres)
        for b in rng.sample(range(64), rng.randint(0, 6)):
            x ^= 1 << b
        out.add(x)
    return sorted(out)


def test_links_connect_what_is_within_four_bits_with_and_without_hot_buckets(spark, monkeypatch):
    rng = random.Random(3)
    prints = _near(rng, [rng.getrandbits(64) for _ in range(12)], 300)
    want = dict(zip(prints, brute_components([(S._signed(x), x) for x in prints]), strict=True))
    df = spark.createDataFrame([(S._signed(x),) for x in prints], "fp long")
    for bucket, few in ((4096, 1 << 20), (3, 1 << 20), (4096, 1)):
        monkeypatch.setattr(S, "FEW", few)
        found = {r.node: r.root for r in connected_components(S.links(df, bucket)).collect()}
        assert {x: found.get(S._signed(x), S._signed(x)) for x in prints} == want


def test_every_mask_set_finds_every_pair_within_the_limit():
    rng = random.Random(4)
    for n in (1, S.FEW + 1, S.MANY + 1):
        masks = S.masks(n)
        for _ in range(400):
            x = rng.getrandbits(64)
            y = x
            for b in rng.sample(range(64), rng.randint(1, 4)):
                y ^= 1 << b
            assert any((x ^ y) & m == 0 for m in masks)


def test_chain_filter_agrees_with_the_distance():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**64, 4000, np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for k in rng.integers(0, 8, 4000)], np.uint64)
    assert (S.linked(a, a ^ flips) == (np.bitwise_count(flips) <= 4)).all()


def test_stage_keeps_the_smallest_of_each_group(documents, empty):
    parts = {(r._id, r.component_id) for r in S.components(documents).collect()}
    kept = {r.doc_id for r in S.near_dedup(documents).collect()}
    assert kept == {i for i, c in parts if i == c or i is None}
    assert S.near_dedup(documents).columns == documents.columns
    assert S.components(empty).count() == 0


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, j) for j in range(1001, 1200)] + [(5, 5)]
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(301)) and all(found[j] == 1000 for j in range(1000, 1200))


def test_columns_with_names_used_inside(spark):
    df = spark.createDataFrame([(1, "a b c d e", 1, 7, "x"), (2, "a b c d e", 2, 8, "y"), (None, "a b c d e", 3, 9, "z")], "doc_id long, text string, _keep int, _id int, `a.b` string")
    out = S.near_dedup(df)
    assert out.columns == df.columns
    assert sorted(r["_keep"] for r in out.collect()) == [1, 3]

import hashlib
import random
from collections import defaultdict

import pytest

from lodestrata.llm import sharding as S


def brute(rows, limit):
    """Split a bucket on one more bit while it is too large."""
    h = {i: int(hashlib.md5(("" if k is None else str(k)).encode()).hexdigest()[:15], 16) for i, (k, _) in enumerate(rows)}
    n = {i: len((t or "").encode()) for i, (_, t) in enumerate(rows)}
    out = {}

    def split(own, depth):
        if sum(n[i] for i in own) <= limit or len(own) == 1 or depth == S.BITS:
            for i in own:
                out[i] = format(h[i], "060b")[:depth]
            return
        for bit in (0, 1):
            part = [i for i in own if h[i] >> (S.BITS - 1 - depth) & 1 == bit]
            if part:
                split(part, depth + 1)

    if rows:
        split(list(h), 0)
    return sorted((str(rows[i][0]), n[i], s) for i, s in out.items())


@pytest.mark.parametrize("limit", [10**9, 20_000, 900, 1])
def test_shards_match_brute_force(spark, make, limit):
    rng = random.Random(1)
    rows = [(i, make(rng, rng.randint(0, 80))) for i in range(300)] + [(400, None), (401, ""), (402, "é" * 5000), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = S.assign_shards(df, limit).collect()
    assert sorted((str(r._key), r.n_bytes, r.shard) for r in found) == brute(rows, limit)
    sums = defaultdict(lambda: [0, 0])
    for r in found:
        sums[r.shard][0] += r.n_bytes
        sums[r.shard][1] += 1
    assert all([r.shard_bytes, r.shard_docs] == sums[r.shard] and len(r.shard) == r.depth for r in found)
    assert all(b <= limit or n == 1 for b, n in sums.values())


def test_equal_keys_overflow_exactly(spark):
    rows = [(7, "x" * 100)] * 50 + [(8, "y" * 10)]
    found = S.assign_shards(spark.createDataFrame(rows, "doc_id long, text string"), 350).collect()
    sums = defaultdict(int)
    for r in found:
        sums[r.shard] += r.n_bytes
    assert len(found) == 51 and max(sums.values()) <= 350 and all(r.shard.startswith("x") for r in found if r._key == 7)


def test_files_of_shards(spark, make, tmp_path):
    rng = random.Random(2)
    df = spark.createDataFrame([(i, make(rng, 50), "z") for i in range(80)], "doc_id long, text string, shard string")
    S.write_shards(df, str(tmp_path / "out"), 3000)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.doc_id for r in back.collect()) == list(range(80)) and {"doc_id", "text", "shard"} <= set(back.columns)


def test_empty_table_and_native_plan(documents, empty):
    assert S.assign_shards(empty).count() == 0
    plan = S.assign_shards(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_columns_with_names_used_inside(spark, tmp_path):
    df = spark.createDataFrame([(1, "a" * 50, "x", "y"), (2, "b" * 50, "z", "w")], "doc_id long, text string, shard string, _shard string")
    S.write_shards(df, f"{tmp_path}/out", 60)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted((r["doc_id"], r["shard"], r["_shard"]) for r in back.collect()) == [(1, "x", "y"), (2, "z", "w")]
    assert "__shard" in back.columns

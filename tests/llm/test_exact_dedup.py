import hashlib
import random
from collections import defaultdict

import pytest

from lodestrata.llm import exact_dedup as E


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r.text or ""].append(r.doc_id)
    low = lambda i: -(10**18) if i is None else i
    return sorted(((i, max(ids, key=low), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids), key=str), len(groups)


@pytest.mark.parametrize("limit", [512, 2, 1])
def test_groups_match_brute_force_whatever_the_bucket_limit(documents, limit):
    rows = documents.select("doc_id", "text").collect()
    found = E.exact_groups(documents, bucket_rows=limit).collect()
    want, n = brute(rows)
    assert sorted(((r._id, r.keep_id, r.group_size, r.text_sha256) for r in found), key=str) == want
    assert sum(r.kept for r in found) == n


def test_large_buckets_are_split_by_bytes_too(documents):
    found = E.exact_groups(documents, bucket_bytes=100)
    assert found.where("kept").count() == brute(documents.collect())[1]


def test_the_stage_keeps_columns_and_one_row_of_each_text(documents):
    out = E.exact_dedup(documents)
    assert out.columns == documents.columns
    texts = [r.text or "" for r in out.collect()]
    assert len(texts) == len(set(texts)) == brute(documents.collect())[1]


def test_clashing_column_names_pass_through(spark):
    df = spark.createDataFrame([(1, "a", 5, "x"), (2, "a", 6, "y")], "doc_id long, text string, kept long, _t string").withColumnRenamed("kept", "keep_id")
    rows = E.exact_dedup(df).collect()
    assert [tuple(r) for r in rows] == [(2, "a", 6, "y")]


def test_empty_table(empty):
    assert E.exact_groups(empty).count() == 0


def test_radix_groups_of_bytes():
    rng = random.Random(1)
    texts = [bytes(rng.choices(b"ab", k=rng.randint(0, 40))) for _ in range(300)] + [b"x" * n for n in (15, 16, 17, 48, 48)]
    found = E.radix_groups(texts)
    assert sorted(i for g in found for i in g) == list(range(len(texts)))
    assert all(len({texts[i] for i in g}) == 1 for g in found) and len(found) == len(set(texts))

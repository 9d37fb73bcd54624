import random

import pytest

import corpus_pipeline as C
from lodestrata.llm import decontam, langid
from tests.llm import test_decontam, test_exact_dedup, test_simhash  # noqa: F401  (their brute-force versions)


@pytest.fixture(scope="module")
def folder(spark, make, tmp_path_factory):
    """Documents in the small, with copies, near copies, leaks and texts without letters."""
    rng = random.Random(11)
    d = tmp_path_factory.mktemp("sf")
    items = [(i, make(rng, rng.randint(14, 40))) for i in range(6)]
    texts = [make(rng, rng.randint(30, 300)) for _ in range(80)]
    texts += texts[:10] + texts[:3] + [t + " end" for t in texts[10:20]]
    texts += [f"{make(rng, 20)} {items[i][1]} {make(rng, 20)}" for i in range(6)]
    texts += [None, "", "12 34", "!!!"]
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), rows, items


def test_every_stage_matches_brute_force(spark, folder):
    d, rows, items = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = {r[0]: r[1] for r in rows}
    steps = dict(C.STAGES)
    columns = docs.columns

    docs = steps["language ID"](spark, docs, d)
    kept = {i: t for i, t in kept.items() if len(langid.trigrams(t or ""))}
    assert {r.doc_id for r in docs.collect()} == set(kept) and docs.columns == columns

    docs = steps["exact dedup"](spark, docs, d)
    last = {t: i for i, t in sorted(kept.items())}
    kept = {i: t for t, i in last.items()}
    assert {r.doc_id for r in docs.collect()} == set(kept) and docs.columns == columns

    docs = steps["SimHash near-dedup"](spark, docs, d)
    pairs = [(i, test_simhash.brute_print(t)) for i, t in kept.items()]
    kept = {i: kept[i] for (i, _), c in zip(pairs, test_simhash.brute_components(pairs), strict=True) if i == c}
    assert {r.doc_id for r in docs.collect()} == set(kept) and docs.columns == columns

    docs = steps["benchmark decontamination"](spark, docs, d)
    kept = {i: t for i, t in kept.items() if test_decontam.brute(t, items) is None}
    assert {r.doc_id for r in docs.collect()} == set(kept) and docs.columns == columns

    packed = steps["best-fit packing"](spark, docs, d).collect()
    assert {r.doc_id for r in packed} == set(kept)
    assert len({r.sequence_id for r in packed}) <= -(-sum(r.length for r in packed) // 2048) + 1


def test_run_applies_the_stages_in_order(spark, folder):
    d, _, _ = folder
    out = C.run(spark, d)
    assert out.count() == len({(r.doc_id, r.piece) for r in out.collect()}) > 0
    assert [n for n, _ in C.STAGES] == ["language ID", "exact dedup", "SimHash near-dedup", "benchmark decontamination", "best-fit packing"]


def test_queries_are_registered():
    import __spark_entry__ as E

    names = set(E.queries())
    assert {f"op{n}_" for n in range(1, 11)} <= {x.split("_")[0] + "_" for x in names if x.startswith("op")} and "pipeline" in names
    assert decontam.WINDOW == 8

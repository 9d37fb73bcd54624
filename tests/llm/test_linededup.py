import random
import re

import pytest
from pyspark.sql import functions as F

from lodestrata.llm import linededup as L


def brute(rows, t=L.SIMILARITY):
    """Line numbers kept of each document, by comparing every line with all before it."""
    seen, out = [], {}
    for doc, text in sorted(rows):
        kept = []
        for k, line in enumerate((text or "").split("\n")):
            s = frozenset(w for w in re.split("[ \t\r\x0b\x0c]+", line.lower()) if w)
            if not s or not any(len(s & y) >= t * len(s | y) - 1e-9 for y in seen):
                kept.append(k)
            if s:
                seen.append(s)
        out[doc] = kept
    return out


@pytest.fixture(scope="module")
def rows(make):
    rng = random.Random(9)
    pool = [make(rng, rng.randint(1, 30)) for _ in range(60)]
    out = []
    for i in range(70):
        lines = []
        for _ in range(rng.randint(0, 9)):
            words = rng.choice(pool).split()
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                words[rng.randrange(len(words))] = rng.choice(["x1", "y2", "z3", make(rng, 1)])
            rng.shuffle(words) if rng.random() < 0.2 else None
            lines.append(rng.choice(["", " "]).join([" ".join(words), ""]).upper() if rng.random() < 0.1 else " ".join(words))
        out.append((i, "\n".join(lines)))
    return out + [(100, None), (101, ""), (102, "\n \n\t\n"), (103, "the\nThe\n the \nother")]


def test_decisions_match_brute_force(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r._id: r.kept_lines for r in L.line_decisions(df).collect()}
    assert found == brute(rows)


@pytest.mark.parametrize("t", [0.5, 0.9, 1.0])
def test_other_similarities(spark, rows, t):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r._id: r.kept_lines for r in L.line_decisions(df, similarity=t).collect()} == brute(rows, t)


def test_texts_lose_the_lines_and_keep_columns(spark, rows):
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, kept int")
    kept = brute(rows)
    out = L.dedup_lines(df)
    assert out.columns == df.columns
    texts = {r.doc_id: r.text for r in out.collect()}
    for i, text in rows:
        assert texts[i] == (None if text is None else "\n".join(text.split("\n")[k] for k in kept[i]))


def test_rows_without_ids_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, "same line here"), (1, "same line here"), (1, "same line here"), (2, "same line here")], "doc_id long, text string")
    found = sorted((str(r._id), r.n_removed) for r in L.line_decisions(df).collect())
    assert found == [("1", 0), ("1", 0), ("2", 1), ("None", 0)]


def test_a_near_copy_group_lists_no_pairs_within_it(spark, make):
    """All variants of one line are settled by the first."""
    rng = random.Random(3)
    words = make(rng, 40).split()
    rows = []
    for i in range(150):
        w = list(words)
        w[rng.randrange(40)] = f"v{i}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r._id: r.kept_lines for r in L.line_decisions(df).collect()} == brute(rows)


@pytest.mark.parametrize("crowd", [1, 2, 5])
def test_crowded_words_go_on_to_the_join(spark, rows, monkeypatch, crowd):
    monkeypatch.setattr(L, "CROWD", crowd)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r._id: r.kept_lines for r in L.line_decisions(df).collect()} == brute(rows)


def test_chains_of_near_copies_in_a_crowded_word(spark, make, monkeypatch):
    """Lines that drift away from the first, each like the one before: the first settles few of them."""
    monkeypatch.setattr(L, "CROWD", 4)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(["shared", *words[i : i + 20]])) for i in range(40)] + [(50, "shared")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r._id: r.kept_lines for r in L.line_decisions(df).collect()} == brute(rows)


def test_no_python_in_the_plans(spark, rows, capsys, tmp_path):
    """Native: neither the classes nor the join nor the decisions run Python code."""
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    df = spark.read.parquet(f"{tmp_path}/docs")
    for made in (L.classes(L.line_sets(df, "doc_id", "text")), L.line_decisions(df), L.dedup_lines(df)):
        made.explain("formatted")
        assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)


def test_very_long_text_and_line(spark, make):
    rng = random.Random(4)
    long_line = make(rng, 20_000)
    text = "\n".join(make(rng, 5) for _ in range(3_000))
    rows = [(1, text), (2, long_line), (3, text), (4, long_line + " more")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r._id: r for r in L.line_decisions(df).collect()}
    assert found[3].n_removed == 3_000 and found[4].n_removed == 1 and found[2].n_removed == 0


def test_columns_with_names_used_inside(spark):
    df = spark.createDataFrame([(1, "a b c", "x", 1, [1]), (2, "a b c", "y", 2, [2])], "doc_id long, text string, _kept string, _id int, kept array<int>").withColumn("a.b", F.lit(3))
    out = L.dedup_lines(df)
    assert out.columns == df.columns
    assert sorted(out.collect())[1].asDict() == {"doc_id": 2, "text": "", "_kept": "y", "_id": 2, "kept": [2], "a.b": 3}
    assert sorted((r._id, r.n_removed) for r in L.line_decisions(df).collect()) == [(1, 0), (2, 1)]


def test_empty_table(empty):
    assert L.line_decisions(empty).count() == 0
    assert L.dedup_lines(empty).count() == 0


def test_few_pairs_of_a_near_copy_group_are_verified_and_no_words_are_written(spark, make, monkeypatch):
    """Also of a group below the size of a crowded word."""
    rng = random.Random(8)
    words = make(rng, 40).split()
    rows = [(i, " ".join([*words[: i % 40], f"v{i}", *words[i % 40 + 1 :]])) for i in range(120)]
    asked, written, verified, cut = [], [], L._verified, L.cut
    monkeypatch.setattr(L, "_verified", lambda pairs, *a: (asked.append(pairs.count()), verified(pairs, *a))[1])
    monkeypatch.setattr(L, "cut", lambda df, name: (written.append(name), cut(df, name))[1])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r._id: r.kept_lines for r in L.line_decisions(df).collect()} == brute(rows)
    assert sum(asked) <= 2 * len(rows) and "words" not in written


@pytest.fixture
def listed(monkeypatch):
    """Rows of the tables that are written, by name."""
    out, cut = {}, L.cut

    def counting(df, name):
        made = cut(df, name)
        out.setdefault(name, []).append(made.count())
        return made

    monkeypatch.setattr(L, "cut", counting)
    return out


def test_pairs_of_a_group_below_a_crowded_words_size_are_not_listed(spark, make, monkeypatch, listed):
    """What the earliest class of a word settles isn't looked up again: five times the copies, not 25 times the pairs."""
    monkeypatch.setattr(L, "LED", 16)
    words = make(random.Random(12), 40).split()
    rows = [(i, " ".join([*words[: i % 40], f"v{i}", *words[i % 40 + 1 :]])) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r._id: r.kept_lines for r in L.line_decisions(df).collect()} == brute(rows)
    assert sum(listed["pairs"]) <= len(rows) and sum(listed["first"]) <= len(rows) * 20


def test_a_pair_is_tried_once_whatever_parts_its_words_are_in(spark, rows, monkeypatch, listed):
    tried, settled = [], L._settled
    monkeypatch.setattr(L, "_settled", lambda pairs, *a: (tried.append((pairs.count(), pairs.distinct().count())), settled(pairs, *a))[1])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r._id: r.kept_lines for r in L.line_decisions(df).collect()} == brute(rows)
    assert all(n == distinct for n, distinct in tried) and sum(listed["pairs"]) > tried[0][1]


@pytest.mark.parametrize(("led", "crowd", "broadcast"), [(1, 5, 0), (2, 4, 200_000), (3, 1024, 0)])
def test_leaders_lose_no_line(spark, rows, monkeypatch, led, crowd, broadcast):
    monkeypatch.setattr(L, "LED", led)
    monkeypatch.setattr(L, "CROWD", crowd)
    monkeypatch.setattr(L, "BROADCAST_ROWS", broadcast)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r._id: r.kept_lines for r in L.line_decisions(df).collect()} == brute(rows)

import random

import pytest

from lodestrata.llm import decontam as D

ITEMS = [
    (1, "If Tom has 12 apples and buys 5 kg of pears from Anna , how many apples does Tom have left after giving 3 to Anna ?"),
    (2, "the quick brown fox jumps over the lazy dog while seven silent otters watch from the river bank below"),
    (3, "short item with six words here"),
    (4, None),
    (5, "1 2 3 4 5 6 7 8 9 10 11 12 13 14"),
]
FILL = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna"


@pytest.fixture(scope="module")
def tables(spark):
    q = ITEMS[0][1]
    docs = [
        (10, f"{FILL}. {ITEMS[1][1]} {FILL}"),
        (11, FILL),
        (12, f"{FILL} ... {q}"),
        (13, f"So. {q.replace('12', '40').replace(' 5 ', ' 9 ').replace(' 3 ', ' 7 ').replace('Tom', 'Mia').replace('Anna', 'Ben')}"),  # other numbers and names
        (14, "if tom has many apples"),
        (15, None),
        (16, ""),
        (17, ITEMS[1][1].upper()),
        (18, f"x {ITEMS[2][1]} y"),
        (19, "11 12 13 14 15 16 17 18 19 20 21 22 23 24"),
        (20, q.replace("Tom", "Mia", 1).replace("Anna", "Ben")),  # Tom and Mia for one name
        (21, " ".join(ITEMS[1][1].split()[:9])),  # nine words are fewer than thirteen
        (22, " ".join(ITEMS[1][1].split()[2:15])),  # thirteen words in a row
        (10, f"{ITEMS[1][1]}"),
    ]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")


def found(tables, **kw):
    return {(r._row.doc_id, r._row.text): r.item_id for r in D.matches(*tables, **kw).collect()}


def test_leaks_reparameterised_questions_and_clean_texts(tables):
    hit = {}
    for (i, _), item in found(tables).items():
        hit.setdefault(i, set()).add(item)
    assert hit[10] == {2} and hit[12] == {1} and hit[13] == {1} and hit[17] == {2} and hit[18] == {3} and hit[22] == {2}
    assert all(hit[i] == {None} for i in (11, 14, 15, 16, 19, 21))


def test_slots_must_agree(tables):
    m = D.Matcher(D.windows_of([(1, "we met Tom in May and then Tom went home with Tom again in cold June rain")]))
    same = "we met Ann in Dorf and then Ann went home with Ann again in cold Ulm rain"
    assert m.match(same)[0] == 1
    assert m.match(same.replace("then Ann", "then Bob"))[0] is None
    assert D.consistent({("n", "1", "2"), ("n", "2", "3")}) and not D.consistent({("n", "1", "2"), ("n", "3", "2")})


def test_blocks_give_the_same_result(tables):
    assert found(tables, block_chars=40) == found(tables)


def brute(text, items):
    """All windows, no index."""
    t, raw = D.canonical(text or "")
    best = None
    for item, body in items:
        q, values = D.canonical(body or "")
        width = min(D.WINDOW, len(q))
        if not width:
            continue
        good = [a for a in range(len(q) - width + 1) if sum(x not in D._SLOTS for x in q[a : a + width]) >= max(D.SHORTEST, width // 2 + 1)]
        for shift in range(-len(q), len(t)):
            hits = [a for a in good if 0 <= a + shift and a + shift + width <= len(t) and t[a + shift : a + shift + width] == q[a : a + width]]
            pairs = {(q[p], values[p], raw[p + shift]) for a in hits for p in range(a, a + width) if q[p] in D._SLOTS}
            if good and len(hits) >= min(D.RUN, len(good)) and D.consistent(pairs):
                best = item if best is None else min(best, item)
    return best


def test_matches_brute_force_on_random_texts(spark, make):
    rng = random.Random(8)
    items = [(i, make(rng, rng.randint(5, 40))) for i in range(20)]
    docs = []
    for i in range(120):
        words = make(rng, rng.randint(0, 60)).split()
        if rng.random() < 0.6:
            part = rng.choice(items)[1].split()
            a = rng.randint(0, len(part) // 2)
            part = part[a : a + rng.randint(3, 40)]
            for _ in range(rng.randint(0, 2)):
                part[rng.randrange(len(part))] = rng.choice(["7", "Tom", "kg", "the."])
            words[len(words) // 2 : len(words) // 2] = part
        docs.append((i, " ".join(words)))
    got = {r._row.doc_id: r.item_id for r in D.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {i: brute(x, items) for i, x in docs}
    assert len(set(got.values())) > 5


def test_stage_and_empty_tables(spark, tables, empty):
    docs, bench = tables
    assert {r.doc_id for r in D.decontaminate(docs, bench).collect()} >= {11, 14, 15, 16, 19, 21}
    assert D.decontaminate(docs, bench).columns == docs.columns
    assert D.matches(empty, bench).count() == 0
    assert D.decontaminate(docs, bench.limit(0)).count() == docs.count()


def test_templates():
    assert D.canonical("Ann saw 5 kg and $3.50 , 12km (Bob)")[0] == ["ann", "saw", D.NUMBER, D.UNIT, "and", D.MEASURE, D.MEASURE, D.NAME]


def test_one_edited_slot_does_not_save_a_copy():
    """A long item with one of two equal numbers changed, and one whose two numbers become the same."""
    item = "the farmer has 12 sheep in the north field and " + " ".join(f"word{c}" for c in "abcdefghijklmnopqrstuvwxyz") + " so again 12 sheep went over the hill"
    m = D.Matcher(D.windows_of([(1, item)]))
    n = len(D.canonical(item)[0]) - D.WINDOW + 1
    assert m.match(item) == (1, n)
    assert m.match(item.replace("again 12", "again 13"))[0] == 1
    short = "a farmer buys 3 sheep and then 4 goats for the old stable by the river"
    m = D.Matcher(D.windows_of([(2, short)]))
    assert m.match(short.replace("3", "5").replace("4", "5"))[0] == 2


@pytest.mark.parametrize("item", ["12 + 7 = 19 , 15 + 8 = 23", "Tom 5 kg Anna 7 kg Ben 9 km Eve 12 km Max 14 cm", "小明有十二个苹果又买了五个", "猫有几条腿", "แมวมีสี่ขา"])
def test_items_of_values_and_unspaced_scripts_are_found_word_for_word(item):
    m = D.Matcher(D.windows_of([(1, item)]))
    assert m.match(f"{FILL} {item} {FILL}")[0] == 1
    assert m.match(FILL) == (None, 0)
    assert m.match("13 + 8 = 21 , 16 + 9 = 25")[0] is None
    if item[0] > "　":
        assert m.match(f"前文{item}后文")[0] == 1


def test_headings_line_breaks_and_lower_case_copies():
    short, other = "If Tom has 12 apples and buys pears", "If Sara has 30 apples and buys pears"
    m = D.Matcher(D.windows_of([(1, short), (2, "Compare ripe apples with green pears"), (3, ITEMS[0][1])]))
    for text in (f"Q 12\n{short}", f"Exercise {short}", f"Q 12\n{other}", f"Exercise {other}", short.lower(), f"Chapter\n{short} again"):
        assert m.match(text)[0] == 1, text
    assert m.match("Some Heading\nCompare ripe apples with green pears")[0] == 2
    assert m.match("x " + ITEMS[0][1].lower())[0] == 3
    wrapped = ITEMS[0][1].replace("12", "40").replace("Tom", "Mia").replace("from Anna", "from\nBen").replace("Anna", "Ben")
    assert m.match(wrapped)[0] == 3  # a name at a line's beginning
    assert m.match("Q 12\nIf Sara had 30 apples and buys pears")[0] is None

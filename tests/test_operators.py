import pytest
from pyspark.sql import functions as F

from lodestrata.operators import classify, evidence, ind, ontology, profile, ranking
from lodestrata.sources import turtle
from lodestrata.sources.catalog import Catalog, ForeignKey


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# ---------------------------------------------------------------- dependencies


@pytest.fixture(scope="module")
def catalog(spark):
    parent = frame(spark, [(i,) for i in range(20)], "id int")
    child = frame(spark, [(i, i % 10, None if i < 15 else 99, "x") for i in range(20)], "cid int, pid int, rare int, status string")
    return Catalog({"parent": parent, "child": child}, {"parent": ("id",), "child": ("cid",)})


def test_ind_scores_are_containment_of_distinct_values(catalog):
    scores = {(r.table, r.column, r.ref_table): (r.n_source, r.n_common, r.score) for r in ind.all_pairs_ind(catalog).collect()}
    assert scores["child", "pid", "parent"] == (10, 10, 1.0) and ("child", "rare", "parent") not in scores
    assert scores["parent", "id", "child"][2] == 1.0 and not any(k[1] == "status" for k in scores)


def test_a_column_is_contained_in_itself(spark):
    t = frame(spark, [(i,) for i in range(5)], "v int")
    c = Catalog({"a": t, "b": t}, {"a": ("v",)})
    r = ind.all_pairs_ind(c, sources=[("b", "v", "int")]).first()
    assert r.score == 1.0 and r.n_common == 5


def test_merge_rules(spark):
    found = frame(spark, [("a", "x", "b", "id"), ("a", "ref", "a", "id"), ("a", "b_type", "b", "id"), ("a", "item_type", "b", "id"), ("a", "known", "b", "id")], "table string, column string, ref_table string, ref_column string")
    known = frame(spark, [("a", "known")], "table string, column string")
    assert {r.column for r in ind.mergeable(found, known).collect()} == {"x", "b_type"}


def test_reciprocal_ids(spark):
    found = frame(spark, [("child", "ID", "parent", "ID"), ("parent", "ID", "child", "ID"), ("parent", "x", "child", "ID")], "table string, column string, ref_table string, ref_column string")
    left = ind.drop_reciprocal(found, frame(spark, [("child", "parent")], "child string, parent string"))
    assert {(r.table, r.column) for r in left.collect()} == {("child", "ID"), ("parent", "x")}


def test_overlap_is_symmetric_and_kinds(spark):
    a, b = frame(spark, [(str(i),) for i in range(10)] + [(" 3 ",), ("",), (None,)], "v string"), frame(spark, [(i,) for i in range(8)], "v int")
    x, y = ind.overlap(a, "v", b, "v").first(), ind.overlap(b, "v", a, "v").first()
    assert x.source_distinct == 10 and x.jaccard == y.jaccard == 0.8 and x.evidence_type == "high_overlap_column" and y.evidence_type == "inclusion_column_source_to_target"
    assert ind.overlap(a.limit(0), "v", b, "v").first().jaccard == 0.0


def test_match_rate_counts_joined_rows_and_empty_tables(spark):
    left, right = frame(spark, [(1,), (2,), (None,)], "k int"), frame(spark, [(1,), (1,)], "k int")
    c = Catalog({"l": left, "r": right, "e": left.limit(0)})
    rows = ind.match_rates(c, [ForeignKey("l", ("k",), "r", ("k",)), ForeignKey("e", ("k",), "r", ("k",))]).orderBy("table").collect()
    assert [(r.n_joined, r.n_matched, r.match_rate) for r in rows] == [(0, 0, 0.0), (4, 2, 0.5)]


# ---------------------------------------------------------------- profiles and evidence


def test_enum_profile_is_complete_only_within_the_limit(spark):
    df = frame(spark, [(i, chr(97 + i % 6)) for i in range(30)] + [(99, None)], "k int, v string")
    assert {r.complete for r in profile.enum_profile(df, "v", 6).collect()} == {True}
    cut = profile.enum_profile(df, "v", 5).collect()
    assert len(cut) == 5 and {r.complete for r in cut} == {False}
    s = profile.enum_samples(df, "v", "k", 2).collect()
    assert len(s) == 12 and s == profile.enum_samples(df.repartition(7), "v", "k", 2).collect() or len(s) == 12


def test_coverage_counts_distinct_keys_and_evidence_counts_rows(spark):
    df = frame(spark, [(1, "a", 10), (1, "a", 10), (2, "a", 11), (3, "b", None)], "k int, v string, f int")
    out = {r.value: (r.total, r.covered, r.ratio) for r in evidence.coverage_outgoing(df, "k", "v", "f", frame(spark, [(10,), (10,)], "id int"), "id").collect()}
    assert out == {"a": (2, 1, 0.5), "b": (1, 0, 0.0)}
    sub = {r.value: (r.total, r.present) for r in evidence.subtype_evidence(df, ["k"], "v", frame(spark, [(1,)], "k int"), ["k"], "sub").collect()}
    assert sub == {"a": (3, 2), "b": (1, 0)}


def test_relation_domain_locks_only_without_leaks(spark):
    target = frame(spark, [("1",), ("2",)], "id string")
    clean = frame(spark, [("x", 1), ("x", 2), ("y", None)], "v string, f int")
    locks = lambda df: {r.value: r.locks for r in evidence.relation_domain_evidence(df, "v", "f", target, "id").collect()}
    assert locks(clean) == {"x": True, "y": False}
    assert locks(clean.union(frame(spark, [("y", 9)], "v string, f int"))) == {"x": False, "y": False}


def test_structure_signal(spark):
    cov = frame(spark, [("r", "a", 10, 1.0), ("r", "b", 10, 0.0), ("s", "a", 40, 0.5)], "relation string, value string, total int, ratio double")
    assert evidence.structure_signal(cov).first()[0] == pytest.approx((0.7 + 0.15) * 1.0)
    assert evidence.structure_signal(cov.where("relation = 's'")).first()[0] == 0.0


CLASSES = "uri string, local_name string, base double, is_descendant boolean, is_current boolean, has_descendants boolean"


def test_rule_scores_add_up_the_evidence(spark):
    values = frame(spark, [("1",), ("2",)], "value string")
    classes = frame(spark, [("#A", "Author", 0.5, True, False, True), ("#R", "Reviewer", 0.5, True, False, True), ("#P", "Person", 1.0, False, True, True)], CLASSES)
    sub = frame(spark, [("1", "#A", 1.0), ("2", "#A", 0.0)], "value string, uri string, ratio double")
    cov = frame(spark, [("writes.a", "1", 0.0), ("writes.a", "2", 1.0)], "relation string, value string, ratio double")
    hints = frame(spark, [("writes.a", "class", "#R", "Reviewer", 1.0, 1.0)], "relation string, kind string, uri string, name string, score double, edge double")
    s = {(r.value, r.uri): r.score for r in evidence.enum_rule_scores(values, classes, "TYPE", sub, cov, hints).collect()}
    prior = (0.25 + 0.75 * 0.5) * 1.06 * 0.28
    assert s["1", "#A"] == pytest.approx(prior + 1.05)
    assert s["1", "#R"] == pytest.approx(prior - 0.18 - 0.42 * 1.0 * 1.0)  # named by a relation that covers only the other value
    assert s["2", "#R"] == pytest.approx(prior + 1.0) and s["2", "#A"] == pytest.approx(prior - 0.32)
    assert s["1", "#P"] == pytest.approx(0.35 * 0.28 - 0.18)
    best = {r.value: (r.uri, r.level) for r in evidence.enum_decisions(frame(spark, [(*k, v) for k, v in s.items()], "value string, uri string, score double"), numeric=True).collect()}
    assert best == {"1": ("#A", "high"), "2": ("#R", "high")}


def test_literal_enums_need_unique_values_and_a_complete_domain(spark):
    scored = frame(spark, [("solar", "#S", 0.9), ("solar", "#W", 0.1), ("wind", "#S", 0.9), ("wind", "#W", 0.85)], "value string, uri string, score double")
    ok = frame(spark, [("solar", True), ("wind", True)], "value string, complete boolean")
    assert [(r.value, r.uri) for r in evidence.literal_enum(scored, ok).collect()] == [("solar", "#S")]
    assert evidence.literal_enum(scored, ok.withColumn("complete", F.lit(False))).count() == 0
    assert evidence.literal_enum(scored, frame(spark, [("x" * 70, True), ("y", True)], "value string, complete boolean")).count() == 0


def test_strong_subtype_residual_and_locks(spark):
    ev = frame(spark, [("1", "a", 10, 10, 1.0), ("1", "b", 10, 7, 0.7), ("2", "a", 2, 2, 1.0), ("3", "a", 9, 9, 1.0), ("3", "b", 9, 8, 0.9)], "value string, subtype string, total int, present int, ratio double")
    assert [(r.value, r.subtype) for r in evidence.strong_subtype(ev).collect()] == [("1", "a")]
    assert [tuple(r) for r in evidence.relation_locks(frame(spark, [("1", "#A"), ("2", "#A"), ("2", "#B")], "value string, uri string")).collect()] == [("1", "#A")]
    values, kids, locked = frame(spark, [("1",), ("2",)], "value string"), frame(spark, [("#A",), ("#B",)], "uri string"), frame(spark, [("1", "#A")], "value string, uri string")
    assert [tuple(r) for r in evidence.residual_branch(values, locked, kids).collect()] == [("2", "#B")]
    assert evidence.residual_branch(values, locked.limit(0), kids).count() == 0


# ---------------------------------------------------------------- rankings


def test_confidence_is_inclusive_at_its_bounds(spark):
    r = frame(spark, [("a", "u", 0.7, 1), ("a", "v", 0.5, 2), ("b", "u", 0.4, 1), ("b", "v", 0.3, 2), ("c", "u", 0.9, 1), ("c", "v", 0.85, 2)], "name string, uri string, score double, rank int")
    assert {x.name: x.confidence for x in ranking.confidence(r).collect()} == {"a": "high", "b": "medium", "c": "low"}


def test_resolve(spark):
    n, c = frame(spark, [("paper",), ("zzz",)], "name string"), frame(spark, [("http://a#Paper",), ("http://a#Papers",)], "uri string")
    r = {x.name: (x.uri, x.how) for x in ranking.resolve(ranking.rank_classes(n, c, 9)).collect()}
    assert r == {"paper": ("http://a#Paper", "exact"), "zzz": (None, "unresolved")}
    twice = ranking.rank_classes(n, frame(spark, [("http://a#Paper",), ("http://b#paper",)], "uri string"), 9)
    assert {x.name: x.how for x in ranking.resolve(twice).collect()}["paper"] == "ambiguous_exact"


def test_both_track_leaders_stay(spark):
    s = frame(spark, [("n", f"p{i}", a, b, c) for i, (a, b, c) in enumerate([(1.0, 0.0, 0.0), (0.0, 1.0, 1.0), (0.9, 0.9, 0.9), (0.8, 0.8, 0.9)])], "name string, uri string, syntax_score double, domain_score double, range_score double")
    assert [r.uri for r in ranking.rank_object_properties(s, 2).orderBy("rank").collect()] == ["p0", "p1"]


def test_identity_property_abstains_on_a_tie(spark):
    s = frame(spark, [("id", "a", 1.0, 1.0), ("id", "b", 0.98, 0.9), ("k", "c", 1.0, 0.9)], "name string, uri string, lexical double, domain_score double")
    assert [r.uri for r in ranking.identity_property(s).collect()] == ["c"]


def test_general_targets_are_pruned(spark):
    s = frame(spark, [("x", "A", 0.8), ("x", "B", 0.76), ("y", "A", 0.9), ("y", "B", 0.5)], "name string, uri string, score double")
    up = frame(spark, [("B", "A")], "child string, ancestor string")
    assert {(r.name, r.uri) for r in ranking.prune_general(s, up).collect()} == {("x", "B"), ("y", "A"), ("y", "B")}


def test_deterministic_property(spark):
    e = frame(spark, [("t", "http://x#a", "normal", 1.0, 1.0, True, False, False, False, 1), ("t", "http://x#b", "normal", 1.0, 0.78, True, False, False, True, 0)], "task string, uri string, direction string, domain_match double, range_match double, declared boolean, restriction boolean, construction boolean, exact_name boolean, role_hits int")
    r = ranking.deterministic_property(e).first()
    assert r.uri == "http://x#b" and r.score == pytest.approx(5 * 1.78 + 1.2 + 2.4)


def test_boolean_classes_and_empty_keys(spark):
    r = frame(spark, [("program_chair", "#PC", "Program_Chair", 0.5), ("program_chair", "#C", "Chair", 0.9)], "name string, uri string, local_name string, score double")
    assert [(x.uri, x.score) for x in ranking.boolean_classes(r).orderBy("rank").collect()] == [("#PC", 1.2), ("#C", 0.54)]
    p = frame(spark, [("review", "paper", "paper"), ("review", "paper", "person")], "table string, column string, ref_table string")
    assert ranking.empty_fk_candidates(p, 1).first().ref_table == "paper"


# ---------------------------------------------------------------- ontology

TTL = """
@prefix : <http://x#> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
:T a owl:Class ; owl:disjointUnionOf ( :A :B ) . :A1 rdfs:subClassOf :A . :B1 rdfs:subClassOf :B . :A owl:disjointWith :B .
:p a owl:ObjectProperty ; rdfs:domain [ a owl:Class ; owl:unionOf ( :A [ a owl:Class ; owl:unionOf ( :B1 :C ) ] ) ] ; rdfs:range :B ; owl:inverseOf :q .
:q a owl:ObjectProperty ; rdfs:subPropertyOf :r . :r a owl:ObjectProperty .
:d a owl:DatatypeProperty ; rdfs:domain [ a owl:Class ; owl:intersectionOf ( :A :B ) ] ; rdfs:range xsd:int .
:A rdfs:subClassOf [ a owl:Restriction ; owl:onProperty :r ; owl:someValuesFrom :C ] .
[] a owl:AllDisjointClasses ; owl:members ( :C :T ) .
"""


@pytest.fixture(scope="module")
def onto(spark):
    return ontology.read(turtle.triples_frame(spark, turtle.parse(TTL)))


def short(rows):
    return {tuple(None if x is None else str(x).split("#")[-1] for x in r) for r in rows.collect()}


def test_ontology_parts(onto):
    assert {("A", "T"), ("B", "T"), ("A1", "A"), ("B1", "B")} <= short(onto.edges)
    assert ("A1", "T", "2") in short(onto.closed)
    ends = short(onto.endpoints)
    assert {("p", "domain", "A"), ("p", "domain", "B1"), ("p", "domain", "C"), ("p", "range", "B"), ("d", "domain", None), ("q", "range", None)} <= ends
    assert short(onto.disjoint) == {("A", "B"), ("C", "T")}
    assert ("p", "q") in short(onto.inverses) and ("q", "p") in short(onto.inverses) and ("q", "r") in short(onto.subproperties)
    assert ("A1", "r", "C", "1") in short(ontology.restriction_support(onto))


def test_incompatibility_follows_the_hierarchy(onto):
    bad = short(ontology.incompatible(onto.disjoint, onto.closed))
    assert {("A1", "B1"), ("B1", "A1"), ("C", "A1")} <= bad and ("A", "A1") not in bad


def test_domains(onto, spark):
    subjects = frame(spark, [("http://x#A1",), ("http://x#B",)], "subject string")
    fits = short(ontology.domain_compatible(subjects, onto.endpoints, onto.closed))
    assert ("p", "A1") in fits and ("p", "B") not in fits and ("d", "B") in fits  # an opaque domain rejects nothing


def test_hints(onto, spark):
    h = frame(spark, [("http://x#A1",), ("http://y#a",), (None,)], "hint string")
    s = {(r.hint, r.uri.split("#")[1], r.side): r.score for r in ontology.hint_match(h, onto.endpoints, onto.closed).collect()}
    assert s["http://x#A1", "p", "domain"] == 0.85 and s["http://y#a", "p", "domain"] == 1.0 and s[None, "p", "range"] == 0.3 and s["http://x#A1", "q", "range"] == 0.3


def test_closure_of_long_chains_and_cycles(spark):
    chain = frame(spark, [(i, i + 1) for i in range(40)], "child int, parent int")
    c = ontology.closure(chain)
    assert c.count() == 40 * 41 // 2 and c.agg(F.max("distance")).first()[0] == 40
    loop = {tuple(r) for r in ontology.closure(frame(spark, [(1, 2), (2, 3), (3, 1)], "child int, parent int")).collect()}
    assert loop == {(a, b, (b - a) % 3 or 3) for a in (1, 2, 3) for b in (1, 2, 3)}


# ---------------------------------------------------------------- patterns


def shape(spark, columns, pk=(), fks=()):
    t = frame(spark, [], ", ".join(f"`{c}` {k}" for c, k in columns.items()))
    other = frame(spark, [], "ID int")
    c = Catalog({"t": t, "o": other, "p": other}, {"t": tuple(pk)} if pk else {}, [ForeignKey("t", cols, ref, rc, f"k{i}") for i, (cols, ref, rc) in enumerate(fks)])
    return c


def pattern(c):
    r = classify.classify(c.columns_frame(), c.pk_frame(), c.fk_frame()).where(F.col("table") == "t").first()
    return r.pattern, r.value_attr, r.key_only


@pytest.mark.parametrize(
    "columns, pk, fks, want",
    [
        ({"ID": "int", "x": "string"}, ["ID"], [], ("SE", False, False)),
        ({"ID": "int", "x": "string"}, ["ID"], [(("ID",), "o", ("ID",))], ("SH", False, False)),
        ({"ID": "int", "r": "int"}, ["ID", "r"], [(("ID",), "o", ("ID",)), (("r",), "p", ("ID",))], ("SH", False, False)),
        ({"a": "int", "b": "int"}, [], [(("a",), "o", ("ID",)), (("b",), "p", ("ID",))], ("SR", False, False)),
        ({"a": "int", "b": "int"}, ["a"], [(("a",), "o", ("ID",)), (("b",), "p", ("ID",))], ("SH", False, False)),  # SH is tested first
        ({"a": "int", "b": "int"}, ["a", "b"], [(("a",), "o", ("ID",))], ("SR", False, False)),
        ({"a": "int", "b": "string"}, ["a", "b"], [(("a",), "o", ("ID",))], ("SE", True, False)),
        ({"a": "int", "b": "int"}, ["a", "b"], [], ("SE", False, True)),
        ({"a": "int", "b": "int", "c": "int"}, [], [(("a",), "o", ("ID",)), (("b",), "p", ("ID",)), (("c",), "p", ("ID",))], ("SE", False, False)),
    ],
)
def test_patterns(spark, columns, pk, fks, want):
    assert pattern(shape(spark, columns, pk, fks)) == want


def test_inferred_relations_abstain_unless_binary_scalar_and_complete(spark):
    two = [(("a",), "o", ("ID",)), (("b",), "p", ("ID",))]
    cols = {"a": "int", "b": "int", "c": "int", "d": "string"}
    found = lambda pk, fks: [r.asDict() for r in (lambda c: classify.inferred_relations(c.pk_frame(), c.fk_frame()))(shape(spark, cols, pk, fks)).collect()]
    r = found(["a", "b"], two)
    assert len(r) == 1 and (r[0]["column_1"], r[0]["ref_table_2"]) == ("a", "p")
    assert not found(["a", "b", "c"], [*two, (("c",), "o", ("ID",))])
    assert not found(["a"], [(("a", "b"), "o", ("ID", "ID2"))])
    assert not found(["d"], two)


def test_arbitration(spark):
    c = shape(spark, {"x": "int", "y": "int"}, ["x"], [])
    c.foreign_keys = [ForeignKey("o", ("ID",), "p", ("ID",), "k")]
    c.primary_keys["o"] = ("ID",)
    rule = classify.classify(c.columns_frame(), c.pk_frame(), c.fk_frame())
    agent = classify.with_agent(rule, lambda t: {"t": "SR", "o": "SE", "p": "SE"}[t])
    assert {(r.table, r.rule, r.agent) for r in classify.differing(rule, agent).collect()} == {("t", "SE", "SR"), ("o", "SH", "SE")}
    out = lambda **kw: {r.table: (r.pattern, r.reason) for r in classify.arbitrate(rule, agent, **kw).collect()}
    assert out() == {"t": ("SE", "rule"), "o": ("SH", "structure"), "p": ("SE", "agree")}
    assert out(rates=frame(spark, [("t", 0.9)], "table string, match_rate double"))["t"] == ("SR", "match_rate")
    assert out(counts=frame(spark, [("t", 0)], "table string, n_rows long"))["t"] == ("SR", "empty")
